"""Rows that every operator has to get right: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, copies string, _row string, `k.x` int"
LONG = ("lorem ipsum dolor sit amet " * 3000).strip()
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def row(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), "c", None, 1)


ROWS = [
    row(1, "one two three four five six seven eight"), row(2, "one  two\tthree four five six seven eight"), row(3, None, "b"), row(4, "", "b"), row(5, " \n\t ", None),
    row(6, LONG, "a"), row(7, LONG, None), row(8, "single"), row(8, "single"), row(None, "no id at all here", None), row(None, "no id at all here", None), row(9, WORDS, "ä"),
    row(10, WORDS + " omega", "Z"), row(11, "one two three four five six seven eight", "b"), row(9, "another text under a used id", "b"), row(12, "naïve Café 漢字 😀", "a", None),
]


def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

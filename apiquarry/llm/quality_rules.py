"""Quality rules: plain counts, and how far a text diverges from the language it is in.

Everything is a column expression. The plain counts (words, symbols, repeated lines and windows) fail short
and repetitive texts. What is left is compared with references of its language: the shares of
classes of characters, and the shares of the language's commonest words among its words, each by
Jensen-Shannon distance (base 2, so 0 to 1). A text of n characters or words diverges from its own language
by chance, too, by about (bins - 1) / (8 n ln 2) of squared distance, so the threshold grows by that as texts
get short, and texts below ``LEAST_LETTERS`` characters or ``LEAST_WORDS`` words are not compared at all.

References are learned from all documents. The common words are those held by most documents of the language.
Their shares are medians over ``PARTS`` parts of the language, dealt by a digest of the text: copies of one text
fall into one part, so a group of copies, however large, moves no reference. The shares of character classes
are medians over documents. The texts are read twice, once for the common words and once for all counts.

Every language (any value of ``lang``, NULL too) has references. Those of languages that hold at least one in
``LANGUAGE_SHARE`` documents are of a bounded size and are broadcast; the texts of rarer ones, however many
languages that are, meet theirs by shuffled joins on ``lang``.

Defined results: a NULL or empty text has no words and fails the base rules. Repeated rows and NULL ids get a
row each. Very long texts are measured whole. Further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apiquarry.session import cut_lineage

#: Fixed rules: words of a text at least, and the share of its words in repeated windows at most (in percent).
FEWEST_WORDS, REPEATED = 50, 50
WORD, WHITE, SYMBOL = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
#: Classes of characters in the order in which they are taken out of a text; what is left is the last class.
CLASSES = (r"\p{Ll}", WHITE, r"\p{Lu}", r"[\p{L}\p{M}]", r"\p{N}", r"[.,;:]", r"[!?]", r"[\p{Pd}'\"()‘-‟«»]")
#: What separates the terms of the word histogram; longer terms are no common words.
NO_TERM, LONGEST_TERM = r"\P{L}+", 10
COMMON, PARTS, STEPS = 32, 32, 512
LANGUAGE_SHARE = 4096
LEAST_LETTERS, LEAST_WORDS = 200, 50
#: Greatest distances of long texts.
FAR_CLASSES, FAR_WORDS = 0.3, 0.33


def _bodies(docs: DataFrame, text: str, key: str, lang: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))


def _terms() -> Column:
    return F.array_remove(F.split(F.lower("body"), NO_TERM), "")


def _top(rows: DataFrame, count: str, least: int = 0) -> DataFrame:
    """``lang, words``: the ``COMMON`` terms of each language with the highest counts."""
    order = Window.partitionBy("lang").orderBy(F.col(count).desc(), "term")
    best = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= COMMON)
    return best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("best")).select("lang", F.col("best.term").alias("words"))


def common_words(bodies: DataFrame) -> DataFrame:
    """``u_lang, words, usual`` of every language: the words that most of its documents hold, and whether it is not rare."""
    sizes = bodies.groupBy("lang").agg(F.count("*").alias("docs"))
    # one row of a total; one in LANGUAGE_SHARE leaves at most so many usual languages, whatever the table
    shares = sizes.join(F.broadcast(sizes.agg(F.sum("docs").alias("all_docs")))).select(F.col("lang").alias("u_lang"), (F.col("docs") * LANGUAGE_SHARE >= F.col("all_docs")).alias("usual"))
    held = bodies.select("lang", F.explode(F.array_distinct(_terms())).alias("term")).filter(F.length("term") <= LONGEST_TERM).groupBy("lang", "term").agg(F.count("*").alias("docs"))
    return shares.join(_top(held, "docs"), F.col("u_lang").eqNullSafe(F.col("lang")), "left").select("u_lang", F.coalesce("words", F.array().cast("array<string>")).alias("words"), "usual")


def _with_classes(bodies: DataFrame) -> DataFrame:
    """Adds ``classes``, the characters of each class; every step leaves less for the next."""
    out = bodies.withColumn("rest0", F.col("body"))
    for i, pattern in enumerate(CLASSES):
        out = out.withColumn(f"rest{i + 1}", F.regexp_replace(f"rest{i}", f"{pattern}+", ""))
    sizes = [F.length(f"rest{i}") for i in range(len(CLASSES) + 1)]
    counts = [a - b for a, b in zip(sizes, sizes[1:])] + [sizes[-1]]
    return out.withColumn("classes", F.array(*counts)).drop(*[f"rest{i}" for i in range(len(CLASSES) + 1)])


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words inside windows of three that occur again.

    The windows are sorted beside their places, so equal ones are neighbours; no hash is involved.
    """
    n = F.size("words")
    windows = F.sort_array(F.arrays_zip(F.slice("words", F.lit(1), n - 2), F.slice("words", F.lit(2), n - 2), F.slice("words", F.lit(3), n - 2), F.sequence(F.lit(0), n - 3)))
    out = rows.withColumn("windows", F.when(n > 3, windows))
    near = F.size("windows") - 1

    def alike(a: Column, b: Column) -> Column:
        # neighbours often begin alike
        return F.when((a["2"] == b["2"]) & (a["1"] == b["1"]) & (a["0"] == b["0"]), F.array(a["3"], b["3"]))

    out = out.withColumn("again", F.zip_with(F.slice("windows", F.lit(1), near), F.slice("windows", F.lit(2), near), alike)).drop("windows")
    out = out.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.array_compact("again"))))).drop("again")
    gaps = F.zip_with(F.slice("at", F.lit(1), F.size("at") - 1), F.slice("at", F.lit(2), F.size("at") - 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("at") > 0, F.aggregate(gaps, F.lit(3), lambda s, x: s + x)).otherwise(F.lit(0))
    return out.withColumn("n_repeat_words", covered.cast("bigint")).drop("at")


def base_rules(bodies: DataFrame) -> DataFrame:
    """Adds the plain counts and ``base_failed`` to rows with a ``body``."""
    body = F.col("body")
    out = bodies.withColumns({"words": F.array_remove(F.split(body, f"{WHITE}+"), ""), "lines": F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))})
    out = _with_repeats(out).withColumns(
        {
            "n_words": F.size("words").cast("bigint"),
            "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
            "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, f"{SYMBOL}+", ""))).cast("bigint"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        }
    )
    return out.withColumn("base_failed", (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))).drop("words", "lines")


def _total(values: Column | str) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _with_line(bodies: DataFrame, is_common: Callable[[Column], Column]) -> DataFrame:
    """The plain counts, ``n_terms``, and ``line``, the terms that are common words."""
    rows = base_rules(_with_classes(bodies)).withColumn("terms", _terms())
    return rows.withColumns({"n_terms": F.size("terms").cast("bigint"), "line": F.array_join(F.filter("terms", is_common), "  ")}).drop("terms")


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Everything that is counted in a text: a few numbers per row, so the texts are not needed again."""
    bodies = _bodies(docs, text, key, lang)
    known = cut_lineage(common_words(bodies)).withColumnRenamed("words", "u_words")
    usual, rare = known.filter("usual"), known.filter("NOT usual")
    spoken = F.col("lang").eqNullSafe(F.col("u_lang"))
    # the common words of all usual languages, a bounded list, leave few terms to count
    every = [r["w"] for r in usual.select(F.explode("u_words").alias("w")).distinct().collect()]
    # a bounded table, see ``common_words``
    rows = _with_line(bodies.join(F.broadcast(usual), spoken), lambda t: t.isin(every))
    if not rare.isEmpty():
        rows = rows.unionByName(_with_line(bodies.join(rare.hint("shuffle_hash"), spoken), lambda t: F.array_contains("u_words", t)))
    # terms between two blanks each, so that a word is found by replacing it, neighbours of its kind too
    rows = rows.withColumn("line", F.concat(F.lit(" "), "line", F.lit(" "))).withColumn("bytes", F.octet_length("line"))
    common = F.transform("u_words", lambda w: ((F.col("bytes") - F.octet_length(F.replace("line", F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)).cast("bigint"))
    part = F.conv(F.substring(F.md5(F.col("body").cast("binary")), 1, 2), 16, 10).cast("int") % PARTS
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select("doc_id", "lang", "usual", part.alias("part"), *counts, "classes", (_total("classes") - F.col("classes")[1]).alias("letters"), "n_terms", common.alias("common"))


def references(rows: DataFrame) -> DataFrame:
    """``r_lang, r_classes, r_shares`` of each language that has common words, from what ``measured`` counts.

    The share of a class of characters is the median over the language's documents, to one in ``STEPS``; that of
    a common word is the median over parts of the language (the lower of two middle ones).
    """
    spoken = rows.filter("common IS NOT NULL")
    each = spoken.filter(F.col("letters") >= LEAST_LETTERS).select(
        "lang", F.posexplode(F.transform("classes", lambda c: F.round(STEPS * c / _total("classes")).cast("int"))).alias("place", "step")
    )
    steps = each.groupBy("lang", "place", "step").agg(F.count("*").alias("n"))
    line = Window.partitionBy("lang", "place")
    halves = steps.withColumns({"below": F.sum("n").over(line.orderBy("step")), "all": F.sum("n").over(line)}).filter(2 * F.col("below") >= F.col("all"))
    medians = halves.groupBy("lang", "place").agg((F.min("step") / STEPS).alias("share"))
    classes = medians.groupBy(F.col("lang").alias("r_lang")).agg(F.array_sort(F.collect_list(F.struct("place", "share"))).alias("c"))
    parts = spoken.select("lang", "part", "n_terms", F.posexplode("common").alias("place", "n")).groupBy("lang", "part", "place").agg(F.try_divide(F.sum("n"), F.sum("n_terms")).alias("share"))
    middle = parts.filter("share IS NOT NULL").groupBy("lang", "place").agg(F.array_sort(F.collect_list("share")).alias("seen"))
    shares = middle.groupBy(F.col("lang").alias("w_lang")).agg(
        F.array_sort(F.collect_list(F.struct("place", F.get("seen", F.floor((F.size("seen") - 1) / 2).cast("int")).alias("share")))).alias("w")
    )
    joined = classes.join(shares, F.col("r_lang").eqNullSafe(F.col("w_lang")), "left")
    return joined.select("r_lang", F.col("c.share").alias("r_classes"), F.col("w.share").alias("r_shares"))


def divergence(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon divergence, base 2, of an array of counts from an array of shares; both are scaled to sum 1."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    def part(x: Column, middle: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(F.lit(0.0))

    n, m = total(counts), total(shares)
    pairs = F.zip_with(counts, shares, lambda c, s: F.struct(c.alias("p"), s.alias("q")))
    scaled = F.transform(F.array(F.struct(n.alias("n"), m.alias("m"))), lambda t: F.transform(pairs, lambda x: F.struct(F.try_divide(x["p"], t["n"]).alias("p"), F.try_divide(x["q"], t["m"]).alias("q"))))
    terms = F.transform(scaled[0], lambda x: part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2))
    return F.greatest(F.lit(0.0), total(terms) / 2)


def _too_far(square: str, far: float, bins: Column, n: str) -> Column:
    chance = (bins - 1) / (8 * math.log(2) * F.col(n))
    return F.coalesce(F.col(square) > far * far + chance, F.lit(False))


def judged(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """``doc_id``, the counts, ``base_failed, kept``, and the distances from the language's references (NULL where not compared)."""
    counted = cut_lineage(measured(docs, text, key, lang))
    usual, rare, spoken = counted.filter("usual"), counted.filter("NOT usual"), F.col("lang").eqNullSafe(F.col("r_lang"))
    # at most one row per common-word list, see ``common_words``
    rows = usual.join(F.broadcast(references(usual)), spoken, "left")
    if not rare.isEmpty():
        rows = rows.unionByName(rare.join(references(rare).hint("shuffle_hash"), spoken, "left"))
    doubles = F.transform("common", lambda c: c.cast("double"))
    rest, other = F.col("n_terms") - _total("common"), F.greatest(F.lit(0.0), 1 - F.aggregate("r_shares", F.lit(0.0), lambda s, x: s + x))
    by_class = divergence(F.transform("classes", lambda c: c.cast("double")), F.col("r_classes"))
    by_word = divergence(F.concat(doubles, F.array(rest.cast("double"))), F.concat("r_shares", F.array(other)))
    rows = rows.withColumns(
        {
            "by_class": F.when(~F.col("base_failed") & (F.col("letters") >= LEAST_LETTERS) & F.col("r_classes").isNotNull(), by_class),
            "by_word": F.when(~F.col("base_failed") & (F.col("n_terms") >= LEAST_WORDS) & (F.size("r_shares") > 1), by_word),
        }
    )
    far = _too_far("by_class", FAR_CLASSES, F.lit(len(CLASSES) + 1), "letters") | _too_far("by_word", FAR_WORDS, F.size("r_shares") + 1, "n_terms")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select("doc_id", *counts, (~F.col("base_failed") & ~far).alias("kept"), F.sqrt("by_class").alias("class_distance"), F.sqrt("by_word").alias("word_distance"))

import collections
import math
import re

from apiquarry.llm import reversed_search

from . import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, k):
    docs = [(r[0], terms(r[1])) for r in rows]
    n_docs, total = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = collections.Counter(w for _, t in docs for w in set(t))
    out = []
    for item, text in set(items):
        asked, found = collections.Counter(terms(text)), []
        for doc, own in docs:
            tf = collections.Counter(own)
            score = sum(
                n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * (25 + 75 * len(own) * n_docs // total)))
                for w, n in asked.items() if w in tf
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, doc, -less) for rank, (less, _, _, doc) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "one TWO three one"), (2, None), (3, "漢字 naïve alpha"), (4, "..."), (None, "single"), (1, "lorem omega"), (1, "lorem omega"), (5, "nowhere_to be-found id"), (6, "alpha " * 5000)]


def test_odd_rows_in_blocks_of_any_size(spark, monkeypatch):
    rows = [*cases.ROWS, *[cases.row(2**60 + i, "one two") for i in range(30)]]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(5)
    items = spark.createDataFrame([(i, t, 7) for i, t in ITEMS], "item_id bigint, text string, score int")
    for block, k in ((4096, 10), (2, 3)):
        monkeypatch.setattr(reversed_search, "BLOCK_ITEMS", block)
        got = [tuple(r) for r in reversed_search.best_documents(docs, items, k).collect()]
        assert sorted(got, key=repr) == brute(rows, ITEMS, k)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert reversed_search.best_documents(cases.empty(spark), items).collect() == []
    assert reversed_search.best_documents(cases.odd(spark), items.limit(0)).collect() == []

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from apiquarry.llm import components, exact_dedup, minhash

from . import cases


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact_brute(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    return sorted(
        ((r[0], min((x for x in groups[norm(r[1])] if x is not None), default=None), len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows), key=repr
    )


def test_exact_duplicates_agree_with_brute_force(spark):
    got = exact_dedup.duplicates(cases.odd(spark)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == exact_brute(cases.ROWS)
    # one row of every distinct text stays
    assert sum(r.kept for r in got) == len({norm(r[1]) for r in cases.ROWS})
    assert len({r.text_sha256 for r in got if r.kept}) == sum(r.kept for r in got)


def test_exact_keep_first_returns_whole_rows(spark):
    kept = exact_dedup.keep_first(cases.odd(spark))
    assert kept.columns == cases.odd(spark).columns
    rows = kept.collect()
    assert len(rows) == len({norm(r[1]) for r in cases.ROWS})
    assert {r.doc_id for r in rows if r.text and r.text.startswith("one")} == {1}


def test_exact_on_an_empty_table(spark):
    assert exact_dedup.duplicates(cases.empty(spark)).count() == 0
    assert exact_dedup.keep_first(cases.empty(spark)).count() == 0


def test_fingerprints_compose_from_chunks():
    (p, b), data = exact_dedup.FIELDS[0], random.Random(1).randbytes(1000)
    powers = exact_dedup._powers(p, b, 1000)
    whole = 0
    for x in data:
        whole = (whole * b + x + 1) % p
    cut = [data[:300], data[300:301], data[301:]]
    rests = [700, 699, 0]
    assert sum(exact_dedup.chunk_hash(c, p, powers) * pow(b, r, p) for c, r in zip(cut, rests)) % p == whole


def test_texts_with_equal_fingerprints_are_told_apart(spark, monkeypatch):
    """With a fingerprint that is the length only, comparison and SHA-256 have to do the work."""
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda docs, text, key: _by_length(docs, text, key))
    original = exact_dedup._hashed

    def _by_length(docs, text, key):
        return original(docs, text, key).groupBy("doc_id", "sha", "n").count().selectExpr("doc_id", "sha", "n", "0L h1", "0L h2", "count copies")

    docs = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "abc"), (4, "xyzw")], "doc_id bigint, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup.duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near_brute(rows, width):
    sets = [shingles(r[1], width) for r in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            label[b] = a
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    return sorted(((r[0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_agree_with_brute_force(spark, width):
    got = minhash.near_duplicates(cases.odd(spark), width=width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == near_brute(cases.ROWS, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_families_with_chains_and_long_lists(spark, monkeypatch):
    """Copies of a text with few and many changes, and a passage that unrelated texts share."""
    monkeypatch.setattr(minhash, "LONG_LIST", 8)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base, passage = rng.choices(vocabulary, k=150), rng.choices(vocabulary, k=60)
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 2, 4, 8, 12])):
            words[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    for i in range(60, 100):
        rows.append((i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 10, 60])) + passage)))
    for i in range(100, 130):  # a chain: each differs a little from the one before
        rows.append((i, " ".join(vocabulary[(i - 100) * 5 : (i - 100) * 5 + 100])))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == near_brute(rows, 2)


def test_long_lists_meet_their_leaders_class_by_class(spark, monkeypatch):
    """What is joined on the leader are classes with their sets, not their shingles; shingles it lacks are looked up first."""
    shared = list(range(8))
    sets = [(0, [*shared, 100, 101])] + [(i, [*shared, 200 + (i + 1) // 2, 300 + (i + 1) // 2]) for i in range(1, 8)]
    mixed = [(1, i, 10, 5, i, 0, 8) for i in range(8)]
    pairs = minhash._long_pairs(
        spark.createDataFrame(mixed, "value bigint, cid bigint, n bigint, shared bigint, comp bigint, main bigint, members bigint"),
        spark.createDataFrame([(1, 0, 8)], "value bigint, leader bigint, members bigint"),
        spark.createDataFrame(sets, "cid bigint, shingles array<bigint>"),
    )
    assert "LeftOuter" not in pairs._jdf.queryExecution().analyzed().toString()
    # no class meets the family behind the list
    assert {(r.x, r.y) for r in pairs.collect()} == {(1, 2), (3, 4), (5, 6)}


def test_unrelated_texts_with_common_shingles_do_not_meet(spark, monkeypatch):
    """Each pair of words is in a dozen texts, no two texts are alike: no whole set is asked for."""
    monkeypatch.setattr(minhash, "LONG_LIST", 8)
    asked, sets_of = [], minhash._sets_of
    monkeypatch.setattr(minhash, "_sets_of", lambda *a: asked.append(sets_of(*a)) or asked[-1])
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(40)], k=120))) for i in range(150)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect()
    assert len(got) == 150 and all(r.doc_id == r.component_id and r.kept for r in got)
    assert asked and sum(x.count() for x in asked) <= 2


def test_sets_that_may_be_linked_share_bands():
    """At the limit, small and large sets agree in a third of their bands, whatever their hashes."""
    rng = np.random.default_rng(3)
    for small, large in ((4, 5), (8, 10), (400, 500)):
        agree = []
        for _ in range(300):
            every = np.unique(rng.integers(0, 2**63, large))
            keys = minhash.band_keys(np.stack([minhash.minima(np.sort(every)), minhash.minima(np.sort(rng.permutation(every)[:small]))]))
            agree.append((keys[0] == keys[1]).sum())
        assert min(agree) >= 2 and abs(np.mean(agree) - minhash.BANDS * 0.8**minhash.BAND) < 1 and np.std(agree) < 4.2


def test_near_keep_one_returns_whole_rows(spark):
    docs = cases.odd(spark).dropDuplicates(["doc_id", "text"])
    kept = minhash.keep_one(docs, width=2)
    assert kept.columns == docs.columns
    want = {(r[0], r[1]) for r in cases.ROWS} - {(2, cases.ROWS[1][1]), (7, cases.LONG), (10, cases.ROWS[12][1]), (11, cases.ROWS[0][1])}
    assert {(r.doc_id, r.text) for r in kept.collect()} == want
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.comp for r in components.connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}

import random

from facts import endpoints
from pyspark.sql import functions as F

from apiquarry.functions import paths
from apiquarry.operators import inventory, merge


def run(spark, static, runtime):
    s = endpoints(spark, [{"origin": ("static_scan", "x", None), "confidence": "medium", "source": ("a.py", i, 0), **r} for i, r in enumerate(static)])
    r = endpoints(spark, [{"origin": ("runtime", None, None), "confidence": "high", **x} for x in runtime])
    merged = merge.merge_inventories(s, r)
    rows = merged.select("*", paths.display(F.col("method"), F.col("path")).alias("d")).collect()
    return {r["d"]: r for r in rows}, rows, merged


def test_matched_only_and_report(spark):
    by, rows, merged = run(
        spark,
        [{"method": "GET", "path": "/a/{id}", "group": "s", "orphaned": True, "metadata": {"k": "1"}}, {"method": "GET", "path": "/gone"}],
        [{"method": "GET", "path": "/a/{other}", "summary": "r", "metadata": {"m": "2"}}, {"method": "POST", "path": "/new"}],
    )
    got = by["GET /a/{other}"]
    assert (got["group"], got["summary"], got["orphaned"], got["confidence"], got["source"]["file"]) == ("s", "r", False, "high", "a.py")
    assert got["metadata"] == {"k": "1", "m": "2", "enrich": "matched"}
    assert by["GET /gone"]["confidence"] == "low" and by["GET /gone"]["metadata"]["enrich"] == "static_only"
    assert by["POST /new"]["metadata"]["enrich"] == "runtime_only" and by["POST /new"]["source"] is None
    assert merge.merge_report(merged).first()[1:] == (1, 1, 1, 0)


def test_gap_rules(spark):
    by, *_ = run(
        spark,
        [{"method": "GET", "path": "/?X/stats"}, {"method": "GET", "path": "/?Y/list"}, {"method": "POST", "path": "/?Z/stats"}, {"method": "GET", "path": "/v/{a}/?W/end"}],
        [
            {"method": "GET", "path": "/admin/stats"}, {"method": "GET", "path": "/a/list"}, {"method": "GET", "path": "/b/list"},
            {"method": "GET", "path": "/v/{q}/x/y/end"}, {"method": "GET", "path": "/v/lit/z/end"}, {"method": "POST", "path": "/stats"},
        ],
    )
    assert by["GET /admin/stats"]["metadata"] == {"enrich": "gap_filled", "resolved_from": "X"}
    assert by["GET /v/{q}/x/y/end"]["metadata"]["enrich"] == "gap_filled"
    assert by["GET /?/list"]["metadata"]["enrich"] == "static_only"
    assert by["POST /?/stats"]["metadata"]["enrich"] == "static_only"
    assert by["GET /a/list"]["metadata"]["enrich"] == "runtime_only"


def test_catch_all_duplicates_and_unknown_methods(spark):
    by, rows, _ = run(
        spark,
        [
            {"method": "GET", "path": "/f/{name:path}"}, {"method": "GET", "path": "/dup"}, {"method": "GET", "path": "/dup"},
            {"method": "POST", "path": "/view"}, {"method": "PUT", "path": "/view"},
        ],
        [{"method": "GET", "path": "/f/{name}"}, {"method": "GET", "path": "/dup"}, {"method": "GET", "path": "/view", "metadata": {"methods-unknown": "true"}}],
    )
    assert by["GET /f/{name}"]["metadata"]["enrich"] == "matched"
    assert sorted(r["metadata"]["enrich"] for r in rows if r["d"] == "GET /dup") == ["matched", "static_only"]
    assert by["POST /view"]["metadata"]["enrich"] == "matched" and by["PUT /view"]["id"] == "PUT /view"
    assert by["GET /view"]["metadata"]["enrich"] == "runtime_only"


def _fold(pairs):
    """The rule as stated: gaps in order, each takes its one free candidate."""
    taken, out = set(), {}
    for sid in sorted({s for s, _ in pairs}):
        free = [r for s, r in pairs if s == sid and r not in taken]
        if len(free) == 1:
            taken.add(free[0])
            out[sid] = free[0]
    return out


def test_settling_equals_the_sequential_rule(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for project in range(60):
        pairs = {(rng.randrange(8), rng.randrange(7)) for _ in range(rng.randrange(1, 16))}
        rows += [(str(project), s, str(r), s) for s, r in pairs]
        want.update({(str(project), s): str(r) for s, r in _fold(pairs).items()})
    df = spark.createDataFrame(rows, "project_id string, sid bigint, rid string, ord bigint")
    got = {(r["project_id"], r["sid"]): r["rid"] for r in merge.settle_gaps(df).collect()}
    assert got == want


def test_drift(spark):
    a = spark.createDataFrame([("p", "GET /a"), ("p", "GET /b"), ("p", "GET /b")], "project_id string, d string")
    b = spark.createDataFrame([("p", "GET /b"), ("p", "GET /c")], "project_id string, d string")
    got = sorted((r["d"], r["change"]) for r in inventory.drift(a, b, ["project_id", "d"]).collect())
    assert got == [("GET /a", "removed"), ("GET /b", "removed"), ("GET /c", "added")]


def test_gaps_of_one_class_settle_without_pairs(spark):
    rng = random.Random(9)
    gaps, offers, pairs, want = [], [], [], {}
    for project in range(60):
        name, classes = str(project), rng.randrange(1, 5)
        sets = [sorted(rng.sample(range(6), rng.randrange(1, 5))) for _ in range(classes)]
        asks = [(s, rng.randrange(classes)) for s in rng.sample(range(30), rng.randrange(1, 14))]
        gaps += [(name, c, s, s) for s, c in asks]
        offers += [(name, c, str(r), 1) for c in range(classes) for r in sets[c]]
        want.update({(name, s): str(r) for s, r in _fold({(s, r) for s, c in asks for r in sets[c]}).items()})
    g = spark.createDataFrame(gaps, "project_id string, cls int, sid bigint, ord bigint")
    o = spark.createDataFrame(offers, "project_id string, cls int, rid string, weight bigint")
    got = {(r["project_id"], r["sid"]): r["rid"] for r in merge.settle_classes(g, o).collect()}
    assert got == want


def test_many_ambiguous_gaps_stay_in_one_class(spark):
    # 400 gaps that ask for the same and 400 candidates: 160,000 pairs, 400 candidates of a class
    static = [{"method": "GET", "path": "/?Y/many"}] * 400 + [{"method": "GET", "path": "/?X/one"}]
    runtime = [{"method": "GET", "path": f"/o{i}/many"} for i in range(400)] + [{"method": "GET", "path": "/a/one"}]
    s = endpoints(spark, [{"origin": ("static_scan", "x", None), "confidence": "medium", "source": ("a.py", i, 0), **r} for i, r in enumerate(static)])
    r = endpoints(spark, [{"origin": ("runtime", None, None), "confidence": "high", **x} for x in runtime])
    asks, offers = merge.gap_candidates(s.withColumn("sid", F.col("seq")), r.withColumn("rid", F.col("id")))
    assert asks.count() == 401 and offers.count() == 401
    assert merge.merge_report(merge.merge_inventories(s, r)).first()[1:] == (0, 400, 400, 1)

import heapq
import random

from pyspark.sql import functions as F

from apiquarry.operators import flows, runs, variables

NODE = (
    "project_id string, flow string, node_id string, doc_index int, type string, texts array<string>, spec_ref string, "
    "extract array<struct<name:string,`from`:string,header:string,path:string>>, "
    "assert array<struct<`from`:string,header:string,path:string,op:string,expected:string>>, "
    "left string, op string, right string, variables array<struct<name:string,value:string>>, text string"
)
EDGE = "project_id string, flow string, from_node string, to_node string, handle string, edge_index int"


def nodes(spark, rows):
    names = [f.split(" ")[0] for f in NODE.replace("<`from`:string,header:string,path:string", "<").split(", ")]
    cols = ["project_id", "flow", "node_id", "doc_index", "type", "texts", "spec_ref", "extract", "assert", "left", "op", "right", "variables", "text"]
    assert len(cols) == 14 and names
    counts, data = {}, []
    for r in rows:
        flow = r.get("flow", "f")
        counts[flow] = counts.get(flow, -1) + 1
        base = {"project_id": "p", "flow": flow, "doc_index": counts[flow], "type": "request", "extract": [], "assert": [], "texts": [], "variables": []}
        data.append(tuple({**base, **r}.get(c) for c in cols))
    return spark.createDataFrame(data, NODE)


def edges(spark, rows):
    return spark.createDataFrame([("p", r[3] if len(r) > 3 else "f", r[0], r[1], r[2] if len(r) > 2 else None, i) for i, r in enumerate(rows)], EDGE)


def _kahn(n, pairs):
    indeg = [0] * n
    for _, b in pairs:
        indeg[b] += 1
    ready = [i for i in range(n) if not indeg[i]]
    heapq.heapify(ready)
    out = []
    while ready:
        i = heapq.heappop(ready)
        out.append(i)
        for a, b in pairs:
            if a == i:
                indeg[b] -= 1
                if not indeg[b]:
                    heapq.heappush(ready, b)
    return out


def test_order_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    node_rows, edge_rows, want = [], [], {}
    for k in range(40):
        n = rng.randrange(1, 9)
        shuffled = list(range(n))
        rng.shuffle(shuffled)
        pairs = {(shuffled[i], shuffled[j]) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3}
        flow = f"f{k}"
        node_rows += [{"flow": flow, "node_id": f"n{i}"} for i in range(n)]
        edge_rows += [(f"n{a}", f"n{b}", None, flow) for a, b in pairs] * 2
        want[flow] = [f"n{i}" for i in _kahn(n, pairs)]
    got = flows.execution_order(nodes(spark, node_rows), edges(spark, edge_rows)).toPandas()
    for flow, order in want.items():
        mine = got[got.flow == flow].sort_values("pos")
        assert list(mine.node_id) == order and list(mine.pos) == list(range(len(order)))


def test_input_blocks_first_depth_and_components(spark):
    ns = nodes(spark, [{"node_id": "a"}, {"node_id": "b"}, {"node_id": "v", "type": "variables", "variables": [("t", "1")]}, {"node_id": "c"}, {"node_id": "x"}])
    es = edges(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("a", "c")])
    order = flows.execution_order(ns, es).orderBy("pos").toPandas()
    assert list(order.node_id) == ["v", "a", "b", "c", "x"]
    assert {r["node_id"]: r["depth"] for r in flows.depth(ns, es).collect()} == {"a": 0, "b": 1, "c": 2, "v": 0, "x": 0}
    parts = {r["node"]: r["component"] for r in flows.flow_components(ns, es).collect()}
    assert parts == {"a": "a", "b": "a", "c": "a", "v": "v", "x": "x"}
    pick = spark.createDataFrame([("p", "f", "c")], "project_id string, flow string, node_id string")
    assert {r["node_id"] for r in flows.ancestors(es, pick).collect()} == {"a", "b"}
    for scope, want in [("all", {"a", "b", "c", "v", "x"}), ("step", {"c", "v"}), ("connected", {"a", "b", "c", "v"})]:
        asked = spark.createDataFrame([("p", "f", scope, "c")], "project_id string, flow string, scope string, selected string")
        assert {r["node_id"] for r in flows.run_scope(ns, es, asked).collect()} == want
    assert {r["name"] for r in flows.upstream_variables(ns, es, pick).collect()} == {"t"}


def test_long_chain_components(spark):
    ns = nodes(spark, [{"node_id": f"{i:03d}"} for i in range(60)])
    es = edges(spark, [(f"{i:03d}", f"{i + 1:03d}") for i in range(59)])
    assert {r["component"] for r in flows.flow_components(ns, es).collect()} == {"000"}


def test_validation(spark):
    ns = nodes(
        spark,
        [{"node_id": "a"}, {"node_id": "a"}, {"flow": "g", "node_id": "a"}, {"flow": "g", "node_id": "c", "type": "condition"}, {"flow": "h", "node_id": "x"},
         {"flow": "h", "node_id": "y"}, {"flow": "h", "node_id": "z"}, {"flow": "h", "node_id": "q"}, {"flow": "ok", "node_id": "o"}],
    )
    es = edges(
        spark,
        [("a", "ghost"), ("a", "a", None, "g"), ("a", "c", "true", "g"), ("c", "a", None, "g"), ("c", "a", "true", "g"), ("x", "y", None, "h"), ("y", "z", None, "h"), ("z", "y", None, "h")],
    )
    found = flows.validate_flow(ns, es)
    got = sorted((r["flow"], r["rule"], r["node"], r["handle"]) for r in found.collect())
    assert got == sorted([
        ("f", "duplicate_node", "a", None), ("f", "dangling_edge", "ghost", None), ("g", "self_loop", "a", None), ("g", "unknown_handle", "a", "true"),
        ("g", "unknown_handle", "c", ""), ("h", "cycle", "y", None), ("h", "cycle", "z", None),
    ], key=lambda r: (r[0], r[1], r[2], r[3]))
    first = {r["flow"]: r["rule"] for r in flows.first_problem(found).collect()}
    assert first == {"f": "duplicate_node", "g": "self_loop", "h": "cycle"}
    assert {r["depth"] for r in flows.depth(ns.filter("flow = 'h'"), es.filter("flow = 'h'")).collect()} == {0}


def test_lint(spark):
    ns = nodes(
        spark,
        [
            {"node_id": "use", "texts": ["{{base}}/{{tok}}/{{ghost}}"], "assert": [("status", None, None, "equals", "{{tok}}")], "spec_ref": "GET /gone"},
            {"node_id": "set", "extract": [("tok", "body", None, "t")], "spec_ref": "GET /here"},
            {"node_id": "v", "type": "variables", "variables": [("one", "{{two}}"), ("two", "2"), ("three", "{{two}}")]},
            {"node_id": "d", "type": "display", "text": "{{tok}} {{three}} {{secret:k}} {{secret:none}}"},
        ],
    )
    es = edges(spark, [("set", "d")])
    vs = spark.createDataFrame([("p", "base"), ("p", "secret:k")], "project_id string, name string")
    eps = spark.createDataFrame([("p", "GET /here")], "project_id string, id string")
    got = sorted((r["node_id"], r["rule"], r["subject"]) for r in flows.lint_flows(ns, es, vs, eps).collect())
    assert got == [
        ("d", "undefined", "secret:none"), ("set", "no_assertions", None), ("use", "set_later", "tok"), ("use", "set_later", "tok"),
        ("use", "stale_spec_ref", "GET /gone"), ("use", "undefined", "ghost"), ("v", "undefined", "two"),
    ]


def evaluate(spark, ns, es, recorded, base=(), only=None, seeds=None):
    vs = spark.createDataFrame([("p", "dev", *v) for v in [("environment", "zz", "1"), *base]], "project_id string, environment string, scope string, name string, value string")
    rs = spark.createDataFrame([("p", "r1", "f", "dev")], "project_id string, run_id string, flow string, environment string")
    rec = spark.createDataFrame(
        [("p", "r1", n, e, x) for n, e, x in recorded],
        "project_id string, run_id string, node_id string, transport_error string, x struct<status:int,total_ms:bigint,response_headers:array<struct<name:string,value:string>>,body:string>",
    )
    steps = runs.prepare_steps(rs, flows.execution_order(ns, es), ns, es, rec, only)
    out = runs.evaluate_runs(steps, variables.scope_maps(vs), seeds)
    return {r["node_id"]: r for r in out.collect()}, out


def test_runs_extract_branch_and_fail(spark):
    ok = [("status", None, None, "equals", "200")]
    ns = nodes(
        spark,
        [
            {"node_id": "in", "type": "variables", "variables": [("a", "1"), ("b", "{{a}}2"), ("", "x")]},
            {"node_id": "login", "texts": ["{{base}}/login/{{b}}"], "extract": [("tok", "body", None, "t"), ("h", "header", "x-id", None)], "assert": ok},
            {"node_id": "if", "type": "condition", "left": "{{tok}}", "op": "equals", "right": "abc"},
            {"node_id": "yes", "texts": ["{{tok}}"], "assert": [("body", None, "n", "greater_than", "{{a}}"), ("status", None, None, "equals", "500")]},
            {"node_id": "no", "texts": [], "assert": ok},
            {"node_id": "after_no", "type": "display", "text": "never"},
            {"node_id": "after_yes", "type": "display", "text": "x"},
            {"node_id": "far", "type": "display", "text": "y"},
            {"node_id": "show", "type": "display", "text": "{{tok}}-{{h}}-{{b}}"},
            {"node_id": "lost", "texts": ["{{nope}} {{gone}}"]},
            {"node_id": "down", "texts": []},
            {"node_id": "empty", "texts": [], "extract": [("q", "body", None, "none")]},
            {"node_id": "loop", "texts": ["{{self}}"]},
        ],
    )
    es = edges(spark, [("login", "if"), ("if", "yes", "true"), ("if", "no", "false"), ("no", "after_no"), ("yes", "after_yes"), ("after_yes", "far"), ("login", "show")])
    got, out = evaluate(
        spark, ns, es,
        [("login", None, (200, 5, [("X-Id", "7")], '{"t":"abc","n":3}')), ("yes", None, (200, 5, [], '{"n":3}')), ("down", "refused", None), ("empty", None, (200, 1, [], "{}")), ("loop", None, (200, 1, [], "{}"))],
        base=[("environment", "base", "http://h"), ("environment", "self", "{{self}}")],
    )
    assert {n: r["status"] for n, r in got.items()} == {
        "in": "passed", "login": "passed", "if": "passed", "yes": "failed", "no": "skipped", "after_no": "skipped", "after_yes": "skipped", "far": "skipped",
        "show": "passed", "lost": "failed", "down": "failed", "empty": "failed", "loop": "failed",
    }
    assert got["if"]["branch"] == "true" and got["show"]["output"] == "abc-7-12"
    assert (got["no"]["reason_kind"], got["no"]["culprit"], got["no"]["handle"]) == ("branch_not_taken", "if", "false")
    assert (got["after_no"]["reason_kind"], got["after_no"]["culprit"]) == ("branch_not_taken", "if")
    assert (got["far"]["reason_kind"], got["far"]["culprit"]) == ("upstream_failed", "yes")
    assert (got["yes"]["failure_kind"], got["yes"]["failed_assertions"]) == ("assertions", 1)
    assert [a["passed"] for a in got["yes"]["assertions"]] == [True, False]
    assert got["lost"]["failure_name"] == "nope, gone"
    assert (got["down"]["failure_kind"], got["down"]["failure_message"]) == ("transport", "refused")
    assert (got["empty"]["failure_kind"], got["empty"]["failure_message"]) == ("extraction", "nothing at body path `none`")
    assert (got["loop"]["failure_kind"], got["loop"]["failure_message"]) == ("resolve", "reference in a circle: self")
    total = runs.run_summary(out).first()
    assert (total["passed"], total["failed"], total["skipped"], total["run_passed"]) == (4, 5, 4, False)
    run_edges = es.withColumn("run_id", F.lit("r1"))
    states = {(r["from_node"], r["to_node"]): r["state"] for r in flows.edge_state(run_edges, out, ["project_id", "run_id"]).collect()}
    assert states[("if", "yes")] == "taken" and states[("if", "no")] == "inactive" and states[("no", "after_no")] == "inactive"
    assert states[("yes", "after_yes")] == "dead" and states[("after_yes", "far")] == "dead"


def test_partial_run_with_seed(spark):
    ns = nodes(spark, [{"node_id": "a", "extract": [("t", "status", None, None)]}, {"node_id": "b", "type": "display", "text": "{{t}}"}])
    es = edges(spark, [("a", "b")])
    only = spark.createDataFrame([("p", "r1", "b")], "project_id string, run_id string, node_id string")
    seeds = spark.createDataFrame([("p", "r1", "t", "seeded")], "project_id string, run_id string, name string, value string")
    got, _ = evaluate(spark, ns, es, [("a", None, (200, 1, [], ""))], only=only, seeds=seeds)
    assert set(got) == {"b"} and got["b"]["output"] == "seeded"


def test_values_in_scope(spark):
    rng = random.Random(1)
    sets = sorted({(rng.randrange(50), rng.choice("ab")) for _ in range(30)})
    passing = spark.createDataFrame([("r", n, p, f"{n}{p}") for p, n in sets], "run_id string, name string, pos int, value string")
    at = spark.createDataFrame([("r", n, p) for p in range(50) for n in "ab"], "run_id string, name string, pos int")
    got = {(r["name"], r["pos"]): r["value"] for r in runs.values_in_scope(passing, at, ["run_id"], chunk=7).collect()}
    for n in "ab":
        for p in range(50):
            before = [q for q, m in sets if m == n and q < p]
            assert got[(n, p)] == (f"{n}{max(before)}" if before else None)


def _random_flows(spark, rng, count, most):
    node_rows, edge_rows = [], []
    for k in range(count):
        n = rng.randrange(1, most)
        node_rows += [{"flow": f"f{k}", "node_id": f"n{i}"} for i in range(n)]
        edge_rows += [(f"n{rng.randrange(n)}", f"n{rng.randrange(n + 1)}", None, f"f{k}") for _ in range(rng.randrange(n + 2))]
    return nodes(spark, node_rows), edges(spark, edge_rows)


def test_small_flows_take_no_rounds(spark, monkeypatch):
    ns, es = _random_flows(spark, random.Random(5), 30, 8)
    pick = ns.filter("doc_index < 2").select("project_id", "flow", "node_id")
    asked = ns.filter("doc_index = 0").selectExpr("project_id", "flow", "CASE WHEN flow < 'f2' THEN 'connected' WHEN flow < 'f3' THEN 'step' ELSE 'all' END AS scope", "node_id AS selected")

    def run():
        found = flows.layers(ns, es), flows.execution_order(ns, es), flows.ancestors(es, pick), flows.flow_components(ns, es), flows.run_scope(ns, es, asked)
        return [sorted(map(str, df.select(sorted(df.columns)).collect())) for df in found]

    with monkeypatch.context() as m:
        m.setattr(flows, "SMALL", 0)
        want = run()

    def never(*_):
        raise AssertionError("a small flow went through rounds of joins")

    for name in ("_layers_in_rounds", "_order_in_rounds", "_ancestors_in_rounds", "components"):
        monkeypatch.setattr(flows, name, never)
    assert run() == want


def test_flows_with_repeated_or_missing_names_and_large_ones(spark):
    rows = [{"flow": "long", "node_id": f"{i:02d}"} for i in range(40)] + [{"flow": "twice", "node_id": "a"}] * 2 + [{"flow": None, "node_id": "x"}, {"flow": "short", "node_id": "s"}]
    ns, es = nodes(spark, rows), edges(spark, [(f"{i:02d}", f"{i + 1:02d}", None, "long") for i in range(39)])
    depths = sorted((r["flow"] or "", r["node_id"], r["depth"]) for r in flows.depth(ns, es).collect())
    assert depths == [("", "x", 0), *(("long", f"{i:02d}", i) for i in range(40)), ("short", "s", 0), ("twice", "a", 0)]
    parts = {(r["flow"], r["component"]) for r in flows.flow_components(ns, es).collect()}
    assert parts == {(None, "x"), ("long", "00"), ("short", "s"), ("twice", "a")}

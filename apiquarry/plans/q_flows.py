"""Queries on test flows and their recorded runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from apiquarry.operators import flows, runs, variables
from apiquarry.operators.variables import spread_environments
from apiquarry.plans.base import query, table
from apiquarry.session import cut_lineage

c = F.col
P = "project_id"
_EXTRACT = "array<struct<name:string,`from`:string,header:string,path:string>>"
_ASSERT = "array<struct<`from`:string,header:string,path:string,op:string,expected:string>>"
_VARS = "array<struct<name:string,value:string>>"


def order_flows(spark, sf):
    """Every order is a flow, its line numbers are steps. The document lists steps by falling
    line number; edges run from each line to the next one present."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    base = lines.select(
        F.concat(F.lit("c"), c("l_orderkey") % 13).alias(P), c("l_orderkey").cast("string").alias("flow"), F.concat(F.lit("s"), "l_linenumber").alias("node_id"),
        (-c("l_linenumber")).alias("doc_index"), c("l_linenumber").alias("n"), c("l_orderkey").alias("k"),
    )
    nodes = base.select(
        P, "flow", "node_id", "doc_index", F.expr("CASE WHEN n = 7 AND k % 2 = 0 THEN 'variables' WHEN n = 5 THEN 'condition' ELSE 'request' END").alias("type"), "n", "k",
    )
    following = F.lead("n").over(Window.partitionBy(P, "flow").orderBy("n"))
    nexts = base.filter("k is not null and n is not null").select(P, "flow", "k", c("n").alias("a"), following.alias("b")).filter("b is not null")
    # Line seven stands alone in even orders.
    edges = nexts.filter("not (b = 7 and k % 2 = 0)").select(
        P, "flow", F.concat(F.lit("s"), "a").alias("from_node"), F.concat(F.lit("s"), "b").alias("to_node"), F.when(c("a") == 5, "true").alias("handle"), c("a").alias("edge_index"), "k", "a", "b",
    )
    return nodes, edges


LINES = """l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem),
 w AS (SELECT k, n, k % 2 = 0 AND n = 7 AS alone, lead(n) OVER (PARTITION BY k ORDER BY n) AS nxt, row_number() OVER (PARTITION BY k ORDER BY n) AS rn FROM l)"""


@query("execution_order", f"WITH {LINES} SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN alone THEN 0 ELSE 1 END, n) - 1 AS pos FROM w")
def execution_order(spark, sf):
    nodes, edges = order_flows(spark, sf)
    got = flows.execution_order(nodes, edges)
    return got.select(c("flow").cast("bigint").alias("k"), F.substring("node_id", 2, 1).cast("int").alias("n"), "pos")


@query("flow_depth", f"WITH {LINES} SELECT k, n, CASE WHEN alone THEN 0 ELSE rn - 1 END AS depth FROM w")
def flow_depth(spark, sf):
    nodes, edges = order_flows(spark, sf)
    return flows.depth(nodes, edges).select(c("flow").cast("bigint").alias("k"), F.substring("node_id", 2, 1).cast("int").alias("n"), "depth")


@query(
    "validate_flow",
    f"""WITH {LINES}, e AS (SELECT k, n AS a, nxt AS b, CASE WHEN n = 5 THEN CASE WHEN k % 5 = 0 THEN 'maybe' ELSE 'true' END END AS handle FROM w WHERE nxt IS NOT NULL AND NOT (nxt = 7 AND k % 2 = 0)),
 bad AS (SELECT k, 'unknown_handle' AS rule, 's' || a AS node, handle FROM e WHERE handle = 'maybe' UNION ALL SELECT k, 'dangling_edge', 'ghost', NULL FROM w WHERE k % 7 = 1 AND rn = 1 UNION ALL SELECT k, 'self_loop', 's' || n, NULL FROM w WHERE k % 7 = 2 AND rn = 1),
 cyc AS (SELECT k FROM w WHERE k % 7 = 3 AND NOT alone AND k NOT IN (SELECT k FROM bad) GROUP BY k HAVING count(*) > 1)
 SELECT * FROM bad UNION ALL SELECT w.k, 'cycle', 's' || n, NULL FROM w JOIN cyc USING (k) WHERE NOT alone""",
)
def validate_flow(spark, sf):
    """Order flows with a bad handle, an edge to nowhere, a self loop or an edge back."""
    nodes, edges = order_flows(spark, sf)
    ends = nodes.filter("not (n = 7 and k % 2 = 0)").groupBy(P, "flow", "k").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    first = nodes.groupBy(P, "flow", "k").agg(F.min("n").alias("a"))

    def extra(df, when, src, dst, index):
        kind = F.when(src == F.lit("s5"), "true")
        return df.filter(when).select(P, "flow", src.alias("from_node"), dst.alias("to_node"), kind.alias("handle"), F.lit(index).alias("edge_index"))

    name = lambda x: F.concat(F.lit("s"), x)
    plain = edges.select(P, "flow", "from_node", "to_node", F.when((c("a") == 5) & (c("k") % 5 == 0), "maybe").otherwise(c("handle")).alias("handle"), "edge_index")
    every = (
        plain.unionByName(extra(first, "k % 7 = 1", name(c("a")), F.lit("ghost"), 100))
        .unionByName(extra(first, "k % 7 = 2", name(c("a")), name(c("a")), 101))
        .unionByName(extra(ends, "k % 7 = 3 and a < b", name(c("b")), name(c("a")), 102))
    )
    found = flows.validate_flow(nodes.select(P, "flow", "node_id", "doc_index", "type"), every)
    return found.select(c("flow").cast("bigint").alias("k"), "rule", "node", "handle")


@query("flow_ancestors", f"WITH {LINES}, r AS (SELECT k, max(n) AS root FROM w WHERE NOT alone GROUP BY k) SELECT w.k, root, n FROM w JOIN r USING (k) WHERE n < root AND NOT alone")
def flow_ancestors(spark, sf):
    nodes, edges = order_flows(spark, sf)
    last = nodes.filter("not (n = 7 and k % 2 = 0)").groupBy(P, "flow").agg(F.concat(F.lit("s"), F.max("n")).alias("node_id"))
    got = flows.ancestors(edges, last)
    return got.select(c("flow").cast("bigint").alias("k"), F.substring("root", 2, 1).cast("int").alias("root"), F.substring("node_id", 2, 1).cast("int").alias("n"))


def with_definitions(nodes):
    """Line one extracts a token, line seven (where it is a block) sets a user."""
    return nodes.select(
        P, "flow", "node_id", "doc_index", "type", "n", "k",
        F.expr(f"CAST(CASE WHEN n = 1 THEN array(named_struct('name', 'token', 'from', 'body', 'header', NULL, 'path', 't')) ELSE array() END AS {_EXTRACT})").alias("extract"),
        F.expr(f"CAST(CASE WHEN type = 'variables' THEN array(named_struct('name', ' user ', 'value', 'u')) ELSE array() END AS {_VARS})").alias("variables"),
    )


@query(
    "upstream_variables",
    f"""WITH {LINES}, r AS (SELECT k, max(n) AS root, min(n) AS first FROM w WHERE NOT alone GROUP BY k)
 SELECT k, root, 'token' AS name FROM r WHERE first = 1 AND root > 1 UNION ALL SELECT r.k, root, 'user' FROM r JOIN w ON w.k = r.k AND alone""",
)
def upstream_variables(spark, sf):
    nodes, edges = order_flows(spark, sf)
    last = nodes.filter("not (n = 7 and k % 2 = 0)").groupBy(P, "flow").agg(F.concat(F.lit("s"), F.max("n")).alias("node_id"))
    got = flows.upstream_variables(with_definitions(nodes), edges, last)
    return got.select(c("flow").cast("bigint").alias("k"), F.substring("root", 2, 1).cast("int").alias("root"), "name")


@query("flow_components", f"WITH {LINES} SELECT k, n, CASE WHEN alone THEN 7 ELSE min(n) FILTER (WHERE NOT alone) OVER (PARTITION BY k) END AS component FROM w")
def flow_components(spark, sf):
    nodes, edges = order_flows(spark, sf)
    got = flows.flow_components(nodes, edges)
    return got.select(c("flow").cast("bigint").alias("k"), F.substring("node", 2, 1).cast("int").alias("n"), F.substring("component", 2, 1).cast("int").alias("component"))


@query(
    "run_scope",
    f"""WITH {LINES}, f AS (SELECT k, min(n) AS sel FROM w WHERE NOT alone GROUP BY k), a AS (SELECT k FROM w GROUP BY k)
 SELECT w.k, n FROM w JOIN a USING (k) LEFT JOIN f USING (k) WHERE k % 3 = 0 OR f.sel IS NULL OR alone OR (k % 3 = 1) OR n = f.sel""",
)
def run_scope(spark, sf):
    """A third of the flows run whole, a third the part around a step, a third one step."""
    nodes, edges = order_flows(spark, sf)
    asked = nodes.groupBy(P, "flow", "k").agg(F.concat(F.lit("s"), F.min(F.when(~((c("n") == 7) & (c("k") % 2 == 0)), c("n")))).alias("selected")).select(
        P, "flow", F.expr("CASE k % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'connected' ELSE 'step' END").alias("scope"), "selected"
    )
    got = flows.run_scope(nodes, edges, asked)
    return got.select(c("flow").cast("bigint").alias("k"), F.substring("node_id", 2, 1).cast("int").alias("n"))


@query(
    "lint_flows",
    f"""WITH {LINES}, has1 AS (SELECT DISTINCT k FROM l WHERE n = 1)
 SELECT w.k, w.n, 'undefined' AS rule, 'ghost' AS subject FROM w WHERE n = 2
 UNION ALL SELECT w.k, w.n, 'undefined', 'token' FROM w WHERE n = 3 AND k NOT IN (SELECT k FROM has1)
 UNION ALL SELECT w.k, w.n, 'no_assertions', NULL FROM w WHERE NOT alone AND n <> 5 AND n % 2 = 1
 UNION ALL SELECT w.k, w.n, 'stale_spec_ref', 'GET /gone' FROM w WHERE n = 4 AND k % 13 <> 5""",
)
def lint_flows(spark, sf):
    nodes, edges = order_flows(spark, sf)
    checked = "array(named_struct('from', 'status', 'header', NULL, 'path', NULL, 'op', 'equals', 'expected', '200'))"
    full = with_definitions(nodes).select(
        P, "flow", "node_id", "doc_index", "type", "extract", "variables",
        F.expr("CASE n WHEN 2 THEN array('{{base}}/{{ghost}}') WHEN 3 THEN array('{{token}}') ELSE CAST(array() AS array<string>) END").alias("texts"),
        F.expr(f"CAST(CASE WHEN n % 2 = 0 THEN {checked} ELSE array() END AS {_ASSERT})").alias("assert"),
        F.expr("CASE WHEN n = 4 THEN 'GET /gone' WHEN n = 2 THEN 'GET /here' END").alias("spec_ref"),
        F.lit("{{base}}").alias("left"), F.lit("").alias("right"), F.lit(None).cast("string").alias("text"),
    )
    projects = nodes.select(P).distinct()
    names = projects.select(P, F.lit("base").alias("name"))
    endpoints = projects.filter("project_id <> 'c5'").select(P, F.lit("GET /here").alias("id"))
    got = flows.lint_flows(full, edges, names, endpoints)
    return got.select(c("flow").cast("bigint").alias("k"), F.substring("node_id", 2, 1).cast("int").alias("n"), "rule", "subject")


@query("stale_spec_ref", f"WITH {LINES} SELECT k, n FROM l WHERE n = 4 AND k % 13 <> 5")
def stale_spec_ref(spark, sf):
    nodes, _ = order_flows(spark, sf)
    steps = nodes.withColumn("spec_ref", F.expr("CASE WHEN n = 4 THEN 'GET /gone' ELSE 'GET /here' END"))
    endpoints = nodes.select(P).distinct().filter("project_id <> 'c5'").select(P, F.lit("GET /here").alias("id"))
    return flows.stale_references(steps, endpoints).select(c("flow").cast("bigint").alias("k"), F.substring("node_id", 2, 1).cast("int").alias("n"))


def talk_runs(spark, sf):
    """Conversations as runs of one shape of flow: a turn is a step, its text the answer.

    Odd turns hang on the turn before; a step asserts that its answer is shorter than the
    limit of its environment, and every first turn extracts the role of its speaker.
    """
    talk = table(spark, sf, "conversations").selectExpr("concat('t', conv_id % 5) AS project_id", "CAST(conv_id AS STRING) AS run_id", "concat('f', conv_id) AS flow", "CAST(turn AS INT) AS turn", "role", "length(text) AS chars")
    node = F.concat(F.lit("n"), "turn")
    assertion = "named_struct('from', 'body', 'header', CAST(NULL AS STRING), 'path', 'chars', 'op', 'less_than', 'expected', '{{limit}}')"
    nodes = talk.select(
        P, "flow", node.alias("node_id"), c("turn").alias("doc_index"), F.expr("CASE WHEN turn = 2 THEN 'display' ELSE 'request' END").alias("type"),
        F.expr("CASE WHEN turn = 3 THEN array('{{who}}/{{nobody}}') ELSE array('http://h/{{limit}}') END").alias("texts"),
        F.expr(f"CAST(CASE WHEN turn = 0 THEN array(named_struct('name', 'who', 'from', 'body', 'header', NULL, 'path', 'role')) ELSE array() END AS {_EXTRACT})").alias("extract"),
        F.expr(f"CAST(array({assertion}) AS {_ASSERT})").alias("assert"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("op"),
        F.lit(None).cast("string").alias("right"), F.lit(None).cast(_VARS).alias("variables"), F.lit("{{who}} of {{limit}}").alias("text"),
    )
    edges = talk.filter("turn % 2 = 1").select(
        P, "flow", F.concat(F.lit("n"), c("turn") - 1).alias("from_node"), node.alias("to_node"), F.lit(None).cast("string").alias("handle"), c("turn").alias("edge_index")
    )
    recorded = talk.select(
        P, "run_id", node.alias("node_id"), F.lit(None).cast("string").alias("transport_error"),
        F.expr(
            "named_struct('status', 200, 'total_ms', CAST(5 AS BIGINT), 'response_headers', CAST(array() AS array<struct<name:string,value:string>>), "
            "'body', concat('{\"role\":\"', role, '\",\"chars\":', chars, '}'))"
        ).alias("x"),
    )
    run_list = talk.select(P, "run_id", "flow", F.lit("dev").alias("environment")).distinct()
    settings = talk.select(P).distinct().withColumn("environment", F.lit("dev")).selectExpr(P, "environment", "'environment' AS scope", "'limit' AS name", "'150' AS value").unionByName(
        talk.select(P).distinct().selectExpr(P, "CAST(NULL AS STRING) AS environment", "'globals' AS scope", "'limit' AS name", "'1' AS value")
    )
    return run_list, nodes, edges, recorded, spread_environments(settings)


def evaluated(spark, sf):
    run_list, nodes, edges, recorded, settings = talk_runs(spark, sf)
    steps = runs.prepare_steps(run_list, flows.execution_order(nodes, edges), nodes, edges, recorded)
    return runs.evaluate_runs(steps, variables.scope_maps(settings))


# A turn by itself; whether the first turn's value is in scope; what hangs on what.
TALK = """t AS (SELECT conv_id, turn, role, length(text) < 150 AS short, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS who, first_value(length(text) < 150) OVER (PARTITION BY conv_id ORDER BY turn) AS ok0 FROM conversations),
 own AS (SELECT *, CASE WHEN turn = 2 THEN CASE WHEN ok0 THEN 'passed' ELSE 'undefined_variables' END WHEN turn = 3 THEN 'undefined_variables' WHEN short THEN 'passed' ELSE 'assertions' END AS verdict FROM t),
 res AS (SELECT a.conv_id, a.turn, CASE WHEN a.turn % 2 = 1 AND b.verdict <> 'passed' THEN 'skipped' WHEN a.verdict = 'passed' THEN 'passed' ELSE 'failed' END AS status,
   CASE WHEN a.turn % 2 = 1 AND b.verdict <> 'passed' THEN NULL WHEN a.verdict <> 'passed' THEN a.verdict END AS failure_kind, CASE WHEN a.turn % 2 = 1 AND b.verdict <> 'passed' THEN 'n' || b.turn END AS culprit,
   CASE WHEN a.turn = 2 AND a.ok0 THEN a.who || ' of 150' END AS output FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1)"""


@query("evaluate_runs", f"WITH {TALK} SELECT * FROM res")
def evaluate_runs(spark, sf):
    got = evaluated(spark, sf)
    return got.select(
        c("run_id").cast("bigint").alias("conv_id"), F.substring("node_id", 2, 3).cast("bigint").alias("turn"), "status", "failure_kind", "culprit", "output"
    )


@query("run_gate", f"WITH {TALK} SELECT conv_id, turn, culprit FROM res WHERE status = 'skipped'")
def run_gate(spark, sf):
    got = evaluated(spark, sf).filter("status = 'skipped' and reason_kind = 'upstream_failed'")
    return got.select(c("run_id").cast("bigint").alias("conv_id"), F.substring("node_id", 2, 3).cast("bigint").alias("turn"), "culprit")


@query("run_summary", f"WITH {TALK} SELECT conv_id, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') = 0 AS run_passed FROM res GROUP BY 1")
def run_summary(spark, sf):
    return runs.run_summary(evaluated(spark, sf)).select(c("run_id").cast("bigint").alias("conv_id"), "passed", "failed", "skipped", "run_passed")


@query("edge_state", f"WITH {TALK} SELECT a.conv_id, a.turn AS to_turn, CASE WHEN b.status = 'passed' THEN 'taken' ELSE 'dead' END AS state FROM res a JOIN res b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.turn % 2 = 1")
def edge_state(spark, sf):
    run_list, _, edges, _, _ = talk_runs(spark, sf)
    results = cut_lineage(evaluated(spark, sf))
    run_edges = edges.join(run_list.select(P, "run_id", "flow"), [P, "flow"])
    got = flows.edge_state(run_edges, results, [P, "run_id"])
    return got.select(c("run_id").cast("bigint").alias("conv_id"), F.substring("to_node", 2, 3).cast("bigint").alias("to_turn"), "state")


@query("partial_run", f"WITH {TALK} SELECT conv_id, turn, CASE WHEN turn = 2 THEN 'passed' WHEN turn = 3 THEN 'failed' END AS status, CASE WHEN turn = 2 THEN 'seed of 150' END AS output FROM t WHERE turn IN (2, 3)")
def partial_run(spark, sf):
    """Only turns two and three run, with the first turn's value given beforehand."""
    run_list, nodes, edges, recorded, settings = talk_runs(spark, sf)
    only = run_list.select(P, "run_id", F.explode(F.array(F.lit("n2"), F.lit("n3"))).alias("node_id"))
    seeds = run_list.select(P, "run_id", F.lit("who").alias("name"), F.lit("seed").alias("value"))
    steps = runs.prepare_steps(run_list, flows.execution_order(nodes, edges), nodes, edges, recorded, only)
    got = runs.evaluate_runs(steps, variables.scope_maps(settings), seeds)
    return got.select(c("run_id").cast("bigint").alias("conv_id"), F.substring("node_id", 2, 3).cast("bigint").alias("turn"), "status", "output")


@query(
    "values_in_scope",
    """WITH e AS (SELECT user_id, event_id AS pos, CASE WHEN event_type <> 'error' THEN props END AS v FROM events)
 SELECT user_id, pos, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS value FROM e""",
)
def values_in_scope(spark, sf):
    """Each user's events as one long run; a good event sets the value, every event reads it."""
    rows = table(spark, sf, "events").selectExpr("user_id", "'props' AS name", "event_id AS pos", "event_type", "props AS value")
    got = runs.values_in_scope(rows.filter("event_type <> 'error'"), rows, ["user_id"], chunk=1000)
    return got.select("user_id", "pos", "value")

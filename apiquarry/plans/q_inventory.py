"""Queries on the registration graph, linking, inventories and their merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from apiquarry.functions import paths
from apiquarry.operators import closure, graph, groups, inventory, linking, merge, models, providers, views, warnings
from apiquarry.plans.base import query, table
from apiquarry.schemas import AUTH, BODY, PARAM
from apiquarry.session import cut_lineage

c = F.col
P = "project_id"
REGION_ROOTS = "r_regionkey < 4"

_NONE_AUTH = f"CAST(NULL AS {AUTH})"


def estate(spark, sf):
    """Regions as applications, nations as routers mounted on them, suppliers as routers mounted
    on nations; customers are routes of their nation. The last region is no application."""
    nation = table(spark, sf, "nation").withColumn(P, F.expr("concat('e', n_regionkey % 2)"))
    region = table(spark, sf, "region").withColumn(P, F.expr("concat('e', r_regionkey % 2)"))
    supplier = table(spark, sf, "supplier").join(nation, c("s_nationkey") == c("n_nationkey"))
    customer = table(spark, sf, "customer").join(nation, c("c_nationkey") == c("n_nationkey"))

    def prefix(df, expr):
        return df.withColumn("prefix", paths.parse_path(F.expr(expr), "braces"))

    def router(df, seq, module, name, pre, group, root, implicit="false"):
        return prefix(df, pre).select(
            P, F.expr(seq).cast("bigint").alias("seq"), F.expr(module).alias("module"), F.expr(name).alias("name"), "prefix",
            F.expr(group).cast("string").alias("group"), F.expr(root).alias("is_app_root"), F.expr(implicit).alias("implicit"),
            F.lit(1).alias("line"), F.lit(0).alias("column"),
        )

    routers = (
        router(region, "r_regionkey", "concat('app', r_regionkey, '.py')", "'app'", "'/api'", "NULL", REGION_ROOTS)
        .unionByName(router(nation, "n_nationkey", "concat('nation', n_nationkey, '.py')", "'router'", "concat('/n', n_nationkey)", "n_name", "false"))
        .unionByName(router(supplier, "s_suppkey", "concat('supplier', s_suppkey, '.py')", "'router'", "''", "NULL", "false"))
    )

    def mount(df, seq, parent, child, pre, group, auth, methods, replaces="false"):
        return prefix(df, pre).select(
            P, F.expr(seq).cast("bigint").alias("seq"), F.expr(parent[0]).alias("parent_module"), F.expr(parent[1]).alias("parent_name"),
            F.expr(child[0]).alias("child_module"), F.expr(child[1]).alias("child_name"), "prefix", F.expr(group).cast("string").alias("group"),
            F.expr(auth).cast(AUTH).alias("auth"), F.expr(methods).cast("array<string>").alias("methods"), F.expr(replaces).alias("replaces_child_prefix"),
            F.lit(1).alias("line"), F.lit(0).alias("column"),
        )

    bearer = "named_struct('type', 'bearer', 'format', CAST(NULL AS STRING), 'name', CAST(NULL AS STRING), 'location', CAST(NULL AS STRING), 'scopes', CAST(array() AS array<string>), 'hint', CAST(NULL AS STRING))"
    app = ("concat('app', n_regionkey, '.py')", "'app'")
    own = ("concat('nation', n_nationkey, '.py')", "'router'")
    mounts = mount(nation, "n_nationkey", app, own, "concat('/v', n_regionkey)", "NULL", f"CASE WHEN n_nationkey % 3 = 0 THEN {bearer} END", "array()").unionByName(
        mount(
            supplier, "1000 + s_suppkey", own, ("concat('supplier', s_suppkey, '.py')", "'router'"), "concat('/s', s_suppkey)", "concat('g', s_suppkey % 3)",
            "NULL", "CASE WHEN s_suppkey % 4 = 0 THEN array('GET') ELSE array() END",
        )
    )
    # A nation of the first regions is mounted a second time, under another prefix and without its own.
    again = nation.filter("n_regionkey = 0")
    mounts = mounts.unionByName(mount(again, "100000 + n_nationkey", app, own, "'/legacy'", "'old'", "NULL", "array()", "true"))

    def route(df, seq, module, path, methods, group, line):
        return df.select(
            P, F.expr(seq).cast("bigint").alias("seq"), F.expr(module).alias("router_module"), F.lit("router").alias("router_name"),
            F.expr(methods).alias("methods"), paths.parse_path(F.expr(path), "braces").alias("path"), F.expr("CAST(array() AS array<" + PARAM + ">)").alias("query_params"),
            F.expr("CAST(array() AS array<" + PARAM + ">)").alias("headers"), F.lit(None).cast(BODY).alias("body"), F.lit(None).cast(AUTH).alias("auth"),
            F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("description"), F.expr(group).cast("string").alias("group"),
            F.lit(False).alias("deprecated"), F.lit(None).cast("string").alias("handler_module"), F.lit(None).cast("string").alias("handler_name"),
            F.expr(line).cast("int").alias("line"), F.lit(0).alias("column"),
        )

    routes = route(
        customer, "c_custkey", own[0], "concat('/customers/', c_custkey, '/{id}')", "CASE WHEN c_custkey % 2 = 0 THEN array('GET', 'PUT') ELSE array('GET') END",
        "CASE WHEN c_custkey % 5 = 0 THEN 'vip' END", "c_custkey",
    ).unionByName(route(supplier, "1000000 + s_suppkey", "concat('supplier', s_suppkey, '.py')", "'/stock/'", "array('GET', 'POST')", "NULL", "s_suppkey"))
    # Routes on a name nobody declares.
    lost = table(spark, sf, "customer").filter("c_custkey % 50 = 7").withColumn(P, F.lit("e0"))
    routes = routes.unionByName(route(lost, "2000000 + c_custkey", "concat('lost', c_custkey % 3, '.py')", "concat('/lost/', c_custkey)", "array('GET')", "NULL", "c_custkey"))
    return routers, routes, mounts


def composed(spark, sf):
    routers, routes, mounts = estate(spark, sf)
    resolved, warnings = graph.resolve_routes(routers, routes, mounts)
    return inventory.to_endpoints(resolved, F.lit("fastapi")), warnings, routers, routes, mounts


def view_of(spark, sf):
    return inventory.endpoint_view(composed(spark, sf)[0])


# The same estate in SQL: ways to each nation router, then routes on nations, suppliers, lost names.
ESTATE = """ways AS (SELECT 'e' || (n_regionkey % 2) AS project_id, n_nationkey, n_regionkey, n_name, n_regionkey >= 4 AS orphaned,
  '/api/v' || n_regionkey || '/n' || n_nationkey AS base, n_nationkey % 3 = 0 AS auth, n_name AS grp FROM nation
 UNION ALL SELECT 'e' || (n_regionkey % 2), n_nationkey, n_regionkey, n_name, FALSE, '/api/legacy', FALSE, n_name FROM nation WHERE n_regionkey = 0),
inv AS (SELECT project_id, m AS method, base || '/customers/' || c_custkey || '/{id}' AS path, base || '/customers/' || c_custkey || '/{}' AS normalized, CASE WHEN c_custkey % 5 = 0 THEN 'vip' ELSE grp END AS grp, auth, orphaned,
   'nation' || n_nationkey || '.py:' || c_custkey AS source FROM ways JOIN customer ON c_nationkey = n_nationkey, LATERAL (SELECT unnest(CASE WHEN c_custkey % 2 = 0 THEN ['GET', 'PUT'] ELSE ['GET'] END) AS m)
 UNION ALL SELECT project_id, m, base || '/s' || s_suppkey || '/stock/', base || '/s' || s_suppkey || '/stock', 'g' || (s_suppkey % 3), auth, orphaned, 'supplier' || s_suppkey || '.py:' || s_suppkey
  FROM ways JOIN supplier ON s_nationkey = n_nationkey, LATERAL (SELECT unnest(CASE WHEN s_suppkey % 4 = 0 THEN ['GET'] ELSE ['GET', 'POST'] END) AS m)
 UNION ALL SELECT 'e0', 'GET', '/lost/' || c_custkey, '/lost/' || c_custkey, NULL, FALSE, TRUE, 'lost' || (c_custkey % 3) || '.py:' || c_custkey FROM customer WHERE c_custkey % 50 = 7)"""


@query("resolve_routes", f"WITH {ESTATE} SELECT project_id, method, path, grp, auth, orphaned, source FROM inv")
def resolve_routes(spark, sf):
    return view_of(spark, sf).select(
        P, "method", "path", c("group").alias("grp"), "auth", "orphaned", F.concat_ws(":", "file", c("line").cast("string")).alias("source")
    )


@query(
    "graph_warnings",
    """SELECT 'e0' AS project_id, 'orphaned_router' AS kind, 'app4.py:app' AS subject, 'no mount leads to app4.py:app' AS message FROM region WHERE r_regionkey = 4
 UNION ALL SELECT 'e0', 'undeclared_router', 'lost' || (c_custkey % 3) || '.py:router', 'routes without a known prefix: ' || count(*) || ' on undeclared lost' || (c_custkey % 3) || '.py:router'
 FROM customer WHERE c_custkey % 50 = 7 GROUP BY c_custkey % 3""",
)
def graph_warnings(spark, sf):
    return composed(spark, sf)[1]


@query(
    "orphans",
    """SELECT 'e0' AS project_id, 'app4.py:app' AS symbol, TRUE AS declared, 0 AS routes FROM region WHERE r_regionkey = 4
 UNION ALL SELECT 'e0', 'lost' || (c_custkey % 3) || '.py:router', FALSE, count(*) FROM customer WHERE c_custkey % 50 = 7 GROUP BY c_custkey % 3""",
)
def orphans(spark, sf):
    routers, routes, mounts = estate(spark, sf)
    placed, tied, _ = graph.attach(routes, mounts, routers, None)
    roots = routers.filter("is_app_root").select(P, F.struct("module", "name").alias("symbol"))
    reached = graph.reached_symbols(roots, tied)
    found = graph.orphan_roots(routers, placed, tied, reached)
    return found.select(P, graph.symbol_text(c("symbol")).alias("symbol"), "declared", "routes")


@query(
    "closure",
    """WITH RECURSIVE e AS (SELECT 'a' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
 r AS (SELECT 'a' || r_regionkey AS root, 'a' || r_regionkey AS node FROM region UNION SELECT root, dst FROM r JOIN e ON src = node)
 SELECT root, count(*) AS reached FROM r GROUP BY root""",
)
def closure_(spark, sf):
    edges = table(spark, sf, "nation").selectExpr("1 AS g", "concat('a', n_regionkey) AS src", "concat('n', n_nationkey) AS dst").unionByName(
        table(spark, sf, "supplier").selectExpr("1 AS g", "concat('n', s_nationkey) AS src", "concat('s', s_suppkey) AS dst")
    )
    start = table(spark, sf, "region").selectExpr("1 AS g", "concat('a', r_regionkey) AS root", "concat('a', r_regionkey) AS node")
    return closure.reachable(edges, start, ["g"]).groupBy("root").agg(F.count("*").alias("reached"))


@query(
    "cycle_guard",
    """SELECT 'n' || n_nationkey AS project_id, 'cycle' AS kind, 'm.py:a' AS subject, 2 AS visits FROM nation WHERE n_nationkey % 2 = 0
 UNION ALL SELECT 'n' || n_nationkey, NULL, NULL, 40 FROM nation WHERE n_nationkey % 2 = 1""",
)
def cycle_guard(spark, sf):
    """Even nations mount in a ring, which is reported; odd ones in a chain of forty, which is walked to its end."""
    base = table(spark, sf, "nation").selectExpr("concat('n', n_nationkey) AS project_id", "n_nationkey % 2 = 0 AS ring")
    names = F.when(c("ring"), F.array(F.lit("a"), F.lit("b"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("c"), i.cast("string")))
    )
    nodes = base.select(P, "ring", F.posexplode(names).alias("pos", "name"))
    routers = nodes.select(
        P, F.lit("m.py").alias("module"), "name", paths.empty_path().alias("prefix"), F.lit(None).cast("string").alias("group"), (c("pos") == 0).alias("is_app_root")
    )
    nxt = F.when(c("ring"), F.when(c("pos") == 0, "b").otherwise("a")).otherwise(F.concat(F.lit("c"), (c("pos") + 1).cast("string")))
    steps = nodes.filter("ring or pos < 39").select(
        P, F.struct(F.lit("m.py").alias("module"), c("name").alias("name")).alias("symbol"), F.struct(F.lit("m.py").alias("module"), nxt.alias("name")).alias("child"),
        paths.path_of(paths.literal("p")).alias("m_prefix"), F.lit(None).cast("string").alias("m_group"), F.lit(None).cast(AUTH).alias("m_auth"),
        F.array().cast("array<string>").alias("m_methods"), paths.empty_path().alias("c_prefix"), F.lit(None).cast("string").alias("c_group"),
    )
    roots = routers.filter("is_app_root").select(P, F.struct("module", "name").alias("symbol"))
    visits, warnings = graph.walk(roots, cut_lineage(steps), routers, orphaned=False)
    return visits.groupBy(P).agg(F.count("*").alias("visits")).join(warnings.select(P, "kind", "subject"), P, "left")


@query(
    "attach_routes",
    """SELECT 'nation' || n_nationkey || '.py:router' AS router, count(*) AS routes FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
 UNION ALL SELECT 'supplier' || s_suppkey || '.py:router', 1 FROM supplier
 UNION ALL SELECT 'lost' || (c_custkey % 3) || '.py:router', count(*) FROM customer WHERE c_custkey % 50 = 7 GROUP BY 1""",
)
def attach_routes(spark, sf):
    routers, routes, mounts = estate(spark, sf)
    placed, _, _ = graph.attach(routes, mounts, routers, None)
    return placed.groupBy(graph.symbol_text(c("router")).alias("router")).agg(F.count("*").alias("routes"))


@query(
    "undeclared_mounts",
    """SELECT 'e' || (n_regionkey % 2) AS project_id, 'ghost.py:g' || n_nationkey AS subject FROM nation WHERE n_nationkey % 4 = 1""",
)
def undeclared_mounts(spark, sf):
    routers, routes, mounts = estate(spark, sf)
    ghosts = mounts.filter("seq < 1000 and seq % 4 = 1").withColumn("child_module", F.lit("ghost.py")).withColumn("child_name", F.concat(F.lit("g"), c("seq").cast("string")))
    _, _, warnings = graph.attach(routes, mounts.unionByName(ghosts), routers, None)
    return warnings.filter("kind = 'undeclared_mount'").select(P, "subject")


@query(
    "undeclared_router_counts",
    """SELECT 'e0' AS project_id, 'lost' || (c_custkey % 3) || '.py:router' AS router, count(*) AS routes FROM customer WHERE c_custkey % 50 = 7 GROUP BY 2""",
)
def undeclared_router_counts(spark, sf):
    routers, routes, mounts = estate(spark, sf)
    placed, _, _ = graph.attach(routes, mounts, routers, None)
    return inventory.undeclared_router_counts(placed, routers).select(P, graph.symbol_text(c("router")).alias("router"), "routes")


@query(
    "unreached_symbols",
    """SELECT 'e0' AS project_id, 'app4.py:app' AS symbol FROM region WHERE r_regionkey = 4 UNION SELECT 'e0', 'nation' || n_nationkey || '.py:router' FROM nation WHERE n_regionkey = 4
 UNION SELECT 'e0', 'supplier' || s_suppkey || '.py:router' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 4
 UNION SELECT 'e0', 'lost' || (c_custkey % 3) || '.py:router' FROM customer WHERE c_custkey % 50 = 7""",
)
def unreached_symbols(spark, sf):
    """(routers ∪ route targets) − reached."""
    routers, routes, mounts = estate(spark, sf)
    placed, tied, _ = graph.attach(routes, mounts, routers, None)
    roots = routers.filter("is_app_root").select(P, F.struct("module", "name").alias("symbol"))
    reached = graph.reached_symbols(roots, tied)
    every = routers.select(P, F.struct("module", "name").alias("symbol")).unionByName(placed.select(P, c("router").alias("symbol"))).distinct()
    return every.join(reached, [P, "symbol"], "left_anti").select(P, graph.symbol_text(c("symbol")).alias("symbol"))


@query(
    "first_router_declaration",
    """SELECT o_custkey, min(o_orderkey) AS first_seq, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1""",
)
def first_router_declaration(spark, sf):
    """Orders of a customer as repeated declarations of one router."""
    rows = table(spark, sf, "orders").selectExpr("'p' AS project_id", "CAST(o_custkey AS STRING) AS module", "'app' AS name", "o_orderkey AS seq", "o_orderstatus AS factory")
    return linking.first_declarations(rows).select(c("module").cast("bigint").alias("o_custkey"), c("seq").alias("first_seq"), c("factory").alias("status"))


@query(
    "first_mount",
    """SELECT c_mktsegment AS child, c_nationkey AS parent, min(c_custkey) AS seq FROM customer GROUP BY 1, 2""",
)
def first_mount(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.lit("p").alias(P), c("c_custkey").alias("seq"), c("c_nationkey").cast("string").alias("parent_module"), F.lit("r").alias("parent_name"),
        c("c_mktsegment").alias("child_module"), F.lit("r").alias("child_name"), paths.path_of(paths.literal("x")).alias("prefix"),
        F.array(F.lit("GET")).alias("methods"), F.lit(False).alias("replaces_child_prefix"),
    )
    return graph.dedupe_mounts(rows).select(c("child_module").alias("child"), c("parent_module").cast("int").alias("parent"), "seq")


@query(
    "last_binding",
    """SELECT o_custkey, o_orderpriority AS exported, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS local FROM orders GROUP BY 1, 2""",
)
def last_binding(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_custkey", "o_orderpriority AS exported", "o_orderkey AS seq", "o_orderstatus AS local")
    return groups.last_per_key(rows, ["o_custkey", "exported"], ["seq"])


@query(
    "collapse_repeated",
    """SELECT l_orderkey, l_linenumber, arg_max(l_partkey, (l_shipdate, l_partkey, l_suppkey)) AS l_partkey FROM lineitem GROUP BY 1, 2""",
)
def collapse_repeated(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return groups.last_per_key(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


def python_imports(spark, sf):
    """Parts as importing files; each imports its neighbour one way or another."""
    base = table(spark, sf, "part").selectExpr("p_partkey AS k", "concat('b', p_size) AS project_id", "concat('pkg/m', p_partkey, '/views.py') AS module")
    files = base.selectExpr(P, "module AS path").unionByName(base.selectExpr(P, "concat('pkg/m', k, '/__init__.py') AS path")).unionByName(
        base.filter("k % 5 = 3").selectExpr(P, "concat('shared', k, '.py') AS path")
    )
    imports = base.select(
        P, c("k").alias("seq"), "module", F.lit("r").alias("local_name"),
        F.expr("CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'views' WHEN 2 THEN concat('pkg.m', k) WHEN 3 THEN concat('shared', k) ELSE 'fastapi' END").alias("source"),
        F.expr("CASE k % 5 WHEN 0 THEN 'views' WHEN 1 THEN 'router' WHEN 2 THEN NULL ELSE 'app' END").alias("original"),
        F.expr("CASE WHEN k % 5 IN (0, 1) THEN 1 ELSE 0 END").alias("level"),
    )
    return imports, files, base


@query(
    "resolve_python_imports",
    """SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'module' WHEN 2 THEN 'module' ELSE 'symbol' END AS kind,
 CASE p_partkey % 5 WHEN 2 THEN 'pkg/m' || p_partkey || '/__init__.py' WHEN 3 THEN 'shared' || p_partkey || '.py' ELSE 'pkg/m' || p_partkey || '/views.py' END AS target,
 CASE p_partkey % 5 WHEN 1 THEN 'router' WHEN 3 THEN 'app' END AS name FROM part WHERE p_partkey % 5 <> 4""",
)
def resolve_python_imports(spark, sf):
    imports, files, base = python_imports(spark, sf)
    got = linking.resolve_imports(imports, files)
    return got.join(base, [P, "module"]).select("k", "kind", c("target_module").alias("target"), c("target_name").alias("name"))


def js_project(spark, sf):
    base = table(spark, sf, "part").selectExpr("p_partkey AS k", "concat('b', p_size) AS project_id", "concat('web/a', p_partkey, '/app.ts') AS module")
    target = "CASE k % 4 WHEN 0 THEN concat('web/lib/x', k, '.ts') WHEN 1 THEN concat('src/u', k, '/index.js') WHEN 2 THEN concat('y', k, '.route.ts') END"
    files = base.selectExpr(P, "module AS path").unionByName(base.filter("k % 4 < 3").selectExpr(P, f"{target} AS path"))
    source = "CASE k % 4 WHEN 0 THEN concat('../lib/./x', k, '.js') WHEN 1 THEN concat('@/u', k) WHEN 2 THEN concat('~/y', k, '.route') ELSE 'express' END"
    imports = base.select(
        P, c("k").alias("seq"), "module", F.lit("r").alias("local_name"), F.expr(source).alias("source"), F.lit("default").alias("original"), F.lit(0).alias("level")
    )
    return base, imports, files, target


@query(
    "resolve_js_imports",
    """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'web/lib/x' || p_partkey || '.ts' WHEN 1 THEN 'src/u' || p_partkey || '/index.js' ELSE 'y' || p_partkey || '.route.ts' END AS target FROM part WHERE p_partkey % 4 < 3""",
)
def resolve_js_imports(spark, sf):
    base, imports, files, _ = js_project(spark, sf)
    return linking.resolve_imports(imports, files).join(base, [P, "module"]).select("k", c("target_module").alias("target"))


@query(
    "canonical_symbols",
    """SELECT p_partkey AS k, 'x' || (p_partkey + 20 - p_partkey % 20) || '.js' AS to_module, 'router' AS to_name FROM part
 WHERE p_partkey % 20 <> 0 AND p_partkey + 20 - p_partkey % 20 <= (SELECT max(p_partkey) FROM part)
 UNION ALL SELECT p_partkey, 'x' || (1 + (SELECT max(p_partkey) FROM part)) || '.js', 'router' FROM part
 WHERE p_partkey % 20 <> 0 AND p_partkey + 20 - p_partkey % 20 > (SELECT max(p_partkey) FROM part)
 UNION ALL SELECT p_partkey, 'y' || p_partkey || '.js', 'local' FROM part""",
)
def canonical_symbols(spark, sf):
    """Chains of re-exports: x1 → x2 → … up to the next multiple of twenty, which declares it, or to the
    end; and exports y1, y2, … under another name than the local one."""
    part = table(spark, sf, "part").select(F.lit("p").alias(P), c("p_partkey").alias("k"))
    declared = part.filter("k % 20 = 0").selectExpr(P, "concat('x', k, '.js') AS module", "'router' AS name")
    bindings = part.filter("k % 20 <> 0").selectExpr(
        P, "concat('x', k, '.js') AS module", "'router' AS local_name", "'symbol' AS kind", "concat('x', k + 1, '.js') AS target_module", "'router' AS target_name"
    )
    exports = part.selectExpr(P, "concat('y', k, '.js') AS module", "'public' AS exported", "'local' AS local")
    ends = linking.canonical_symbols(declared, bindings, exports)
    return ends.select(F.regexp_extract("module", r"(\d+)", 1).cast("bigint").alias("k"), "to_module", "to_name")


@query(
    "resolve_symbols",
    """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'web/lib/x' || p_partkey || '.ts' WHEN 1 THEN 'src/u' || p_partkey || '/index.js' WHEN 2 THEN NULL ELSE 'web/a' || p_partkey || '/app.ts' END AS sym_module,
 CASE p_partkey % 4 WHEN 0 THEN 'router' WHEN 1 THEN 'users' WHEN 2 THEN NULL ELSE 'app' END AS sym_name FROM part""",
)
def resolve_symbols(spark, sf):
    base, imports, files, target = js_project(spark, sf)
    bindings = cut_lineage(linking.resolve_imports(imports, files))
    where = base.filter("k % 4 < 3").selectExpr(P, "k", f"{target} AS module")
    declared = where.filter("k % 4 = 0").select(P, "module", F.lit("router").alias("name"))
    exports = where.filter("k % 4 = 0").select(P, "module", F.lit("default").alias("exported"), F.lit("router").alias("local")).unionByName(
        where.filter("k % 4 = 1").select(P, "module", F.lit("users").alias("exported"), F.lit("users").alias("local"))
    )
    name = F.expr("CASE k % 4 WHEN 0 THEN 'r' WHEN 1 THEN 'r.users' WHEN 2 THEN 'r.missing' ELSE 'app' END")
    refs = base.select(P, "k", "module", name.alias("name"))
    got = linking.resolve_symbols(refs, declared, bindings, exports)
    return refs.join(got, [P, "module", "name"]).select("k", "sym_module", "sym_name")


@query(
    "resolve_go_symbols",
    """SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN 'svc' || s_suppkey || '/routes.go' WHEN 1 THEN 'lib' || s_suppkey || '/api.go' WHEN 2 THEN 'lib' || s_suppkey || '/api.go'
  WHEN 5 THEN 'lib' || s_suppkey || '/api.go' ELSE 'svc' || s_suppkey || '/main.go' END AS sym_module,
 CASE s_suppkey % 6 WHEN 0 THEN 'r' WHEN 1 THEN 'Register' WHEN 2 THEN 'Handler.Routes' WHEN 3 THEN 'gone.Thing' WHEN 4 THEN 'lib.Self.Routes' ELSE 'Handler.Routes' END AS sym_name FROM supplier""",
)
def resolve_go_symbols(spark, sf):
    """Routers of the own and of imported packages; one alias begins with itself, others form a chain of twenty."""
    base = table(spark, sf, "supplier").selectExpr("concat('n', s_nationkey) AS project_id", "s_suppkey AS k", "concat('svc', s_suppkey, '/main.go') AS module")
    declared = base.selectExpr(
        P, "CASE WHEN k % 6 = 0 THEN concat('svc', k, '/routes.go') ELSE concat('lib', k, '/api.go') END AS module",
        "CASE k % 6 WHEN 0 THEN 'r' WHEN 1 THEN 'Register' WHEN 3 THEN 'Other' ELSE 'Handler.Routes' END AS name",
    )
    bindings = base.selectExpr(P, "module", "'lib' AS local_name", "'module' AS kind", "concat('lib', k) AS target_module", "CAST(NULL AS STRING) AS target_name")
    aliases = base.selectExpr(
        P, "k", "explode(concat(array(struct('NewHandler' AS exported, 'Handler' AS local), struct('Self' AS exported, 'Self.Inner' AS local)), "
        "transform(sequence(0, 19), i -> struct(concat('Hop', i) AS exported, IF(i = 19, 'Handler', concat('Hop', i + 1)) AS local)))) AS a",
    )
    exports = aliases.selectExpr(P, "k AS seq", "concat('lib', k, '/new.go') AS module", "a.exported", "a.local")
    refs = base.selectExpr(
        P, "k", "module",
        "CASE k % 6 WHEN 0 THEN 'r' WHEN 1 THEN 'lib.Register' WHEN 2 THEN 'lib.NewHandler.Routes' WHEN 3 THEN 'gone.Thing' WHEN 4 THEN 'lib.Self.Routes' ELSE 'lib.Hop0.Routes' END AS name",
    )
    got = linking.resolve_go_symbols(refs, declared, bindings, exports)
    return refs.join(got.hint("merge"), [P, "module", "name"]).select("k", "sym_module", "sym_name")


_P = "named_struct('name', {0}, 'ty', CAST(NULL AS STRING), 'required', false, 'default_json', CAST(NULL AS STRING), 'description', CAST(NULL AS STRING), 'enum_json', CAST(array() AS array<string>))"


@query(
    "handler_fill",
    f"""WITH {ESTATE}, h AS (SELECT *, CAST(split_part(source, ':', 2) AS BIGINT) AS ck FROM inv WHERE path LIKE '%/customers/%')
 SELECT method, path, CASE WHEN ck % 3 = 0 THEN 'q' || ck ELSE '' END AS query, auth OR ck % 3 = 1 AS auth FROM h
 UNION ALL SELECT method, path, '' AS query, auth FROM inv WHERE path NOT LIKE '%/customers/%'""",
)
def handler_fill(spark, sf):
    """Customers' routes name a handler: some in their own package, some by a unique name."""
    endpoints = composed(spark, sf)[0]
    is_customer = F.contains(paths.render_path(c("path")), F.lit("/customers/"))
    key = c("source.line")
    endpoints = endpoints.withColumn("handler_module", F.when(is_customer, F.lit("svc/main.go"))).withColumn(
        "handler_name", F.when(is_customer, F.concat(F.lit("h.Show"), key.cast("string")))
    )
    # Both projects hold every handler.
    cust = table(spark, sf, "customer").withColumn(P, F.explode(F.array(F.lit("e0"), F.lit("e1"))))
    handlers = cust.filter("c_custkey % 3 < 2").select(
        P, c("c_custkey").alias("seq"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'svc/h.go' ELSE 'lib/other.go' END").alias("module"),
        F.expr("concat(CASE WHEN c_custkey % 3 = 0 THEN 'h.Show' ELSE 'Show' END, c_custkey)").alias("name"),
        F.expr(f"CASE WHEN c_custkey % 3 = 0 THEN array({_P.format('concat(chr(113), c_custkey)')}, {_P.format(chr(39) + 'id' + chr(39))}) ELSE CAST(array() AS array<{PARAM}>) END").alias("query_params"),
        F.expr(f"CAST(array() AS array<{PARAM}>)").alias("headers"), F.lit(None).cast(BODY).alias("body"),
        F.expr(f"CAST(CASE WHEN c_custkey % 3 = 1 THEN named_struct('type', 'bearer', 'format', NULL, 'name', NULL, 'location', NULL, 'scopes', array(), 'hint', NULL) END AS {AUTH})").alias("auth"),
        F.array().cast("array<string>").alias("methods"),
    )
    filled = inventory.fill_from_handlers(endpoints, handlers)
    return inventory.endpoint_view(filled).select("method", "path", F.array_join("query", ",").alias("query"), "auth")


@query(
    "class_views",
    """SELECT p_partkey AS k, m AS method, CASE WHEN d THEN '/{sku}/' ELSE '/' END AS path FROM part, LATERAL (SELECT unnest(CASE p_partkey % 4
  WHEN 0 THEN [{'m': 'GET', 'd': FALSE}, {'m': 'POST', 'd': FALSE}, {'m': 'GET', 'd': TRUE}, {'m': 'PUT', 'd': TRUE}, {'m': 'PATCH', 'd': TRUE}, {'m': 'DELETE', 'd': TRUE}]
  WHEN 1 THEN [{'m': 'GET', 'd': FALSE}, {'m': 'DELETE', 'd': TRUE}] WHEN 2 THEN [{'m': 'GET', 'd': FALSE}, {'m': 'POST', 'd': FALSE}] ELSE [{'m': 'PATCH', 'd': FALSE}] END, recursive := true))""",
)
def class_views(spark, sf):
    df = table(spark, sf, "part").selectExpr(
        "concat('b', p_size) AS project_id", "p_partkey AS k", "'views.py' AS module", "concat('V', p_partkey) AS name",
        "CASE p_partkey % 4 WHEN 0 THEN array('ModelViewSet') WHEN 1 THEN array('ListModelMixin', 'GenericViewSet') WHEN 2 THEN array('ListCreateAPIView') ELSE array('APIView') END AS bases",
        "CASE p_partkey % 4 WHEN 1 THEN array('destroy', 'helper') WHEN 3 THEN array('patch', 'helper') ELSE CAST(array() AS array<string>) END AS own_methods",
        "'sku' AS lookup",
    )
    got = views.expand_class_views(df)
    path = F.when(F.size("path.segments") == 0, "/").otherwise(paths.render_path(c("path")))
    return got.join(df.select(P, "name", "k"), [P, "name"]).select("k", "method", path.alias("path"))


@query(
    "expand_models",
    """SELECT s_suppkey AS k, name, schema_json, example_json FROM supplier, LATERAL (SELECT unnest([
 {'name': 'Base' || s_suppkey, 'schema_json': '{"properties":{"id":{"type":"integer"}},"required":["id"],"title":"Base' || s_suppkey || '","type":"object"}', 'example_json': '{"id":0}'},
 {'name': 'User' || s_suppkey, 'schema_json': '{"properties":{"bio":{"default":"hi","type":"string"},"friends":{"items":{"properties":{"id":{"type":"integer"}},"required":["id"],"title":"Base' || s_suppkey || '","type":"object"},"type":"array"},"id":{"type":"integer"},"kind":{"enum":["a",1]},"mail":{"format":"email","type":"string"},"meta":{"additionalProperties":{"type":"number"},"type":"object"},"odd":{"title":"Thing","type":"string"}},"required":["id","mail","friends"],"title":"User' || s_suppkey || '","type":"object"}',
  'example_json': '{"bio":"hi","friends":[{"id":0}],"id":0,"kind":"a","mail":"user@example.com","meta":{},"odd":"string"}'}], recursive := true))""",
)
def expand_models(spark, sf):
    field = "named_struct('name', '{0}', 'annotation', {1}, 'default_json', {2}, 'required', {3})"
    null = "CAST(NULL AS STRING)"
    base = table(spark, sf, "supplier").selectExpr("concat('n', s_nationkey) AS project_id", "s_suppkey AS seq")
    first = base.selectExpr(
        P, "seq", "concat('Base', seq) AS name", "'m.py' AS module", "CAST(array() AS array<string>) AS bases", "array(" + field.format("id", "'int'", null, "true") + ") AS fields"
    )
    second = base.selectExpr(
        P, "seq", "concat('User', seq) AS name", "'m.py' AS module", "array(concat('Base', seq), 'BaseModel') AS bases",
        "array("
        + ", ".join(
            [
                field.format("mail", "'pydantic.EmailStr'", null, "true"), field.format("friends", "concat('Optional[list[Base', seq, ']]')", null, "true"),
                field.format("bio", "'str | None'", "'\"hi\"'", "false"), field.format("meta", "'dict[str, float]'", null, "false"),
                field.format("kind", "'Literal[\"a\", 1]'", null, "false"), field.format("odd", "'lib.Thing'", null, "false"),
            ]
        )
        + ") AS fields",
    )
    got = models.expand_models(first.unionByName(second))
    return got.select(F.regexp_extract("name", r"(\d+)$", 1).cast("bigint").alias("k"), "name", "schema_json", "example_json")


@query("endpoint_view", f"WITH {ESTATE} SELECT method || ' ' || path AS display, grp, auth, FALSE AS has_body, FALSE AS unresolved, orphaned FROM inv")
def endpoint_view(spark, sf):
    return view_of(spark, sf).select("display", c("group").alias("grp"), "auth", "has_body", "unresolved", "orphaned")


@query("endpoint_to_request", f"WITH {ESTATE} SELECT method || ' ' || normalized AS spec_ref, 'http://h' || path AS url, method || ' ' || path AS name, grp AS folder FROM inv")
def endpoint_to_request(spark, sf):
    sent, _ = inventory.endpoint_to_request(composed(spark, sf)[0], F.lit("http://h//"))
    return sent.select("spec_ref", "url", "name", "folder")


@query("refused_requests", "SELECT s_suppkey, 'cfg.' || s_name AS exprs FROM supplier WHERE s_suppkey % 3 = 0")
def refused_requests(spark, sf):
    from apiquarry.plans.q_paths import gapped

    params = F.expr(f"CAST(array() AS array<{PARAM}>)")
    eps = gapped(spark, sf).select(
        F.concat(F.lit("n"), c("s_nationkey")).alias(P), c("s_suppkey").cast("string").alias("id"), F.lit("GET").alias("method"), "path", params.alias("path_params"),
        params.alias("query_params"), params.alias("headers"), F.lit(None).cast(BODY).alias("body"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("group"),
    )
    _, refused = inventory.endpoint_to_request(eps, F.lit("{{base_url}}"))
    return refused.select(c("id").cast("bigint").alias("s_suppkey"), F.array_join("unresolved_exprs", ",").alias("exprs"))


@query(
    "search_endpoints",
    f"WITH {ESTATE} SELECT method || ' ' || path AS display FROM inv WHERE lower(method || ' ' || path) LIKE '%stock%' OR lower(coalesce(grp, '')) LIKE '%stock%' ORDER BY project_id, normalized, method, display LIMIT 20 OFFSET 5",
)
def search_endpoints(spark, sf):
    return inventory.search_endpoints(view_of(spark, sf), "STOCK", 5, 20).select("display")


@query("search_total", f"WITH {ESTATE} SELECT count(*) AS total FROM inv WHERE lower(method || ' ' || path) LIKE '%vip%' OR lower(coalesce(grp, '')) LIKE '%vip%'")
def search_total(spark, sf):
    return inventory.matching(view_of(spark, sf), "Vip").agg(F.count("*").alias("total"))


@query("find_endpoint", f"WITH {ESTATE} SELECT project_id, method || ' ' || path AS display FROM inv WHERE lower(method || ' ' || normalized) = 'get /api/legacy/customers/0/{{}}' OR lower(method || ' ' || normalized) = 'get /lost/7'")
def find_endpoint(spark, sf):
    view = view_of(spark, sf)
    by_id = inventory.find_endpoint(view, "GET /API/legacy/customers/0/{}")
    return by_id.unionByName(inventory.find_endpoint(view, "get /LOST/7")).select(P, "display")


@query("resolved_only", "SELECT count(*) FILTER (WHERE s_suppkey % 3 <> 0) AS resolved, count(*) FILTER (WHERE s_suppkey % 3 = 0 OR s_suppkey % 4 = 0) AS with_gaps FROM supplier")
def resolved_only(spark, sf):
    from apiquarry.plans.q_paths import gapped

    eps = gapped(spark, sf)
    usable = inventory.resolved_only(eps).select(F.lit(1).alias("resolved"), F.lit(0).alias("with_gaps"))
    flawed = inventory.with_gaps(eps).select(F.lit(0).alias("resolved"), F.lit(1).alias("with_gaps"))
    return usable.unionByName(flawed).agg(F.sum("resolved").alias("resolved"), F.sum("with_gaps").alias("with_gaps"))


@query("gap_counts", "SELECT s_nationkey, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS gaps, count(*) FILTER (WHERE s_suppkey % 4 = 0 AND s_suppkey % 3 <> 0) AS orphans FROM supplier GROUP BY 1")
def gap_counts(spark, sf):
    from apiquarry.plans.q_paths import gapped

    eps = gapped(spark, sf).select(c("s_nationkey").alias(P), "orphaned", (~paths.is_resolved(c("path"))).alias("unresolved"))
    return inventory.gap_counts(eps).withColumnRenamed(P, "s_nationkey")


@query("group_endpoints", f"WITH {ESTATE} SELECT project_id, coalesce(grp, 'ungrouped') AS grp, count(*) AS endpoints FROM inv GROUP BY 1, 2")
def group_endpoints(spark, sf):
    return inventory.group_sizes(view_of(spark, sf)).select(P, c("group").alias("grp"), "endpoints")


@query("order_endpoints", f"WITH {ESTATE} SELECT project_id, method, normalized FROM inv ORDER BY project_id, normalized, method")
def order_endpoints(spark, sf):
    eps = composed(spark, sf)[0]
    return inventory.in_order(eps).select(P, "method", paths.normalize_path(c("path")).alias("normalized"))


@query("page_endpoints", f"WITH {ESTATE} SELECT method || ' ' || path AS display FROM inv ORDER BY project_id, normalized, method, display LIMIT 50 OFFSET 30")
def page_endpoints(spark, sf):
    return inventory.search_endpoints(view_of(spark, sf), "", 30).select("display")


@query(
    "scan_stats",
    f"""WITH {ESTATE}, e AS (SELECT project_id, count(*) AS endpoints_found FROM inv GROUP BY 1),
 r AS (SELECT project_id, count(*) AS routers_found FROM (SELECT 'e' || (r_regionkey % 2) AS project_id FROM region UNION ALL SELECT 'e' || (n_regionkey % 2) FROM nation UNION ALL SELECT 'e' || (n_regionkey % 2) FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1),
 f AS (SELECT project_id, count(*) AS n FROM (SELECT DISTINCT project_id, split_part(source, ':', 1) AS file FROM inv) GROUP BY 1)
 SELECT project_id, n AS files_seen, n AS files_parsed, routers_found, endpoints_found, 0 AS unresolved FROM e JOIN r USING (project_id) JOIN f USING (project_id)""",
)
def scan_stats(spark, sf):
    view = cut_lineage(view_of(spark, sf))
    files = view.select(P, c("file").alias("path")).distinct()
    return inventory.scan_stats(files, files, estate(spark, sf)[0], view)


@query(
    "fact_union",
    """SELECT project_id, count(*) AS routes FROM (SELECT 'e' || (n_regionkey % 2) AS project_id FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 'e' || (n_regionkey % 2) FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'e0' FROM customer WHERE c_custkey % 50 = 7) GROUP BY 1""",
)
def fact_union(spark, sf):
    """Two providers of route facts, united."""
    _, routes, _ = estate(spark, sf)
    providers.register("even", lambda _files: {"routes": routes.filter("seq % 2 = 0")})
    providers.register("odd", lambda _files: {"routes": routes.filter("seq % 2 = 1").drop("deprecated")})
    return providers.collect_facts(routes, ["even", "odd"])["routes"].groupBy(P).agg(F.count("*").alias("routes"))


def two_inventories(spark, sf):
    """Static and runtime endpoints of orders: some in both, some in one, some with gaps."""
    base = table(spark, sf, "orders").selectExpr("concat('c', o_custkey % 11) AS project_id", "o_orderkey AS seq", "o_orderkey AS k")
    params = F.expr(f"CAST(array() AS array<{PARAM}>)")

    def endpoints(df, path, source, group):
        return df.select(
            P, "seq", F.expr("CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END").alias("method"), path.alias("path"), params.alias("path_params"), params.alias("query_params"),
            params.alias("headers"), F.lit(None).cast(BODY).alias("body"), F.lit(None).cast(AUTH).alias("auth"),
            F.expr(f"CAST({source} AS struct<file:string,line:int,column:int>)").alias("source"), F.lit(None).cast("struct<source:string,framework:string,document:string>").alias("origin"),
            F.expr(group).cast("string").alias("group"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("description"),
            F.lit("medium").alias("confidence"), F.lit(False).alias("orphaned"), F.expr("CAST(map() AS map<string,string>)").alias("metadata"),
        ).withColumn("id", paths.endpoint_id(c("method"), c("path")))

    lit, key = paths.literal, F.concat(F.lit("o"), c("k").cast("string"))
    static_path = (
        F.when(c("k") % 6 == 2, paths.path_of(lit("api"), paths.unresolved(F.concat(F.lit("X"), key)), lit(key), paths.param("id")))
        .when(c("k") % 6 == 3, paths.path_of(lit("api"), lit(key), paths.parse_path(F.lit("{rest:path}"), "braces")["segments"][0]))
        .when(c("k") % 6 == 4, paths.path_of(paths.unresolved("Y"), lit("many")))
        .otherwise(paths.path_of(lit("api"), lit(key), paths.param("id")))
    )
    runtime_path = (
        F.when(c("k") % 6 == 2, paths.path_of(lit("api"), lit("v1"), lit(key), paths.param("order")))
        .when(c("k") % 6 == 4, paths.path_of(lit(key), lit("many")))
        .otherwise(paths.path_of(lit("api"), lit(key), paths.param("order")))
    )
    static = endpoints(base.filter("k % 6 <> 5"), static_path, "named_struct('file', 'a.py', 'line', CAST(k AS INT), 'column', 0)", "'static'")
    runtime = endpoints(base.filter("k % 6 <> 1"), runtime_path, "NULL", "CASE WHEN k % 12 = 0 THEN 'runtime' END")
    return static, runtime


# k % 6: 0 in both, 1 static only, 2 gap filled, 3 catch-all against plain, 4 ambiguous gaps, 5 runtime only.
MERGED = """m AS (SELECT 'c' || (o_custkey % 11) AS project_id, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, o_orderkey % 6 AS t FROM orders),
 amb AS (SELECT project_id, count(*) AS n FROM m WHERE t = 4 GROUP BY 1),
 merged AS (SELECT project_id, method || ' ' || CASE t WHEN 2 THEN '/api/v1/o' || k || '/{}' ELSE '/api/o' || k || '/{}' END AS id, CASE t WHEN 1 THEN 'static_only' WHEN 2 THEN 'gap_filled' ELSE 'matched' END AS enrich,
   CASE WHEN k % 12 = 0 THEN 'runtime' ELSE 'static' END AS grp, CAST(k AS INTEGER) AS line, CASE WHEN t = 2 THEN 'Xo' || k END AS resolved_from FROM m WHERE t < 4
  UNION ALL SELECT project_id, 'GET /{?Y}/many', CASE WHEN n = 1 THEN 'gap' ELSE 'static_only' END, 'static', CAST(k AS INTEGER), NULL FROM m JOIN amb USING (project_id) WHERE t = 4
  UNION ALL SELECT project_id, method || CASE t WHEN 4 THEN ' /o' || k || '/many' ELSE ' /api/o' || k || '/{}' END, 'runtime_only', CASE WHEN k % 12 = 0 THEN 'runtime' END, NULL, NULL FROM m WHERE t IN (4, 5))"""


def merged(spark, sf):
    return merge.merge_inventories(*two_inventories(spark, sf))


@query("merge_inventories", f"WITH {MERGED} SELECT project_id, id, enrich FROM merged")
def merge_inventories(spark, sf):
    return merged(spark, sf).select(P, "id", c("metadata")["enrich"].alias("enrich"))


@query("gap_fill", f"WITH {MERGED} SELECT project_id, id, resolved_from FROM merged WHERE enrich = 'gap_filled'")
def gap_fill(spark, sf):
    m = c("metadata")
    return merged(spark, sf).filter(m["enrich"] == "gap_filled").select(P, "id", m["resolved_from"].alias("resolved_from"))


@query("combine", f"WITH {MERGED} SELECT project_id, id, grp, line FROM merged WHERE enrich = 'matched'")
def combine(spark, sf):
    return merged(spark, sf).filter(c("metadata")["enrich"] == "matched").select(P, "id", c("group").alias("grp"), c("source.line").alias("line"))


@query(
    "merge_report",
    f"""WITH {MERGED} SELECT project_id, count(*) FILTER (WHERE enrich = 'matched') AS matched, count(*) FILTER (WHERE enrich = 'static_only') AS static_only,
 count(*) FILTER (WHERE enrich = 'runtime_only') AS runtime_only, count(*) FILTER (WHERE enrich = 'gap_filled') AS gaps_filled FROM merged GROUP BY 1""",
)
def merge_report(spark, sf):
    return merge.merge_report(merged(spark, sf))


DRIFT = """ev AS (SELECT DISTINCT 'p' || (user_id % 7) AS project_id, CASE event_type WHEN 'view' THEN 'GET' ELSE 'POST' END || ' /u/' || user_id || '/' || event_type || '/' || json_extract_string(props, '$.k') AS display, event_id % 3 AS slice FROM events)"""


#: Events a task compares.
DRIFT_ROWS = 100_000


@query(
    "inventory_drift",
    f"""WITH {DRIFT}, a AS (SELECT DISTINCT project_id, display FROM ev WHERE slice <> 0), b AS (SELECT DISTINCT project_id, display FROM ev WHERE slice <> 1)
 SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def inventory_drift(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "concat('p', user_id % 7) AS project_id", "concat(CASE event_type WHEN 'view' THEN 'GET' ELSE 'POST' END, ' /u/', user_id, '/', event_type, '/', get_json_object(props, '$.k')) AS display", "event_id % 3 AS slice"
    )
    # Dealt over as many tasks as the table's rows ask for: texts like these pack so well that by bytes a task gets far too many.
    rows = rows.repartition(1 + rows.count() // DRIFT_ROWS, P, "display")
    a, b = (rows.filter(f"slice <> {n}").select(P, "display").distinct() for n in (0, 1))
    return inventory.drift(a, b, [P, "display"])


@query("misses_now_found", f"WITH {ESTATE} SELECT DISTINCT i.project_id, i.path FROM inv i WHERE i.path LIKE '%/customers/%0/{{id}}' AND i.project_id = 'e0'")
def misses_now_found(spark, sf):
    routes = table(spark, sf, "customer").join(table(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey")).filter("c_custkey % 10 = 0")
    plain = routes.selectExpr("'e0' AS project_id", "concat('/api/v', n_regionkey, '/n', n_nationkey, '/customers/', c_custkey, '/{id}') AS path")
    old = routes.selectExpr("'e0' AS project_id", "concat('/api/legacy/customers/', c_custkey, '/{id}') AS path")
    return inventory.misses_now_found(plain.unionByName(old), view_of(spark, sf))


@query(
    "warning_summary",
    """WITH w AS (SELECT CASE WHEN event_id % 10 < 9 THEN 'big' ELSE 'p' || (user_id % 3) END AS project_id, event_id AS seq, event_type AS kind, event_type || ' of ' || user_id AS message FROM events),
 k AS (SELECT project_id, kind, count(*) AS n FROM w GROUP BY ALL),
 e AS (SELECT project_id, list(message ORDER BY seq)[1:3] AS examples FROM w GROUP BY 1),
 t AS (SELECT project_id, CAST(sum(n) AS BIGINT) AS warnings, string_agg(kind || '=' || n, ',' ORDER BY n DESC, kind) AS kinds FROM k GROUP BY 1)
 SELECT project_id, warnings, kinds, array_to_string(examples, '; ') AS examples, warnings || ' scan warning(s), e.g.: ' || array_to_string(examples, ' | ') AS summary FROM t JOIN e USING (project_id)""",
)
def warning_summary(spark, sf):
    """One project has nine tenths of all warnings."""
    found = table(spark, sf, "events").selectExpr(
        "CASE WHEN event_id % 10 < 9 THEN 'big' ELSE concat('p', user_id % 3) END AS project_id", "event_id AS seq", "event_type AS kind", "concat(event_type, ' of ', user_id) AS message"
    )
    kinds = F.array_join(F.transform("kinds", lambda k: F.concat_ws("=", k["kind"], k["n"].cast("string"))), ",")
    return warnings.summarise(found).select(P, "warnings", kinds.alias("kinds"), F.array_join("examples", "; ").alias("examples"), "summary")

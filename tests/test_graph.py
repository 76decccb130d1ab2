from facts import AUTH, endpoints, fastapi_project, mounts, routers, routes, table
from pyspark.sql import functions as F

from apiquarry import schemas
from apiquarry.functions import paths
from apiquarry.operators import graph, inventory, linking
from apiquarry.plans import q_inventory

GOLDEN = {
    ("DELETE", "/api/v1/users/{user_id}", "users", "app/api/users.py:42"),
    ("GET", "/?/stats", "admin", "app/api/admin.py:11"),
    ("GET", "/api/v1/users/", "users", "app/api/users.py:17"),
    ("GET", "/api/v1/users/{user_id}", "users", "app/api/users.py:26"),
    ("GET", "/dynamic/?", None, "app/api/dynamic.py:12"),
    ("GET", "/health", "meta", "app/main.py:20"),
    ("GET", "/orphan/forgotten", None, "app/api/orphan.py:8"),
    ("GET", "/v1/items", "items", "app/api/items.py:11"),
    ("GET", "/v1/items/{item_id}", "items", "app/api/items.py:17"),
    ("GET", "/v2/items", "items", "app/api/items.py:11"),
    ("GET", "/v2/items/{item_id}", "items", "app/api/items.py:17"),
    ("POST", "/api/v1/users/", "users", "app/api/users.py:35"),
    ("PUT", "/v1/items/{item_id}", "items", "app/api/items.py:17"),
    ("PUT", "/v2/items/{item_id}", "items", "app/api/items.py:17"),
}


def test_golden_fastapi_inventory(spark):
    f = fastapi_project(spark)
    resolved, warnings = graph.resolve_routes(f["routers"], f["routes"], f["mounts"], f["imports"], f["exports"], f["files"])
    view = inventory.endpoint_view(inventory.to_endpoints(resolved, F.lit("fastapi"))).collect()
    assert {(r["method"], r["path"], r["group"], f"{r['file']}:{r['line']}") for r in view} == GOLDEN
    assert len(view) == len(GOLDEN)
    assert {r["path"] for r in view if r["orphaned"]} == {"/dynamic/?", "/orphan/forgotten"}
    assert {r["path"] for r in view if r["unresolved"]} == {"/?/stats", "/dynamic/?"}
    assert {r["path"] for r in view if r["auth"]} == {"/api/v1/users/", "/api/v1/users/{user_id}"}
    said = {(r["kind"], r["subject"]) for r in warnings.collect()}
    assert said == {("orphaned_router", "app/api/orphan.py:router"), ("orphaned_router", "app/api/dynamic.py:router")}


def _paths(df):
    return sorted(df.select(paths.display(F.col("method"), F.col("path")).alias("d")).toPandas()["d"])


def simple(spark, rs, ms, ps):
    return graph.resolve_routes(
        routers(spark, [{"module": "m.py", **r} for r in rs]),
        routes(spark, [{"router_module": "m.py", "methods": ["GET"], **p} for p in ps]),
        mounts(spark, [{"parent_module": "m.py", "child_module": "m.py", **m} for m in ms]),
    )


def test_nested_double_mount_and_filters(spark):
    got, warnings = simple(
        spark,
        [{"name": "app", "is_app_root": True}, {"name": "a", "prefix": "/own", "group": "ga"}, {"name": "b", "prefix": "/bb"}],
        [
            {"parent_name": "app", "child_name": "a", "prefix": "/x", "auth": AUTH},
            {"parent_name": "app", "child_name": "a", "prefix": "/y", "replaces_child_prefix": True},
            {"parent_name": "a", "child_name": "b", "prefix": "/z", "methods": ["GET"], "group": "gm"},
            {"parent_name": "a", "child_name": "b", "prefix": "/z", "methods": ["GET"], "group": "other"},
        ],
        [{"router_name": "b", "path": "/r", "methods": ["GET", "POST"]}, {"router_name": "a", "path": "/"}],
    )
    assert _paths(got) == ["GET /x/own/", "GET /x/own/z/bb/r", "GET /y/", "GET /y/z/bb/r"]
    rows = {paths_: (g, a) for paths_, g, a in [(r["d"], r["group"], r["auth"] is not None) for r in got.select(paths.display(F.col("method"), F.col("path")).alias("d"), "group", "auth").collect()]}
    assert rows["GET /x/own/z/bb/r"] == ("gm", True)
    assert rows["GET /y/z/bb/r"] == ("gm", False)
    assert warnings.count() == 0


def test_cycle_and_orphan_order(spark):
    got, warnings = simple(
        spark,
        [{"name": "app", "is_app_root": True}, {"name": "c1"}, {"name": "c2"}, {"name": "imp", "implicit": True}],
        [
            {"parent_name": "app", "child_name": "c1", "prefix": "/a"},
            {"parent_name": "c1", "child_name": "app", "prefix": "/again"},
            {"parent_name": "zz", "child_name": "c2", "prefix": "/late"},
            {"parent_name": "app", "child_name": "nowhere", "prefix": "/n"},
        ],
        [{"router_name": "c1", "path": "/one"}, {"router_name": "c2", "path": "/two"}, {"router_name": "zz", "path": "/three"}, {"router_name": "imp", "path": "/four"}],
    )
    # c2 sorts before zz, so it is listed alone and again under zz.
    assert _paths(got) == ["GET /a/one", "GET /late/two", "GET /three", "GET /two"]
    assert {(r["kind"], r["subject"]) for r in warnings.collect()} == {
        ("cycle", "m.py:app"), ("orphaned_router", "m.py:c2"), ("undeclared_router", "m.py:zz"), ("undeclared_mount", "m.py:nowhere"),
    }


def test_long_chains_are_walked_to_the_end(spark):
    chain = [f"r{i:02d}" for i in range(40)]
    got, warnings = simple(
        spark,
        [{"name": n, "is_app_root": n == "r00"} for n in chain],
        [{"parent_name": a, "child_name": b, "prefix": "/p"} for a, b in zip(chain, chain[1:])],
        [{"router_name": n, "path": "/x"} for n in ("r31", "r32")],
    )
    rows = got.select("orphaned", F.size("path.segments").alias("n")).collect()
    assert {(r["orphaned"], r["n"]) for r in rows} == {(False, 32), (False, 33)}
    assert warnings.count() == 0


def bindings(spark, files, imports):
    f = spark.createDataFrame([("p", x, "") for x in files], schemas.FILES)
    i = table(spark, schemas.IMPORTS, imports)
    return {(r["module"], r["local_name"]): (r["kind"], r["target_module"], r["target_name"]) for r in linking.resolve_imports(i, f).collect()}


def test_import_resolution(spark):
    got = bindings(
        spark,
        ["pkg/a.py", "pkg/sub/__init__.py", "pkg/sub/users.py", "web/src/lib/db.ts", "src/lib/x.ts", "src/util/index.js", "web/routes/users.route.ts", "shared.py"],
        [
            {"module": "pkg/sub/users.py", "local_name": "a1", "source": "a", "original": "thing", "level": 2},
            {"module": "pkg/a.py", "local_name": "users", "source": "sub", "original": "users", "level": 1},
            {"module": "pkg/a.py", "local_name": "sub", "source": "pkg.sub", "original": None, "level": 0},
            {"module": "pkg/a.py", "local_name": "nested", "source": "sub.users", "original": "r", "level": 0},
            {"module": "pkg/a.py", "local_name": "outside", "source": "fastapi", "original": "FastAPI", "level": 0},
            {"module": "pkg/a.py", "local_name": "twice", "source": "shared", "original": "one", "level": 0},
            {"module": "pkg/a.py", "local_name": "twice", "source": "shared", "original": "two", "level": 0},
            {"module": "web/routes/app.ts", "local_name": "db", "source": "../src/lib/db.js", "original": "default", "level": 0},
            {"module": "web/routes/app.ts", "local_name": "u", "source": "./users.route", "original": None, "level": 0},
            {"module": "web/routes/app.ts", "local_name": "x", "source": "@/lib/x", "original": "x", "level": 0},
            {"module": "web/routes/app.ts", "local_name": "util", "source": "~/util", "original": None, "level": 0},
            {"module": "web/routes/app.ts", "local_name": "express", "source": "express", "original": "default", "level": 0},
            {"module": "svc/main.go", "local_name": "routes", "source": "/svc/routes", "original": None, "level": 0},
        ],
    )
    assert got == {
        ("pkg/sub/users.py", "a1"): ("symbol", "pkg/a.py", "thing"),
        ("pkg/a.py", "users"): ("module", "pkg/sub/users.py", None),
        ("pkg/a.py", "sub"): ("module", "pkg/sub/__init__.py", None),
        ("pkg/a.py", "nested"): ("symbol", "pkg/sub/users.py", "r"),
        ("pkg/a.py", "twice"): ("symbol", "shared.py", "two"),
        ("web/routes/app.ts", "db"): ("symbol", "web/src/lib/db.ts", "default"),
        ("web/routes/app.ts", "u"): ("module", "web/routes/users.route.ts", None),
        ("web/routes/app.ts", "x"): ("symbol", "src/lib/x.ts", "x"),
        ("web/routes/app.ts", "util"): ("module", "src/util/index.js", None),
        ("svc/main.go", "routes"): ("module", "svc/routes", None),
    }


def test_symbols_through_exports_and_go_packages(spark):
    rs = routers(
        spark,
        [
            {"module": "r/users.js", "name": "router"},
            {"module": "svc/routes/api.go", "name": "Register"},
            {"module": "svc/routes/api.go", "name": "Handler.Routes"},
            {"module": "svc/main.go", "name": "r"},
        ],
    )
    ex = table(
        spark,
        schemas.EXPORTS,
        [
            {"module": "r/users.js", "exported": "default", "local": "router"},
            {"module": "r/index.js", "exported": "users", "local": "u"},
            {"module": "svc/routes/new.go", "exported": "NewHandler", "local": "Handler"},
        ],
    )
    im = table(
        spark,
        schemas.IMPORTS,
        [
            {"module": "app.js", "local_name": "users", "source": "./r/users", "original": "default", "level": 0},
            {"module": "app.js", "local_name": "all", "source": "./r", "original": "default", "level": 0},
            {"module": "r/index.js", "local_name": "u", "source": "./users", "original": "default", "level": 0},
            {"module": "app.js", "local_name": "value", "source": "./r/users", "original": "thing", "level": 0},
            {"module": "svc/main.go", "local_name": "routes", "source": "/svc/routes", "original": None, "level": 0},
        ],
    )
    fl = spark.createDataFrame([("p", x, "") for x in ["app.js", "r/users.js", "r/index.js"]], schemas.FILES)
    refs = spark.createDataFrame(
        [("p", m, n) for m, n in [
            ("app.js", "users"), ("app.js", "all.users"), ("app.js", "all.nothing"), ("app.js", "value.x"), ("app.js", "here"),
            ("svc/main.go", "routes.Register"), ("svc/main.go", "routes.NewHandler.Routes"), ("svc/other.go", "r"), ("svc/main.go", "lost.Thing"),
        ]],
        "project_id string, module string, name string",
    )
    got = {(r["module"], r["name"]): (r["sym_module"], r["sym_name"]) for r in graph.link(refs, rs, im, ex, fl).collect()}
    assert got == {
        ("app.js", "users"): ("r/users.js", "router"),
        ("app.js", "all.users"): ("r/users.js", "router"),
        ("app.js", "all.nothing"): (None, None),
        ("app.js", "value.x"): (None, None),
        ("app.js", "here"): ("app.js", "here"),
        ("svc/main.go", "routes.Register"): ("svc/routes/api.go", "Register"),
        ("svc/main.go", "routes.NewHandler.Routes"): ("svc/routes/api.go", "Handler.Routes"),
        ("svc/other.go", "r"): ("svc/main.go", "r"),
        ("svc/main.go", "lost.Thing"): ("svc/main.go", "lost.Thing"),
    }


def test_handlers_fill_and_narrow(spark):
    rs, _ = graph.resolve_routes(
        routers(spark, [{"module": "svc/main.go", "name": "r", "is_app_root": True}]),
        routes(
            spark,
            [
                {"router_module": "svc/main.go", "router_name": "r", "path": "/a/{id}", "methods": inventory.UNSPECIFIED_METHODS, "handler_module": "svc/main.go", "handler_name": "List", "summary": "any method"},
                {"router_module": "svc/main.go", "router_name": "r", "path": "/b", "methods": ["GET"], "handler_module": "svc/main.go", "handler_name": "h.Show"},
                {"router_module": "svc/main.go", "router_name": "r", "path": "/c", "methods": ["GET"], "handler_module": "svc/main.go", "handler_name": "h.Twice"},
            ],
        ),
        mounts(spark, []),
    )
    p = lambda n: (n, None, False, None, None, [])
    hs = table(
        spark,
        schemas.HANDLERS,
        [
            {"module": "svc/h.go", "name": "List", "query_params": [p("id"), p("q")], "methods": ["POST"]},
            {"module": "svc/z.go", "name": "List", "query_params": [p("other")], "methods": ["GET"]},
            {"module": "lib/h.go", "name": "Show", "headers": [p("X-A")], "auth": AUTH},
            {"module": "lib/h.go", "name": "Twice"},
            {"module": "lib2/h.go", "name": "Twice"},
        ],
    )
    got = inventory.fill_from_handlers(inventory.to_endpoints(rs, F.lit("go")), hs)
    view = {r["display"]: r for r in inventory.endpoint_view(got).collect()}
    assert set(view) == {"POST /a/{id}", "GET /b", "GET /c"}
    assert view["POST /a/{id}"]["query"] == ["q"] and view["POST /a/{id}"]["summary"] is None
    assert view["GET /b"]["auth"] and not view["GET /c"]["auth"]


def test_requests_and_search(spark):
    eps = endpoints(
        spark,
        [
            {"method": "GET", "path": "/users/{id}", "summary": "One user", "group": "users", "query_params": [("limit", "integer", False, "20", None, []), ("q", None, False, '"a b"', None, [])], "path_params": [param_("id")]},
            {"method": "POST", "path": "/users", "body": ("application/json", None, '{"b":1.0,"a":[true]}', True)},
            {"method": "GET", "path": "/?X/stats"},
        ],
    )
    sent, refused = inventory.endpoint_to_request(eps, F.lit("http://h/"))
    rows = {r["spec_ref"]: r for r in sent.collect()}
    assert rows["GET /users/{}"]["url"] == "http://h/users/{id}" and rows["GET /users/{}"]["name"] == "One user"
    assert [(q["key"], q["value"]) for q in rows["GET /users/{}"]["query"]] == [("limit", "20"), ("q", "a b")]
    assert rows["GET /users/{}"]["path_values"] == {"id": ""}
    assert rows["POST /users"]["body_text"] == '{\n  "a": [\n    true\n  ],\n  "b": 1.0\n}'
    assert [(r["id"], r["unresolved_exprs"]) for r in refused.collect()] == [("GET /{?X}/stats", ["X"])]
    view = inventory.endpoint_view(eps)
    assert [r["id"] for r in inventory.search_endpoints(view, "USER", 0, 1).collect()] == ["POST /users"]
    assert inventory.matching(view, "user").count() == 2
    assert inventory.find_endpoint(view, " get /USERS/{ID} ").count() == 1
    assert inventory.gap_counts(view).first()["gaps"] == 1


def param_(name):
    return (name, None, True, None, None, [])


def test_aliases_of_constant_names_meet_without_a_loop_over_pairs(spark, monkeypatch):
    plans = []
    cut = linking.cut_lineage
    monkeypatch.setattr(linking, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    ids = spark.range(40).select(F.lit("p").alias("project_id"), F.col("id").alias("k"))
    declared = ids.filter("k % 20 = 0").selectExpr("project_id", "concat('x', k) AS module", "'router' AS name")
    bindings = ids.filter("k % 20 <> 0").selectExpr(
        "project_id", "concat('x', k) AS module", "'router' AS local_name", "'symbol' AS kind", "concat('x', k + 1) AS target_module", "'router' AS target_name"
    )
    exports = ids.selectExpr("project_id", "concat('y', k) AS module", "'public' AS exported", "'local' AS local")
    ends = {(r["module"], r["name"]): (r["to_module"], r["to_name"]) for r in linking.canonical_symbols(declared, bindings, exports).collect()}
    assert len(ends) == 78 and ends["x1", "router"] == ("x20", "router") and ends["y7", "public"] == ("y7", "local")
    assert "FullOuter" not in plans[0] and "Join LeftOuter, false" not in plans[0]


def test_imports_are_dealt_over_all_tasks(spark):
    files = spark.createDataFrame([("p", "a/b.ts")], "project_id string, path string")
    imports = spark.createDataFrame([("p", 1, "a/c.ts", "r", "./b.js", "default", 0)], "project_id string, seq bigint, module string, local_name string, source string, original string, level int").coalesce(1)
    got = linking.resolve_imports(imports, files)
    assert "RepartitionByExpression [project_id" in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.first()["target_module"] == "a/b.ts"


def test_go_symbols_are_not_sent_through_the_driver(spark, monkeypatch):
    small = "project_id string, module string, name string"
    refs = spark.createDataFrame([("p", "a/m.go", "One")], small)
    declared = spark.createDataFrame([("p", "a/r.go", "Three")], small)
    bindings = spark.createDataFrame([], "project_id string, module string, local_name string, kind string, target_module string, target_name string")
    exports = spark.createDataFrame([("p", i, "a/n.go", x, y) for i, (x, y) in enumerate([("One", "Two"), ("Two", "Three")])], "project_id string, seq bigint, module string, exported string, local string")
    plans = []
    cut = linking.cut_lineage
    monkeypatch.setattr(linking, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    got = linking.resolve_go_symbols(refs, declared, bindings, exports)
    assert [(r["sym_module"], r["sym_name"]) for r in got.collect()] == [("a/r.go", "Three")]
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_drift_is_dealt_by_the_rows_of_the_table(spark, tmp_path, monkeypatch):
    events = spark.createDataFrame([(i, i % 5, "view" if i % 2 else "click", '{"k": %d}' % (i % 4)) for i in range(60)], "event_id bigint, user_id bigint, event_type string, props string")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(q_inventory, "DRIFT_ROWS", 10)
    got = q_inventory.inventory_drift(spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    sides = [{(i % 5, i % 2, i % 4) for i in range(60) if i % 3 != n} for n in (0, 1)]
    assert got.count() == len(sides[0] ^ sides[1])

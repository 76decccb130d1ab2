import json
import tempfile

from pyspark.sql import functions as F

from apiquarry.functions import paths
from apiquarry.operators import collections, detect, providers, traffic
from apiquarry.sources import files, history, openapi, raw_http
from apiquarry.streaming import changes, ingest, runs

DOC = """{"openapi":"3.1.0","info":{"title":"T"},"servers":[{"url":"https://h/"}],
"components":{"schemas":{"A":{"$ref":"#/components/schemas/B","description":"beside"},"B":{"type":"object","properties":{"a":{"$ref":"#/components/schemas/A"},"when":{"type":"string","format":"date-time"},"far":{"$ref":"other.json#/X"}}}}},
"paths":{"/x/{id}":{"get":{"summary":"S","responses":{},"parameters":[{"name":"q","in":"query","schema":{"enum":["b",2]}}]},"post":{"requestBody":{"content":{"application/json":{"schema":{"$ref":"#/components/schemas/A"},"examples":{"one":{"value":{"z":1}}}}}}},"note":"no operation"}}}"""


def docs(spark, *texts):
    return openapi.parse_documents(spark.createDataFrame([("p", str(i), t) for i, t in enumerate(texts)], "project_id string, document string, content string"))


def test_openapi(spark):
    parsed = docs(spark, DOC, '{"swagger":"2.0","paths":{}}', '{"a":1}', "nope", '{"openapi":"3.0.0"}', '{"openapi":"2.5"}')
    rows = {r["id"]: r for r in openapi.openapi_endpoints(parsed).collect()}
    assert set(rows) == {"GET /x/{}", "POST /x/{}"}
    assert rows["GET /x/{}"]["query_params"][0]["enum_json"] == ['"b"', "2"]
    assert [p["name"] for p in rows["GET /x/{}"]["path_params"]] == ["id"]
    body = rows["POST /x/{}"]["body"]
    assert body["example_json"] == '{"z":1}'
    assert body["schema_json"] == '{"properties":{"a":{},"far":{"$ref":"other.json#/X"},"when":{"format":"date-time","type":"string"}},"type":"object"}'
    warned = {(r["document"], r["warning"]) for r in openapi.openapi_warnings(parsed).collect()}
    assert warned == {
        ("1", "no operations"), ("1", "no server: give a base URL"),
        ("2", "refused: not_openapi"), ("3", "refused: not_json"), ("4", "no paths"), ("5", "refused: unsupported_version"),
    }


def test_references_of_any_shape(spark):
    """Members of any nesting beside a reference, long texts, chains of thirty, and circles."""
    chain = {f"C{i}": {"$ref": f"#/components/schemas/C{i + 1}", "x-a": {"b": {"c": [i, {"d": 1}]}}, "description": 'long "text" {' * 10_000} for i in range(30)}
    nest = {"type": "integer"}
    for _ in range(25):
        nest = {"type": "array", "items": nest}
    schemas = chain | {
        "C30": {"type": "object", "properties": {"deep": nest, "self": {"$ref": "#/components/schemas/C30"}}}, "A": {"properties": {"b": {"$ref": "#/components/schemas/B"}}},
        "B": {"properties": {"a": {"$ref": "#/components/schemas/A"}, "gone": {"$ref": "#/nowhere"}, "far": {"$ref": "x.json#/Y", "z": 1}, "s~/l": {"$ref": "#/components/schemas/t~0~1u"}}}, "t~/u": {"enum": ["$ref"]},
    }
    body = lambda ref: {"requestBody": {"content": {"application/json": {"schema": {"$ref": f"#/components/schemas/{ref}"}}}}}
    doc = {"openapi": "3.0.0", "paths": {"/c": {"post": body("C0")}, "/a": {"post": body("A")}}, "components": {"schemas": schemas}}
    got = {r["id"]: r["body"] for r in openapi.openapi_endpoints(docs(spark, json.dumps(doc))).collect()}
    assert json.loads(got["POST /c"]["schema_json"]) == {"type": "object", "properties": {"deep": nest, "self": {}}}
    assert got["POST /c"]["example_json"] == '{"deep":' + "[" * 25 + "0" + "]" * 25 + ',"self":null}'
    assert json.loads(got["POST /a"]["schema_json"]) == {
        "properties": {"b": {"properties": {"a": {}, "gone": {}, "far": {"$ref": "x.json#/Y", "z": 1}, "s~/l": {"enum": ["$ref"]}}}}
    }


def test_example_of_schema(spark):
    cases = [
        ('{"type":"array","items":{"type":"number"}}', "[0.0]"), ('{"allOf":[{"type":"boolean"}]}', "false"), ('{"default":null,"type":"string"}', "null"),
        ('{"properties":{"a":{"type":"string","format":"email"},"b":{}}}', '{"a":"user@example.com","b":null}'), ('{"type":"object"}', "null"), ('{"type":"array"}', "[null]"),
    ]
    df = spark.createDataFrame(cases, "s string, want string")
    for r in df.select("want", openapi.example_of(F.parse_json("s")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_raw_http_edges(spark):
    df = spark.createDataFrame(
        [(1, "\n\n"), (2, "GET"), (3, "GET http://h/p?a=1&b"), (4, 'POST /x HTTP/1.1\nHost: h:443\n\n{"a":1}\n'), (5, "POST /x\nHost: h\nAuthorization: Basic !!\n\na=1&b=2")], "id int, raw string"
    )
    got = {r["id"]: r for r in raw_http.parse_raw_http(df).collect()}
    assert got[1]["error"] == "empty" and got[2]["error"] == "bad_request_line"
    assert got[3]["url"] == "http://h/p" and [tuple(q) for q in got[3]["query"]] == [("a", "1"), ("b", "")]
    assert got[3]["warnings"] == ["request line only"]
    assert (got[4]["url"], got[4]["body_type"], got[4]["body"]) == ("https://h:443/x", "json", '{"a":1}')
    assert got[5]["auth"] is None and [h["name"] for h in got[5]["headers"]] == ["Authorization"]
    assert got[5]["body_type"] == "form" and [tuple(f) for f in got[5]["form"]] == [("a", "1"), ("b", "2")]


def test_kept_files_and_routes(spark):
    rows = [("big", f"f{i:03d}.py", "") for i in range(50)] + [("small", "a.py", ""), ("small", ".git/x", ""), ("small", ".env", "")]
    df = spark.createDataFrame(rows, "project_id string, path string, content string")
    kept, report = files.list_files(df)
    assert {r["project_id"]: (r["files"], r["skipped"]) for r in report.collect()} == {"big": (50, 0), "small": (2, 1)}
    assert sorted(r["path"] for r in kept.filter("project_id = 'small'").collect()) == [".env", "a.py"]
    for path, want in [
        ("app/api/users/[id]/route.ts", ("app", ".", "users", "/api/users/{id}")), ("src/app/(g)/@m/(..)x/route.js", ("app", ".", "x", "/x")), ("app/_p/route.ts", None),
        ("pages/api/a/[...r].ts", ("pages_api", ".", "a", "/api/a/{r}")), ("pages/api/route.ts", None), ("pages/api/x.d.ts", None), ("pages/apix/y.ts", None),
    ]:
        r = spark.range(1).select(files.file_route(F.lit(path)).alias("r")).select("r.kind", "r.root", "r.group", F.when(F.col("r").isNotNull(), paths.render_path(F.col("r.path")))).first()
        assert (tuple(r) if want else r[0]) == want, path


def test_ports_and_detection(spark):
    m = spark.createDataFrame(
        [("p", "Procfile", "web: uvicorn a:b --port 9000"), ("p", "docker-compose.yml", 'ports:\n - "9000:80"\n - 7001:80'), ("p", "requirements.txt", "#fastapi\nFastAPI==1")],
        "project_id string, name string, content string",
    ).withColumn("path", F.col("name"))
    fs = spark.createDataFrame([("p", "a.py", "from fastapi import X"), ("p", "b.py", "import fastapi"), ("p", "m/go.mod", "require github.com/go-chi/chi")], "project_id string, path string, content string")
    found = detect.detect_frameworks(fs, m)
    assert {r["framework"]: (r["score"], r["evidence"]) for r in found.collect()} == {
        "fastapi": (4, ["import in a.py", "manifest in requirements.txt"]), "go": (1, ["require chi in m/go.mod"]),
    }
    listens = spark.createDataFrame([("p", 0, 9000, "main"), ("p", 1, 5555, "main")], "project_id string, seq int, port int, seen_at string")
    got = detect.mine_ports(m, listens, found).orderBy("place").collect()
    assert [(r["url"][-4:], r["confidence"]) for r in got] == [("9000", 9), ("5555", 8), ("7001", 7), ("8000", 1), ("8080", 1)]


def test_collections_and_providers(spark):
    saved = spark.createDataFrame([("p", "c", 0, "i0", "one", "f", "GET /a"), ("p", "c", 1, "i1", "two", None, None)], "project_id string, collection string, position bigint, id string, name string, folder string, spec_ref string")
    drafts = spark.createDataFrame([("p", "c", 0, "GET /a", "A", "g"), ("p", "c", 1, "GET /b", "B", "g"), ("p", "new", 2, "GET /c", "C", None)], "project_id string, collection string, seq bigint, spec_ref string, name string, folder string")
    out, report = collections.save_inventory(saved, drafts)
    rows = sorted((r["collection"], r["position"], r["name"], r["folder"], r["action"]) for r in out.collect())
    assert rows == [("c", 0, "A", "f", "updated"), ("c", 1, "two", None, "kept"), ("c", 2, "B", "g", "added"), ("new", 0, "C", None, "added")]
    assert {r["collection"]: (r["added"], r["updated"]) for r in report.collect()} == {"c": (1, 1), "new": (1, 0)}
    united = providers.unite_facts([{"x": saved.select("id")}, {"x": saved.select("id", "name")}])
    assert united["x"].count() == 4


def test_newest_match_patterns(spark):
    ex = spark.createDataFrame(
        [("p", 1, 10, "GET", "http://h/users/7?x=1", True), ("p", 2, 10, "get", "http://h/users/8", True), ("p", 3, 99, "GET", "http://h/users/8", False), ("p", 4, 50, "GET", "http://h/users/8/x", True), ("p", 5, 60, "GET", "http://h/a?u=/users/9", True)],
        "project_id string, id bigint, at bigint, method string, url string, has_response boolean",
    )
    ts = spark.createDataFrame([("p", "t1", "GET", "{{b}}/users/{id}"), ("p", "t2", "GET", "http://h/users/{id}/x"), ("p", "t3", "GET", "{{b}}/{x}"), ("p", "t4", "POST", "{{b}}")], "project_id string, template_id string, method string, url string")
    got = {r["template_id"]: r["exchange_id"] for r in traffic.newest_match(ex, ts).collect()}
    assert got == {"t1": 5, "t2": 4, "t3": 5}


def _stream(spark, df):
    folder = tempfile.mkdtemp(prefix="aq-") + "/in"
    df.coalesce(1).write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def _drain(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_streams(spark):
    feed = spark.createDataFrame(
        [("p", "2024-01-01 00:00:00.000", ".q/flows/a.yaml", False), ("p", "2024-01-01 00:00:00.100", ".q/flows/a.yaml", False), ("p", "2024-01-01 00:00:00.250", ".q/Collections/c.yml", True),
         ("p", "2024-01-01 00:00:01.000", ".q/workspace.yaml", False), ("p", "2024-01-01 00:00:01.010", ".q/flows/.tmp.yaml", False), ("p", "2024-01-01 00:09:00.000", ".q/flows/z.yaml", False)],
        "project_id string, ts string, path string, removed boolean",
    ).withColumn("ts", F.to_timestamp("ts"))
    bursts = sorted([(r["started"].second, [(d["kind"], d["name"], d["removed"]) for d in r["documents"]]) for r in _drain(changes.coalesce_changes(_stream(spark, feed)), "append", "bursts")])
    assert bursts == [(0, [("collection", "c", True), ("flow", "a", False)]), (1, [("workspace", "", False)])]

    echo = spark.createDataFrame(
        [("p", ".q/flows/a.yaml", "v1", False, True, 1), ("p", ".Q/flows/A.yaml", "v1", False, False, 2), ("p", ".q/flows/a.yaml", "v2", False, False, 3), ("p", ".q/flows/b.yaml", "v1", False, False, 4),
         ("p", ".q/flows/a.yaml", None, True, True, 5), ("p", ".q/flows/a.yaml", None, True, False, 6)],
        "project_id string, path string, content string, removed boolean, own_write boolean, seq bigint",
    )
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    assert sorted(r["seq"] for r in _drain(changes.suppress_echo_stream(_stream(spark, echo)), "update", "echo")) == [3, 4]

    cells = "array<struct<node_id:string,status:string,reason_kind:string,branch:string>>"
    events = spark.createDataFrame(
        [("p", "r", 0, "started", ["a", "b"], None, None, None, None, None), ("p", "r", 1, "node_started", None, "a", None, None, None, None), ("p", "r", 2, "node_finished", None, "a", "passed", None, "true", None), ("p", "r", 3, "node_started", None, "b", None, None, None, None)],
        f"project_id string, run_id string, seq bigint, event string, nodes array<string>, node string, status string, reason_kind string, branch string, results {cells}",
    )
    state = {r["node_id"]: (r["status"], r["branch"]) for r in _drain(runs.live_run_state(_stream(spark, events)), "complete", "live")}
    assert state == {"a": ("passed", "true"), "b": ("running", None)}


def test_history_stream_and_writer(spark):
    rows = spark.createDataFrame(
        [("p", 1, "2024-01-01 10:00:00", "GET", "http://h/?k=hush", 200, 5, None, "{}", '{"a":"hush"}', '{"hush":1}'), ("p", 2, "2024-01-02 10:00:00", "GET", "http://h", None, None, "bad hush", '{"d":1}', None, None), ("p", 3, "2024-01-02 10:00:00", "GET", "x", None, None, None, None, None, None)],
        "project_id string, id bigint, at string, method string, url string, status int, total_ms bigint, error string, draft string, request string, response string",
    ).withColumn("at", F.to_timestamp("at")).withColumn("source", F.lit("send"))
    secrets = spark.createDataFrame([("p", "s", "hush")], "project_id string, name string, value string")
    out, state = (tempfile.mkdtemp(prefix="aq-") + "/o" for _ in range(2))
    ingest.ingest_history_batches(_stream(spark, rows), lambda: secrets, out, state).awaitTermination()
    back = history.read_history(spark, out)
    got = {r["id"]: r for r in back.collect()}
    assert set(got) == {1, 2} and "hush" not in str(got)
    assert got[2]["error"] == "bad ••••••" and got[2]["request"] == '{"d":1}'
    for wrong in (lambda: history.append_history(back, out), lambda: history.RedactedHistory()):
        try:
            wrong()
            raise AssertionError("unredacted rows were accepted")
        except TypeError:
            pass
    # another stream adds its rows, a batch written again replaces itself, and both share the log
    ingest.ingest_history_batches(_stream(spark, rows), lambda: secrets, out, tempfile.mkdtemp(prefix="aq-") + "/o").awaitTermination()
    more = history.RedactedHistory.of(history.history_rows(rows.withColumn("id", F.col("id") + 10)), secrets)
    history.append_history(more, out, "again")
    history.append_history(more, out, "again")
    assert sorted(r["id"] for r in history.read_history(spark, out).collect()) == [1, 1, 2, 2, 11, 12]
    history.clear_history(spark, out)
    assert history.read_history(spark, out).count() == 0
    history.append_history(more, out)
    assert history.read_history(spark, out).count() == 2


def test_every_query_is_registered_once():
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 100

import pytest
from pyspark.sql import functions as F

from apiquarry.operators import redact, requests, variables

VARS = [
    ("environment", "base", "http://h"), ("globals", "base", "http://global"), ("globals", "token", "plain"), ("secrets", "token", "s3cr3t"),
    ("secrets", "only", "hush"), ("environment", "url", "{{base}}/v1"), ("environment", "auth", "Bearer {{ secret:token }}"),
    ("environment", "loop", "{{loop2}}"), ("environment", "loop2", "x{{loop}}"), ("environment", "bad", "{{ok}}{{nope}}"), ("environment", "ok", "fine"),
    ("environment", "empty", "{{}}"), *[("environment", f"c{i}", "{{c%d}}" % (i + 1)) for i in range(40)], ("environment", "c40", "end"), ("environment", "two", "{{two}}{{two}}"), ("environment", "late", "{{ok}}{{two}}{{nope}}"), ("environment", "tail", "{{c30}}+{{c39}}+{{auth}}"),
    ("request_local", "local", "L"), ("environment", "local", "E"),
]


@pytest.fixture(scope="module")
def scope(spark):
    return spark.createDataFrame([("p", "dev", *v) for v in VARS], "project_id string, environment string, scope string, name string, value string")


@pytest.mark.parametrize(
    "text,value,secrets,error,name",
    [
        ("{{url}}/users", "http://h/v1/users", [], None, None),
        ("{{ token }}", "plain", [], None, None),
        ("{{secret:token}} {{only}}", "s3cr3t hush", ["only", "token"], None, None),
        ("{{auth}}", "Bearer s3cr3t", ["token"], None, None),
        ("{{local}}", "L", [], None, None),
        ("a {{open", "a {{open", [], None, None),
        ("{{}}", None, None, "empty_name", None),
        ("{{empty}}", None, None, "empty_name", None),
        ("{{gone}}", None, None, "undefined", "gone"),
        ("{{bad}}", None, None, "undefined", "nope"),
        ("{{ok}}{{loop}}", None, None, "cycle", "loop"),
        ("{{loop2}}", None, None, "cycle", "loop2"),
        ("{{c3}}", "end", [], None, None),
        ("{{c0}}", "end", [], None, None),
        ("{{two}}", None, None, "cycle", "two"),
        ("{{late}}", None, None, "cycle", "two"),
        ("{{tail}}", "end+end+Bearer s3cr3t", ["token"], None, None),
    ],
)
def test_resolve(spark, scope, text, value, secrets, error, name):
    texts = spark.createDataFrame([("p", "dev", text)], "project_id string, environment string, t string")
    r = variables.resolve_templates(texts, scope, "t").first()["resolved_text"]
    assert (r["value"], r["error"], r["error_name"]) == (value, error, name)
    if secrets is not None:
        assert r["secrets"] == secrets
    raw = texts.join(variables.scope_maps(scope), ["project_id", "environment"]).select(variables.expand(F.col("t"), F.col("scope")).alias("r")).first()["r"]
    assert (raw["value"], raw["error"], raw["error_name"]) == (value, error, name)


def test_undefined_missing_and_names(spark, scope):
    reqs = spark.createDataFrame([("p", "dev", 1, ["base", "x", "secret:token", "y"]), ("p", "dev", 2, ["base"])], "project_id string, environment string, id int, refs array<string>")
    assert [(r["id"], r["undefined"]) for r in variables.undefined_references(reqs, scope).collect()] == [(1, ["x", "y"])]
    expected = spark.createDataFrame([("p", "dev", "token"), ("p", "dev", "absent")], "project_id string, environment string, name string")
    got = variables.missing_secrets(expected, scope.filter("scope = 'secrets'")).collect()
    assert [r["name"] for r in got] == ["absent"]
    names = {r["name"] for r in variables.variable_names(scope).collect()}
    assert {"base", "token", "secret:token", "secret:only"} <= names and "only" not in names


def test_materialise(spark):
    kv = "array<struct<key:string,value:string,enabled:boolean,description:string>>"
    ddl = (
        f"id int, method string, url string, path_values map<string,string>, query {kv}, headers {kv}, cookies {kv}, "
        "auth struct<type:string,token:string,username:string,password:string,key:string,value:string,location:string>, "
        f"body struct<type:string,content:string,content_type:string,fields:{kv}>"
    )
    row = lambda k, v, on=True: (k, v, on, None)
    df = spark.createDataFrame(
        [
            (1, "POST", "http://h/u/{id}?a=1#f", {"id": "7"}, [row("q", "x y"), row("off", "1", False)], [row("X-A", "1"), row("X-B", "2"), row("x-a", "3"), row("Authorization", "old")],
             [row("c", "1")], ("bearer", "T", None, None, None, None, None), ("json", "{}", None, [])),
            (2, "HEAD", "http://h", {}, [], [], [], ("api_key", None, None, None, "k", "v&", "query"), ("form", None, None, [row("a", "b c")])),
            (3, "PUT", "http://h/{x}", {}, [], [], [], ("none", None, None, None, None, None, None), None),
            (4, "PUT", "http://h/p?", {}, [], [row("Content-Type", "text/csv")], [], ("basic", None, "u", "p", None, None, None), ("form", None, None, [row("a", "b c"), row("z", "1", False)])),
        ],
        ddl,
    )
    got = {r["id"]: r for r in requests.materialise(df).collect()}
    assert got[1]["wire_url"] == "http://h/u/7?a=1&q=x+y#f"
    assert [tuple(h) for h in got[1]["wire_headers"]] == [
        ("x-a", "1"), ("x-a", "3"), ("x-b", "2"), ("authorization", "Bearer T"), ("cookie", "c=1"), ("content-type", "application/json"),
    ]
    assert (got[2]["wire_url"], got[2]["wire_body"], got[2]["wire_headers"]) == ("http://h/?k=v%26", None, [])
    assert got[3]["wire_error"] == "unfilled_placeholder {x}" and got[3]["wire_url"] is None
    assert got[4]["wire_url"] == "http://h/p" and got[4]["wire_body"] == "a=b+c"
    assert [tuple(h) for h in got[4]["wire_headers"]] == [("content-type", "text/csv"), ("authorization", "Basic dTpw")]


def test_redaction_leaves_no_secret(spark, scope):
    secrets = scope.filter("scope = 'secrets'").select("project_id", "name", "value")
    h = spark.createDataFrame(
        [("p", 1, "http://h/?t=s3cr3t", "died at hush", '{"h":["s3cr3t"]}', '{"s3cr3t":{"n":1.0,"x":"a\\"hush"}}'), ("q", 2, "http://h/?t=s3cr3t", None, None, None)],
        "project_id string, id int, url string, error string, request string, response string",
    )
    rows = {r["id"]: r for r in redact.redact_history(h, secrets).collect()}
    assert not any(s in str(rows[1].asDict()) for s in ("s3cr3t", "hush"))
    assert rows[1]["response"] == '{"••••••":{"n":1.0,"x":"a\\"••••••"}}'
    assert rows[2]["url"].endswith("s3cr3t")


def test_masked_preview(spark):
    secrets = spark.createDataFrame([("p", "k", "secretvalue")], "project_id string, name string, value string")
    x = spark.createDataFrame(
        [
            ("p", 1, "http://h/secretvalue", [("A", "secretvalue")], '{"b":1,"a":"secretvalue"}', "application/json", 25),
            ("p", 2, "http://h", [], "éé plain", "text/plain", 10), ("p", 3, "http://h", [], None, "image/png", 99), ("p", 4, "http://h", [], None, None, 7),
        ],
        "project_id string, id int, url string, response_headers array<struct<name:string,value:string>>, body string, content_type string, body_bytes bigint",
    )
    got = {r["id"]: r for r in redact.masked_preview(x, secrets, 3).collect()}
    assert got[1]["preview"] == "{\n " and got[1]["preview_cut"] and got[1]["url"] == "http://h/{{secret:k}}"
    assert got[2]["preview"] == "é" and got[3]["preview"] == "<99 bytes of image/png>" and got[4]["preview"] == "<7 bytes of binary data>"
    whole = {r["id"]: r for r in redact.masked_preview(x, secrets, 1000).collect()}
    assert whole[1]["preview"] == '{\n  "a": "{{secret:k}}",\n  "b": 1\n}' and not whole[1]["preview_cut"]

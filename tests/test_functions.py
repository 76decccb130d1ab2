import pytest
from pyspark.sql import functions as F

from apiquarry.functions import http, jsonvalues, paths, text
from apiquarry.operators import warnings
from apiquarry.operators.attach import attach
from apiquarry.operators.json_paths import json_paths

c = F.col


@pytest.mark.parametrize(
    "raw,style,normal,shown",
    [
        ("/users/{user_id}", "braces", "/users/{}", "/users/{user_id}"),
        ("/users/{user_id:int}", "braces", "/users/{}", "/users/{user_id}"),
        ("/files/{rest:path}", "braces", "/files/{*}", "/files/{rest}"),
        ("/users/:id?", "colon", "/users/{}", "/users/{id}"),
        ("*", "colon", "/{*}", "/{wildcard}"),
        ("<int:user_id>", "angle", "/{}", "/{user_id}"),
        ("<path:rest>/x/", "angle", "/{*}/x", "/{rest}/x/"),
        ("docs/[...slug]", "bracket", "/docs/{*}", "/docs/{slug}"),
        ("[[...terms]]", "bracket", "/{*}", "/{terms}"),
        ("/", "braces", "/", "/"),
        ("/users/", "braces", "/users", "/users/"),
        ("/file-{id}.json", "braces", "/file-{id}.json", "/file-{id}.json"),
    ],
)
def test_parse_render_normalise(one, raw, style, normal, shown):
    got = one(F.array(paths.normalize_path(paths.parse_path(c("p"), style)), paths.render_path(paths.parse_path(c("p"), style))), p=raw)
    assert got == [normal, shown]


def test_join_and_styles(one):
    p = paths.parse_path(c("a"), "braces")
    q = paths.parse_path(c("b"), "braces")
    assert one(paths.render_path(paths.join_path(p, q)), a="/api/", b="/users") == "/api/users"
    assert one(paths.render_path(paths.join_path(p, q)), a="/api/", b="/") == "/api/"
    for style, want in [("colon", "/*/:id"), ("angle", "/<path:r>/<id>"), ("bracket", "/[...r]/[id]")]:
        assert one(paths.render_path(paths.parse_path(c("a"), "braces"), style), a="/{r:path}/{id}") == want


def test_type_hint(one):
    for raw, want in [("INT", "integer"), ("float", "number"), ("slug", "path"), ("DateTime", "date_time"), ("Thing", "thing")]:
        assert one(paths.type_hint(c("t")), t=raw) == want


def test_unresolved_and_confidence(spark):
    df = spark.range(1).select(paths.path_of(paths.unresolved("X.y"), paths.literal("stats")).alias("p"))
    row = df.select(
        paths.normalize_path(c("p")).alias("n"), paths.render_path(c("p")).alias("r"), paths.is_resolved(c("p")).alias("ok"),
        paths.unresolved_exprs(c("p")).alias("e"), paths.confidence(c("p"), F.lit("runtime"), F.lit(False)).alias("c"),
    ).first()
    assert row == ("/{?X.y}/stats", "/?/stats", False, ["X.y"], "low")


@pytest.mark.parametrize(
    "path,want",
    [
        ("user.id", ("42", None)),
        ("$.user.name", ("Ada", None)),
        ("items[0].name", ("x", None)),
        ("items[1]", ('{"a":1,"z":2}', None)),
        ('["odd key"]', ("1.0", None)),
        ("none", ("null", None)),
        ("missing", (None, None)),
        ("items[9]", (None, None)),
        ("items[x]", (None, "bad_path")),
        ("a..b", (None, "bad_path")),
        ("user.", (None, "bad_path")),
        ("flag", ("true", None)),
    ],
)
def test_json_path(one, path, want):
    body = '{"user":{"id":42,"name":"Ada"},"items":[{"name":"x"},{"z":2,"a":1}],"odd key":1.0,"none":null,"flag":true}'
    assert tuple(one(jsonvalues.json_path(c("b"), c("p")), b=body, p=path)) == want


def test_json_path_root_and_not_json(one):
    assert tuple(one(jsonvalues.json_path(c("b"), c("p")), b='{"b":1,"a":2}', p="$")) == ('{"a":2,"b":1}', None)
    assert tuple(one(jsonvalues.json_path(c("b"), c("p")), b="<html>", p="a")) == (None, "not_json")


@pytest.mark.parametrize(
    "op,actual,expected,want",
    [
        ("equals", "200", "200.0", True),
        ("equals", "200d", "200", False),
        ("equals", "abc", "abc", True),
        ("not_equals", "1", "2", True),
        ("contains", "hello", "ell", True),
        ("not_contains", "hello", "x", True),
        ("greater_than", "10", "9", True),
        ("greater_than", "10", "9a", False),
        ("less_than", " 9 ", "10", True),
        ("equals", "NaN", "nan", False),
        ("not_equals", "NaN", "nan", True),
        ("less_than", "-inf", "0", True),
        ("exists", "", "", True),
        ("not_exists", "", "", False),
        ("exists", None, "", False),
        ("not_exists", None, "", True),
        ("not_equals", None, "x", True),
        ("not_contains", None, "x", True),
        ("equals", None, "", False),
    ],
)
def test_holds(one, op, actual, expected, want):
    assert one(jsonvalues.holds(c("o"), c("a").cast("string"), c("e")), o=op, a=actual, e=expected) is want


def test_json_paths(spark):
    bodies = {
        1: '{"b": {"x y": 1}, "a":[1,"two",null,4.0],"2":true,"10":0,"e":{}, "s":"a\\"b\u00e9"}', 2: "not json", 3: None, 4: "7", 5: ' [[],[{"k":"{\\"no\\":1}"}]]',
        6: "{" + ",".join(f'"k{i}":[{i}]' for i in range(500)) + "}", 7: '{"a":1,"a":2}', 8: "[" + ",".join(map(str, range(50))) + "]", 9: '{"n":' * 16 + "1" + "}" * 16,
    }
    df = spark.createDataFrame(list(bodies.items()), "id int, body string")
    rows = {}
    for r in sorted(json_paths(df, "body", ["id"]).collect(), key=lambda r: r.place):
        rows.setdefault(r.id, []).append((r.path, r.preview, r.scalar, r.text))
    assert rows[1] == [
        ('["2"]', "true", True, "true"),
        ('["10"]', "0", True, "0"),
        ("b", "{1 key}", False, '{"x y":1}'),
        ('b["x y"]', "1", True, "1"),
        ("a", "[4 items]", False, '[1,"two",null,4.0]'),
        ("a[0]", "1", True, "1"),
        ("a[1]", '"two"', True, "two"),
        ("a[2]", "null", True, "null"),
        ("a[3]", "4.0", True, "4.0"),
        ("e", "{0 keys}", False, "{}"),
        ("s", '"a\\"b\u00e9"', True, 'a"b\u00e9'),
    ]
    assert not rows.keys() & {2, 3, 4, 7}
    assert [r[:3] for r in rows[5]] == [("[0]", "[0 items]", False), ("[1]", "[1 item]", False), ("[1][0]", "{1 key}", False), ("[1][0].k", '"{\\"no\\":1}"', True)]
    assert len(rows[6]) == 1000 and len(rows[8]) == 50 and len(rows[9]) == 16
    short = json_paths(df.filter("id > 5"), "body", ["id"], limit=400, sample=3, width=10)
    assert {r.id: r.n for r in short.groupBy("id").agg(F.count("*").alias("n")).collect()} == {6: 400, 8: 3, 9: 16}


def test_attach_moves_only_the_small_side(spark):
    log = spark.range(1000).selectExpr("IF(id % 10 = 0, 'cold', 'hot') AS project_id", "id", "map('a', id) AS m")
    small = spark.createDataFrame([("hot", 1), ("other", 2)], "project_id string, v int")
    for limit in (None, 0):
        got = attach(log, small, ["project_id"], limit)
        assert sorted((r.id, r.v) for r in got.collect()) == [(i, None if i % 10 == 0 else 1) for i in range(1000)]
    plan = attach(log, small, ["project_id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(project_id" not in plan and "BroadcastHashJoin" in plan


def test_warning_summary_with_one_noisy_project(spark):
    rows = [("hot", i, f"kind{i % 3}", f"w{i:05d}") for i in range(9000)] + [("cold", i, None, f"c{i}") for i in range(2)] + [("mute", 1, "k", None), ("hot", 0, "kind0", "w00000")]
    got = {r.project_id: r for r in warnings.summarise(spark.createDataFrame(rows, "project_id string, seq int, kind string, message string"), n=4).collect()}
    assert got["hot"].warnings == 9001 and [tuple(k) for k in got["hot"].kinds] == [("kind0", 3001), ("kind1", 3000), ("kind2", 3000)]
    assert got["hot"].examples == ["w00000", "w00000", "w00001", "w00002"]
    assert got["cold"].summary == "2 scan warning(s), e.g.: c0 | c1" and got["mute"].summary == "1 scan warning(s)"



def test_references(one):
    assert one(text.references(c("t")), t="{{a}}/{{ b }}/{{a}}{{}}{{open") == ["a", "b"]


def test_urls(one):
    assert one(http.path_of_url(c("u")), u="{{base}}/users/1?x=2") == "/users/1?x=2"
    assert one(http.path_of_url(c("u")), u="https://h.example/a") == "/a"
    assert one(http.path_of_url(c("u")), u="https://h.example") == "https://h.example"
    got = one(http.split_url_query(c("u")), u="https://h.example?a=1+2&b&c=%41#f")
    assert got["base"] == "https://h.example/#f"
    assert [(r["key"], r["value"]) for r in got["query"]] == [("a", "1 2"), ("b", ""), ("c", "A")]
    assert one(http.same_origin(c("a"), c("b")), a="http://h/x", b="http://H:80/y") is True
    assert one(http.same_origin(c("a"), c("b")), a="http://h/x", b="https://h/y") is False
    for u, want in [
        ("http://localhost:3000/", True), ("http://api.localhost/", True), ("http://127.9.9.9/", True), ("http://[::1]:8/", True),
        ("http://0.0.0.0/", True), ("http://[::ffff:127.0.0.1]/", True), ("http://localhost.evil.com/", False), ("http://10.0.0.1/", False),
    ]:
        assert one(http.is_loopback(c("u")), u=u) is want, u


def test_fill_path_values(spark):
    df = spark.createDataFrame([("/a/{id}/{x}", {"id": "7", "x": ""})], "u string, v map<string,string>")
    assert df.select(http.fill_path_values(c("u"), c("v")), http.unfilled_placeholder(http.fill_path_values(c("u"), c("v")))).first() == ("/a/7/{x}", "{x}")


@pytest.mark.parametrize(
    "name,want",
    [("get_current_user", "unknown"), ("jwt_auth", "bearer"), ("BasicAuth", "basic"), ("my_api_key", "api_key"), ("get_db", None)],
)
def test_auth_from_name(one, name, want):
    got = one(http.auth_from_name(c("n")), n=name)
    assert (got["type"] if got else None) == want


def test_auth_from_middleware(one):
    for name, want in [("requireAuth", "unknown"), ("jwtCheck", "bearer"), ("authRouter", None), ("cors", None), ("basicAuth", "basic")]:
        got = one(http.auth_from_middleware(c("n")), n=name)
        assert (got["type"] if got else None) == want, name


def test_masks(spark):
    df = spark.createDataFrame(
        [('{"to\\u006ben":"tok \\"q\\" x","n":1, "o":["abc", 1]}', [("b", 'tok "q"'), ("a", "token"), ("c", "1"), ("d", "")])],
        "j string, s array<struct<name:string,value:string>>",
    )
    assert df.select(text.mask_all_json(c("j"), c("s"))).first()[0] == '{"••••••":"•••••• x","n":1, "o":["abc", 1]}'
    nested = spark.createDataFrame([("x abab y ab", [("p", "ab"), ("q", "abab")])], "t string, s array<struct<name:string,value:string>>")
    assert nested.select(text.mask_named(c("t"), c("s"))).first()[0] == "x {{secret:q}} y {{secret:p}}"
    assert nested.select(text.mask_all(c("t"), c("s"))).first()[0] == "x •••••••••••• y ••••••"
    assert nested.select(text.mask_used(c("t"), c("s"), F.array(F.lit("q")))).first()[0] == "x •••••• y ab"


def test_cut_bytes(one):
    for n, want in [(0, ""), (1, "a"), (2, "a"), (3, "aé"), (5, "aé"), (6, "aé日"), (9, "aé日x")]:
        assert one(text.cut_bytes(c("t"), n), t="aé日x") == want


def test_masks_survive_long_strings_with_escapes(spark):
    long = 'say \\"hunter2\\" and \\\\ ' * 40_000 + "x" * 300_000
    df = spark.createDataFrame([('{"a":"' + long + '","n":[1,"hunter2"]}', [("s", "hunter2")])], "j string, s array<struct<name:string,value:string>>")
    got = df.select(text.mask_all_json(F.col("j"), F.col("s"))).first()[0]
    assert "hunter2" not in got and got.count(text.REDACTION) == 40_001 and len(got) > 900_000


def test_bodies_are_dealt_over_all_tasks(spark):
    df = spark.range(64, numPartitions=1).selectExpr("id", """concat('{"a":[{"v":', id, '}]}') AS body""")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = json_paths(df, "body", ["id"])
        assert got.count() == 192 and got.select("id", F.spark_partition_id().alias("p")).filter("id >= 0").select("p").distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

"""Queries on path templates, URLs, methods and other column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from apiquarry.functions import http, jsonvalues, paths, text
from apiquarry.operators.json_paths import json_paths as json_rows
from apiquarry.plans.base import EX, exchanges, query, table
from apiquarry.sources.files import file_routes
from apiquarry.operators.inventory import UNSPECIFIED_METHODS

c = F.col

# Templates in the four styles, by customer key.
RAW = """CASE c_custkey % 10
 WHEN 0 THEN concat('/u', c_custkey, '/{user_id:int}/') WHEN 1 THEN concat('/f', c_custkey, '/{rest:path}')
 WHEN 2 THEN concat('/a', c_custkey, '/:id?') WHEN 3 THEN '*' WHEN 4 THEN concat('/b', c_custkey, '/<int:user_id>/x')
 WHEN 5 THEN '<slug:page>' WHEN 6 THEN concat('docs/', c_custkey, '/[...slug]') WHEN 7 THEN '[[...terms]]/'
 WHEN 8 THEN '/' ELSE concat('//m', c_custkey, '//file-{id}.json') END"""


def templates(spark, sf):
    raw = table(spark, sf, "customer").selectExpr("c_custkey", f"{RAW} AS raw")
    style = c("c_custkey") % 10
    path = (
        F.when(style.isin(2, 3), paths.parse_path(c("raw"), "colon"))
        .when(style.isin(4, 5), paths.parse_path(c("raw"), "angle"))
        .when(style.isin(6, 7), paths.parse_path(c("raw"), "bracket"))
        .otherwise(paths.parse_path(c("raw"), "braces"))
    )
    return raw.select("c_custkey", "raw", path.alias("path"))


@query(
    "parse_path",
    """SELECT c_custkey, CASE WHEN c_custkey % 10 IN (3, 5, 7) THEN 1 WHEN c_custkey % 10 = 8 THEN 0 WHEN c_custkey % 10 IN (4, 6) THEN 3 ELSE 2 END AS segments,
 c_custkey % 10 IN (0, 7) AS trailing_slash,
 CASE c_custkey % 10 WHEN 0 THEN 'integer' WHEN 1 THEN 'path' WHEN 3 THEN 'path' WHEN 4 THEN 'integer' WHEN 5 THEN 'path' WHEN 6 THEN 'path' WHEN 7 THEN 'path' ELSE '' END AS types,
 c_custkey % 10 IN (1, 3, 5, 6, 7) AS catch_all, c_custkey % 10 IN (2, 7) AS optional FROM customer""",
)
def parse_path(spark, sf):
    seg = c("path.segments")
    return templates(spark, sf).select(
        "c_custkey",
        F.size(seg).alias("segments"),
        c("path.trailing_slash").alias("trailing_slash"),
        F.array_join(F.transform(seg, lambda s: s["ty"]), ",").alias("types"),
        F.exists(seg, lambda s: F.coalesce(s["catch_all"], F.lit(False))).alias("catch_all"),
        F.exists(seg, lambda s: F.coalesce(s["optional"], F.lit(False))).alias("optional"),
    )


@query(
    "type_hint",
    """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'integer' WHEN 1 THEN 'string' WHEN 2 THEN 'number' WHEN 3 THEN 'boolean' WHEN 4 THEN 'uuid'
 WHEN 5 THEN 'path' WHEN 6 THEN 'date_time' ELSE lower(p_type) END AS hint FROM part""",
)
def type_hint(spark, sf):
    raw = F.expr(
        "CASE p_partkey % 8 WHEN 0 THEN ' INT ' WHEN 1 THEN 'Str' WHEN 2 THEN 'decimal' WHEN 3 THEN 'bool' WHEN 4 THEN 'UUID' "
        "WHEN 5 THEN 'slug' WHEN 6 THEN 'datetime' ELSE p_type END"
    )
    return table(spark, sf, "part").select("p_partkey", paths.type_hint(raw).alias("hint"))


@query(
    "join_path",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '/api/v' || c_custkey || '/users' WHEN 1 THEN '/api/v' || c_custkey || '/users/'
 WHEN 2 THEN '/api/v' || c_custkey || '/' ELSE '/users/{id}' END AS joined FROM customer""",
)
def join_path(spark, sf):
    df = table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "CASE WHEN c_custkey % 4 = 3 THEN '' ELSE concat('/api/v', c_custkey, '/') END AS parent",
        "CASE c_custkey % 4 WHEN 0 THEN '/users' WHEN 1 THEN '/users/' WHEN 2 THEN '/' ELSE 'users/{id}' END AS child",
    )
    both = paths.join_path(paths.parse_path(c("parent"), "braces"), paths.parse_path(c("child"), "braces"))
    return df.select("c_custkey", paths.render_path(both).alias("joined"))


@query(
    "render_path",
    """SELECT c_custkey,
 CASE c_custkey % 10 WHEN 0 THEN '/u' || c_custkey || '/{user_id}/' WHEN 1 THEN '/f' || c_custkey || '/{rest}' WHEN 2 THEN '/a' || c_custkey || '/{id}' WHEN 3 THEN '/{wildcard}'
  WHEN 4 THEN '/b' || c_custkey || '/{user_id}/x' WHEN 5 THEN '/{page}' WHEN 6 THEN '/docs/' || c_custkey || '/{slug}' WHEN 7 THEN '/{terms}/' WHEN 8 THEN '/' ELSE '/m' || c_custkey || '/file-{id}.json' END AS braces,
 CASE c_custkey % 10 WHEN 0 THEN '/u' || c_custkey || '/:user_id/' WHEN 1 THEN '/f' || c_custkey || '/*' WHEN 2 THEN '/a' || c_custkey || '/:id?' WHEN 3 THEN '/*'
  WHEN 4 THEN '/b' || c_custkey || '/:user_id/x' WHEN 5 THEN '/*' WHEN 6 THEN '/docs/' || c_custkey || '/*' WHEN 7 THEN '/*/' WHEN 8 THEN '/' ELSE '/m' || c_custkey || '/file-{id}.json' END AS colon,
 CASE c_custkey % 10 WHEN 0 THEN '/u' || c_custkey || '/<user_id>/' WHEN 1 THEN '/f' || c_custkey || '/<path:rest>' WHEN 2 THEN '/a' || c_custkey || '/<id>' WHEN 3 THEN '/<path:wildcard>'
  WHEN 4 THEN '/b' || c_custkey || '/<user_id>/x' WHEN 5 THEN '/<path:page>' WHEN 6 THEN '/docs/' || c_custkey || '/<path:slug>' WHEN 7 THEN '/<path:terms>/' WHEN 8 THEN '/' ELSE '/m' || c_custkey || '/file-{id}.json' END AS angle,
 CASE c_custkey % 10 WHEN 0 THEN '/u' || c_custkey || '/[user_id]/' WHEN 1 THEN '/f' || c_custkey || '/[...rest]' WHEN 2 THEN '/a' || c_custkey || '/[id]' WHEN 3 THEN '/[...wildcard]'
  WHEN 4 THEN '/b' || c_custkey || '/[user_id]/x' WHEN 5 THEN '/[...page]' WHEN 6 THEN '/docs/' || c_custkey || '/[...slug]' WHEN 7 THEN '/[[...terms]]/' WHEN 8 THEN '/' ELSE '/m' || c_custkey || '/file-{id}.json' END AS bracket
 FROM customer""",
)
def render_path(spark, sf):
    return templates(spark, sf).select("c_custkey", *[paths.render_path(c("path"), s).alias(s) for s in paths.STYLES])


@query(
    "normalize_path",
    """SELECT CASE c_custkey % 10 WHEN 0 THEN '/u' || c_custkey || '/{}' WHEN 1 THEN '/f' || c_custkey || '/{*}' WHEN 2 THEN '/a' || c_custkey || '/{}' WHEN 3 THEN '/{*}'
  WHEN 4 THEN '/b' || c_custkey || '/{}/x' WHEN 5 THEN '/{*}' WHEN 6 THEN '/docs/' || c_custkey || '/{*}' WHEN 7 THEN '/{*}' WHEN 8 THEN '/' ELSE '/m' || c_custkey || '/file-{id}.json' END AS normalized,
 count(*) AS templates FROM customer GROUP BY 1""",
)
def normalize_path(spark, sf):
    return templates(spark, sf).groupBy(paths.normalize_path(c("path")).alias("normalized")).agg(F.count("*").alias("templates"))


def gapped(spark, sf):
    """Templates of which a third has a segment that could not be worked out."""
    seg = [
        paths.literal("api"),
        F.when(c("s_suppkey") % 3 == 0, paths.unresolved(F.concat(F.lit("cfg."), c("s_name")))).otherwise(paths.literal(c("s_name"))),
        paths.param("id"),
    ]
    return table(spark, sf, "supplier").select(
        "s_suppkey", "s_nationkey", paths.path_of(*seg).alias("path"), F.expr("s_suppkey % 4 = 0").alias("orphaned"),
        F.expr("CASE s_suppkey % 5 WHEN 0 THEN 'runtime' WHEN 1 THEN 'openapi' ELSE 'static_scan' END").alias("origin"),
    )


@query(
    "path_facts",
    """SELECT s_suppkey, s_suppkey % 3 <> 0 AS resolved, CASE WHEN s_suppkey % 3 = 0 THEN 'cfg.' || s_name ELSE '' END AS exprs, 'id' AS params FROM supplier""",
)
def path_facts(spark, sf):
    p = c("path")
    return gapped(spark, sf).select(
        "s_suppkey", paths.is_resolved(p).alias("resolved"), F.array_join(paths.unresolved_exprs(p), ",").alias("exprs"),
        F.array_join(paths.param_names(p), ",").alias("params"),
    )


@query(
    "endpoint_id",
    """SELECT s_suppkey, 'GET /api/' || CASE WHEN s_suppkey % 3 = 0 THEN '{?cfg.' || s_name || '}' ELSE s_name END || '/{}' AS id,
 'GET /api/' || CASE WHEN s_suppkey % 3 = 0 THEN '?' ELSE s_name END || '/{id}' AS display, (s_suppkey % 3 = 0 OR s_suppkey % 4 = 0) AS gaps FROM supplier""",
)
def endpoint_id(spark, sf):
    get, p = F.lit("GET"), c("path")
    return gapped(spark, sf).select(
        "s_suppkey", paths.endpoint_id(get, p).alias("id"), paths.display(get, p).alias("display"), paths.has_gaps(p, c("orphaned")).alias("gaps")
    )


@query(
    "confidence",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'low' WHEN s_suppkey % 5 IN (0, 1) THEN 'high' WHEN s_suppkey % 4 = 0 THEN 'low' ELSE 'medium' END AS confidence FROM supplier""",
)
def confidence(spark, sf):
    return gapped(spark, sf).select("s_suppkey", paths.confidence(c("path"), c("origin"), c("orphaned")).alias("confidence"))


@query(
    "seed_path_params",
    """SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN 'user_id' WHEN 1 THEN 'rest' WHEN 2 THEN 'id' WHEN 3 THEN 'wildcard' WHEN 4 THEN 'user_id' WHEN 5 THEN 'page' WHEN 6 THEN 'slug' ELSE 'terms' END AS name, TRUE AS required
 FROM customer WHERE c_custkey % 10 < 8""",
)
def seed_path_params(spark, sf):
    return templates(spark, sf).select("c_custkey", F.explode(paths.seed_path_params(c("path"))).alias("p")).select(
        "c_custkey", "p.name", "p.required"
    )


@query(
    "fill_path_values",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '/c/{cust}/o/' || o_orderkey ELSE '/c/' || o_custkey || '/o/' || o_orderkey END AS url,
 CASE WHEN o_orderkey % 3 = 0 THEN '{cust}' END AS unfilled FROM orders""",
)
def fill_path_values(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "'/c/{cust}/o/{order}' AS template",
        "map('order', CAST(o_orderkey AS STRING), 'cust', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END) AS vals",
    )
    filled = http.fill_path_values(c("template"), c("vals"))
    return df.select("o_orderkey", filled.alias("url"), http.unfilled_placeholder(filled).alias("unfilled"))


@query(
    "split_url_query",
    """WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '#') > 0 THEN substr(url, instr(url, '#')) ELSE '' END AS frag, split_part(url, '#', 1) AS bare FROM pages),
 q AS (SELECT page_id, split_part(bare, '?', 1) || frag AS base, CASE WHEN instr(bare, '?') > 0 THEN substr(bare, instr(bare, '?') + 1) END AS query FROM u)
 SELECT page_id, base, coalesce(array_to_string(list_transform(string_split(query, '&'), lambda p: replace(url_decode(split_part(p, '=', 1)), '+', ' ') || '>' || replace(url_decode(substr(p, instr(p, '=') + 1)), '+', ' ')), ';'), '') AS rows_ FROM q""",
)
def split_url_query(spark, sf):
    s = http.split_url_query(c("url"))
    rows = F.transform(c("s.query"), lambda q: F.concat(q["key"], F.lit(">"), q["value"]))
    return table(spark, sf, "pages").select("page_id", s.alias("s")).select(
        "page_id", c("s.base").alias("base"), F.array_join(rows, ";").alias("rows_")
    )


@query(
    "path_of_url",
    r"""SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path, CASE page_id % 3 WHEN 0 THEN '/x/' || page_id WHEN 1 THEN 'https://h' ELSE '/' END AS other FROM pages""",
)
def path_of_url(spark, sf):
    other = F.expr("CASE page_id % 3 WHEN 0 THEN concat('{{base}}/x/', page_id) WHEN 1 THEN 'https://h' ELSE '' END")
    return table(spark, sf, "pages").select("page_id", http.path_of_url(c("url")).alias("path"), http.path_of_url(other).alias("other"))


@query(
    "status_class",
    f"""WITH {EX} SELECT id, status BETWEEN 200 AND 299 AS success, status BETWEEN 300 AND 399 AS redirect, status >= 400 AS error, coalesce(status BETWEEN 200 AND 399, FALSE) AS succeeded FROM ex""",
)
def status_class(spark, sf):
    s = c("status")
    return exchanges(spark, sf).select(
        "id", http.is_success(s).alias("success"), http.is_redirect(s).alias("redirect"), http.is_error(s).alias("error"), http.succeeded(s).alias("succeeded")
    )


def with_headers(spark, sf):
    """Exchanges with response headers; names differ in case and repeat."""
    return exchanges(spark, sf).withColumn(
        "response_headers",
        F.expr(
            "array(named_struct('name', 'Content-Type', 'value', 'application/json'), named_struct('name', 'X-Id', 'value', CAST(id AS STRING)), "
            "named_struct('name', 'x-id', 'value', 'second'), named_struct('name', CASE WHEN k % 2 = 0 THEN 'Set-Cookie' ELSE 'Authorization' END, 'value', concat('s', k)))"
        ),
    )


@query("header_value", f"""WITH {EX} SELECT id, CAST(id AS VARCHAR) AS x_id, CASE WHEN k % 2 = 0 THEN 's' || k END AS cookie, CAST(NULL AS VARCHAR) AS absent FROM ex""")
def header_value(spark, sf):
    h = c("response_headers")
    return with_headers(spark, sf).select(
        "id", http.header_value(h, "X-ID").alias("x_id"), http.header_value(h, "set-cookie").alias("cookie"), http.header_value(h, "nope").alias("absent")
    )


@query(
    "response_headers",
    f"""WITH {EX} SELECT CASE WHEN k % 2 = 0 THEN 'content-type,set-cookie,x-id' ELSE 'authorization,content-type,x-id' END AS names, count(*) AS exchanges FROM ex GROUP BY 1""",
)
def response_headers(spark, sf):
    return with_headers(spark, sf).groupBy(F.array_join(http.header_names(c("response_headers")), ",").alias("names")).agg(F.count("*").alias("exchanges"))


@query(
    "sanitise_headers",
    f"""WITH {EX} SELECT id, 'application/json|' || id || '|second|[redacted]' AS shown FROM ex""",
)
def sanitise_headers(spark, sf):
    clean = text.sanitise_headers(c("response_headers"))
    return with_headers(spark, sf).select("id", F.array_join(F.transform(clean, lambda h: h["value"]), "|").alias("shown"))


BODY = (
    "concat('{\"id\":', o_orderkey, ',\"cust\":{\"key\":', o_custkey, ',\"tags\":[\"', o_orderstatus, '\",\"z\"],\"none\":null},\"odd key\":\"', o_orderpriority, '\"}')"
)


@query(
    "json_path",
    """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN o_orderstatus WHEN 3 THEN o_orderpriority
 WHEN 4 THEN 'null' WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN '{"key":' || o_custkey || ',"none":null,"tags":["' || o_orderstatus || '","z"]}' ELSE NULL END AS value,
 CASE o_orderkey % 9 WHEN 6 THEN 'bad_path' WHEN 8 THEN 'not_json' END AS error FROM orders""",
)
def json_path(spark, sf):
    path = (
        "CASE o_orderkey % 9 WHEN 0 THEN '$.id' WHEN 1 THEN 'cust.key' WHEN 2 THEN 'cust.tags[0]' WHEN 3 THEN '[\"odd key\"]' WHEN 4 THEN 'cust.none' "
        "WHEN 5 THEN 'cust.tags[7].x' WHEN 6 THEN 'cust.[0]' WHEN 7 THEN 'cust' ELSE 'id' END"
    )
    df = table(spark, sf, "orders").selectExpr("o_orderkey", f"CASE WHEN o_orderkey % 9 = 8 THEN 'x' ELSE {BODY} END AS body", f"{path} AS path")
    return df.withColumn("v", jsonvalues.json_path(c("body"), c("path"))).select("o_orderkey", "v.value", "v.error")


@query(
    "extract_value",
    f"""WITH {EX} SELECT id, CASE id % 5 WHEN 0 THEN CAST(status AS VARCHAR) WHEN 1 THEN CAST(total_ms AS VARCHAR) WHEN 2 THEN CAST(id AS VARCHAR) WHEN 3 THEN CAST(k AS VARCHAR) ELSE body END AS value FROM ex""",
)
def extract_value(spark, sf):
    source = F.expr("CASE id % 5 WHEN 0 THEN 'status' WHEN 1 THEN 'duration' WHEN 2 THEN 'header' WHEN 3 THEN 'body' ELSE 'body_text' END")
    v = jsonvalues.extract_value(source, F.lit("x-id"), F.lit("k"), c("status"), c("total_ms"), c("response_headers"), c("body"))
    return with_headers(spark, sf).withColumn("v", v).select("id", "v.value")


@query(
    "holds",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS q, CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN 'equals' WHEN 1 THEN 'not_equals' WHEN 2 THEN 'contains' WHEN 3 THEN 'not_contains'
  WHEN 4 THEN 'exists' WHEN 5 THEN 'not_exists' WHEN 6 THEN 'greater_than' ELSE 'less_than' END AS op, CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS kind FROM lineitem)
 SELECT op, kind, count(*) AS steps, count(*) FILTER (WHERE CASE kind
   WHEN 0 THEN op IN ('not_exists', 'not_equals', 'not_contains')
   WHEN 1 THEN CASE op WHEN 'equals' THEN q = 25 WHEN 'not_equals' THEN q <> 25 WHEN 'contains' THEN CAST(q AS VARCHAR) || '.0' LIKE '%25%' WHEN 'not_contains' THEN NOT CAST(q AS VARCHAR) || '.0' LIKE '%25%'
     WHEN 'exists' THEN TRUE WHEN 'not_exists' THEN FALSE WHEN 'greater_than' THEN q > 25 ELSE q < 25 END
   WHEN 2 THEN CASE op WHEN 'equals' THEN FALSE WHEN 'not_equals' THEN TRUE WHEN 'contains' THEN CAST(q AS VARCHAR) || 'd' LIKE '%25%' WHEN 'not_contains' THEN NOT CAST(q AS VARCHAR) || 'd' LIKE '%25%'
     WHEN 'exists' THEN TRUE WHEN 'not_exists' THEN FALSE WHEN 'greater_than' THEN CAST(q AS VARCHAR) || 'd' > '25' ELSE CAST(q AS VARCHAR) || 'd' < '25' END
   ELSE op IN ('not_equals', 'not_contains', 'exists') END) AS held FROM t GROUP BY op, kind""",
)
def holds(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN 'equals' WHEN 1 THEN 'not_equals' WHEN 2 THEN 'contains' WHEN 3 THEN 'not_contains' "
        "WHEN 4 THEN 'exists' WHEN 5 THEN 'not_exists' WHEN 6 THEN 'greater_than' ELSE 'less_than' END AS op",
        "CAST(l_partkey % 4 AS INT) AS kind",
        "CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat(CAST(l_quantity AS INT), '.0') WHEN 2 THEN concat(CAST(l_quantity AS INT), 'd') ELSE 'NaN' END AS actual",
        "CASE WHEN l_partkey % 4 = 3 THEN 'nan' ELSE '25' END AS expected",
    )
    return df.withColumn("h", jsonvalues.holds(c("op"), c("actual"), c("expected"))).groupBy("op", "kind").agg(
        F.count("*").alias("steps"), F.count_if("h").alias("held")
    )


NAMES = "CASE {k} % 8 WHEN 0 THEN 'get_current_user' WHEN 1 THEN 'oauth2_scheme' WHEN 2 THEN 'BasicAuth' WHEN 3 THEN 'my_api_key' WHEN 4 THEN 'get_db' WHEN 5 THEN 'requireAuth' WHEN 6 THEN 'jwtRouter' ELSE 'jwtCheck' END"


@query(
    "auth_from_name",
    """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'unknown' WHEN 1 THEN 'bearer' WHEN 2 THEN 'basic' WHEN 3 THEN 'api_key' WHEN 4 THEN NULL WHEN 5 THEN 'unknown' ELSE 'bearer' END AS by_name,
 CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' WHEN 2 THEN 'basic' WHEN 5 THEN 'unknown' WHEN 7 THEN 'bearer' END AS by_middleware FROM customer""",
)
def auth_from_name(spark, sf):
    n = F.expr(NAMES.format(k="c_custkey"))
    return table(spark, sf, "customer").select(
        "c_custkey", http.auth_from_name(n)["type"].alias("by_name"), http.auth_from_middleware(n)["type"].alias("by_middleware")
    )


@query(
    "references",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || ',' || lang WHEN 1 THEN lang ELSE '' END AS names FROM documents""",
)
def references(spark, sf):
    t = F.expr(
        "concat(CASE doc_id % 3 WHEN 0 THEN concat('{{ ', source, ' }}/{{', lang, '}}/{{', source, '}}') WHEN 1 THEN concat('{{}}{{', lang, '}}') ELSE '' END, text, '{{open')"
    )
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.references(t), ",").alias("names"))


@query(
    "request_references",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'base,v1,v2,on,tok,body' ELSE 'base,v1,v2,tok,body' END AS names FROM orders""",
)
def request_references(spark, sf):
    row = "named_struct('key', '{0}', 'value', '{1}', 'enabled', {2}, 'description', CAST(NULL AS STRING))"
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "'{{base}}/{id}/{x}' AS url", "map('x', '{{v2}}', 'id', '{{v1}}{{base}}') AS path_values",
        "array(" + row.format("a", "{{on}}", "o_orderkey % 2 = 0") + ", " + row.format("{{off}}", "b", "false") + ") AS query",
    )
    names = text.request_references(c("url"), c("path_values"), [c("query")], [F.lit("Bearer {{tok}}"), F.lit('{"a":"{{body}}{{v1}}"}')])
    return df.select("o_orderkey", F.array_join(names, ",").alias("names"))


@query(
    "file_route",
    """WITH t AS (SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN 'apps/web/src/app/api/(admin)/u' || p_partkey || '/[id]/route.ts' WHEN 1 THEN 'app/@slot/(.)photos/[...slug]/route.js'
  WHEN 2 THEN 'pages/api/v' || p_partkey || '/index.ts' WHEN 3 THEN 'src/pages/api/[[...rest]].js' END AS file FROM part)
 SELECT file, CASE k % 7 WHEN 0 THEN 'apps/web' ELSE '.' END AS root, CASE k % 7 WHEN 0 THEN 'u' || k WHEN 1 THEN 'photos' WHEN 2 THEN 'v' || k END AS grp,
  m || CASE k % 7 WHEN 0 THEN ' /api/u' || k || '/{id}' WHEN 1 THEN ' /photos/{slug}' WHEN 2 THEN ' /api/v' || k ELSE ' /api/{rest}' END AS route
 FROM t, LATERAL (SELECT unnest(CASE WHEN k % 7 IN (0, 1) THEN ['GET'] WHEN k % 7 = 2 THEN ['GET', 'POST', 'PUT', 'PATCH', 'DELETE'] WHEN k % 7 = 3 THEN ['POST'] END) AS m) WHERE file IS NOT NULL""",
)
def file_route(spark, sf):
    path = (
        "CASE p_partkey % 7 WHEN 0 THEN concat('apps/web/src/app/api/(admin)/u', p_partkey, '/[id]/route.ts') WHEN 1 THEN 'app/@slot/(.)photos/[...slug]/route.js' "
        "WHEN 2 THEN concat('pages/api/v', p_partkey, '/index.ts') WHEN 3 THEN 'src/pages/api/[[...rest]].js' WHEN 4 THEN 'app/_private/x/route.ts' "
        "WHEN 5 THEN 'pages/api/types.d.ts' ELSE concat('lib/', p_name, '.ts') END"
    )
    files = table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS project_id", f"{path} AS path", "'' AS content")
    exports = table(spark, sf, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS project_id", f"{path} AS path",
        "CASE p_partkey % 7 WHEN 0 THEN array('GET') WHEN 1 THEN array('GET') WHEN 3 THEN array('POST') ELSE CAST(array() AS array<string>) END AS methods",
    )
    return file_routes(files, exports, UNSPECIFIED_METHODS).select(
        "file", "root", c("group").alias("grp"), paths.display(c("method"), c("path")).alias("route")
    )


@query("enabled_rows", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ',' || o_orderstatus ELSE o_orderstatus END AS kept FROM orders""")
def enabled_rows(spark, sf):
    rows = F.expr(
        "array(named_struct('key', 'p', 'value', o_orderpriority, 'enabled', o_orderkey % 2 = 0), named_struct('key', 's', 'value', o_orderstatus, 'enabled', true))"
    )
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(F.transform(http.enabled_rows(rows), lambda r: r["value"]), ",").alias("kept"))


@query(
    "is_loopback",
    """SELECT page_id, url, FALSE AS loopback, page_id % 6 < 5 AS other FROM pages""",
)
def is_loopback(spark, sf):
    other = F.expr(
        "CASE page_id % 6 WHEN 0 THEN 'http://LOCALHOST:3000/a' WHEN 1 THEN 'http://127.0.0.9' WHEN 2 THEN 'http://[::1]:80/' WHEN 3 THEN 'https://api.localhost/' "
        "WHEN 4 THEN 'http://0.0.0.0:8000/' ELSE 'http://localhost.example.com/' END"
    )
    return table(spark, sf, "pages").select("page_id", "url", http.is_loopback(c("url")).alias("loopback"), http.is_loopback(other).alias("other"))


@query(
    "same_origin",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE ELSE FALSE END AS same FROM pages""",
)
def same_origin(spark, sf):
    host = "regexp_extract(url, '://([^/?#]+)', 1)"
    other = F.expr(
        f"CASE page_id % 4 WHEN 0 THEN concat(substring_index(url, ':', 1), '://', upper({host}), '/other?x=1') "
        f"WHEN 1 THEN concat(substring_index(url, ':', 1), '://', {host}, CASE WHEN url LIKE 'https%' THEN ':443' ELSE ':80' END) "
        f"WHEN 2 THEN concat(substring_index(url, ':', 1), '://', {host}, ':8443/') ELSE concat(substring_index(url, ':', 1), '://x.', {host}) END"
    )
    return table(spark, sf, "pages").select("page_id", http.same_origin(c("url"), other).alias("same"))


@query(
    "method_predicates",
    f"""WITH {EX} SELECT method, method = 'GET' AS safe, method IN ('GET', 'PUT', 'DELETE') AS idempotent, method IN ('POST', 'PUT', 'PATCH') AS has_body, count(*) AS exchanges FROM ex GROUP BY 1""",
)
def method_predicates(spark, sf):
    m = c("method")
    return exchanges(spark, sf).groupBy(
        "method", http.is_safe(m).alias("safe"), http.is_idempotent(m).alias("idempotent"), http.conventionally_has_body(m).alias("has_body")
    ).agg(F.count("*").alias("exchanges"))


@query(
    "json_paths",
    """SELECT o_orderkey, u.path, u.preview, u.scalar FROM orders, LATERAL (SELECT unnest([
  {'path': 'id', 'preview': CAST(o_orderkey AS VARCHAR), 'scalar': TRUE}, {'path': 'cust', 'preview': '{3 keys}', 'scalar': FALSE}, {'path': 'cust.key', 'preview': CAST(o_custkey AS VARCHAR), 'scalar': TRUE},
  {'path': 'cust.tags', 'preview': '[2 items]', 'scalar': FALSE}, {'path': 'cust.tags[0]', 'preview': '"' || o_orderstatus || '"', 'scalar': TRUE}, {'path': 'cust.tags[1]', 'preview': '"z"', 'scalar': TRUE},
  {'path': 'cust.none', 'preview': 'null', 'scalar': TRUE}, {'path': '["odd key"]', 'preview': '"' || o_orderpriority || '"', 'scalar': TRUE}]) AS u)""",
)
def json_paths(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey", f"{BODY} AS body")
    return json_rows(df, "body", ["o_orderkey"]).select("o_orderkey", "path", "preview", "scalar")


@query(
    "json_paths_long",
    """WITH c AS (SELECT c_custkey AS k, 40 + c_custkey % 30 AS n FROM customer)
 SELECT k, 'rows' AS path, '[' || n || ' items]' AS preview FROM c
 UNION ALL SELECT k, 'rows[' || i || ']', '{1 key}' FROM c, LATERAL (SELECT unnest(range(n)) AS i)
 UNION ALL SELECT k, 'rows[' || i || '].v', CAST(k * i AS VARCHAR) FROM c, LATERAL (SELECT unnest(range(n)) AS i)
 UNION ALL SELECT k, 'deep' || repeat('.d', i), CASE WHEN i = 20 THEN '"' || repeat('x', 70) || '"' ELSE '{1 key}' END FROM c, LATERAL (SELECT unnest(range(21)) AS i)""",
)
def json_paths_long(spark, sf):
    """Arrays of many elements, and objects twenty deep: nothing is left out or cut."""
    df = table(spark, sf, "customer").selectExpr(
        "c_custkey AS k",
        "concat('{\"rows\":[', array_join(transform(sequence(0L, 39 + c_custkey % 30), i -> concat('{\"v\":', c_custkey * i, '}')), ','), '],\"deep\":', "
        "repeat('{\"d\":', 20), '\"', repeat('x', 70), '\"', repeat('}', 20), '}') AS body",
    )
    return json_rows(df, "body", ["k"]).select("k", "path", "preview")

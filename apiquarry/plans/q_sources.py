"""Queries on source trees, detection, OpenAPI documents, transcripts, collections, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from apiquarry.functions import paths
from apiquarry.functions.http import language_of
from apiquarry.operators import collections, detect
from apiquarry.plans.base import EX, exchanges, query, shared_folder, table
from apiquarry.sources import files, ignore, openapi, raw_http
from apiquarry.sources.history import RedactedHistory, append_history, clear_history, history_rows, read_history
from apiquarry.streaming import changes, ingest
from apiquarry.streaming import runs as live

c = F.col
P = "project_id"

TREE = "CASE doc_id % 6 WHEN 0 THEN concat('node_modules/x', doc_id, '.js') WHEN 1 THEN concat('app/tests/t', doc_id, '.py') WHEN 2 THEN concat('app/m', doc_id, '.py') WHEN 3 THEN concat('web/s', doc_id, '.ts') WHEN 4 THEN concat('svc/h', doc_id, '.go') ELSE concat('docs/d', doc_id, '.md') END"


def tree(spark, sf):
    """Documents as the files of a project per source; their text is the content."""
    return table(spark, sf, "documents").selectExpr("doc_id", "source AS project_id", f"{TREE} AS path", "text AS content")


SQL_TREE = """f AS (SELECT doc_id, source AS project_id, CASE doc_id % 6 WHEN 0 THEN 'node_modules/x' || doc_id || '.js' WHEN 1 THEN 'app/tests/t' || doc_id || '.py' WHEN 2 THEN 'app/m' || doc_id || '.py' WHEN 3 THEN 'web/s' || doc_id || '.ts' WHEN 4 THEN 'svc/h' || doc_id || '.go' ELSE 'docs/d' || doc_id || '.md' END AS path, text AS content FROM documents)"""


@query("read_source_files", f"WITH {SQL_TREE} SELECT project_id, path FROM f WHERE doc_id % 6 <> 0")
def read_source_files(spark, sf):
    return files.list_files(tree(spark, sf))[0].select(P, "path")


@query("source_files_report", f"WITH {SQL_TREE} SELECT project_id, count(*) FILTER (doc_id % 6 <> 0) AS files, count(*) FILTER (doc_id % 6 = 0) AS skipped FROM f GROUP BY 1")
def source_files_report(spark, sf):
    return files.list_files(tree(spark, sf))[1]


@query(
    "ignore_rules",
    f"""WITH {SQL_TREE} SELECT project_id, path FROM f WHERE project_id IS NULL OR NOT (path LIKE 'node_modules/%' OR path LIKE 'app/tests/%'
 OR (path LIKE 'docs/%' AND path NOT LIKE '%7.md') OR (path LIKE 'web/%' AND regexp_matches(path, '[13]\\.ts$') AND path NOT LIKE '%13.ts'))
 UNION ALL SELECT DISTINCT project_id, unnest(['.gitignore', 'web/.gitignore']) AS path FROM f""",
)
def ignore_rules(spark, sf):
    """Every project with two ignore files: names, folders, negation, and a folder that nothing re-includes."""
    own = tree(spark, sf).select(P, "path", "content")
    root = "# generated\\n*.md\\n!docs/d*7.md\\n/app/tests/\\nnode_modules\\n!node_modules/*.js"
    texts = F.expr(f"map('.gitignore', '{root}', 'web/.gitignore', 's*[13].ts\\n!**/s*13.ts')")
    rules = own.select(P).distinct().select(P, F.explode(texts).alias("path", "content"))
    return ignore.without_ignored(own.unionByName(rules)).select(P, "path")


@query("language_of", f"WITH {SQL_TREE} SELECT CASE doc_id % 6 WHEN 0 THEN 'javascript' WHEN 1 THEN 'python' WHEN 2 THEN 'python' WHEN 3 THEN 'typescript' WHEN 4 THEN 'go' END AS language, count(*) AS files FROM f GROUP BY 1")
def language(spark, sf):
    return tree(spark, sf).groupBy(language_of(c("path")).alias("language")).agg(F.count("*").alias("files"))


@query("languages", f"WITH {SQL_TREE} SELECT project_id, array_to_string(list_sort(list_distinct(list(CASE doc_id % 6 WHEN 0 THEN 'javascript' WHEN 1 THEN 'python' WHEN 2 THEN 'python' WHEN 3 THEN 'typescript' ELSE 'go' END))), ',') AS languages FROM f WHERE doc_id % 6 < 5 GROUP BY 1")
def languages(spark, sf):
    return files.languages(tree(spark, sf)).select(P, F.array_join("languages", ",").alias("languages"))


@query("pick_manifests", "SELECT 's' || (p_size % 5) AS project_id, CASE p_partkey % 3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'go.mod' ELSE 'Dockerfile' END AS name, arg_min(CASE p_partkey % 4 WHEN 0 THEN 'a/b/c' || p_partkey || '/' WHEN 1 THEN 'a/b' || p_partkey || '/' ELSE 'a/' || 'c' || p_partkey || '/d/' END || CASE p_partkey % 3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'go.mod' ELSE 'Dockerfile' END, (CASE p_partkey % 4 WHEN 1 THEN 3 ELSE 4 END, CASE p_partkey % 4 WHEN 0 THEN 'a/b/c' || p_partkey || '/' WHEN 1 THEN 'a/b' || p_partkey || '/' ELSE 'a/' || 'c' || p_partkey || '/d/' END || CASE p_partkey % 3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'go.mod' ELSE 'Dockerfile' END)) AS path FROM part GROUP BY 1, 2")
def pick_manifests(spark, sf):
    df = table(spark, sf, "part").selectExpr(
        "concat('s', p_size % 5) AS project_id",
        "concat(CASE p_partkey % 4 WHEN 0 THEN concat('a/b/c', p_partkey, '/') WHEN 1 THEN concat('a/b', p_partkey, '/') ELSE concat('a/c', p_partkey, '/d/') END, CASE p_partkey % 3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'go.mod' ELSE 'Dockerfile' END) AS path",
        "'' AS content",
    )
    return files.pick_manifests(df).select(P, "name", "path")


@query("candidate_files", f"WITH {SQL_TREE} SELECT 'fastapi' AS framework, path FROM f WHERE doc_id % 6 = 2 UNION ALL SELECT 'flask', path FROM f WHERE doc_id % 6 = 2 UNION ALL SELECT 'django', path FROM f WHERE doc_id % 6 = 2 AND regexp_matches(content, 'urlpatterns|ROOT_URLCONF|View|api_view|request|Router') UNION ALL SELECT 'express', path FROM f WHERE doc_id % 6 IN (0, 3) UNION ALL SELECT 'go', path FROM f WHERE doc_id % 6 = 4")
def candidate_files(spark, sf):
    return files.candidate_files(tree(spark, sf)).select("framework", "path")


@query(
    "detect_frameworks",
    f"""WITH {SQL_TREE}, x AS (SELECT project_id, doc_id % 12 AS t FROM f),
 r AS (SELECT project_id, 'flask' AS framework, 3 AS points FROM x WHERE t = 2 UNION SELECT project_id, 'django', 4 FROM x WHERE t = 8 UNION SELECT project_id, 'express', 3 FROM x WHERE t = 3 UNION SELECT project_id, 'go', 6 FROM x WHERE t = 4
  UNION SELECT DISTINCT project_id, 'flask', -1 FROM x UNION SELECT DISTINCT project_id, 'express', -2 FROM x)
 SELECT project_id, framework, sum(CASE WHEN points < 0 THEN 1 ELSE points END) AS score FROM r WHERE points > -9 GROUP BY 1, 2""",
)
def detect_frameworks(spark, sf):
    """Whole texts with import lines added by kind; each project also has two manifests."""
    lines = (
        "CASE doc_id % 12 WHEN 2 THEN '\\nfrom flask import Flask' WHEN 8 THEN '\\nimport django\\nrest_framework' WHEN 3 THEN '\\nimport e from \"express\"' "
        "WHEN 4 THEN '\\nimport \"github.com/go-chi/chi/v5\"\\nhttp.HandleFunc(\"/\", h)' ELSE '' END"
    )
    sources = tree(spark, sf).withColumn("content", F.concat("content", F.expr(lines)))
    projects = sources.select(P).distinct()
    manifests = projects.selectExpr(P, "'requirements.txt' AS name", "'requirements.txt' AS path", "'# fastapi\\nFlask==2' AS content").unionByName(
        projects.selectExpr(P, "'package.json' AS name", "'package.json' AS path", "'{\"dependencies\":{\"express\":\"1\"}}' AS content")
    )
    return detect.detect_frameworks(sources, manifests).select(P, "framework", "score")


@query("order_frameworks", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'go,fastapi,flask' ELSE 'fastapi,go,flask' END AS ranked FROM nation")
def order_frameworks(spark, sf):
    base = table(spark, sf, "nation")
    parts = [base.selectExpr("n_nationkey AS project_id", f"'{f}' AS framework", f"{s} AS score") for f, s in [("flask", "1"), ("go", "CASE WHEN n_nationkey % 2 = 0 THEN 5 ELSE 3 END"), ("fastapi", "3")]]
    ordered = detect.framework_order(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    rank = F.struct((-c("score")).alias("s"), F.array_position(F.array(*[F.lit(f) for f in detect.FRAMEWORKS]), c("framework")).alias("r"), "framework")
    return ordered.groupBy(c(P).alias("n_nationkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["framework"]), ",").alias("ranked"))


@query(
    "mine_ports",
    """SELECT s_suppkey, u.port, u.confidence FROM supplier, LATERAL (SELECT unnest(CASE s_suppkey % 3
 WHEN 0 THEN [{'port': 9000 + s_suppkey, 'confidence': 9}, {'port': 3000 + s_suppkey, 'confidence': 9}, {'port': 8000, 'confidence': 1}]
 WHEN 1 THEN [{'port': 7000 + s_suppkey, 'confidence': 7}, {'port': 3000 + s_suppkey, 'confidence': 8}, {'port': 8000, 'confidence': 1}]
 ELSE [{'port': 6000 + s_suppkey, 'confidence': 6}, {'port': 3000 + s_suppkey, 'confidence': 8}, {'port': 4000 + s_suppkey, 'confidence': 4}, {'port': 8000, 'confidence': 1}] END) AS u)""",
)
def mine_ports(spark, sf):
    base = table(spark, sf, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS project_id", "s_suppkey AS k")
    name = "CASE k % 3 WHEN 0 THEN 'Procfile' WHEN 1 THEN 'docker-compose.yml' ELSE '.env' END"
    content = (
        "CASE k % 3 WHEN 0 THEN concat('web: uvicorn app:app --port \"', 9000 + k, '\" --bind 0.0.0.0:', 3000 + k) WHEN 1 THEN concat('ports:\\n  - \"', 7000 + k, ':80\"\\n  - x') "
        "ELSE concat('# PORT=1\\nAPP_PORT=\"', 6000 + k, '\"\\nOTHER=5') END"
    )
    manifests = base.selectExpr(P, f"{name} AS name", f"{content} AS content").unionByName(
        base.filter("k % 3 = 2").selectExpr(P, "'Dockerfile' AS name", "concat('EXPOSE ', 4000 + k, '/tcp ', 3000 + k) AS content")
    )
    listens = base.filter("k % 3 <> 0").selectExpr(P, "k AS seq", "CAST(3000 + k AS INT) AS port", "'listen' AS seen_at")
    detected = base.limit(0).selectExpr(P, "'' AS framework", "1 AS score")
    got = detect.mine_ports(manifests, listens, detected)
    port = F.regexp_extract("url", r":(\d+)$", 1).cast("bigint")
    return got.select(c(P).cast("bigint").alias("s_suppkey"), port.alias("port"), "confidence")


def specs(spark, sf):
    """One OpenAPI document per supplier; some are Swagger 2.0, some refused."""
    three = (
        "concat('{\"openapi\":\"3.0.1\",\"info\":{\"title\":\"', s_name, '\",\"version\":\"1\"},\"servers\":[{\"url\":\"https://s', s_suppkey, '.example.com/\"},{\"url\":\"http://b\"}],"
        "\"security\":[{\"key\":[]}],\"components\":{\"securitySchemes\":{\"key\":{\"type\":\"apiKey\",\"name\":\"X-K\",\"in\":\"header\"},\"jwt\":{\"type\":\"http\",\"scheme\":\"Bearer\",\"bearerFormat\":\"JWT\"}},"
        "\"parameters\":{\"page\":{\"name\":\"page\",\"in\":\"query\",\"schema\":{\"type\":\"integer\",\"default\":', s_suppkey, '}}},"
        "\"schemas\":{\"Node\":{\"type\":\"object\",\"properties\":{\"id\":{\"type\":\"integer\"},\"kids\":{\"type\":\"array\",\"items\":{\"$ref\":\"#/components/schemas/Node\"}},\"tag\":{\"$ref\":\"#/components/schemas/Tag\"}}},\"Tag\":{\"type\":\"string\",\"enum\":[\"t', s_suppkey, '\",\"u\"]}}},"
        "\"paths\":{\"/n/{id}/{rest}\":{\"parameters\":[{\"name\":\"id\",\"in\":\"path\",\"required\":true,\"schema\":{\"type\":\"string\",\"format\":\"uuid\"}},{\"name\":\"rest\",\"in\":\"path\",\"schema\":{\"type\":\"string\",\"format\":\"path\"}},{\"$ref\":\"#/components/parameters/page\"}],"
        "\"get\":{\"operationId\":\"getN\",\"tags\":[\"nodes\",\"x\"],\"deprecated\":true,\"x-rate\":5,\"security\":[{\"jwt\":[]}],\"parameters\":[{\"name\":\"page\",\"in\":\"query\",\"schema\":{\"type\":\"number\"}}]},"
        "\"post\":{\"summary\":\"Make\",\"security\":[{\"gone\":[]}],\"requestBody\":{\"required\":true,\"content\":{\"text/plain\":{},\"application/json\":{\"schema\":{\"$ref\":\"#/components/schemas/Node\"}}}}}}}}')"
    )
    two = (
        "concat('{\"swagger\":\"2.0\",\"host\":\"h', s_suppkey, '.example.com\",\"basePath\":\"/v2\",\"schemes\":[\"http\",\"https\"],\"paths\":{\"/p\":{\"put\":{\"security\":[],\"parameters\":[{\"name\":\"b\",\"in\":\"body\",\"required\":true,\"schema\":{\"type\":\"object\",\"properties\":{\"n\":{\"type\":\"integer\",\"example\":', s_suppkey, '}}}},{\"name\":\"H\",\"in\":\"header\",\"type\":\"boolean\"}]}}}}')"
    )
    content = f"CASE s_suppkey % 4 WHEN 0 THEN {two} WHEN 1 THEN '{{\"openapi\":\"4.0\"}}' ELSE {three} END"
    docs = table(spark, sf, "supplier").selectExpr("concat('n', s_nationkey) AS project_id", "CAST(s_suppkey AS STRING) AS document", f"{content} AS content")
    return openapi.parse_documents(docs)


def operations(spark, sf):
    return openapi.openapi_endpoints(specs(spark, sf)).withColumn("k", c("document").cast("bigint"))


@query(
    "read_openapi",
    """SELECT s_suppkey AS k, 'PUT /p' AS id, '/p' AS path, NULL AS summary, NULL AS grp, NULL AS meta FROM supplier WHERE s_suppkey % 4 = 0
 UNION ALL SELECT s_suppkey, 'GET /n/{}/{}', '/n/{id}/{rest}', 'getN', 'nodes', 'deprecated=true;rate=5' FROM supplier WHERE s_suppkey % 4 > 1
 UNION ALL SELECT s_suppkey, 'POST /n/{}/{}', '/n/{id}/{rest}', 'Make', NULL, NULL FROM supplier WHERE s_suppkey % 4 > 1""",
)
def read_openapi(spark, sf):
    meta = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return operations(spark, sf).select("k", "id", paths.render_path(c("path")).alias("path"), "summary", c("group").alias("grp"), F.nullif(meta, F.lit("")).alias("meta"))


@query("openapi_warnings", "SELECT s_suppkey AS k, 'refused: unsupported_version' AS warning FROM supplier WHERE s_suppkey % 4 = 1")
def openapi_warnings(spark, sf):
    return openapi.openapi_warnings(specs(spark, sf)).select(c("document").cast("bigint").alias("k"), "warning")


@query("openapi_servers", """SELECT s_suppkey AS k, u.pos, u.url FROM supplier, LATERAL (SELECT unnest(CASE WHEN s_suppkey % 4 = 0 THEN [{'pos': 0, 'url': 'http://h' || s_suppkey || '.example.com/v2'}, {'pos': 1, 'url': 'https://h' || s_suppkey || '.example.com/v2'}] ELSE [{'pos': 0, 'url': 'https://s' || s_suppkey || '.example.com'}, {'pos': 1, 'url': 'http://b'}] END) AS u) WHERE s_suppkey % 4 <> 1""")
def openapi_servers(spark, sf):
    return openapi.openapi_servers(specs(spark, sf)).select(c("document").cast("bigint").alias("k"), "pos", "url")


@query(
    "openapi_params",
    """SELECT s_suppkey AS k, m AS method, CASE m WHEN 'PUT' THEN '' ELSE 'id:uuid:true,rest:path:false' END AS in_path, CASE m WHEN 'GET' THEN 'page:number:' WHEN 'POST' THEN 'page:integer:' || s_suppkey ELSE '' END AS in_query,
 CASE m WHEN 'PUT' THEN 'H:boolean' ELSE '' END AS in_header, m <> 'PUT' AS spread FROM supplier, LATERAL (SELECT unnest(CASE WHEN s_suppkey % 4 = 0 THEN ['PUT'] ELSE ['GET', 'POST'] END) AS m) WHERE s_suppkey % 4 <> 1""",
)
def openapi_params(spark, sf):
    def listed(column, *fields):
        return F.array_join(F.transform(column, lambda p: F.concat_ws(":", *[F.coalesce(p[f].cast("string"), F.lit("")) for f in fields])), ",")

    return operations(spark, sf).select(
        "k", "method", listed("path_params", "name", "ty", "required").alias("in_path"), listed("query_params", "name", "ty", "default_json").alias("in_query"),
        listed("headers", "name", "ty").alias("in_header"), F.exists("path.segments", lambda s: F.coalesce(s["catch_all"], F.lit(False))).alias("spread"),
    )


@query(
    "openapi_body",
    """SELECT s_suppkey AS k, method, 'application/json' AS content_type, TRUE AS required, example FROM (SELECT s_suppkey, 'PUT' AS method, '{"n":' || s_suppkey || '}' AS example FROM supplier WHERE s_suppkey % 4 = 0
 UNION ALL SELECT s_suppkey, 'POST', '{"id":0,"kids":[null],"tag":"t' || s_suppkey || '"}' FROM supplier WHERE s_suppkey % 4 > 1)""",
)
def openapi_body(spark, sf):
    return operations(spark, sf).filter("body is not null").select("k", "method", "body.content_type", "body.required", c("body.example_json").alias("example"))


@query(
    "openapi_auth",
    """SELECT s_suppkey AS k, m AS method, CASE m WHEN 'GET' THEN 'bearer' WHEN 'POST' THEN 'unknown' END AS type, CASE m WHEN 'GET' THEN 'JWT' WHEN 'POST' THEN 'gone' END AS detail
 FROM supplier, LATERAL (SELECT unnest(CASE WHEN s_suppkey % 4 = 0 THEN ['PUT'] ELSE ['GET', 'POST'] END) AS m) WHERE s_suppkey % 4 <> 1""",
)
def openapi_auth(spark, sf):
    return operations(spark, sf).select("k", "method", "auth.type", F.coalesce("auth.format", "auth.hint").alias("detail"))


@query("resolve_local_refs", """SELECT s_suppkey AS k, '{"properties":{"id":{"type":"integer"},"kids":{"items":{},"type":"array"},"tag":{"enum":["t' || s_suppkey || '","u"],"type":"string"}},"type":"object"}' AS schema_json FROM supplier WHERE s_suppkey % 4 > 1""")
def resolve_local_refs(spark, sf):
    return operations(spark, sf).filter("method = 'POST'").select("k", c("body.schema_json").alias("schema_json"))


@query(
    "resolve_deep_refs",
    """SELECT s_suppkey AS k, '{"properties":{"id":{"enum":[' || s_suppkey || ']},"self":{}},"type":"object"}' AS schema_json, '{"id":' || s_suppkey || ',"self":null}' AS example_json FROM supplier""",
)
def resolve_deep_refs(spark, sf):
    """Chains of sixteen references with nested members beside each, and a circle at their end."""
    ref = "'{\"$ref\":\"#/components/schemas/C'"
    chain = f"array_join(transform(sequence(0, 15), i -> concat('\"C', i, '\":', {ref}, i + 1, '\",\"x-a\":{{\"b\":{{\"c\":[', i, ']}}}}}}')), ',')"
    raw = table(spark, sf, "supplier").selectExpr(
        "concat('n', s_nationkey) AS project_id", "CAST(s_suppkey AS STRING) AS document",
        "concat('{\"openapi\":\"3.0.0\",\"paths\":{\"/p\":{\"post\":{\"requestBody\":{\"content\":{\"application/json\":{\"schema\":', " + ref + ", '0\"}}}}}}},\"components\":{\"schemas\":{', "
        + chain + ", ',\"C16\":{\"type\":\"object\",\"properties\":{\"id\":{\"enum\":[', s_suppkey, ']},\"self\":', " + ref + ", '3\"}}}}}}') AS content",
    )
    got = openapi.openapi_endpoints(openapi.parse_documents(raw))
    return got.select(c("document").cast("bigint").alias("k"), c("body.schema_json").alias("schema_json"), c("body.example_json").alias("example_json"))


@query(
    "requests_from_openapi",
    """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'http://h' || s_suppkey || '.example.com/v2' ELSE 'https://s' || s_suppkey || '.example.com' END AS base_url, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 2 END AS requests FROM supplier WHERE s_suppkey % 4 <> 1""",
)
def requests_from_openapi(spark, sf):
    servers = openapi.openapi_servers(specs(spark, sf))
    return collections.requests_from_openapi(operations(spark, sf), servers).groupBy("k", "base_url").agg(F.count("*").alias("requests"))


@query(
    "read_raw_http",
    f"""WITH {EX} SELECT id, method, CASE WHEN id % 4 = 3 THEN NULL ELSE 'http' || CASE WHEN id % 2 = 0 THEN 's' ELSE '' END || '://api.example.com/u/' || user_id END AS url, 'k=' || k AS query, CASE id % 3 WHEN 0 THEN 'bearer:t' || k WHEN 1 THEN 'basic:u' || k || ':p' END AS auth,
 'a=1,b=' || k AS cookies, CASE id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'form' ELSE 'text' END AS body_type, CASE id % 3 WHEN 0 THEN body WHEN 2 THEN 'plain ' || k END AS body, CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 4 = 3 THEN 1 ELSE 0 END AS warnings FROM ex""",
)
def read_raw_http(spark, sf):
    ex = exchanges(spark, sf)
    raw = (
        "concat('\\r\\n', method, ' ', '/u/', user_id, '?k=', k, ' HTTP/1.1\\r\\n', CASE WHEN id % 4 = 3 THEN '' ELSE 'Host: api.example.com\\r\\n' END, CASE WHEN id % 2 = 0 THEN 'X-Forwarded-Proto: https\\r\\n' ELSE '' END, "
        "CASE WHEN id % 5 = 0 THEN 'nonsense\\r\\n' ELSE '' END, CASE id % 3 WHEN 0 THEN concat('Authorization: Bearer t', k, '\\r\\n') WHEN 1 THEN concat('authorization: Basic ', base64(encode(concat('u', k, ':p'), 'UTF-8')), '\\r\\n') ELSE 'Content-Type: text/plain\\r\\n' END, "
        "'Cookie: a=1; b=', k, '\\r\\nContent-Length: 3\\r\\nX-Z: 1\\r\\n\\r\\n', CASE id % 3 WHEN 0 THEN body WHEN 1 THEN concat('q=', k, '+1') ELSE concat('plain ', k) END, '\\r\\n')"
    )
    got = raw_http.parse_raw_http(ex.select("id", F.expr(raw).alias("raw")))
    pairs = lambda col: F.array_join(F.transform(col, lambda p: F.concat_ws("=", p["key"], p["value"])), ",")
    auth = F.when(c("auth.type") == "bearer", F.concat_ws(":", "auth.type", "auth.token")).when(c("auth.type") == "basic", F.concat_ws(":", "auth.type", "auth.username", "auth.password"))
    relative = ~F.contains(c("url"), F.lit("://"))
    query_text = F.when(relative, F.regexp_extract("url", r"\?(.*)$", 1)).otherwise(pairs("query"))
    return got.select(
        "id", "method", F.when(~relative, c("url")).alias("url"), query_text.alias("query"), auth.alias("auth"), pairs("cookies").alias("cookies"), "body_type", "body", F.size("warnings").alias("warnings")
    )


def saved(spark, sf):
    """Orders of a customer as the collection of a project; priorities are folders."""
    return table(spark, sf, "orders").selectExpr(
        "concat('c', o_custkey % 17) AS project_id", "concat('col', o_custkey % 5) AS collection", "o_orderkey AS position", "concat('id', o_orderkey) AS id", "concat('n', o_orderkey) AS name",
        "CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS folder", "CASE WHEN o_orderkey % 3 = 0 THEN concat('GET /o/', o_orderkey) END AS spec_ref", "o_orderkey AS k",
    )


@query(
    "save_inventory",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority WHEN o_orderkey % 6 = 0 THEN 'fresh' END AS folder, CASE WHEN o_orderkey % 6 = 0 THEN 'updated' ELSE 'kept' END AS action, CASE WHEN o_orderkey % 6 = 0 THEN 'd' ELSE 'n' END || o_orderkey AS name FROM orders
 UNION ALL SELECT o_orderkey, 'fresh', 'added', 'd' || o_orderkey FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 2 = 0""",
)
def save_inventory(spark, sf):
    now = saved(spark, sf)
    drafts = now.filter("k % 2 = 0 and k % 3 < 2").select(
        P, "collection", c("k").alias("seq"), F.concat(F.lit("GET /o/"), "k").alias("spec_ref"), F.concat(F.lit("d"), "k").alias("name"), F.lit("fresh").alias("folder"), "k"
    )
    out, _ = collections.save_inventory(now, drafts)
    return out.select("k", "folder", "action", "name")


@query("save_inventory_report", "SELECT 'c' || (o_custkey % 17) AS project_id, 'col' || (o_custkey % 5) AS collection, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS added, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS updated FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 < 2 GROUP BY 1, 2")
def save_inventory_report(spark, sf):
    now = saved(spark, sf)
    drafts = now.filter("k % 2 = 0 and k % 3 < 2").select(
        P, "collection", c("k").alias("seq"), F.concat(F.lit("GET /o/"), "k").alias("spec_ref"), F.concat(F.lit("d"), "k").alias("name"), F.lit("fresh").alias("folder"), "k"
    )
    return collections.save_inventory(now, drafts)[1]


@query(
    "save_request",
    """SELECT 'n' || CASE WHEN o_orderkey % 5 = 0 THEN 'ew' ELSE '' END || o_orderkey AS name, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS folder, CASE WHEN o_orderkey % 5 < 2 THEN 'updated' ELSE 'kept' END AS action FROM orders
 UNION ALL SELECT 'other' || o_orderkey, NULL, 'added' FROM orders WHERE o_orderkey % 5 = 2""",
)
def save_request(spark, sf):
    """Renamed by id, replaced by name, and new ones."""
    now = saved(spark, sf).drop("spec_ref")
    incoming = now.filter("k % 5 < 3").select(
        P, "collection", F.expr("CASE WHEN k % 5 = 0 THEN id ELSE concat('x', k) END").alias("id"), F.expr("CASE k % 5 WHEN 0 THEN concat('new', k) WHEN 1 THEN name ELSE concat('other', k) END").alias("name"),
        F.lit(None).cast("string").alias("folder"), "k", c("k").alias("seq"),
    )
    return collections.save_requests(now, incoming).select("name", "folder", "action")


@query(
    "folder_rollup",
    """SELECT 'c' || (o_custkey % 17) AS project_id, f AS folder, count(*) AS requests FROM orders, LATERAL (SELECT unnest(['', o_orderstatus, o_orderstatus || '/' || o_orderpriority]) AS f) GROUP BY 1, 2""",
)
def folder_rollup(spark, sf):
    df = table(spark, sf, "orders").selectExpr("concat('c', o_custkey % 17) AS project_id", "'one' AS collection", "concat('/', o_orderstatus, '//', o_orderpriority) AS folder")
    return collections.folder_rollup(df).select(P, "folder", "requests")


@query("collection_size", "SELECT 'c' || (o_custkey % 17) AS project_id, 'col' || (o_custkey % 5) AS collection, count(*) AS requests FROM orders GROUP BY 1, 2")
def collection_size(spark, sf):
    return collections.collection_sizes(saved(spark, sf))


@query("document_listing", "SELECT 'p' || (o_custkey % 3) AS project_id, 'flow' AS kind, 'f' || o_orderkey AS name, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS steps FROM orders UNION ALL SELECT DISTINCT 'p' || (o_custkey % 3), 'collection', 'c' || o_custkey, NULL FROM orders")
def document_listing(spark, sf):
    orders = table(spark, sf, "orders").withColumn(P, F.expr("concat('p', o_custkey % 3)"))
    docs = orders.selectExpr(P, "'flow' AS kind", "concat('f', o_orderkey) AS name").unionByName(orders.selectExpr(P, "'collection' AS kind", "concat('c', o_custkey) AS name"))
    nodes = table(spark, sf, "lineitem").join(orders, c("l_orderkey") == c("o_orderkey")).selectExpr(P, "concat('f', l_orderkey) AS flow")
    return collections.document_listing(docs, nodes)


def change_feed(spark, sf):
    kind = "CASE user_id % 5 WHEN 0 THEN concat('.x/flows/f', user_id, '.yaml') WHEN 1 THEN concat('x/Collections/c', user_id, '.yml') WHEN 2 THEN 'x/workspace.yaml' WHEN 3 THEN concat('x/flows/.f', user_id, '.yaml') ELSE concat('x/notes/', user_id, '.yaml') END"
    return table(spark, sf, "events").selectExpr("concat('p', user_id % 7) AS project_id", "ts", "event_id AS seq", f"{kind} AS path", "event_type = 'error' AS removed", "props AS content")


BURSTS = """ch AS (SELECT 'p' || (user_id % 7) AS project_id, ts, CASE user_id % 5 WHEN 0 THEN 'flow:f' || user_id WHEN 1 THEN 'collection:c' || user_id ELSE 'workspace:' END || ':' || (event_type = 'error') AS doc FROM events WHERE user_id % 5 < 3),
 g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY project_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM ch), s AS (SELECT *, sum(fresh) OVER (PARTITION BY project_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)"""


@query("coalesce_changes", f"WITH {BURSTS} SELECT project_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(DISTINCT doc) AS documents FROM s GROUP BY project_id, burst")
def coalesce_changes(spark, sf):
    """The change feed as a table, with half an hour of silence between bursts."""
    got = changes.coalesce_changes(change_feed(spark, sf), settle="30 minutes")
    return got.select(P, F.unix_timestamp("started").alias("started"), F.size("documents").cast("bigint").alias("documents"))


@query("suppress_echo", "SELECT user_id, event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id AS u, arg_max(CASE WHEN event_type = 'error' THEN 'gone' ELSE props END, event_id) AS last FROM events WHERE event_id % 2 = 0 GROUP BY 1) w WHERE w.u = e.user_id AND w.last = CASE WHEN event_type = 'error' THEN 'gone' ELSE props END)")
def suppress_echo(spark, sf):
    """Even events are own writes; what repeats a document's last own write is dropped."""
    feed = table(spark, sf, "events").selectExpr(
        "concat('p', user_id % 7) AS project_id", "ts", "event_id AS seq", "user_id", "concat('x/flows/f', user_id, '.yaml') AS path", "event_type = 'error' AS removed", "props AS content"
    )
    writes = feed.filter("seq % 2 = 0").withColumn("written_at", c("seq"))
    return changes.suppress_echo(feed, writes).select("user_id", c("seq").alias("event_id"))


def run_events(spark, sf):
    """Turns of conversations as the event stream of runs."""
    cell = "named_struct('node_id', {0}, 'status', {1}, 'reason_kind', CAST(NULL AS STRING), 'branch', CAST(NULL AS STRING))"
    talk = table(spark, sf, "conversations")
    base = ["concat('t', conv_id % 5) AS project_id", "CAST(conv_id AS STRING) AS run_id"]
    none = "CAST(NULL AS STRING)"
    cells = "array<struct<node_id:string,status:string,reason_kind:string,branch:string>>"
    started = talk.filter("turn = 0").selectExpr(*base, "CAST(0 AS BIGINT) AS seq", "'started' AS event", "array('n0', 'n1', 'n99') AS nodes", f"{none} AS node", f"{none} AS status", f"{none} AS reason_kind", f"{none} AS branch", f"CAST(NULL AS {cells}) AS results")
    begun = talk.selectExpr(*base, "turn * 2 + 1 AS seq", "'node_started' AS event", "CAST(NULL AS array<string>) AS nodes", "concat('n', turn) AS node", f"{none} AS status", f"{none} AS reason_kind", f"{none} AS branch", f"CAST(NULL AS {cells}) AS results")
    ended = talk.filter("turn % 3 <> 2").selectExpr(*base, "turn * 2 + 2 AS seq", "'node_finished' AS event", "CAST(NULL AS array<string>) AS nodes", "concat('n', turn) AS node", "CASE role WHEN 'user' THEN 'passed' ELSE 'failed' END AS status", f"{none} AS reason_kind", f"{none} AS branch", f"CAST(NULL AS {cells}) AS results")
    final = talk.filter("turn = 0 and conv_id % 4 = 0").selectExpr(*base, "CAST(10000 AS BIGINT) AS seq", "'finished' AS event", "CAST(NULL AS array<string>) AS nodes", f"{none} AS node", f"{none} AS status", f"{none} AS reason_kind", f"{none} AS branch", f"array({cell.format(chr(39) + 'n99' + chr(39), chr(39) + 'passed' + chr(39))}) AS results")
    return started.unionByName(begun).unionByName(ended).unionByName(final)


@query(
    "live_run_state",
    """SELECT conv_id, 'n' || turn AS node_id, CASE WHEN turn % 3 = 2 THEN 'running' WHEN role = 'user' THEN 'passed' ELSE 'failed' END AS status FROM conversations
 UNION ALL SELECT conv_id, 'n99', CASE WHEN conv_id % 4 = 0 THEN 'passed' ELSE 'pending' END FROM conversations WHERE turn = 0
 UNION ALL SELECT conv_id, 'n1', 'pending' FROM conversations GROUP BY conv_id HAVING max(turn) = 0""",
)
def live_run_state(spark, sf):
    return live.live_run_state(run_events(spark, sf)).select(c("run_id").cast("bigint").alias("conv_id"), "node_id", "status")


@query(
    "live_edge_state",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'idle' WHEN role = 'user' THEN 'taken' ELSE 'dead' END AS state FROM conversations""",
)
def live_edge_state(spark, sf):
    state = live.live_run_state(run_events(spark, sf))
    edges = table(spark, sf, "conversations").selectExpr(
        "concat('t', conv_id % 5) AS project_id", "CAST(conv_id AS STRING) AS run_id", "concat('n', turn) AS from_node", "'end' AS to_node", "CAST(NULL AS STRING) AS handle", "conv_id", "turn"
    )
    return live.live_edge_state(state, edges).select("conv_id", "turn", "state")


def _stream_of(spark, df, label):
    """A table put where a file stream can read it."""
    folder = shared_folder(spark, label)
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def log_rows(spark, sf):
    return exchanges(spark, sf).selectExpr("*", "CAST(NULL AS STRING) AS error", "'{}' AS draft", "'{}' AS request", "body AS response", "'send' AS source")


@query("history_log", f"WITH {EX} SELECT project_id, count(*) AS entries, min(id) AS first_id FROM ex WHERE status IS NOT NULL GROUP BY 1")
def history_log(spark, sf):
    """One log: it is streamed to, cleared, and then filled half by a stream and half by the batch writer."""
    rows = log_rows(spark, sf)
    secrets = rows.select(P).distinct().selectExpr(P, "'h' AS name", "'api.example.com' AS value")
    folder = shared_folder(spark, "log")
    for label in ("first", "second"):
        even = _stream_of(spark, rows.filter("id % 2 = 0"), f"feed-{label}")
        ingest.ingest_history(even, secrets, folder, shared_folder(spark, f"state-{label}")).awaitTermination()
        if label == "first":
            clear_history(spark, folder)
    append_history(RedactedHistory.of(history_rows(rows.filter("id % 2 = 1")), secrets), folder)
    return read_history(spark, folder).groupBy(P).agg(F.count("*").alias("entries"), F.min("id").alias("first_id"))


@query("ingest_history", f"""WITH {EX} SELECT project_id, count(*) AS entries, count(*) FILTER (WHERE contains(url, 'api.example.com')) AS leaked FROM (SELECT project_id, replace(url, 'api.example.com', '••••••') AS url FROM ex WHERE status IS NOT NULL) GROUP BY 1""")
def ingest_history(spark, sf):
    """Every answered exchange through the streaming append, its host being a secret."""
    rows = log_rows(spark, sf)
    secrets = rows.select(P).distinct().selectExpr(P, "'h' AS name", "'api.example.com' AS value")
    folder, state = shared_folder(spark, "log"), shared_folder(spark, "state")
    ingest.ingest_history(_stream_of(spark, rows, "feed"), secrets, folder, state).awaitTermination()
    return read_history(spark, folder).groupBy(P).agg(F.count("*").alias("entries"), F.count_if(F.contains(c("url"), F.lit("api.example.com"))).alias("leaked"))


@query("policy_stream", f"WITH {EX} SELECT id, CASE WHEN method = 'GET' THEN NULL ELSE 'method_not_allowed' END AS reason FROM ex")
def policy_stream(spark, sf):
    calls = exchanges(spark, sf).select(P, "id", "method", "url")
    rules = calls.select(P).distinct().selectExpr(P, "'api.example.com' AS host", "array('GET') AS methods")
    out, state = shared_folder(spark, "verdicts"), shared_folder(spark, "state")
    stream = ingest.policy_stream(_stream_of(spark, calls, "calls"), lambda: rules, lambda df, _epoch: df.write.mode("append").parquet(out), state)
    stream.awaitTermination()
    return spark.read.parquet(out).select("id", "reason")


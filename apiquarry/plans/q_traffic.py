"""Queries on recorded traffic, the history log, variables, secrets and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from apiquarry.functions import text
from apiquarry.operators import groups, redact, requests, traffic, variables
from apiquarry.plans.base import EX, exchanges, query, shared_folder, table
from apiquarry.sources import har, history

c = F.col
P = "project_id"


@query(
    "newest_match",
    f"""WITH {EX}, t AS (SELECT DISTINCT project_id, method, event_type FROM ex),
 m AS (SELECT t.project_id, t.method || ' ' || t.event_type || ' one' AS template_id, ex.id, ex."at" FROM t JOIN ex ON ex.project_id = t.project_id AND ex.method = t.method AND ex.event_type = t.event_type WHERE status IS NOT NULL
  UNION ALL SELECT t.project_id, t.method || ' ' || t.event_type || ' any', ex.id, ex."at" FROM t JOIN ex ON ex.project_id = t.project_id AND ex.method = t.method WHERE status IS NOT NULL)
 SELECT project_id, template_id, arg_max(id, ("at", id)) AS exchange_id FROM m GROUP BY 1, 2""",
)
def newest_match(spark, sf):
    """Templates with a literal end, and templates that end in holes."""
    ex = exchanges(spark, sf).withColumn("has_response", c("status").isNotNull())
    kinds = ex.select(P, "method", "event_type").distinct()
    one = kinds.select(P, F.concat_ws(" ", "method", "event_type", F.lit("one")).alias("template_id"), F.lower("method").alias("method"), F.concat(F.lit("{{base}}/users/{user_id}/"), "event_type").alias("url"))
    many = kinds.select(P, F.concat_ws(" ", "method", "event_type", F.lit("any")).alias("template_id"), "method", F.lit("{{base}}/{user_id}/{what}").alias("url"))
    return traffic.newest_match(ex, one.unionByName(many)).select(P, "template_id", "exchange_id")


CALLS = """calls AS (SELECT page_id, 'p' || (page_id % 3) AS project_id, CASE page_id % 3 WHEN 0 THEN 'get' ELSE 'POST' END AS method, url, regexp_extract(url, '://([^/?#]+)', 1) AS host, url LIKE 'https%' AS tls FROM pages)"""


@query(
    "check_allowed",
    f"""WITH {CALLS}, h AS (SELECT *, project_id IN ('p0', 'p1') AND host LIKE '%.example.com' AS suffix_ok, project_id = 'p1' AND host LIKE '%.example.org' AND tls AS port_ok,
  project_id = 'p2' AND host = (SELECT max(regexp_extract(url, '://([^/?#]+)', 1)) FROM pages) AS exact_ok FROM calls)
 SELECT page_id, CASE WHEN page_id % 10 = 9 THEN NULL WHEN NOT (suffix_ok OR exact_ok) THEN 'host_not_allowed' WHEN suffix_ok AND project_id = 'p1' THEN 'method_not_allowed' END AS reason FROM h""",
)
def check_allowed(spark, sf):
    """One project takes a suffix, one a suffix for GET only, one an exact host."""
    pages = table(spark, sf, "pages")
    calls = pages.selectExpr(
        "page_id", "concat('p', page_id % 3) AS project_id", "CASE page_id % 3 WHEN 0 THEN 'get' ELSE 'POST' END AS method",
        "CASE WHEN page_id % 10 = 9 THEN 'http://localhost:8000/x' ELSE url END AS url",
    )
    top = pages.agg(F.max(F.regexp_extract("url", "://([^/?#]+)", 1)).alias("host")).selectExpr("'p2' AS project_id", "host", "CAST(array() AS array<string>) AS methods")
    fixed = spark.createDataFrame(
        [("p0", " *.Example.com ", []), ("p1", "*.example.com:80", ["GET"]), ("p1", "*.example.com:443", ["get"])], "project_id string, host string, methods array<string>"
    )
    return traffic.check_allowed(calls, fixed.unionByName(top)).select("page_id", "reason")


def redirected(spark, sf):
    """Exchanges with a chain of two redirects, the second to another origin."""
    hop = "named_struct('status', {0}, 'from', {1}, 'to', {2}, 'credentials_stripped', {3})"
    other = "concat('https://other', user_id, '.example.com/x')"
    first = hop.format("CASE id % 3 WHEN 0 THEN 302 WHEN 1 THEN 307 ELSE 303 END", "url", "concat(url, '&next=1')", "false")
    second = hop.format("301", "concat(url, '&next=1')", other, "true")
    return exchanges(spark, sf).withColumn("redirects", F.expr(f"CASE WHEN id % 5 = 0 THEN array({first}, {second}) ELSE array({first}) END"))


@query(
    "redirect_audit",
    f"""WITH {EX} SELECT id, 1 AS hop, FALSE AS crossed_origin, FALSE AS credentials_stripped, CASE WHEN id % 3 = 2 OR (id % 3 = 0 AND method = 'POST') THEN 'GET' ELSE method END AS next_method FROM ex
 UNION ALL SELECT id, 2, TRUE, TRUE, CASE WHEN id % 3 = 2 OR method = 'POST' THEN 'GET' ELSE method END FROM ex WHERE id % 5 = 0""",
)
def redirect_audit(spark, sf):
    return traffic.redirect_audit(redirected(spark, sf)).select("id", "hop", "crossed_origin", "credentials_stripped", "next_method")


@query(
    "check_redirect_hops",
    f"""WITH {EX} SELECT project_id, hop, reason, count(*) AS calls FROM (SELECT project_id, 0 AS hop, NULL AS reason FROM ex UNION ALL SELECT project_id, 1, NULL FROM ex UNION ALL SELECT project_id, 2, 'host_not_allowed' FROM ex WHERE id % 5 = 0) GROUP BY 1, 2, 3""",
)
def check_redirect_hops(spark, sf):
    calls = traffic.calls_with_hops(redirected(spark, sf))
    rules = calls.select(P).distinct().selectExpr(P, "'api.example.com' AS host", "CAST(array() AS array<string>) AS methods")
    return traffic.check_allowed(calls, rules).groupBy(P, "hop", "reason").agg(F.count("*").alias("calls"))


def history_table(spark, sf):
    ex = exchanges(spark, sf).selectExpr(
        "*", "CASE WHEN status IS NULL AND id % 2 = 0 THEN concat('refused by token', k) END AS error", "concat('{\"draft\":\"', url, '\"}') AS draft",
        "concat('{\"url\":\"', url, '\"}') AS request", "concat('{\"status\":', status, ',\"body\":', body, '}') AS response", "'send' AS source",
    )
    return history.history_rows(ex)


HISTORY = f"""{EX}, hist AS (SELECT project_id, id, CAST(floor(epoch("at")) AS BIGINT) AS "at", method, url, status, CASE WHEN status IS NOT NULL THEN total_ms END AS duration_ms,
  CASE WHEN status IS NULL THEN 'refused by token' || k END AS error, CASE WHEN status IS NULL THEN '{{"draft":"' || url || '"}}' ELSE '{{"url":"' || url || '"}}' END AS request,
  CASE WHEN status IS NOT NULL THEN '{{"status":' || status || ',"body":' || body || '}}' END AS response FROM ex WHERE status IS NOT NULL OR id % 2 = 0)"""


@query("history_row_from_exchange", f'WITH {HISTORY} SELECT id, "at", status, duration_ms, error, request, response FROM hist')
def history_row_from_exchange(spark, sf):
    return history_table(spark, sf).select("id", "at", "status", "duration_ms", "error", "request", "response")


@query("history_append", f"WITH {HISTORY} SELECT project_id, 0 AS leaked, count(*) AS entries FROM hist GROUP BY 1")
def history_append(spark, sf):
    """Append redacted rows to the log and read them back; no secret survives."""
    rows = history_table(spark, sf)
    secrets = rows.select(P).distinct().selectExpr(P, "'tok' AS name", "'token' AS value")
    folder = shared_folder(spark, "history")
    history.append_history(history.RedactedHistory.of(rows, secrets), folder)
    back = history.read_history(spark, folder)
    return back.groupBy(P).agg(F.count_if(F.contains(c("error"), F.lit("token"))).cast("int").alias("leaked"), F.count("*").alias("entries"))


@query("history_recent", f"WITH {HISTORY} SELECT id, method, status FROM hist ORDER BY id DESC LIMIT 25")
def history_recent(spark, sf):
    return history.recent(history_table(spark, sf), 25).select("id", "method", "status")


@query("history_get", f"WITH {HISTORY} SELECT id, url FROM hist WHERE id = 42")
def history_get(spark, sf):
    return history.entry(history_table(spark, sf), 42).select("id", "url")


@query("history_count", f"WITH {HISTORY} SELECT project_id, count(*) AS entries FROM hist GROUP BY 1")
def history_count(spark, sf):
    return history.history_count(history_table(spark, sf))


@query("history_prune", f"WITH {HISTORY} SELECT project_id, id FROM hist QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY id DESC) <= 40")
def history_prune(spark, sf):
    return history.prune(history_table(spark, sf), 40)[0].select(P, "id")


@query("history_pruned", f"WITH {HISTORY} SELECT project_id, greatest(count(*) - 40, 0) AS removed FROM hist GROUP BY 1")
def history_pruned(spark, sf):
    return history.prune(history_table(spark, sf), 40)[1]


@query("history_prune_deep", "SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) <= 1500")
def history_prune_deep(spark, sf):
    """A limit beyond what Spark ranks before the shuffle by itself; three keys hold every row."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf, "lineitem").select("l_returnflag", *keys, "l_extendedprice")
    order = [F.desc(k) for k in (*keys, "l_extendedprice")]
    return groups.top_k_per_key(rows, ["l_returnflag"], order, 1500, ["l_orderkey"]).select("l_returnflag", *keys)


@query(
    "rank_per_key",
    "SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank FROM lineitem",
)
def rank_per_key(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return groups.rank_per_key(table(spark, sf, "lineitem").select("l_returnflag", *keys), ["l_returnflag"], keys)


@query(
    "export_har",
    f"""WITH {EX} SELECT project_id, method, url, coalesce(status, 0) AS status, CASE WHEN status IS NULL THEN 0 ELSE total_ms END AS time, CASE WHEN status IS NULL THEN '' ELSE '[redacted]' END AS cookie,
 CASE WHEN status IS NULL THEN -1 ELSE length(body) END AS body_size, k AS query_k FROM ex""",
)
def export_har(spark, sf):
    """Whole HAR documents, read back entry by entry."""
    header = "named_struct('name', '{0}', 'value', {1})"
    rows = exchanges(spark, sf).selectExpr(
        P, "'traffic' AS collection", "id AS position", "method", "url", f"array({header.format('Authorization', 'CAST(id AS STRING)')}) AS request_headers", "CAST(NULL AS STRING) AS request_body",
        "at AS started", "status", "'' AS status_text", f"array({header.format('Set-Cookie', 'CAST(k AS STRING)')}) AS response_headers", "body", "'application/json' AS content_type",
        "CAST(NULL AS BIGINT) AS reported_length", "CAST(0 AS BIGINT) AS ttfb_ms", "total_ms",
    )
    documents = har.export_har(rows, sanitized=True, per_file=500)
    entries = documents.select(P, F.explode(F.expr("variant_get(parse_json(har), '$.log.entries', 'array<variant>')")).alias("e"))
    get = lambda path, kind: F.expr(f"try_variant_get(e, '{path}', '{kind}')")
    return entries.select(
        P, get("$.request.method", "string").alias("method"), get("$.request.url", "string").alias("url"), get("$.response.status", "int").alias("status"),
        get("$.time", "bigint").alias("time"), F.coalesce(get("$.response.headers[0].value", "string"), F.lit("")).alias("cookie"),
        get("$.response.bodySize", "bigint").alias("body_size"), get("$.request.queryString[0].value", "int").alias("query_k"),
    )


@query(
    "materialise_requests",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE 'http://h/o/' || o_orderkey || '?p=' || replace(o_orderpriority, ' ', '+') || CASE WHEN o_orderkey % 3 = 1 THEN '&api=k' || o_custkey ELSE '' END END AS url,
 CASE o_orderkey % 3 WHEN 0 THEN 'x-s=' || o_orderstatus || ';authorization=Bearer t' || o_custkey || ';content-type=application/json' WHEN 1 THEN 'x-s=' || o_orderstatus || ';cookie=c=1;content-type=application/x-www-form-urlencoded' ELSE 'x-s=' || o_orderstatus END AS headers,
 CASE o_orderkey % 3 WHEN 0 THEN '{}' WHEN 1 THEN 'a=b+c' END AS body, CASE WHEN o_orderkey % 3 = 2 THEN 'unfilled_placeholder {id}' END AS error FROM orders""",
)
def materialise_requests(spark, sf):
    kv = "array<struct<key:string,value:string,enabled:boolean,description:string>>"
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 3 = 2 THEN 'HEAD' ELSE 'POST' END AS method", "'http://h/o/{id}' AS url",
        "map('id', CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE CAST(o_orderkey AS STRING) END) AS path_values",
        f"CAST(array(named_struct('k', 'p', 'v', o_orderpriority, 'e', true, 'd', NULL), named_struct('k', 'off', 'v', 'x', 'e', false, 'd', NULL)) AS {kv}) AS query",
        f"CAST(array(named_struct('k', 'X-S', 'v', o_orderstatus, 'e', true, 'd', NULL)) AS {kv}) AS headers",
        f"CAST(CASE WHEN o_orderkey % 3 = 1 THEN array(named_struct('k', 'c', 'v', '1', 'e', true, 'd', NULL)) ELSE array() END AS {kv}) AS cookies",
        "CASE o_orderkey % 3 WHEN 0 THEN named_struct('type', 'bearer', 'token', concat('t', o_custkey), 'username', '', 'password', '', 'key', '', 'value', '', 'location', '') "
        "WHEN 1 THEN named_struct('type', 'api_key', 'token', '', 'username', '', 'password', '', 'key', 'api', 'value', concat('k', o_custkey), 'location', 'query') END AS auth",
        f"named_struct('type', CASE o_orderkey % 3 WHEN 1 THEN 'form' ELSE 'json' END, 'content', '{{}}', 'content_type', CAST(NULL AS STRING), 'fields', CAST(array(named_struct('k', 'a', 'v', 'b c', 'e', true, 'd', NULL)) AS {kv})) AS body",
    )
    sent = requests.materialise(df)
    shown = F.array_join(F.transform("wire_headers", lambda h: F.concat_ws("=", h["name"], h["value"])), ";")
    return sent.select("o_orderkey", c("wire_url").alias("url"), shown.alias("headers"), c("wire_body").alias("body"), c("wire_error").alias("error"))


def scopes_of(spark, sf):
    """Variables of every nation's environment, from its suppliers and its own row."""
    nation = table(spark, sf, "nation").selectExpr("concat('r', n_regionkey) AS project_id", "n_name AS environment", "n_nationkey AS k")
    rows = [
        ("environment", "base", "concat('http://n', k)"), ("globals", "base", "'http://global'"), ("environment", "url", "'{{base}}/v1'"),
        ("secrets", "token", "concat('s3cr3t', k)"), ("globals", "token", "'plain'"), ("environment", "auth", "'Bearer {{secret:token}}'"),
        ("environment", "loop", "'{{loop}}'"), ("environment", "bad", "'{{url}}{{gone}}'"), ("request_local", "local", "'L'"), ("environment", "local", "'E'"),
    ]
    out = None
    for scope, name, value in rows:
        part = nation.selectExpr(P, "environment", f"'{scope}' AS scope", f"'{name}' AS name", f"{value} AS value")
        out = part if out is None else out.unionByName(part)
    return out


def texts_of(spark, sf):
    """Template texts by customer, in the environment of its nation."""
    nation = table(spark, sf, "nation")
    template = (
        "CASE c_custkey % 7 WHEN 0 THEN concat('{{url}}/c/', c_custkey) WHEN 1 THEN '{{auth}} {{ token }}' WHEN 2 THEN '{{loop}}' WHEN 3 THEN 'x{{bad}}' "
        "WHEN 4 THEN '{{local}}{{open' WHEN 5 THEN '{{}}' ELSE concat('{{missing', c_custkey, '}}') END"
    )
    return table(spark, sf, "customer").join(nation, c("c_nationkey") == c("n_nationkey")).selectExpr(
        "c_custkey", "concat('r', n_regionkey) AS project_id", "n_name AS environment", f"{template} AS t"
    )


@query(
    "resolve_templates",
    """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'http://n' || c_nationkey || '/v1/c/' || c_custkey WHEN 1 THEN 'Bearer s3cr3t' || c_nationkey || ' plain' WHEN 4 THEN 'L{{open' END AS value,
 CASE c_custkey % 7 WHEN 2 THEN 'cycle' WHEN 3 THEN 'undefined' WHEN 5 THEN 'empty_name' WHEN 6 THEN 'undefined' END AS error, CASE c_custkey % 7 WHEN 2 THEN 'loop' WHEN 3 THEN 'gone' WHEN 6 THEN 'missing' || c_custkey END AS error_name FROM customer""",
)
def resolve_templates(spark, sf):
    r = variables.resolve_templates(texts_of(spark, sf), scopes_of(spark, sf), "t")
    return r.select("c_custkey", "resolved_text.value", "resolved_text.error", "resolved_text.error_name")


@query("secrets_used", "SELECT c_nationkey, count(*) AS texts FROM customer WHERE c_custkey % 7 = 1 GROUP BY 1")
def secrets_used(spark, sf):
    r = variables.resolve_templates(texts_of(spark, sf), scopes_of(spark, sf), "t").filter("array_contains(resolved_text.secrets, 'token')")
    return r.groupBy(F.regexp_extract("resolved_text.value", r"s3cr3t(\d+)", 1).cast("int").alias("c_nationkey")).agg(F.count("*").alias("texts"))


@query(
    "variable_lookup",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'http://n' || c_nationkey WHEN 1 THEN 's3cr3t' || c_nationkey ELSE 'L' END AS value, c_custkey % 3 = 1 AS is_secret FROM customer""",
)
def variable_lookup(spark, sf):
    name = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'secret: token' ELSE 'local' END")
    refs = texts_of(spark, sf).select("c_custkey", P, "environment", name.alias("name"))
    return variables.lookup_references(refs, scopes_of(spark, sf)).select("c_custkey", "value", c("secret").isNotNull().alias("is_secret"))


@query("undefined_references", "SELECT c_custkey, 'missing' || c_custkey AS undefined FROM customer WHERE c_custkey % 7 = 6")
def undefined_references(spark, sf):
    refs = texts_of(spark, sf).withColumn("refs", text.references(c("t")))
    return variables.undefined_references(refs, scopes_of(spark, sf)).select("c_custkey", F.array_join("undefined", ",").alias("undefined"))


@query("missing_secrets", "SELECT n_name AS environment, 'other' AS name FROM nation UNION ALL SELECT n_name, 'token' FROM nation WHERE n_regionkey = 1")
def missing_secrets(spark, sf):
    nation = table(spark, sf, "nation").selectExpr("concat('r', n_regionkey) AS project_id", "n_name AS environment", "n_regionkey")
    expected = nation.select(P, "environment", F.explode(F.array(F.lit("token"), F.lit("other"))).alias("name"))
    store = nation.filter("n_regionkey <> 1").selectExpr(P, "'token' AS name")
    return variables.missing_secrets(expected, store).select("environment", "name")


@query("variable_names", "SELECT n_name AS environment, u AS name FROM nation, LATERAL (SELECT unnest(['auth', 'bad', 'base', 'local', 'loop', 'secret:token', 'token', 'url']) AS u)")
def variable_names(spark, sf):
    return variables.variable_names(scopes_of(spark, sf)).select("environment", "name")


SECRETS = [("a", "the"), ("b", "other"), ("c", "er"), ("d", ""), ("e", "de la")]


def secret_store(spark):
    return spark.createDataFrame([(lang, n, v) for lang in ("en", "fr") for n, v in SECRETS], "project_id string, name string, value string")


def documents(spark, sf):
    return table(spark, sf, "documents").withColumn(P, c("lang"))


_MASK = "replace(replace(replace(replace({0}, 'the', '••••••'), 'other', '••••••'), 'er', '••••••'), 'de la', '••••••')"


@query(
    "redact_history",
    f"""SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN {_MASK.format('text')} ELSE text END AS url, CASE WHEN lang IN ('en', 'fr') THEN '{{"n":1.0,"••••••":"' || {_MASK.format("source || ' the er'")} || '"}}' ELSE '{{"n":1.0,"the":"' || source || ' the er"}}' END AS request FROM documents""",
)
def redact_history(spark, sf):
    h = documents(spark, sf).selectExpr(
        P, "doc_id", "text AS url", "CAST(NULL AS STRING) AS error", "concat('{\"n\":1.0,\"the\":\"', source, ' the er\"}') AS request", "CAST(NULL AS STRING) AS response"
    )
    return redact.redact_history(h, secret_store(spark)).select("doc_id", "url", "request")


@query(
    "mask_named",
    """SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN replace(replace(replace(replace(text, 'de la', '{{secret:e}}'), 'other', '{{secret:b}}'), 'the', '{{secret:a}}'), 'er', '{{secret:c}}') ELSE text END AS text FROM documents""",
)
def mask_named(spark, sf):
    return redact.mask_named(documents(spark, sf), secret_store(spark), ["text"]).select("doc_id", "text")


@query(
    "redact_used",
    """SELECT doc_id, CASE WHEN lang NOT IN ('en', 'fr') THEN text WHEN doc_id % 2 = 0 THEN replace(text, 'the', '••••••') ELSE text END AS text FROM documents""",
)
def redact_used(spark, sf):
    d = documents(spark, sf).withColumn("used", F.expr("CASE WHEN doc_id % 2 = 0 THEN array('a', 'zz') ELSE array('d') END"))
    return redact.redact_used(d, secret_store(spark), "text", "used").select("doc_id", "text")


@query(
    "masked_preview",
    """WITH d AS (SELECT doc_id, n_chars, CASE WHEN lang IN ('en', 'fr') THEN replace(replace(replace(replace(text, 'de la', '{{secret:e}}'), 'other', '{{secret:b}}'), 'the', '{{secret:a}}'), 'er', '{{secret:c}}') ELSE text END AS masked FROM documents)
 SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{' || chr(10) || '  "a": [' || chr(10) || '    ' || doc_id || chr(10) || '  ]' || chr(10) || '}' WHEN doc_id % 3 = 1 THEN '<' || n_chars || ' bytes of image/png>' ELSE masked END AS preview FROM d""",
)
def masked_preview(spark, sf):
    """Large enough a limit to keep texts whole; the cut itself is tested on its own."""
    x = documents(spark, sf).selectExpr(
        P, "doc_id", "'http://h' AS url", "CAST(array() AS array<struct<name:string,value:string>>) AS response_headers",
        "CASE doc_id % 3 WHEN 0 THEN concat('{\"a\":[', doc_id, ']}') WHEN 2 THEN text END AS body",
        "CASE doc_id % 3 WHEN 0 THEN 'application/json' WHEN 1 THEN 'image/png' ELSE 'text/plain' END AS content_type", "n_chars AS body_bytes",
    )
    return redact.masked_preview(x, secret_store(spark), 10_000_000).select("doc_id", "preview")


@query(
    "cut_preview",
    """SELECT doc_id, octet_length(encode(text)) > 200 AS cut, CASE WHEN octet_length(encode(text)) <= 200 THEN text ELSE array_to_string(list_transform(list_filter(range(1, 202), lambda i: octet_length(encode(left(text, i))) <= 200), lambda i: substr(text, i, 1)), '') END AS preview FROM documents""",
)
def cut_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.octet_length("text") > 200).alias("cut"), text.cut_bytes(c("text"), 200).alias("preview"))

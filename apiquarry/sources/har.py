"""HAR 1.2 export of materialised requests and their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiquarry.functions.http import header_value, query_rows, url_query
from apiquarry.functions.text import sanitise_headers
from apiquarry.operators.groups import rank_per_key

P = "project_id"


def har_entry(sanitized: bool) -> Column:
    """One HAR entry as JSON from method, url, request_headers, request_body, started, status
    (NULL = never answered), status_text, response_headers, body, content_type,
    reported_length, ttfb_ms, total_ms."""

    def shown(c: Column) -> Column:
        return sanitise_headers(c) if sanitized else c

    none = F.array().cast("array<struct<name:string,value:string>>")
    answered = F.col("status").isNotNull()
    size = F.coalesce("reported_length", F.length("body").cast("bigint"))
    pairs = F.transform(
        F.coalesce(query_rows(url_query(F.col("url"))), F.array().cast("array<struct<key:string,value:string>>")),
        lambda q: F.struct(q["key"].alias("name"), q["value"].alias("value")),
    )
    post = F.when(
        F.col("request_body").isNotNull(),
        F.struct(
            F.coalesce(header_value(F.col("request_headers"), "content-type"), F.lit("")).alias("mimeType"),
            F.col("request_body").alias("text"),
        ),
    )
    request = F.struct(
        F.upper("method").alias("method"),
        F.col("url").alias("url"),
        F.lit("HTTP/1.1").alias("httpVersion"),
        none.alias("cookies"),
        shown(F.col("request_headers")).alias("headers"),
        pairs.alias("queryString"),
        post.alias("postData"),
        F.lit(-1).alias("headersSize"),
        F.coalesce(F.length("request_body"), F.lit(-1)).alias("bodySize"),
    )
    response = F.struct(
        F.coalesce("status", F.lit(0)).alias("status"),
        F.coalesce("status_text", F.lit("")).alias("statusText"),
        F.lit("HTTP/1.1").alias("httpVersion"),
        none.alias("cookies"),
        F.coalesce(F.when(answered, shown(F.col("response_headers"))), none).alias("headers"),
        F.struct(
            F.when(answered, size).otherwise(F.lit(0)).alias("size"),
            F.when(answered, F.coalesce("content_type", F.lit(""))).otherwise("").alias("mimeType"),
            F.when(answered, F.col("body")).alias("text"),
        ).alias("content"),
        F.lit("").alias("redirectURL"),
        F.lit(-1).alias("headersSize"),
        F.when(answered, size).otherwise(F.lit(-1)).alias("bodySize"),
    )
    timings = F.struct(
        F.lit(0).alias("send"),
        F.coalesce(F.when(answered, F.col("ttfb_ms")), F.lit(0)).alias("wait"),
        F.coalesce(F.when(answered, F.col("total_ms") - F.col("ttfb_ms")), F.lit(0)).alias("receive"),
    )
    return F.to_json(
        F.struct(
            F.date_format(F.col("started").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("startedDateTime"),
            F.coalesce(F.when(answered, F.col("total_ms")), F.lit(0)).alias("time"),
            request.alias("request"),
            response.alias("response"),
            F.create_map().cast("map<string,string>").alias("cache"),
            timings.alias("timings"),
        )
    )


def export_har(sources: DataFrame, sanitized: bool, per_file: int = 5000, creator: str = "apiquarry") -> DataFrame:
    """(project_id, collection, part, har): HAR documents of at most ``per_file`` entries.

    A collection is one document unless it is larger than that; then it is a series of valid
    documents, so no task ever holds more than one part. ``position`` gives the order.
    """
    placed = rank_per_key(
        sources.select(P, "collection", "position", har_entry(sanitized).alias("entry")), [P, "collection"], ["position"], "_n"
    )
    part = F.floor((F.col("_n") - 1) / F.lit(per_file)).alias("part")
    joined = placed.groupBy(P, "collection", part).agg(F.array_sort(F.collect_list(F.struct("_n", "entry"))).alias("e"))
    entries = F.array_join(F.transform("e", lambda e: e["entry"]), ",")
    head = '{"log":{"version":"1.2","creator":{"name":"' + creator + '","version":""},"entries":['
    return joined.select(P, "collection", "part", F.concat(F.lit(head), entries, F.lit("]}}")).alias("har"))


def write_har(documents: DataFrame, path: str) -> None:
    """One folder per project and collection, one text row per document."""
    documents.select(P, "collection", F.col("har").alias("value")).write.mode("overwrite").partitionBy(P, "collection").text(path)

"""Drafts to wire-ready requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiquarry.functions import http
from apiquarry.schemas import HEADERS

# Content types a body implies.
IMPLIED = {"json": "application/json", "form": "application/x-www-form-urlencoded"}


def _header(name: Column, value: Column) -> Column:
    return F.struct(F.lower(name).alias("name"), value.alias("value"))


def wire_url(url: Column, path_values: Column, query: Column, auth: Column) -> Column:
    """Path values filled in, enabled query rows and a query API key appended form-encoded."""
    filled = http.fill_path_values(url, path_values)
    rows = F.transform(http.enabled_rows(query), lambda r: F.struct(r["key"].alias("key"), r["value"].alias("value")))
    in_query = (auth["type"] == "api_key") & (auth["location"] == "query")
    key = F.array(F.struct(auth["key"].alias("key"), auth["value"].alias("value")))
    added = http.form_pairs(F.when(F.coalesce(in_query, F.lit(False)), F.concat(rows, key)).otherwise(rows))
    fragment = F.regexp_extract(filled, r"(#[\s\S]*)$", 1)
    bare = F.regexp_replace(http.url_without_query(filled), r"#[\s\S]*$", "")
    stated = F.coalesce(http.url_query(filled), F.lit(""))
    whole = F.array_join(F.filter(F.array(stated, added), lambda p: p != ""), "&")
    return F.concat(bare, F.when(whole == "", "").otherwise(F.concat(F.lit("?"), whole)), fragment)


def wire_headers(headers: Column, cookies: Column, auth: Column) -> Column:
    """Enabled rows with duplicates kept side by side; credentials and cookies replace rows
    of their name."""
    stated = F.transform(http.enabled_rows(headers), lambda r: _header(r["key"], r["value"]))
    sent_cookies = F.transform(http.enabled_rows(cookies), lambda c: F.concat(c["key"], F.lit("="), c["value"]))
    key_at = F.when(auth["type"] == "api_key", auth["location"])
    all_cookies = F.when(key_at == "cookie", F.concat(sent_cookies, F.array(F.concat(auth["key"], F.lit("="), auth["value"])))).otherwise(sent_cookies)
    basic = F.base64(F.encode(F.concat_ws(":", auth["username"], auth["password"]), "UTF-8"))
    credential = (
        F.when(auth["type"] == "bearer", _header(F.lit("authorization"), F.concat(F.lit("Bearer "), auth["token"])))
        .when(auth["type"] == "basic", _header(F.lit("authorization"), F.concat(F.lit("Basic "), basic)))
        .when(key_at == "header", _header(auth["key"], auth["value"]))
    )
    cookie = F.when(F.size(all_cookies) > 0, _header(F.lit("cookie"), F.array_join(all_cookies, "; ")))
    forced = F.filter(F.array(credential, cookie), lambda h: h.isNotNull())
    names = F.array_distinct(F.transform(F.concat(stated, forced), lambda h: h["name"]))

    def of(n: Column) -> Column:
        own = F.filter(forced, lambda h: h["name"] == n)
        return F.when(F.size(own) > 0, F.slice(own, F.size(own), F.lit(1))).otherwise(F.filter(stated, lambda h: h["name"] == n))

    return F.flatten(F.transform(names, of)).cast(HEADERS)


def materialise(requests: DataFrame) -> DataFrame:
    """Resolved drafts as they would go on the wire.

    ``auth`` is struct<type,token,username,password,key,value,location>; ``body`` is
    struct<type,content,content_type,fields>. ``error`` names an unfilled placeholder or a URL
    without a scheme; such rows carry no URL.
    """
    body, auth = F.col("body"), F.col("auth")
    filled = http.fill_path_values(F.col("url"), F.col("path_values"))
    placeholder = http.unfilled_placeholder(filled)
    error = F.when(placeholder.isNotNull(), F.concat(F.lit("unfilled_placeholder "), placeholder)).when(
        http.url_scheme(filled).isNull(), F.lit("invalid_url")
    )
    text = (
        F.when(F.upper("method") == "HEAD", None)
        .when(body["type"].isin("json", "text"), body["content"])
        .when(body["type"] == "form", http.form_pairs(http.enabled_rows(body["fields"])))
    )
    sent = (F.upper("method") != "HEAD") & body["type"].isin("json", "text", "form", "binary")
    implied = F.when(body["type"].isin("text", "binary"), body["content_type"])
    for kind, content_type in IMPLIED.items():
        implied = F.when(body["type"] == kind, content_type).otherwise(implied)
    headers = wire_headers(F.col("headers"), F.col("cookies"), auth)
    stated = F.exists(headers, lambda h: h["name"] == "content-type")
    content = F.when(
        F.coalesce(sent, F.lit(False)) & ~stated & implied.isNotNull(),
        F.array(_header(F.lit("content-type"), implied)),
    ).otherwise(F.array().cast(HEADERS))
    return (
        requests.withColumn("wire_error", error)
        .withColumn("wire_headers", F.concat(headers, content))
        .withColumn("wire_body", text)
        .withColumn("wire_url", F.when(error.isNull(), wire_url(F.col("url"), F.col("path_values"), F.col("query"), auth)))
    )

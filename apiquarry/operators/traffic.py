"""Recorded traffic against templates, rules and itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiquarry.functions import http

P = "project_id"

_HOLE = r"\{\{[^}]*\}\}|\{[^{}]+\}"


def template_pattern(url: Column) -> Column:
    """Regular expression of a URL template: ``{{v}}`` anything, ``{p}`` one segment, any
    query string behind."""
    holes = F.regexp_extract_all(url, F.lit(f"({_HOLE})"), F.lit(1))
    literals = F.transform(
        F.split(url, _HOLE, -1), lambda t: F.regexp_replace(t, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    )
    filled = F.transform(holes, lambda h: F.when(h.startswith("{{"), ".*").otherwise("[^/?#]+"))
    body = F.array_join(F.zip_with(literals, filled, lambda l, h: F.concat(l, F.coalesce(h, F.lit("")))), "")
    return F.concat(F.lit("^"), body, F.lit(r"(\?.*)?$"))


def _anchor(url: Column) -> Column:
    """The last literal segment of a template, as struct<d, piece>: ``d`` segments from the
    end. NULL when the template ends in holes only."""
    tail = F.regexp_replace(url, r"^[\s\S]*\{\{[^}]*\}\}", "")
    open_start = F.contains(url, F.lit("{{"))
    pieces = F.reverse(F.split(tail, "/", -1))
    # A first piece right behind a ``{{v}}`` is glued to it and says nothing on its own.
    usable = F.when(open_start, F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))).otherwise(pieces)
    placed = F.transform(usable, lambda p, i: F.struct(i.alias("d"), p.alias("piece")))
    return F.get(F.filter(placed, lambda a: (a["piece"] != "") & ~F.contains(a["piece"], F.lit("{"))), F.lit(0))


def _offers(url: Column) -> Column:
    """Every (d, piece) a URL can be anchored by: its segments, read from its end and from
    before each ``?`` where a query may start."""
    parts = F.split(url, r"\?", -1)
    cuts = F.transform(parts, lambda _p, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "?"))
    placed = F.transform(
        cuts,
        lambda c: F.transform(F.reverse(F.split(c, "/", -1)), lambda p, i: F.struct(i.alias("d"), p.alias("piece"))),
    )
    return F.array_distinct(F.flatten(placed))


def newest_match(exchanges: DataFrame, templates: DataFrame) -> DataFrame:
    """For each template (project_id, template_id, method, url) the newest answered exchange
    that could be it.

    Exchanges collapse to one row per (method, URL) first. Templates are then found by their
    last literal segment, an equi-join, and only those pairs meet the pattern.
    """
    answered = (
        exchanges.filter("has_response")
        .groupBy(P, F.upper("method").alias("method"), "url")
        .agg(F.max(F.struct("at", "id")).alias("newest"))
    )
    wanted = templates.select(
        P, "template_id", F.upper("method").alias("method"), template_pattern(F.col("url")).alias("pattern"), _anchor(F.col("url")).alias("a")
    )
    anchored = wanted.filter("a is not null").select(P, "template_id", "method", "pattern", "a.d", "a.piece")
    loose = wanted.filter("a is null").select(P, "template_id", "method", "pattern")
    offered = answered.withColumn("o", F.explode(_offers(F.col("url")))).select(P, "method", "url", "newest", "o.d", "o.piece")
    hits = (
        anchored.join(offered, [P, "method", "d", "piece"])
        .select(P, "template_id", "pattern", "url", "newest")
        .unionByName(loose.join(answered, [P, "method"]).select(P, "template_id", "pattern", "url", "newest"))
        .filter("url rlike pattern")
    )
    return (
        hits.groupBy(P, "template_id")
        .agg(F.max("newest").alias("n"))
        .select(P, "template_id", F.col("n.id").alias("exchange_id"), F.col("n.at").alias("at"))
    )


def _parent_domains(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.when(
        F.size(labels) > 1,
        F.transform(
            F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
        ),
    ).otherwise(F.array().cast("array<string>"))


def check_allowed(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdict per (project_id, method, url): allowed, or why not.

    Loopback always passes. A rule's host is exact, ``host:port`` or ``*.suffix``; a host looks
    its rules up by its own name and by each parent domain, so no rule is compared with every
    host. Verdicts are worked out once per distinct (host, port, method).
    """
    url = F.col("url")
    calls = (
        calls.withColumn("_host", F.regexp_replace(http.url_host(url), r"\.+$", ""))
        .withColumn("_port", http.effective_port(url))
        .withColumn("_method", F.upper("method"))
        .withColumn("_loop", http.is_loopback(url))
    )
    # Brackets are only dropped from the pattern, as the rule's author may leave them out.
    text = F.lower(F.regexp_replace("host", r"^\s+|\s+$", ""))
    ported = text.rlike(r"[^:]:\d+$|^:\d+$")
    name = F.when(ported, F.regexp_replace(text, r":\d+$", "")).otherwise(text)
    suffix = name.startswith("*.")
    by_key = rules.select(
        P,
        F.when(suffix, "suffix").otherwise("exact").alias("_kind"),
        F.when(suffix, F.substring(name, F.lit(3), F.length(name)))
        .otherwise(F.regexp_replace(name, r"^\[+|\]+$", ""))
        .alias("_name"),
        F.when(ported, F.nullif(F.least(F.regexp_extract(text, r":(\d+)$", 1).cast("bigint"), F.lit(65536)), F.lit(65536))).alias("_rule_port"),
        F.transform("methods", lambda m: F.upper(m)).alias("_rule_methods"),
    )
    seen = calls.filter("not _loop").select(P, "_host", "_port", "_method").distinct()
    keys = F.concat(
        F.array(F.struct(F.lit("exact").alias("_kind"), F.col("_host").alias("_name"))),
        F.transform(_parent_domains(F.col("_host")), lambda d: F.struct(F.lit("suffix").alias("_kind"), d.alias("_name"))),
    )
    looked = seen.withColumn("_k", F.explode(keys)).select(P, "_host", "_port", "_method", "_k.*")
    matched = looked.join(by_key, [P, "_kind", "_name"]).filter("_rule_port is null or _rule_port = _port")
    verdicts = matched.groupBy(P, "_host", "_port", "_method").agg(
        F.bool_or((F.size("_rule_methods") == 0) | F.array_contains("_rule_methods", F.col("_method"))).alias("_method_ok")
    )
    renamed = verdicts.toDF("_p", "_h", "_q", "_m", "_method_ok")
    same = (
        (F.col(P) == F.col("_p"))
        & F.col("_host").eqNullSafe(F.col("_h"))
        & F.col("_port").eqNullSafe(F.col("_q"))
        & (F.col("_method") == F.col("_m"))
    )
    joined = calls.join(renamed, same, "left")
    reason = (
        F.when(F.col("_loop") | F.col("_method_ok"), None)
        .when(F.col("_method_ok").isNull(), "host_not_allowed")
        .otherwise("method_not_allowed")
    )
    return (
        joined.withColumn("reason", reason)
        .withColumn("allowed", F.col("reason").isNull())
        .withColumn("shown_host", http.display_host(F.col("url")))
        .drop("_host", "_port", "_method", "_loop", "_method_ok", "_p", "_h", "_q", "_m")
    )


def calls_with_hops(exchanges: DataFrame) -> DataFrame:
    """Every URL an exchange touched: what was sent, and where each redirect led."""
    first = exchanges.select(P, "id", F.lit(0).alias("hop"), "method", "url")
    hops = redirect_audit(exchanges).select(P, "id", F.col("hop"), F.col("next_method").alias("method"), F.col("to").alias("url"))
    return first.unionByName(hops)


def redirect_audit(exchanges: DataFrame) -> DataFrame:
    """One row per redirect: origin crossed, credentials stripped, and the method it leads to.

    A 303, and a 301 or 302 of a POST, turn the method into GET for the rest of the chain, so
    the method of a hop follows from the hops before it in the same row.
    """
    state = "struct<method:string,out:array<string>>"

    def onward(acc: Column, hop: Column) -> Column:
        to_get = (hop["status"] == 303) | (hop["status"].isin(301, 302) & (acc["method"] == "POST"))
        after = F.when(to_get, "GET").otherwise(acc["method"])
        return F.struct(after.alias("method"), F.concat(acc["out"], F.array(after)).alias("out")).cast(state)

    start = F.struct(F.upper("method").alias("method"), F.array().cast("array<string>").alias("out")).cast(state)
    methods = F.aggregate("redirects", start, onward)["out"]
    zipped = F.transform("redirects", lambda h, i: F.struct(h.alias("h"), F.get(methods, i).alias("next_method"), (i + 1).alias("hop")))
    return exchanges.select(P, "id", F.explode(zipped).alias("z")).select(
        P,
        "id",
        F.col("z.hop").alias("hop"),
        F.col("z.h.status").alias("status"),
        F.col("z.h.from").alias("from"),
        F.col("z.h.to").alias("to"),
        F.col("z.h.credentials_stripped").alias("credentials_stripped"),
        (~http.same_origin(F.col("z.h.from"), F.col("z.h.to"))).alias("crossed_origin"),
        F.col("z.next_method").alias("next_method"),
    )

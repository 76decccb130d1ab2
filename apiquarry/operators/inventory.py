"""From composed routes to the endpoint inventory, and everything read off an inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiquarry.functions import paths
from apiquarry.functions.pretty import pretty_json
from apiquarry.operators.groups import first_per_key
from apiquarry.operators.linking import directory_of
from apiquarry.schemas import ORIGIN

P = "project_id"

# The methods listed for a route that states none.
UNSPECIFIED_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE"]
DEFAULT_PAGE = 50


def to_endpoints(routes: DataFrame, framework: Column) -> DataFrame:
    """Composed routes as endpoints of a static scan."""
    origin = F.struct(
        F.lit("static_scan").alias("source"), framework.cast("string").alias("framework"), F.lit(None).cast("string").alias("document")
    ).cast(ORIGIN)
    return routes.select(
        P,
        "seq",
        paths.endpoint_id(F.col("method"), F.col("path")).alias("id"),
        "method",
        "path",
        paths.seed_path_params(F.col("path")).alias("path_params"),
        "query_params",
        "headers",
        "body",
        "auth",
        F.struct(F.col("router_module").alias("file"), "line", "column").alias("source"),
        origin.alias("origin"),
        "group",
        "summary",
        "description",
        paths.confidence(F.col("path"), F.lit("static_scan"), F.col("orphaned")).alias("confidence"),
        "orphaned",
        F.when(F.col("deprecated"), F.create_map(F.lit("deprecated"), F.lit("true")))
        .otherwise(F.create_map().cast("map<string,string>"))
        .alias("metadata"),
        "route_methods",
        "handler_module",
        "handler_name",
    )


def fill_from_handlers(endpoints: DataFrame, handlers: DataFrame) -> DataFrame:
    """Fill what a route leaves empty from its handler.

    A handler is found by (package, name), first declaration first; else by a name, whole and
    then after its first dot, that only one handler of the project has. A route without stated
    methods keeps only those its handler checks.
    """
    facts = ["query_params", "headers", "body", "auth", "methods"]
    handlers = handlers.select(P, "seq", directory_of(F.col("module")).alias("pkg"), "name", F.struct(*facts).alias("h"))
    by_package = first_per_key(handlers, [P, "pkg", "name"], ["seq"]).select(P, "pkg", "name", F.col("h").alias("h_pkg"))
    unique = (
        handlers.groupBy(P, "name").agg(F.count("*").alias("_n"), F.any_value("h").alias("h")).filter("_n = 1").drop("_n")
    )
    dotted = F.contains(F.col("handler_name"), F.lit("."))
    short = F.when(dotted, F.regexp_replace("handler_name", r"^[^.]*\.", ""))
    found = (
        endpoints.withColumn("pkg", directory_of(F.col("handler_module")))
        .withColumn("name", F.col("handler_name"))
        .join(by_package, [P, "pkg", "name"], "left")
        .join(unique.withColumnRenamed("h", "h_full"), [P, "name"], "left")
        .withColumn("name", short)
        .join(unique.withColumnRenamed("h", "h_short"), [P, "name"], "left")
        .withColumn("h", F.coalesce("h_pkg", "h_full", "h_short"))
        .drop("pkg", "name", "h_pkg", "h_full", "h_short")
    )
    open_methods = F.coalesce(
        (F.col("route_methods") == F.array(*[F.lit(m) for m in UNSPECIFIED_METHODS])) & (F.size("h.methods") > 0),
        F.lit(False),
    )
    names = paths.param_names(F.col("path"))
    usable_query = F.filter(F.col("h.query_params"), lambda q: ~F.array_contains(names, q["name"]))
    kept = found.filter(~open_methods | F.array_contains("h.methods", F.col("method")))
    return (
        kept.withColumn("summary", F.when(~open_methods, F.col("summary")))
        .withColumn("query_params", F.when(F.size("query_params") > 0, F.col("query_params")).otherwise(F.coalesce(usable_query, "query_params")))
        .withColumn("headers", F.when(F.size("headers") > 0, F.col("headers")).otherwise(F.coalesce("h.headers", "headers")))
        .withColumn("body", F.coalesce("body", "h.body"))
        .withColumn("auth", F.coalesce("auth", "h.auth"))
        .drop("h")
    )


def endpoint_view(endpoints: DataFrame) -> DataFrame:
    """An endpoint flattened for reading."""
    path = F.col("path")
    return endpoints.select(
        P,
        "id",
        "method",
        paths.render_path(path).alias("path"),
        paths.display(F.col("method"), path).alias("display"),
        "group",
        "summary",
        F.replace(F.col("source.file"), F.lit("\\"), F.lit("/")).alias("file"),
        F.col("source.line").alias("line"),
        "orphaned",
        (~paths.is_resolved(path)).alias("unresolved"),
        paths.unresolved_exprs(path).alias("unresolved_exprs"),
        F.col("auth").isNotNull().alias("auth"),
        F.col("body").isNotNull().alias("has_body"),
        F.transform("query_params", lambda q: q["name"]).alias("query"),
        F.col("metadata")["enrich"].alias("enrich"),
        paths.normalize_path(path).alias("normalized"),
    )


def in_order(endpoints: DataFrame) -> DataFrame:
    """Project, normalised path, method."""
    return endpoints.orderBy(P, paths.normalize_path(F.col("path")), "method")


def search_endpoints(view: DataFrame, needle: str = "", offset: int = 0, limit: int | None = None) -> DataFrame:
    """Case-insensitive substring over display, group and summary; one page in total order."""
    size = DEFAULT_PAGE if limit is None else limit
    return matching(view, needle).orderBy(P, "normalized", "method", "display").offset(offset).limit(size)


def matching(view: DataFrame, needle: str) -> DataFrame:
    if not needle:
        return view
    n = F.lit(needle.lower())
    fields = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("display", "group", "summary")]
    return view.filter(F.contains(fields[0], n) | F.contains(fields[1], n) | F.contains(fields[2], n))


def find_endpoint(view: DataFrame, wanted: str) -> DataFrame:
    """Case-insensitive match on id or display."""
    w = wanted.strip().lower()
    return view.filter((F.lower("id") == w) | (F.lower("display") == w))


def resolved_only(endpoints: DataFrame) -> DataFrame:
    return endpoints.filter(paths.is_resolved(F.col("path")))


def with_gaps(endpoints: DataFrame) -> DataFrame:
    return endpoints.filter(paths.has_gaps(F.col("path"), F.col("orphaned")))


def gap_counts(view: DataFrame) -> DataFrame:
    """Per project: gaps (unresolved) and orphans (orphaned but resolved)."""
    return view.groupBy(P).agg(
        F.count_if("unresolved").alias("gaps"), F.count_if(F.col("orphaned") & ~F.col("unresolved")).alias("orphans")
    )


def scan_stats(files: DataFrame, parsed: DataFrame, routers: DataFrame, view: DataFrame) -> DataFrame:
    """Per project: files seen and parsed, routers, endpoints, unresolved endpoints."""
    parts = [
        files.groupBy(P).agg(F.count("*").alias("files_seen")),
        parsed.groupBy(P).agg(F.count("*").alias("files_parsed")),
        routers.groupBy(P).agg(F.count_distinct("module", "name").alias("routers_found")),
        view.groupBy(P).agg(F.count("*").alias("endpoints_found"), F.count_if("unresolved").alias("unresolved")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, P, "full")
    return out.na.fill(0)


def group_sizes(view: DataFrame) -> DataFrame:
    """Endpoints per group, ``ungrouped`` where none is named."""
    return view.groupBy(P, F.coalesce("group", F.lit("ungrouped")).alias("group")).agg(F.count("*").alias("endpoints"))


def drift(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows no longer found and rows newly found between two inventories (as multisets)."""
    gone = before.select(*columns).exceptAll(after.select(*columns)).withColumn("change", F.lit("removed"))
    new = after.select(*columns).exceptAll(before.select(*columns)).withColumn("change", F.lit("added"))
    return gone.unionByName(new)


def misses_now_found(misses: DataFrame, view: DataFrame) -> DataFrame:
    """Expected misses that an inventory does list."""
    return misses.join(view.select(P, "path").distinct(), [P, "path"], "left_semi")


def undeclared_router_counts(routes: DataFrame, routers: DataFrame) -> DataFrame:
    """Routes per router symbol that is declared nowhere."""
    known = routers.select(P, F.struct("module", "name").alias("router"))
    return routes.join(known, [P, "router"], "left_anti").groupBy(P, "router").agg(F.count("*").alias("routes"))


def endpoint_to_request(endpoints: DataFrame, base_url: Column) -> tuple[DataFrame, DataFrame]:
    """(requests, refused): drafts of resolved endpoints; the others with what defeated them."""
    path = F.col("path")
    ok = paths.is_resolved(path)
    blank = F.lit("")

    def text(json: Column) -> Column:
        decoded = F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")
        return F.when(json.startswith('"'), decoded).otherwise(F.coalesce(json, blank))

    def row(key: Column, value: Column, description: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"), F.lit(True).alias("enabled"), description.alias("description"))

    requests = endpoints.filter(ok).select(
        P,
        F.col("id").alias("spec_ref"),
        F.coalesce("summary", paths.display(F.col("method"), path)).alias("name"),
        F.col("group").alias("folder"),
        "method",
        F.concat(F.regexp_replace(base_url, "/+$", ""), paths.render_path(path)).alias("url"),
        F.map_from_entries(
            F.transform(F.array_distinct(F.transform("path_params", lambda p: p["name"])), lambda n: F.struct(n, F.lit("")))
        ).alias("path_values"),
        F.transform("query_params", lambda q: row(q["name"], text(q["default_json"]), q["description"])).alias("query"),
        F.transform("headers", lambda h: row(h["name"], blank, h["description"])).alias("headers"),
        F.when(F.col("body").isNotNull(), F.when(F.contains(F.col("body.content_type"), F.lit("json")), "json").otherwise("text")).alias("body_type"),
        F.when(F.col("body").isNotNull(), F.coalesce(pretty_json("body.example_json"), blank)).alias("body_text"),
        F.col("body.content_type").alias("body_content_type"),
    )
    refused = endpoints.filter(~ok).select(P, "id", paths.unresolved_exprs(path).alias("unresolved_exprs"))
    return requests, refused

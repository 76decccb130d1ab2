"""Saved requests: upserts from an inventory or an editor, folders, listings.

``collection_requests`` has project_id, collection, position, id, name, folder, spec_ref and
the request's own fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiquarry.operators.groups import first_per_key, last_per_key, rank_per_key

P, COLLECTION = "project_id", "collection"
KEYS = [P, COLLECTION]


def save_inventory(saved: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bring an inventory's drafts (project_id, collection, seq, spec_ref, …) into collections.

    Matched by ``spec_ref``: a match is replaced and keeps its id and any folder a person
    chose; the rest is appended. A collection row is matched once per reference, the first one;
    of several drafts for one reference the last stands. Returns (collection, report).
    """
    fields = [c for c in drafts.columns if c not in (*KEYS, "seq", "spec_ref", "folder")]
    fresh = last_per_key(drafts, [*KEYS, "spec_ref"], ["seq"])
    first = first_per_key(
        saved.filter("spec_ref is not null").select(*KEYS, "spec_ref", "position", F.lit(True).alias("_mine")),
        [*KEYS, "spec_ref"], ["position"],
    )
    kept = saved.join(first, [*KEYS, "spec_ref", "position"], "left")
    new = fresh.select(*KEYS, "spec_ref", F.lit(True).alias("_new"), F.col("folder").alias("_folder"), *[F.col(c).alias(f"_d_{c}") for c in fields])
    joined = kept.join(new, [*KEYS, "spec_ref"], "left")
    hit = F.coalesce(F.col("_mine") & F.col("_new"), F.lit(False))
    updated = joined.select(
        *KEYS, "position", "id", "spec_ref",
        F.when(hit, F.coalesce("folder", "_folder")).otherwise(F.col("folder")).alias("folder"),
        *[F.when(hit, F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c) for c in fields],
        F.when(hit, "updated").otherwise("kept").alias("action"),
    )
    known = saved.filter("spec_ref is not null").select(*KEYS, "spec_ref").distinct()
    added = rank_per_key(
        first_per_key(drafts, [*KEYS, "spec_ref"], ["seq"]).select(*KEYS, "spec_ref", "seq").join(known, [*KEYS, "spec_ref"], "left_anti"),
        KEYS, ["seq"], "_n",
    )
    ends = saved.groupBy(*KEYS).agg((F.max("position") + 1).alias("_end"))
    appended = (
        added.join(fresh.drop("seq"), [*KEYS, "spec_ref"])
        .join(ends, KEYS, "left")
        .select(
            *KEYS,
            (F.coalesce("_end", F.lit(0)) + F.col("_n") - 1).cast("bigint").alias("position"),
            F.sha2(F.concat_ws("\u0001", P, COLLECTION, "spec_ref"), 256).alias("id"),
            "spec_ref", "folder", *fields, F.lit("added").alias("action"),
        )
    )
    out = updated.withColumn("position", F.col("position").cast("bigint")).unionByName(appended)
    # Every draft counts: the first of a reference is added or updates, later ones update.
    counts = drafts.join(known.withColumn("_known", F.lit(True)), [*KEYS, "spec_ref"], "left").groupBy(*KEYS).agg(
        F.count_distinct(F.when(F.col("_known").isNull(), F.col("spec_ref"))).alias("added"), F.count("*").alias("_all")
    )
    report = counts.select(*KEYS, "added", (F.col("_all") - F.col("added")).alias("updated"))
    return out, report


def save_requests(saved: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert requests (one per id and name): by id, else onto the first row of that name, else
    appended. An update without a folder keeps the old one. ``incoming`` has ``seq``."""
    fields = [c for c in saved.columns if c not in (*KEYS, "position", "folder")]
    by_id = incoming.join(first_per_key(saved.select(*KEYS, "id", "position"), [*KEYS, "id"], ["position"]), [*KEYS, "id"], "left")
    names = saved.filter("name is not null").groupBy(*KEYS, "name").agg(F.min("position").alias("_named"))
    placed = by_id.join(names, [*KEYS, "name"], "left").withColumn("_at", F.coalesce("position", "_named")).drop("position", "_named")
    # Of several requests aimed at one row the last stands.
    updates = last_per_key(placed.filter("_at is not null"), [*KEYS, "_at"], ["seq"]).withColumnRenamed("_at", "position")
    renamed = updates.select(
        *KEYS, "position", F.lit(True).alias("_hit"), F.col("folder").alias("_folder"), *[F.col(c).alias(f"_u_{c}") for c in fields]
    )
    merged = saved.join(renamed, [*KEYS, "position"], "left").select(
        *KEYS, "position", F.coalesce("_folder", "folder").alias("folder"),
        *[F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) for c in fields],
        F.when(F.col("_hit"), "updated").otherwise("kept").alias("action"),
    )
    added = rank_per_key(placed.filter("_at is null").drop("_at"), KEYS, ["seq"], "_n")
    ends = saved.groupBy(*KEYS).agg((F.max("position") + 1).alias("_end"))
    appended = added.join(ends, KEYS, "left").select(
        *KEYS, (F.coalesce("_end", F.lit(0)) + F.col("_n") - 1).cast("bigint").alias("position"), "folder", *fields, F.lit("added").alias("action")
    )
    return merged.withColumn("position", F.col("position").cast("bigint")).unionByName(appended)


def folder_rollup(requests: DataFrame) -> DataFrame:
    """Requests per folder including everything below it; the top is the empty folder."""
    parts = F.filter(F.split(F.coalesce("folder", F.lit("")), "/", -1), lambda p: p != "")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    return requests.select(*KEYS, F.explode(prefixes).alias("folder")).groupBy(*KEYS, "folder").agg(F.count("*").alias("requests"))


def collection_sizes(requests: DataFrame) -> DataFrame:
    return requests.groupBy(*KEYS).agg(F.count("*").alias("requests"))


def document_listing(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names of each kind of document, and the number of steps of each flow."""
    steps = nodes.groupBy(P, F.col("flow").alias("name")).agg(F.count("*").alias("steps")).withColumn("kind", F.lit("flow"))
    listed = documents.select(P, "kind", "name").distinct()
    return listed.join(steps, [P, "kind", "name"], "left").select(
        P, "kind", "name", F.when(F.col("kind") == "flow", F.coalesce("steps", F.lit(0))).alias("steps")
    )


def requests_from_openapi(endpoints: DataFrame, servers: DataFrame) -> DataFrame:
    """Endpoints of a document with the base URL of its first server, else ``{{base_url}}``."""
    first = servers.groupBy(P, "document").agg(F.min_by("url", "pos").alias("base_url"))
    return endpoints.join(first, [P, "document"], "left").withColumn("base_url", F.coalesce("base_url", F.lit("{{base_url}}")))

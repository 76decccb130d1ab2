"""Bounded reachability over edge tables, all graphs in one job.

An edge table has the key columns plus ``src`` and ``dst``; keys keep graphs apart. Loops end
when a round adds nothing, and each round is checkpointed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiquarry.session import cut_lineage


def reachable(edges: DataFrame, start: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Nodes reached from ``start`` (keys + any label columns + ``node``), start included.

    Label columns tell starts apart: with a ``root`` column the result is pairs (root, node).
    """
    keys = list(keys)
    columns = start.columns
    seen = cut_lineage(start.distinct())
    frontier = seen
    hops = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("_next")).distinct()
    rounds = 0
    while limit is None or rounds < limit:
        stepped = frontier.join(hops, [*keys, "node"]).drop("node").withColumnRenamed("_next", "node")
        fresh = cut_lineage(stepped.select(*columns).distinct().join(seen, columns, "left_anti"))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        frontier = fresh
        rounds += 1
    return seen


def least_ancestor(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """For each node the least ``label`` among itself and all its ancestors.

    ``nodes`` has keys, ``node`` and ``label`` (NULL = the node passes labels on but has none).
    """
    keys = list(keys)
    current = cut_lineage(nodes.select(*keys, "node", label))
    hops = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("_next")).distinct()
    changed = current.filter(F.col(label).isNotNull())
    while True:
        offered = (
            changed.join(hops, [*keys, "node"])
            .groupBy(*keys, F.col("_next").alias("node"))
            .agg(F.min(label).alias("_offer"))
        )
        better = F.col("_offer").isNotNull() & (F.col(label).isNull() | (F.col("_offer") < F.col(label)))
        joined = current.join(offered, [*keys, "node"], "left").withColumn("_better", better)
        state = cut_lineage(
            joined.select(
                *keys,
                "node",
                F.when(F.col("_better"), F.col("_offer")).otherwise(F.col(label)).alias(label),
                F.col("_better"),
            )
        )
        changed = state.filter("_better").drop("_better")
        current = state.drop("_better")
        if changed.isEmpty():
            return current


def components(edges: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Undirected components: keys, ``node``, ``component`` (the least node in it).

    Each round takes the least label around a node and then jumps to that label's own label,
    so long chains close in logarithmically many rounds.
    """
    keys = list(keys)
    both = edges.select(*keys, "src", "dst").unionByName(
        edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    both = cut_lineage(both.distinct())
    labels = cut_lineage(nodes.select(*keys, "node").distinct().withColumn("component", F.col("node")))
    while True:
        offered = (
            both.withColumnRenamed("dst", "node")
            .join(labels, [*keys, "node"])
            .groupBy(*keys, F.col("src").alias("node"))
            .agg(F.min("component").alias("_offer"))
        )
        near = labels.join(offered, [*keys, "node"], "left").select(
            *keys, "node", F.col("component").alias("_was"), F.least("component", "_offer").alias("component")
        )
        near = cut_lineage(near)
        jump = near.select(*keys, F.col("node").alias("component"), F.col("component").alias("_jump"))
        state = cut_lineage(
            near.join(jump, [*keys, "component"], "left").select(
                *keys, "node", "_was", F.least("component", "_jump").alias("component")
            )
        )
        labels = state.drop("_was")
        if state.filter(F.col("_was") != F.col("component")).isEmpty():
            return labels

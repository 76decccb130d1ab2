"""Connected components of a large graph by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiquarry.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(x, y)`` → ``node, comp``: each node with the smallest node it is connected to.

    Every round takes the least label among the neighbours and then the label of that label, so the
    number of rounds grows with the logarithm of the longest chain. Labels of a hub's neighbours
    are combined before the shuffle.
    """
    both = cut_lineage(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    # the first round is the least neighbour, which needs no join
    labels = cut_lineage(both.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("comp")))
    kind = labels.schema["comp"].dataType
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), F.col("comp").alias("near")), "y").select(F.col("x").alias("node"), "near", F.lit(None).cast(kind).alias("was"))
        # a node's own label goes the same way as its neighbours': one exchange for both
        seen = near.unionByName(labels.select("node", F.col("comp").alias("near"), F.col("comp").alias("was")))
        lower = seen.groupBy("node").agg(F.min("near").alias("low"), F.max("was").alias("was"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("lower"))
        moved = cut_lineage(lower.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("comp"), "was"))
        labels = moved.select("node", "comp")
        if moved.filter("comp <> was").isEmpty():
            return labels


def join_components(known: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels ``node, comp`` after further ``edges(x, y)``: only the components that these join are looked at."""
    of = known.select(F.col("node").alias("x"), F.col("comp").alias("cx"))
    ends = edges.join(of, "x", "left").join(of.toDF("y", "cy"), "y", "left")
    between = cut_lineage(ends.select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y"), F.col("x").alias("px"), F.col("y").alias("py")))
    joined = connected_components(between.filter("x <> y").select("x", "y"))
    # nodes that no link named before are components of their own
    fresh = between.filter("x = px").select(F.col("px").alias("node")).unionByName(between.filter("y = py").select(F.col("py").alias("node"))).distinct()
    every = known.unionByName(fresh.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp")))
    return cut_lineage(
        every.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("least")), "comp", "left").select("node", F.coalesce("least", "comp").alias("comp"))
    )

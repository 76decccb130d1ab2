"""Picks within groups that stay safe when one group holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apiquarry.session import cut_lineage

SALTS = 64


def _pick(df: DataFrame, keys: list[str], order: list[Column], choose) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    best = choose(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row of each key. An aggregate, so a hot key is combined before the shuffle."""
    return _pick(df, keys, [F.col(o) if isinstance(o, str) else o for o in order], F.min_by)


def last_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return _pick(df, keys, [F.col(o) if isinstance(o, str) else o for o in order], F.max_by)


def top_k_per_key(
    df: DataFrame, keys: list[str], order: list[Column], k: int, tie: list[str], rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each key with their rank.

    Up to a thousand Spark itself limits each group before the shuffle. Beyond, the rows of a
    key are first ranked inside ``SALTS`` sub-groups, so the last window sees at most
    ``SALTS * k`` rows of any key.
    """
    if k > 1000:
        salt = F.pmod(F.xxhash64(*tie), F.lit(SALTS))
        inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(inner))
        df = df.filter(F.col("_r") <= k).drop("_r", "_salt")
    outer = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= k)


def rank_per_key(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """Row number within each key, for keys of any size.

    Rows are range-partitioned by key and order, numbered inside each (key, range) and lifted
    by the size of the ranges before. No task sees more than one range of a hot key.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    )
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    lifts = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lift"))
    numbered = ranged.withColumn("_r", F.row_number().over(within))
    return (
        numbered.join(lifts, [*keys, "_range"])
        .withColumn(rank, (F.col("_r") + F.col("_lift")).cast("bigint"))
        .drop("_r", "_lift", "_range")
    )

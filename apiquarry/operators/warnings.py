"""What a scan complained about, per project: how often, and the first few examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P = "project_id"
#: Parts of a project within which examples are ranked first.
SALTS = 64


def first_texts(rows: DataFrame, keys: list[str], text: str, order: list[str], n: int) -> DataFrame:
    """``keys``, ``examples``: the first ``n`` texts of each key by ``order``, then by text.

    Rows are ranked inside salted parts of a key, where all but ``n`` go, and only what is left is ranked
    whole, so a key with most of the rows is no task of its own.
    """
    by: list[Column | str] = [*order, text]
    salted = rows.select(*keys, *order, text, F.pmod(F.xxhash64(*order, text), F.lit(SALTS)).alias("_salt"))
    near = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*by))).filter(F.col("_r") <= n)
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("_r") <= n)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(text).alias("text")))).alias("e")).select(*keys, F.col("e.text").alias("examples"))


def summarise(warnings: DataFrame, n: int = 3, text: str = "message", kind: str = "kind", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``project_id, warnings, kinds, examples, summary`` for each project with warnings.

    ``kinds`` counts each kind (``array<struct<kind,n>>``, most frequent first, then by name), ``examples`` are the first
    ``n`` texts by ``order``, and ``summary`` says both in a line. NULL texts count, but are no examples; kinds may be NULL.
    """
    counts = warnings.groupBy(P, F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    kinds = counts.groupBy(P).agg(F.sum("n").alias("warnings"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "kind", "n"))).alias("k"))
    kinds = kinds.select(P, "warnings", F.transform("k", lambda x: F.struct(x["kind"].alias("kind"), x["n"].alias("n"))).alias("kinds"))
    found = first_texts(warnings.filter(F.col(text).isNotNull()), [P], text, list(order), n)
    joined = kinds.join(found, P, "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    said = F.concat(F.col("warnings").cast("string"), F.lit(" scan warning(s)"))
    shown = F.when(F.size("examples") > 0, F.concat(said, F.lit(", e.g.: "), F.array_join("examples", " | "))).otherwise(said)
    return joined.withColumn("summary", shown)

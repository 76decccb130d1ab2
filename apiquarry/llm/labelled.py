"""Bounded samples of labelled rows for fitting, and the split that keeps a fifth of the ids out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents with this remainder of crc32(id as text) are never learned from.
HELD_OUT, FOLDS = 0, 5


def held_out(key: Column) -> Column:
    """True for ids that are never learned from; False for NULL ids, which no label names."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, y, body`` for at most ``rows`` labelled ids outside the held-out fold.

    The ids with the smallest hashes are taken, so the choice does not depend on the order of rows.
    Labels other than 0 and 1 are ignored; several labels of an id are averaged.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("bigint").alias("l_id"))
        .agg(F.avg(label).alias("y"))
    )
    chosen = known.orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), body.alias("body"))
    # at most ``rows`` pairs of numbers: a fixed bound for the broadcast
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("doc_id", "y", "body")

"""Picking whole input rows by what an operator decided about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick_rows(docs: DataFrame, stays: DataFrame, key: str, digest: Column) -> DataFrame:
    """Rows of ``docs`` whose (id, digest of the text) is in ``stays(doc_id, digest, copies)``.

    Where ``copies`` says that an (id, digest) occurs more than once, one of its rows is returned.
    All columns are packed into one struct meanwhile, so their names clash with nothing.
    """
    stays = stays.select(F.col("doc_id").alias("_s_id"), F.col("digest").alias("_s_digest"), F.col("copies").alias("_s_copies"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    marked = docs.select(row, F.col(f"`{key}`").cast("bigint").alias("_id"), digest.alias("_digest"))
    kept = marked.join(stays, (F.col("_digest") == F.col("_s_digest")) & F.col("_id").eqNullSafe(F.col("_s_id")))
    single = kept.filter("_s_copies = 1").select("_row")
    first = kept.filter("_s_copies > 1").groupBy("_id", "_digest").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row")
    return single.unionByName(first).select("_row.*")


#: Bits of the filter below: 2 MB, whatever the number of ids.
FILTER_BITS = 1 << 24


def maybe_in(docs: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key may be in the only column of ``ids``; no row whose key is in it is lost.

    A bitmap of the hashed ids, of a fixed size, is broadcast, so texts that no one asked for are dropped
    where they are read. Where there are more ids than bits it lets everything pass.
    """
    name = ids.columns[0]

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1

    bits = (
        ids.select(place(F.col(name)).alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    )
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2.0), at % 8)) % 2 == 1
    return docs.join(F.broadcast(bits), F.bitmap_bucket_number(place(key)) == F.col("_bucket")).filter(hit).select(*[docs[f"`{c}`"] for c in docs.columns])

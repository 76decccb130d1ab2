"""Giving the rows of a large table what a small one holds for their key, without moving the large one by that key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiquarry.session import cut_lineage

#: A small side up to this size (as JSON text) is broadcast.
BROADCAST_BYTES = 64 << 20
#: Copies of each of its rows otherwise.
COPIES = 64


def size_of(small: DataFrame) -> int:
    """Bytes of a table as JSON text, by one aggregate."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in small.columns]))
    return small.agg(F.coalesce(F.sum(F.octet_length(row).cast("bigint")), F.lit(0))).first()[0]


def attach(df: DataFrame, small: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """``df`` left-joined with ``small``, one row per key, on a few keys that may be very hot.

    The size of ``small`` is measured. Up to ``limit`` bytes (``BROADCAST_BYTES``) it is broadcast and the large
    table stays where it is. Beyond, each of its rows is copied ``COPIES`` times and the large table is dealt by
    key and a salt that comes from all columns of a row, so one key is spread over ``COPIES`` tasks.
    """
    small = cut_lineage(small)
    if size_of(small) <= (BROADCAST_BYTES if limit is None else limit):
        return df.join(F.broadcast(small), keys, "left")
    salt = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType.simpleString())]), F.lit(COPIES))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(COPIES - 1).cast("bigint"))))
    return df.withColumn("_salt", salt).join(copies.hint("shuffle_hash"), [*keys, "_salt"], "left").drop("_salt")


def _hashable(kind: str) -> bool:
    return not any(word in kind for word in ("map<", "variant"))

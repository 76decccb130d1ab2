"""Exact duplicates by polynomial fingerprints that are summed from chunk hashes.

A text of bytes ``b_0 … b_n-1`` has the fingerprint ``sum (b_i + 1) * B^(n-1-i)`` modulo a prime,
for two primes at once. A chunk contributes its own hash shifted by ``B^(bytes after it)``, and
these contributions are added: a document is hashed chunk by chunk, on as many tasks as hold its
chunks, and the sum is combined before the shuffle. Texts with equal fingerprint and length are
then compared chunk by chunk: a chunk position of a group is the same in all its members exactly if
its least and its greatest content agree, which is an aggregate and needs no pairs, however large
the group. Groups that fail (a collision) are split by SHA-256.

Defined results. A NULL text counts as empty; empty texts are equal to each other. NULL ids are
allowed: the smallest id of a group ignores them, and a group of NULL ids only keeps one of its rows.
Repeated rows (same id, same text) are copies like any other: the first of them may stay. An id with
two texts is two documents. Further columns, whatever their names, are passed through by
``keep_first`` and not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apiquarry.llm.rows import maybe_in, pick_rows
from apiquarry.session import cut_lineage

#: (prime, base) of the two fingerprints.
FIELDS = ((2147483647, 1000003), (2147483629, 998244353))
CHUNK_BYTES = 1 << 16


def normal_text(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; NULL becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _powers(prime: int, base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.int64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * pow(base, done, prime) % prime
        done += more
    return out


def chunk_hash(data: bytes, prime: int, powers: np.ndarray) -> int:
    """Hash of one chunk of at most ``CHUNK_BYTES`` bytes; the products cannot overflow."""
    values = np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 1
    return int(values @ powers[: len(values)][::-1]) % prime


@F.pandas_udf(T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))
def _shifted_hashes(chunk: pd.Series, after: pd.Series) -> pd.DataFrame:
    tables = [_powers(p, b, CHUNK_BYTES) for p, b in FIELDS]
    out = np.empty((len(chunk), 2), dtype=np.int64)
    for i, (data, rest) in enumerate(zip(chunk, after)):
        for j, ((p, b), powers) in enumerate(zip(FIELDS, tables)):
            h = chunk_hash(data, p, powers)
            out[i, j] = h * pow(b, int(rest), p) % p if rest else h
    return pd.DataFrame({"h1": out[:, 0], "h2": out[:, 1]})


def _hashed(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(
        F.col(f"`{key}`").cast("bigint").alias("doc_id"), normal_text(F.col(f"`{text}`")).cast("binary").alias("bytes")
    ).select("doc_id", F.sha2("bytes", 256).alias("sha"), F.octet_length("bytes").cast("bigint").alias("n"), "bytes")


def _chunks(hashed: DataFrame, *carry: str) -> DataFrame:
    """One row per chunk; an empty text has one empty chunk."""
    last = F.expr(f"greatest(0, (n + {CHUNK_BYTES - 1}) div {CHUNK_BYTES} - 1)")
    cut = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.substring("bytes", i * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)))
    return hashed.select(*carry, F.posexplode(cut).alias("k", "chunk"))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, sha, n, h1, h2, copies``: one row per distinct (id, text), with its number of rows."""
    chunks = _chunks(_hashed(docs, text, key), "doc_id", "sha", "n")
    after = F.col("n") - F.col("k") * CHUNK_BYTES - F.octet_length("chunk")
    terms = chunks.select("doc_id", "sha", "n", "k", _shifted_hashes("chunk", after).alias("t"))
    summed = terms.groupBy("doc_id", "sha", "n").agg(
        F.sum("t.h1").alias("s1"), F.sum("t.h2").alias("s2"), F.count_if(F.col("k") == 0).alias("copies")
    )
    # repeated rows add the same terms once more, so the sum is a whole multiple
    return summed.select(
        "doc_id", "sha", "n", F.expr(f"(s1 div copies) % {FIELDS[0][0]}").alias("h1"), F.expr(f"(s2 div copies) % {FIELDS[1][0]}").alias("h2"), "copies"
    )


def _collisions(docs: DataFrame, prints: DataFrame, text: str, key: str) -> DataFrame:
    """Fingerprints (n, h1, h2) under which not all texts are the same."""
    shared = cut_lineage(prints.groupBy("n", "h1", "h2").agg(F.count("*").alias("members")).filter("members > 1"))
    suspects = cut_lineage(prints.join(shared, ["n", "h1", "h2"], "left_semi").select(F.col("doc_id").alias("s_id"), F.col("sha").alias("s_sha"), "h1", "h2"))
    hashed = _hashed(maybe_in(docs, F.col(f"`{key}`").cast("bigint"), suspects.select("s_id")), text, key)
    again = hashed.join(suspects, (hashed.sha == suspects.s_sha) & hashed.doc_id.eqNullSafe(suspects.s_id))
    compared = _chunks(again, "n", "h1", "h2").groupBy("n", "h1", "h2", "k").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    return compared.filter("lo <> hi").select("n", "h1", "h2").distinct()


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, sha, copies, keep_id, group_size, keeps``, one row per distinct (id, text).

    ``keeps`` says that one row of this (id, text) is the one that stays.
    """
    prints = cut_lineage(fingerprints(docs, text, key))
    split = cut_lineage(_collisions(docs, prints, text, key)).withColumn("split", F.lit(True))
    # copies of a text are combined before anything is dealt by fingerprint
    texts = prints.groupBy("n", "h1", "h2", "sha").agg(F.min("doc_id").alias("least"), F.sum("copies").alias("rows"), F.count("*").alias("ids"))
    parted = texts.join(split, ["n", "h1", "h2"], "left").withColumn("part", F.when(F.col("split"), F.col("sha")).otherwise(""))
    # one text under an unsplit fingerprint, and one a part under a split one
    shared = (
        parted.groupBy("n", "h1", "h2", "part")
        .agg(F.min("sha").alias("sha"), F.min("least").alias("keep_id"), F.sum("rows").alias("group_size"), F.sum("ids").alias("members"))
        .filter("members > 1")
        .drop("members", "part")
    )
    # cut, so that the join below has an exchange on either side and a hot group can be split
    found = prints.join(cut_lineage(shared), ["n", "h1", "h2", "sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", "sha", "copies", keep.alias("keep_id"), F.coalesce("group_size", "copies").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("keeps")
    )


def duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = exact_groups(docs, text, key).select("*", F.posexplode(F.sequence(F.lit(1), F.col("copies"))).alias("nth", "_"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("keeps") & (F.col("nth") == 0)).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stays = exact_groups(docs, text, key).filter("keeps").select("doc_id", F.col("sha").alias("digest"), "copies")
    return pick_rows(docs, stays, key, F.sha2(normal_text(F.col(f"`{text}`")).cast("binary"), 256))

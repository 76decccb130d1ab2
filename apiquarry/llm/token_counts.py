"""Token counts of documents in flat token files that have no index.

A flat file is nothing but token ids of a fixed width, one document behind the other, each closed by a
separator id. It is read in blocks. Each block is searched for the separator at once, and is summed up by
the number of its tokens and separators and the place of its last one. A prefix scan of these sums in the order
of the blocks gives, for every block, how many documents ended before it and where the open one began, which
is all that is needed to number its documents and to complete the first. The scan has two levels, groups of
``GROUP`` blocks and the blocks inside, so a file of any size is no task of its own.

``write_token_files`` makes such files from documents: one per partition, as a Parquet dataset of blocks cut
without regard to documents, with a list of the documents' ids beside them, in order; ``read_flat_files`` reads
plain binary files.

Defined results: a NULL or empty text is a document of 0 tokens; separators that follow each other enclose
documents of 0 tokens; tokens behind the last separator of a file are a document with ``closed`` false; an
empty file has no documents. A text that spells the separator is encoded as ordinary text. NULL ids and
repeated rows are documents of their own. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apiquarry.llm.bpe import PieceCache, load

#: Tokens in a block, and blocks in a group of the scan.
BLOCK, GROUP = 1 << 18, 1024
#: Ids in a row of the list of documents.
NAMES = 8192
WIDTHS = {2: "<u2", 4: "<u4"}


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, separator: int, width: int = 2, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> None:
    """Write ``folder/blocks`` (file, block, tokens) and ``folder/names`` (file, first, ids)."""
    if separator >= 256**width:
        raise ValueError("the separator does not fit the width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        cache = PieceCache(bpe)
        file, number, first = TaskContext.get().partitionId(), 0, 0
        waiting, size, names = [], 0, []

        def row(at: int | None, tokens: bytes | None, start: int | None, ids: list | None) -> pa.RecordBatch:
            arrays = [pa.array([file], pa.int64()), pa.array([at], pa.int64()), pa.array([tokens], pa.binary()), pa.array([start], pa.int64()), pa.array([ids], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=["file", "block", "tokens", "first", "ids"])

        for batch in batches:
            for name, body in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = bpe.encode(body.as_py() or "", cache, special=False)
                waiting.append(np.append(ids, separator).astype(WIDTHS[width]))
                size += len(waiting[-1])
                names.append(name)
                if size >= block:
                    tokens = np.concatenate(waiting)
                    for at in range(0, size - block + 1, block):
                        yield row(number, tokens[at : at + block].tobytes(), None, None)
                        number += 1
                    waiting = [tokens[size - size % block :]]
                    size %= block
                if len(names) == NAMES:
                    yield row(None, None, first, names)
                    first, names = first + len(names), []
        if size:
            yield row(number, np.concatenate(waiting).tobytes(), None, None)
        if names:
            yield row(None, None, first, names)

    slim = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = slim.mapInArrow(run, "file bigint, block bigint, tokens binary, first bigint, ids array<bigint>")
    rows.withColumn("part", F.when(F.col("block").isNull(), "names").otherwise("blocks")).write.option("compression", "zstd").partitionBy("part").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Blocks and names of a folder that ``write_token_files`` wrote."""
    rows = spark.read.schema("file bigint, block bigint, tokens binary, first bigint, ids array<bigint>, part string").parquet(folder)
    return rows.filter("part = 'blocks'").select("file", "block", "tokens"), rows.filter("part = 'names'").select("file", "first", "ids")


def read_flat_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """``file, block, tokens`` of plain binary files, each up to Spark's limit for a binary value."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    step = block * width
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"CAST((length - 1) div {step} AS INT)")), lambda i: F.substring("content", i * step + 1, F.lit(step)))
    return files.select(F.col("path").alias("file"), F.posexplode(cut).alias("block", "tokens"))


def _scanned(blocks: DataFrame, separator: int, width: int) -> DataFrame:
    """Per block: its tokens ``n``, separators ``seps``, places ``head`` and ``last`` of the first and last, and the
    lengths of the documents that begin and end in it, with the separators ``seps_at`` before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts, heads, lasts, inner, places = [], [], [], [], [], []
            for data in batch.column("tokens"):
                tokens = np.frombuffer(data.as_buffer(), dtype=WIDTHS[width])
                at = np.flatnonzero(tokens == separator)
                sizes.append(len(tokens))
                counts.append(len(at))
                heads.append(int(at[0]) if len(at) else None)
                lasts.append(int(at[-1]) if len(at) else None)
                inner.append((np.diff(at) - 1).astype(np.int32))
                places.append(at[:-1].astype(np.int32))
            offsets = pa.array(np.cumsum([0, *map(len, inner)], dtype=np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.empty(0, np.int32))) for x in (inner, places)]
            arrays = [batch.column("file"), batch.column("block"), *(pa.array(x, pa.int64()) for x in (sizes, counts, heads, lasts)), *lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["file", "block", "n", "seps", "head", "last", "lengths", "seps_at"])

    kind = dict(blocks.dtypes)["file"]
    slim = blocks.select("file", F.col("block").cast("bigint").alias("block"), "tokens")
    return slim.mapInArrow(run, f"file {kind}, block bigint, n bigint, seps bigint, head bigint, last bigint, lengths array<int>, seps_at array<int>")


def document_lengths(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """``file, ordinal, first_token, n_tokens, closed`` per document of ``blocks(file, block, tokens)``."""
    found = _scanned(blocks, separator, width).withColumn("group", F.expr(f"block div {GROUP}"))
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # places are relative to the group until the second level lifts them
    local = found.withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("end", F.col("start") + F.col("last"))
    local = local.withColumn("before", F.coalesce(F.sum("seps").over(inside), F.lit(0))).withColumn("open", F.max("end").over(inside))
    groups = local.groupBy("file", "group").agg(F.sum("n").alias("g_n"), F.sum("seps").alias("g_seps"), F.max("end").alias("g_end"))
    across = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    lifted = groups.withColumn("g_start", F.coalesce(F.sum("g_n").over(across), F.lit(0))).withColumn("g_before", F.coalesce(F.sum("g_seps").over(across), F.lit(0)))
    lifted = lifted.withColumn("g_end", F.col("g_start") + F.col("g_end")).withColumn("g_open", F.max("g_end").over(across))
    joined = local.join(lifted.select("file", "group", "g_start", "g_before", "g_open"), ["file", "group"])
    start = F.col("g_start") + F.col("start")
    opened = F.coalesce(F.col("g_start") + F.col("open"), F.col("g_open"), F.lit(-1)) + 1
    # the first document of a block may begin in an earlier one, the others behind the separator before them
    places = F.concat(F.array(opened), F.transform("seps_at", lambda p: start + p + 1))
    sizes = F.concat(F.array(start + F.col("head") - opened), F.col("lengths").cast("array<bigint>"))
    whole = joined.filter("seps > 0").select("file", (F.col("g_before") + F.col("before")).alias("base"), F.posexplode(F.arrays_zip(places.alias("at"), sizes.alias("n"))).alias("i", "d"))
    closed = whole.select("file", (F.col("base") + F.col("i")).alias("ordinal"), F.col("d.at").alias("first_token"), F.col("d.n").alias("n_tokens"), F.lit(True).alias("closed"))
    ends = lifted.groupBy("file").agg(F.max(F.col("g_start") + F.col("g_n")).alias("total"), F.max("g_end").alias("end"), F.sum("g_seps").alias("ordinal"))
    rest = ends.withColumn("first_token", F.coalesce(F.col("end"), F.lit(-1)) + 1).withColumn("n_tokens", F.col("total") - F.col("first_token")).filter("n_tokens > 0")
    return closed.unionByName(rest.select("file", "ordinal", "first_token", "n_tokens", F.lit(False).alias("closed")))


def token_counts(docs: DataFrame, folder: str, tokenizer: str, separator: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, file, ordinal, first_token, n_tokens``: documents are written to flat files in ``folder``, and what
    the scan of the files finds is named by the lists beside them."""
    write_token_files(docs, folder, tokenizer, separator, text=text, key=key)
    blocks, names = read_token_files(docs.sparkSession, folder)
    named = names.select("file", "first", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return document_lengths(blocks, separator).join(named, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "first_token", "n_tokens")

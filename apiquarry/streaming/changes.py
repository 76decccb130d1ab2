"""Workspace change feeds: bursts of file events, and one's own writes coming back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

P = "project_id"

# The silence that ends a burst, and where each kind of document lives.
SETTLE = "200 milliseconds"
KINDS = {"flows": "flow", "collections": "collection", "environments": "environment"}


def classify(path: Column) -> Column:
    """``struct<kind,name>`` of a changed path, or NULL for anything but a document."""
    file = F.substring_index(path, "/", -1)
    folder = F.lower(F.get(F.reverse(F.split(path, "/", -1)), F.lit(1)))
    stem = F.regexp_extract(file, r"^(.+)\.(yaml|yml)$", 1)
    kind = F.when(file == "workspace.yaml", "workspace")
    for directory, name in KINDS.items():
        kind = F.when((folder == directory) & (stem != ""), name).otherwise(kind)
    return F.when(
        ~file.startswith(".") & kind.isNotNull(),
        F.struct(kind.alias("kind"), F.when(kind == "workspace", "").otherwise(stem).alias("name")),
    )


def coalesce_changes(changes: DataFrame, watermark: str = "10 seconds", settle: str = SETTLE) -> DataFrame:
    """Bursts of changes, each document once per burst: project_id, burst start and end,
    ``documents``.

    Works on a stream and on a table. On a stream a row later than the watermark is dropped.
    """
    known = changes.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("c", classify(F.col("path"))).filter("c is not null")
    item = F.struct(F.col("c.kind").alias("kind"), F.col("c.name").alias("name"), "removed")
    return (
        known.withWatermark("ts", watermark)
        .groupBy(P, F.session_window("ts", settle).alias("burst"))
        .agg(F.array_sort(F.collect_set(item)).alias("documents"))
        .select(P, F.col("burst.start").alias("started"), F.col("burst.end").alias("ended"), "documents")
    )


def fingerprint(content: Column, removed: Column) -> Column:
    """What a write leaves behind: a content hash, 0 for a deletion."""
    return F.when(removed, F.lit(0).cast("bigint")).otherwise(F.xxhash64(content))


def document_key(path: Column) -> Column:
    """The last folder and the file name, without case: the same document on any file system."""
    parts = F.split(F.lower(path), "/", -1)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.least(F.size(parts), F.lit(3))), "/")


def suppress_echo(changes: DataFrame, writes: DataFrame) -> DataFrame:
    """Changes that are not just this writer's own last write of the document coming back.

    ``writes`` has project_id, path, content, removed, written_at; the latest write before the
    whole batch counts.
    """
    last = writes.groupBy(P, document_key(F.col("path")).alias("_key")).agg(
        F.max_by(fingerprint(F.col("content"), F.col("removed")), "written_at").alias("_print")
    )
    return (
        changes.withColumn("_key", document_key(F.col("path")))
        .withColumn("_print", fingerprint(F.col("content"), F.col("removed")))
        .join(last, [P, "_key", "_print"], "left_anti")
        .drop("_key", "_print")
    )


class EchoFilter(StatefulProcessor):
    """Remembers per document the fingerprint this writer last left; lets other changes pass."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "print bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self._last.get()[0] if self._last.exists() else None
        for batch in rows:
            ordered = batch.sort_values("seq")
            prints = ordered["print"].astype("Int64")
            # the own write that each row comes after
            before = prints.where(ordered["own_write"]).ffill()
            if last is not None:
                before = before.fillna(last)
            passed = ~ordered["own_write"].astype(bool) & (before.isna() | (prints != before)).astype(bool)
            if len(before) and not pd.isna(before.iloc[-1]):
                last = int(before.iloc[-1])
            yield ordered.loc[passed, ["project_id", "path", "removed", "seq"]]
        if last is not None:
            self._last.update((last,))

    def close(self) -> None:
        pass


def suppress_echo_stream(feed: DataFrame) -> DataFrame:
    """The same on a stream of own writes and observed changes (``own_write`` tells them apart,
    ``seq`` orders them)."""
    keyed = feed.withColumn("doc", F.concat_ws("\u0001", P, document_key(F.col("path")))).withColumn(
        "print", fingerprint(F.col("content"), F.col("removed"))
    )
    return (
        keyed.select("doc", P, "path", "removed", "own_write", "seq", "print")
        .groupBy("doc")
        .transformWithStateInPandas(
            EchoFilter(), "project_id string, path string, removed boolean, seq bigint", "append", "none"
        )
    )

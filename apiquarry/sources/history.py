"""The exchange log: rows out of exchanges, redacted appends, newest-first reads, pruning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiquarry.operators.groups import top_k_per_key
from apiquarry.operators.redact import redact_history

P = "project_id"
COLUMNS = [P, "id", "at", "method", "url", "status", "duration_ms", "error", "request", "response", "source"]


def history_rows(exchanges: DataFrame) -> DataFrame:
    """Exchange or error to a history row.

    ``exchanges`` has id, at (timestamp), method, url, draft, request, response (JSON texts),
    status, total_ms, error. A step that never reached the wire has neither and yields no row.
    """
    answered = F.col("status").isNotNull()
    return exchanges.filter(answered | F.col("error").isNotNull()).select(
        P,
        "id",
        F.unix_timestamp(F.col("at").cast("timestamp")).alias("at"),
        "method",
        "url",
        "status",
        F.when(answered, F.col("total_ms")).alias("duration_ms"),
        F.when(~answered, F.col("error")).alias("error"),
        F.when(answered, F.col("request")).otherwise(F.col("draft")).alias("request"),
        F.when(answered, F.col("response")).alias("response"),
        "source",
    )


class RedactedHistory:
    """History rows that went through redaction; the only thing the writer takes. Made by ``of`` alone."""

    __slots__ = ("rows",)

    def __init__(self) -> None:
        raise TypeError("use RedactedHistory.of")

    @classmethod
    def of(cls, history: DataFrame, secrets: DataFrame) -> RedactedHistory:
        """Rows without a project have no secrets to look for, so they stop the write."""
        named = F.when(F.col(P).isNull(), F.raise_error(F.lit("a history row has no project"))).otherwise(F.col(P))
        made = object.__new__(cls)
        made.rows = redact_history(history.withColumn(P, named), secrets).select(*COLUMNS)
        return made


def append_history(redacted: RedactedHistory, path: str, batch: str | None = None) -> None:
    """Append to the Parquet log at ``path``, partitioned by batch and day.

    A batch is written into a folder of its own, which is replaced if it is written again: a stream names
    it by its epoch, so a replay changes nothing, and batch and stream writers share one log.
    """
    if not isinstance(redacted, RedactedHistory):
        raise TypeError("only redacted rows may be written")
    dated = redacted.rows.withColumn("date", F.to_date(F.timestamp_seconds("at")))
    dated.write.mode("overwrite").partitionBy("date").parquet(f"{path}/batch={batch or uuid.uuid4().hex}")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the log, whoever wrote it; a range of days reads only its days."""
    return spark.read.parquet(path).drop("batch")


def clear_history(spark: SparkSession, path: str) -> None:
    """Remove every row; the log stays readable and can be appended to."""
    schema = read_history(spark, path).drop("date").schema
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{path}/batch=none/date=1970-01-01")


def recent(history: DataFrame, limit: int) -> DataFrame:
    """Newest first; the limit is taken per task before anything is gathered."""
    return history.orderBy(F.desc("id")).limit(limit)


def entry(history: DataFrame, id_: int) -> DataFrame:
    return history.filter(F.col("id") == id_)


def prune(history: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(rows kept, removed per project): the newest ``keep`` of each project stay."""
    rest = [c for c in history.columns]
    kept = top_k_per_key(history, [P], [F.desc("id")], keep, ["id"], "_r").select(*rest)
    removed = history.groupBy(P).agg(F.greatest(F.count("*") - F.lit(keep), F.lit(0)).alias("removed"))
    return kept, removed


def history_count(history: DataFrame) -> DataFrame:
    return history.groupBy(P).agg(F.count("*").alias("entries"))

"""Streams into the history log and past the allow list."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from apiquarry.operators.traffic import check_allowed
from apiquarry.sources.history import RedactedHistory, append_history, history_rows


def ingest_history(exchanges: DataFrame, secrets: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append every finished send, redacted, success or failure, with a static secret store."""
    return ingest_history_batches(exchanges, lambda: secrets, path, checkpoint, **trigger)


def ingest_history_batches(
    exchanges: DataFrame, read_secrets: Callable[[], DataFrame], path: str, checkpoint: str, **trigger: object
) -> StreamingQuery:
    """The same with the secret store read afresh for each micro-batch, for stores that change while the
    stream runs. Each epoch has its own folder in the log, so a replayed one is written once."""
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, epoch: int) -> None:
        append_history(RedactedHistory.of(history_rows(batch), read_secrets()), path, f"{stream}-{epoch}")

    return (
        exchanges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def policy_stream(
    calls: DataFrame, read_rules: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Check each call against the allow list as it stands when its batch starts."""

    def judge(batch: DataFrame, epoch: int) -> None:
        write(check_allowed(batch, read_rules()), epoch)

    return calls.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

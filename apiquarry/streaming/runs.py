"""Live state of flow runs from their event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiquarry.operators.flows import edge_state

KEYS = ["project_id", "run_id"]


def node_events(events: DataFrame) -> DataFrame:
    """Run events as one row per node: project_id, run_id, node_id, seq, status, reason_kind,
    branch.

    ``started`` lists the order (``nodes``), ``node_started`` and ``node_finished`` name one
    node, ``finished`` carries every result (``results``). A later event of a node replaces
    the earlier, which is what a finished run does to all of its nodes.
    """
    cell = "struct<node_id:string,status:string,reason_kind:string,branch:string>"
    none = F.lit(None).cast("string")
    pending = F.transform(
        "nodes", lambda n: F.struct(n.alias("node_id"), F.lit("pending").alias("status"), none.alias("reason_kind"), none.alias("branch"))
    )
    one = F.array(
        F.struct(
            F.col("node").alias("node_id"), F.when(F.col("event") == "node_started", "running").otherwise(F.col("status")).alias("status"),
            F.when(F.col("event") == "node_finished", F.col("reason_kind")).alias("reason_kind"),
            F.when(F.col("event") == "node_finished", F.col("branch")).alias("branch"),
        )
    )
    cells = (
        F.when(F.col("event") == "started", pending.cast(f"array<{cell}>"))
        .when(F.col("event") == "finished", F.col("results").cast(f"array<{cell}>"))
        .otherwise(one.cast(f"array<{cell}>"))
    )
    return events.select(*KEYS, "seq", F.explode(cells).alias("c")).select(*KEYS, "seq", "c.*")


def live_run_state(events: DataFrame) -> DataFrame:
    """Latest status of every node of every run; use update or complete mode on a stream."""
    latest = F.max_by(F.struct("status", "reason_kind", "branch"), "seq").alias("s")
    return node_events(events).groupBy(*KEYS, "node_id").agg(latest).select(*KEYS, "node_id", "s.*")


def live_edge_state(state: DataFrame, edges: DataFrame) -> DataFrame:
    """How each edge of each run stands. In a stream, call it from ``foreachBatch`` with the
    state table; ``edges`` carries the run keys."""
    return edge_state(edges, state, KEYS)

"""Registry of queries over the given tables and the tables they are derived into.

Every query reads whole tables. The domain tables (exchanges, fact tables, flows …) are fixed
projections of the given ones; the SQL beside a query repeats the projection, or states what
the operator must yield for it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from apiquarry.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as recorded exchanges; a fifth of them never got an answer."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('p', user_id % 7) AS project_id",
        "event_id AS id",
        "ts AS at",
        "CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST' WHEN 'signup' THEN 'PUT' "
        "WHEN 'purchase' THEN 'PATCH' ELSE 'DELETE' END AS method",
        "concat('http://api.example.com/api/v1/users/', user_id, '/', event_type, '?k=', get_json_object(props, '$.k')) AS url",
        "CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 201 WHEN 'signup' THEN 302 WHEN 'purchase' THEN 404 END AS status",
        "CAST(floor(value * 10) AS BIGINT) AS total_ms",
        "props AS body",
        "event_type",
        "user_id",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
    )


EX = """ex AS (SELECT 'p' || (user_id % 7) AS project_id, event_id AS id, ts AS "at",
 CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST' WHEN 'signup' THEN 'PUT' WHEN 'purchase' THEN 'PATCH' ELSE 'DELETE' END AS method,
 'http://api.example.com/api/v1/users/' || user_id || '/' || event_type || '?k=' || json_extract_string(props, '$.k') AS url,
 CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 201 WHEN 'signup' THEN 302 WHEN 'purchase' THEN 404 END AS status,
 CAST(floor(value * 10) AS BIGINT) AS total_ms, props AS body, event_type, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
 FROM events)"""


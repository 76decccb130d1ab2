import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from apiquarry.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "apiquarry-tests",
        master="local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def one(spark):
    """Evaluate a column expression on one row of named text columns."""
    from pyspark.sql import functions as F

    def run(build, **columns):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
        return df.select(build.alias("v")).first()["v"]

    return run

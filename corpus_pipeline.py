"""From raw documents to tokens: quality, exact and near duplicates, mixing, token ids.

``STAGES`` holds the steps in order. Each takes what the one before kept, as written to Parquet and read
again; the first four return the columns of ``documents``, the last adds the ids and the text decoded
from them. A stage works on all its rows and decides alike at every size:

* ``quality`` drops documents that the classifier rejects; it is fitted on the labelled documents given;
* ``exact_dedup`` keeps the smallest id of equal texts;
* ``near_dedup`` keeps the smallest id of documents linked by a similarity of 0.8 of five-word shingles;
* ``mixing`` returns a row per document and pass over its source, texts taken in part being cut to the
  words taken (and ``n_chars`` counted anew);
* ``tokens`` encodes every text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiquarry.llm import bpe, exact_dedup, minhash, mixing, quality
from apiquarry.llm.tokenizer_files import byte_bpe
from apiquarry.plans.base import shared_folder

WEIGHTS, SHARE = (3, 1, 2), 1.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, width=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_documents(docs, WEIGHTS, SHARE)
    return mixed.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else mixed


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, byte_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix), ("tokens", tokens),
]

#: SQL expresses neither the classifier nor the draws; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written beside the checkpoints and read again."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes, in ``2^BITS`` places, of its words, its neighbouring word
pairs and its pairs with one word between. FTRL-proximal keeps a learning rate per coordinate and sets
to zero every weight whose evidence stays below ``L1``. The labelled sample is dealt to ``SHARDS`` groups
that make a pass side by side, ``ROUNDS`` times, each starting from the mean of the states before; the
weights that are not zero, a short list of places, are what scoring tasks get.

At most ``FIT_ROWS`` labelled documents are learned from; all documents are scored, whole. Labels,
languages, sources and ids are no inputs of a score. A word is lower-cased and stripped of marks at its
ends. Defined results: NULL and empty texts have no feature and get the score of the intercept; without
labels every score is 0.5. Repeated rows score alike. Further columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apiquarry.llm.labelled import held_out, labelled_texts
from apiquarry.llm.words import WordHashes
from apiquarry.session import cut_lineage

BITS = 19
FIT_ROWS = 20_000
SHARDS = 4
ROUNDS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.01
THRESHOLD = 0.5


def hashed_grams(data: bytes, words: WordHashes) -> np.ndarray:
    """Distinct feature places of a whole text."""
    h = words.of(data)
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        skips = (h[:-2] * np.uint64(0x165667B19E3779F9)) ^ (h[2:] * np.uint64(0xD6E8FEB86659FD93))
        every = np.concatenate([h, pairs, skips]) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((every >> np.uint64(64 - BITS)).astype(np.int32))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _grams(body: pd.Series) -> pd.Series:
    words = WordHashes()
    return body.map(lambda x: hashed_grams(bytes(x), words))


@dataclass(frozen=True)
class ToxicityModel:
    places: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, bodies: list[bytes]) -> np.ndarray:
        dense = np.zeros(1 << BITS, dtype=np.float32)
        dense[self.places] = self.weights
        words = WordHashes()
        margins = np.array([self.intercept + float(dense[hashed_grams(x, words)].sum()) for x in bodies])
        return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def ftrl_weights(z: np.ndarray, n: np.ndarray, free: np.ndarray | bool) -> np.ndarray:
    """Closed form of the weights; coordinates marked ``free`` (the intercept) are not shrunk."""
    least = np.where(free, 0.0, L1)
    w = -(z - np.sign(z) * least) / ((BETA + np.sqrt(n)) / ALPHA + np.where(free, 0.0, L2))
    return np.where(np.abs(z) <= least, 0.0, w)


def ftrl_pass(z: np.ndarray, n: np.ndarray, rows: list[np.ndarray], labels: np.ndarray) -> None:
    """One pass over the rows in the given order, in place; the last coordinate is the intercept."""
    last = len(z) - 1
    for row, y in zip(rows, labels):
        at = np.append(row, last)
        w = ftrl_weights(z[at], n[at], at == last)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        grown = n[at] + g * g
        z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
        n[at] = grown


def _passes(state):
    """One pass over the rows of a partition, in their order, from a broadcast state; the state after it."""

    def run(batches):
        own_z, own_n, rows = *(x.copy() for x in state.value), 0
        for batch in batches:
            ftrl_pass(own_z, own_n, [np.asarray(x) for x in batch["grams"]], batch["y"].to_numpy())
            rows += len(batch)
        if rows:
            yield pd.DataFrame({"z": [own_z.tobytes()], "n": [own_n.tobytes()]})

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = FIT_ROWS) -> ToxicityModel:
    sample = labelled_texts(docs, labels, label, rows, text, key)
    turn = F.xxhash64(F.lit("turn"), "doc_id")
    train = sample.select("doc_id", "y", turn.alias("turn"), F.pmod(turn, F.lit(SHARDS)).alias("shard"), _grams("body").alias("grams"))
    # dealt out and put in order once; every pass reads the cut rows where they lie
    train = cut_lineage(train.repartition(SHARDS, "shard").sortWithinPartitions("turn", "doc_id", F.size("grams")).select("y", "grams"))
    size = 1 << BITS
    z, n = np.zeros(size + 1, dtype=np.float32), np.zeros(size + 1, dtype=np.float32)
    for _ in range(ROUNDS):
        # SHARDS rows of 2^BITS numbers each, whatever the corpus
        state = docs.sparkSession.sparkContext.broadcast((z, n))
        states = train.mapInPandas(_passes(state), "z binary, n binary").collect()
        state.destroy()
        if not states:
            return ToxicityModel(np.empty(0, dtype=np.int64), np.empty(0), 0.0)
        z = sum(np.frombuffer(s.z, dtype=np.float32) for s in states) / len(states)
        n = sum(np.frombuffer(s.n, dtype=np.float32) for s in states) / len(states)
    weights = ftrl_weights(z, n, np.arange(size + 1) == size)
    places = np.flatnonzero(weights[:size])
    return ToxicityModel(places, weights[places], float(weights[size]))


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """The score of a text column, from 0 to 1."""

    @F.pandas_udf(T.DoubleType())
    def score(body: pd.Series) -> pd.Series:
        return pd.Series(model.score([bytes(x) for x in body]), dtype=float)

    return score(F.coalesce(text, F.lit("")).cast("binary"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row."""
    model = fit_toxicity(docs, labels, text, key)
    scored = docs.select(F.col(f"`{key}`").alias("doc_id"), held_out(F.col(f"`{key}`")).alias("held_out"), toxicity_score(model, F.col(f"`{text}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

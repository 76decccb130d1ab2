"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

Each text is reduced to ``STATISTICS`` (character classes, word shapes, repetition), standardised and
clipped, and mapped to ``cos(x W + b)``, whose inner products approximate a Gaussian kernel. Every
partition of the training rows adds up its part of the normal equations; the sums, of a fixed size,
are added and solved once. Part of the training rows is kept aside and gives a monotone map from
ridge scores to probabilities (pool adjacent violators, interpolated between blocks).

At most ``FIT_ROWS`` labelled documents are learned from; all documents are scored, whole.
Labels, languages, sources and ids are no inputs of a score. Defined results: NULL and empty texts
have the statistics 0 and get the score that belongs to them; without usable labels every score is
0.5, and with one class only it is that class's smoothed share. Repeated rows score alike. Further
columns are not looked at.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apiquarry.llm.labelled import held_out, labelled_texts
from apiquarry.session import cut_lineage

STATISTICS = (
    "log bytes", "log words", "bytes per word", "letters", "upper case of letters", "digits", "white space", "sentence marks", "other marks",
    "bars", "exclamations", "byte entropy", "compressed share", "distinct words", "repeated neighbours", "words per line",
)
FIT_ROWS = 20_000
FEATURES = 256
#: Width of the Gaussian kernel, in standard deviations of the statistics.
WIDTH = 4.0
RIDGE = 1.0
CLIP = 4.0
#: Of the fitted rows, one in so many calibrates.
CALIBRATE = 4
#: Documents with a lower score are rejected.
THRESHOLD = 0.3

_CLASSES = np.zeros((256, 8))
for _codes, _k in (
    ((*range(97, 123), *range(128, 256)), 0), (range(65, 91), 1), (range(48, 58), 2), ((32, 9, 10, 11, 12, 13), 3), (b".,;:'\"-?()", 4),
    (b"#$%&*+/<=>@[]\\^_`{}~", 5), (b"|", 6), (b"!", 7),
):
    _CLASSES[list(_codes), _k] = 1


def statistics(data: bytes) -> np.ndarray:
    """The statistics of one whole text."""
    n = len(data)
    if not n:
        return np.zeros(len(STATISTICS))
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    lower, upper, digits, white, sentence, other, bars, shouts = counts @ _CLASSES
    words = data.split()
    count = len(words)
    shares = counts[counts > 0] / n
    return np.array(
        [
            np.log1p(n), np.log1p(count), n / max(count, 1), (lower + upper) / n, upper / max(lower + upper, 1), digits / n, white / n, sentence / max(count, 1),
            other / max(count, 1), bars / max(count, 1), shouts / max(count, 1), -float(shares @ np.log2(shares)), len(zlib.compress(data, 1)) / n,
            np.log1p(len(set(words))) / np.log1p(count) if count else 0.0, sum(map(eq, words, words[1:])) / max(count, 1), np.log1p(count / (1 + data.count(b"\n"))),
        ]
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(body: pd.Series) -> pd.Series:
    return body.map(lambda x: statistics(bytes(x)))


def pool_adjacent(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on x: centres and (rising) values of its blocks."""
    blocks: list[list[float]] = []  # sum of x, sum of y, rows
    order = np.argsort(x, kind="stable")
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.cos(x @ self.waves + self.phases) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        # a little of the raw score keeps the order inside a flat stretch
        return 0.98 * np.interp(raw, self.knots, self.values) + 0.02 / (1 + np.exp(-4 * (raw - 0.5)))


def _constant(value: float) -> QualityModel:
    k = len(STATISTICS)
    zero = np.zeros(FEATURES + 1)
    flat = (value - 0.02 / (1 + np.exp(2.0))) / 0.98
    return QualityModel(np.zeros(k), np.ones(k), np.zeros((k, FEATURES)), np.zeros(FEATURES), zero, np.array([0.0]), np.array([flat]))


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = FIT_ROWS, seed: int = 11) -> QualityModel:
    sample = labelled_texts(docs, labels, label, rows, text, key)
    aside = F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(CALIBRATE)) == 0
    train = cut_lineage(sample.select("y", aside.alias("aside"), _statistics("body").alias("stats")))
    k = len(STATISTICS)
    fit = train.filter("NOT aside")
    moments = fit.select(F.count("*"), F.avg("y"), *[f(F.col("stats")[i]) for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    n, share = moments[0], moments[1]
    if not n or share in (0.0, 1.0):
        return _constant((share * n + 0.5) / (n + 1) if n else 0.5)
    spread = np.array(moments[3::2])
    rng = np.random.default_rng(seed)
    zero = np.zeros(FEATURES + 1)
    model = QualityModel(
        np.array(moments[2::2]), np.where(spread > 1e-9, spread, 1.0), rng.normal(size=(k, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES), zero,
        np.array([0.0, 1.0]), np.array([0.0, 1.0]),
    )

    def sums(batches):
        left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z = model.features(np.stack(batch["stats"].to_numpy()))
            left += z.T @ z
            right += z.T @ batch["y"].to_numpy()
        yield pd.DataFrame({"lhs": [left.tobytes()], "rhs": [right.tobytes()]})

    # the sample is bounded, and so are its partitions and their sums
    parts = fit.coalesce(16).mapInPandas(sums, "lhs binary, rhs binary").collect()
    lhs = sum(np.frombuffer(p.lhs).reshape(FEATURES + 1, -1) for p in parts)
    rhs = sum(np.frombuffer(p.rhs) for p in parts)
    weights = np.linalg.solve(lhs + RIDGE * np.diag([*np.ones(FEATURES), 1e-6]), rhs)
    model = QualityModel(model.mean, model.scale, model.waves, model.phases, weights, model.knots, model.values)
    kept = train.filter("aside").select("y", "stats").toPandas()
    if len(kept):
        knots, values = pool_adjacent(model.raw(np.stack(kept["stats"].to_numpy())), kept["y"].to_numpy())
        model = QualityModel(model.mean, model.scale, model.waves, model.phases, weights, knots, np.clip(values, 0.0, 1.0))
    return model


def quality_score(model: QualityModel, text: Column) -> Column:
    """The score of a text column, from 0 to 1."""

    @F.pandas_udf(T.DoubleType())
    def score(body: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([statistics(bytes(x)) for x in body])) if len(body) else [], dtype=float)

    return score(F.coalesce(text, F.lit("")).cast("binary"))


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row."""
    model = fit_quality(docs, labels, text, key)
    scored = docs.select(F.col(f"`{key}`").alias("doc_id"), held_out(F.col(f"`{key}`")).alias("held_out"), quality_score(model, F.col(f"`{text}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    return docs.filter(quality_score(fit_quality(docs, labels, text, key), F.col(f"`{text}`")) >= THRESHOLD)

"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is read as one stream of words: its documents in a hashed order, one behind the other,
cut into blocks of ``BLOCK_WORDS`` words. A source's target may take the stream up to ``MOST`` times;
each pass takes the blocks in another pseudo-random order (a multiplicative permutation of the block
numbers), and the last block of the last pass is cut, so that a source gives exactly its target,
rounded down. The blocks a source gives are its quota. A tree splits the quotas among the output
shards: a node that serves several shards draws, from a multivariate hypergeometric distribution, how
many blocks of each source go to its left half; every leaf has its exact number of blocks. A source's
drawn blocks are dealt to the shards in draw order, so no block goes to two of them, and each shard
is shuffled locally by the hash of its pieces.

Tables that hold a row per source (and per tree node and source) are small, being the list of
weights; everything that grows with the documents is a join or a window on (source, part), with
``PARTS`` hashed parts per source, so a hot source is spread over that many groups.

Words are runs of code points other than ASCII white space. Defined results: sources come in the
order of their code points and NULL, a source like any other, last; NULL and empty texts have size 0
and give nothing; a source of size 0 has target 0; NULL ids and repeated rows are rows of their own.
All draws depend on the documents and the seed only, so reruns agree. Further columns are not looked
at, and ``mixed_documents`` passes them through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apiquarry.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 1024
#: Times a source may be repeated at most.
MOST = 2
#: Hashed parts of a source's stream.
PARTS = 4096
#: Words in one output shard, about.
SHARD_WORDS = 4_000_000
#: Tree levels that one task expands below a node before its children are dealt out again.
LEVELS = 6
#: Copies of the table of sources when rows are joined with it.
SALTS = 64
#: Primes; multiplying by one that does not divide the number of blocks permutes block numbers. A number
#: that both divide is beyond 9e17.
STEPS = (1_000_000_007, 998_244_353)


def _measured(docs: DataFrame, text: str, source: str, key: str, seed: int) -> DataFrame:
    """Per row: its source, size and place in the hashed order; ``same`` numbers equal rows."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64(body).alias("digest"),
    )
    return base.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "digest")).withColumn("part", F.pmod("place", F.lit(PARTS)))


def targets(sizes: DataFrame, weights: Sequence[float], share: float) -> DataFrame:
    """``source, source_size, target`` for ``sizes(source, source_size)``.

    Weights repeat in the order of the sources. A level is raised until the targets, each
    ``min(MOST * size, level * weight)``, add up: sources are sorted by the level at which they are
    full, and the level is found from sums before and behind each.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    listed = sizes.withColumn("nth", (F.row_number().over(named) - 1) % len(weights))
    listed = listed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("nth").cast("int") + 1))
    listed = listed.withColumn("room", F.col("source_size") * float(MOST))
    order = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    whole = Window.partitionBy()
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(behind)
    listed = listed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("room"))
    final = F.min(F.when(F.col("fits"), F.struct(F.col("room") / F.col("weight"), "level"))).over(whole)["level"]
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("room", F.coalesce(F.greatest(final, F.lit(0.0)) * F.col("weight"), F.col("room"))))
    return listed.select("source", "source_size", target.alias("target"))


def _first_draws(words: Column, size: Column, short_rank: Column) -> Column:
    """Blocks drawn until ``words`` words are there; the short last block is drawn at ``short_rank``."""
    short = F.pmod(-size, F.lit(BLOCK_WORDS))  # words that the last block lacks
    plain = F.ceil(words / BLOCK_WORDS)
    return F.when(plain <= short_rank, plain).otherwise(F.ceil((words + short) / BLOCK_WORDS))


def _plan(sources: DataFrame, seed: int) -> DataFrame:
    """One row per (source, pass): words to take and the permutation of its blocks."""
    passes = sources.filter("source_size > 0").withColumn("quota", F.floor("target").cast("bigint")).select("*", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("pass"))
    passes = passes.withColumn("words", F.greatest(F.lit(0), F.least("source_size", F.col("quota") - F.col("pass") * F.col("source_size"))))
    passes = passes.withColumn("blocks", F.expr(f"(source_size + {BLOCK_WORDS - 1}) div {BLOCK_WORDS}"))
    passes = passes.withColumn("offset", F.pmod(F.xxhash64(F.lit(seed), "source", "pass"), F.col("blocks")))
    passes = passes.withColumn("short_rank", _rank(F.col("blocks") - 1)).withColumn("drawn", _first_draws(F.col("words"), F.col("source_size"), F.col("short_rank")).cast("bigint"))
    return passes.filter("words > 0").select("source", "source_size", "pass", "words", "blocks", "offset", "short_rank", "drawn")


def _rank(block: Column) -> Column:
    """Place of a block in the order of its pass: a bijection. Products are decimals, which hold them at any size."""
    blocks = F.col("blocks")
    step = F.when(blocks % STEPS[0] == 0, STEPS[1]).otherwise(STEPS[0])
    product = F.pmod(block, blocks).cast("decimal(19,0)") * F.pmod(step, blocks).cast("decimal(10,0)")
    return F.pmod(F.pmod(product, blocks.cast("decimal(19,0)")).cast("bigint") + F.col("offset"), blocks)


def _seed(*path: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256("/".join(map(str, path)).encode()).digest()[:8], "little"))


def hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """How many of ``draws`` from ``good + bad`` are good, for populations of any size.

    Inversion over the probabilities within ten deviations of the mode, each from its neighbour's by
    their ratio: no logarithms of factorials, whose errors would grow with the population.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    whole = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (whole + 2)))
    spread = (draws * (good / whole) * (bad / whole) * ((whole - draws) / max(1, whole - 1))) ** 0.5
    reach = int(10 * spread) + 30
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.append(0.0, np.cumsum(steps))
    sums = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def _halved(counts: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """Multivariate hypergeometric draw of ``left`` blocks from the counts, source by source."""
    out, rest, need = np.zeros_like(counts), int(counts.sum()), left
    for i, have in enumerate(counts):
        rest -= int(have)
        out[i] = hypergeometric(int(have), rest, need, rng)
        need -= int(out[i])
    return out


def _descend(seed: int, levels: int):
    """Splits the quotas of a node ``[lo, hi)`` of shards among its descendants ``levels`` below."""

    def run(node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values("nth")
        lo, hi = int(node["lo"].iloc[0]), int(node["hi"].iloc[0])
        todo, done = [(lo, hi, node["blocks"].to_numpy(np.int64), node["first"].to_numpy(np.int64), 0)], []
        while todo:
            lo, hi, counts, first, depth = todo.pop()
            if hi - lo == 1 or depth == levels:
                done.append(pd.DataFrame({"nth": node["nth"].to_numpy(), "lo": lo, "hi": hi, "blocks": counts, "first": first}))
                continue
            mid, total = (lo + hi) // 2, int(counts.sum())
            left = _halved(counts, total * (mid - lo) // (hi - lo), _seed(seed, lo, hi))
            todo += [(lo, mid, left, first, depth + 1), (mid, hi, counts - left, first + left, depth + 1)]
        return pd.concat(done)[lambda x: x["blocks"] > 0]

    return run


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``nth, shard, first, blocks`` for ``quotas(nth, blocks)``: shard's draws of source ``nth``
    are ``first … first + blocks - 1``. Nodes of one round are split side by side."""
    schema = "nth bigint, lo bigint, hi bigint, blocks bigint, first bigint"
    nodes = quotas.select(
        F.col("nth").cast("bigint"), F.lit(0).cast("bigint").alias("lo"), F.lit(shards).cast("bigint").alias("hi"),
        F.col("blocks").cast("bigint"), F.lit(0).cast("bigint").alias("first"),
    )
    reach = shards
    while reach > 1:
        nodes = nodes.groupBy("lo", "hi").applyInPandas(_descend(seed, LEVELS), schema)
        reach = -(-reach // (1 << LEVELS))
    return nodes.filter("blocks > 0").select("nth", F.col("lo").alias("shard"), "first", "blocks")


def _streams(rows: DataFrame) -> DataFrame:
    """Rows with the place ``start`` of their first word in their source's stream."""
    full = rows.filter("size > 0")
    parts = full.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lifts = parts.select("source", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("lift"))
    inside = Window.partitionBy("source", "part").orderBy("place", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = full.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(lifts.toDF("l_source", "l_part", "lift"), F.col("source").eqNullSafe(F.col("l_source")) & (F.col("part") == F.col("l_part")))
    return joined.select("doc_id", "digest", "source", "size", (F.col("lift") + F.col("inner")).alias("start"))


def _same_row(doc_id: Column, digest: Column, source: Column, prefix: str) -> Column:
    return doc_id.eqNullSafe(F.col(f"{prefix}id")) & (digest == F.col(f"{prefix}digest")) & source.eqNullSafe(F.col(f"{prefix}source"))


def _by_source(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Join rows of hot sources with a small table per source, on (source, salt)."""
    few = few.withColumnRenamed("source", "f_source").withColumn("f_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)).cast("int"))
    return salted.join(few, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("salt") == F.col("f_salt"))).drop("f_source", "f_salt", "salt")


class Mix:
    """A mix of ``docs``: ``sources`` (targets), ``rows`` (each document) and ``pieces`` (what is taken)."""

    def __init__(
        self, docs: DataFrame, weights: Sequence[float], share: float, text: str = "text", source: str = "source", key: str = "doc_id",
        seed: int = 7, shard_words: int = SHARD_WORDS,
    ) -> None:
        self.all = cut_lineage(_measured(docs, text, source, key, seed))
        self.sources = cut_lineage(targets(self.all.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share))
        self.rows = cut_lineage(_streams(self.all))
        # one number decides how many shards there are
        words = self.sources.agg(F.sum("target")).first()[0] or 0
        self.shards = max(1, -(-int(words) // shard_words))
        self.plan = _plan(self.sources, seed)
        self.seed = seed

    def pieces(self) -> DataFrame:
        """``source, doc_id, digest, size, start, pass, block, shard, position, first_word, words``: runs of
        ``words`` words of a document, from its word ``first_word`` on, in the order of their shard."""
        order = Window.orderBy(F.col("source").isNull(), F.col("source"))
        listed = self.plan.groupBy("source").agg(F.sum("drawn").alias("blocks")).withColumn("nth", F.row_number().over(order))
        leaves = split_quotas(listed.select("nth", "blocks"), self.shards, self.seed)
        named = leaves.join(listed.select("nth", F.col("source").alias("d_source")), "nth")
        dealt = named.select("d_source", "shard", F.explode(F.expr("sequence(first, first + blocks - 1)")).alias("d_draw"))
        plan = self.plan.withColumn("earlier", F.coalesce(F.sum("drawn").over(Window.partitionBy("source").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        cut = self.rows.withColumn("block", F.explode(F.expr(f"sequence(start div {BLOCK_WORDS}, (start + size - 1) div {BLOCK_WORDS})")))
        found = _by_source(cut, plan).withColumn("rank", _rank(F.col("block")))
        begun = F.col("rank") * BLOCK_WORDS - F.when(F.col("rank") > F.col("short_rank"), F.pmod(-F.col("source_size"), F.lit(BLOCK_WORDS))).otherwise(0)
        found = found.withColumn("upto", F.col("block") * BLOCK_WORDS + F.least(F.lit(BLOCK_WORDS), F.col("words") - begun))
        found = found.withColumn("from", F.greatest("start", F.col("block") * BLOCK_WORDS))
        found = found.withColumn("take", F.least(F.col("start") + F.col("size"), F.col("upto")) - F.col("from")).filter("rank < drawn AND take > 0")
        found = found.withColumn("draw", F.col("earlier") + F.col("rank"))
        sharded = found.join(dealt, F.col("source").eqNullSafe(F.col("d_source")) & (F.col("draw") == F.col("d_draw")))
        return sharded.select(
            "source", "doc_id", "digest", "size", "start", "pass", "block", "shard", F.xxhash64(F.lit(self.seed), "shard", "pass", "start", "source").alias("position"),
            (F.col("from") - F.col("start")).alias("first_word"), F.col("take").alias("words"),
        )

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken``: one row per input row."""
        own = self.pieces().groupBy("source", "start", "doc_id", "digest").agg(F.sum("words").alias("taken")).toDF("t_source", "t_start", "t_id", "t_digest", "taken")
        same = F.col("source").eqNullSafe(F.col("t_source")) & (F.col("start") == F.col("t_start"))
        full = self.rows.join(own, same, "left").select("doc_id", "digest", "source", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
        empty = self.all.filter("size = 0").select("doc_id", "digest", "source", "size", F.lit(0).cast("bigint").alias("taken"))
        return _by_source(full.unionByName(empty), self.sources).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: Sequence[float], share: float, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 7) -> DataFrame:
    """The mix as documents: one row per document and pass, its text the words taken in that pass.

    A document taken whole keeps its text as it is; of one taken in part, the taken runs follow each
    other, joined by spaces. Rows keep all columns of ``docs``.
    """
    runs = Mix(docs, weights, share, text, source, key, seed).pieces()
    per_row = runs.groupBy("source", "start", "doc_id", "digest", "size", "pass").agg(
        F.sum("words").alias("all_words"), F.array_sort(F.collect_list(F.struct("first_word", "words"))).alias("runs")
    )
    same = ["doc_id", "digest", "source"]
    copies = per_row.groupBy(*same).agg(F.countDistinct("start").alias("copies"))
    per_row = per_row.join(copies.toDF("c_id", "c_digest", "c_source", "copies"), _same_row(F.col("doc_id"), F.col("digest"), F.col("source"), "c_")).drop("c_id", "c_digest", "c_source")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(row.alias("_row"), F.col(f"`{key}`").cast("bigint").alias("m_id"), F.xxhash64(body).alias("m_digest"), F.col(f"`{source}`").cast("string").alias("m_source"))
    on = _same_row(F.col("doc_id"), F.col("digest"), F.col("source"), "m_")
    single = marked.join(per_row.filter("copies = 1"), on).select("_row", "runs", "all_words", "size")
    # of equal rows one stands for all; each of them has its own runs
    many = per_row.filter("copies > 1")
    asked = marked.join(many.select(*same).distinct(), on).groupBy("m_id", "m_digest", "m_source").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    picked = asked.join(many, on).select("_row", "runs", "all_words", "size")
    out = single.unionByName(picked)
    words = F.regexp_extract_all(F.col(f"_row.`{text}`"), F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(words, r["first_word"].cast("int") + 1, r["words"].cast("int")))), " ")
    mixed = F.when(F.col("all_words") == F.col("size"), F.col(f"_row.`{text}`")).otherwise(part)
    return out.select(*[mixed.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])

"""Best documents for every item, with the index over the items and the documents streaming through it.

The usual order of search is turned round: items are few and documents many, so the inverted index is that
of the items' terms, and it is what gets broadcast. A first pass counts over all documents how many hold a
term, how many hold each term of the index, and the terms in all. In the second pass each task streams its
documents: the counts of a document's terms meet the posting lists, the sums per item are compared with the
worst of that item's heap, and only what beats it enters. A task thus returns at most ``k`` rows per item,
whatever the number of its documents; heaps are merged by ranking within salts of an item first.

The index stays bounded: items are dealt by hash into blocks of about ``BLOCK_BYTES`` of text and
``BLOCK_ITEMS`` items, and the documents are streamed once more for each block, so that no size of the
items' table enlarges a broadcast. Most tables of items are one block.

Defined results: terms are maximal runs of ASCII letters, digits and all code points from 128 on, with only
A-Z lower-cased. A NULL or empty text has no terms: as a document it is found by nothing, as an item it
returns nothing. Equal scores go by ascending id, NULL ids last. Equal (id, text) rows of items are one item;
an id with two texts is two items, ranked separately. Repeated documents are ranked each. Further columns are
not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of a block of items.
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 4096
#: Heaps of an item are merged within so many parts first.
SALTS = 32
#: Fixed values of the score: length weight in percent, and the scales of its integer arithmetic.
LENGTH_WEIGHT, HUNDRED, GAIN, TF_SCALE, NORM_SCALE, WEIGHT_SCALE = 75, 100, 1_000_000_000, 1000, 8, 1000

_TERM_BYTES = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order: every other byte is a blank, and A-Z are lower-cased."""
    return data.translate(_TERM_BYTES).split()


class ItemIndex:
    """Posting lists of the terms of a block of items: which items hold a term, and how often."""

    def __init__(self, texts: list[bytes]) -> None:
        lists: dict[bytes, list[tuple[int, int]]] = {}
        for item, text in enumerate(texts):
            for term, times in Counter(terms_of(text)).items():
                lists.setdefault(term, []).append((item, times))
        self.n_items = len(texts)
        self.place = {term: at for at, term in enumerate(lists)}
        self.items = [np.array([i for i, _ in found], dtype=np.int64) for found in lists.values()]
        self.times = [np.array([n for _, n in found], dtype=np.int64) for found in lists.values()]

    def held(self, counts: Counter) -> list[tuple[int, int]]:
        """(place of the term, occurrences) for the terms of a document that the index holds."""
        place = self.place
        if len(counts) <= len(place):
            return [(place[t], n) for t, n in counts.items() if t in place]
        return [(at, counts[t]) for t, at in place.items() if t in counts]


def _weights(n_docs: int, held_by: dict[int, int], size: int) -> np.ndarray:
    return np.array([math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * held_by.get(t, 0) + 1))) for t in range(size)], dtype=np.int64)


class ItemHeaps:
    """The best ``k`` documents of each item among those a task has seen."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.heaps = k, [[] for _ in range(n_items)]
        self.least = np.ones(n_items, dtype=np.int64)

    def add(self, doc: int | None, sums: np.ndarray) -> None:
        for item in np.flatnonzero(sums >= self.least).tolist():
            heap = self.heaps[item]
            # the worst comes first: lowest score, then no id, then the greatest id
            entry = (int(sums[item]), doc is not None, -(doc or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for item, heap in enumerate(self.heaps):
            for score, known, less in heap:
                yield item, -less if known else None, score


def _bodies(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("body"))


def _statistics(bodies: DataFrame, index: Broadcast) -> tuple[int, int, dict[int, int]]:
    """Documents that hold a term, terms of all documents, and the documents that hold each term of the index.

    What is fetched is as long as the index, whose size is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, docs, total = index.value, 0, 0
        held_by = np.zeros(len(own.items), dtype=np.int64)
        for batch in batches:
            for body in batch.column("body").to_pylist():
                terms = terms_of(body)
                docs, total = docs + bool(terms), total + len(terms)
                for at, _ in own.held(Counter(terms)):
                    held_by[at] += 1
        seen = np.flatnonzero(held_by)
        # places -1 and -2 stand for the documents and the terms in all
        yield pa.RecordBatch.from_pydict({"place": [-1, -2, *seen.tolist()], "n": [docs, total, *held_by[seen].tolist()]})

    found = dict(map(tuple, bodies.select("body").mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n")).collect()))
    return found.pop(-1, 0), found.pop(-2, 0), found


def _search_block(bodies: DataFrame, texts: list[bytes], k: int) -> DataFrame | None:
    """``item, doc_id, score``: what the heaps of all tasks hold in the end; NULL without any term to look for."""
    spark = bodies.sparkSession
    index = spark.sparkContext.broadcast(ItemIndex(texts))
    if not index.value.place:
        return None
    n_docs, n_terms, held_by = _statistics(bodies, index)
    if not n_docs:
        return None
    weights = _weights(n_docs, held_by, len(index.value.items))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        heaps = ItemHeaps(own.n_items, k)
        for batch in batches:
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                terms = terms_of(body)
                held = own.held(Counter(terms))
                if not held:
                    continue
                norm = HUNDRED - LENGTH_WEIGHT + LENGTH_WEIGHT * len(terms) * n_docs // n_terms
                places, tf = np.array(held, dtype=np.int64).T
                gains = weights[places] * (GAIN * tf // (TF_SCALE * tf + NORM_SCALE * norm))
                lists = [own.items[p] for p in places.tolist()]
                sums = np.zeros(own.n_items, dtype=np.int64)
                times = np.concatenate([own.times[p] for p in places.tolist()])
                np.add.at(sums, np.concatenate(lists), np.repeat(gains, [len(x) for x in lists]) * times)
                heaps.add(doc, sums)
        found = list(heaps.rows())
        yield pa.RecordBatch.from_pydict(
            {
                "item": pa.array([x[0] for x in found], pa.int32()), "doc_id": pa.array([x[1] for x in found], pa.int64()),
                "score": pa.array([x[2] for x in found], pa.int64()),
            }
        )

    return bodies.mapInArrow(search, "item int, doc_id bigint, score bigint")


def best_documents(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, scores above 0 only."""
    bodies = _bodies(docs, text, key)
    asked = items.select(F.col(f"`{item_key}`").alias("item_id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).cast("binary").alias("body")).distinct()
    n_items, n_bytes = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("body").cast("bigint")), F.lit(0))).first()
    blocks = max(1, -(-n_items // BLOCK_ITEMS), -(-n_bytes // BLOCK_BYTES))
    id_type = asked.schema["item_id"].dataType.simpleString()
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)))
    out = docs.sparkSession.createDataFrame([], f"item_id {id_type}, block int, item int, doc_id bigint, score bigint")
    for block in range(blocks):
        # a block of items, of bounded size
        own = asked.filter(F.col("block") == block).orderBy("item_id", "body").collect()
        found = _search_block(bodies, [bytes(r["body"]) for r in own], k)
        if found is not None:
            names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"item int, item_id {id_type}")
            out = out.unionByName(found.join(F.broadcast(names), "item").withColumn("block", F.lit(block)))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = out.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    near = salted.withColumn("_r", F.row_number().over(Window.partitionBy("block", "item", "_salt").orderBy(*order))).filter(F.col("_r") <= k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")

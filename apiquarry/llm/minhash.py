"""Near duplicates from min-hashes in bands, and from what texts differ in from the leaders of their bands.

A document's set of word shingles is hashed once to 63 bits. Documents with the same set are one class from the start.
A class has ``BANDS`` keys, each of the least hashes of its set under ``BAND`` orders; classes that agree in a key are
a list. Two sets with a Jaccard similarity of 0.8 or more meet in no list with a probability of 1e-9, and
unrelated texts that share some common shingles hardly ever meet, however many there are, so lists hold families of
similar texts and what follows is done for these alone.

Pairs are made in two rounds, so that a family of n copies does not make n² of them. First each class meets the leaders
of its lists: a leader is the class that has most others in its lists, in a family mostly the text the others were made
from. What a class and a leader differ in, extra shingles and missing ones, is worked out from the whole sets and kept;
its size says exactly whether the two are linked. Verified links give components.
Then classes of different components that have the same leader meet. How far two classes are apart follows from their
differences from the leader, so whole sets are not looked at again. In short groups all pairs are worked out where they
are gathered. In others differences are indexed: linked classes, of which one at least is not linked with the leader,
share a number of differences that follows from the sizes, so one of the first of them in an order that both have in
common, extra shingles first and rare ones first. No link between different components is lost, and inside a component
none is needed.

Words are runs of bytes other than ASCII white space, A-Z in lower case. Defined results: a text
without words (NULL, empty, white space) has an empty set, is linked with nothing and is kept; with
fewer words than a shingle takes, the whole sequence is the only shingle. A NULL id may be linked; a
component's id is its smallest id that is not NULL, or NULL where all are. Rows that repeat an id
with the same text get the same result. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiquarry.llm.components import connected_components, join_components
from apiquarry.llm.rows import maybe_in, pick_rows
from apiquarry.session import cut_lineage

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Orders of a band, and bands: two sets of similarity 0.8 agree in none with a probability of (1 - 0.8 ** 5) ** 52 = 1e-9.
BAND, BANDS = 5, 52
#: The least size of sets of which two different ones can be linked.
LEAST_SIZE = 4
#: In groups of more classes, pairs come from an index of their differences.
LONG_LIST = 8
#: Word hashes held at once by a task.
WORD_CACHE = 400_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(data: bytes, width: int, words: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word shingles of a text."""
    parts = data.lower().split()
    if not parts:
        return np.empty(0, dtype=np.int64)
    hashes = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=len(parts))
    width = min(width, len(hashes))
    with np.errstate(over="ignore"):
        mixed = _mix(hashes[: len(hashes) - width + 1] + np.uint64(width))
        for j in range(1, width):
            mixed = _mix(mixed + hashes[j : len(hashes) - width + 1 + j])
    return np.unique(mixed >> np.uint64(1)).view(np.int64)


#: Each order is that of the products of a factor and a shingle's hash, some of its bits being flipped.
_SEEDS = _mix(np.arange(1, BAND * BANDS + 1, dtype=np.uint64))[:, None]
_FLIPS, _FACTORS = (_SEEDS >> np.uint64(32)).astype(np.uint32), _SEEDS.astype(np.uint32) | np.uint32(1)
#: Shingles taken at once, times all orders.
_AT_ONCE = 1024


def minima(values: np.ndarray) -> np.ndarray:
    """The least hash of a set under each order, of 32 bits."""
    least = np.full(BAND * BANDS, 2**32 - 1, dtype=np.uint32)
    folded = (values >> 20).astype(np.uint32)
    for i in range(0, len(folded), _AT_ONCE):
        np.minimum(least, ((folded[i : i + _AT_ONCE] ^ _FLIPS) * _FACTORS).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key of 63 bits for each band, from rows of ``minima``."""
    parts = least.reshape(-1, BANDS, BAND).astype(np.uint64)
    keys = np.broadcast_to(_mix(np.arange(BANDS, dtype=np.uint64)), parts.shape[:2])
    for j in range(BAND):
        keys = _mix(keys + parts[:, :, j])
    return (keys >> np.uint64(1)).view(np.int64)


def _set_name(values: np.ndarray) -> bytes:
    """128 bits that two different sets do not share."""
    return xxhash.xxh3_128_digest(values.tobytes())


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.xxhash64(body).alias("digest"), body.cast("binary").alias("body"))


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5) -> DataFrame:
    """``doc_id, digest, cid, n, bands`` per row; ``cid`` names the set, ``digest`` the text. Sets too small to be linked have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            cids, sizes, least = [], [], [np.empty((0, BAND * BANDS), np.uint32)]
            for body in batch.column("body"):
                values = shingle_set(body.as_buffer().to_pybytes(), width, words)
                cids.append(_set_name(values))
                sizes.append(len(values))
                if len(values) >= LEAST_SIZE:
                    least.append(minima(values)[None, :])
            offsets = np.cumsum([0, *(BANDS * (n >= LEAST_SIZE) for n in sizes)], dtype=np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band_keys(np.concatenate(least)).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(cids, pa.binary()), pa.array(sizes, pa.int64()), bands],
                names=["doc_id", "digest", "cid", "n", "bands"],
            )

    return _texts(docs, text, key).mapInArrow(run, "doc_id bigint, digest bigint, cid binary, n bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5) -> DataFrame:
    """``cid, shingles``: the whole set of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            sets = [shingle_set(body.as_buffer().to_pybytes(), width, words) for body in batch.column("body")]
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_set_name, sets), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["cid", "shingles"]
            )

    return _texts(docs, text, key).mapInArrow(run, "cid binary, shingles array<bigint>")


def _lists(classes: DataFrame) -> DataFrame:
    """``value, cid, shared``: the keys that several classes have; ``shared`` adds up how many classes have each of its keys."""
    keys = classes.select("cid", F.explode("bands").alias("value"))
    several = keys.groupBy("value").agg(F.count("*").alias("members")).filter("members > 1")
    met = keys.join(several, "value").groupBy("cid").agg(F.sum("members").alias("shared"), F.collect_list("value").alias("values"))
    return met.select(F.explode("values").alias("value"), "cid", "shared")


def _leaders(lists: DataFrame) -> DataFrame:
    return lists.groupBy("value").agg(F.max_by("cid", F.struct("shared", F.xxhash64("cid"))).alias("leader"))


def _led(lists: DataFrame, leaders: DataFrame, *also: str) -> DataFrame:
    """``cid, leader``: each class with the leaders of its lists."""
    return lists.join(leaders.select("value", "leader"), "value").filter("cid <> leader").select("cid", "leader", *also).distinct()


def _differences(led: DataFrame, sets: DataFrame, leading: DataFrame) -> DataFrame:
    """``led`` with the sizes of both sets, the shingles that the leader lacks and those that the class lacks."""
    both = led.join(sets.select("cid", "shingles"), "cid").join(leading.select(F.col("cid").alias("leader"), F.col("shingles").alias("theirs")), "leader")
    sizes = [F.size("shingles").cast("bigint").alias("n"), F.size("theirs").cast("bigint").alias("m")]
    return both.select(*led.columns, *sizes, F.array_except("shingles", "theirs").alias("extra"), F.array_except("theirs", "shingles").alias("holes"))


def _linked(n: Column, m: Column, apart: Column) -> Column:
    """Whether sets of ``n`` and ``m`` shingles that differ in ``apart`` are linked: twice their union is ``n + m + apart``."""
    return (n + m) * (100 - PERCENT) >= apart * (100 + PERCENT)


def _apart(a: Column, b: Column) -> Column:
    """In how many shingles two classes differ, from what each differs in from one leader."""
    own = [F.size(x[c]) for x in (a, b) for c in ("extra", "holes")]
    return own[0] + own[1] + own[2] + own[3] - 2 * F.size(F.array_intersect(a["extra"], b["extra"])) - 2 * F.size(F.array_intersect(a["holes"], b["holes"]))


def _of_short(groups: DataFrame) -> DataFrame:
    """Linked pairs ``x, y`` of different components in groups of ``LONG_LIST`` classes at most."""
    gathered = groups.groupBy("leader").agg(F.collect_list(F.struct("cid", "n", "comp", "extra", "holes")).alias("g"))

    def with_later(a: Column, i: Column) -> Column:
        linked = F.filter(F.slice("g", i + 2, LONG_LIST), lambda b: (a["comp"] != b["comp"]) & _linked(a["n"], b["n"], _apart(a, b)))
        return F.transform(linked, lambda b: F.struct(a["cid"].alias("x"), b["cid"].alias("y")))

    return gathered.select(F.explode(F.flatten(F.transform("g", with_later))).alias("p")).select("p.x", "p.y")


def _sharing(groups: DataFrame) -> DataFrame:
    """Pairs ``x, y`` with a ``leader`` that can be linked, being of different components.

    Two classes that differ in ``d`` and ``e`` shingles from the leader, and in ``most`` from each other at most,
    share ``(d + e - most) / 2`` of these or more, which is more than none where one of the two is not linked with
    the leader. So one of those is among the first of both in an order that is the same for all classes of the leader.
    """
    sizes = [F.size("extra").alias("e"), F.size("holes").alias("h")]
    marked = F.concat(
        F.transform("extra", lambda s: F.struct(F.lit(False).alias("hole"), s.alias("s"))), F.transform("holes", lambda s: F.struct(F.lit(True).alias("hole"), s.alias("s")))
    )
    own = ["leader", "cid", "n", "m", "comp", "e", "h"]
    every = groups.select("leader", "cid", "n", "m", "comp", *sizes, F.explode(marked).alias("d")).select(*own, "d.hole", "d.s")
    counts = every.groupBy("leader", "s").agg(F.count("*").alias("df")).filter("df > 1")
    # differences that no other class has are the first of their kind and need no row
    order = every.join(counts, ["leader", "s"]).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("hole", "df", "s"))).alias("order"))
    order = order.withColumn("d", F.col("e") + F.col("h")).withColumn("far", ~_linked(F.col("n"), F.col("m"), F.col("d")))
    order = order.withColumn("known", F.size(F.filter("order", lambda o: ~o["hole"])))
    place = F.when(F.col("o.hole"), F.col("d") - F.size("order")).otherwise(F.col("e") - F.col("known")) + F.col("i")
    rows = order.select("*", F.posexplode("order").alias("i", "o")).withColumn("place", place)
    # the least that a class shares with any other: one that is not linked with the leader if it is linked itself
    spare = F.when(F.col("far"), F.col("n") + F.col("m")).otherwise(F.col("n") - F.col("m")) * (100 - PERCENT) / (100 + PERCENT)
    least = F.greatest(F.lit(1), F.ceil((F.col("d") - spare) / 2 - 1e-9))
    rows = rows.filter(F.col("place") + least <= F.col("d")).select("leader", F.col("o.s").alias("s"), "cid", "n", "comp", "d", "far", "place")
    a, b = (rows.select("leader", "s", *[F.col(c).alias(f"{k}_{c}") for c in rows.columns[2:]]) for k in "ab")
    most = F.floor((F.col("a_n") + F.col("b_n")) * (100 - PERCENT) / (100 + PERCENT) + 1e-9)
    need = F.ceil((F.col("a_d") + F.col("b_d") - most) / 2)
    met = a.join(b, ["leader", "s"]).filter(
        (F.col("a_cid") < F.col("b_cid")) & (F.col("a_comp") != F.col("b_comp")) & (F.col("a_far") | F.col("b_far"))
        & (F.col("a_place") + need <= F.col("a_d")) & (F.col("b_place") + need <= F.col("b_d"))
    )
    return met.groupBy(F.col("a_cid").alias("x"), F.col("b_cid").alias("y")).agg(F.min("leader").alias("leader"))


def _of_long(groups: DataFrame) -> DataFrame:
    """Linked pairs ``x, y`` of different components in groups of any size."""
    of = groups.select("leader", "cid", "n", F.struct("extra", "holes").alias("d"))
    both = _sharing(groups).join(of.toDF("leader", "x", "nx", "dx"), ["leader", "x"]).join(of.toDF("leader", "y", "ny", "dy"), ["leader", "y"])
    return both.filter(_linked(F.col("nx"), F.col("ny"), _apart(F.col("dx"), F.col("dy")))).select("x", "y")


def _long_pairs(mixed: DataFrame, leaders: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``x, y`` that can be linked in lists with several components, from the whole sets of their classes."""
    return _sharing(_differences(_led(mixed, leaders, "comp"), sets, sets)).select("x", "y")


def near_components(rows: DataFrame, docs: DataFrame, text: str, key: str, width: int) -> tuple[DataFrame, DataFrame]:
    """``node, comp`` of the classes that are linked with others, and the classes."""
    named = rows.filter("n > 0").groupBy(F.col("cid").alias("name")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("bands").alias("bands"))
    # unique numbers, fixed by the checkpoint; in shuffled lists they take a fraction of a name's bytes
    classes = cut_lineage(named.withColumn("cid", F.monotonically_increasing_id()))
    lists = cut_lineage(_lists(classes))
    led = cut_lineage(_led(lists, _leaders(lists)))
    sets = _sets_of(led, classes, docs, text, key, width)
    apart = cut_lineage(_differences(led, sets, sets.filter("leads")))
    near = _linked(F.col("n"), F.col("m"), F.size("extra") + F.size("holes"))
    comps = connected_components(apart.filter(near).select(F.col("cid").alias("x"), F.col("leader").alias("y")))
    of = apart.join(comps.toDF("cid", "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    groups = of.groupBy("leader").agg(F.count("*").alias("classes"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    mixed = cut_lineage(of.join(groups.drop("low", "high"), "leader"))
    short, long = mixed.filter(F.col("classes") <= LONG_LIST), mixed.filter(F.col("classes") > LONG_LIST)
    return join_components(comps, _of_short(short).unionByName(_of_long(long)).distinct()), classes


def _sets_of(led: DataFrame, classes: DataFrame, docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """``cid, leads, shingles``: whole sets of the classes in ``led``, from one document of each."""
    ends = led.select("cid", F.lit(False).alias("leads")).unionByName(led.select(F.col("leader").alias("cid"), F.lit(True).alias("leads")))
    used = cut_lineage(classes.select("cid", "name", "rep").join(ends.groupBy("cid").agg(F.max("leads").alias("leads")), "cid"))
    asked = maybe_in(docs, F.col(f"`{key}`").cast("bigint"), used.select("rep"))
    found = shingle_sets(asked, text, key, width).withColumnRenamed("cid", "name").join(used.select("cid", "name", "leads"), "name")
    return cut_lineage(found.dropDuplicates(["name"]).select("cid", "leads", "shingles"))


def _components(docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """``doc_id, digest, n, component_id`` per row."""
    rows = cut_lineage(sketches(docs, text, key, width))
    comps, classes = near_components(rows, docs, text, key, width)
    joined = classes.select("cid", "name", "rep", "members").join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    joined = cut_lineage(joined)
    least = joined.groupBy("comp").agg(F.min("rep").alias("component_id"))
    # cut, so that a class with many rows can be split in the join below
    shared = cut_lineage(joined.join(least, "comp").filter("members > 1 OR comp <> cid OR NOT rep <=> component_id").select(F.col("name").alias("cid"), "component_id", F.lit(True).alias("found")))
    slim = rows.select("doc_id", "digest", "cid", "n")
    found = slim.join(shared, "cid", "left")
    return found.select("doc_id", "digest", "n", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``."""
    return _components(docs, text, key, width).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5) -> DataFrame:
    """One document of each component, with all its columns."""
    found = _components(docs, text, key, width).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = found.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    return pick_rows(docs, stays, key, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))

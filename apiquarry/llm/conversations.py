"""Repair of the structure of conversations by the cheapest audit of edits.

Every turn is kept, given another role, or deleted, and turns without text may be inserted, so that the
roles read: perhaps a system turn, then user and assistant in turns; or nothing at all. Among the cheapest
audits the one whose letters (D, I, K, R) come first as text is taken.

Dynamic programming over the turns with four states (nothing written, system, user, assistant written
last) keeps one audit per state. Audits share their prefixes: an audit is a node that links to the audit it
continues, with ancestors at distances of powers of two and a rolling hash of its letters. Two audits of
equal cost are compared at the end of their longest common prefix, which is found by binary search over
the ancestors; equal hashes of different nodes are verified letter by letter.

No conversation has to fit into one task. Turns are numbered, cut into chunks of ``CHUNK_TURNS``, and every
chunk yields its cheapest audit from each state to each state; these tables are joined in order by the
same comparison, with chunks in the place of letters. No letters of one chunk continue those of another
audit at equal cost (inserts cost, everything else is as frequent), so the parts decide alone. In this step a
turn is one byte. The repaired text is hashed while turns stream by in order: the edits of a turn come just
before its text. Only this stream visits one conversation in one task, as a SHA-256 has to, in constant memory.

Defined results: NULL roles, turns and texts are one space (in keys and texts), but a NULL turn counts as no
turn among gaps and comes first. A NULL ``conv_id`` is a conversation of its own. Equal turns are put in the
order of role and then the digest of the text, so copies are neighbours. A role other than user, assistant or
system counts by its first character. Very long texts are digested where they are read. Empty tables give
empty tables; further columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apiquarry.session import cut_lineage

#: Costs of the edits, as given, and what an undeleted truncated turn adds.
RECAST, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What is written last: nothing, a system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (NOTHING, ASSISTANT)
#: Role that an inserted or recast turn gets in each state, and the state after it.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = ("su", "ua", "au")
CHUNK_TURNS = 4096
#: Chunks whose tables a task remembers.
REMEMBERED = 50_000
_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Audits that share prefixes; node 0 is the empty one. A label is a letter, or the letters of a chunk."""

    def __init__(self) -> None:
        self.label, self.hash, self.depth = [""], [0], [0]
        self.above: list[list[int]] = [[]]
        self.verified: set[tuple[int, int]] = set()

    def grow(self, node: int, label: str) -> int:
        """The audit ``node`` with one more label."""
        new = len(self.label)
        up, at, k = [node], node, 0
        while len(self.above[at]) > k:
            at = self.above[at][k]
            up.append(at)
            k += 1
        self.above.append(up)
        self.label.append(label)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + hash(label) % _MOD + 1) % _MOD)
        return new

    def ancestor(self, node: int, depth: int) -> int:
        left, k = self.depth[node] - depth, 0
        while left:
            if left & 1:
                node = self.above[node][k]
            left, k = left >> 1, k + 1
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two audits of equal depth have the same labels; equal hashes are verified."""
        if a == b:
            return True
        if self.hash[a] != self.hash[b]:
            return False
        path = []
        while a != b and (a, b) not in self.verified:
            if self.label[a] != self.label[b]:
                return False
            path.append((a, b))
            a, b = self.above[a][0], self.above[b][0]
        self.verified.update(path)
        return True

    def common(self, a: int, b: int) -> int:
        """Depth of the longest common prefix."""
        low, high = 0, min(self.depth[a], self.depth[b])
        a, b = self.ancestor(a, high), self.ancestor(b, high)
        if self.same(a, b):
            return high
        for k in range(len(self.above[a]) - 1, -1, -1):
            if k < len(self.above[a]) and not self.same(self.above[a][k], self.above[b][k]):
                a, b = self.above[a][k], self.above[b][k]
        return self.depth[a] - 1

    def tail(self, node: int, depth: int) -> Iterator[str]:
        """Labels of an audit behind its first ``depth`` ones."""
        for d in range(depth + 1, self.depth[node] + 1):
            yield self.label[self.ancestor(node, d)]

    def less(self, a: int, b: int) -> bool:
        """Whether the letters of ``a`` come before those of ``b``."""
        if a == b:
            return False
        at = self.common(a, b)
        left, right, x, y = self.tail(a, at), self.tail(b, at), "", ""
        while True:
            x, y = x or next(left, ""), y or next(right, "")
            n = min(len(x), len(y))
            if x[:n] != y[:n] or not n:
                return x[:n] < y[:n] if n else not x and bool(y)
            x, y = x[n:], y[n:]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.label[node])
            node = self.above[node][0]
        return "".join(reversed(out))

    def labels(self, node: int) -> list[str]:
        out = []
        while node:
            out.append(self.label[node])
            node = self.above[node][0]
        return out[::-1]


Front = dict[int, tuple[int, int]]


def _offer(audits: Audits, front: Front, state: int, cost: int, node: int, label: str) -> None:
    """Continue an audit into ``state`` if that is cheaper, or as cheap and its letters come first."""
    known = front.get(state)
    if known is not None and known[0] < cost:
        return
    new = audits.grow(node, label)
    if known is None or cost < known[0] or audits.less(new, known[1]):
        front[state] = (cost, new)


def _inserted(audits: Audits, front: Front) -> Front:
    """The front with up to two turns inserted here; a third would come back to where it began."""
    out = dict(front)
    for _ in range(2):
        for state, (cost, node) in list(out.items()):
            _offer(audits, out, NEXT[state], cost + INSERT, node, "I")
    return out


def chunk_table(codes: str, starts: Iterable[int] = STATES) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest ``(cost, letters)`` through the turns of a chunk, by (state before, state after).

    A turn is ``x`` if it has to go, and otherwise its role's initial (``o`` for others), in upper case if truncated.
    """
    table = {}
    for start in starts:
        audits = Audits()
        front = _inserted(audits, {start: (0, 0)})
        for code in codes:
            after: Front = {}
            for state, (cost, node) in front.items():
                _offer(audits, after, state, cost + DELETE, node, "D")
                if code != "x":
                    own, more = code.lower(), TRUNCATED if code.isupper() else 0
                    if (state, own) in KEPT:
                        _offer(audits, after, KEPT[state, own], cost + more, node, "K")
                    _offer(audits, after, NEXT[state], cost + RECAST + more, node, "R")
            front = _inserted(audits, after)
        table |= {(start, end): (cost, audits.text(node)) for end, (cost, node) in front.items()}
    return table


def cheapest(tables: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, list[str]]:
    """Cost of the best audit through all chunks, and its letters chunk by chunk."""
    audits = Audits()
    front: Front = {NOTHING: (0, 0)}
    for table in tables:
        after: Front = {}
        for (start, end), (cost, letters) in table.items():
            if start in front:
                _offer(audits, after, end, front[start][0] + cost, front[start][1], letters)
        front = after
    best: Front = {}
    for state in ENDS:
        if state in front:
            cost, node = front[state]
            if NOTHING not in best or cost < best[NOTHING][0] or (cost == best[NOTHING][0] and audits.less(node, best[NOTHING][1])):
                best[NOTHING] = (cost, node)
    return best[NOTHING][0], audits.labels(best[NOTHING][1])


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, copies`` after the drill's damage: by crc32(``conv:turn``) mod 20 a turn is dropped
    (``copies`` 0), emptied, robbed of its full stops, repeated (``copies`` 2), or given to the user."""

    def plain(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")), F.lit(20))
    rows = conversations.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), plain(role).alias("role"), plain(text).alias("text"), kind.alias("kind")
    )
    return rows.select(
        "conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]+", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, F.lit(0)).when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )


def as_given(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The same columns for rows as they are."""

    def plain(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    return conversations.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), plain(role).alias("role"), plain(text).alias("text"), F.lit(1).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _chunks(rows: DataFrame) -> DataFrame:
    """``conv, chunk, codes, turns, roles, digests`` and the counts of each chunk. No text is moved."""
    white = r"[\x20\x09-\x0D]"
    bare = rows.select(
        "conv", "turn", "role", _digest().alias("digest"), "copies", (F.col("copies") == 0).alias("gone"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(rf"[.!?]{white}*\z")).alias("open"),
    )
    copied = bare.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("copies")))))
    order = [F.col("turn").asc_nulls_first(), "role", "digest", "again", "copy"]
    seen = Window.partitionBy("conv", "gone", "role", "digest").orderBy(F.col("turn").asc_nulls_first(), "copy")
    known = copied.withColumn("again", F.row_number().over(seen) > 1)
    # dropped turns stand behind the others, so they are in nobody's neighbourhood
    line = Window.partitionBy("conv").orderBy("gone", *order)
    placed = known.select(
        "*", (F.row_number().over(line) - 1).alias("place"), F.lag("turn").over(line).alias("turn_before"), F.lag(F.substring("role", 1, 1)).over(line).alias("initial_before")
    )
    initial, here = F.substring("role", 1, 1), ~F.col("gone")
    first = F.col("place") == 0
    duplicate, cut = ~F.col("blank") & F.col("again"), ~F.col("blank") & ~F.col("again") & F.col("open")
    code = F.when(F.col("blank") | F.col("again"), F.lit("x")).otherwise(
        F.when(cut, F.upper(F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o")))).otherwise(F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o")))
    )
    facts = placed.select(
        "conv", F.floor(F.col("place") / CHUNK_TURNS).alias("chunk"), here.alias("here"), "turn",
        F.struct("place", code.alias("code"), "turn", "role", "digest").alias("row"), F.col("blank").alias("is_blank"), duplicate.alias("is_duplicate"), cut.alias("is_cut"),
        (~first & ~F.concat("initial_before", initial).isin(*LEGAL)).alias("is_illegal"),
        (F.col("turn").isNotNull() & (first | ~F.col("turn").eqNullSafe(F.col("turn_before")))).alias("is_new"),
    )

    def count(flag: str) -> Column:
        return F.count_if(F.col("here") & F.col(flag)).alias(flag[3:])

    grouped = facts.groupBy("conv", "chunk").agg(
        F.min(F.when(F.col("here"), F.col("turn"))).alias("least"), F.max(F.when(F.col("here"), F.col("turn"))).alias("greatest"),
        *map(count, ("is_blank", "is_duplicate", "is_cut", "is_illegal", "is_new")),
        # at most CHUNK_TURNS rows of a few bytes
        F.array_sort(F.collect_list(F.when(F.col("here"), F.col("row")))).alias("rows"),
    )
    return grouped.select(
        "conv", "chunk", "least", "greatest", "blank", "duplicate", "cut", "illegal", "new",
        F.array_join("rows.code", "").alias("codes"), F.transform("rows", lambda r: F.struct(*[r[n].alias(n) for n in ("turn", "role", "digest")])).alias("turns"),
    )


class _Tables(dict):
    """Codes of a chunk → its table, remembered: most short conversations look alike."""

    def __missing__(self, codes: str) -> dict:
        if len(self) >= REMEMBERED:
            self.clear()
        self[codes] = table = chunk_table(codes)
        return table


_TABLE = "table array<struct<start:int,stop:int,cost:bigint,letters:string>>"


def _with_tables(chunks: DataFrame) -> DataFrame:
    kept = chunks.schema
    entry = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Tables()
        for batch in batches:
            found = [[{"start": a, "stop": b, "cost": cost, "letters": letters} for (a, b), (cost, letters) in tables[codes].items()] for codes in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, entry)], names=[*batch.schema.names, "table"])

    return chunks.mapInArrow(add, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", {_TABLE}")


def _audits(tables: DataFrame) -> DataFrame:
    """``conv``, its counts, ``cost, audit`` and the ``parts`` of the audit per chunk. A turn is a few bytes here."""
    by_conv = tables.groupBy("conv").agg(
        *[f(c).alias(c) for f, names in ((F.min, ["least"]), (F.max, ["greatest"]), (F.sum, ["blank", "duplicate", "cut", "illegal", "new"])) for c in names],
        F.array_sort(F.collect_list(F.struct("chunk", "table"))).alias("chunks"),
    )
    gaps = F.coalesce(F.col("greatest") - F.col("least") + 1 - F.col("new"), F.lit(0))
    facts = by_conv.select("conv", gaps.alias("gaps"), "blank", "duplicate", F.col("cut").alias("truncated"), "illegal", F.col("chunks.table").alias("tables"))
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cheapest([{(e["start"], e["stop"]): (e["cost"], e["letters"]) for e in table} for table in tables]) for tables in batch.column("tables").to_pylist()]
            columns = [pa.array([cost for cost, _ in found], pa.int64()), pa.array(["".join(parts) for _, parts in found], pa.string()), pa.array([parts for _, parts in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *columns], names=[*names, "cost", "audit", "parts"])

    conv = tables.schema["conv"].dataType.simpleString()
    return facts.mapInArrow(decide, f"conv {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, parts array<string>")


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


#: Rows of the stream: the facts of a conversation, letters of its audit, the text of a turn.
OPENS, EDITS, TEXT = range(3)
ROLES = ("", "system", "user", "assistant")


class Writer:
    """Follows a stream of (kind, key, value) and says what is written: conversations that open, and their lines.

    The letters of a turn (inserts, then its own) come before its text. Of several texts with one key, which are
    equal, the first is used. Letters without a key are those at the end of a conversation.
    """

    def __init__(self) -> None:
        self.state, self.waiting, self.key = NOTHING, [], None

    def take(self, kind: int, key: tuple | None, value: object) -> Iterator[tuple[int, str, object]]:
        if kind == OPENS:
            self.state, self.waiting, self.key = NOTHING, [], None
            yield OPENS, "", value
        elif kind == EDITS and key is not None:
            self.key = key
            self.waiting.append(value)
        elif kind == EDITS:
            yield from self._written(value, None)
        elif key == self.key and self.waiting:
            letters, self.waiting = "".join(self.waiting), []
            yield from self._written(letters, value)

    def _written(self, letters: str, turn: tuple[str, str] | None) -> Iterator[tuple[int, str, str]]:
        for letter in letters:
            if letter == "K":
                self.state = KEPT[self.state, turn[0][:1]]
                yield TEXT, turn[0], turn[1]
            elif letter != "D":
                self.state = NEXT[self.state]
                yield TEXT, ROLES[self.state], turn[1] if letter == "R" else ""


def _edit_stream(rows: DataFrame) -> DataFrame:
    """Facts, edits and texts, sorted so that each partition can be written as it streams by."""
    chunks = cut_lineage(_with_tables(_chunks(rows)))
    audits = cut_lineage(_audits(chunks.select("conv", "chunk", "least", "greatest", "blank", "duplicate", "cut", "illegal", "new", "table")))
    parts = audits.select(F.col("conv").alias("p_conv"), F.posexplode("parts").alias("p_chunk", "letters"))
    cut = chunks.select("conv", "chunk", "turns").join(parts, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("chunk") == F.col("p_chunk")))
    own = F.regexp_extract_all("letters", F.lit("I*[DKR]"), F.lit(0))
    edits = cut.select("conv", "chunk", F.posexplode(F.zip_with(own, "turns", lambda letters, turn: F.struct(letters.alias("own"), turn.alias("of")))).alias("place", "edit"))
    # inserts at the end of a chunk are told with the first turn of the next one, or at the end
    ends = cut.select("conv", "chunk", F.regexp_extract("letters", "I*$", 0).alias("rest")).filter("rest <> ''")
    firsts = chunks.filter("chunk > 0 AND codes <> ''").select(F.col("conv").alias("f_conv"), F.col("chunk").alias("f_chunk"), F.get("turns", F.lit(0)).alias("f_turn"))
    told_ends = ends.join(firsts, F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("chunk") + 1 == F.col("f_chunk")), "left")
    shape = (
        ("turn", "bigint"), ("role", "string"), ("digest", "binary"), ("kind", "int"), ("place", "bigint"), ("letters", "string"), ("text", "string"), *[(n, "bigint") for n in FACTS]
    )

    def line(df: DataFrame, part: Column | int, kind: int, **given: Column | str) -> DataFrame:
        cells = {"kind": F.lit(kind), **given}
        return df.select("conv", (part if isinstance(part, Column) else F.lit(part)).alias("part"), *[(F.col(c) if isinstance(c := cells.get(n), str) else F.lit(c)).cast(t).alias(n) for n, t in shape])

    def key(of: str) -> dict[str, str]:
        return {n: f"{of}.{n}" for n in ("turn", "role", "digest")}

    place = F.col("chunk") * CHUNK_TURNS
    together = [
        line(audits, 0, OPENS, letters="audit", **{n: n for n in FACTS}),
        line(edits, 1, EDITS, letters="edit.own", place=2 * (place + F.col("place")), **key("edit.of")),
        line(told_ends, F.when(F.col("f_turn").isNull(), F.lit(2)).otherwise(F.lit(1)), EDITS, letters="rest", place=2 * (place + CHUNK_TURNS) - 1, **key("f_turn")),
        line(rows.filter("copies > 0").withColumn("digest", _digest()), 1, TEXT, turn="turn", role="role", digest="digest", text="text"),
    ]
    stream = functools.reduce(DataFrame.unionByName, together)
    return stream.repartition("conv").sortWithinPartitions("conv", "part", F.col("turn").asc_nulls_first(), "role", "digest", "kind", "place")


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("kind", "part", "turn", "role", "digest", "letters", "text", "conv", *FACTS)]
        for kind, part, turn, role, digest, letters, text, conv, *facts in zip(*columns):
            own = (turn, role, digest) if part == 1 else None
            yield kind, own, (conv, facts, letters) if kind == OPENS else letters if kind == EDITS else (role, text)


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the turns of every conversation after its cheapest audit, in their new order.

    ``rows`` are ``conv, turn, role, text, copies``, as ``damaged`` and ``as_given`` return them.
    """
    stream = _edit_stream(rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place = None, 0
        for batch, lines in _by_batch(batches):
            found = []
            for kind, role, value in lines:
                conv, place = (value[0], 0) if kind == OPENS else (conv, place + 1)
                if kind != OPENS:
                    found.append((conv, place, role, value))
            types = (batch.schema.field("conv").type, pa.int64(), pa.string(), pa.string())
            cells = zip(*found) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=["conv_id", "place", "role", "text"])

    return stream.mapInArrow(write, f"conv_id {rows.schema['conv'].dataType.simpleString()}, place bigint, role string, text string")


def _by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Each batch with the lines written while it passes; a conversation may cross batches."""
    current: list[tuple] = []
    writer = Writer()
    for batch in batches:
        current = [line for entry in _lines([batch]) for line in writer.take(*entry)]
        yield batch, current


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` per conversation of ``rows``."""
    stream = _edit_stream(rows)
    conv = rows.schema["conv"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, digest, first, last = None, hashlib.sha256(), True, None

        def batch_of(done: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
            types = [like.schema.field("conv").type, *[pa.int64()] * len(FACTS), pa.string(), pa.string()]
            cells = zip(*[(conv, *facts, audit, sha) for (conv, facts, audit), sha in done]) if done else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=["conv_id", *FACTS, "audit", "repaired_sha256"])

        for last, lines in _by_batch(batches):
            done = []
            for kind, role, value in lines:
                if kind == OPENS:
                    if known is not None:
                        done.append((known, digest.hexdigest()))
                    known, digest, first = value, hashlib.sha256(), True
                else:
                    digest.update(f"{'' if first else chr(10)}{role}:".encode())
                    digest.update(value.encode())
                    first = False
            yield batch_of(done, last)
        if known is not None:
            yield batch_of([(known, digest.hexdigest())], last)

    return stream.mapInArrow(write, f"conv_id {conv}, {', '.join(f'{n} bigint' for n in FACTS)}, audit string, repaired_sha256 string")

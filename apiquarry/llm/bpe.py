"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

A merge list decides how far to the right of a place the text can still change what happens there:
a merge is only prevented, or made possible, by merges of higher priority next to it, which depend on
merges of still higher priority next to them, and so on. ``lookahead`` follows these chains over the
whole list, in the order of priority, and returns the longest reach in bytes. The transducer merges a
window of a piece, emits the tokens that end more than that reach before the window's end, since they
are final whatever follows, and goes on from there: no merge crosses the end of an emitted token, so
what follows is encoded as if it began there. Its memory is one window, however long the piece.

Pieces are what the tokenizer's pattern splits a text into; special tokens' strings are cut out first.
Short pieces repeat, so each task remembers a bounded number of them.

Decoding feeds the bytes of the ids, some thousand at a time, to an incremental UTF-8 decoder, which
keeps the unfinished bytes of a character as its state and replaces invalid ones.

Defined results: NULL and empty texts have no ids and decode to the empty text. Any text, whatever its
length, decodes to itself. Repeated rows and NULL ids are encoded like any other; further columns are not
looked at by ``token_digests``, and passed through by ``encode_documents``.
"""

from __future__ import annotations

import codecs
import heapq
import json
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed pattern of byte-level tokenizers of this kind.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a task remembers, and the longest of them in characters.
CACHE_PIECES, CACHE_LENGTH = 500_000, 64
#: Ids that are decoded at a time.
DECODE_IDS = 8192
#: Ids are below 2^20.
MASK, NO_MERGE = (1 << 20) - 1, 1 << 62
#: Bytes of text per batch that a task returns.
BATCH_BYTES = 4 << 20


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tables of a byte-level BPE tokenizer file, and the transducer over them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items()}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in ids.items()}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            x, y = (ids[bytes(letters[c] for c in part)] for part in (a, b))
            self.merges[x, y] = (rank, ids[self.bytes_of[x] + self.bytes_of[y]])
        # the same with a pair as one number, and rank and new id as one
        self.joins = {x << 20 | y: rank << 20 | new for (x, y), (rank, new) in self.merges.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.lookahead = lookahead(self.merges, {i: len(b) for i, b in self.bytes_of.items()})
        self.longest = max(map(len, self.bytes_of.values()))
        #: Bytes merged at a time; some token is final in every window.
        self.window = 4 * (self.lookahead + self.longest)

    def merged(self, data: bytes) -> list[int]:
        """Ids of a window: the pair of the highest priority, the leftmost first, until none is left."""
        ids = [self.byte_ids[b] for b in data]
        if len(ids) > 256:
            return self._merged_long(ids)
        get, last = self.joins.get, len(ids) - 1
        ranks = [get(a << 20 | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_MERGE:
                break
            at = ranks.index(best)
            new = best & MASK
            ids[at : at + 2] = [new]
            del ranks[at]
            last -= 1
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | new, NO_MERGE)
            if at < last:
                ranks[at] = get(new << 20 | ids[at + 1], NO_MERGE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for windows of thousands of bytes."""
        n = len(ids)
        left, right = [*range(-1, n - 1)], [*range(1, n), -1]
        heap = [(found[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = self.merges[a, b][1], -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (found := self.merges.get((ids[k], ids[right[k]]))):
                    heapq.heappush(heap, (found[0], k, ids[k], ids[right[k]]))
        return [x for x in ids if x >= 0]

    def transduce(self, data: bytes, window: int | None = None) -> Iterator[int]:
        """Ids of one piece, emitted as soon as they are final."""
        window = window or self.window
        start = 0
        while len(data) - start > window:
            end, emitted = 0, 0
            for token in self.merged(data[start : start + window]):
                end += len(self.bytes_of[token])
                if end > window - self.lookahead:
                    break
                emitted = end
                yield token
            start += emitted
        yield from self.merged(data[start:])

    def encode(self, text: str, cache: PieceCache, special: bool = True) -> np.ndarray:
        """Ids of a whole text; without ``special``, strings of special tokens are ordinary text."""
        out, at = [], 0
        for found in self.cut.finditer(text) if self.cut and special else ():
            out += [*map(cache.__getitem__, self.pieces.findall(text, at, found.start())), np.int32(self.special[found.group()]).tobytes()]
            at = found.end()
        out.extend(map(cache.__getitem__, self.pieces.findall(text, at) if at else self.pieces.findall(text)))
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the decoder's state is the unfinished character."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        parts = [machine.decode(b"".join(map(self.bytes_of.__getitem__, ids[i : i + DECODE_IDS].tolist()))) for i in range(0, len(ids), DECODE_IDS)]
        return "".join(parts) + machine.decode(b"", True)


class PieceCache(dict):
    """Piece → its ids as bytes; emptied when full. Long pieces are not kept."""

    def __init__(self, bpe: Bpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        ids = array("i", self.bpe.merged(data) if len(data) <= self.bpe.window else self.bpe.transduce(data)).tobytes()
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def lookahead(merges: dict[tuple[int, int], tuple[int, int]], length: dict[int, int]) -> int:
    """Bytes to the right of a place that can still change the merges there.

    ``reach`` of a merge (x, y) counts from the border of x and y. It needs to see y; whether x and y are
    there depends on the merges that made them, and on those of higher priority that would consume one of
    them: (x, ·) and (·, y) at this border, (y, ·) at y's end, (·, x) at x's beginning. All of them have been
    looked at when the list is followed from the highest priority on.
    """
    made: dict[int, int] = {}  # token → reach of its making, from the border inside it
    inner: dict[int, tuple[int, int]] = {}  # token → lengths of its two parts
    first, second = defaultdict(int), defaultdict(int)  # token → reach of merges that begin or end with it
    longest = 0
    for (x, y), (_, new) in sorted(merges.items(), key=lambda m: m[1][0]):
        reach = length[y]
        if y in made:
            reach = max(reach, inner[y][0] + made[y])
        if x in made:
            reach = max(reach, made[x] - inner[x][1])
        reach = max(reach, first[x], second[y], length[y] + first[y], second[x] - length[x])
        first[x], second[y] = max(first[x], reach), max(second[y], reach)
        if reach >= made.get(new, 0):
            made[new], inner[new] = reach, (length[x], length[y])
        longest = max(longest, reach)
    return longest


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """Tables of a tokenizer file; read once per process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _batches(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BATCH_BYTES`` of text."""
    ends = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)])
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + BATCH_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the token ids of ``text`` and the text decoded from them as last columns."""
    if ids in docs.columns or decoded in docs.columns:
        raise ValueError("choose names that are not columns of docs")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0)]
    packed = docs.select(F.struct(*rest).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        cache = PieceCache(bpe)
        for whole in batches:
            for batch in _batches(whole, "text"):
                coded = [bpe.encode(x.as_py() or "", cache) for x in batch.column("text")]
                offsets = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded) if coded else np.empty(0, np.int32)))
                texts = pa.array([bpe.decode(x) for x in coded], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), lists, texts], names=["row", "text", "ids", "decoded"])

    schema = T.StructType([*packed.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    coded = packed.mapInArrow(run, schema)
    kept = [F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return coded.select(*kept, F.col("ids").alias(ids), F.col("decoded").alias(decoded))


def token_digests(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row."""
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    coded = encode_documents(slim, tokenizer)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

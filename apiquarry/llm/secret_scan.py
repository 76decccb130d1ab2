"""Secrets in texts: fixed patterns, and tokens that pass a battery of randomness tests.

Everything is a column expression. The pattern spans (``assign``, ``access``, ``hex``) are found by the
patterns below, leftmost first and not overlapping within a kind; matches that fail their length are
dropped. Besides, every run of code-like characters that mixes letters and digits is a candidate of
kind ``random``, with ``=`` only as the padding at its end, and so is every piece of it between slashes,
plus signs, or hyphens and underscores: names, paths and prefixes stand beside tokens without a space. Of
accepted candidates that overlap the longest stays. Its alphabet is inferred from the characters in it, and three tests ask whether its
characters could be independent uniform draws from it: chi-squared of its letters, the number of
runs above and below the alphabet's middle, and the correlation of neighbours. The three normal scores
are combined to one p-value.

Ordinary tokens have p-values near 0, random ones uniform p-values. For each (alphabet, band of lengths)
the upper quarter of the p-values therefore tells how many random tokens there are, and, once the quarter
below it has passed, the upper half. The threshold is the lowest at which no more than ``FALSE_SHARE`` of the
tokens above it are in excess of that: a false discovery control that knows that short tokens pass the tests
more easily. It is computed over the distinct tokens of all rows, as copies of one say nothing new. The
upper quarter is what the others are measured by, so nothing measures it.

Defined results: a NULL or empty text has no spans (the base digest is that of the empty string). Offsets
count code points, ends are exclusive. Candidates that overlap a pattern span are left out. Repeated rows
and NULL ids get their own row each. Further columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiquarry.functions.text import let
from apiquarry.session import cut_lineage

#: Fixed pattern; group 2 is the value. Those of the other kinds are in ``PATTERNS``.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")
#: Runs that hold the candidates of the battery; a candidate has ``SHORTEST`` characters with its padding.
CANDIDATE = r"[A-Za-z0-9+/_-]{14,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
SHORTEST = 20
#: Inferred alphabets: name, pattern, letters in order. The first that fits is taken.
ALPHABETS = (
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", r"^[A-Za-z0-9]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Upper ends of the bands of lengths.
BANDS = (24, 32, 48, 64, 128)
BINS = 20
FALSE_SHARE = 0.1
#: The lowest bin of p-values is never taken, however many random tokens there are.
FLOOR = 1
#: Where every match that is long enough is one of a bounded pattern, and the other way round, the bounded one is used.
PATTERNS = (ASSIGN, rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", rf"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}", CANDIDATE)

_SPANS = "array<struct<start:int,stop:int,found:string>>"


def _placed(found: Column, gaps: Column) -> Column:
    """Matches with their places, from the matches and the texts between them: ``_SPANS``."""
    steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("long"), m.alias("found")))

    def step(done: Column, m: Column) -> Column:
        at = done["at"] + m["gap"]
        span = F.struct(at.alias("start"), (at + m["long"]).alias("stop"), m["found"].alias("found"))
        return F.struct((at + m["long"]).alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out")), step, lambda done: done["out"])


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def _tail(z: Column) -> Column:
    """P(N > z) of a standard normal, to about 1e-4."""
    return let(z, lambda z: 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), 0.07056 * z * z * z + 1.5976 * z)))))


def battery(codes: Column, letters: Column) -> Column:
    """p-value of an array of places 1 … ``letters`` being independent and uniform.

    Chi-squared over the letters, runs above and below the middle, and neighbour correlation give
    one normal score each; the sum of their squares is chi-squared with three degrees of freedom
    (cube-root approximation).
    """
    n, steps = F.size(codes).cast("double"), (F.size(codes) - 1).cast("double")
    parts = F.transform(F.sequence(F.lit(1), letters.cast("int")), lambda j: F.size(F.filter(codes, lambda c: c == j)).cast("double"))
    chi = F.aggregate(parts, F.lit(0.0), lambda total, x: total + x * x) * letters / n - n
    uniform = (chi - (letters - 1)) / F.sqrt(2.0 * (letters - 1) * (n - 1) / n)
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    half, middle = letters / 2, (letters + 1) / 2
    changes = F.size(F.filter(pairs, lambda p: (p["a"] > half) != (p["b"] > half))).cast("double")
    runs = (changes - steps / 2) / F.sqrt(steps / 4)
    product = F.aggregate(pairs, F.lit(0.0), lambda total, p: total + (p["a"] - middle) * (p["b"] - middle))
    serial = product / F.sqrt(steps) / ((letters * letters - 1) / 12)
    # changes of side and products of neighbours go together; what is left of the products does not
    shared = 0.75 * letters * letters / (letters * letters - 1)
    serial = (serial + shared * runs) / F.sqrt(1 - shared * shared)
    square = F.aggregate(F.array(uniform, runs, serial), F.lit(0.0), lambda total, z: total + z * z)
    return _tail((F.pow(square / 3, F.lit(1 / 3)) - (1 - 2 / 27)) / math.sqrt(2 / 27))


def _tested(token: Column) -> Column:
    """``struct<alphabet, band, p>`` of a candidate; NULL p where no alphabet fits or letters or digits are missing."""
    name, letters = F.lit(None).cast("string"), F.lit(None).cast("string")
    for which, pattern, order in reversed(ALPHABETS):
        fits = token.rlike(pattern)
        name, letters = F.when(fits, F.lit(which)).otherwise(name), F.when(fits, F.lit(order)).otherwise(letters)
    body = F.rtrim(token, F.lit("="))
    which = F.struct(name.alias("name"), letters.alias("letters"))
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (F.length(body) > 1)
    band = F.lit(len(BANDS))
    for i, end in reversed([*enumerate(BANDS)]):
        band = F.when(F.length(token) <= end, F.lit(i)).otherwise(band)

    def p(letters: Column) -> Column:
        return let(F.transform(F.split(body, ""), lambda c: F.position(c, letters)), lambda codes: battery(codes, F.length(letters).cast("double")))

    # bound by ``let``: inside a lambda an expression is computed as often as it is named
    return let(which, lambda a: F.struct(a["name"].alias("alphabet"), band.alias("band"), F.when(mixed & a["name"].isNotNull(), p(a["letters"])).alias("p")))


def _mixed(span: Column) -> Column:
    return (F.length(span["found"]) >= SHORTEST) & span["found"].rlike("[0-9]") & span["found"].rlike("[A-Za-z]")


def _cut(span: Column, mark: str) -> Column:
    """Pieces of a span between the characters ``mark`` that can be candidates: ``_SPANS``."""

    def step(done: Column, piece: Column) -> Column:
        stop = done["at"] + F.length(piece)
        own = F.struct(done["at"].alias("start"), stop.alias("stop"), piece.alias("found"))
        return F.struct((stop + 1).alias("at"), F.when(_mixed(own), F.concat(done["out"], F.array(own))).otherwise(done["out"]).alias("out"))

    start = F.struct(span["start"].alias("at"), F.array().cast(_SPANS).alias("out"))
    return F.aggregate(F.split(span["found"], mark, -1), start, step, lambda done: done["out"])


def _pieces(runs: DataFrame, name: str) -> DataFrame:
    """Runs in ``name``, and their pieces: cut at slashes, then at plus signs, then at hyphens and underscores, or at these only."""

    def cut(spans: str, mark: str, whole: bool) -> Column:
        return F.flatten(F.transform(spans, lambda s: F.when(s["found"].rlike(mark), _cut(s, mark)).otherwise(F.array(s) if whole else F.array().cast(_SPANS))))

    out = runs.withColumn(name, F.filter(name, _mixed))
    out = out.withColumns({"c1": cut(name, "/", True), "n1": cut(name, "/", False), "n4": F.filter(cut(name, "[_-]", False), lambda s: s["found"].rlike("[+/]"))})
    out = out.withColumns({"c2": cut("c1", r"\+", True), "n2": cut("c1", r"\+", False)}).withColumn("n3", cut("c2", "[_-]", False))
    return out.withColumn(name, F.concat(name, "n1", "n2", "n3", "n4")).drop("c1", "c2", "n1", "n2", "n3", "n4")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, base, tested`` per row: spans ``(start, order, stop)`` of the patterns, and candidates with their tests."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.select(F.col(f"`{key}`").alias("doc_id"), body.alias("body"), *[F.regexp_extract_all(body, F.lit(p), F.lit(0)).alias(f"m{i}") for i, p in enumerate(PATTERNS)])
    gaps = found.select("*", *[F.when(F.size(f"m{i}") > 0, F.split("body", p, -1)).otherwise(F.array().cast("array<string>")).alias(f"g{i}") for i, p in enumerate(PATTERNS)])
    placed = gaps.select("doc_id", *[_placed(F.col(f"m{i}"), F.col(f"g{i}")).alias(f"s{i}") for i in range(len(PATTERNS))])
    placed = placed.withColumn("s0", F.filter("s0", lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= LEAST["assign"]))

    def spans(i: int) -> Column:
        return F.transform(f"s{i}", lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("order"), s["stop"].alias("stop")))

    based = placed.select("doc_id", F.array_sort(F.concat(spans(0), spans(1), spans(2))).alias("base"), "s3")
    free = _pieces(based, "s3").withColumn("s3", F.filter("s3", lambda c: ~F.exists("base", lambda b: _overlaps(b, c))))
    tested = F.transform("s3", lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.xxhash64(c["found"]).alias("hash"), _tested(c["found"]).alias("t")))
    return free.select("doc_id", "base", F.filter(tested, lambda c: c["t"]["p"].isNotNull()).alias("tested"))


def thresholds(scanned: DataFrame) -> dict[tuple[str, int], float]:
    """Least p-value taken of each (alphabet, band of lengths) that has random tokens.

    The counts that are fetched are at most alphabets × bands × bins.
    """
    tests = scanned.select(F.explode("tested").alias("c")).select("c.t.alphabet", "c.t.band", F.least(F.lit(BINS - 1), F.floor(F.col("c.t.p") * BINS)).alias("bin"), "c.hash")
    # the distinct tokens are dealt by all four columns, so copies of one are combined before they move
    counts = tests.distinct().groupBy("alphabet", "band", "bin").count().collect()
    groups: dict[tuple[str, int], list[int]] = {}
    for alphabet, band, place, count in counts:
        groups.setdefault((alphabet, band), [0] * BINS)[place] = count
    return {group: least / BINS for group, own in groups.items() if (least := _least_bin(own)) is not None}


def _least_bin(own: list[int]) -> int | None:
    """Lowest bin taken of the counts of distinct tokens per bin; None where none is."""
    quarter, half = BINS * 3 // 4, BINS // 2
    above, out = sum(own[quarter:]), None
    uniform, known = above / (BINS - quarter), above
    if above:
        out = quarter
    for place in range(quarter - 1, FLOOR - 1, -1):
        if place == half - 1:
            uniform, known = above / (BINS - half), above
        above += own[place]
        expected = uniform * (BINS - place)
        # what exceeds the flat share may be chance, too, of these counts and of those the share is from
        chance = math.sqrt(expected + (expected * expected / known if known else 0))
        if above - expected > FALSE_SHARE * above + 2 * chance:
            break
        if above:
            out = place
    return out


def secret_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, base, spans`` per row, each an array of ``(start, order, stop)`` by start, then kind."""
    scanned = cut_lineage(scan(docs, text, key))
    taken = thresholds(scanned)

    def passes(c: Column) -> Column:
        t = c["t"]
        return F.coalesce(*[F.when((t["alphabet"] == a) & (t["band"] == b), t["p"] >= p) for (a, b), p in sorted(taken.items())], F.lit(False))

    longest = F.array_sort(F.transform(F.filter("tested", passes), lambda c: F.struct((c["start"] - c["stop"]).alias("less"), c["start"].alias("start"), c["stop"].alias("stop"))))
    apart = F.aggregate(longest, F.array().cast("array<struct<less:int,start:int,stop:int>>"), lambda kept, c: F.when(F.exists(kept, lambda k: _overlaps(k, c)), kept).otherwise(F.concat(kept, F.array(c))))
    random = F.transform(apart, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("order"), c["stop"].alias("stop")))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def _written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` per row."""
    found = secret_spans(docs, text, key)

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["order"] == i)).cast("bigint").alias(f"n_{KINDS[i]}")

    return found.select("doc_id", count(0), count(1), count(2), F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans"), count(3))

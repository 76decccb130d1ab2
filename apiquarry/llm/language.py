"""Languages of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per page: the likelihood of its visible text under hashed
byte trigrams of each language, the language its markup declares, the suffix of its address, and what
is usual on its host. The trigram model is learned from a bounded sample of the documents of each known
language, so a rare language is one however many documents others have. Everything else is learned from the pages themselves, by grouped aggregation of the posteriors
that the text alone gives: how often a declaration or a suffix goes with a language, and a prior per host
that is smoothed towards its domain's, which is smoothed towards that of all pages. A page's own share is
taken out of its host's and domain's counts. Neighbouring trigrams are not independent, so a text of n of them
counts as ``n / (1 + n / EFFECTIVE)``.

Declarations are known languages, ``other`` or ``none``; suffixes are country codes, a few general names, or
``other``: a bounded number of either, which is why their tables are constants of the last step.

Defined results: a NULL or empty page, or one without letters, is judged by its address alone; a NULL or
malformed address has an empty host; ties go to the first language by name; without any document to learn
from ``language`` is NULL. NULL ids and repeated rows get a row each. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apiquarry.llm.rows import maybe_in
from apiquarry.session import cut_lineage

PLACES = 1 << 16
#: Documents a language is learned from, at most.
FIT_ROWS = 1000
EFFECTIVE = 200.0
#: Weight of the level above, in pages.
SMOOTH = 5.0
SUFFIXES = ("com", "org", "net", "edu", "gov", "info")
#: Copies of the rows of a host or domain when pages of hot hosts are joined with them, from this number of pages on.
SALTS, HOT = 64, 1000


def trigram_places(data: bytes) -> np.ndarray:
    """Hashed places of the byte trigrams of a lower-cased text, runs of other than letters being one space."""
    raw = np.frombuffer(data, dtype=np.uint8)
    lower = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
    letter = ((lower >= 97) & (lower <= 122)) | (raw >= 128)
    keep = letter | np.append(True, letter[:-1])[: len(letter)]
    x = np.where(letter, lower, 32)[keep].astype(np.uint32)
    if len(x) < 3:
        return np.empty(0, dtype=np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


class TrigramModel:
    """Languages and, for each, the logarithms of the shares of trigram places."""

    def __init__(self, languages: list[str], logs: np.ndarray) -> None:
        self.languages, self.logs = languages, logs

    def likelihoods(self, data: bytes) -> np.ndarray:
        """Tempered log-likelihood of a text per language."""
        at = trigram_places(data)
        if not len(at):
            return np.zeros(len(self.languages))
        counts = np.bincount(at, minlength=PLACES)
        used = np.flatnonzero(counts)
        return self.logs[:, used] @ counts[used] / (1 + len(at) / EFFECTIVE)


def fit_trigrams(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = FIT_ROWS) -> TrigramModel:
    """Learn each language from the ``rows`` ids with the smallest hashes among its documents."""
    known = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{key}`").alias("c_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    known = known.filter("lang is not null and c_id is not null")
    # cut to ``rows`` ids inside salts first, so that a language with most documents is no task of its own
    ids = known.select("lang", "c_id").distinct().withColumn("order", F.xxhash64("c_id"))
    for part in (["lang", F.pmod("order", F.lit(SALTS))], ["lang"]):
        window = Window.partitionBy(*part).orderBy("order", "c_id")
        ids = ids.withColumn("nth", F.row_number().over(window)).filter(F.col("nth") <= rows).drop("nth")
    chosen = cut_lineage(ids.select("lang", "c_id"))
    # texts that are not in the sample are dropped where they are read
    sample = maybe_in(known, F.col("c_id"), chosen.select("c_id")).join(chosen, ["lang", "c_id"]).select("lang", F.col("body").cast("binary").alias("body"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang_, body in zip(batch["lang"], batch["body"]):
                own[lang_] = own.get(lang_, 0) + np.bincount(trigram_places(bytes(body)), minlength=PLACES)
        yield pd.DataFrame({"lang": pd.Series(list(own), dtype=object), "counts": [c.astype(np.int64).tobytes() for c in own.values()]})

    def combined(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, dtype=np.int64) for c in parts["counts"]], axis=0)
        return pd.DataFrame({"lang": [parts["lang"].iloc[0]], "counts": [total.tobytes()]})

    schema = "lang string, counts binary"
    # one row a language
    total = sample.mapInPandas(sums, schema).groupBy("lang").applyInPandas(combined, schema).collect()
    total = {part.lang: np.frombuffer(part.counts, dtype=np.int64) for part in total}
    languages = sorted(total)
    counts = np.array([total[x] + 0.5 for x in languages]).reshape(len(languages), PLACES)
    return TrigramModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags; entities are left as they are."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")


def _page_facts(pages: DataFrame, model: TrigramModel, html: str, url: str, key: str) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def likelihoods(body: pd.Series) -> pd.Series:
        return body.map(lambda x: model.likelihoods(bytes(x)))

    markup = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    said = F.lower(F.regexp_extract(markup, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z]+)$", 1)
    facts = pages.select(
        F.col(f"`{key}`").alias("page_id"), host.alias("host"), F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1).alias("domain"),
        F.when(suffix.rlike("^[a-z]{2}$") | suffix.isin(*SUFFIXES), suffix).otherwise("other").alias("suffix"),
        F.when(said == "", "none").when(said.isin(*model.languages), said).otherwise("other").alias("declared"),
        likelihoods(visible_text(F.col(f"`{html}`")).cast("binary")).alias("likelihood"),
    )
    top = F.array_max("likelihood")
    raised = facts.withColumn("raised", F.transform("likelihood", lambda x: F.exp(x - top)))
    total = F.aggregate("raised", F.lit(0.0), lambda a, x: a + x)
    return raised.withColumn("share", F.transform("raised", lambda x: x / total)).drop("raised")


def _sums(k: int, name: str) -> list[Column]:
    return [F.array(*[F.sum(F.col("share")[i]) for i in range(k)]).alias(name), F.count("*").alias(f"{name}_pages")]


def _with_group(pages: DataFrame, groups: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Join pages with the row of their group; rows of groups with many pages are copied to salts."""
    copies = F.when(F.col(f"{by}_sums_pages") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    salted = groups.select(F.col(by).alias(f"g_{by}"), *columns, F.explode(copies).alias("g_salt"))
    spread = F.pmod(F.xxhash64("page_id", "likelihood"), F.lit(SALTS)).cast("int")
    cold = salted.filter("g_salt = -1")
    hot = salted.filter("g_salt >= 0")
    names = [F.col(c).alias(f"h_{c}") for c in columns]
    out = pages.join(cold.drop("g_salt"), F.col(by) == F.col(f"g_{by}"), "left").drop(f"g_{by}").withColumn("g_spread", spread)
    out = out.join(hot.select(F.col(f"g_{by}"), "g_salt", *names), (F.col(by) == F.col(f"g_{by}")) & (F.col("g_spread") == F.col("g_salt")), "left")
    rest = [c for c in pages.columns]
    return out.select(*rest, *[F.coalesce(c, f"h_{c}").alias(c) for c in columns])


def page_languages(
    pages: DataFrame, docs: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", text: str = "text", lang: str = "lang", doc_key: str = "doc_id",
) -> DataFrame:
    """``page_id, host, declared, language, probability, text_language`` per page."""
    model = fit_trigrams(docs, text, lang, doc_key)
    k = len(model.languages)
    if not k:
        empty = F.lit(None).cast("string")
        return pages.select(F.col(f"`{key}`").alias("page_id"), empty.alias("host"), empty.alias("declared"), empty.alias("language"), F.lit(None).cast("double").alias("probability"), empty.alias("text_language"))
    facts = cut_lineage(_page_facts(pages, model, html, url, key))
    # one row, and a bounded number of rows for each declaration and suffix
    all_row = facts.agg(*_sums(k, "sums")).first()
    base = (np.array([x or 0.0 for x in all_row.sums]) + 1) / (all_row.sums_pages + k)

    def evidence(by: str) -> Column:
        rows = {r[by]: np.array(r.sums) for r in facts.groupBy(by).agg(*_sums(k, "sums")).collect()}
        per_language = sum(rows.values(), np.zeros(k)) + SMOOTH
        pages_of = sum(r.sum() for r in rows.values()) + 1
        table = {name: np.log((own + SMOOTH * own.sum() / pages_of) / per_language) for name, own in rows.items()}
        pairs = [x for name, logs in table.items() for x in (F.lit(name), F.array(*[F.lit(float(v)) for v in logs]))]
        return F.element_at(F.create_map(*pairs), F.col(by)) if pairs else F.array(*[F.lit(0.0)] * k)

    hosts = cut_lineage(facts.groupBy("host", "domain").agg(*_sums(k, "host_sums")))
    domains = cut_lineage(hosts.groupBy("domain").agg(F.array(*[F.sum(F.col("host_sums")[i]) for i in range(k)]).alias("domain_sums"), F.sum("host_sums_pages").alias("domain_sums_pages")))
    joined = _with_group(facts, hosts.drop("domain"), "host", ["host_sums", "host_sums_pages"])
    joined = _with_group(joined, domains, "domain", ["domain_sums", "domain_sums_pages"])
    place = F.sequence(F.lit(0), F.lit(k - 1))
    root = F.array(*[F.lit(float(x)) for x in base])
    # a page's own share does not speak for its host
    domain = F.transform(place, lambda i: (F.greatest(F.lit(0.0), F.get("domain_sums", i) - F.get("share", i)) + SMOOTH * F.get(root, i)) / (F.col("domain_sums_pages") - 1 + SMOOTH))
    with_domain = joined.withColumn("domain_prior", domain)
    host = F.transform(place, lambda i: (F.greatest(F.lit(0.0), F.get("host_sums", i) - F.get("share", i)) + SMOOTH * F.get("domain_prior", i)) / (F.col("host_sums_pages") - 1 + SMOOTH))
    fused = with_domain.withColumn("prior", host).withColumn("said", evidence("declared")).withColumn("ends", evidence("suffix"))
    logs = F.transform(place, lambda i: F.get("likelihood", i) + F.log(F.get("prior", i)) + F.get("said", i) + F.get("ends", i))
    scored = fused.withColumn("logs", logs).withColumn("best", F.array_max("logs"))
    names = F.array(*map(F.lit, model.languages))

    def first_best(scores: str) -> Column:
        return F.get(names, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))

    probability = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    silent = F.array_max("likelihood") == F.array_min("likelihood")
    return scored.select(
        "page_id", "host", "declared", first_best("logs").alias("language"), probability.alias("probability"),
        F.when(~silent, first_best("likelihood")).alias("text_language"),
    )

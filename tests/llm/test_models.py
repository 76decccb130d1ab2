import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from apiquarry.llm import labelled, language, quality, toxicity

from . import cases

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = (y == 1).sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (y == 0).sum())


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_fold(spark):
    got = spark.range(50).select("id", labelled.held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_quality_on_held_out_documents(spark, tables):
    scored = quality.quality_scores(*tables).join(tables[1], "doc_id").filter("held_out").toPandas()
    assert auc(scored["quality"].to_numpy(), scored["score"].to_numpy()) > 0.95
    assert ((scored["predicted"] == scored["quality"]).mean()) > 0.93


def test_toxicity_on_held_out_documents(spark, tables):
    scored = toxicity.toxicity_scores(*tables).join(tables[1], "doc_id").filter("held_out").toPandas()
    assert auc(scored["toxic"].to_numpy(), scored["score"].to_numpy()) > 0.6
    assert scored[scored["toxic"] == 0]["predicted"].mean() < 0.05


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_odd_rows_get_scores(spark, tables, score):
    docs = cases.odd(spark)
    for labels in (tables[1].limit(0), spark.createDataFrame([(1, 1, 1), (9, 1, 1), (None, 0, 0), (4, None, 3)], "doc_id bigint, quality int, toxic int")):
        rows = score(docs, labels).collect()
        assert len(rows) == len(cases.ROWS)
        assert all(0 <= r.score <= 1 for r in rows)
    assert score(cases.empty(spark), tables[1]).count() == 0


def test_quality_without_labels_is_undecided(spark, tables):
    assert {round(r.score, 9) for r in quality.quality_scores(cases.odd(spark), tables[1].limit(0)).collect()} == {0.5}


def test_isotonic_fit_rises_and_keeps_the_mean():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=500), (rng.random(500) < 0.4).astype(float)
    knots, values = quality.pool_adjacent(x, y)
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    assert values.min() <= y.mean() <= values.max()


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    k = len(quality.STATISTICS)
    model = quality.QualityModel(
        np.zeros(k), np.ones(k), rng.normal(size=(k, quality.FEATURES)) / quality.WIDTH, rng.uniform(0, 2 * np.pi, quality.FEATURES), np.zeros(quality.FEATURES + 1), np.zeros(1), np.zeros(1)
    )
    a, b = rng.normal(size=(2, 20, k))
    z, w = model.features(a)[:, :-1], model.features(b)[:, :-1]
    exact = np.exp(-((a - b) ** 2).sum(axis=1) / (2 * quality.WIDTH**2))
    assert np.abs((z * w).sum(axis=1) - exact).max() < 0.25


def test_ftrl_drops_weights_without_evidence():
    rng = np.random.default_rng(2)
    rows = [np.unique(np.append(rng.integers(100, 1000, 20), 7 if i % 4 == 0 else 8)).astype(np.int32) for i in range(400)]
    labels = np.array([float(i % 4 == 0) for i in range(400)])
    z, n = np.zeros(2001, dtype=np.float32), np.zeros(2001, dtype=np.float32)
    for _ in range(4):
        toxicity.ftrl_pass(z, n, rows, labels)
    w = toxicity.ftrl_weights(z, n, np.arange(2001) == 2000)
    assert w[7] > 0.5 and np.abs(np.delete(w, [7, 8, 2000])).max() < w[7] and (w[1000:2000] == 0).all()


PAGES = "page_id bigint, url string, html string, host string, likelihood int"


def page(i, lang, body, url="http://www.site.example.com/x"):
    return (i, url, None if body is None else f'<html lang="{lang}"><head><style>p{{}}</style></head><body><script>var der = "die das";</script><p>{body}</p></body></html>', "h", 1)


def test_languages_of_pages(spark, tables):
    docs = tables[0]
    texts = {r.lang: r.text for r in docs.filter("length(text) > 800").collect()}
    rows = [page(i, lang, texts[lang][:600]) for i, lang in enumerate(sorted(texts) * 3)]
    rows += [page(50, "de", texts["en"][:700]), page(51, "zz", texts["fr"][:300]), page(52, "en", ""), page(53, None, None), page(None, "es", texts["es"][:200], None), page(54, "en", texts["en"][:300], "not a url"), page(54, "en", texts["en"][:300], "not a url")]
    got = language.page_languages(spark.createDataFrame(rows, PAGES), docs).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, lang in enumerate(sorted(texts) * 3):
        assert by_id[i].language == lang
    assert by_id[50].language == "en" and by_id[51].language == "fr" and by_id[None].language == "es"
    assert by_id[52].text_language is None and by_id[53].language is not None
    assert by_id[54].host == "" and by_id[50].host == "www.site.example.com"
    assert all(0 < r.probability <= 1 for r in got)


def test_rare_languages_stay(spark):
    lines = {"en": "the house is on the hill and the dog is in it", "de": "das Haus steht auf dem Berg und der Hund ist darin", "nl": "het huis staat op de heuvel en de hond is erin"}
    rows = [(i, "en", lines["en"]) for i in range(60)] + [(100 + i, "de", lines["de"]) for i in range(9)] + [(200, "nl", lines["nl"]), (201, None, "x"), (None, "xx", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    model = language.fit_trigrams(docs, rows=5)
    assert model.languages == ["de", "en", "nl"]
    for lang, line in lines.items():
        assert model.languages[int(model.likelihoods((line + ". " + line).encode()).argmax())] == lang


def test_languages_of_nothing(spark, tables):
    nothing = spark.createDataFrame([], PAGES)
    assert language.page_languages(nothing, tables[0]).count() == 0
    rows = language.page_languages(spark.createDataFrame([page(1, "en", "hello")], PAGES), cases.empty(spark)).collect()
    assert [r.language for r in rows] == [None]


def test_hot_hosts_are_salted_without_loss(spark, tables, monkeypatch):
    monkeypatch.setattr(language, "HOT", 3)
    texts = {r.lang: r.text for r in tables[0].filter("length(text) > 800").collect()}
    rows = [page(i, "en", texts["en"][i : i + 300]) for i in range(20)] + [page(99, "fr", texts["fr"][:300], "http://other.example.org/")]
    got = language.page_languages(spark.createDataFrame(rows, PAGES), tables[0]).collect()
    assert sorted((r.page_id, r.language) for r in got) == [*((i, "en") for i in range(20)), (99, "fr")]

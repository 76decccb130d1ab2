import collections
import hashlib
import math
import random
import re
import statistics

import regex

from apiquarry.llm import quality_rules as rules
from apiquarry.llm import queries

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def divergence(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    return sum(x * math.log2(2 * x / (x + y)) for a, b in ((p, q), (q, p)) for x, y in zip(a, b) if x) / 2


def brute(rows):
    """(base counts, kept) of each (text, lang): everything in plain loops."""
    texts = [(t or "", lang) for t, lang in rows]
    terms = [regex.findall(r"\p{L}+", t.lower()) for t, _ in texts]
    by_lang = collections.defaultdict(list)
    for i, (_, lang) in enumerate(texts):
        by_lang[lang].append(i)
    classes = []
    for t, _ in texts:
        own = []
        for pattern in rules.CLASSES:
            rest = regex.sub(pattern, "", t)
            own.append(len(t) - len(rest))
            t = rest
        classes.append([*own, len(t)])
    refs = {}
    for lang, members in by_lang.items():
        if len(members) * rules.LANGUAGE_SHARE < len(texts):
            continue
        df = collections.Counter(w for i in members for w in set(terms[i]) if len(w) <= rules.LONGEST_TERM)
        words = sorted(df, key=lambda w: (-df[w], w.encode()))[: rules.COMMON]
        letters = [i for i in members if sum(classes[i]) - classes[i][1] >= rules.LEAST_LETTERS]
        if not letters:
            continue
        steps = [sorted(math.floor(rules.STEPS * classes[i][c] / sum(classes[i]) + 0.5) for i in letters) for c in range(len(rules.CLASSES) + 1)]
        shares = [s[(len(s) + 1) // 2 - 1] / rules.STEPS for s in steps]
        parts = collections.defaultdict(list)
        for i in members:
            parts[int(hashlib.md5(texts[i][0].encode()).hexdigest()[:2], 16) % rules.PARTS].append(i)
        said = {p: sum(len(terms[i]) for i in m) for p, m in parts.items()}
        usual = [statistics.median_low([sum(terms[i].count(w) for i in m) / said[p] for p, m in parts.items() if said[p]]) for w in words]
        refs[lang] = words, shares, usual
    out = []
    for i, (t, lang) in enumerate(texts):
        base = brute_base(t)
        far = False
        if lang in refs and not base[-1]:
            words, shares, usual = refs[lang]
            n = sum(classes[i]) - classes[i][1]
            if n >= rules.LEAST_LETTERS:
                far |= divergence(classes[i], shares) > rules.FAR_CLASSES**2 + len(rules.CLASSES) / (8 * math.log(2) * n)
            n = len(terms[i])
            if n >= rules.LEAST_WORDS and len(words) > 1:
                common = [terms[i].count(w) for w in words]
                far |= divergence([*common, n - sum(common)], [*usual, 1 - sum(usual)]) > rules.FAR_WORDS**2 + len(words) / (8 * math.log(2) * n)
        out.append((*base, not base[-1] and not far))
    return out


def check(spark, docs, rows):
    got = rules.judged(docs).collect()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = [(r[0], *b) for r, b in zip(rows, brute([(r[1], r[2]) for r in rows]))]
    assert sorted([(r.doc_id, *(r[c] for c in counts)) for r in got], key=repr) == sorted(want, key=repr)
    return want


def test_odd_rows(spark):
    check(spark, cases.odd(spark), cases.ROWS)
    assert rules.judged(cases.empty(spark)).collect() == []


def test_junk_goes_and_a_hot_group_of_copies_moves_nothing(spark):
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(2, 9))) for _ in range(600)]
    weights = [1 / (i + 1) for i in range(600)]

    def prose(n):
        return " ".join(draw.choices(vocabulary, weights, k=n)).capitalize() + "."

    rows = [cases.row(i, prose(draw.randrange(60, 400))) for i in range(120)]
    shout = " ".join(f"{w.upper()}!!" for w in draw.choices(vocabulary, k=200))
    table = " | ".join(draw.sample(vocabulary[200:], 300))
    rows += [cases.row(1000 + i, shout) for i in range(50)] + [cases.row(2000, table)]
    rows = [(r[0], r[1], "xx", *r[3:]) for r in rows]
    want = check(spark, spark.createDataFrame(rows, cases.SCHEMA), rows)
    kept = {w[0] for w in want if w[-1]}
    assert kept == {i for i in range(120) if not brute_base(rows[i][1])[-1]} and len(kept) > 80


def test_very_long_and_repetitive_texts(spark):
    words = [f"w{i % 7000}" for i in range(200_000)]
    rows = [cases.row(1, " ".join(words)), cases.row(2, "\n".join(["a line"] * 30_000)), cases.row(3, "x" * 1_000_000), cases.row(4, " # " * 100_000), cases.row(5, " ".join(f"u{i}" for i in range(100_000)))]
    check(spark, spark.createDataFrame(rows, cases.SCHEMA), rows)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = [tuple(r) for r in queries.QUERIES["op11_quality_rules"](spark, SF).collect()]
    assert sorted(got) == sorted((r[0], *b) for r, b in zip(rows, brute([r[1:] for r in rows])))


def test_no_python_in_the_plan(spark):
    plan = rules.measured(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rare_languages_are_compared_too(spark, monkeypatch):
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(2, 9))) for _ in range(300)]

    def text():
        return " ".join(draw.choices(vocabulary, [1 / (i + 1) for i in range(300)], k=150)) + "."

    rows = [cases.row(i, text(), lang="en") for i in range(40)] + [cases.row(100 + i, text(), lang="xx") for i in range(6)] + [cases.row(200 + i, text(), lang=None) for i in range(6)]
    rows += [cases.row(300, " ".join(f"{i}#{i * i}" for i in range(150)), lang="xx"), cases.row(301, " ".join(f"{i}#{i * i}" for i in range(150)), lang=None)]
    want = [(r[0], b[-1]) for r, b in zip(rows, brute([(r[1], r[2]) for r in rows]))]
    assert (300, False) in want and (301, False) in want
    monkeypatch.setattr(rules, "LANGUAGE_SHARE", 2)
    got = rules.judged(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == sorted(want)
    assert all(r.class_distance is not None for r in got if not r.base_failed)

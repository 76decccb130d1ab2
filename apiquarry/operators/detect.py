"""Which frameworks a project uses, and where it probably listens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiquarry.functions.http import language_of
from apiquarry.functions.text import strip
from apiquarry.sources.files import file_route

P = "project_id"

# Frameworks in the order that breaks ties, and the port each usually takes.
FRAMEWORKS = ["fastapi", "flask", "django", "nextjs", "express", "go"]
DEFAULT_PORTS = {
    "fastapi": (8000, "uvicorn default"),
    "flask": (5000, "Flask default"),
    "django": (8000, "Django default"),
    "nextjs": (3000, "Next.js default"),
    "express": (3000, "the usual Express choice"),
    "go": (8080, "the usual Go choice"),
}
# Fixed values: (framework, rule, points, languages, texts of which one must occur).
IMPORT_RULES = [
    ("fastapi", "import", 3, ["python"], ["from fastapi import", "import fastapi"]),
    ("flask", "import", 3, ["python"], ["from flask import", "import flask"]),
    ("django", "import", 3, ["python"], ["from django", "import django"]),
    ("django", "rest_framework", 1, ["python"], ["rest_framework"]),
    (
        "express", "import", 3, ["javascript", "typescript"],
        ["require('express')", 'require("express")', "from 'express'", 'from "express"'],
    ),
    ("go", "net/http", 3, ["go"], ["http.HandleFunc(", "http.Handle(", "http.NewServeMux("]),
]
GO_MODULES = {
    "gin": "github.com/gin-gonic/gin",
    "echo": "github.com/labstack/echo",
    "chi": "github.com/go-chi/chi",
    "fiber": "github.com/gofiber/fiber",
    "gorilla/mux": "github.com/gorilla/mux",
}
RUN_WORDS = [
    "uvicorn", "gunicorn", "hypercorn", "flask run", "flask --app", "runserver", "daphne", "next dev", "next start",
    "node ", "nodemon", "ts-node", "tsx ",
]
RUN_MANIFESTS = ["Procfile", "Makefile", "docker-compose.yml", "Dockerfile", "package.json"]
COMPOSE_MANIFESTS = ["docker-compose.yml", "docker-compose.yaml", "compose.yml"]
ENV_MANIFESTS = [".env", ".env.local", ".env.example"]


def _has_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def _lines(c: Column) -> Column:
    return F.split(c, r"\r?\n", -1)


def mentions(content: Column, word: str) -> Column:
    """A manifest line other than a ``#`` comment contains the word."""
    return F.exists(_lines(content), lambda l: ~strip(l).startswith("#") & F.contains(F.lower(l), F.lit(word.lower())))


def detect_frameworks(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(project_id, framework, score, evidence) where the score is above zero.

    Every file turns into the few rules it satisfies; a rule scores once per project however
    many files match, except a Go requirement, which scores once per ``go.mod``. Only hits are
    shuffled, combined before the shuffle.
    """

    def hit(framework: str, rule: str, points: int, when: Column, scope: Column | None = None) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(framework).alias("framework"), F.lit(rule).alias("rule"), F.lit(points).alias("points"),
                (scope if scope is not None else F.lit("")).alias("scope"),
            ),
        )

    text, name, path = F.col("content"), F.col("name"), F.col("path")
    declared = [hit(f, "manifest", 1, mentions(text, f)) for f in ("fastapi", "flask", "django")]
    declared += [
        hit("django", "manage.py", 2, name == "manage.py"),
        hit("nextjs", "package.json", 2, (name == "package.json") & F.contains(text, F.lit('"next"'))),
        hit("nextjs", "next.config", 2, name.isin("next.config.js", "next.config.mjs", "next.config.ts")),
        hit("express", "package.json", 1, (name == "package.json") & F.contains(text, F.lit('"express"'))),
    ]
    language = F.coalesce(language_of(path), F.lit(""))
    seen = [hit(f, r, p, language.isin(ls) & _has_any(text, ws)) for f, r, p, ls, ws in IMPORT_RULES]
    for short, module in GO_MODULES.items():
        seen.append(hit("go", f"import {short}", 3, (language == "go") & _has_any(text, [f'"{module}"', f'"{module}/'])))
        seen.append(
            hit("go", f"require {short}", 1, (F.substring_index(path, "/", -1) == "go.mod") & F.contains(text, F.lit(module)), path)
        )
    routed = file_route(path)["kind"]
    seen += [hit("nextjs", "app routes", 3, routed == "app"), hit("nextjs", "pages/api routes", 3, routed == "pages_api")]

    def hits(df: DataFrame, rules: list[Column]) -> DataFrame:
        found = F.filter(F.array(*rules), lambda h: h.isNotNull())
        return df.select(P, "path", F.explode(found).alias("h")).select(P, "path", "h.*")

    once = hits(manifests, declared).unionByName(hits(files, seen)).groupBy(P, "framework", "rule", "scope").agg(
        F.max("points").alias("points"), F.min("path").alias("first"), F.count_distinct("path").alias("n")
    )
    where = F.when(F.col("rule").endswith("routes"), F.concat(F.col("n").cast("string"), F.lit(" "), F.col("rule"))).otherwise(
        F.concat_ws(" in ", "rule", "first")
    )
    return once.groupBy(P, "framework").agg(
        F.sum("points").alias("score"), F.array_sort(F.collect_list(where)).alias("evidence")
    )


def framework_order(detected: DataFrame) -> DataFrame:
    """Frameworks by falling score; ties in the fixed order."""
    rank = F.array_position(F.array(*[F.lit(f) for f in FRAMEWORKS]), F.col("framework"))
    return detected.orderBy(P, F.desc("score"), rank)


def _port(c: Column) -> Column:
    """A text that is a port number, else NULL."""
    n = F.when(c.rlike(r"^\+?\d{1,9}$"), c.try_cast("int"))
    return F.when(n.between(0, 65535), n)


def _digits(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^[^0-9]+", ""), r"[^0-9]+$", "")


def _run_ports(line: Column) -> Column:
    """Ports a run command names, in order."""
    tokens = F.transform(
        F.filter(F.split(line, r"\s+"), lambda t: t != ""), lambda t: F.regexp_replace(t, "^[\"']+|[\"']+$", "")
    )

    def of(t: Column, i: Column) -> Column:
        after = F.get(tokens, i + 1)
        before = F.when(i > 0, F.get(tokens, i - 1))
        env = F.when(t.startswith("PORT="), _port(_digits(F.regexp_replace(t, "^PORT=", ""))))
        flag = F.when(t.startswith("--port="), F.regexp_replace(t, "^--port=", "")).when(t.isin("--port", "-p"), after)
        server = F.when(before == "runserver", _port(F.substring_index(t, ":", -1)))
        bind = F.when(t.startswith("--bind="), F.regexp_replace(t, "^--bind=", "")).when(t.isin("--bind", "-b"), after)
        bound = F.when(F.contains(bind, F.lit(":")), _port(F.regexp_replace(F.substring_index(bind, ":", -1), '^"+|"+$', "")))
        return F.array(env, _port(_digits(flag)), server, bound)

    found = F.flatten(F.transform(tokens, of))
    is_run = _has_any(F.lower(line), RUN_WORDS)
    return F.when(is_run, F.filter(found, lambda p: p.isNotNull())).otherwise(F.array().cast("array<int>"))


def _published(line: Column) -> Column:
    t = strip(line)
    value = F.regexp_replace(strip(F.regexp_replace(t, r"^-+", "")), "^[\"']+|[\"']+$", "")
    return F.filter(F.array(F.when(t.startswith("-"), _port(F.substring_index(value, ":", 1)))), lambda p: p.isNotNull())


def _env(line: Column) -> Column:
    t = strip(line)
    key = F.upper(strip(F.substring_index(t, "=", 1)))
    value = F.regexp_replace(strip(F.regexp_replace(t, r"^[^=]*=", "")), "^[\"']+|[\"']+$", "")
    counts = ~t.startswith("#") & F.contains(t, F.lit("=")) & ((key == "PORT") | key.endswith("_PORT"))
    return F.filter(F.array(F.when(counts, _port(value))), lambda p: p.isNotNull())


def _exposed(line: Column) -> Column:
    t = strip(line)
    tokens = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    rest = F.slice(tokens, F.lit(2), F.size(tokens))
    ports = F.filter(F.transform(rest, lambda x: _port(F.substring_index(x, "/", 1))), lambda p: p.isNotNull())
    return F.when(F.upper(t).startswith("EXPOSE"), ports).otherwise(F.array().cast("array<int>"))


def mine_ports(manifests: DataFrame, listens: DataFrame, detected: DataFrame) -> DataFrame:
    """Base URL candidates: project_id, url, source, confidence, ``place`` (rank order).

    Evidence from run commands (9), listen calls in code (8), published ports (7), environment
    files (6), EXPOSE (4) and framework defaults (1); the first evidence of a URL counts.
    ``listens`` has project_id, seq, port, seen_at.
    """

    def stage(names: list[str], ports_of, confidence: int, label: str) -> DataFrame:
        rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")).cast("bigint")
        found = F.flatten(F.transform(_lines(F.col("content")), ports_of))
        return manifests.filter(F.col("name").isin(names)).select(
            P, F.posexplode(found).alias("n", "port"), rank.alias("rank"), "name"
        ).select(
            P, "port", F.concat(F.lit(label), F.col("name")).alias("source"), F.lit(confidence).alias("confidence"),
            F.struct(F.lit(-confidence).alias("stage"), F.col("rank"), F.col("n").cast("bigint").alias("n")).alias("place"),
        )

    order = F.array_position(F.array(*[F.lit(f) for f in FRAMEWORKS]), F.col("framework")).cast("bigint")
    port, why = F.lit(8000), F.lit("a common default")
    for f, (p, w) in DEFAULT_PORTS.items():
        port = F.when(F.col("framework") == f, p).otherwise(port)
        why = F.when(F.col("framework") == f, w).otherwise(why)
    projects = manifests.select(P).unionByName(detected.select(P)).distinct()
    guessed = projects.join(detected.select(P, "framework", "score"), P, "left").select(
        P, port.alias("port"), why.alias("source"), F.lit(1).alias("confidence"),
        F.struct(F.lit(-1).alias("stage"), F.coalesce(-F.col("score"), F.lit(0)).cast("bigint").alias("rank"), F.coalesce(order, F.lit(0)).cast("bigint").alias("n")).alias("place"),
    )
    heard = listens.select(
        P, "port", F.col("seen_at").alias("source"), F.lit(8).alias("confidence"),
        F.struct(F.lit(-8).alias("stage"), F.lit(0).cast("bigint").alias("rank"), F.col("seq").cast("bigint").alias("n")).alias("place"),
    )
    every = (
        stage(RUN_MANIFESTS, _run_ports, 9, "run command in ")
        .unionByName(heard)
        .unionByName(stage(COMPOSE_MANIFESTS, _published, 7, "published port in "))
        .unionByName(stage(ENV_MANIFESTS, _env, 6, "PORT in "))
        .unionByName(stage(["Dockerfile"], _exposed, 4, "EXPOSE in "))
        .unionByName(guessed)
    )
    return every.groupBy(P, F.concat(F.lit("http://localhost:"), F.col("port").cast("string")).alias("url")).agg(
        F.min_by(F.struct("source", "confidence"), "place").alias("f"), F.min("place").alias("place")
    ).select(P, "url", "f.source", "f.confidence", "place")

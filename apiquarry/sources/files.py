"""Source trees of many projects: listing, manifests, the files worth mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apiquarry.functions.http import language_of
from apiquarry.functions.paths import STYLES, parse_path
from apiquarry.operators.groups import first_per_key

P = "project_id"

# Skipped directories and manifest names.
SKIP_DIRECTORIES = [
    "node_modules", "__pycache__", ".venv", "venv", ".git", ".hg", ".svn", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", ".tox", "target", "vendor", "dist", "build", ".next", ".nuxt", ".svelte-kit", "coverage",
]
MANIFESTS = [
    "pyproject.toml", "requirements.txt", "requirements-dev.txt", "setup.py", "setup.cfg", "Pipfile", "poetry.lock",
    "package.json", "go.mod", "next.config.js", "next.config.mjs", "next.config.ts", "manage.py", "Dockerfile",
    "docker-compose.yml", "docker-compose.yaml", "compose.yml", "Procfile", "Makefile", ".env", ".env.example", ".env.local",
]

_PY_TESTS = r"/tests/|^tests/|/migrations/|(^|/)test_[^/]*$|_test\.py$"
_JS_TESTS = (
    r"/tests/|/test/|/__tests__/|^tests/|^test/|\.test\.[^/]*$|\.spec\.[^/]*$|\.d\.ts$|\.config\.(js|ts|mjs)$"
)
_GO_TESTS = r"_test\.go$|\.pb\.go$|\.gen\.go$|/testdata/|^testdata/"
# Fixed values: (framework, language, paths left out, content words of which one must occur).
CANDIDATE_RULES = [
    ("fastapi", "python", _PY_TESTS, None),
    ("flask", "python", _PY_TESTS, None),
    ("django", "python", _PY_TESTS, "urlpatterns|ROOT_URLCONF|View|api_view|request|Router"),
    ("express", "javascript", _JS_TESTS, None),
    ("express", "typescript", _JS_TESTS, None),
    ("go", "go", _GO_TESTS, None),
]


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root/<project>/…`` as (project_id, path, content). Paths are pruned before
    any content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rest = F.regexp_replace(F.col("path"), r"^.*?" + _quoted(root.rstrip("/")) + "/", "")
    split = raw.select(
        F.substring_index(rest, "/", 1).alias(P), F.regexp_replace(rest, r"^[^/]*/", "").alias("path"), "content"
    )
    return split.filter(~_skipped(F.col("path"))).withColumn("content", F.decode("content", "UTF-8"))


def _quoted(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != "/" else ch for ch in text)


def _skipped(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/", -1), F.array(*[F.lit(d) for d in SKIP_DIRECTORIES]))


def list_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files kept, per-project counts of files kept and skipped): every file outside the noise.

    The counts read paths only, and the files are filtered where they lie.
    """
    noise = _skipped(F.col("path"))
    report = files.groupBy(P).agg(F.count_if(~noise).alias("files"), F.count_if(noise).alias("skipped"))
    return files.filter(~noise), report


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path")))


def languages(files: DataFrame) -> DataFrame:
    """Sorted distinct languages per project."""
    return (
        with_language(files).filter("language is not null").groupBy(P).agg(F.array_sort(F.collect_set("language")).alias("languages"))
    )


def pick_manifests(files: DataFrame) -> DataFrame:
    """One file per manifest name and project: the shallowest, then the first by path."""
    name = F.substring_index("path", "/", -1)
    named = files.withColumn("name", name).filter(F.col("name").isin(MANIFESTS))
    return first_per_key(named, [P, "name"], [F.size(F.split("path", "/")), F.col("path")])


def candidate_files(files: DataFrame) -> DataFrame:
    """Files worth mining per framework: (project_id, framework, path)."""
    spark = files.sparkSession
    # A handful of fixed rows, so the broadcast is of known size.
    rules = F.broadcast(spark.createDataFrame(CANDIDATE_RULES, "framework string, language string, leave_out string, words string"))
    by_rule = (
        with_language(files)
        .join(rules, "language")
        .filter(~F.expr("path rlike leave_out"))
        .filter(F.expr("words is null or content rlike words"))
        .select(P, "framework", "path")
    )
    routed = files.filter(file_route(F.col("path")).isNotNull()).select(P, F.lit("nextjs").alias("framework"), "path")
    return by_rule.unionByName(routed)


def _unmarked(segment: Column) -> Column:
    """A path part without its leading intercept markers such as ``(.)``."""
    return F.regexp_replace(segment, r"^(\([^)]*\))+", "")


def file_route(path: Column) -> Column:
    """``struct<kind, root, group, path>`` of a file-system route, or NULL.

    ``app/**/route.*`` and ``pages/api/**``; groups, slots and intercept markers drop out and a
    private folder opts out.
    """
    assert "bracket" in STYLES
    parts = F.split(path, "/", -1)
    file = F.element_at(parts, -1)
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    ext = F.regexp_extract(file, r"\.([^.]+)$", 1)
    stem = F.regexp_replace(file, r"\.[^.]+$", "")
    scripted = F.contains(file, F.lit(".")) & ext.isin("js", "jsx", "ts", "tsx", "mjs")

    app_at = F.array_position(dirs, "app").cast("int")
    app_parts = F.slice(dirs, app_at + 1, F.size(dirs) - app_at)
    app_private = F.exists(app_parts, lambda s: s.startswith("_"))
    shown = F.transform(
        F.filter(app_parts, lambda s: ~s.startswith("@") & ~s.rlike(r"^\([\s\S]*\)$")), _unmarked
    )
    is_app = scripted & (stem == "route")

    pairs = F.transform(dirs, lambda d, i: (d == "pages") & F.coalesce(F.get(dirs, i + 1) == "api", F.lit(False)))
    api_at = F.array_position(pairs, True).cast("int")
    api_parts = F.slice(dirs, api_at + 1, F.size(dirs) - api_at)
    api_private = F.exists(api_parts, lambda s: s.startswith("_")) | stem.startswith("_")
    api_shown = F.when(stem == "index", api_parts).otherwise(F.concat(api_parts, F.array(stem)))
    is_api = scripted & (stem != "route") & ~stem.endswith(".d")

    def located(kind: str, at: Column, shown_parts: Column) -> Column:
        above = F.slice(dirs, F.lit(1), at - 1)
        trimmed = F.when(F.element_at(above, -1) == "src", F.slice(above, F.lit(1), F.size(above) - 1)).otherwise(above)
        root = F.when(F.size(above) == 0, ".").otherwise(
            F.when(F.size(trimmed) == 0, ".").otherwise(F.array_join(trimmed, "/"))
        )
        template = parse_path(F.array_join(shown_parts, "/"), "bracket")
        literals = F.transform(F.filter(template["segments"], lambda s: s["kind"] == "literal"), lambda s: s["value"])
        api = F.array_position(literals, "api").cast("int")
        after = F.when(api > 0, F.slice(literals, api + 1, F.size(literals))).otherwise(literals)
        return F.struct(
            F.lit(kind).alias("kind"), root.alias("root"), F.get(after, F.lit(0)).alias("group"), template.alias("path")
        )

    return F.when(
        is_app & (app_at > 0) & ~app_private, located("app", app_at, shown)
    ).when(is_api & (api_at > 0) & ~api_private, located("pages_api", api_at, api_shown))


def file_routes(files: DataFrame, exports: DataFrame, unspecified: list[str]) -> DataFrame:
    """Routes of file-system routed projects. ``exports`` (project_id, path, methods) are the
    methods a file states; a pages/api file without any is listed with all usual ones."""
    # paths are short, so they come in few files, but working a route out is long: dealt over all tasks
    dealt = files.select(P, "path").repartition(P, "path")
    at = dealt.select(P, "path", file_route(F.col("path")).alias("r")).filter("r is not null")
    stated = at.join(exports, [P, "path"], "left")
    usual = F.array(*[F.lit(m) for m in unspecified])
    none = F.array().cast("array<string>")
    methods = F.when(F.size(F.coalesce("methods", none)) > 0, F.col("methods")).when(F.col("r.kind") == "pages_api", usual).otherwise(none)
    return stated.select(
        P, F.col("path").alias("file"), "r.kind", "r.root", "r.group", F.col("r.path").alias("path"), F.explode(methods).alias("method")
    )

"""Ignore files of source trees: their rules as a table, met by paths in joins.

A rule says nothing about paths outside the folder of its file. Of the rules that match a path the one
in the deepest folder wins, and there the last; what lies below an ignored folder is ignored, whatever
its own rules say. A file without a project or path is kept; a rule file without content has no rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = "project_id"

_TOKEN = r"^(?:\*\*/)+|(?:/\*\*)+/|/\*\*$|\*+|\?|\[[!^]?\]?(?:\\.|[^\]\\])*\]|\\[\s\S]|[\s\S]"


def _literal(text: Column) -> Column:
    return F.regexp_replace(text, r"([^\w\s])", r"\\$1")


def _class(token: Column) -> Column:
    """A bracket expression; one with a range that runs backwards matches nothing."""
    inside = F.regexp_extract(token, r"^\[[!^]?([\s\S]*)\]$", 1)
    plain = F.regexp_replace(inside, r"\\([^-])", "$1")
    backwards = F.exists(
        F.regexp_extract_all(plain, F.lit(r"[\s\S]-[\s\S]"), F.lit(0)), lambda r: F.substring(r, 1, 1) > F.substring(r, 3, 1)
    )
    shown = F.regexp_replace(plain, r"([^\w\s\\-])", r"\\$1")
    negation = F.when(token.rlike(r"^\[[!^]"), "^").otherwise("")
    return F.when(backwards, "(?!)").otherwise(F.concat(F.lit("(?!/)["), negation, shown, F.lit("]")))


def _piece(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^(\*\*/)+$"), "(?:.*/)?")
        .when(token.rlike(r"^(/\*\*)+/$"), "/(?:.*/)?")
        .when(token == "/**", "/.+")
        .when(token.startswith("*"), "[^/]*")
        .when(token == "?", "[^/]")
        .when(token.rlike(r"^\[[\s\S]+\]$"), _class(token))
        .otherwise(_literal(F.regexp_replace(token, r"^\\([\s\S])$", "$1")))
    )


def ignore_rules(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """``project_id, folder, seq, pattern, negated, only_folders, regex``: one row per rule of the files called
    ``name``; ``folder`` is empty or ends in a slash, and ``regex`` is for paths below it."""
    own = files.filter(F.substring_index("path", "/", -1) == name)
    lines = own.select(P, F.regexp_replace("path", r"[^/]*$", "").alias("folder"), F.posexplode(F.split("content", r"\r?\n")).alias("seq", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"(?<!\\) +$", "")).filter(~F.col("line").startswith("#"))
    body = F.regexp_replace("line", "^!", "")
    rules = lines.select(
        P, "folder", "seq", F.col("line").alias("pattern"), F.col("line").startswith("!").alias("negated"),
        body.endswith("/").alias("only_folders"), F.regexp_replace(body, "/+$", "").alias("core"),
    ).filter("core <> ''")
    # a slash inside a pattern ties it to the folder; without one it names something at any depth
    above = F.when(F.contains("core", F.lit("/")), "").otherwise("(?:.*/)?")
    tokens = F.regexp_extract_all(F.regexp_replace("core", "^/", ""), F.lit(_TOKEN), F.lit(0))
    regex = F.concat(F.lit(r"(?s)\A"), above, F.array_join(F.transform(tokens, _piece), ""), F.lit(r"\z"))
    return rules.withColumn("regex", regex).drop("core")


def _steps(path: Column) -> Column:
    """The folders on the way to a path, and the path itself: ``array<struct<prefix, is_folder>>``."""
    parts = F.split(path, "/", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix"), (i < F.size(parts)).alias("is_folder")),
    )


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``project_id, prefix, is_folder``: the files and folders that a rule of their own ignores."""
    steps = files.select(P, F.explode(_steps(F.col("path"))).alias("s")).select(P, "s.*").distinct()
    parts = F.split("prefix", "/", -1)
    folders = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    )
    listed = rules.groupBy(P, "folder").agg(F.array_sort(F.collect_list(F.struct("seq", "negated", "only_folders", "regex"))).alias("rules"))
    met = steps.withColumn("folder", F.explode(folders)).join(listed, [P, "folder"])
    rest = F.substring(F.col("prefix"), F.length("folder") + 1, F.length("prefix"))
    hits = F.filter("rules", lambda r: (~r["only_folders"] | F.col("is_folder")) & F.rlike(rest, r["regex"]))
    said = met.withColumn("hit", F.get(F.reverse(hits), F.lit(0))).filter("hit is not null")
    verdict = said.groupBy(P, "prefix", "is_folder").agg(F.max_by("hit.negated", F.length("folder")).alias("kept"))
    return verdict.filter("not kept").drop("kept")


def without_ignored(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The files that no ignore rule leaves out; the rules are those of the tree unless given."""
    out = ignored(files, ignore_rules(files) if rules is None else rules)
    below = files.select(P, "path", F.explode(_steps(F.col("path"))).alias("s")).select(P, "path", "s.*")
    gone = below.join(out, [P, "prefix", "is_folder"], "left_semi").select(P, "path").distinct()
    return files.join(gone, [P, "path"], "left_anti").select(*files.columns)

"""Path templates as column expressions: parse, join, render, normalise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from apiquarry.functions.text import strip
from apiquarry.schemas import PARAM, SEGMENT

STYLES = ("braces", "colon", "angle", "bracket")


def type_hint(raw: Column) -> Column:
    """Converter name to type tag; an unknown name is kept, lower-cased."""
    t = F.lower(strip(raw))
    # The tag each converter name stands for.
    return (
        F.when(t.isin("str", "string"), "string")
        .when(t.isin("int", "integer"), "integer")
        .when(t.isin("float", "number", "decimal"), "number")
        .when(t.isin("bool", "boolean"), "boolean")
        .when(t.isin("path", "slug"), "path")
        .when(t == "datetime", "date_time")
        .otherwise(t)
    )


def _segment(kind, value=None, name=None, ty=None, catch_all=None, optional=None, expr=None) -> Column:
    def of(v, to):
        return (v if isinstance(v, Column) else F.lit(v)).cast(to)

    is_param = kind == "param"
    return F.struct(
        F.lit(kind).alias("kind"),
        of(value, "string").alias("value"),
        of(name, "string").alias("name"),
        of(ty, "string").alias("ty"),
        of(catch_all if catch_all is not None else (False if is_param else None), "boolean").alias("catch_all"),
        of(optional if optional is not None else (False if is_param else None), "boolean").alias("optional"),
        of(expr, "string").alias("expr"),
    )


def literal(value: Column | str) -> Column:
    return _segment("literal", value=value)


def param(name: Column | str) -> Column:
    return _segment("param", name=name)


def unresolved(expr: Column | str) -> Column:
    return _segment("unresolved", expr=expr)


def path_of(*segments: Column, trailing_slash: bool = False) -> Column:
    segs = F.array(*segments) if segments else F.array().cast(f"array<{SEGMENT}>")
    return F.struct(segs.alias("segments"), F.lit(trailing_slash).alias("trailing_slash"))


def empty_path() -> Column:
    return path_of()


def _inner(s: Column, width: int = 1) -> Column:
    return F.substring(s, F.lit(width + 1), F.length(s) - 2 * width)


def _braces(s: Column) -> Column:
    inner = _inner(s)
    typed = F.contains(inner, F.lit(":"))
    ty = F.when(typed, type_hint(F.regexp_replace(inner, r"^[^:]*:", "")))
    name = strip(F.when(typed, F.substring_index(inner, ":", 1)).otherwise(inner))
    seg = _segment("param", name=name, ty=ty, catch_all=F.coalesce(ty == "path", F.lit(False)))
    return F.when(s.rlike(r"^\{[\s\S]*\}$"), seg).otherwise(literal(s))


def _colon(s: Column) -> Column:
    named = _segment(
        "param", name=F.regexp_replace(F.substring(s, F.lit(2), F.length(s)), r"\?+$", ""), optional=s.endswith("?")
    )
    star = _segment("param", name="wildcard", ty="path", catch_all=True)
    return F.when(s.startswith(":"), named).when(s == "*", star).otherwise(literal(s))


def _angle(s: Column) -> Column:
    inner = _inner(s)
    typed = F.contains(inner, F.lit(":"))
    ty = F.when(typed, type_hint(F.substring_index(inner, ":", 1)))
    name = strip(F.when(typed, F.regexp_replace(inner, r"^[^:]*:", "")).otherwise(inner))
    seg = _segment("param", name=name, ty=ty, catch_all=F.coalesce(ty == "path", F.lit(False)))
    return F.when(s.rlike(r"^<[\s\S]*>$"), seg).otherwise(literal(s))


def _bracket(s: Column) -> Column:
    def bare(c: Column) -> Column:
        return F.regexp_replace(c, r"^(\.\.\.)+", "")

    double = _segment("param", name=bare(_inner(s, 2)), ty="path", catch_all=True, optional=True)
    rest = _inner(s)
    dots = rest.startswith("...")
    single = _segment("param", name=bare(rest), ty=F.when(dots, F.lit("path")), catch_all=dots)
    return (
        F.when(s.rlike(r"^\[\[[\s\S]*\]\]$"), double)
        .when(s.rlike(r"^\[[\s\S]*\]$"), single)
        .otherwise(literal(s))
    )


_PARSERS: dict[str, Callable[[Column], Column]] = {
    "braces": _braces,
    "colon": _colon,
    "angle": _angle,
    "bracket": _bracket,
}


def parse_path(raw: Column, style: str) -> Column:
    """Split on ``/``, drop empties; a segment is a parameter only as a whole."""
    text = strip(raw)
    parts = F.filter(F.split(text, "/", -1), lambda s: s != "")
    return F.struct(
        F.transform(parts, _PARSERS[style]).alias("segments"),
        ((F.length(text) > 1) & text.endswith("/")).alias("trailing_slash"),
    )


def join_path(parent: Column, child: Column) -> Column:
    """Concatenate; the child decides the trailing slash unless it adds no segment."""
    return F.struct(
        F.concat(parent["segments"], child["segments"]).alias("segments"),
        F.when(F.size(child["segments"]) == 0, parent["trailing_slash"] | child["trailing_slash"])
        .otherwise(child["trailing_slash"])
        .alias("trailing_slash"),
    )


def _render_param(seg: Column, style: str) -> Column:
    n = seg["name"]
    if style == "braces":
        return F.concat(F.lit("{"), n, F.lit("}"))
    if style == "colon":
        return (
            F.when(seg["catch_all"], "*")
            .when(seg["optional"], F.concat(F.lit(":"), n, F.lit("?")))
            .otherwise(F.concat(F.lit(":"), n))
        )
    if style == "angle":
        return F.when(seg["catch_all"], F.concat(F.lit("<path:"), n, F.lit(">"))).otherwise(
            F.concat(F.lit("<"), n, F.lit(">"))
        )
    return (
        F.when(seg["catch_all"] & seg["optional"], F.concat(F.lit("[[..."), n, F.lit("]]")))
        .when(seg["catch_all"], F.concat(F.lit("[..."), n, F.lit("]")))
        .otherwise(F.concat(F.lit("["), n, F.lit("]")))
    )


def render_path(path: Column, style: str = "braces") -> Column:
    """Template to text; an unresolved segment shows as ``?`` and an empty path as ``/``."""
    parts = F.transform(
        path["segments"],
        lambda s: F.concat(
            F.lit("/"),
            F.when(s["kind"] == "literal", s["value"])
            .when(s["kind"] == "unresolved", F.lit("?"))
            .otherwise(_render_param(s, style)),
        ),
    )
    tail = F.when(path["trailing_slash"], "/").otherwise("")
    return F.when(F.size(path["segments"]) == 0, "/").otherwise(F.concat(F.array_join(parts, ""), tail))


def normalize_path(path: Column) -> Column:
    """Identity form: parameter names and the trailing slash do not count."""
    parts = F.transform(
        path["segments"],
        lambda s: F.concat(
            F.lit("/"),
            F.when(s["kind"] == "literal", s["value"])
            .when(s["kind"] == "unresolved", F.concat(F.lit("{?"), s["expr"], F.lit("}")))
            .when(s["catch_all"], "{*}")
            .otherwise("{}"),
        ),
    )
    return F.when(F.size(path["segments"]) == 0, "/").otherwise(F.array_join(parts, ""))


def is_resolved(path: Column) -> Column:
    return ~F.exists(path["segments"], lambda s: s["kind"] == "unresolved")


def unresolved_exprs(path: Column) -> Column:
    return F.transform(F.filter(path["segments"], lambda s: s["kind"] == "unresolved"), lambda s: s["expr"])


def param_names(path: Column) -> Column:
    return F.transform(F.filter(path["segments"], lambda s: s["kind"] == "param"), lambda s: s["name"])


def endpoint_id(method: Column, path: Column) -> Column:
    return F.concat_ws(" ", method, normalize_path(path))


def display(method: Column, path: Column) -> Column:
    return F.concat_ws(" ", method, render_path(path))


def has_gaps(path: Column, orphaned: Column) -> Column:
    return ~is_resolved(path) | orphaned


def confidence(path: Column, origin_source: Column, orphaned: Column) -> Column:
    """Low with a gap, high when stated by the application or a document, else medium;
    an orphan loses its medium."""
    return (
        F.when(~is_resolved(path), "low")
        .when(origin_source.isin("runtime", "openapi"), "high")
        .when(orphaned, "low")
        .otherwise("medium")
    )


def plain_param(name: Column, required: bool = False) -> Column:
    return F.struct(
        name.alias("name"),
        F.lit(None).cast("string").alias("ty"),
        F.lit(required).alias("required"),
        F.lit(None).cast("string").alias("default_json"),
        F.lit(None).cast("string").alias("description"),
        F.array().cast("array<string>").alias("enum_json"),
    ).cast(PARAM)


def seed_path_params(path: Column) -> Column:
    """The parameters a template implies, all required."""
    return F.transform(param_names(path), lambda n: plain_param(n, required=True))

"""Values out of JSON bodies by a path that is itself data, and the comparison of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from apiquarry.functions.http import header_value
from apiquarry.functions.text import let, strip

_STEP = r'\[\s*("[^\]]*"|\+?\d+)\s*\]|([^.\[]+)'
_WHOLE = r'^\$?(?:\.(?=[^.\[])|\[\s*(?:"[^\]]*"|\+?\d+)\s*\]|[^.\[]+)*$'


def _json_text(json: Column, path: Column) -> Column:
    """``get_json_object`` with a path per row."""
    return F.call_function("get_json_object", json, path)


def path_is_valid(path: Column) -> Column:
    return strip(path).rlike(_WHOLE)


def _steps(path: Column) -> Column:
    """Steps of a valid path: ``"key"`` quoted, an index bare."""
    rest = F.regexp_replace(strip(path), r"^\$", "")
    raw = F.regexp_extract_all(rest, F.lit(_STEP), F.lit(0))

    def step(t: Column) -> Column:
        inside = strip(F.substring(t, F.lit(2), F.length(t) - 2))
        return F.when(t.startswith("["), F.regexp_replace(inside, r"^\+", "")).otherwise(
            F.concat(F.lit('"'), t, F.lit('"'))
        )

    return F.transform(raw, step)


def _variant_path(steps: Column) -> Column:
    return F.concat(
        F.lit("$"), F.array_join(F.transform(steps, lambda s: F.concat(F.lit("["), s, F.lit("]"))), "")
    )


def _text_path(steps: Column) -> Column:
    def piece(s: Column) -> Column:
        key = F.substring(s, F.lit(2), F.length(s) - 2)
        return F.when(s.startswith('"'), F.concat(F.lit("['"), key, F.lit("']"))).otherwise(
            F.concat(F.lit("["), s, F.lit("]"))
        )

    return F.concat(F.lit("$"), F.array_join(F.transform(steps, piece), ""))


def _is_container(variant: Column) -> Column:
    return F.schema_of_variant(variant).rlike("^(OBJECT|ARRAY)")


def json_path(body: Column, path: Column) -> Column:
    """``struct<value, error>`` for a path such as ``user.id``, ``items[0].name`` or ``$``.

    Missing is a NULL value without error. A scalar comes as plain text (JSON null as
    ``null``), a container as compact JSON with sorted keys. ``error`` is ``not_json`` or
    ``bad_path``. Inside a container ``1.0`` is written ``1``.
    """
    out = "struct<value:string,error:string>"

    def said(value: Column | None, error: str | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            (value if value is not None else none).cast("string").alias("value"), F.lit(error).cast("string").alias("error")
        ).cast(out)

    def follow(b: Column) -> Column:
        def render(node: Column) -> Column:
            plain = F.coalesce(_json_text(body, _text_path(b["steps"])), node.cast("string"))
            text = F.when(F.is_variant_null(node), "null").when(_is_container(node), F.to_json(node)).otherwise(plain)
            return said(F.when(node.isNotNull(), text))

        # try_variant_get takes a path column, so each row may carry its own.
        node = F.call_function("try_variant_get", b["document"], _variant_path(b["steps"]), F.lit("variant"))
        return (
            F.when(b["document"].isNull(), said(None, "not_json"))
            .when(b["steps"].isNull(), said(None, "bad_path"))
            .otherwise(let(node, render))
        )

    steps = F.when(path_is_valid(path), _steps(path))
    return let(F.struct(F.try_parse_json(body).alias("document"), steps.alias("steps")), follow)


def extract_value(
    source: Column, header: Column, path: Column, status: Column, total_ms: Column, headers: Column, body: Column
) -> Column:
    """``struct<value, error>`` a source names in an exchange: status, duration, header,
    body (by path) or body_text."""

    def plain(c: Column) -> Column:
        return F.struct(c.cast("string").alias("value"), F.lit(None).cast("string").alias("error"))

    return (
        F.when(source == "status", plain(status))
        .when(source == "duration", plain(total_ms))
        .when(source == "header", plain(header_value(headers, header)))
        .when(source == "body_text", plain(F.coalesce(body, F.lit(""))))
        .otherwise(json_path(F.coalesce(body, F.lit("")), path))
    )


def describe_source(source: Column, header: Column, path: Column) -> Column:
    return (
        F.when(source == "body_text", "body")
        .when(source == "header", F.concat(F.lit("header "), header))
        .when(source == "body", F.concat(F.lit("body path `"), path, F.lit("`")))
        .otherwise(source)
    )


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number_of(c: Column) -> Column:
    """A whole text that reads as a number; suffixes such as ``200d`` do not count."""

    def read(t: Column) -> Column:
        word = F.lower(t)
        return (
            F.when(t.rlike(_NUMBER), t.try_cast("double"))
            .when(word.rlike(r"^[+]?inf(inity)?$"), F.lit(float("inf")))
            .when(word.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
            .when(word.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
        )

    return let(strip(c), read)


def holds(op: Column, actual: Column, expected: Column) -> Column:
    """Whether ``actual op expected``; nothing there satisfies only the negative forms."""

    def compare(v: Column) -> Column:
        a, b = v["a"], v["b"]
        numeric = a.isNotNull() & b.isNotNull()
        # -1, 0, 1, or 2 where NaN makes every comparison false, unlike in Spark.
        order = (
            F.when(numeric & (F.isnan(a) | F.isnan(b)), 2)
            .when(numeric, F.when(a < b, -1).when(a > b, 1).otherwise(0))
            .otherwise(F.when(v["x"] < v["y"], -1).when(v["x"] > v["y"], 1).otherwise(0))
        )
        return let(order, lambda o: decide(v, o))

    def decide(v: Column, order: Column) -> Column:
        return (
            F.when(v["x"].isNull(), op.isin("not_exists", "not_equals", "not_contains"))
            .when(op == "exists", True)
            .when(op == "not_exists", False)
            .when(op == "equals", order == 0)
            .when(op == "not_equals", order != 0)
            .when(op == "contains", F.contains(v["x"], v["y"]))
            .when(op == "not_contains", ~F.contains(v["x"], v["y"]))
            .when(op == "greater_than", order == 1)
            .when(op == "less_than", order == -1)
        )

    values = F.struct(
        actual.alias("x"), expected.alias("y"), number_of(actual).alias("a"), number_of(expected).alias("b")
    )
    return let(values, compare)

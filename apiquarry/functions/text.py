"""Text expressions: template references, masks, trimming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mask written in place of a secret, and the reference syntax.
REDACTION = "••••••"
REFERENCE = r"\{\{([\s\S]*?)\}\}"
SENSITIVE_HEADERS = ["authorization", "cookie", "set-cookie", "proxy-authorization"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression, so that its text is not repeated in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def references(c: Column) -> Column:
    """Distinct ``{{name}}`` in order of first appearance; empty names are skipped."""
    found = F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1)), strip)
    return F.array_distinct(F.filter(found, lambda n: n != ""))


def request_references(
    url: Column, path_values: Column, rows: list[Column], others: list[Column]
) -> Column:
    """References of a whole request: url, path values in name order, enabled key/value rows,
    then credentials and body text."""
    values = F.transform(F.array_sort(F.map_entries(path_values)), lambda e: e["value"])
    texts = [F.array(url), values]
    for r in rows:
        enabled = F.filter(r, lambda kv: kv["enabled"])
        texts.append(F.flatten(F.transform(enabled, lambda kv: F.array(kv["key"], kv["value"]))))
    texts.append(F.array(*[F.coalesce(o, F.lit("")) for o in others]) if others else F.array())
    merged = F.concat(*[F.coalesce(t, F.array().cast("array<string>")) for t in texts])
    return F.array_distinct(F.flatten(F.transform(merged, references)))


def mask_all(c: Column, secrets: Column) -> Column:
    """Replace each non-empty secret value, in secret-name order, by the mask.

    ``secrets`` is ``array<struct<name,value>>``; the order matters where one secret holds
    another, so the array is sorted here.
    """
    ordered = F.array_sort(F.filter(secrets, lambda s: s["value"] != ""))
    return F.coalesce(F.aggregate(ordered, c, lambda a, s: F.replace(a, s["value"], F.lit(REDACTION))), c)


def mask_used(c: Column, secrets: Column, used: Column) -> Column:
    """:func:`mask_all` for the secrets a template consumed."""
    return mask_all(c, F.filter(secrets, lambda s: F.array_contains(used, s["name"])))


def json_escaped(c: Column) -> Column:
    """The form a text takes inside a JSON string."""
    quoted = F.to_json(F.struct(c.alias("v")))
    return F.substring(quoted, F.lit(7), F.length(quoted) - 8)


def mask_all_json(c: Column, secrets: Column) -> Column:
    """:func:`mask_all` on JSON text: keys and string values, in their decoded form.

    Only string literals are rewritten, so a secret ``1`` never damages a number.
    """
    ordered = F.array_sort(F.filter(secrets, lambda s: s["value"] != ""))
    # Even slots lie outside string literals, odd slots are the literals themselves.
    # Possessive and unrolled: nothing is pushed on a stack per character, however long a literal is.
    inside = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
    outside = F.split(c, f'"{inside}"')
    literals = F.regexp_extract_all(c, F.lit(f'"({inside})"'), F.lit(1))

    def fold(text: Column) -> Column:
        return F.aggregate(ordered, text, lambda a, s: F.replace(a, s["value"], F.lit(REDACTION)))

    def decoded(t: Column) -> Column:
        whole = F.concat(F.lit('{"v":"'), t, F.lit('"}'))
        return F.coalesce(F.get_json_object(whole, "$.v"), t)

    # A literal without a backslash is its own decoded form; the others are decoded first, so
    # a secret written with escapes is caught too.
    masked = F.transform(
        literals,
        lambda t: F.when(F.contains(t, F.lit("\\")), json_escaped(fold(decoded(t)))).otherwise(fold(t)),
    )
    quoted = F.transform(masked, lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    # zip_with pads the shorter side with null: there is one more outside part than literals.
    woven = F.zip_with(outside, quoted, lambda o, q: F.concat(o, F.coalesce(q, F.lit(""))))
    return F.when(F.size(F.coalesce(ordered, F.array())) == 0, c).otherwise(F.array_join(woven, ""))


def mask_named(c: Column, secrets: Column) -> Column:
    """Replace a secret value by ``{{secret:NAME}}``, the longest value (in bytes) first."""
    keyed = F.transform(
        F.filter(secrets, lambda s: s["value"] != ""),
        lambda s: F.struct(
            (-F.octet_length(s["value"])).alias("neg_len"), s["name"].alias("name"), s["value"].alias("value")
        ),
    )
    fold = F.aggregate(
        F.array_sort(keyed),
        c,
        lambda a, s: F.replace(a, s["value"], F.concat(F.lit("{{secret:"), s["name"], F.lit("}}"))),
    )
    return F.coalesce(fold, c)


def sanitise_headers(headers: Column) -> Column:
    """Blank the credentials of a header list, keeping order and duplicates."""
    return F.transform(
        headers,
        lambda h: F.struct(
            h["name"].alias("name"),
            F.when(F.lower(h["name"]).isin(SENSITIVE_HEADERS), F.lit("[redacted]"))
            .otherwise(h["value"])
            .alias("value"),
        ),
    )


def cut_bytes(c: Column, limit: int) -> Column:
    """The longest prefix of at most ``limit`` UTF-8 bytes that ends on a character."""
    raw = F.encode(c, "UTF-8")
    # A continuation byte is 10xxxxxx; the cut moves left past at most three of them.
    def ends_inside(n: int) -> Column:
        return F.expr("true") & (
            F.conv(F.hex(F.substring(raw, limit + 1 - n, 1)), 16, 10).cast("int").between(128, 191)
        )

    keep = F.lit(limit)
    for n in range(1, 4):
        inside = ends_inside(0)
        for m in range(1, n):
            inside = inside & ends_inside(m)
        keep = F.when(inside, F.lit(limit - n)).otherwise(keep)
    cut = F.decode(F.substring(raw, F.lit(1), keep), "UTF-8")
    return F.when(F.octet_length(c) <= limit, c).otherwise(cut)

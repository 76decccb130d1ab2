"""Keeping secrets out of whatever is written down or shared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiquarry.functions import text
from apiquarry.functions.pretty import pretty_json
from apiquarry.operators.attach import attach

P = "project_id"
SECRETS = "array<struct<name:string,value:string>>"


def secret_lists(secrets: DataFrame) -> DataFrame:
    """One row per project with its secret store; every value has to meet every text."""
    return secrets.groupBy(P).agg(F.collect_list(F.struct("name", "value")).alias("_secrets"))


def with_secrets(df: DataFrame, secrets: DataFrame) -> DataFrame:
    """The project's secrets beside each row. The log is not dealt by project: the secret store goes to it."""
    joined = attach(df, secret_lists(secrets), [P])
    return joined.withColumn("_secrets", F.coalesce("_secrets", F.array().cast(SECRETS)))


def redact_history(history: DataFrame, secrets: DataFrame) -> DataFrame:
    """Mask every secret in url, error and all JSON strings and keys of request/response."""
    s = F.col("_secrets")
    return (
        with_secrets(history, secrets)
        .withColumn("url", text.mask_all(F.col("url"), s))
        .withColumn("error", text.mask_all(F.col("error"), s))
        .withColumn("request", text.mask_all_json(F.col("request"), s))
        .withColumn("response", text.mask_all_json(F.col("response"), s))
        .drop("_secrets")
    )


def mask_named(df: DataFrame, secrets: DataFrame, columns: list[str]) -> DataFrame:
    """Replace secret values by ``{{secret:NAME}}`` in the given columns, longest first."""
    out = with_secrets(df, secrets)
    for c in columns:
        out = out.withColumn(c, text.mask_named(F.col(c), F.col("_secrets")))
    return out.drop("_secrets")


def redact_used(df: DataFrame, secrets: DataFrame, column: str, used: str) -> DataFrame:
    """Mask only the secrets a row is known to have used."""
    out = with_secrets(df, secrets)
    return out.withColumn(column, text.mask_used(F.col(column), F.col("_secrets"), F.col(used))).drop("_secrets")


def looks_textual(content_type: Column, body: Column) -> Column:
    """By content type; without one, any decodable body counts as text."""
    c = F.lower(content_type)
    named = c.startswith("text/")
    for part in ("json", "xml", "javascript", "x-www-form-urlencoded"):
        named = named | F.contains(c, F.lit(part))
    return F.when(content_type.isNull(), body.isNotNull()).otherwise(named)


def masked_preview(exchanges: DataFrame, secrets: DataFrame, max_bytes: int) -> DataFrame:
    """A response for sharing: masked first, then cut at ``max_bytes`` on a character.

    ``body`` is the decoded text (NULL when the bytes are not text) and ``body_bytes`` its size.
    """
    s = F.col("_secrets")
    out = with_secrets(exchanges, secrets).withColumn("_pretty", pretty_json("body"))
    textual = F.col("_pretty").isNotNull() | F.coalesce(looks_textual(F.col("content_type"), F.col("body")), F.lit(False))
    shown = text.mask_named(F.coalesce("_pretty", "body", F.lit("")), s)
    size = F.concat(
        F.lit("<"), F.col("body_bytes").cast("string"), F.lit(" bytes of "),
        F.coalesce("content_type", F.lit("binary data")), F.lit(">"),
    )
    headers = F.transform(
        "response_headers", lambda h: F.struct(h["name"].alias("name"), text.mask_named(h["value"], s).alias("value"))
    )
    return (
        out.withColumn("_shown", shown)
        .withColumn("url", text.mask_named(F.col("url"), s))
        .withColumn("response_headers", headers)
        .withColumn("preview", F.when(textual, text.cut_bytes(F.col("_shown"), max_bytes)).otherwise(size))
        .withColumn("preview_cut", textual & (F.octet_length("_shown") > max_bytes))
        .drop("_secrets", "_pretty", "_shown")
    )

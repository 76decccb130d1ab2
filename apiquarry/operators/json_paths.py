"""Every path of JSON bodies, level by level.

A level holds the containers found so far, each as its own JSON text. It is parsed once into ordered members, which
become rows; the containers among them are the next level. So the work of a level is that of the texts in it, a
wide body is spread over tasks from its second level on, and there is no limit on depth, paths or elements other than
those a caller asks for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apiquarry.functions.text import json_escaped
from apiquarry.session import cut_lineage

# A key that needs no quotes, and one that a script engine lists first, as a number (below 2^32 - 1).
PLAIN_KEY, INDEX_KEY = r"^[A-Za-z_][A-Za-z0-9_-]*$", r"^(0|[1-9][0-9]{0,9})$"
INDEX_LIMIT = (1 << 32) - 1


def _segment(key: Column, root: Column) -> Column:
    quoted = F.concat(F.lit('["'), json_escaped(key), F.lit('"]'))
    return F.when(key.rlike(PLAIN_KEY), F.when(root, key).otherwise(F.concat(F.lit("."), key))).otherwise(quoted)


def _expanded(level: DataFrame, keys: list[str], sample: int | None) -> DataFrame:
    """Members of the containers ``_place, _path, _json`` of a level, one row each."""
    # every text is parsed twice, for the spelling of its members and for their types
    json, named = F.col("_json"), F.col("_json").startswith("{")
    parsed = level.select(
        *keys, "_place", "_path", F.when(named, F.from_json(json, "map<string,string>")).alias("_texts"), F.when(named, F.from_json(json, "map<string,variant>")).alias("_nodes"),
        F.when(~named, F.from_json(json, "array<string>")).alias("_items"), F.when(~named, F.from_json(json, "array<variant>")).alias("_values"),
    )
    items, values = ("_items", "_values") if sample is None else (F.slice("_items", 1, sample), F.slice("_values", 1, sample))
    of_object = F.arrays_zip(F.map_keys("_texts").alias("key"), F.map_values("_texts").alias("text"), F.map_values("_nodes").alias("node"))
    of_array = F.arrays_zip(F.array().cast("array<string>").alias("key"), F.col(items).alias("text") if isinstance(items, str) else items, F.col(values).alias("node") if isinstance(values, str) else values)
    entry = "array<struct<key:string,text:string,node:variant>>"
    rows = parsed.select(*keys, "_place", "_path", F.posexplode(F.coalesce(of_object.cast(entry), of_array.cast(entry))).alias("_i", "_m"))
    key, kind = F.col("_m.key"), F.coalesce(F.schema_of_variant("_m.node"), F.lit("VOID"))
    number = F.when(key.rlike(INDEX_KEY), key.cast("bigint"))
    # keys that are numbers come before all others, in their order
    at = F.when(number < INDEX_LIMIT, number - INDEX_LIMIT).otherwise(F.col("_i").cast("bigint"))
    step = F.when(key.isNull(), F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("]"))).otherwise(_segment(key, F.col("_path") == ""))
    rows = rows.select(
        *keys, F.concat("_place", F.array(at)).alias("_place"), F.concat("_path", step).alias("_path"),
        F.when(kind.startswith("OBJECT"), F.lit("o")).when(kind.startswith("ARRAY"), F.lit("a")).when(kind == "STRING", F.lit("s")).otherwise(F.lit("v")).alias("_kind"),
        F.coalesce("_m.text", F.lit("null")).alias("_text"),
    )
    # containers are written without blanks
    return rows.withColumn("_text", F.when(F.col("_kind").isin("o", "a"), F.get_json_object("_text", "$")).otherwise(F.col("_text")))


def json_paths(df: DataFrame, body: str, keys: list[str], limit: int | None = None, sample: int | None = None, width: int | None = None) -> DataFrame:
    """``keys``, ``place, path, preview, scalar, text``: a row per path of each body; ``keys`` identify a row.

    ``place`` orders the paths of a body as the document does. With ``limit`` only the first paths of a body are
    returned, with ``sample`` only the first elements of an array are looked at, and with ``width`` longer previews
    are cut. Bodies that are NULL, no JSON, or a scalar have no paths, nor have those that name a key twice. Scalars
    keep their spelling, strings come without quotes.
    """
    trimmed = F.trim(F.regexp_replace(body, r"^[\x09\x0A\x0D]+", ""))
    root = df.filter(F.try_parse_json(body).isNotNull() & trimmed.rlike(r"^[{\[]"))
    # bodies in few files would stay in few tasks on every level
    root = root.repartition(*keys)
    level = root.select(*keys, F.array().cast("array<bigint>").alias("_place"), F.lit("").alias("_path"), F.get_json_object(body, "$").alias("_json"))
    found = []
    while True:
        rows = _expanded(level, keys, sample)
        found.append(rows)
        inner = rows.filter(F.col("_kind").isin("o", "a") & ~F.col("_text").isin("{}", "[]"))
        level = cut_lineage(inner.select(*keys, "_place", "_path", F.col("_text").alias("_json")))
        if level.isEmpty():
            break
    every = reduce(DataFrame.unionByName, found)
    if limit is not None:
        every = every.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("_place"))).filter(F.col("_nth") <= limit)
    text, container = F.col("_text"), F.col("_kind").isin("o", "a")
    size = F.when(F.col("_kind") == "a", F.json_array_length(text)).otherwise(F.size(F.json_object_keys(text)))
    plural = F.when(size == 1, "").otherwise("s")
    shown = F.when(F.col("_kind") == "s", F.concat(F.lit('"'), json_escaped(text), F.lit('"'))).otherwise(text)
    if width is not None:
        shown = F.when(F.length(shown) > width, F.concat(F.left(shown, F.lit(width - 3)), F.lit("…"))).otherwise(shown)
    preview = (
        F.when(F.col("_kind") == "a", F.concat(F.lit("["), size, F.lit(" item"), plural, F.lit("]")))
        .when(F.col("_kind") == "o", F.concat(F.lit("{"), size, F.lit(" key"), plural, F.lit("}")))
        .otherwise(shown)
    )
    return every.select(*keys, F.col("_place").alias("place"), F.col("_path").alias("path"), preview.alias("preview"), (~container).alias("scalar"), text.alias("text"))

"""Class facts of request models, flattened to a JSON schema and an example."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiquarry.functions.text import strip
from apiquarry.operators.groups import first_per_key
from apiquarry.session import cut_lineage

P = "project_id"
MAX_DEPTH = 4  # fixed value: nesting beyond it is shown as an unknown type

# Schema entries and example of the types a model may use, as JSON.
_TYPES = {
    ("str", "SecretStr", "constr", "StrictStr"): ({"type": '"string"'}, '"string"'),
    ("int", "conint", "StrictInt", "PositiveInt", "NonNegativeInt"): ({"type": '"integer"'}, "0"),
    ("float", "Decimal", "confloat", "StrictFloat", "PositiveFloat"): ({"type": '"number"'}, "0.0"),
    ("bool", "StrictBool"): ({"type": '"boolean"'}, "false"),
    ("bytes",): ({"type": '"string"', "format": '"binary"'}, '""'),
    ("EmailStr", "NameEmail"): ({"type": '"string"', "format": '"email"'}, '"user@example.com"'),
    ("HttpUrl", "AnyUrl", "AnyHttpUrl", "Url"): ({"type": '"string"', "format": '"uri"'}, '"https://example.com"'),
    ("UUID", "UUID4"): ({"type": '"string"', "format": '"uuid"'}, '"3fa85f64-5717-4562-b3fc-2c963f66afa6"'),
    ("datetime",): ({"type": '"string"', "format": '"date-time"'}, '"2024-01-01T00:00:00Z"'),
    ("date",): ({"type": '"string"', "format": '"date"'}, '"2024-01-01"'),
    ("time",): ({"type": '"string"', "format": '"time"'}, '"00:00:00"'),
    ("Any", "object", ""): ({}, "null"),
    ("dict", "Dict", "Json"): ({"type": '"object"'}, "{}"),
    ("list", "List"): ({"type": '"array"'}, "[]"),
}
_FIRST = ["Optional", "Annotated", "Required", "NotRequired", "Final"]
_LISTS = ["list", "List", "Sequence", "set", "Set", "frozenset", "tuple", "Tuple", "Iterable"]
_DICTS = ["dict", "Dict", "Mapping"]

_MAP = "map<string,string>"


def json_string(c: Column) -> Column:
    whole = F.to_json(F.struct(c.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def object_text(entries: Column) -> Column:
    """JSON object with sorted keys from a map of raw JSON values."""
    rows = F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(rows, ","), F.lit("}"))


def split_top_level(text: Column) -> Column:
    """Comma-separated parts outside brackets and parentheses, trimmed."""
    state = "struct<depth:int,cur:string,parts:array<string>>"

    def step(acc: Column, ch: Column) -> Column:
        opens, closes = ch.isin("[", "("), ch.isin("]", ")")
        cut = (ch == ",") & (acc["depth"] == 0)
        return F.struct(
            (acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(cut, "").otherwise(F.concat(acc["cur"], ch)).alias("cur"),
            F.when(cut, F.concat(acc["parts"], F.array(strip(acc["cur"])))).otherwise(acc["parts"]).alias("parts"),
        ).cast(state)

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("parts")).cast(state)
    end = F.aggregate(F.split(text, ""), start, step)
    return F.when(strip(end["cur"]) == "", end["parts"]).otherwise(F.concat(end["parts"], F.array(strip(end["cur"]))))


def unwrap(annotation: Column) -> Column:
    """``struct<text, wraps, literal>``: the inner type, the containers around it (outermost
    first) and whether ``text`` is the inside of a ``Literal``."""
    state = "struct<text:string,wraps:array<string>,literal:boolean,done:boolean>"

    def step(acc: Column) -> Column:
        t = strip(acc["text"])
        generic = t.rlike(r"^[^\[]*\[[\s\S]*\]$")
        outer = F.substring_index(strip(F.regexp_extract(t, r"^([^\[]*)\[", 1)), ".", -1)
        inner = F.regexp_extract(t, r"^[^\[]*\[([\s\S]*)\]$", 1)
        parts = split_top_level(inner)
        first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))

        def state_of(text: Column, wraps: Column, literal: bool = False, done: bool = False) -> Column:
            return F.struct(text.alias("text"), wraps.alias("wraps"), F.lit(literal).alias("literal"), F.lit(done).alias("done")).cast(state)

        w = acc["wraps"]
        other = F.coalesce(F.get(F.filter(parts, lambda p: p != "None"), F.lit(0)), F.lit(""))
        return (
            F.when(acc["done"], acc)
            .when(t.endswith("| None"), state_of(F.regexp_replace(t, r"\| None$", ""), w))
            .when(t.startswith("None |"), state_of(F.regexp_replace(t, r"^None \|", ""), w))
            .when(generic & outer.isin(_FIRST), state_of(first, w))
            .when(generic & (outer == "Union"), state_of(other, w))
            .when(generic & outer.isin(_LISTS), state_of(first, F.concat(w, F.array(F.lit("array")))))
            .when(generic & outer.isin(_DICTS), state_of(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.concat(w, F.array(F.lit("object")))))
            .when(generic & (outer == "Literal"), state_of(inner, w, literal=True, done=True))
            .otherwise(state_of(F.substring_index(t, ".", -1), w, done=True))
        )

    start = F.struct(
        annotation.alias("text"), F.array().cast("array<string>").alias("wraps"), F.lit(False).alias("literal"), F.lit(False).alias("done")
    ).cast(state)
    # Each step removes a bracket or a ``|``, so the count of those bounds the steps.
    steps = F.length(F.regexp_replace(annotation, r"[^\[|]", "")) + 1
    return F.aggregate(F.sequence(F.lit(1), steps), start, lambda acc, _i: step(acc))


def _literal_values(inside: Column) -> Column:
    def value(p: Column) -> Column:
        quoted = p.rlike(r"""^("[\s\S]*"|'[\s\S]*')$""") & (F.length(p) >= 2)
        return (
            F.when(quoted, json_string(F.substring(p, F.lit(2), F.length(p) - 2)))
            .when(p == "True", "true")
            .when(p == "False", "false")
            .when(p == "None", "null")
            .when(p.rlike(r"^[+-]?\d+$"), p.cast("bigint").cast("string"))
            .when(p.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), p.cast("double").cast("string"))
        )

    return F.filter(F.transform(split_top_level(inside), value), lambda v: v.isNotNull())


def _builtin(name: Column) -> tuple[Column, Column]:
    schema, example = F.lit(None).cast(_MAP), F.lit(None).cast("string")
    for names, (entries, shown) in _TYPES.items():
        cells = [F.lit(x) for kv in entries.items() for x in kv]
        made = F.create_map(*cells) if cells else F.create_map().cast(_MAP)
        schema = F.when(name.isin(list(names)), made).otherwise(schema)
        example = F.when(name.isin(list(names)), F.lit(shown)).otherwise(example)
    return schema, example


def _put(entries: Column, key: str, value: Column) -> Column:
    kept = F.map_filter(entries, lambda k, _v: k != F.lit(key))
    return F.when(value.isNotNull(), F.map_concat(kept, F.create_map(F.lit(key), value))).otherwise(entries)


def _level(models: DataFrame, fields: DataFrame, below: DataFrame | None) -> DataFrame:
    """Schemas at one nesting depth, given those one deeper (None: nothing nests further)."""
    inner_cols = ["i_props", "i_required", "i_example"]
    if below is None:
        deeper = models.select(P, F.col("name").alias("leaf")).limit(0)
        for c, t in zip(inner_cols, (_MAP, "array<string>", _MAP)):
            deeper = deeper.withColumn(c, F.lit(None).cast(t))
    else:
        deeper = below.select(
            P, F.col("name").alias("leaf"), F.col("props").alias("i_props"), F.col("required").alias("i_required"), F.col("example").alias("i_example")
        )
    joined = fields.join(deeper, [P, "leaf"], "left")
    known = F.col("i_props").isNotNull()
    nested = {
        "properties": object_text(F.col("i_props")),
        "title": json_string(F.col("leaf")),
        "type": F.lit('"object"'),
    }
    cells = [x for k, v in nested.items() for x in (F.lit(k), v)]
    nested_schema = F.create_map(*cells)
    listed = F.concat(F.lit("["), F.array_join(F.transform("i_required", json_string), ","), F.lit("]"))
    nested_schema = F.when(F.size("i_required") > 0, _put(nested_schema, "required", listed)).otherwise(nested_schema)
    unknown = F.create_map(F.lit("title"), json_string(F.col("leaf")), F.lit("type"), F.lit('"string"'))
    leaf_schema = F.coalesce("leaf_schema", F.when(known, nested_schema).otherwise(unknown))
    leaf_example = F.coalesce("leaf_example", F.when(known, object_text(F.col("i_example"))).otherwise(F.lit('"string"')))

    # Containers are put back around the leaf, innermost first.
    state = f"struct<schema:{_MAP},example:string>"

    def around(acc: Column, w: Column) -> Column:
        inside = object_text(acc["schema"])
        as_list = F.struct(
            F.create_map(F.lit("items"), inside, F.lit("type"), F.lit('"array"')).alias("schema"),
            F.concat(F.lit("["), acc["example"], F.lit("]")).alias("example"),
        ).cast(state)
        as_map = F.struct(
            F.create_map(F.lit("additionalProperties"), inside, F.lit("type"), F.lit('"object"')).alias("schema"),
            F.lit("{}").alias("example"),
        ).cast(state)
        return F.when(w == "array", as_list).otherwise(as_map)

    built = F.aggregate(
        F.reverse("wraps"), F.struct(leaf_schema.alias("schema"), leaf_example.alias("example")).cast(state), around
    )
    with_default = _put(built["schema"], "default", F.col("default_json"))
    shown = F.when(F.col("default_json").isNull() | (F.col("default_json") == "null"), built["example"]).otherwise(F.col("default_json"))
    own = joined.filter("field is not null").select(
        P, "name", F.lit(1).alias("kind"), "pos",
        F.array(F.struct(F.col("field").alias("key"), object_text(with_default).alias("value"))).alias("props"),
        F.array(F.struct(F.col("field").alias("key"), shown.alias("value"))).alias("examples"),
        F.when(F.col("required"), F.array("field")).otherwise(F.array().cast("array<string>")).alias("required"),
    )
    based = joined.filter("field is null").filter(known).select(
        P, "name", F.lit(0).alias("kind"), "pos",
        F.map_entries("i_props").alias("props"), F.map_entries("i_example").alias("examples"), F.col("i_required").alias("required"),
    )
    parts = own.unionByName(based).groupBy(P, "name").agg(
        F.array_sort(F.collect_list(F.struct("kind", "pos", "props", "examples", "required"))).alias("parts")
    )

    def last_of(column: str) -> Column:
        rows = F.flatten(F.transform("parts", lambda p: p[column]))
        keys = F.array_distinct(F.transform(rows, lambda r: r["key"]))
        return F.map_from_entries(
            F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(rows, lambda r: r["key"] == k), -1)["value"]))
        )

    empty = F.create_map().cast(_MAP)
    return models.select(P, "name").join(parts, [P, "name"], "left").select(
        P, "name",
        F.coalesce(last_of("props"), empty).alias("props"),
        F.coalesce(last_of("examples"), empty).alias("example"),
        F.coalesce(F.flatten(F.transform("parts", lambda p: p["required"])), F.array().cast("array<string>")).alias("required"),
    )


def expand_models(models: DataFrame) -> DataFrame:
    """Models (first of a name wins) with ``schema_json`` and ``example_json``.

    Depth by depth from the deepest: a model's bases and nested models are looked up among the
    schemas one level further down, so a recursive model ends by itself.
    """
    firsts = cut_lineage(first_per_key(models, [P, "name"], ["seq"]))
    raw = firsts.select(P, "name", F.posexplode("fields").alias("pos", "f"))
    unwrapped = raw.withColumn("u", unwrap(F.col("f.annotation")))
    schema, example = _builtin(F.col("u.text"))
    values = _literal_values(F.col("u.text"))
    literal_schema = F.create_map(F.lit("enum"), F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")))
    fields = unwrapped.select(
        P, "name", "pos", F.col("f.name").alias("field"), F.col("f.required").alias("required"), F.col("f.default_json").alias("default_json"),
        F.col("u.text").alias("leaf"), F.col("u.wraps").alias("wraps"),
        F.when(F.col("u.literal"), literal_schema).otherwise(schema).alias("leaf_schema"),
        F.when(F.col("u.literal"), F.coalesce(F.get(values, F.lit(0)), F.lit('""'))).otherwise(example).alias("leaf_example"),
    )
    bases = firsts.select(P, "name", F.posexplode("bases").alias("pos", "leaf")).select(
        P, "name", "pos", F.lit(None).cast("string").alias("field"), F.lit(False).alias("required"),
        F.lit(None).cast("string").alias("default_json"), "leaf", F.array().cast("array<string>").alias("wraps"),
        F.lit(None).cast(_MAP).alias("leaf_schema"), F.lit(None).cast("string").alias("leaf_example"),
    )
    parts = cut_lineage(fields.unionByName(bases))
    level: DataFrame | None = None
    for _ in range(MAX_DEPTH + 1):
        level = cut_lineage(_level(firsts, parts, level))
    listed = F.concat(F.lit("["), F.array_join(F.transform("required", json_string), ","), F.lit("]"))
    whole = F.create_map(
        F.lit("properties"), object_text(F.col("props")), F.lit("title"), json_string(F.col("name")), F.lit("type"), F.lit('"object"')
    )
    schema_map = F.when(F.size("required") > 0, _put(whole, "required", listed)).otherwise(whole)
    return level.select(P, "name", object_text(schema_map).alias("schema_json"), object_text(F.col("example")).alias("example_json"))


def fill_bodies(endpoints: DataFrame, described: DataFrame) -> DataFrame:
    """Give bodies that only name a model (a title, no properties) its schema and example."""
    title = F.get_json_object("body.schema_json", "$.title")
    open_ = F.col("body").isNotNull() & F.get_json_object("body.schema_json", "$.properties").isNull()
    looked = endpoints.withColumn("_title", F.when(open_, title))
    models = described.select(P, F.col("name").alias("_title"), F.col("schema_json").alias("_s"), F.col("example_json").alias("_e"))
    joined = looked.join(models, [P, "_title"], "left")
    filled = F.struct(
        F.col("body.content_type").alias("content_type"), F.col("_s").alias("schema_json"),
        F.coalesce("body.example_json", "_e").alias("example_json"), F.col("body.required").alias("required"),
    )
    return joined.withColumn("body", F.when(F.col("_s").isNotNull(), filled).otherwise(F.col("body"))).drop("_title", "_s", "_e")

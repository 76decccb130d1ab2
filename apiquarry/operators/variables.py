"""Variables in four scopes and the ``{{name}}`` templates that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiquarry.functions.text import REFERENCE, let, references, strip
from apiquarry.operators.attach import attach

P, ENV = "project_id", "environment"

# Scopes by precedence.
SCOPES = ["request_local", "environment", "globals", "secrets"]

RESOLVED = "struct<value:string,secrets:array<string>,error:string,error_name:string>"


def scope_rank(scope: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SCOPES]), scope)


def spread_environments(variables: DataFrame) -> DataFrame:
    """Copy project-wide rows (no environment) into each environment of their project."""
    named = variables.filter(F.col(ENV).isNotNull())
    wide = variables.filter(F.col(ENV).isNull()).drop(ENV)
    environments = named.select(P, ENV).distinct()
    return named.unionByName(wide.join(environments, P).select(*named.columns))


def lookup_table(variables: DataFrame) -> DataFrame:
    """What each name means per environment: the highest scope wins, and ``secret:NAME``
    reads secrets only. Columns: name, value, secret (its name when the value is one)."""
    plain = (
        variables.groupBy(P, ENV, "name")
        .agg(F.min_by(F.struct("value", "scope"), scope_rank(F.col("scope"))).alias("_w"))
        .select(P, ENV, "name", "_w.value", F.when(F.col("_w.scope") == "secrets", F.col("name")).alias("secret"))
    )
    secret = variables.filter("scope = 'secrets'").select(
        P, ENV, F.concat(F.lit("secret:"), F.col("name")).alias("name"), "value", F.col("name").alias("secret")
    )
    return plain.unionByName(secret)


def scope_maps(variables: DataFrame) -> DataFrame:
    """One row per environment with all its names in a map.

    The map is one environment document — the same document every request of that environment
    resolves against. Texts then join by (project, environment) and never group by name.
    """
    entries = F.map_from_entries(F.collect_list(F.struct("name", F.struct("value", "secret"))))
    return lookup_table(variables).groupBy(P, ENV).agg(entries.alias("scope"))


def canonical_name(name: Column) -> Column:
    """``secret: x`` and ``secret:x`` are one name."""
    return F.regexp_replace(name, r"^secret:\s+", "secret:")


def _names(text: Column) -> Column:
    """Every reference of a text in order, repeats and empties included."""
    raw = F.regexp_extract_all(text, F.lit(r"\{\{\s*([\s\S]*?)\s*\}\}"), F.lit(1))
    return F.transform(raw, canonical_name)


def find(name: Column, scope: Column) -> Column:
    """``struct<value, secret>`` of a name; NULL when undefined."""
    return F.try_element_at(scope, name)


def with_local(scope: Column, local: Column) -> Column:
    """A scope with run-local values in front. ``secret:`` names never mean a local value."""
    named = F.map_filter(local, lambda k, _v: ~k.startswith("secret:"))
    cells = F.transform_values(named, lambda _k, v: F.struct(v.alias("value"), F.lit(None).cast("string").alias("secret")))
    return F.map_concat(F.map_filter(scope, lambda k, _v: ~F.map_contains_key(local, k) | k.startswith("secret:")), cells)


def _weave(text: Column, values: Column) -> Column:
    literals = F.split(text, REFERENCE, -1)
    return F.array_join(F.zip_with(literals, values, lambda l, v: F.concat(l, F.coalesce(v, F.lit("")))), "")


def _done(value: Column | None = None, secrets: Column | None = None, error: Column | None = None, name: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        (null if value is None else value).alias("value"), (F.array().cast("array<string>") if secrets is None else secrets).alias("secrets"),
        (null if error is None else error).alias("error"), (null if name is None else name).alias("error_name"),
    ).cast(RESOLVED)


def _needed(names: Column, scope: Column) -> Column:
    """The names and all that their values refer to, however far: each is looked up once."""

    def more(acc: Column) -> Column:
        told = F.flatten(F.transform(acc["new"], lambda n: F.coalesce(_names(find(n, scope)["value"]), F.array().cast("array<string>"))))
        return let(F.array_except(told, acc["every"]), lambda new: F.struct(F.concat(acc["every"], new).alias("every"), new.alias("new")))

    start = let(F.array_distinct(names), lambda n: F.struct(n.alias("every"), n.alias("new")))
    rounds = F.sequence(F.lit(0), F.size(F.map_keys(scope)))
    return F.aggregate(rounds, start, lambda acc, _i: F.when(F.size(acc["new"]) == 0, acc).otherwise(more(acc)))["every"]


def _first_not_ready(name: Column, scope: Column, ready: Column) -> Column:
    """The first reference of a name's value that is not expanded, or not yet."""
    return F.get(F.filter(_names(find(name, scope)["value"]), lambda r: F.try_element_at(ready, r).isNull() | F.try_element_at(ready, r)["error"].isNotNull()), F.lit(0))


def expand_names(names: Column, scope: Column) -> Column:
    """``map<string,RESOLVED>`` of the names and all that they need.

    Names whose references are all expanded are expanded next, each once, until nothing moves: a chain
    of n names takes n rounds, and no text is copied on the way round a circle. A name fails as its first
    reference that does not expand: because that is undefined or empty, or failed itself. What is left then
    leads to circles, and each name blames the one that comes first a second time on its way.
    """
    ready_type = f"map<string,{RESOLVED}>"
    state = f"struct<ready:{ready_type},left:array<string>,moved:boolean>"

    def attempt(n: Column, ready: Column) -> Column:
        def with_hit(hit: Column) -> Column:
            def with_parts(parts: Column) -> Column:
                bad = F.get(F.filter(parts, lambda x: x["error"].isNotNull()), F.lit(0))
                waits = F.get(F.filter(F.transform(parts, lambda x: F.when(x.isNull(), F.lit("wait")).otherwise(x["error"])), lambda e: e.isNotNull()), F.lit(0)) == "wait"
                used = F.concat(F.flatten(F.transform(parts, lambda x: x["secrets"])), F.when(hit["secret"].isNotNull(), F.array(hit["secret"])).otherwise(F.array().cast("array<string>")))
                fine = _done(_weave(hit["value"], F.transform(parts, lambda x: x["value"])), F.array_sort(F.array_distinct(used)))
                return F.when(F.coalesce(waits, F.lit(False)), F.lit(None).cast(RESOLVED)).when(bad.isNotNull(), _done(error=bad["error"], name=bad["error_name"])).otherwise(fine)

            missing = F.when(n == "", _done(error=F.lit("empty_name"))).otherwise(_done(error=F.lit("undefined"), name=n))
            return F.when(hit.isNull(), missing).otherwise(let(F.transform(_names(hit["value"]), lambda r: F.try_element_at(ready, r)), with_parts))

        return let(find(n, scope), with_hit)

    def step(acc: Column) -> Column:
        tried = F.transform(acc["left"], lambda n: F.struct(n.alias("n"), attempt(n, acc["ready"]).alias("r")))

        def settled(t: Column) -> Column:
            new = F.filter(t, lambda x: x["r"].isNotNull())
            return F.struct(
                F.map_concat(acc["ready"], F.map_from_entries(new)).alias("ready"), F.transform(F.filter(t, lambda x: x["r"].isNull()), lambda x: x["n"]).alias("left"), (F.size(new) > 0).alias("moved")
            ).cast(state)

        return F.when(acc["moved"] & (F.size(acc["left"]) > 0), let(tried, settled)).otherwise(acc)

    def circles(end: Column) -> Column:
        def blamed(n: Column) -> Column:
            walk = "struct<at:string,seen:array<string>,found:string>"

            def on(acc: Column) -> Column:
                return let(
                    _first_not_ready(acc["at"], scope, end["ready"]),
                    lambda to: F.struct(to.alias("at"), F.concat(acc["seen"], F.array(to)).alias("seen"), F.when(F.array_contains(acc["seen"], to), to).alias("found")).cast(walk),
                )

            start = F.struct(n.alias("at"), F.array(n).alias("seen"), F.lit(None).cast("string").alias("found")).cast(walk)
            return F.aggregate(F.sequence(F.lit(0), F.size(end["left"])), start, lambda acc, _i: F.when(acc["found"].isNotNull(), acc).otherwise(on(acc)))["found"]

        failed = F.map_from_entries(F.transform(end["left"], lambda n: F.struct(n, _done(error=F.lit("cycle"), name=blamed(n)))))
        return F.when(F.size(end["left"]) == 0, end["ready"]).otherwise(F.map_concat(end["ready"], failed))

    def run(every: Column) -> Column:
        start = F.struct(F.create_map().cast(ready_type).alias("ready"), every.alias("left"), F.lit(True).alias("moved")).cast(state)
        return let(F.aggregate(F.sequence(F.lit(0), F.size(every)), start, lambda acc, _i: step(acc)), circles)

    return let(_needed(names, scope), run)


#: Stands for the text itself among the names; no reference can be written like this.
_TEXT = "}}"


def expand(text: Column, scope: Column) -> Column:
    """Resolve a template against raw scopes: value and secrets used, or the first error."""
    own = F.create_map(F.lit(_TEXT), F.struct(text.alias("value"), F.lit(None).cast("string").alias("secret")))
    resolved = F.try_element_at(expand_names(F.array(F.lit(_TEXT)), F.map_concat(scope, own)), F.lit(_TEXT))
    return F.when(text.rlike(REFERENCE), resolved).otherwise(F.when(text.isNotNull(), _done(text)))


def resolved_maps(variables: DataFrame) -> DataFrame:
    """Environments with every name already expanded, so a text needs one look-up per name."""
    return scope_maps(variables).select(P, ENV, expand_names(F.map_keys("scope"), F.col("scope")).alias("resolved"))


def substitute(text: Column, resolved: Column) -> Column:
    """One pass over a template with pre-expanded names: ``struct<value, secrets, error,
    error_name>``. Unclosed ``{{`` is literal."""
    scope = F.coalesce(resolved, F.create_map().cast(f"map<string,{RESOLVED}>"))
    names = _names(text)

    def hit(n: Column) -> Column:
        found = F.try_element_at(scope, n)
        missing = F.struct(
            F.lit(None).cast("string").alias("value"),
            F.array().cast("array<string>").alias("secrets"),
            F.when(n == "", "empty_name").otherwise("undefined").alias("error"),
            F.when(n != "", n).alias("error_name"),
        ).cast(RESOLVED)
        return F.coalesce(found, missing)

    def put_in(hits: Column) -> Column:
        failed = F.get(F.filter(hits, lambda h: h["error"].isNotNull()), F.lit(0))
        value = _weave(text, F.transform(hits, lambda h: h["value"]))
        used = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["secrets"]))))
        return F.struct(
            F.when(failed.isNull(), value).alias("value"),
            used.alias("secrets"),
            failed["error"].alias("error"),
            failed["error_name"].alias("error_name"),
        ).cast(RESOLVED)

    return let(F.transform(names, hit), put_in)


def resolve_templates(texts: DataFrame, variables: DataFrame, column: str, out: str = "resolved_text") -> DataFrame:
    """Resolve ``column`` of a table that has project_id and environment."""
    maps = resolved_maps(variables).withColumnRenamed("resolved", "_map")
    return attach(texts, maps, [P, ENV]).withColumn(out, substitute(F.col(column), F.col("_map"))).drop("_map")


def lookup_references(refs: DataFrame, variables: DataFrame) -> DataFrame:
    """References (project_id, environment, name) with the value in force."""
    return refs.withColumn("name", canonical_name(F.col("name"))).join(lookup_table(variables), [P, ENV, "name"])


def undefined_references(requests: DataFrame, variables: DataFrame, refs: str = "refs") -> DataFrame:
    """Requests with the names that do not resolve, all at once and in order."""
    maps = scope_maps(variables)
    scope = F.coalesce("scope", F.create_map().cast("map<string,struct<value:string,secret:string>>"))
    names = F.filter(F.col(refs), lambda n: ~F.map_contains_key(scope, canonical_name(n)))
    return attach(requests, maps, [P, ENV]).withColumn("undefined", names).drop("scope").filter(F.size("undefined") > 0)


def missing_secrets(expected: DataFrame, secrets: DataFrame) -> DataFrame:
    """Secret names an environment expects and the store does not hold."""
    return expected.select(P, ENV, "name").distinct().join(secrets.select(P, "name").distinct(), [P, "name"], "left_anti")


def variable_names(variables: DataFrame) -> DataFrame:
    """Names a reference could use: globals, environment, and ``secret:NAME``."""
    shown = F.when(F.col("scope") == "secrets", F.concat(F.lit("secret:"), F.col("name"))).otherwise(F.col("name"))
    return variables.filter("scope <> 'request_local'").select(P, ENV, shown.alias("name")).distinct()


__all__ = [
    "expand", "find", "lookup_references", "lookup_table", "missing_secrets", "references", "resolve_templates",
    "resolved_maps", "scope_maps", "spread_environments", "substitute", "undefined_references", "variable_names",
]

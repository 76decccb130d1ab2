"""Linking names across files: imports to files, references to declared symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiquarry.functions.http import language_of
from apiquarry.operators.groups import first_per_key, last_per_key
from apiquarry.session import cut_lineage

P = "project_id"

# File endings of the module systems.
JS_EXTENSIONS = ["js", "ts", "jsx", "tsx", "mjs", "cjs", "mts", "cts"]
JS_SWAPS = {"js": "ts", "mjs": "mts", "cjs": "cts", "jsx": "tsx"}


def directory_of(path: Column) -> Column:
    """Everything before the last ``/``; empty at the top."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/$", "")


def _lexical(path: Column) -> Column:
    """Collapse ``.`` and ``..`` by text; climbing past the top stays at the top."""
    parts = F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(kept, "/")


def _under(base: Column, rest: Column) -> Column:
    return F.when(base == "", rest).when(rest == "", base).otherwise(F.concat_ws("/", base, rest))


def _py_files(base: Column) -> list[Column]:
    return [
        F.concat(F.regexp_replace(base, r"\.[^./]*$", ""), F.lit(".py")),
        _under(base, F.lit("__init__.py")),
    ]


def python_bases(importing: Column, source: Column, level: Column) -> list[Column]:
    """What a Python import may name, best first, without endings; NULL where a rule does not apply."""
    tail = F.array_join(F.filter(F.split(source, r"\.", -1), lambda s: s != ""), "/")
    dirs = F.filter(F.split(directory_of(importing), "/", -1), lambda s: s != "")
    climbs = level - 1
    own = F.when(
        (level > 0) & (F.size(dirs) >= climbs),
        F.array_join(F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - climbs, F.lit(0))), "/"),
    )
    base = _under(F.when(level == 0, F.lit("")).otherwise(own), tail)
    top = F.when(level == 0, F.substring_index(importing, "/", 1))
    return [base, _under(top, tail)]


def js_bases(importing: Column, source: Column) -> list[Column]:
    """What a JavaScript or TypeScript import may name, best first, without endings."""
    relative = source.startswith("./") | source.startswith("../")
    aliased = source.startswith("@/") | source.startswith("~/")
    rest = F.substring(source, F.lit(3), F.length(source))
    first = F.when(relative, _lexical(_under(directory_of(importing), source))).when(
        aliased, _lexical(F.concat(F.lit("src/"), rest))
    )
    second = F.when(aliased & ~relative, _lexical(rest))
    return [first, second]


def _js_files(base: Column) -> list[Column]:
    ext = F.regexp_extract(base, r"[^/]\.([^./]+)$", 1)
    swapped = F.lit(None).cast("string")
    for a, b in JS_SWAPS.items():
        swapped = F.when(ext == a, F.regexp_replace(base, r"\.[^./]+$", f".{b}")).otherwise(swapped)
    out = [base, swapped]
    out += [F.concat(base, F.lit(f".{e}")) for e in JS_EXTENSIONS]
    return out + [_under(base, F.lit(f"index.{e}")) for e in JS_EXTENSIONS]


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Import rows to bindings: ``kind`` (symbol or module), ``target_module``, ``target_name``.

    Every candidate file of an import is one row with a rank; an equi-join with the project's
    files keeps the real ones and the best rank wins. Imports from outside the project drop
    out. The last binding of a (module, local name) wins.
    """
    imports = imports.withColumn("_language", language_of(F.col("module")))
    module, source, original, level = (F.col(c) for c in ("module", "source", "original", "level"))
    python = F.col("_language") == "python"
    script = F.col("_language").isin("javascript", "typescript")
    absolute = source.startswith("/")
    nested = F.when(source == "", original).otherwise(F.concat_ws(".", source, original))

    def candidate(path: Column, rank: int, when: Column, is_module: Column, known: bool) -> Column:
        return F.struct(
            F.when(when, path).alias("path"),
            F.lit(rank).alias("rank"),
            is_module.alias("is_module"),
            F.lit(known).alias("known"),
        )

    plain = original.isNull()
    # Each base is worked out once, for rows dealt over all tasks, and only then given its endings.
    bases = {f"_nested{i}": b for i, b in enumerate(python_bases(module, nested, level))}
    bases |= {f"_python{i}": b for i, b in enumerate(python_bases(module, source, level))}
    bases |= {f"_script{i}": b for i, b in enumerate(js_bases(module, source))}
    imports = imports.repartition(P, "seq", "module", "local_name").withColumns(bases)
    ranked: list[Column] = []

    def rank(names: str, files_of, when: Column, is_module: Column) -> None:
        for name in (n for n in bases if n.startswith(names)):
            for path in files_of(F.col(name)):
                ranked.append(candidate(path, len(ranked), when, is_module, False))

    rank("_nested", _py_files, python & original.isNotNull() & ~absolute, F.lit(True))
    ranked.append(candidate(F.substring(source, F.lit(2), F.length(source)), len(ranked), absolute, plain, True))
    rank("_python", _py_files, python & ~absolute, plain)
    rank("_script", _js_files, script & ~absolute, plain)

    tried = (
        imports.select(P, "seq", "module", "local_name", "original", F.explode(F.array(*ranked)).alias("_c"))
        .filter("_c.path is not null")
        .select(P, "seq", "module", "local_name", "original", "_c.*")
    )
    known = files.select(P, "path").distinct().withColumn("_there", F.lit(True))
    hits = tried.join(known, [P, "path"], "left").filter("_there or known")
    best = hits.groupBy(P, "seq", "module", "local_name", "original").agg(
        F.min_by(F.struct("path", "is_module"), "rank").alias("_b")
    )
    bound = best.select(
        P,
        "seq",
        "module",
        "local_name",
        F.when(F.col("_b.is_module"), "module").otherwise("symbol").alias("kind"),
        F.col("_b.path").alias("target_module"),
        F.when(~F.col("_b.is_module"), F.col("original")).alias("target_name"),
    )
    return last_per_key(bound, [P, "module", "local_name"], ["seq"]).drop("seq")


def last_exports(exports: DataFrame) -> DataFrame:
    """Last export of a (module, exported name) wins."""
    return last_per_key(exports.select(P, "seq", "module", "exported", "local"), [P, "module", "exported"], ["seq"]).drop("seq")


def canonical_symbols(declared: DataFrame, bindings: DataFrame, exports: DataFrame) -> DataFrame:
    """Where each alias ends: (module, name) → (to_module, to_name).

    One hop is: a declared router stays; an export stands for its local name; an import for
    its target, a whole module for its ``default``. The hop table is composed with itself until
    nothing moves, which takes the logarithm of the longest chain. Aliases that go round in a circle
    still move when the number of moving ones stops falling; they have no end. Names without a hop or
    an end are absent.
    """
    by_export = exports.filter("exported <> local").select(
        P, "module", F.col("exported").alias("name"), F.col("module").alias("e_module"), F.col("local").alias("e_name")
    )
    by_import = bindings.select(
        P,
        "module",
        F.col("local_name").alias("name"),
        F.col("target_module").alias("i_module"),
        F.coalesce("target_name", F.lit("default")).alias("i_name"),
    )
    # two joins rather than a full one: where names are constants Spark knows that none match, and
    # makes of a full join a loop over all pairs
    key = [P, "module", "name"]
    both = by_export.join(by_import, key, "left").unionByName(by_import.join(by_export, key, "left_anti"), allowMissingColumns=True)
    hops = both.join(declared.select(*key), key, "left_anti").select(
        *key,
        F.coalesce("e_module", "i_module").alias("to_module"),
        F.when(F.col("e_module").isNotNull(), F.col("e_name")).otherwise(F.col("i_name")).alias("to_name"),
    )
    hops = cut_lineage(hops)
    before = None
    while True:
        onward = hops.select(
            P,
            F.col("module").alias("to_module"),
            F.col("name").alias("to_name"),
            F.col("to_module").alias("n_module"),
            F.col("to_name").alias("n_name"),
        )
        hops = cut_lineage(
            hops.join(onward, [P, "to_module", "to_name"], "left").select(
                P,
                "module",
                "name",
                F.coalesce("n_module", "to_module").alias("to_module"),
                F.coalesce("n_name", "to_name").alias("to_name"),
                F.col("n_module").isNotNull().alias("moved"),
            )
        )
        moving = hops.filter("moved").count()
        if moving in (0, before):
            return hops.filter("NOT moved").drop("moved")
        hops, before = hops.drop("moved"), moving


def resolve_symbols(refs: DataFrame, declared: DataFrame, bindings: DataFrame, exports: DataFrame) -> DataFrame:
    """References (project_id, module, name) with ``sym_module``, ``sym_name``; NULL = untraced.

    Go references are left out here, see :func:`resolve_go_symbols`.
    """
    refs = refs.select(P, "module", "name").distinct()
    qualified = F.col("name").rlike(r"\.[\p{L}_$][\p{L}\p{N}_$]*$")
    attribute = F.when(qualified, F.substring_index("name", ".", -1)).otherwise(F.col("name"))
    qualifier = F.when(qualified, F.regexp_replace("name", r"\.[^.]*$", ""))
    split = refs.withColumn("_attr", attribute).withColumn("_qual", qualifier)
    bound = bindings.withColumnRenamed("local_name", "_look")
    named = split.withColumn("_look", F.coalesce("_qual", "_attr")).join(bound, [P, "module", "_look"], "left")

    here = declared.select(P, "module", F.col("name").alias("_attr")).distinct().withColumn("_local", F.lit(True))
    named = named.join(here, [P, "module", "_attr"], "left")
    exported = exports.select(
        P, F.col("module").alias("target_module"), F.col("exported").alias("_attr")
    ).distinct().withColumn("_exported", F.lit(True))
    named = named.join(exported, [P, "target_module", "_attr"], "left")

    dotted = F.col("_qual").isNotNull()
    start_module = (
        F.when(dotted & (F.col("kind") == "module"), F.col("target_module"))
        .when(dotted & (F.col("target_name") == "default") & F.col("_exported"), F.col("target_module"))
        .when(dotted, None)
        .when(F.col("_local"), F.col("module"))
        .when(F.col("kind") == "symbol", F.col("target_module"))
        .when(F.col("kind") == "module", None)
        .otherwise(F.col("module"))
    )
    start_name = F.when(~dotted & ~F.coalesce("_local", F.lit(False)) & (F.col("kind") == "symbol"), F.col("target_name")).otherwise(
        F.col("_attr")
    )
    # A local or untraced local name is its own end; everything else follows its aliases.
    follow = dotted | (~F.coalesce("_local", F.lit(False)) & (F.col("kind") == "symbol"))
    started = named.select(
        P, "module", "name", start_module.alias("s_module"), start_name.alias("s_name"),
        F.coalesce(follow, F.lit(False)).alias("_follow"),
    )
    ends = canonical_symbols(declared, bindings, exports).select(
        P, F.col("module").alias("s_module"), F.col("name").alias("s_name"), "to_module", "to_name"
    )
    return started.join(ends, [P, "s_module", "s_name"], "left").select(
        P,
        "module",
        "name",
        F.when(F.col("_follow"), F.coalesce("to_module", "s_module")).otherwise(F.col("s_module")).alias("sym_module"),
        F.when(F.col("s_module").isNull(), None)
        .when(F.col("_follow"), F.coalesce("to_name", "s_name"))
        .otherwise(F.col("s_name"))
        .alias("sym_name"),
    )


def resolve_go_symbols(refs: DataFrame, declared: DataFrame, bindings: DataFrame, exports: DataFrame) -> DataFrame:
    """Go references: the file, then its package (directory), then an imported package.

    ``exports`` must be the raw rows with ``seq``: the last alias of a package wins.

    Aliases may stand for longer names, even for names that begin with themselves. A name with more parts than
    any router or alias of its package can only have its head replaced, which never shortens it, so it leads
    nowhere; shorter names are finitely many, and one met before ends the chain. Every chain thus ends by itself.

    All joins are by merging: sides made by exploding look small to Spark, which would send them through the driver
    in every round.
    """
    go = language_of(F.col("module")) == "go"
    refs = refs.filter(go).select(P, "module", "name").distinct()
    symbols = declared.filter(go).select(P, "module", "name").distinct()
    routers = last_per_key(
        symbols.select(P, directory_of(F.col("module")).alias("pkg"), F.col("name").alias("look"), F.col("module").alias("r_module")),
        [P, "pkg", "look"],
        ["r_module"],
    )
    aliases = last_per_key(
        exports.filter(go).select(P, directory_of(F.col("module")).alias("pkg"), F.col("exported").alias("look"), F.col("local").alias("alias"), "seq"),
        [P, "pkg", "look"],
        ["seq"],
    ).drop("seq")
    aliases = cut_lineage(aliases.filter("alias <> look"))
    parts = F.size(F.split("look", r"\."))
    longest = routers.select(P, "pkg", "look").unionByName(aliases.select(P, "pkg", "look")).groupBy(P, "pkg").agg(F.max(parts).alias("longest"))

    here = symbols.withColumn("_here", F.lit(True))
    first = F.substring_index("name", ".", 1)
    imported = bindings.filter("kind = 'module'").select(P, "module", F.col("local_name").alias("_first"), F.col("target_module").alias("_pkg"))
    rest = F.regexp_replace("name", r"^[^.]*\.", "")
    dotted = F.contains(F.col("name"), F.lit("."))
    state = (
        refs.withColumn("_first", first)
        .join(imported.hint("merge"), [P, "module", "_first"], "left")
        .join(here.hint("merge"), [P, "module", "name"], "left")
        .select(
            P,
            "module",
            "name",
            F.when(dotted & F.col("_pkg").isNotNull(), F.col("_pkg")).otherwise(directory_of(F.col("module"))).alias("pkg"),
            F.when(dotted & F.col("_pkg").isNotNull(), rest).otherwise(F.col("name")).alias("look"),
            F.when(F.col("_here"), F.col("module")).alias("sym_module"),
            F.when(F.col("_here"), F.col("name")).alias("sym_name"),
            F.array().cast("array<string>").alias("seen"),
        )
    )
    settled = state.filter("sym_module is not null").select(P, "module", "name", "sym_module", "sym_name")
    open_ = cut_lineage(state.filter("sym_module is null").drop("sym_module", "sym_name").join(longest.hint("merge"), [P, "pkg"], "left"))
    heads = aliases.select(P, "pkg", F.col("look").alias("_head"), F.col("alias").alias("_head_alias"))
    while not open_.isEmpty():
        met = (
            open_.join(routers.hint("merge"), [P, "pkg", "look"], "left")
            .join(aliases.hint("merge"), [P, "pkg", "look"], "left")
            .withColumn("_head", F.substring_index("look", ".", 1))
            .join(heads.hint("merge"), [P, "pkg", "_head"], "left")
        )
        tail = F.when(F.contains(F.col("look"), F.lit(".")), F.regexp_replace("look", r"^[^.]*", "")).otherwise("")
        moved = F.coalesce(F.col("alias"), F.concat(F.col("_head_alias"), tail))
        looked = cut_lineage(met.select(P, "module", "name", "pkg", "longest", "look", "seen", "r_module", moved.alias("moved")))
        ends = F.col("moved").isNull() | F.array_contains("seen", F.col("moved")) | (F.size(F.split("moved", r"\.")) > F.col("longest"))
        settled = settled.unionByName(
            looked.filter(F.col("r_module").isNotNull() | ends).select(
                P,
                "module",
                "name",
                F.coalesce("r_module", "module").alias("sym_module"),
                F.when(F.col("r_module").isNotNull(), F.col("look")).otherwise(F.col("name")).alias("sym_name"),
            )
        )
        open_ = looked.filter(F.col("r_module").isNull() & ~ends).select(
            P, "module", "name", "pkg", F.col("moved").alias("look"), F.concat("seen", F.array(F.col("look"))).alias("seen"), "longest"
        )
    return settled


def first_declarations(routers: DataFrame) -> DataFrame:
    """First declaration of a router symbol wins."""
    return first_per_key(routers, [P, "module", "name"], ["seq"])

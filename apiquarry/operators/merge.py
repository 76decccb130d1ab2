"""Merging two inventories of the same projects: what the source says and what the running
application says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apiquarry.functions import paths
from apiquarry.operators.groups import first_per_key, last_per_key, top_k_per_key
from apiquarry.session import cut_lineage

P = "project_id"
NO_META = "map<string,string>"


def _loose(path: Column) -> Column:
    return F.replace(paths.normalize_path(path), F.lit("{*}"), F.lit("{}"))


def _signature(segments: Column) -> Column:
    """Literals by value, parameters all alike; an unresolved segment matches nothing."""
    marks = F.transform(
        segments,
        lambda s: F.when(s["kind"] == "literal", F.concat(F.lit("/="), s["value"]))
        .when(s["kind"] == "param", F.lit("/{}"))
        .otherwise(F.lit("/?")),
    )
    return F.array_join(marks, "")


def gap_candidates(gaps: DataFrame, runtime: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which runtime paths could fill which static gaps, gaps that ask for the same in one class:
    the gaps (project_id, cls, sid) and the candidates of a class (project_id, cls, rid, weight).

    The parts before the first and after the last unresolved segment become join keys, and a
    runtime row offers every (head, tail) split of itself, so the join is a plain equi-join. Rows
    of one ``sid`` are one gap; ``weight`` is how many of them a candidate fits. Gaps times
    candidates are never written out.
    """
    segs = F.col("path.segments")
    marks = F.transform(segs, lambda s: s["kind"] == "unresolved")
    first = F.array_position(marks, True).cast("int")
    last = (F.size(segs) + 1 - F.array_position(F.reverse(marks), True)).cast("int")
    split = ["method", "h", "t", "head", "tail"]
    left = gaps.filter(F.col(P).isNotNull() & F.col("sid").isNotNull() & F.col("method").isNotNull()).select(
        P,
        "sid",
        "method",
        (first - 1).alias("h"),
        (F.size(segs) - last).alias("t"),
        _signature(F.slice(segs, F.lit(1), first - 1)).alias("head"),
        _signature(F.slice(segs, last + 1, F.size(segs) - last)).alias("tail"),
    )
    counted = left.groupBy(P, "sid", *split).agg(F.count("*").alias("weight"))
    wants = counted.groupBy(P, "sid").agg(F.array_sort(F.collect_list(F.struct(*split, "weight"))).alias("asks"))
    wants = cut_lineage(wants)
    classes = cut_lineage(wants.groupBy(P, "asks").agg(F.min("sid").alias("cls")))
    asking = classes.select(P, "cls", F.explode("asks").alias("a")).select(P, "cls", "a.*")
    # Only splits some gap of that project and method asks for are offered.
    asked = asking.select(P, "method", "h", "t").distinct()
    offered = (
        runtime.select(P, "rid", "method", "path")
        .join(asked, [P, "method"])
        .filter(F.size(segs) >= F.col("h") + F.col("t") + 1)
        .select(
            P,
            "rid",
            "method",
            "h",
            "t",
            _signature(F.slice(segs, F.lit(1), F.col("h"))).alias("head"),
            _signature(F.slice(segs, F.size(segs) - F.col("t") + 1, F.col("t"))).alias("tail"),
        )
    )
    offers = asking.join(offered, [P, *split]).groupBy(P, "cls", "rid").agg(F.sum("weight").alias("weight"))
    return wants.join(classes, [P, "asks"]).select(P, "cls", "sid"), offers


def settle_gaps(pairs: DataFrame) -> DataFrame:
    """Which gap takes which candidate: (project_id, sid, rid), from pairs of both.

    The rule is sequential: gaps in order, each takes its candidate when exactly one is still
    free. ``pairs`` has ``ord`` (the gap's place in that order).
    """
    pairs = cut_lineage(pairs)
    gaps = pairs.select(P, F.col("sid").alias("cls"), "sid", "ord").distinct()
    return settle_classes(gaps, pairs.groupBy(P, F.col("sid").alias("cls"), "rid").agg(F.count("*").alias("weight")))


def settle_classes(gaps: DataFrame, offers: DataFrame) -> DataFrame:
    """:func:`settle_gaps` for gaps (project_id, cls, sid, ord) and the candidates of a class
    (project_id, cls, rid, weight).

    A class takes one candidate at most: with its last one gone nothing is left. So what has to be
    known is when. The earliest place at which a class could be down to one candidate is, with one,
    its first gap; with n, its first gap after n - 1 of its candidates could be gone. Places are
    lowered from "never" until none moves. Classes that stay at "never" are set aside; a class with one candidate
    that nobody could take earlier takes it. Independent classes settle in the same round.
    """
    cls = [P, "cls"]
    gaps, offers = cut_lineage(gaps), cut_lineage(offers)
    floor = gaps.groupBy(*cls).agg(F.min("ord").alias("floor"))
    taken: list[DataFrame] = []
    while True:
        sizes = cut_lineage(offers.groupBy(*cls).agg(F.sum("weight").alias("n")).join(floor, cls))
        if sizes.isEmpty():
            break
        # a floor is always the place of a gap
        places = cut_lineage(sizes.filter("n = 1").select(*cls, F.col("floor").alias("at")))
        while True:
            gone = offers.join(places, cls).groupBy(P, "rid").agg(F.min("at").alias("gone"))
            loses = cut_lineage(offers.join(sizes.filter("n > 1"), cls).join(gone, [P, "rid"]))
            enough = loses.groupBy(*cls, "n").agg(F.sum("weight").alias("lost")).filter("lost >= n - 1").select(*cls)
            upto = F.sum("weight").over(Window.partitionBy(*cls).orderBy("gone"))
            after = (
                loses.join(enough, cls, "left_semi")
                .withColumn("lost", upto)
                .filter("lost >= n - 1")
                .groupBy(*cls)
                .agg(F.min("gone").alias("gone"), F.min("floor").alias("floor"))
            )
            found = gaps.join(after, cls).filter("ord > gone AND ord >= floor").groupBy(*cls).agg(F.min("ord").alias("at"))
            was = places.withColumnRenamed("at", "was")
            better = cut_lineage(found.join(was, cls, "left").filter("was IS NULL OR at < was").select(*cls, "at"))
            if better.isEmpty():
                break
            places = cut_lineage(places.join(better, cls, "left_anti").unionByName(better))
        live = cut_lineage(offers.join(places, cls))
        if live.isEmpty():
            break
        turn = live.groupBy(P, "rid").agg(F.min(F.struct("at", "cls")).alias("turn"))
        takes = (
            live.join(sizes.filter("n = 1").select(*cls), cls, "left_semi")
            .join(turn, [P, "rid"])
            .filter((F.col("turn.at") == F.col("at")) & (F.col("turn.cls") == F.col("cls")))
        )
        takes = takes.select(*cls, "rid", F.col("at").alias("ord"))
        took = cut_lineage(gaps.join(takes, [*cls, "ord"]).groupBy(P, "rid").agg(F.min("sid").alias("sid")).select(P, "sid", "rid"))
        taken.append(took)
        offers = cut_lineage(live.select(*cls, "rid", "weight").join(took.select(P, "rid"), [P, "rid"], "left_anti"))
        floor = places.withColumnRenamed("at", "floor")
    none = gaps.join(offers.select(*cls, "rid"), cls).select(P, "sid", "rid").limit(0)
    return reduce(DataFrame.unionByName, taken) if taken else none


def merge_inventories(static: DataFrame, runtime: DataFrame) -> DataFrame:
    """One inventory from a static and a runtime one; ``metadata['enrich']`` says how each row
    fared: matched, static_only, runtime_only or gap_filled.

    Both inputs are endpoint tables with ``seq`` (order of appearance). Each runtime row is
    claimed at most once, except where its methods are unknown.
    """
    # Runtime rows of one id: the last stands. Static order: as given.
    runtime = cut_lineage(
        last_per_key(runtime, [P, "id"], ["seq"]).withColumn("rid", F.col("id")).withColumn("loose", _loose(F.col("path")))
    )
    static = cut_lineage(
        static.withColumn("sid", F.col("seq")).withColumn("loose", _loose(F.col("path")))
    )
    ids = runtime.select(P, "id", "rid")
    # (a) same id: only the first static row of an id claims.
    firsts = first_per_key(static.select(P, "id", "sid"), [P, "id"], ["sid"])
    exact = cut_lineage(firsts.join(ids, [P, "id"]).select(P, "sid", "rid"))
    rest = static.join(exact.select(P, "sid"), [P, "sid"], "left_anti")
    free = runtime.join(exact.select(P, "rid"), [P, "rid"], "left_anti")
    gaps = rest.filter(~paths.is_resolved(F.col("path")))
    plain = cut_lineage(rest.filter(paths.is_resolved(F.col("path"))))
    free = cut_lineage(free)

    # (b) same method and loosened path: n-th static row with n-th runtime row. A key offers
    # few runtime rows, so only that many static rows of it are ranked.
    key = [P, "method", "loose"]
    deepest = free.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    offers = top_k_per_key(free.select(*key, "rid"), key, [F.col("rid")], int(deepest), ["rid"], "rn")
    asks = plain.select(*key, "sid").join(offers.select(*key).distinct(), key, "left_semi")
    asks = top_k_per_key(asks, key, [F.col("sid")], int(deepest), ["sid"], "rn")
    loose = cut_lineage(asks.join(offers, [*key, "rn"]).select(P, "sid", "rid"))
    left = plain.join(loose.select(P, "sid"), [P, "sid"], "left_anti")

    # (c) same path where runtime does not know its methods: borrowed, not consumed. Free rows
    # come first by id, then those (b) had taken by then, then those of (a).
    unknown = F.col("metadata")["methods-unknown"] == "true"
    claims = loose.select(P, "rid", F.col("sid").alias("taken_at")).withColumn("pool", F.lit(1)).unionByName(
        exact.select(P, "rid", F.col("sid").alias("taken_at")).withColumn("pool", F.lit(2))
    )
    lenders = runtime.filter(unknown).select(P, "loose", "rid").join(claims, [P, "rid"], "left")
    later = (F.col("pool") == 1) & (F.col("taken_at") > F.col("sid"))
    pool = F.when(F.col("pool").isNull() | later, 0).otherwise(F.col("pool"))
    choice = F.struct(
        pool.alias("pool"),
        F.when(pool == 0, F.lit(0).cast("bigint")).otherwise(F.col("taken_at")).alias("at"),
        F.col("rid"),
    )
    borrowed = (
        left.select(P, "loose", "sid")
        .join(lenders, [P, "loose"])
        .groupBy(P, "sid")
        .agg(F.min_by("rid", choice).alias("rid"))
    )
    borrowed = cut_lineage(borrowed)

    # (d) gaps, against what (b) left free, in static order.
    still = free.join(loose.select(P, "rid"), [P, "rid"], "left_anti")
    asks, offers = gap_candidates(gaps, still)
    filled = cut_lineage(settle_classes(asks.withColumn("ord", F.col("sid")), offers))

    how = (
        exact.withColumn("enrich", F.lit("matched"))
        .unionByName(loose.withColumn("enrich", F.lit("matched")))
        .unionByName(borrowed.withColumn("enrich", F.lit("borrowed")))
        .unionByName(filled.withColumn("enrich", F.lit("gap_filled")))
    )
    return _assemble(static, runtime, how)


def _assemble(static: DataFrame, runtime: DataFrame, how: DataFrame) -> DataFrame:
    """Combine matched pairs (runtime wins on detail, static gives the source) and mark the
    rest."""
    columns = [
        "id", "method", "path", "path_params", "query_params", "headers", "body", "auth", "source", "origin",
        "group", "summary", "description", "confidence", "orphaned", "metadata",
    ]
    s = static.select(P, "sid", F.struct(*columns).alias("s")).join(how, [P, "sid"], "left")
    r = runtime.select(P, "rid", F.struct(*columns).alias("r"))
    both = s.join(r, [P, "rid"], "left")
    alone = F.col("rid").isNull()
    borrowed = F.col("enrich") == "borrowed"
    mark = F.when(alone, "static_only").when(borrowed, "matched").otherwise(F.col("enrich"))
    empty = F.create_map().cast(NO_META)
    s_meta, r_meta = F.coalesce("s.metadata", empty), F.coalesce("r.metadata", empty)
    kept = F.map_filter(s_meta, lambda k, _v: ~F.map_contains_key(r_meta, k))

    def stamp(meta: Column, value: Column) -> Column:
        clean = F.map_filter(meta, lambda k, _v: ~k.isin("enrich"))
        return F.map_concat(clean, F.create_map(F.lit("enrich"), value))

    merged_meta = stamp(F.map_concat(kept, r_meta), mark)
    exprs = F.array_join(paths.unresolved_exprs(F.col("s.path")), ", ")
    merged_meta = F.when(
        mark == "gap_filled",
        F.map_concat(
            F.map_filter(merged_meta, lambda k, _v: k != "resolved_from"), F.create_map(F.lit("resolved_from"), exprs)
        ),
    ).otherwise(merged_meta)
    picked = {
        "method": F.when(alone | borrowed, F.col("s.method")).otherwise(F.col("r.method")),
        "source": F.col("s.source"),
        "group": F.coalesce("r.group", "s.group"),
        "summary": F.coalesce("r.summary", "s.summary"),
        "description": F.coalesce("r.description", "s.description"),
        "confidence": F.when(alone, "low").otherwise("high"),
        "orphaned": F.when(alone, F.col("s.orphaned")).otherwise(False),
        "metadata": F.when(alone, stamp(s_meta, F.lit("static_only"))).otherwise(merged_meta),
    }
    whole = [
        picked.get(c, F.when(alone, F.col(f"s.{c}")).otherwise(F.col(f"r.{c}"))).alias(c) for c in columns if c != "id"
    ]
    from_static = both.select(P, *whole).withColumn("id", paths.endpoint_id(F.col("method"), F.col("path")))
    claimed = how.filter("enrich <> 'borrowed'").select(P, "rid").distinct()
    from_runtime = (
        runtime.join(claimed, [P, "rid"], "left_anti")
        .select(P, *columns)
        .withColumn("metadata", stamp(F.coalesce("metadata", empty), F.lit("runtime_only")))
    )
    return from_static.select(P, *columns).unionByName(from_runtime)


def merge_report(merged: DataFrame) -> DataFrame:
    """Per project: matched, static_only, runtime_only, gaps_filled."""
    how = F.col("metadata")["enrich"]
    return merged.groupBy(P).agg(
        F.count_if(how == "matched").alias("matched"),
        F.count_if(how == "static_only").alias("static_only"),
        F.count_if(how == "runtime_only").alias("runtime_only"),
        F.count_if(how == "gap_filled").alias("gaps_filled"),
    )

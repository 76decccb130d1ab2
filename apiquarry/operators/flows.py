"""Test flows as node and edge tables: validation, order, reachability, lint.

``flow_nodes`` has project_id, flow, node_id, doc_index, type and the step's own fields;
``flow_edges`` has project_id, flow, from_node, to_node, handle, edge_index. All flows of all
projects are handled in one job.

Flows of at most ``SMALL`` rows are gathered into one row each and solved by expressions over its
arrays, so all of them together take one shuffle; larger ones, and those with repeated or missing
names, go in rounds of joins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apiquarry.functions.text import references, strip
from apiquarry.operators.closure import components, reachable
from apiquarry.operators.groups import rank_per_key
from apiquarry.operators.variables import canonical_name
from apiquarry.session import cut_lineage

P, FLOW = "project_id", "flow"
KEYS = [P, FLOW]
#: Most rows, nodes and edges together, of a flow that is solved inside one row.
SMALL = 32


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _times(n: Column, start: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` taken ``n`` times, or until it changes nothing."""
    first = F.struct(start.alias("now"), F.lit(True).alias("moved"))
    again = lambda s: _let(step(s["now"]), lambda new: F.struct(new.alias("now"), (new != s["now"]).alias("moved")))
    return F.aggregate(F.array_repeat(F.lit(0), n.cast("int")), first, lambda s, _: F.when(s["moved"], again(s)).otherwise(s), lambda s: s["now"])


def _split(nodes: DataFrame, edges: DataFrame, solve: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Small flows solved within one row, and the keys of the flows that are left.

    ``nodes`` has keys, ``node`` and what else ``solve`` needs, ``edges`` keys, ``src`` and ``dst``. ``solve`` is
    given a flow's nodes by name and its distinct edges, and returns an array of structs, which become rows.
    No more than ``SMALL`` rows of a flow and one more are brought together. Flows with a missing key, name or other
    value, or a name twice, are left like the large ones.
    """
    others = [c for c in nodes.columns if c not in KEYS]
    rows = nodes.select(*KEYS, F.struct(*others).alias("n")).unionByName(
        edges.select(*KEYS, F.struct("src", "dst").alias("e")), allowMissingColumns=True
    )
    few = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("e").isNull()))).filter(F.col("_at") <= SMALL + 1)
    flows = few.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list("n")).alias("ns"), F.collect_set("e").alias("es"), F.count("*").alias("size")
    )
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in KEYS]) & (F.col("size") <= SMALL)
    full = F.forall("ns", lambda n: reduce(Column.__and__, [n[c].isNotNull() for c in others]))
    once = F.size(F.array_distinct(F.transform("ns", lambda n: n["node"]))) == F.size("ns")
    solved = cut_lineage(flows.select(*KEYS, F.when(whole & full & once, solve(F.col("ns"), F.col("es"))).alias("got")))
    return solved.filter("got is not null").select(*KEYS, F.inline("got")), cut_lineage(solved.filter("got is null").select(*KEYS))


def _of(df: DataFrame, flows: DataFrame) -> DataFrame:
    """Rows of these flows, missing keys included."""
    these = flows.select(*[F.col(k).alias(f"_{k}") for k in KEYS])
    return df.join(these, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]), "left_semi")


def _fed_by(ns: Column, es: Column) -> Column:
    """For each node the places, from one, of the nodes an edge leads from; edges to and from nowhere are left out."""
    names = F.transform(ns, lambda n: n["node"])

    def links(names: Column) -> Column:
        place = lambda name: F.array_position(names, name).cast("int")
        ends = F.transform(es, lambda e: F.struct(place(e["src"]).alias("a"), place(e["dst"]).alias("b")))
        known = F.filter(ends, lambda e: (e["a"] > 0) & (e["b"] > 0))
        return _let(
            known,
            lambda ls: F.transform(names, lambda _, i: F.transform(F.filter(ls, lambda x: x["b"] == i + 1), lambda x: x["a"])),
        )

    return _let(names, links)


def flow_edges_of(edges: DataFrame) -> DataFrame:
    """Distinct src → dst pairs; a repeated edge counts once."""
    return edges.select(*KEYS, F.col("from_node").alias("src"), F.col("to_node").alias("dst")).distinct()


def is_input_block(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(keys, node_id) of variables blocks nothing leads into."""
    fed = edges.select(*KEYS, F.col("to_node").alias("node_id")).distinct()
    return nodes.filter("type = 'variables'").select(*KEYS, "node_id").join(fed, [*KEYS, "node_id"], "left_anti")


def _layers_within(ns: Column, es: Column) -> Column:
    """A node's layer is one more than the highest it is fed from; what never comes below ``SMALL`` is stuck."""
    stuck = F.lit(SMALL)

    def step(fed: Column, now: Column) -> Column:
        return F.transform(fed, lambda p: F.aggregate(p, F.lit(0), lambda top, x: F.greatest(top, F.least(F.element_at(now, x) + 1, stuck))))

    found = _let(_fed_by(ns, es), lambda fed: _times(F.size(ns), F.transform(fed, lambda _: stuck), lambda now: step(fed, now)))
    return _let(
        found,
        lambda at: F.transform(ns, lambda n, i: F.struct(n["node"].alias("node_id"), F.nullif(F.element_at(at, i + 1), stuck).alias("layer"))),
    )


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``layer`` is the length of the longest chain into a node; NULL for the nodes stuck in or
    behind a cycle.
    """
    ends = edges.select(*KEYS, F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
    small, left = _split(nodes.select(*KEYS, F.col("node_id").alias("node")), ends, _layers_within)
    if left.isEmpty():
        return small
    return small.unionByName(_layers_in_rounds(_of(nodes, left), _of(edges, left)))


def _layers_in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Peel nodes without incoming edges, round by round, all flows at once."""
    left = cut_lineage(nodes.select(*KEYS, F.col("node_id").alias("node")).distinct())
    known = left
    open_edges = flow_edges_of(edges)
    for end in ("src", "dst"):
        open_edges = open_edges.join(known.withColumnRenamed("node", end), [*KEYS, end], "left_semi")
    open_edges = cut_lineage(open_edges)
    peeled: list[DataFrame] = []
    layer = 0
    while True:
        fed = open_edges.select(*KEYS, F.col("dst").alias("node")).distinct()
        flagged = cut_lineage(left.join(fed.withColumn("_fed", F.lit(True)), [*KEYS, "node"], "left"))
        ready = flagged.filter("_fed is null").drop("_fed")
        if ready.isEmpty():
            break
        peeled.append(ready.withColumn("layer", F.lit(layer)))
        left = flagged.filter("_fed").drop("_fed")
        open_edges = cut_lineage(open_edges.join(ready.withColumnRenamed("node", "src"), [*KEYS, "src"], "left_anti"))
        layer += 1
    stuck = left.withColumn("layer", F.lit(None).cast("int"))
    return reduce(DataFrame.unionByName, [*peeled, stuck]).withColumnRenamed("node", "node_id")


def depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest edge chain into each node; 0 everywhere in a flow with a cycle."""
    found = layers(nodes, edges)
    cyclic = found.filter("layer is null").select(*KEYS).distinct().withColumn("_cyclic", F.lit(True))
    return found.join(cyclic, KEYS, "left").select(
        *KEYS, "node_id", F.when(F.col("_cyclic"), 0).otherwise(F.col("layer")).alias("depth")
    )


def validate_flow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every problem of every flow: keys, ``rule``, ``node``, ``handle``, ``place``.

    ``place`` orders problems the way they would be met: duplicate nodes, then edges one by
    one, then the cycle. A cycle is looked for only where nothing else is wrong; its row names
    the stuck nodes in document order.
    """
    duplicate = (
        nodes.groupBy(*KEYS, "node_id")
        .agg(F.count("*").alias("n"), F.min("doc_index").alias("at"))
        .filter("n > 1")
        .select(*KEYS, F.lit("duplicate_node").alias("rule"), F.col("node_id").alias("node"), F.lit(None).cast("string").alias("handle"), F.struct(F.lit(0), F.col("at").cast("bigint"), F.lit(0)).alias("place"))
    )
    first = nodes.groupBy(*KEYS, "node_id").agg(F.min_by("type", "doc_index").alias("type"))
    ends = edges.join(first.withColumnRenamed("node_id", "from_node").withColumnRenamed("type", "from_type"), [*KEYS, "from_node"], "left").join(
        first.withColumnRenamed("node_id", "to_node").withColumnRenamed("type", "to_type"), [*KEYS, "to_node"], "left"
    )
    branching = F.col("from_type") == "condition"
    handle = F.col("handle")
    bad_handle = F.when(branching, handle.isNull() | ~handle.isin("true", "false")).otherwise(handle.isNotNull())

    def edge_rule(rule: str, node: str, step: int, shown: Column) -> Column:
        return F.struct(
            F.lit(rule).alias("rule"), F.col(node).alias("node"), shown.cast("string").alias("handle"),
            F.struct(F.lit(1), F.col("edge_index").cast("bigint"), F.lit(step)).alias("place"),
        )

    known = F.col("from_type").isNotNull() & F.col("to_type").isNotNull()
    own = F.col("from_node") == F.col("to_node")
    none = F.lit(None)
    # An edge breaks one rule at most.
    broken = (
        F.when(F.col("from_type").isNull(), edge_rule("dangling_edge", "from_node", 0, none))
        .when(F.col("to_type").isNull(), edge_rule("dangling_edge", "to_node", 1, none))
        .when(known & own, edge_rule("self_loop", "from_node", 2, none))
        .when(known & ~own & bad_handle, edge_rule("unknown_handle", "from_node", 3, F.coalesce(handle, F.lit(""))))
    )
    bad_edges = ends.select(*KEYS, broken.alias("_p")).filter("_p is not null").select(*KEYS, "_p.*")
    problems = cut_lineage(duplicate.unionByName(bad_edges))
    flawed = problems.select(*KEYS).distinct()
    clean_nodes = nodes.join(flawed, KEYS, "left_anti")
    clean_edges = edges.join(flawed, KEYS, "left_anti")
    stuck = layers(clean_nodes, clean_edges).filter("layer is null").join(clean_nodes.select(*KEYS, "node_id", "doc_index"), [*KEYS, "node_id"])
    cycle = stuck.select(
        *KEYS, F.lit("cycle").alias("rule"), F.col("node_id").alias("node"), F.lit(None).cast("string").alias("handle"),
        F.struct(F.lit(2), F.col("doc_index").cast("bigint"), F.lit(0)).alias("place"),
    )
    return problems.unionByName(cycle)


def first_problem(problems: DataFrame) -> DataFrame:
    """The one problem a validation of the flow stops at."""
    return problems.groupBy(*KEYS).agg(F.min_by(F.struct("rule", "node", "handle"), "place").alias("p")).select(*KEYS, "p.*")


def order_keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(keys, node, key): sorting a flow by ``key`` is its topological order.

    Always taking the ready node of least index is the same as sorting by an array: the
    greatest key among a node's predecessors, cut back to the entries above the node's own
    index, then that index. A flow whose edges all run down the document needs no more than
    the indexes; the others are worked out layer by layer, all of them at once.
    """
    indexed = cut_lineage(nodes.select(*KEYS, F.col("node_id").alias("node"), F.col("doc_index").cast("bigint").alias("idx")))
    pairs = flow_edges_of(edges)
    for end in ("src", "dst"):
        pairs = pairs.join(indexed.select(*KEYS, F.col("node").alias(end), F.col("idx").alias(f"{end}_idx")), [*KEYS, end])
    pairs = cut_lineage(pairs)
    upward = cut_lineage(pairs.filter("src_idx > dst_idx").select(*KEYS).distinct())
    plain = indexed.join(upward, KEYS, "left_anti").select(*KEYS, "node", F.array("idx").alias("key"))
    left = cut_lineage(indexed.join(upward, KEYS, "left_semi"))
    open_edges = pairs.join(upward, KEYS, "left_semi").select(*KEYS, "src", "dst")
    edges_left = cut_lineage(open_edges)
    settled = [plain]
    best = left.select(*KEYS, "node", F.lit(None).cast("array<bigint>").alias("best")).limit(0)
    while not left.isEmpty():
        fed = edges_left.select(*KEYS, F.col("dst").alias("node")).distinct().withColumn("_fed", F.lit(True))
        flagged = cut_lineage(left.join(fed, [*KEYS, "node"], "left").join(best, [*KEYS, "node"], "left"))
        above = F.filter(F.coalesce("best", F.array().cast("array<bigint>")), lambda k: k > F.col("idx"))
        ready = cut_lineage(flagged.filter("_fed is null").select(*KEYS, "node", F.concat(above, F.array("idx")).alias("key")))
        if ready.isEmpty():
            break
        settled.append(ready)
        offers = edges_left.join(ready.withColumnRenamed("node", "src"), [*KEYS, "src"]).select(*KEYS, F.col("dst").alias("node"), F.col("key").alias("best"))
        kept = flagged.filter("_fed").select(*KEYS, "node", "best").filter("best is not null")
        best = cut_lineage(kept.unionByName(offers).groupBy(*KEYS, "node").agg(F.max("best").alias("best")))
        left = flagged.filter("_fed").select(*KEYS, "node", "idx")
        edges_left = cut_lineage(edges_left.join(ready.select(*KEYS, F.col("node").alias("src")), [*KEYS, "src"], "left_anti"))
    return reduce(DataFrame.unionByName, settled)


def _order_within(ns: Column, es: Column) -> Column:
    """The keys of :func:`order_keys` for one flow; its nodes sorted by them, input blocks first."""

    def key(fed: Column, n: Column, i: Column, now: Column) -> Column:
        before = F.transform(F.element_at(fed, i + 1), lambda x: F.element_at(now, x))
        # An empty array stands for a node that has no key yet.
        ready = F.forall(before, lambda k: F.size(k) > 0)
        above = F.filter(F.coalesce(F.array_max(before), F.array().cast("array<bigint>")), lambda k: k > n["idx"])
        return F.when(ready, F.concat(above, F.array(n["idx"]))).otherwise(F.array().cast("array<bigint>"))

    def place(fed: Column) -> Column:
        up = F.transform(ns, lambda n, i: F.exists(F.element_at(fed, i + 1), lambda x: F.element_at(ns, x)["idx"] > n["idx"]))

        def keys(upward: Column) -> Column:
            start = F.transform(ns, lambda n: F.when(upward, F.array().cast("array<bigint>")).otherwise(F.array(n["idx"])))
            return _times(F.when(upward, F.size(ns)).otherwise(0), start, lambda now: F.transform(ns, lambda n, i: key(fed, n, i, now)))

        return _let(F.exists(up, lambda u: u), keys)

    fed_at_all = F.transform(es, lambda e: e["dst"])
    late = lambda n: F.when((n["type"] == "variables") & ~F.coalesce(F.array_contains(fed_at_all, n["node"]), F.lit(False)), 0).otherwise(1)
    keyed = _let(
        _let(_fed_by(ns, es), place),
        lambda at: F.transform(ns, lambda n, i: F.struct(late(n).alias("late"), F.element_at(at, i + 1).alias("key"), n["node"].alias("node_id"))),
    )
    ordered = F.array_sort(F.filter(keyed, lambda k: F.size(k["key"]) > 0))
    return F.transform(ordered, lambda k, i: F.struct(k["node_id"].alias("node_id"), i.cast("bigint").alias("pos")))


def execution_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``pos`` of each node: topological, ties by document index, input blocks first.

    Flows must be acyclic (see :func:`validate_flow`); nodes in or behind a cycle have no place.
    """
    steps = nodes.select(
        *KEYS, F.col("node_id").alias("node"), F.col("doc_index").cast("bigint").alias("idx"), F.coalesce("type", F.lit("")).alias("type")
    )
    ends = edges.select(*KEYS, F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
    small, left = _split(steps, ends, _order_within)
    small = cut_lineage(small)
    if left.isEmpty():
        return small
    return small.unionByName(_order_in_rounds(_of(nodes, left), _of(edges, left)))


def _order_in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    keys = order_keys(nodes, edges).withColumnRenamed("node", "node_id")
    inputs = is_input_block(nodes, edges).withColumn("_late", F.lit(0))
    placed = keys.join(inputs, [*KEYS, "node_id"], "left").withColumn("_late", F.coalesce("_late", F.lit(1)))
    ranked = rank_per_key(placed, KEYS, ["_late", "key"], "pos")
    return cut_lineage(ranked.select(*KEYS, "node_id", (F.col("pos") - 1).alias("pos")))


def ancestors(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """(keys, root, node_id): everything upstream of each selected node (keys, node_id)."""
    roots = selected.select(*KEYS, F.col("node_id").alias("node")).distinct()
    ends = edges.select(*KEYS, F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
    small, left = _split(roots, ends, _ancestors_within)
    if left.isEmpty():
        return small
    return small.unionByName(_ancestors_in_rounds(_of(edges, left), _of(selected, left)))


def _ancestors_within(ns: Column, es: Column) -> Column:
    def sources(near: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(es, lambda e: near(e["dst"])), lambda e: e["src"])

    def up(root: Column) -> Column:
        first = F.array_distinct(sources(lambda dst: dst == root))
        found = _times(F.size(es), first, lambda seen: F.array_union(seen, sources(lambda dst: F.array_contains(seen, dst))))
        return F.transform(found, lambda name: F.struct(root.alias("root"), name.alias("node_id")))

    return F.flatten(F.transform(ns, lambda n: up(n["node"])))


def _ancestors_in_rounds(edges: DataFrame, selected: DataFrame) -> DataFrame:
    back = edges.select(*KEYS, F.col("to_node").alias("src"), F.col("from_node").alias("dst")).distinct()
    start = selected.select(*KEYS, F.col("node_id").alias("root"), F.col("node_id").alias("node"))
    # The first hop is taken by hand, so a node counts as its own ancestor only on a cycle.
    first = start.join(back.withColumnRenamed("src", "node"), [*KEYS, "node"]).select(*KEYS, "root", F.col("dst").alias("node"))
    return reachable(back, first, KEYS).withColumnRenamed("node", "node_id")


def definitions(nodes: DataFrame) -> DataFrame:
    """(keys, node_id, doc_index, name): names a step sets, by extraction or as a block."""
    extracted = F.when(F.col("type") == "request", F.transform("extract", lambda e: e["name"]))
    declared = F.when(F.col("type") == "variables", F.transform("variables", lambda v: strip(v["name"])))
    names = F.filter(F.coalesce(extracted, declared, F.array().cast("array<string>")), lambda n: n != "")
    return nodes.select(*KEYS, "node_id", "doc_index", F.explode(names).alias("name"))


def upstream_variables(nodes: DataFrame, edges: DataFrame, selected: DataFrame) -> DataFrame:
    """(keys, root, name): names a node can rely on — set by its ancestors or an input block."""
    up = ancestors(edges, selected)
    inputs = is_input_block(nodes, edges)
    start = selected.select(*KEYS, F.col("node_id").alias("root"))
    by_input = start.join(inputs, KEYS).filter("root <> node_id")
    return up.unionByName(by_input).join(definitions(nodes), [*KEYS, "node_id"]).select(*KEYS, "root", "name").distinct()


def flow_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(keys, node, component): undirected connected components."""
    steps = nodes.select(*KEYS, F.col("node_id").alias("node"))
    ends = edges.select(*KEYS, F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
    small, left = _split(steps, ends, _components_within)
    if left.isEmpty():
        return small
    return small.unionByName(components(flow_edges_of(_of(edges, left)), _of(steps, left), KEYS))


def _components_within(ns: Column, es: Column) -> Column:
    """Every edge gives the greater label of its two ends' the lesser one, wherever it stands."""

    def join(names: Column, labels: Column, e: Column) -> Column:
        a, b = (F.array_position(names, e[end]).cast("int") for end in ("src", "dst"))
        ends = _let(F.struct(a.alias("a"), b.alias("b")), lambda at: F.when((at["a"] > 0) & (at["b"] > 0), F.array(F.element_at(labels, at["a"]), F.element_at(labels, at["b"]))))
        return _let(
            F.array_sort(ends),
            lambda two: F.when(two[0] < two[1], F.transform(labels, lambda x: F.when(x == two[1], two[0]).otherwise(x))).otherwise(labels),
        )

    def label(names: Column) -> Column:
        return F.aggregate(es, names, lambda labels, e: join(names, labels, e))

    names = F.transform(ns, lambda n: n["node"])
    return _let(_let(names, label), lambda at: F.transform(ns, lambda n, i: F.struct(n["node"].alias("node"), F.element_at(at, i + 1).alias("component"))))


def run_scope(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Nodes a run covers. ``asked`` has keys, ``scope`` (all, connected, step), ``selected``.

    A narrowed run always includes the input blocks; an unknown selection means everything.
    """
    parts = flow_components(nodes, edges)
    # Every node is in a component, so one join tells which selections are known and where they are.
    wanted = cut_lineage(asked.join(parts.withColumnRenamed("node", "selected"), [*KEYS, "selected"], "left"))
    whole = (F.col("scope") == "all") | F.col("selected").isNull() | F.col("component").isNull()
    every = wanted.filter(whole).select(*KEYS).join(parts.select(*KEYS, F.col("node").alias("node_id")), KEYS)
    narrow = wanted.filter(~whole)
    mine = narrow.filter("scope = 'connected'")
    linked = mine.select(*KEYS, "component").join(parts, [*KEYS, "component"]).select(*KEYS, F.col("node").alias("node_id"))
    single = narrow.filter("scope = 'step'").select(*KEYS, F.col("selected").alias("node_id"))
    inputs = narrow.select(*KEYS).join(is_input_block(nodes, edges), KEYS)
    return every.unionByName(linked).unionByName(single).unionByName(inputs).distinct()


def templates_of(nodes: DataFrame) -> DataFrame:
    """(keys, node_id, name, slot): every name a step refers to.

    ``slot`` numbers the texts of a step; for a variables block it is the entry's place, whose
    own earlier entries count as defined.
    """
    texts = (
        F.when(
            F.col("type") == "request",
            F.concat(
                F.transform(
                    F.array_distinct(F.flatten(F.transform("texts", references))),
                    lambda r: F.concat(F.lit("{{"), r, F.lit("}}")),
                ),
                F.transform("assert", lambda a: F.coalesce(a["expected"], F.lit(""))),
            ),
        )
        .when(F.col("type") == "condition", F.array(F.coalesce("left", F.lit("")), F.coalesce("right", F.lit(""))))
        .when(F.col("type") == "variables", F.transform("variables", lambda v: F.coalesce(v["value"], F.lit(""))))
        .otherwise(F.array(F.coalesce("text", F.lit(""))))
    )
    slots = nodes.select(*KEYS, "node_id", "doc_index", "type", F.posexplode(texts).alias("slot", "text"))
    return slots.select(*KEYS, "node_id", "doc_index", "type", "slot", F.explode(references(F.col("text"))).alias("name"))


def lint_flows(nodes: DataFrame, edges: DataFrame, variables: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """Warnings per step: undefined names, names set only later, requests without assertions,
    and references to endpoints the inventory lacks.

    ``nodes`` carries ``texts`` (the request's texts in order: url, path values, enabled rows,
    credentials, body); ``variables`` has project_id, name.
    """
    order = execution_order(nodes, edges)
    defined = definitions(nodes)
    used = templates_of(nodes).join(order, [*KEYS, "node_id"])
    outside = variables.select(P, F.col("name")).distinct().withColumn("_outside", F.lit(True))
    earliest = (
        defined.join(order, [*KEYS, "node_id"]).groupBy(*KEYS, "name").agg(F.min("pos").alias("_from"), F.min_by("node_id", "doc_index").alias("_definer"))
    )
    own = (
        nodes.filter("type = 'variables'")
        .select(*KEYS, "node_id", F.posexplode("variables").alias("_at", "v"))
        .groupBy(*KEYS, "node_id", strip(F.col("v.name")).alias("name"))
        .agg(F.min("_at").alias("_own_from"))
    )
    judged = (
        used.withColumn("look", canonical_name(F.col("name")))
        .join(outside.withColumnRenamed("name", "look"), [P, "look"], "left")
        .join(earliest, [*KEYS, "name"], "left")
        .join(own, [*KEYS, "node_id", "name"], "left")
    )
    in_scope = F.col("_outside") | (
        ~F.col("name").startswith("secret:")
        & (F.coalesce(F.col("_from") < F.col("pos"), F.lit(False)) | F.coalesce(F.col("_own_from") < F.col("slot"), F.lit(False)))
    )
    missing = judged.filter(~F.coalesce(in_scope, F.lit(False)))
    later = F.coalesce(F.col("_definer") != F.col("node_id"), F.lit(False))
    shown = F.concat(F.lit("{{"), F.col("name"), F.lit("}}"))
    undefined = missing.select(
        *KEYS,
        "node_id",
        F.when(later, "set_later").otherwise("undefined").alias("rule"),
        F.col("name").alias("subject"),
        F.when(
            later,
            F.concat(shown, F.lit(" comes too late; missing edge: "), F.col("_definer"), F.lit(" -> "), F.col("node_id")),
        )
        .otherwise(F.concat(shown, F.lit(" has no value here")))
        .alias("message"),
    )
    requests = nodes.filter("type = 'request'")
    bare = requests.filter(F.size(F.coalesce("assert", F.array().cast(dict(nodes.dtypes)["assert"]))) == 0).select(
        *KEYS, "node_id", F.lit("no_assertions").alias("rule"), F.lit(None).cast("string").alias("subject"),
        F.lit("nothing is asserted about the answer").alias("message"),
    )
    out = undefined.unionByName(bare)
    if endpoints is not None:
        out = out.unionByName(stale_references(requests, endpoints))
    # Only flows that can be ordered are linted.
    return out.join(order, [*KEYS, "node_id"], "left_semi")


def stale_references(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Steps naming an endpoint the inventory of their project lacks; projects without an
    inventory are left alone."""
    scanned = endpoints.select(P).distinct()
    named = requests.filter("spec_ref is not null").join(scanned, P, "left_semi")
    return named.join(endpoints.select(P, F.col("id").alias("spec_ref")).distinct(), [P, "spec_ref"], "left_anti").select(
        *KEYS, "node_id", F.lit("stale_spec_ref").alias("rule"), F.col("spec_ref").alias("subject"),
        F.concat(F.lit("not in the inventory: "), F.col("spec_ref")).alias("message"),
    )


def edge_state(edges: DataFrame, results: DataFrame, run_keys: list[str]) -> DataFrame:
    """idle, taken, dead or inactive for each edge of each run.

    ``edges`` already carries the run keys; ``results`` has run keys, node_id, status,
    reason_kind, branch.
    """
    source = results.select(*run_keys, F.col("node_id").alias("from_node"), "status", "reason_kind", "branch")
    joined = edges.join(source, [*run_keys, "from_node"], "left")
    other_way = F.col("branch").isNotNull() & F.col("handle").isNotNull() & (F.col("branch") != F.col("handle"))
    state = (
        F.when(F.col("status").isNull() | F.col("status").isin("pending", "running"), "idle")
        .when(F.col("status") == "failed", "dead")
        .when(F.col("status") == "skipped", F.when(F.col("reason_kind") == "upstream_failed", "dead").otherwise("inactive"))
        .when(other_way, "inactive")
        .otherwise("taken")
    )
    return joined.select(*edges.columns, state.alias("state"))

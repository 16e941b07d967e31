"""Graph operators as frontier joins.

A graph is two DataFrames: nodes ``(symbol_id, …)`` and edges ``(source, target,
kind, confidence, provenance)``.  Traversals advance all frontiers by one join a
level and drop visited nodes by an anti-join; each level is written, so the plan
of a level does not contain the ones before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.columns import CALL, IMPACT, PATH, edge_weight, is_test_path
from weftgraph.sources.tables import cut


def kinds_filter(edges: DataFrame, kinds: tuple[str, ...] | None, default: tuple[str, ...]) -> DataFrame:
    """None is the default set, none or ``*`` alone is every kind; ``*`` among others is an error."""
    if kinds is None:
        kinds = default
    if "*" in kinds and len(kinds) > 1:
        raise ValueError("'*' stands alone")
    return edges if not kinds or "*" in kinds else edges.where(F.col("kind").isin(*kinds))


def snapshot_edges(edges: DataFrame, nodes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Edges of at least ``threshold`` confidence whose ends are both known; null targets dangle."""
    known = nodes.select("symbol_id")
    both = edges.where(F.col("confidence") >= threshold).join(known, F.col("source") == F.col("symbol_id"), "left_semi")
    return both.join(known, F.col("target") == F.col("symbol_id"), "left_semi")


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """``source, target`` pairs to walk: outgoing, incoming or both; distinct, without null ends."""
    out = edges.select("source", "target")
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    pairs = {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]
    return pairs.dropna().distinct()


def one_hop(edges: DataFrame, seeds: DataFrame, direction: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Distinct ``seed, node`` pairs of callers (incoming) or callees (outgoing)."""
    pairs = directed(kinds_filter(edges, kinds, CALL), direction)
    return seeds.select(F.col("symbol_id").alias("source")).join(pairs, "source").select(F.col("source").alias("seed"), F.col("target").alias("node")).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, direction: str = "outgoing", kinds: tuple[str, ...] | None = None, default: tuple[str, ...] = CALL, include_start: bool = True, limit: int | None = None) -> DataFrame:
    """``seed, node, depth``: least depth of every node within ``max_depth`` of each seed.

    Every seed walks on its own; a seed is in its result at depth 0 unless
    ``include_start`` is false, then only a cycle brings it back.  ``limit`` keeps
    the first nodes of a seed by (depth, node).
    """
    pairs = cut(directed(kinds_filter(edges, kinds, default), direction), "pairs")
    start = seeds.select(F.col("symbol_id").alias("seed"), F.col("symbol_id").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = start = cut(start, "level")
    levels = [start] if include_start else []
    for depth in range(1, max_depth + 1):
        reached = frontier.join(pairs, frontier.node == pairs.source).select("seed", F.col("target").alias("node"), F.lit(depth).alias("depth")).distinct()
        for level in levels:
            reached = reached.join(level.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = cut(reached, "level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = reduce(DataFrame.unionByName, levels) if levels else start.limit(0)
    if limit is not None:
        order = Window.partitionBy("seed").orderBy("depth", "node")
        out = out.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n")
    return out


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int, direction: str = "outgoing", kinds: tuple[str, ...] | None = None, children: DataFrame | None = None, limit: int | None = 1000) -> DataFrame:
    """BFS over the impact kinds; ``children (container, symbol_id)`` adds the members of the seeds as seeds at depth 0.

    Members keep their container as ``seed``.
    """
    if children is None:
        return bfs(edges, seeds, max_depth, direction, kinds, IMPACT, True, limit)
    mine = seeds.select(F.col("symbol_id").alias("seed")).join(children, F.col("seed") == F.col("container")).select("seed", "symbol_id")
    starts = cut(mine.unionByName(seeds.select(F.col("symbol_id").alias("seed"), "symbol_id")).distinct(), "seeds")
    walked = bfs(edges, starts.select("symbol_id"), max_depth, direction, kinds, IMPACT, True, None)
    joined = starts.join(walked.withColumnRenamed("seed", "symbol_id"), "symbol_id")
    out = joined.groupBy("seed", "node").agg(F.min("depth").alias("depth"))
    return out if limit is None else out.withColumn("__n", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))).where(F.col("__n") <= limit).drop("__n")


def forward_frontier(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """Reached nodes without outgoing edges or at the depth bound."""
    walked = cut(bfs(edges, seeds, max_depth), "walked")
    ends = walked.join(kinds_filter(edges, None, CALL).select(F.col("source").alias("node")).distinct(), "node", "left_anti")
    return ends.unionByName(walked.where(F.col("depth") == max_depth).select(*ends.columns)).distinct().select("seed", "node", "depth")


def weighted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the ``weight`` of their hop, its destination being ``nodes (symbol_id, path, qualified_name)``."""
    to = nodes.select(F.col("symbol_id").alias("target"), "path", "qualified_name")
    joined = edges.join(to, "target", "left")
    return joined.select(*edges.columns, edge_weight(F.col("kind"), F.col("confidence"), F.col("provenance"), F.coalesce("path", F.lit("")), F.coalesce("qualified_name", F.lit(""))).alias("weight"))


def shortest_costs(edges: DataFrame, seeds: DataFrame, max_depth: int, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``seed, node, cost, hops``: least cost over walks of at most ``max_depth`` hops of ``weighted`` edges.

    Relaxation by depth: exact for the hop bound.  ``hops`` is the fewest hops of
    that cost; costs are compared at nine decimals.
    """
    hops = kinds_filter(edges, kinds, PATH).groupBy("source", "target").agg(F.min("weight").alias("weight"))
    hops = cut(hops, "hops")
    best = cut(seeds.select(F.col("symbol_id").alias("seed"), F.col("symbol_id").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops")).distinct(), "costs")
    frontier = best
    for depth in range(1, max_depth + 1):
        step = frontier.join(hops, frontier.node == hops.source).groupBy("seed", F.col("target").alias("node")).agg(F.min(F.round(F.col("cost") + F.col("weight"), 9)).alias("cost"))
        better = step.join(best.select("seed", "node", F.col("cost").alias("known")), ["seed", "node"], "left").where("known IS NULL OR cost < known")
        frontier = cut(better.select("seed", "node", "cost", F.lit(depth).alias("hops")), "relaxed")
        if frontier.isEmpty():
            break
        best = cut(best.join(frontier.select("seed", "node"), ["seed", "node"], "left_anti").unionByName(frontier), "costs")
    return best


def _remaining(steps: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """``target_id, node, hops, least``: the least cost from a node to each target within so many hops, for every number of hops where it falls."""
    best = cut(pairs.select("target_id", F.col("target_id").alias("node"), F.lit(0).alias("hops"), F.lit(0.0).alias("least")).distinct(), "bounds")
    hops = cut(steps.groupBy("s", "t").agg(F.min("hop.weight").alias("w")), "bounds")
    parts, frontier, known = [best], best, best.select("target_id", "node", "least")
    for depth in range(1, max_depth):
        grown = frontier.join(hops, frontier.node == hops.t).groupBy("target_id", F.col("s").alias("node")).agg(F.min(F.col("least") + F.col("w")).alias("least"))
        better = grown.join(known.withColumnRenamed("least", "__old"), ["target_id", "node"], "left").where("__old IS NULL OR least < __old")
        frontier = cut(better.select("target_id", "node", F.lit(depth).alias("hops"), "least"), "bounds")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        known = cut(known.unionByName(frontier.select(*known.columns)).groupBy("target_id", "node").agg(F.min("least").alias("least")), "bounds")
    return cut(reduce(DataFrame.unionByName, parts), "bounds")


def simple_paths(edges: DataFrame, pairs: DataFrame, max_depth: int, kinds: tuple[str, ...] | None = None, k: int | None = None, width: int = 64) -> DataFrame:
    """Cycle-free paths of at most ``max_depth`` hops between ``pairs (source_id, target_id)``: all, or with ``k`` those that may be among the ``k`` cheapest of their pair.

    ``nodes``, ``hops`` (struct kind, confidence, provenance, weight) and ``cost`` of each path.  A path
    grows only where the target is within the hops that are left.  With ``k``, a first pass that keeps the
    ``width`` cheapest open paths of a pair at each depth finds some ``k`` paths; the second one leaves open
    paths whose cost and least remaining cost exceed the worst of those, which none of the ``k`` cheapest does.
    """
    hop = F.struct("kind", "confidence", "provenance", "weight")
    steps = cut(kinds_filter(edges, kinds, PATH).select(F.col("source").alias("s"), F.col("target").alias("t"), hop.alias("hop")), "steps")
    bounds = _remaining(steps, pairs, max_depth)
    hops_type = f"array<{steps.schema['hop'].dataType.simpleString()}>"
    start = pairs.select("source_id", "target_id", F.array("source_id").alias("nodes"), F.array().cast(hops_type).alias("hops"), F.lit(0.0).alias("cost")).distinct()
    key = ["source_id", "target_id"]

    def walk(worst: DataFrame | None, most: int | None) -> DataFrame:
        done, now = [start.where("source_id = target_id")], start.where("source_id <> target_id")
        for depth in range(1, max_depth + 1):
            grown = now.join(steps, F.element_at("nodes", -1) == F.col("s")).where(~F.array_contains("nodes", F.col("t")))
            left = bounds.where(F.col("hops") <= max_depth - depth).groupBy("target_id", F.col("node").alias("t")).agg(F.min("least").alias("least"))
            grown = grown.join(left, ["target_id", "t"]).withColumn("cost", F.col("cost") + F.col("hop.weight"))
            if worst is not None:
                grown = grown.join(worst, key, "left").where(F.col("__worst").isNull() | (F.col("cost") + F.col("least") <= F.col("__worst") + 1e-9))
            grown = grown.select(*key, F.array_append("nodes", F.col("t")).alias("nodes"), F.array_append("hops", F.col("hop")).alias("hops"), "cost", "least")
            if most is not None:
                order = Window.partitionBy(*key).orderBy(F.col("cost") + F.col("least"), "nodes", "hops")
                grown = grown.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")
            grown = cut(grown.drop("least"), "paths")
            if grown.isEmpty():
                break
            done.append(grown.where(F.element_at("nodes", -1) == F.col("target_id")))
            now = grown.where(F.element_at("nodes", -1) != F.col("target_id"))
        return reduce(DataFrame.unionByName, done)

    if k is None:
        return walk(None, None)
    some = walk(None, max(width, 2 * k)).withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("cost")))
    return walk(cut(some.where(F.col("__n") == k).select(*key, F.col("cost").alias("__worst")), "paths"), None)


def production_edges(edges: DataFrame, nodes: DataFrame, penalty: float = 5.0) -> DataFrame:
    """``weighted`` edges whose weight grows by ``penalty`` where they enter a test node, so paths prefer production code."""
    tests = nodes.where(is_test_path(F.col("path"))).select(F.col("symbol_id").alias("target"), F.lit(penalty).alias("__more"))
    dearer = edges.join(tests, "target", "left")
    return dearer.select(*[(F.col("weight") + F.coalesce("__more", F.lit(0.0))).alias("weight") if c == "weight" else F.col(c) for c in edges.columns])


def without_edges(edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """Edges but for those of ``excluded (source, target[, kind])``."""
    return edges.join(excluded.distinct(), [c for c in ("source", "target", "kind") if c in excluded.columns], "left_anti")


def path_scores(paths: DataFrame, degrees: DataFrame, penalties: DataFrame) -> DataFrame:
    """Scores of paths: ``semantic``, ``topology``, ``centrality``, ``overall``.

    ``degrees (node, degree)`` and ``penalties (node, penalty)`` describe nodes; a
    node without a row has degree 0 and no penalty.
    """
    keyed = paths.withColumn("__p", F.monotonically_increasing_id())
    keyed = cut(keyed, "scored")
    each = keyed.select("__p", F.size("nodes").alias("n"), F.posexplode("nodes").alias("i", "node"))
    each = each.join(degrees, "node", "left").join(penalties, "node", "left")
    inner = (F.col("i") > 0) & (F.col("i") < F.col("n") - 1)
    nodes = each.groupBy("__p").agg(
        F.avg(1 - F.least(F.lit(1.0), F.coalesce("penalty", F.lit(0.0)))).alias("semantic"),
        F.avg(F.when(inner, F.greatest(F.lit(0.1), F.least(F.coalesce("degree", F.lit(0)), F.lit(10)) / 10))).alias("inner"),
    )
    indirect = lambda h: h["kind"].isin("implements", "instantiates", "registers_callback")
    total = F.aggregate("hops", F.lit(0.0), lambda a, h: a + h["confidence"].cast("double") * F.when(indirect(h), 0.7).otherwise(1.0))
    joined = keyed.join(nodes, "__p").withColumn("topology", F.when(F.size("hops") == 0, 1.0).otherwise(total / F.size("hops")))
    joined = joined.withColumn("semantic", F.when(F.size("nodes") == 1, 1.0).otherwise(F.col("semantic")))
    joined = joined.withColumn("centrality", F.when(F.size("nodes") == 1, 1.0).when(F.size("nodes") == 2, 0.7).otherwise(F.col("inner")))
    return joined.withColumn("overall", 0.40 * F.col("semantic") + 0.35 * F.col("topology") + 0.25 * F.col("centrality")).drop("__p", "inner")


def ranked_paths(edges: DataFrame, pairs: DataFrame, max_depth: int, k: int, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The ``k`` cheapest cycle-free paths of each pair: ``rank`` by cost, hops, nodes."""
    paths = simple_paths(edges, pairs, max_depth, kinds, k)
    cost = F.round("cost", 9)
    order = Window.partitionBy("source_id", "target_id").orderBy("cost", F.size("nodes"), "nodes", "hops")
    return paths.withColumn("cost", cost).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def breakpoints(kind: Column, conf: Column, reversed_: Column, to_test: Column) -> Column:
    """Why a hop may not hold, as an array of codes."""
    return F.array_compact(
        F.array(
            F.when(conf < 0.5, "low_confidence"),
            F.when(kind == "registers_callback", "registers_callback"),
            F.when(reversed_, "reversed"),
            F.when(kind.isin("instantiates", "implements"), "indirect_call"),
            F.when(to_test, "test_contamination"),
        )
    )


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree``; a self loop counts twice."""
    ends = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node")))
    return ends.dropna().groupBy("node").agg(F.count("*").alias("degree"))


def relation_counts(edges: DataFrame) -> DataFrame:
    """``node, kind, outgoing, incoming``."""
    out = edges.groupBy(F.col("source").alias("node"), "kind").agg(F.count("*").alias("outgoing"), F.lit(0).cast("long").alias("incoming"))
    back = edges.groupBy(F.col("target").alias("node"), "kind").agg(F.lit(0).cast("long").alias("outgoing"), F.count("*").alias("incoming"))
    return out.unionByName(back).groupBy("node", "kind").agg(F.sum("outgoing").alias("outgoing"), F.sum("incoming").alias("incoming"))


def without_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot without the nodes of ``files (file_id)`` and the edges at them."""
    rest = nodes.join(files, "file_id", "left_anti")
    gone = nodes.join(files, "file_id", "left_semi").select("symbol_id")
    left = edges.join(gone, F.col("source") == F.col("symbol_id"), "left_anti").join(gone, F.col("target") == F.col("symbol_id"), "left_anti")
    return rest, left


def derive_edges(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from resolved references, by reference and target kind, and containment of each target with a known container.

    ``references (reference_id, source_symbol, kind, target, confidence, provenance)``,
    ``symbols (symbol_id, kind, container_id)``.  References with an unknown end give none.
    """
    ends = symbols.select(F.col("symbol_id").alias("target"), F.col("kind").alias("target_kind"), "container_id")
    known = references.join(ends, "target").join(symbols.select(F.col("symbol_id").alias("source_symbol")), "source_symbol", "left_semi")
    call = F.col("kind").isin("call", "instantiation")
    kind = (
        F.when(call & F.col("target_kind").isin("class", "struct"), "instantiates")
        .when(call & F.col("target_kind").isin("interface", "trait"), "implements")
        .when(call & F.col("target_kind").isin("function", "method", "constructor"), "calls")
        .when(call, F.lit(None))
        .when(F.col("kind") == "inheritance", "extends")
        .when(F.col("kind") == "implementation", "implements")
        .otherwise("references")
    )
    main = known.select(F.col("source_symbol").alias("source"), "target", kind.alias("kind"), "confidence", "provenance", "reference_id").where("kind IS NOT NULL")
    holds = known.join(symbols.select(F.col("symbol_id").alias("container_id")), "container_id", "left_semi")
    return main.unionByName(holds.select(F.col("container_id").alias("source"), "target", F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"), "provenance", "reference_id"))


def edge_policy(existing: DataFrame, incoming: DataFrame, max_fan_out: int = 20) -> DataFrame:
    """Decision for each incoming edge: canonical, candidate, keep or replace.

    ``(source, target, kind, confidence, band, coverage)`` on both sides; an
    incoming (source, kind) with over ``max_fan_out`` targets gives candidates only.
    """
    rank = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in (("repo", 5), ("closure", 4), ("boundary", 3), ("partial", 2), ("manifest", 1)) for x in p]), c), F.lit(0))
    keys = ["source", "target", "kind"]
    old = existing.select(*keys, F.col("confidence").alias("old_confidence"), F.col("band").alias("old_band"), rank(F.col("coverage")).alias("old_rank"))
    fan = incoming.groupBy("source", "kind").agg(F.countDistinct("target").alias("fan_out"))
    joined = incoming.join(fan, ["source", "kind"]).join(old, keys, "left")
    new_rank = rank(F.col("coverage"))
    decision = (
        F.when(F.col("fan_out") > max_fan_out, "candidate")
        .when(F.col("old_rank").isNull(), F.when(F.col("band").isin("certain", "high"), "canonical").otherwise("candidate"))
        .when(F.col("old_band") == "certain", "keep")
        .when(new_rank > F.col("old_rank"), "replace")
        .when((new_rank == F.col("old_rank")) & (F.col("confidence") > F.col("old_confidence")), "replace")
        .otherwise("keep")
    )
    return joined.select(*incoming.columns, decision.alias("decision"))


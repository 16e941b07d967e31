"""Dataflow traces: summaries, slices, caller chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.columns import PATH, is_test_path
from weftgraph.operators.graph import kinds_filter
from weftgraph.sources.tables import cut


def parameter_summaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``parameter, sink, sink_kind, confidence``: return, call-argument and field nodes that each parameter reaches in its function.

    ``nodes (node_id, function_id, kind)``, ``edges (source, target)``; confidence
    is .85 if a parameter has more than one sink, else 1.
    """
    inside = edges.join(nodes.select(F.col("node_id").alias("source"), F.col("function_id").alias("f")), "source").join(nodes.select(F.col("node_id").alias("target"), F.col("function_id").alias("g"), "kind"), "target").where("f = g")
    inside = cut(inside.select(F.col("source").alias("s"), "target", "kind").distinct(), "flow")
    seen = frontier = cut(nodes.where("kind = 'parameter'").select(F.col("node_id").alias("parameter"), F.col("node_id").alias("at"), F.lit("parameter").alias("kind")), "reach")
    parts = [seen]
    while True:
        step = frontier.select("parameter", "at").join(inside, F.col("at") == F.col("s")).select("parameter", F.col("target").alias("at"), "kind").distinct()
        for part in parts:
            step = step.join(part.select("parameter", "at"), ["parameter", "at"], "left_anti")
        frontier = cut(step, "reach")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    sinks = reduce(DataFrame.unionByName, parts).where(F.col("kind").isin("return", "call_return", "call_arg", "field"))
    n = sinks.groupBy("parameter").agg(F.count("*").alias("n"))
    return sinks.join(n, "parameter").select("parameter", F.col("at").alias("sink"), F.col("kind").alias("sink_kind"), F.when(F.col("n") > 1, 0.85).otherwise(1.0).alias("confidence"))


def backward_slices(sinks: DataFrame, edges: DataFrame, max_steps: int = 100) -> DataFrame:
    """``sink, step, node``: the best incoming edge followed back from each sink until none, a cycle or the bound.

    ``sinks (sink)``, ``edges (source, target, priority)``: greatest priority, then greatest source.
    """
    best = edges.groupBy("target").agg(F.max_by("source", F.struct("priority", "source")).alias("source"))
    best = cut(best, "best")
    frontier = cut(sinks.select("sink", F.col("sink").alias("node"), F.lit(0).alias("step"), F.array("sink").alias("seen")).distinct(), "slice")
    parts = [frontier.select("sink", "step", "node")]
    for step in range(1, max_steps + 1):
        grown = frontier.join(best, frontier.node == best.target).where(~F.array_contains("seen", F.col("source")))
        frontier = cut(grown.select("sink", F.col("source").alias("node"), F.lit(step).alias("step"), F.array_append("seen", F.col("source")).alias("seen")), "slice")
        if frontier.isEmpty():
            break
        parts.append(frontier.select("sink", "step", "node"))
    return reduce(DataFrame.unionByName, parts)


def context_slices(sinks: DataFrame, edges: DataFrame, max_steps: int = 20, max_stack: int = 8) -> DataFrame:
    """All ``sink, node, step`` reachable backward with matched calls.

    ``edges (source, target, kind, call_id)``: going back over return_to_call or
    writeback pushes the call, arg_to_param pops it only if it is on top (or the
    stack is empty), state_flow clears the stack.  State is (node, stack); stacks
    deeper than ``max_stack`` keep their top.
    """
    step_edges = edges.select(F.col("source").alias("s"), F.col("target").alias("t"), "kind", "call_id")
    empty = F.array().cast("array<string>")
    frontier = cut(sinks.select("sink", F.col("sink").alias("node"), F.lit(0).alias("step"), empty.alias("stack")).distinct(), "ctx")
    parts = [frontier]
    for step in range(1, max_steps + 1):
        joined = frontier.join(step_edges, F.col("node") == F.col("t"))
        top = F.try_element_at("stack", F.lit(-1))
        call = F.col("call_id").cast("string")
        joined = joined.where((F.col("kind") != "arg_to_param") | (F.size("stack") == 0) | (top == call))
        pushed = F.concat("stack", F.array(call))
        stack = (
            F.when(F.col("kind").isin("return_to_call", "writeback"), F.slice(pushed, F.greatest(F.lit(1), F.size(pushed) - max_stack + 1), max_stack))
            .when((F.col("kind") == "arg_to_param") & (F.size("stack") > 0), F.slice("stack", 1, F.size("stack") - 1))
            .when(F.col("kind") == "state_flow", empty)
            .otherwise(F.col("stack"))
        )
        grown = joined.select("sink", F.col("s").alias("node"), F.lit(step).alias("step"), stack.alias("stack")).distinct()
        for part in parts:
            grown = grown.join(part.select("sink", "node", "stack"), ["sink", "node", "stack"], "left_anti")
        frontier = cut(grown, "ctx")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    return reduce(DataFrame.unionByName, parts).groupBy("sink", "node").agg(F.min("step").alias("step"))


def caller_chains(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """``seed, chain, depth, score``: the best chain of callers up to a root of each seed.

    A chain ends at a caller without callers of its own or at the depth bound;
    non-test roots score 100 more, deeper ones 1 a hop; ties go to the least chain.
    """
    up = cut(kinds_filter(edges, None, PATH).select(F.col("target").alias("t"), F.col("source").alias("s")).dropna().distinct(), "callers")
    now = cut(seeds.select(F.col("symbol_id").alias("seed"), F.array("symbol_id").alias("chain")).distinct(), "chains")
    ends = []
    for depth in range(max_depth + 1):
        last = F.element_at("chain", -1)
        grown = now.join(up, last == F.col("t"), "left")
        stop = F.col("s").isNull() | F.array_contains("chain", F.col("s"))
        ends.append(now.select("seed", "chain") if depth == max_depth else grown.where(F.col("s").isNull()).select("seed", "chain"))
        if depth < max_depth:
            now = cut(grown.where(~stop).select("seed", F.array_append("chain", F.col("s")).alias("chain")), "chains")
            if now.isEmpty():
                break
    chains = reduce(DataFrame.unionByName, ends).distinct()
    root = nodes.select(F.col("symbol_id").alias("root"), is_test_path(F.col("path")).alias("test"))
    scored = chains.withColumn("root", F.element_at("chain", -1)).join(root, "root", "left").withColumn("depth", F.size("chain") - 1)
    scored = scored.withColumn("score", F.when(F.coalesce("test", F.lit(False)), 0).otherwise(100) + F.col("depth"))
    order = Window.partitionBy("seed").orderBy(F.desc("score"), "chain")
    return scored.withColumn("n", F.row_number().over(order)).where("n = 1").select("seed", "chain", "depth", "score")

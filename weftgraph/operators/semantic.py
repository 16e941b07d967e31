"""Per-function analyses: lifecycle lattice, branch differences, aliases, scope exits, contracts, rules."""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import rule_matches
from weftgraph.operators.joins import carry_forward
from weftgraph.sources.tables import cut

#: State after each effect; other effects leave it.
AFTER = {"free": "Freed", "alloc": "Assigned", "store": "Assigned", "assign": "Assigned", "nullify": "Nullified", "escape": "Escaped"}
#: Functions that allocate, free, or may keep what they get.
ALLOCATORS = ("malloc", "calloc", "strdup", "strndup", "fopen", "kmalloc", "kzalloc", "kcalloc", "kmalloc_array", "kvcalloc", "vmalloc", "vzalloc", "kzalloc_obj", "operator new", "operator new[]")
DEALLOCATORS = ("free", "kfree", "kvfree", "vfree", "operator delete", "operator delete[]", "std::free")
MAYBE_OWNERS = ("realloc",)


def state_after(effect: Column) -> Column:
    return reduce(lambda rest, e: F.when(effect == e[0], e[1]).otherwise(rest), AFTER.items(), F.lit(None).cast("string"))


def merge(a: str, b: str) -> str:
    """Join of two lattice states."""
    if a == "Bottom" or a == b:
        return b
    if b == "Bottom":
        return a
    if "Top" in (a, b):
        return "Top"
    pair = {a, b}
    if "Freed" in pair or "MaybeFreed" in pair:
        return "MaybeFreed"
    if pair == {"Assigned", "Unknown"} or "MaybeAssigned" in pair:
        return "MaybeAssigned"
    return "Unknown"


def flag(before: str, after: str) -> str | None:
    if before in ("Freed", "MaybeFreed"):
        if after == "Freed":
            return "double_free"
        if after in ("Assigned", "Nullified", "Escaped"):
            return "use_after_free"
    return None


def straight_lifecycle(effects: DataFrame) -> DataFrame:
    """``effects (function_id, effect_id, effect, ord)`` with the state ``before`` and ``after`` each and its ``flag``.

    For straight-line code the state before an effect is set by the last changing
    effect, so a carry-forward gives the whole fold, however long a function is.
    """
    changed = effects.select("function_id", "effect_id", "effect", "ord", state_after(F.col("effect")).alias("own"))
    rows = carry_forward(changed, ["function_id"], ["ord", "effect_id"], "own", "before", inclusive=False)
    rows = rows.withColumn("before", F.coalesce("before", F.lit("Unknown"))).withColumn("after", F.coalesce("own", "before"))
    freed = F.col("before") == "Freed"
    what = F.when(freed & (F.col("own") == "Freed"), "double_free").when(freed & F.col("own").isin("Assigned", "Nullified", "Escaped"), "use_after_free")
    return rows.select("function_id", "effect_id", "effect", "before", "after", what.alias("flag"))


def verdict(final: Column, flags: Column) -> Column:
    """``suspicious`` with any flag; ``safe`` if it ends freed, nullified or returned; else ``incomplete``."""
    return F.when(flags > 0, "suspicious").when(final.isin("Freed", "Nullified", "Returned"), "safe").otherwise("incomplete")


def lifecycle_proofs(stepped: DataFrame) -> DataFrame:
    """``function_id, final_state, n_flags, verdict`` from :func:`straight_lifecycle`."""
    ends = stepped.groupBy("function_id").agg(F.max_by("after", "effect_id").alias("final_state"), F.count("flag").alias("n_flags"))
    return ends.withColumn("verdict", verdict(F.col("final_state"), F.col("n_flags")))


def cfg_lifecycle(nodes: DataFrame, edges: DataFrame, max_visits: int = 500, per_node: int = 10) -> DataFrame:
    """Forward worklist over each function's control-flow graph.

    ``nodes (function_id, node_id, kind, effect, place)``, ``edges (function_id,
    source, target)``; returns ``function_id, place, node_id, state, flag`` with the
    state after every node that changes or joins the place.  A function's graph is
    one group: functions are bounded by the visit budget, like the analysis itself.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        succ: dict = {}
        for a, b in zip(right["source"], right["target"]):
            succ.setdefault(a, []).append(b)
        rows = []
        effects = {n: (e, p) for n, e, p in zip(left["node_id"], left["effect"], left["place"])}
        entries = [n for n, k in zip(left["node_id"], left["kind"]) if k == "entry"] or sorted(left["node_id"])[:1]
        for place in sorted({p for p in left["place"] if isinstance(p, str)}):
            into, out, seen, visits = {e: "Unknown" for e in entries}, {}, {}, 0
            flags: dict = {}
            work = deque(entries)
            while work and visits < max_visits:
                n = work.popleft()
                seen[n] = seen.get(n, 0) + 1
                visits += 1
                if seen[n] > per_node:
                    continue
                before = into.get(n, "Bottom")
                effect, at = effects.get(n, (None, None))
                touches = at == place or effect == "escape"
                after = AFTER.get(effect, before) if touches else before
                if touches and effect in AFTER and (f := flag(before, after)):
                    flags[n] = f
                if out.get(n) == after:
                    continue
                out[n] = after
                for m in sorted(succ.get(n, [])):
                    joined = merge(into.get(m, "Bottom"), after)
                    if joined != into.get(m) or m not in out:
                        into[m] = joined
                        work.append(m)
            rows += [(key[0], place, n, s, flags.get(n)) for n, s in sorted(out.items())]
        return pd.DataFrame(rows, columns=["function_id", "place", "node_id", "state", "flag"])

    kind = nodes.schema["function_id"].dataType.simpleString()
    node = nodes.schema["node_id"].dataType.simpleString()
    return nodes.groupBy("function_id").cogroup(edges.groupBy("function_id")).applyInPandas(run, f"function_id {kind}, place string, node_id {node}, state string, flag string")


def branch_differences(effects: DataFrame) -> DataFrame:
    """``function_id, branch_id, resource, issue, severity, confidence`` of effects on one side of a branch only.

    ``effects (function_id, branch_id, side, resource, effect)`` with side true or
    false; the first fitting issue of pair, free, alloc, write decides.
    """
    has = lambda side, kinds: F.coalesce(F.bool_or((F.col("side") == side) & F.col("effect").isin(*kinds)), F.lit(False))
    flags = effects.groupBy("function_id", "branch_id", "resource").agg(*[has(s, k).alias(f"{n}_{'t' if s else 'f'}") for s in (True, False) for n, k in (("free", ("free",)), ("alloc", ("alloc",)), ("write", ("write", "store")))])
    c = F.col
    nothing = lambda s: ~(c(f"free_{s}") | c(f"alloc_{s}") | c(f"write_{s}"))
    pair = lambda s, o: c(f"free_{s}") & (c(f"alloc_{s}") | c(f"write_{s}")) & nothing(o)
    issue = F.when(pair("t", "f") | pair("f", "t"), "pair").when(c("free_t") != c("free_f"), "free").when(c("alloc_t") != c("alloc_f"), "alloc").when(c("write_t") != c("write_f"), "write")
    rows = flags.withColumn("issue", issue).where("issue IS NOT NULL")
    graded = {"pair": ("high", 0.85), "free": ("medium", 0.70), "alloc": ("medium", 0.65), "write": ("low", 0.50)}
    pick = lambda k: reduce(lambda rest, g: F.when(c("issue") == g[0], g[1][k]).otherwise(rest), graded.items(), F.lit(None))
    return rows.select("function_id", "branch_id", "resource", "issue", pick(0).alias("severity"), pick(1).alias("confidence"))


def all_but_one(cases: DataFrame) -> DataFrame:
    """``switch_id, resource, effect, missing_case``: what all effectful cases but one of a switch do (three cases at least).

    ``cases (switch_id, case_id, resource, effect)``.
    """
    rows = cases.distinct()
    n = rows.groupBy("switch_id").agg(F.countDistinct("case_id").alias("n"))
    most = rows.groupBy("switch_id", "resource", "effect").agg(F.countDistinct("case_id").alias("k")).join(n, "switch_id").where("n >= 3 AND k = n - 1")
    every = rows.select("switch_id", "case_id").distinct().join(most.select("switch_id", "resource", "effect"), "switch_id")
    missing = every.join(rows, ["switch_id", "case_id", "resource", "effect"], "left_anti")
    return missing.select("switch_id", "resource", "effect", F.col("case_id").alias("missing_case"))


def alias_roots(aliases: DataFrame, max_rounds: int = 20) -> DataFrame:
    """``function_id, name, root`` by pointer jumping over the first alias of each local; cycles stop at the bound.

    ``aliases (function_id, name, of, ord)``.
    """
    now = cut(aliases.groupBy("function_id", "name").agg(F.min_by("of", F.struct("ord", "of")).alias("root")), "alias")
    for _ in range(max_rounds):
        up = now.select("function_id", F.col("name").alias("root"), F.col("root").alias("above"))
        step = cut(now.join(up, ["function_id", "root"], "left").select("function_id", "name", F.coalesce("above", "root").alias("next"), "root"), "alias")
        if step.where("next <> root AND next <> name").isEmpty():
            break
        now = step.select("function_id", "name", F.when(F.col("next") == F.col("name"), F.col("root")).otherwise(F.col("next")).alias("root"))
    return now.select("function_id", "name", "root")


def scope_exit_frees(allocations: DataFrame, frees: DataFrame, escapes: DataFrame) -> DataFrame:
    """Synthetic frees at scope exit of what a function allocates and neither frees nor lets escape: ``function_id, place, confidence``.

    ``allocations (function_id, place, block_scoped)``; block exits are surer than scope exits.
    """
    key = ["function_id", "place"]
    rest = allocations.join(frees.select(*key).distinct(), key, "left_anti").join(escapes.select(*key).distinct(), key, "left_anti")
    return rest.groupBy(*key).agg(F.max(F.when(F.col("block_scoped"), 0.80).otherwise(0.70)).alias("confidence"))


def ownership(callee: Column) -> Column:
    """alloc, free, maybe_owned or none by the builtin contracts."""
    return F.when(callee.isin(*ALLOCATORS), "alloc").when(callee.isin(*DEALLOCATORS), "free").when(callee.isin(*MAYBE_OWNERS), "maybe_owned").otherwise("none")


def match_rules(names: DataFrame, rules: DataFrame) -> DataFrame:
    """``name, language, rule_id, rule_kind``: the best enabled rule of every name, its own language before ``*``.

    ``names (name, language)`` are reduced to distinct ones first; ``rules
    (rule_id, language, rule_kind, pattern, pattern_kind, status, confidence)`` are
    joined by language, so a name meets its language's rules only.
    """
    on = rules.where(F.col("status") == "enabled")
    # each column has its own condition: one on both would make Spark pair their tables first, where they come of different ones
    some = names.select("name", "language").where(F.col("name").isNotNull()).where(F.col("language").isNotNull()).distinct()
    both = some.select("name", "language", F.explode(F.array("language", F.lit("*"))).alias("rule_language"))
    hit = both.join(on.withColumnRenamed("language", "rule_language"), "rule_language").where(rule_matches(F.col("pattern_kind"), F.col("pattern"), F.col("name")))
    order = F.struct((F.col("rule_language") == "*").cast("int"), -F.col("confidence"), "rule_id")
    return hit.groupBy("name", "language").agg(F.min_by(F.struct("rule_id", "rule_kind"), order).alias("r")).select("name", "language", "r.*")


def learn_rules(uses: DataFrame, min_uses: int = 5, min_share: float = 0.8) -> DataFrame:
    """``name, role, n, share`` of names that play one role often and mostly enough; ``uses (name, role)``."""
    by_role = uses.groupBy("name", "role").agg(F.count("*").alias("n"))
    total = by_role.groupBy("name").agg(F.sum("n").alias("total"))
    return by_role.join(total, "name").where((F.col("n") >= min_uses) & (F.col("n") >= min_share * F.col("total"))).select("name", "role", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))

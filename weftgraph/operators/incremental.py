"""Incremental maintenance: change classes, coverage, fingerprints, visibility, fixed points."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.columns import BITS, LAYER_BITS, literal_map
from weftgraph.sources.tables import cut


def change_classes(known: DataFrame, discovered: DataFrame, needed_bits: int = 0) -> DataFrame:
    """``path, change``: new, modified, deleted, incomplete (lacks a needed capability) or unchanged.

    ``known (path, content_hash, capability_mask)``, ``discovered (path, content_hash)``.
    """
    a, b = known.select("path", F.col("content_hash").alias("old"), "capability_mask", F.lit(True).alias("k")), discovered.select("path", F.col("content_hash").alias("new"), F.lit(True).alias("d"))
    joined = a.join(b, "path", "full_outer")
    lacks = F.coalesce(F.col("capability_mask"), F.lit(0)).bitwiseAND(F.lit(needed_bits)) != needed_bits
    change = F.when(F.col("k").isNull(), "new").when(F.col("d").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified").when(lacks, "incomplete").otherwise("unchanged")
    return joined.select("path", change.alias("change"))


def dirty(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("change").isin("new", "modified", "incomplete")).select("path")


def layer_mask(layer: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(LAYER_BITS), layer), F.lit(0))


def coverage(states: DataFrame) -> DataFrame:
    """``file_id, mask, tier`` of fresh states ``(file_id, mask)``: the union of their bits and the best tier it proves."""
    bits = states.groupBy("file_id").agg(F.bit_or("mask").alias("mask"))
    has = lambda *names: F.col("mask").bitwiseAND(F.lit(sum(BITS[n] for n in names))) == sum(BITS[n] for n in names)
    tier = F.when(has("dataflow", "cfg", "summaries"), "full").when(has("dataflow"), "dataflow").when(has("structural"), "structural").when(has("manifest"), "manifest").otherwise("none")
    return bits.withColumn("tier", tier)


def covered_scopes(files: DataFrame, states: DataFrame, bits: int) -> DataFrame:
    """Scopes in which every file has a fresh state with all ``bits``: relational division; a scope has a file at least.

    ``files (scope, file_id)``, ``states (file_id, status, mask)``.
    """
    good = states.where((F.col("status") == "fresh") & (F.col("mask").bitwiseAND(F.lit(bits)) == bits)).select("file_id").distinct()
    lacking = files.join(good, "file_id", "left_anti").select("scope").distinct()
    return files.select("scope").distinct().join(lacking, "scope", "left_anti")


def resolved_scopes(files: DataFrame, references: DataFrame, fingerprints: DataFrame, expected: str) -> DataFrame:
    """Scopes whose files that have references all carry the ``expected`` resolution fingerprint."""
    need = files.join(references.select("file_id").distinct(), "file_id", "left_semi")
    lacking = need.join(fingerprints.where(F.col("fingerprint") == expected).select("file_id").distinct(), "file_id", "left_anti").select("scope").distinct()
    return files.select("scope").distinct().join(lacking, "scope", "left_anti")


def newest_visible(resolutions: DataFrame) -> DataFrame:
    """``reference_id, target`` of each reference's latest visible resolution ``(id, reference_id, target, is_visible)``."""
    return resolutions.where("is_visible").groupBy("reference_id").agg(F.max(F.struct("id", "target")).alias("m")).select("reference_id", "m.target")


def superseded(resolutions: DataFrame) -> DataFrame:
    """Visible resolutions that a later visible one of their reference replaces."""
    last = resolutions.where("is_visible").groupBy("reference_id").agg(F.max("id").alias("last"))
    return resolutions.where("is_visible").join(last, "reference_id").where("id < last").drop("last")


def prune(rows: DataFrame, keep: int, *order: Column) -> DataFrame:
    """The ``keep`` newest rows."""
    return rows.orderBy(*order).limit(keep)


def greedy_chunks(rows: DataFrame, key: str, weight: str, budget: int) -> DataFrame:
    """Rows with the ``chunk`` that a greedy pass in ``key`` order puts them in: a chunk ends before the row that would pass ``budget``.

    A row heavier than the budget is a chunk of its own; null weights count as zero; keys are unique.
    Rows are range-partitioned.  What a partition does depends on the weight that the last chunk before it
    has: each partition tells, for every row at which that chunk may end, how many chunks follow and what
    is left at its end (as many rows as a chunk has).  The driver strings these together, a second pass numbers the rows.
    """
    placed = cut(rows.withColumn("__w", F.coalesce(F.col(weight), F.lit(0)).cast("long")).repartitionByRange(key).withColumn("__p", F.spark_partition_id()), "chunks")

    def starts(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums before each row, and for each row where the chunk after the one that starts there starts."""
        before = np.concatenate([[0], np.cumsum(w)])
        return before, np.maximum(np.searchsorted(before, before[:-1] + budget, "right") - 1, np.arange(1, len(w) + 1))

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf.sort_values(key)["__w"].to_numpy()
        before, following = starts(w)
        n = len(w)
        count, last = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64)
        for k in range(n - 1, -1, -1):
            f = following[k]
            count[k], last[k] = count[f] + 1, last[f] if f < n else k
        some = int(np.searchsorted(before, budget, "right"))  # the chunk before may end at rows 0 to some - 1, or 1 if nothing is before
        k = np.arange(min(max(some, 2), n + 1))
        left = np.where(last[k] >= 0, before[n] - before[last[k]], 0)
        return pd.DataFrame({"p": pdf["__p"].iloc[0], "row": k, "before": before[k], "count": count[k], "rest": left, "total": before[n], "rows": n})

    told = placed.select(key, "__w", "__p").groupBy("__p").applyInPandas(tell, "p int, row long, before long, count long, rest long, total long, rows long").toPandas()
    held, chunk, opening = None, 0, []
    for p, table in told.sort_values(["p", "row"]).groupby("p"):
        fits = table[table["before"] <= budget - (held or 0)] if held is None or held <= budget else table.iloc[:0]
        end = int(fits["row"].max()) if len(fits) else 0
        end = max(end, 1) if held is None else end
        opening.append((int(p), end, chunk))
        row = table[table["row"] == end].iloc[0]
        if end == row["rows"]:
            held = (held or 0) + int(row["total"])
        else:
            chunk, held = chunk + int(row["count"]), int(row["rest"])
    known = {p: (end, first) for p, end, first in opening}

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        end, first = known[int(pdf["__p"].iloc[0])]
        _, following = starts(pdf["__w"].to_numpy())
        new = np.zeros(len(pdf), np.int64)
        while end < len(pdf):
            new[end] = 1
            end = following[end]
        return pd.DataFrame({key: pdf[key], "chunk": first + np.cumsum(new)})

    kind = rows.schema[key].dataType.simpleString()
    numbered = placed.select(key, "__w", "__p").groupBy("__p").applyInPandas(number, f"`{key}` {kind}, chunk long")
    return rows.join(numbered, key).select(*rows.columns, "chunk")


def fixed_point(seed: DataFrame, plan: Callable[[DataFrame], DataFrame], keys: list[str], max_rounds: int | None = None) -> DataFrame:
    """Close ``seed`` under ``plan``, which gives the additions of the newest rows; ends when nothing is new, or after ``max_rounds`` where the caller sets them."""
    known = new = cut(seed.select(*keys).distinct(), "closure")
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        new = cut(plan(new).select(*keys).distinct().join(known, keys, "left_anti"), "closure")
        if new.isEmpty():
            break
        known = cut(known.unionByName(new), "closure")
    return known

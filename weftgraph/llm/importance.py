"""Quality by importance resampling.

Two generative models over hashed word n-grams, one of target texts and one of
all texts, give every document the log ratio of its probabilities.  Gumbel noise
on the log ratio and a top-k choice sample k documents without replacement in
proportion to the ratio.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, map_rows, read_table


def buckets_of(texts: list[str], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed unigrams and bigrams of lower-cased words, text by text, and how many each text has."""
    parts, sizes = [], []
    for t in texts:
        words = t.encode().lower().split()
        one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)
        parts += (one, two)
        sizes.append(len(one) + len(two))
    return (np.concatenate(parts) % np.uint64(n_buckets)).astype(np.int64) if parts else np.empty(0, np.int64), np.array(sizes, np.int64)


def _counts(docs: DataFrame, text_col: str, n_buckets: int) -> np.ndarray:
    """Counts per bucket over all rows: summed in each chunk, then by bucket; ``n_buckets`` rows reach the driver."""

    def make():
        def work(cols):
            at, _ = buckets_of([t or "" for t in cols[0]], n_buckets)
            n = np.bincount(at, minlength=n_buckets)
            seen = np.flatnonzero(n)
            return [pa.array(seen), pa.array(n[seen])]

        return work

    rows = map_rows(docs, [text_col], "bucket long, n long", make, sized=0).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets)
    for bucket, n in rows.collect():
        out[bucket] = n
    return out


def kth_largest(scores: DataFrame, key: str, k: int, ways: int = 4096) -> float | None:
    """The exact k-th largest value of a double column; None if there are fewer values.

    Each pass counts the values in ``ways`` parts of the range that holds the k-th
    one, so ``ways`` rows reach the driver and nothing is sorted.  It ends when all
    values of the range are equal, which takes a few passes.
    """
    inside, left = scores.where(F.col(key).isNotNull()).select(F.col(key).alias("x")), k
    while True:
        low, high, n = inside.agg(F.min("x"), F.max("x"), F.count("*")).first()
        if n < left:
            return None
        if low == high:
            return low
        step = (high - low) / ways
        part = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(step)), F.lit(ways - 1)) if step else (F.col("x") > F.lit(low)).cast("int")
        counted = inside.groupBy(part.alias("p")).agg(F.count("*"), F.min("x"), F.max("x")).collect()
        for _, n, a, b in sorted(map(tuple, counted), reverse=True):
            if n >= left:
                inside = inside.where(F.col("x").between(a, b))
                break
            left -= n


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", quality_col: str = "quality", share: float | None = None, n_buckets: int = 10_000, max_target: int = 50_000, seed: int = 20240501) -> DataFrame:
    """One row per document: id, ``log_ratio``, ``gumbel_key``, ``kept``.

    The target model is fitted on the documents of at most ``max_target`` labelled
    good ids, the ones with the least id hash (the only bound; its id list is what
    is broadcast; ids that tie at the last hash are all taken).  k is ``share`` of all rows, by default the labels' share of good
    ones (all rows without labels).  Rows that tie at the k-th key are all kept.
    A null text counts as empty with log ratio 0; null ids and repeated rows are
    kept as rows, and equal rows share one draw; a null label is not good; other columns are not read.
    """
    good = F.coalesce(F.col(f"`{quality_col}`") == 1, F.lit(False))
    if share is None:
        share = labels.agg(F.avg(good.cast("double"))).first()[0]
        share = 1.0 if share is None else share
    place = F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`")), 11).cast("double")  # 53 bits: exact
    ids = cut(labels.where(good & F.col(f"`{label_id}`").isNotNull()).select(F.col(f"`{label_id}`").alias(id_col)).distinct().withColumn("__weft_place", -place), "importance-ids")
    last = kth_largest(ids, "__weft_place", max_target)
    ids = (ids if last is None else ids.where(F.col("__weft_place") >= F.lit(last))).drop("__weft_place")
    # rows of one id, or of none, draw by their text too
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), 11).cast("double") + 0.5) / float(1 << 53)
    some = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), uniform.alias("__weft_uniform"))
    target = _counts(some.join(F.broadcast(ids), id_col, "left_semi"), text_col, n_buckets)
    raw = _counts(some, text_col, n_buckets)
    weights = np.log((target + 1) / (target.sum() + n_buckets)) - np.log((raw + 1) / (raw.sum() + n_buckets))

    def make():
        def work(cols):
            at, sizes = buckets_of([t or "" for t in cols[1]], n_buckets)
            sums = np.concatenate([[0.0], np.cumsum(weights[at])])
            ends = np.cumsum(sizes)
            return [cols[0], pa.array(sums[ends] - sums[ends - sizes]), cols[2]]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    scored = map_rows(some, [id_col, text_col, "__weft_uniform"], f"`{id_col}` {kind}, log_ratio double, u double", make)
    scored = cut(scored.select(F.col(f"`{id_col}`"), "log_ratio", (F.col("log_ratio") - F.log(-F.log("u"))).alias("gumbel_key")), "importance")
    k = round(share * scored.count())
    least = kth_largest(scored, "gumbel_key", k) if k else None
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(least) if least is not None else F.lit(False))


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

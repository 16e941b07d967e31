"""Streaming twins: dirty files, keyed latest rows, lifecycle states."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators.semantic import AFTER, flag
from weftgraph.sources.tables import shared_dir


def read_stream(spark: SparkSession, folder: str, name: str, max_files: int = 64) -> DataFrame:
    """Parquet table ``name`` of a data folder as a stream of files; the schema is the batch table's."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{folder}/{name}.parquet*")


def drain(stream: DataFrame, mode: str, schema: T.StructType | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it wrote, each row with its ``batch``.

    Batches are written under their id, so a replayed batch overwrites itself.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/weftgraph/stream-{uuid.uuid4().hex}"

    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*(schema or stream.schema).fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{base}/rows")


def latest_per_key(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest row of each key over the whole stream: aggregation in update mode, then the last batch of each key."""
    rest = [c for c in events.columns if c not in key]
    newest = events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    written = drain(newest, "update")
    return written.groupBy(*key).agg(F.max_by("row", "batch").alias("row")).select(*key, "row.*")


def windowed_counts(events: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts per tumbling event-time window with a watermark, from a drained stream (update mode)."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"))
    written = drain(counts, "update")
    return written.groupBy(F.col("w.start").alias("start"), *by).agg(F.max_by("n", "batch").alias("n"))


def lifecycle_states(effects: DataFrame) -> DataFrame:
    """Final lifecycle state and flags per function, kept as keyed stream state.

    ``effects (function_id, effect_id, effect)`` arrive in any number of batches, in
    order of effect id within a batch.
    """
    out = "function_id long, state string, n_flags long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, flags = state.get if state.exists else ("Unknown", 0)
        rows = pd.concat(list(frames)).sort_values("effect_id")
        for effect in rows["effect"]:
            if after := AFTER.get(effect):
                flags += flag(now, after) is not None
                now = after
        state.update((now, flags))
        yield pd.DataFrame([(key[0], now, flags)], columns=["function_id", "state", "n_flags"])

    stateful = effects.groupBy("function_id").applyInPandasWithState(step, out, "state string, n_flags long", "update", "NoTimeout")
    written = drain(stateful, "update")
    return written.groupBy("function_id").agg(F.max_by(F.struct("state", "n_flags"), "batch").alias("v")).select("function_id", "v.*")

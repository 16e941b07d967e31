"""Watching a source tree: what was created, modified or removed between two looks."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.incremental import change_classes
from weftgraph.sources import files
from weftgraph.sources.tables import cut


class Watcher:
    """Compares listings of the source files below ``root``; no file is read.

    Spark's file stream sees a path once and never its removal, so each look lists the tree and is
    joined with the one before, which is kept as a written table.
    """

    def __init__(self, spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None):
        self.spark, self.root, self.globs = spark, root, (include, exclude)
        self.known = self._look()

    def _look(self) -> DataFrame:
        found = files.discover(self.spark, self.root, *self.globs)
        return cut(found.select("path", F.concat_ws(":", "size", F.unix_micros("modified")).alias("content_hash"), F.lit(0).alias("capability_mask")), "inventory")

    def poll(self) -> DataFrame:
        """``path, change``: new, modified and deleted paths since the last look; no rows if nothing changed."""
        now = self._look()
        changes = cut(change_classes(self.known, now).where("change <> 'unchanged'"), "watched")
        self.known = now
        return changes

    def events(self, seconds: float = 1.0, most: int | None = None) -> Iterator[DataFrame]:
        """Changes as they come, one table for each look that saw any; ends after ``most`` looks where that is set."""
        looks = 0
        while most is None or looks < most:
            looks += 1
            changes = self.poll()
            if not changes.isEmpty():
                yield changes
            if most is None or looks < most:
                time.sleep(seconds)

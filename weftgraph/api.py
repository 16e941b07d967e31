"""The query surface: one engine over a catalog of fact DataFrames, every call a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import in_scope, language_of
from weftgraph.operators import graph, incremental, joins, resolve, search, semantic, state, trace
from weftgraph.sources import files, tables
from weftgraph.streaming.watch import Watcher


class Engine:
    """``facts`` maps table names to DataFrames: files, symbols and edges at least, others as an operation needs them."""

    def __init__(self, facts: dict[str, DataFrame]):
        self.facts = facts

    @classmethod
    def index(cls, spark, root: str) -> Engine:
        """Build facts from the sources below ``root``: extract, resolve, derive edges."""
        sources = tables.cut(files.read_sources(spark, root), "sources")
        return cls.built(sources, tables.cut(files.extract(sources), "facts"))

    def sync(self, root: str) -> tuple[Engine, DataFrame]:
        """The engine of the tree as it is now, and the change of every path; only new and modified files are extracted again.

        What refers to a changed or deleted file may resolve elsewhere now, so resolution and
        edges follow from all facts: the result equals that of a new index.
        """
        sources = tables.cut(files.read_sources(self.facts["files"].sparkSession, root), "sources")
        known = self.facts["files"].select("path", "content_hash", F.lit(0).alias("capability_mask"))
        changes = tables.cut(incremental.change_classes(known, sources.select("path", F.col("text_hash").alias("content_hash"))), "changes")
        kept = self.facts["facts"].join(changes.where("change = 'unchanged'").select("path"), "path", "left_semi")
        again = files.extract(sources.join(incremental.dirty(changes), "path", "left_semi"))
        return self.built(sources, tables.cut(kept.select(*again.columns).unionByName(again), "facts")), changes

    def watch(self, root: str, seconds: float = 1.0, most: int | None = None) -> Iterator[tuple[Engine, DataFrame]]:
        """A synced engine and the changed paths, each time that sources below ``root`` change; ends after ``most`` looks where that is set."""
        engine = self
        for changes in Watcher(self.facts["files"].sparkSession, root).events(seconds, most):
            engine, _ = engine.sync(root)
            yield engine, changes

    @classmethod
    def built(cls, sources: DataFrame, rows: DataFrame) -> Engine:
        """The engine of ``sources (path, language, text_hash, …)`` and their fact ``rows``: resolve, derive edges."""
        of = lambda fact: rows.where(F.col("fact") == fact)
        listed = sources.select(F.col("path").alias("file_id"), "path", "language", F.col("text_hash").alias("content_hash"))
        symbols = of("symbol").select(F.col("id").alias("symbol_id"), F.col("path").alias("file_id"), "path", language_of(F.col("path")).alias("language"), "kind", "name", "qualified_name", "start_byte", "end_byte", "start_line", "end_line")
        holders = symbols.select(F.col("symbol_id").alias("container_id"), F.col("qualified_name").alias("parent"), "file_id")
        symbols = symbols.join(of("symbol").select(F.col("id").alias("symbol_id"), "parent"), "symbol_id", "left").join(holders, ["file_id", "parent"], "left").drop("parent")
        symbols = tables.cut(symbols.dropDuplicates(["symbol_id"]), "symbols")
        references = of("reference").select(F.col("id").alias("reference_id"), F.col("path").alias("file_id"), "path", language_of(F.col("path")).alias("language"), "kind", "name", F.col("start_byte").alias("pos"))
        imports = of("import").select(F.col("path").alias("file_id"), "name", F.regexp_replace(F.regexp_replace(F.substring_index("target", ":", 1), r"^\.+", ""), r"\.", "/").alias("module"))
        targets = listed.select(F.col("file_id").alias("target_file"), F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), "/__init__$", "").alias("stem"))
        found = imports.join(targets, F.col("stem").endswith(F.col("module")) & (F.substring_index("stem", "/", -1) == F.substring_index("module", "/", -1)))
        found = tables.cut(found.select("file_id", "name", "target_file"), "imported")
        resolved = tables.cut(resolve.resolve(references, symbols, found), "resolved")
        ranges = symbols.where("kind IN ('function', 'method', 'class')").select("file_id", "start_byte", "end_byte", F.col("symbol_id").alias("source_symbol"))
        owners = joins.innermost(references.select("reference_id", "file_id", "kind", "pos"), ranges, ["file_id"]).select("reference_id", "kind", "source_symbol")
        linked = owners.join(resolved, "reference_id").select("reference_id", "source_symbol", "kind", F.col("symbol_id").alias("target"), "confidence", F.col("strategy").alias("provenance"))
        edges = tables.cut(graph.derive_edges(linked, symbols.select("symbol_id", "kind", "container_id")), "edges")
        return cls({"files": listed, "symbols": symbols, "references": references, "edges": edges, "resolved": resolved, "imports": imports, "imported_files": found.select("file_id", "target_file").distinct(), "facts": rows})

    def status(self) -> DataFrame:
        counts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, df in sorted(self.facts.items())]
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        return out

    def list_files(self, scope: str = ".", language: str | None = None, limit: int = 1000) -> DataFrame:
        rows = self.facts["files"].where(in_scope(F.col("path"), scope))
        return (rows.where(F.col("language") == language) if language else rows).orderBy("path").limit(limit)

    def search(self, query: str, scope: str = ".", limit: int = 20) -> DataFrame:
        return search.search(self.facts["symbols"], query, scope, min(limit, 200))

    def symbol(self, name: str, **hints) -> tuple[str, list]:
        """``single``, ``ambiguous`` or ``not_found`` and the candidates."""
        return search.unique_selection(search.selector_scores(self.facts["symbols"], name, **hints))

    def symbol_at(self, path: str, byte: int) -> DataFrame:
        point = self.facts["files"].where(F.col("path") == path).select("file_id", F.lit(byte).alias("pos"))
        return joins.innermost(point, self.facts["symbols"].select("file_id", "symbol_id", "start_byte", "end_byte"), ["file_id"])

    def usages(self, symbols: DataFrame) -> DataFrame:
        return self.facts["resolved"].join(symbols.select("symbol_id"), "symbol_id", "left_semi").join(self.facts["references"], "reference_id")

    def calls(self, symbols: DataFrame, direction: str = "both", depth: int = 1, limit: int = 500) -> DataFrame:
        return graph.bfs(self.facts["edges"], symbols, min(depth, 5), direction, limit=min(limit, 500))

    def path(self, pairs: DataFrame, k: int = 5, max_depth: int = 10) -> DataFrame:
        edges = graph.weighted(self.facts["edges"], self.facts["symbols"])
        return graph.ranked_paths(edges, pairs, min(max_depth, 10), k)

    def impact(self, symbols: DataFrame, depth: int = 3, direction: str = "outgoing", kinds: tuple[str, ...] | None = None, with_members: bool = False) -> DataFrame:
        members = self.facts["symbols"].select(F.col("container_id").alias("container"), "symbol_id") if with_members else None
        return graph.impact(self.facts["edges"], symbols, min(depth, 5), direction, kinds, members)

    def explore(self, symbols: DataFrame, most: int = 10) -> dict[str, DataFrame]:
        """A dossier: the subjects, their callers, callees and relation counts."""
        edges = self.facts["edges"]
        counts = graph.relation_counts(edges).join(symbols.select(F.col("symbol_id").alias("node")), "node", "left_semi")
        return {
            "subject": self.facts["symbols"].join(symbols.select("symbol_id"), "symbol_id", "left_semi"),
            "callers": graph.one_hop(edges, symbols, "incoming").orderBy("seed", "node").limit(most),
            "callees": graph.one_hop(edges, symbols, "outgoing").orderBy("seed", "node").limit(most),
            "relations": counts,
        }

    def file_dependencies(self, source: str = "both") -> DataFrame:
        """``file_id, depends_on, source``: files that a file needs, by ``edges`` between symbols, by the ``manifest`` of imports, or both.

        Edges win where both tell of a dependency; imports from outside of the project are none.
        """
        holds = self.facts["symbols"].select("symbol_id", "file_id")
        edges = self.facts["edges"].select("source", "target").join(holds.withColumnRenamed("symbol_id", "source"), "source")
        edges = edges.join(holds.select(F.col("symbol_id").alias("target"), F.col("file_id").alias("depends_on")), "target")
        manifest = self.facts["imported_files"].select("file_id", F.col("target_file").alias("depends_on"))
        parts = [df.where("file_id <> depends_on") if source in (name, "both") else df.limit(0) for name, df in (("edges", edges), ("manifest", manifest))]
        return state.merged_dependencies(*parts)

    def dependents(self, files: DataFrame, source: str = "both") -> DataFrame:
        """``file_id, depends_on, source`` of the files that need one of ``files (file_id)``."""
        return self.file_dependencies(source).join(files.select(F.col("file_id").alias("depends_on")).distinct(), "depends_on", "left_semi")

    def trace_callers(self, symbols: DataFrame, depth: int = 5) -> DataFrame:
        return trace.caller_chains(self.facts["edges"], self.facts["symbols"], symbols, depth)

    def trace_variable(self, sinks: DataFrame, dataflow: DataFrame, steps: int = 100) -> DataFrame:
        return trace.backward_slices(sinks, dataflow, steps)

    def lifecycle(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return semantic.cfg_lifecycle(nodes, edges)

    def branch_diff(self, effects: DataFrame) -> DataFrame:
        return semantic.branch_differences(effects)

    def domain_rules(self, rules: DataFrame) -> DataFrame:
        return semantic.match_rules(self.facts["symbols"], rules)

    def changes(self, discovered: DataFrame) -> DataFrame:
        known = self.facts["files"].select("path", "content_hash", F.lit(0).alias("capability_mask"))
        return incremental.change_classes(known, discovered)

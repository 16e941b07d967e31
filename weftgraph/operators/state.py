"""Index state as keyed tables: extraction states, coverage, hints, rules, annotations, windows, and what they decide."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.columns import BITS
from weftgraph.operators.graph import bfs, derive_edges, edge_policy
from weftgraph.operators.incremental import fixed_point
from weftgraph.operators.resolve import resolve

#: Tiers of an index from poor to rich.
TIERS = ("none", "manifest", "structural", "dataflow", "full")
#: Where a resolution holds, by its strategy.
SCOPES = {"compiler": "boundary", "exact_name": "closure_complete", "same_file": "closure_complete", "import": "closure_complete", "implicit_operator": "closure_complete", "name_only": "boundary", "fuzzy": "boundary", "heuristic": "boundary", "builtin": "boundary", "dataflow_pointer": "boundary"}
#: What a question loads around its subject, in order, and the facts it needs.  Type graphs go one deeper in the background.
FOCUS = {
    "semantic_function": ((), "dataflow"),
    "symbol_detail": (("imports", "same_folder"), "structural"),
    "calls": (("calls", "imports"), "call_graph"),
    "context": (("calls", "types", "imports"), "call_graph"),
    "explore": (("calls", "imports"), "call_graph"),
    "path": (("calls", "imports"), "call_graph"),
    "impact": (("calls", "types", "imports"), "call_graph"),
    "search": (("imports", "same_folder"), "structural"),
    "trace_point": (("imports", "same_folder"), "structural"),
    "trace_variable": (("calls", "types", "imports", "same_folder"), "dataflow"),
}
#: Least, usual and most rounds of background loading for questions with a depth of their own, else the one number of rounds.
ROUNDS = {"calls": (1, 1, 5), "path": (1, 5, 10), "impact": (1, 3, 5), "trace_variable": (2, 2, 5), "explore": 2, "context": 2, "search": 1, "symbol_detail": 1, "trace_point": 1, "semantic_function": 0}
#: States of a job.
OPEN, CLOSED = ("queued", "building"), ("complete", "failed")
#: Rule kinds that a rule may have.
RULE_KINDS = ("alloc", "free", "escape", "callback")


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes last in ``order``; ties go to the greatest other columns."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("__r")).select(*keys, "__r.*").select(*rows.columns)


def put(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same keys; null keys are equal."""
    same = [table[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
    new = rows.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return table.join(new, same, "left_anti").unionByName(rows.select(*table.columns))


def drop(table: DataFrame, keys: DataFrame) -> DataFrame:
    """``table`` without the rows whose key is in ``keys``."""
    return table.join(keys.distinct(), keys.columns, "left_anti")


def capabilities(states: DataFrame) -> DataFrame:
    """``file_id, mask``: what fresh states of a file, of whatever unit and layer, can answer."""
    return states.where("status = 'fresh'").groupBy("file_id").agg(F.bit_or("mask").alias("mask"))


def lazy_stats(units: DataFrame) -> DataFrame:
    """One row: analysis units by status, their nodes and edges, files with any: ``units (file_id, unit_id, status, node_count, edge_count)``."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}")
    return units.agg(F.count("*").alias("n_units"), n("fresh"), n("stale"), F.countDistinct("file_id").alias("n_files"), F.coalesce(F.sum("node_count"), F.lit(0)).alias("n_nodes"), F.coalesce(F.sum("edge_count"), F.lit(0)).alias("n_edges"))


def cover(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Closure coverage ``(closure_id, file_id, source, generation, content_hash)`` after an insert: the newest generation of a file in a closure stays."""
    return newest(table.unionByName(rows.select(*table.columns)), ["closure_id", "file_id"], "generation")


def covered_files(table: DataFrame, closure_id: str, hashes: DataFrame) -> DataFrame:
    """``file_id`` of a closure's files whose content is still what was covered; ``hashes (file_id, content_hash)``."""
    own = table.where(F.col("closure_id") == closure_id).select("file_id", F.col("content_hash").alias("__h"))
    return own.join(hashes, "file_id").where(F.col("__h").eqNullSafe(F.col("content_hash"))).select("file_id").distinct()


def reset_session(tables: dict[str, DataFrame], transient: Iterable[str]) -> dict[str, DataFrame]:
    """All tables, the transient ones without rows."""
    return {name: df.limit(0) if name in set(transient) else df for name, df in tables.items()}


def add_hints(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Hints keyed by (name, file): the surest one of a key stays; ``(name, file_id, kind, line, confidence, source)``."""
    return newest(table.unionByName(rows.select(*table.columns)), ["name", "file_id"], "confidence")


def add_candidates(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidate edges after a batch: one row for each (source, target, kind), the surest."""
    return newest(table.unionByName(rows.select(*table.columns)), ["source", "target", "kind"], "confidence")


def rule_id(language: Column, rule_kind: Column, pattern_kind: Column, pattern: Column) -> Column:
    """Stable id of a rule from what it is, fields apart by a byte that no text has."""
    part = lambda c: F.concat(c.cast("binary"), F.unhex(F.lit("ff")))
    return F.sha2(F.concat(part(language), part(rule_kind), part(pattern_kind), pattern.cast("binary")), 256)


def put_rules(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Domain rules after an upsert; a rule kind that is none is an error, ids follow from the rules."""
    wrong = [r[0] for r in rows.select("rule_kind").distinct().limit(100).collect() if r[0] not in RULE_KINDS]
    if wrong:
        raise ValueError(f"no rule kind: {', '.join(map(str, wrong))}")
    made = rows.withColumn("rule_id", rule_id(F.col("language"), F.col("rule_kind"), F.col("pattern_kind"), F.col("pattern")))
    return put(table, newest(made.select(*table.columns), ["rule_id"], "confidence"), ["rule_id"])


def list_rules(table: DataFrame, language: str | None = None, rule_kind: str | None = None) -> DataFrame:
    """Rules of a language (and of all languages), of a kind, enabled or not."""
    out = table if language is None else table.where(F.col("language").isin(language, "*"))
    return out if rule_kind is None else out.where(F.col("rule_kind") == rule_kind)


def put_annotations(table: DataFrame, rows: DataFrame, generation: int) -> DataFrame:
    """Function-pointer annotations ``(source_symbol, field_name, target_symbol, generation)`` after an insert in an overlay generation."""
    return put(table, rows.withColumn("generation", F.lit(generation)).select(*table.columns).distinct(), ["source_symbol", "field_name", "target_symbol"])


def overlay(table: DataFrame) -> int:
    """Generation of the annotations, 0 without any: graphs built before it lack some."""
    return table.agg(F.max("generation")).first()[0] or 0


def merged_dependencies(structural: DataFrame, manifest: DataFrame) -> DataFrame:
    """``file_id, depends_on, source``: dependencies by edges and by manifests, one row each; edges win."""
    both = structural.select("file_id", "depends_on", F.lit(0).alias("__o"), F.lit("edges").alias("source")).unionByName(manifest.select("file_id", "depends_on", F.lit(1).alias("__o"), F.lit("manifest").alias("source")))
    return both.dropna(subset=["file_id", "depends_on"]).groupBy("file_id", "depends_on").agg(F.min_by("source", "__o").alias("source"))


def focus_graph(resolutions: DataFrame, references: DataFrame, symbols: DataFrame, existing: DataFrame, closure_id, generation: int) -> DataFrame:
    """Edges of a closure's visible resolutions with the ``decision`` of the edge policy: canonical, candidate, keep or replace.

    ``resolutions (reference_id, closure_id, generation, target, confidence, is_visible)``,
    ``references (reference_id, source_symbol, kind)``, ``symbols (symbol_id, kind, container_id)``,
    ``existing (source, target, kind, confidence, band, coverage)``.
    """
    own = resolutions.where((F.col("closure_id") == closure_id) & (F.col("generation") == generation) & F.col("is_visible"))
    used = references.join(own.select("reference_id", "target", "confidence"), "reference_id").withColumn("provenance", F.lit("focus"))
    made = derive_edges(used, symbols).groupBy("source", "target", "kind").agg(F.max("confidence").alias("confidence"))
    band = F.when(F.col("confidence") >= 0.95, "certain").when(F.col("confidence") >= 0.75, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low")
    return edge_policy(existing, made.select("source", "target", "kind", "confidence", band.alias("band"), F.lit("closure").alias("coverage")))


def resolve_files(references: DataFrame, symbols: DataFrame, imports: DataFrame | None, files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Resolution of the references in ``files (file_id)``, of some kinds only if given; all symbols stay candidates."""
    some = references.join(files.select("file_id").distinct(), "file_id", "left_semi")
    return resolve(some if kinds is None else some.where(F.col("kind").isin(*kinds)), symbols, imports)


def plan_dependencies(imports: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """``file_id``: files to load for ``seeds (file_id)``, through imports ``(file_id, target_file)`` of any depth or up to ``depth``."""
    hops = imports.select("file_id", "target_file").dropna().distinct()
    return fixed_point(seeds.select("file_id"), lambda new: new.join(hops, "file_id").select(F.col("target_file").alias("file_id")), ["file_id"], depth)


def lazy_window(units: DataFrame, calls: DataFrame, at: DataFrame, depth: int = 2, most: int = 100) -> DataFrame:
    """``unit_id, distance``: the units around places, those that hold them and what they call, nearest first, at most ``most``.

    ``units (unit_id, file_id, start_byte, end_byte)``, ``calls (source, target)`` between units, ``at (file_id, pos)``.
    """
    own = units.join(at, "file_id").where("pos BETWEEN start_byte AND end_byte").select(F.col("unit_id").alias("symbol_id")).distinct()
    edges = calls.select("source", "target", F.lit("calls").alias("kind"))
    near = bfs(edges, own, depth).groupBy(F.col("node").alias("unit_id")).agg(F.min("depth").alias("distance"))
    return near.orderBy("distance", "unit_id").limit(most)


def access_strategy(files: DataFrame, states: DataFrame, bits: int) -> str:
    """``full_cache`` if every file has fresh states with all ``bits``, else ``focus``."""
    good = capabilities(states).where(F.col("mask").bitwiseAND(F.lit(bits)) == bits)
    return "focus" if files.isEmpty() or not files.join(good, "file_id", "left_anti").isEmpty() else "full_cache"


def graph_mode(files: DataFrame, states: DataFrame) -> str:
    """``full`` if all files have structure, ``focus_partial`` if some have, ``empty`` if none."""
    if access_strategy(files, states, BITS["structural"]) == "full_cache":
        return "full"
    return "empty" if capabilities(states).where(F.col("mask").bitwiseAND(F.lit(BITS["structural"])) != 0).isEmpty() else "focus_partial"


def refresh_plan(dirty: DataFrame, n_files: int, max_files: int = 500) -> str:
    """``none``, ``incremental`` for at most ``max_files`` dirty files that are no more than half of all, else ``full``."""
    n = dirty.select("file_id").distinct().limit(max_files + 1).count()
    return "none" if n == 0 else "incremental" if n <= max_files and 2 * n <= n_files else "full"


def focus_plan(question: str, depth: int | None = None, background: bool = False, language: str = "") -> tuple[list[tuple[str, int]], int]:
    """Ways to load around a question's subject, each with its depth, and in how many further rounds (none but in the background)."""
    ways = [(w, 2 if w == "types" and background else 1) for w in FOCUS[question][0]]
    if question == "trace_variable" and language == "arkts":
        ways.append(("state_channels", 1))
    rounds = ROUNDS[question]
    if not isinstance(rounds, int):
        least, usual, most = rounds
        rounds = min(max(usual if depth is None else depth, least), most)
    return ways, rounds if background else 0


def focus_files(edges: DataFrame, symbols: DataFrame, imports: DataFrame, files: DataFrame, seeds: DataFrame, ways: list[tuple[str, int]]) -> DataFrame:
    """``file_id`` of the files that a plan's ways reach from ``seeds (symbol_id)``, those of the seeds included.

    ``edges (source, target, kind)``, ``symbols (symbol_id, file_id)``, ``imports (file_id, target_file)``, ``files (file_id, path)``.
    """
    kinds = {"calls": ("calls", "instantiates", "implements"), "types": ("extends", "implements", "references")}
    own = seeds.join(symbols.select("symbol_id", "file_id"), "symbol_id").select("file_id").distinct()
    out = own
    for way, depth in ways:
        if way in kinds:
            near = bfs(edges.where(F.col("kind").isin(*kinds[way])), seeds.select("symbol_id").distinct(), depth).select(F.col("node").alias("symbol_id")).distinct()
            out = out.unionByName(near.join(symbols.select("symbol_id", "file_id"), "symbol_id").select("file_id"))
        elif way == "imports":
            out = out.unionByName(plan_dependencies(imports, own, depth))
        elif way == "same_folder":
            placed = files.select("file_id", F.regexp_replace("path", "[^/]*$", "").alias("folder"))
            out = out.unionByName(placed.join(placed.join(own, "file_id").select("folder").distinct(), "folder", "left_semi").select("file_id"))
    return out.distinct()


def enqueue(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Jobs ``(job_id, file_id, unit_id, layer, priority, depends_on, status, error)`` after a request for more.

    A request for what a queued or building job does already adds none; of equal requests the most urgent is kept.
    """
    what = ["file_id", "unit_id", "layer"]
    new = newest(rows.withColumn("status", F.lit("queued")).withColumn("error", F.lit(None).cast("string")).select(*jobs.columns), what, "priority")
    busy = jobs.where(F.col("status").isin(*OPEN)).select(*[F.col(c).alias(f"__{c}") for c in what]).distinct()
    return jobs.unionByName(new.join(busy, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in what], "left_anti"))


def runnable(jobs: DataFrame, most: int) -> DataFrame:
    """The ``most`` queued jobs to build next: greatest priority first, then least id; a job waits until the one it depends on is complete."""
    done = jobs.where("status = 'complete'").select(F.col("job_id").alias("__d"))
    queued = jobs.where("status = 'queued'")
    free = queued.where("depends_on IS NULL").unionByName(queued.join(done, queued["depends_on"] == F.col("__d"), "left_semi"))
    return free.orderBy(F.desc("priority"), "job_id").limit(most)


def advance(jobs: DataFrame, moves: DataFrame) -> DataFrame:
    """Jobs after ``moves (job_id, status, error)``: queued to building, building to complete or failed; other moves change nothing.

    Moves of one job are taken as one: the last in the order of states.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in (*OPEN, *CLOSED)]), F.col("to"))
    last = moves.select("job_id", F.col("status").alias("to"), F.col("error").alias("why")).groupBy("job_id").agg(F.max_by(F.struct("to", "why"), F.struct(order, "why")).alias("m"))
    may = ((F.col("status") == "queued") & (F.col("m.to") == "building")) | ((F.col("status") == "building") & F.col("m.to").isin(*CLOSED))
    joined = jobs.join(last, "job_id", "left").withColumn("__may", F.coalesce(may, F.lit(False)))
    values = {"status": F.when(F.col("__may"), F.col("m.to")).otherwise(F.col("status")), "error": F.when(F.col("__may") & (F.col("m.to") == "failed"), F.col("m.why")).otherwise(F.col("error"))}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in jobs.columns])


def tickets(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """``ticket, n_jobs, n_open, n_failed, status``: whether what a question waits for is pending, ready, or partly failed; ``requests (ticket, job_id)``.

    A job that is not known any more is done with.
    """
    held = requests.distinct().join(jobs.select("job_id", "status"), "job_id", "left")
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    counts = held.groupBy("ticket").agg(F.count("*").alias("n_jobs"), n(*OPEN).alias("n_open"), n("failed").alias("n_failed"))
    return counts.withColumn("status", F.when(F.col("n_open") > 0, "pending").when(F.col("n_failed") > 0, "partial").otherwise("ready"))


def guard_precision(current: str, requested: str, force: bool = False) -> None:
    """Refuse an index run that would replace richer facts by poorer ones."""
    if not force and current in TIERS and TIERS.index(requested) < TIERS.index(current):
        raise ValueError(f"the index has tier {current}; a run with {requested} would lose facts (force to allow it)")


def incomplete_types(symbols: DataFrame) -> DataFrame:
    """``file_id`` of files with a brace-language type whose range is one line: their ranges are stale."""
    braces = ("c", "cpp", "csharp", "java", "javascript", "typescript", "kotlin", "rust", "go", "php")
    kinds = ("class", "struct", "interface", "enum", "trait")
    return symbols.where(F.col("language").isin(*braces) & F.col("kind").isin(*kinds) & (F.col("end_line") <= F.col("start_line"))).select("file_id").distinct()


def config_changed(contents: dict[str, bytes], known: str | None) -> tuple[str, bool]:
    """Hash of configuration files by name, and whether it differs from the ``known`` one (a first look is no change)."""
    digest = hashlib.sha256()
    for name in sorted(contents):
        digest.update(name.encode() + b"\xff" + hashlib.sha256(contents[name]).digest())
    return digest.hexdigest(), known is not None and digest.hexdigest() != known


def unresolved_hints(references: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """``name, n_calls, n_candidates``: calls without a target, and how many symbols have their name whatever the case."""
    open_ = references.where("kind = 'call'").join(resolved.select("reference_id").distinct(), "reference_id", "left_anti")
    calls = open_.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n_calls"))
    names = symbols.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"))
    return calls.join(names, "name", "left").select("name", "n_calls", F.coalesce("n", F.lit(0)).alias("n_candidates"))


def evidence(edges: DataFrame, nodes: DataFrame, subjects: DataFrame, direction: str = "incoming", kinds: tuple[str, ...] | None = None, most: int = 10) -> DataFrame:
    """``subject, other, name, path, kind, confidence``: the surest relations of each subject, at most ``most``."""
    own, other = ("target", "source") if direction == "incoming" else ("source", "target")
    some = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    held = some.select(F.col(own).alias("subject"), F.col(other).alias("other"), "kind", "confidence").join(subjects.select(F.col("symbol_id").alias("subject")).distinct(), "subject", "left_semi")
    order = Window.partitionBy("subject").orderBy(F.desc("confidence"), "other", "kind")
    top = held.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")
    return top.join(nodes.select(F.col("symbol_id").alias("other"), "name", "path"), "other").select("subject", "other", "name", "path", "kind", "confidence")


def context_view(edges: DataFrame, nodes: DataFrame, subjects: DataFrame, most: int = 10) -> DataFrame:
    """``subject, part, other, name``: callers, callees and peers of the same file of each subject, ``most`` of each part.

    Peers are the first symbols of the file but the subject itself, so a file's first ``most + 1`` hold all that any subject has.
    """
    calls = ("calls", "instantiates", "implements")
    parts = [evidence(edges, nodes, subjects, d, calls, most).select("subject", F.lit(part).alias("part"), "other", "name").distinct() for d, part in (("incoming", "callers"), ("outgoing", "callees"))]
    here = nodes.join(subjects.distinct(), "symbol_id", "left_semi").select(F.col("symbol_id").alias("subject"), "file_id")
    order = Window.partitionBy("subject").orderBy("other")
    first = nodes.select("file_id", F.col("symbol_id").alias("other"), "name").withColumn("__k", F.row_number().over(Window.partitionBy("file_id").orderBy("other"))).where(F.col("__k") <= most + 1).drop("__k")
    peers = here.join(first, "file_id").where("other <> subject").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    return parts[0].unionByName(parts[1]).unionByName(peers.select("subject", F.lit("peers").alias("part"), "other", "name"))


def to_markdown(title: str, tables: dict[str, DataFrame], most: int = 50) -> str:
    """Tables as Markdown, ``most`` rows of each."""
    lines = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        lines += ["| " + " | ".join(str("" if v is None else v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows[:most]]
        lines += ["", "More rows are left out."] * (len(rows) > most)
    return "\n".join(lines)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Every row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def checked_path(raw: str) -> str:
    """A path within the project with forward slashes and without empty or ``.`` parts; others are an error."""
    path = raw.strip().replace("\\", "/")
    if not path or re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path) or path.startswith("/") or re.match(r"[A-Za-z]:", path):
        raise ValueError(f"no path within the project: {raw!r}")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if ".." in parts or not parts:
        raise ValueError(f"no path within the project: {raw!r}")
    return "/".join(parts)


def simple_score(query: str, name: Column, qualified_name: Column) -> Column:
    """1 for the name, .9 for its start, .75 for a part of it, .6 for a part of the qualified name, else .35; case is ignored."""
    q = query.lower()
    low, whole = F.lower(name), F.lower(qualified_name)
    return F.when(low == q, 1.0).when(low.startswith(q), 0.9).when(low.contains(q), 0.75).when(whole.contains(q), 0.6).otherwise(0.35)


def access_base(path: Column) -> Column:
    """``a`` of the access paths ``a.b``, ``a->b``, ``a::b``, ``a?.b`` and ``a[0]``."""
    return F.regexp_extract(path, r"^(.[^.\[?:-]*(?:(?:-(?!>)|:(?!:)|\?(?!\.))[^.\[?:-]*)*)", 1)


def access_parent(path: Column) -> Column:
    """The access path without its last part; empty if it has one part."""
    return F.regexp_extract(path, r"^(.+?)(?:\.|->|::|\?\.|\[)[^.\[>:?]*\]?$", 1)


def scope_of(strategy: Column) -> Column:
    """Where a resolution of a strategy holds; ``boundary`` for unknown ones."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SCOPES.items() for x in p]), strategy), F.lit("boundary"))


def decoded_arguments(args_json: Column) -> Column:
    """Arguments of a call from their JSON text; null if it is no array."""
    return F.from_json(args_json, "array<struct<value:string,data_node_id:string,start_byte:int>>")

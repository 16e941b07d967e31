"""Queries of value flow, derived joins and index state, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.functions import resources
from weftgraph.operators import flow, graph, joins, resolve, state
from weftgraph.plans.registry import _CALL_SQL, _TEST_SQL, query

# --- value flow: a function is a user, its nodes that user's events in order ------------------

_CFG = """e AS (SELECT user_id AS f, event_id AS n, event_type AS k, value, lead(event_id) OVER w AS n1, lead(event_id, 2) OVER w AS n2, lead(event_id, 3) OVER w AS n3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
cfg AS (SELECT f, n AS s, n1 AS t, 'next' AS kind FROM e WHERE n1 IS NOT NULL UNION ALL SELECT f, n, n2, 'branch' FROM e WHERE k = 'click' AND n2 IS NOT NULL UNION ALL SELECT f, n, n3, 'exception' FROM e WHERE k = 'error' AND n3 IS NOT NULL)"""


def _cfg(x):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = x.table("events").select(F.col("user_id").alias("function_id"), F.col("event_id").alias("node"), F.col("event_type").alias("k"), *[F.lead("event_id", n).over(w).alias(f"n{n}") for n in (1, 2, 3)])
    parts = [e.where(c).select("function_id", F.col("node").alias("source"), F.col(f"n{n}").alias("target"), F.lit(kind).alias("kind")).where("target IS NOT NULL") for c, n, kind in ((F.lit(True), 1, "next"), (F.col("k") == "click", 2, "branch"), (F.col("k") == "error", 3, "exception"))]
    return e, parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "",
    f"""WITH RECURSIVE {_CFG},
d AS (SELECT f, n, n % 3 AS v, CASE WHEN n % 50 = 7 THEN NULL ELSE n END AS at, k = 'purchase' AS sure FROM e WHERE k IN ('purchase', 'signup')),
r AS (SELECT f, n, n % 3 AS v FROM e WHERE k = 'view'),
walk AS (SELECT r.n AS r, r.v, r.f, c.s AS n, c.kind = 'exception' AS x FROM r JOIN cfg c ON c.f = r.f AND c.t = r.n
 UNION SELECT w.r, w.v, w.f, c.s, c.kind = 'exception' FROM walk w JOIN cfg c ON c.f = w.f AND c.t = w.n
  WHERE w.x OR NOT EXISTS (SELECT 1 FROM d WHERE d.f = w.f AND d.v = w.v AND d.at = w.n AND d.sure))
SELECT DISTINCT d.n AS source, w.r AS target, 0.85::DOUBLE AS confidence FROM walk w JOIN d ON d.f = w.f AND d.v = w.v AND d.at = w.n
UNION SELECT d.n, r.n, 0.85::DOUBLE FROM d JOIN r ON d.f = r.f AND d.v = r.v WHERE d.at IS NULL""",
)
def reaching_definitions(x):
    e, edges = _cfg(x)
    rows = e.select("function_id", "node", "k", (F.col("node") % 3).alias("variable"))
    definitions = rows.where("k IN ('purchase', 'signup')").select(F.col("node").alias("definition_id"), "function_id", "variable", F.when(F.col("node") % 50 != 7, F.col("node")).alias("node"), F.lit(0).alias("ord"), (F.col("k") == "purchase").alias("definite"))
    reads = rows.where("k = 'view'").select(F.col("node").alias("read_id"), "function_id", "variable", "node", F.lit(0).alias("ord"))
    return flow.reaching_definitions(definitions, reads, edges)


@query(
    "",
    """SELECT source, target, kind, call_id, 0.67::DOUBLE AS confidence FROM (
SELECT DISTINCT l_partkey AS source, l_suppkey AS target, 'arg_to_param' AS kind, CAST(l_orderkey AS VARCHAR) AS call_id FROM lineitem WHERE l_returnflag = 'A'
UNION SELECT l_suppkey, l_partkey, 'return_to_call', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'N'
UNION SELECT l_partkey, l_partkey + l_suppkey, 'state_flow', NULL FROM lineitem WHERE l_returnflag = 'R') t""",
)
def virtual_edges(x):
    t = x.table("lineitem")
    of = lambda f: t.where(F.col("l_returnflag") == f)
    return flow.virtual_edges(
        of("A").select(F.col("l_orderkey").alias("callsite_id"), F.col("l_partkey").alias("argument"), F.col("l_suppkey").alias("parameter")),
        of("N").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("call_id")),
        of("R").select(F.col("l_partkey").alias("source"), (F.col("l_partkey") + F.col("l_suppkey")).alias("target")),
    )


@query(
    "cg_files cg_symbols cg_edges",
    """WITH h AS (SELECT e.source AS s, e.target AS t, max(e.confidence * CASE WHEN a.file_id <> b.file_id THEN 0.92 ELSE 1.0 END) AS c FROM cg_edges e LEFT JOIN cg_symbols a ON a.symbol_id = e.source LEFT JOIN cg_symbols b ON b.symbol_id = e.target GROUP BY 1, 2),
w AS (SELECT k AS sink, k AS node, 1.0::DOUBLE AS c, 0 AS step FROM (SELECT unnest(range(0, 10)) AS k) x
 UNION SELECT w.sink, h.s, round(w.c * h.c, 9), w.step + 1 FROM w JOIN h ON h.t = w.node WHERE w.step < 3 AND round(w.c * h.c, 9) >= 0.5)
SELECT sink, node, max(c) AS confidence FROM w GROUP BY sink, node""",
    recursive=True,
)
def value_flow(x):
    sinks = x.spark.createDataFrame([(k,) for k in range(10)], "sink long")
    functions = x.symbols.select(F.col("symbol_id").alias("node_id"), F.col("file_id").alias("function_id"))
    return flow.value_flow(sinks, x.edges.select("source", "target", "confidence"), functions, 3, 0.5).select("sink", "node", "confidence")


@query("cg_effects", "SELECT function_id, ord % 9 AS place, count(DISTINCT effect_id) FILTER (WHERE effect IN ('store', 'alloc', 'nullify')) AS n_writes, count(DISTINCT effect_id) FILTER (WHERE effect = 'free') AS n_frees FROM cg_effects WHERE effect <> 'call' GROUP BY 1, 2")
def transfer_graph(x):
    effects = x.effects.select("function_id", (F.col("ord") % 9).alias("place"), F.col("effect_id").alias("node_id"), "effect")
    return flow.transfer_graph(effects).select("function_id", "place", F.col("n_writes").cast("long"), F.col("n_frees").cast("long"))


@query(
    "cg_effects",
    """WITH o AS (SELECT DISTINCT function_id, ord % 4 AS place, effect FROM cg_effects WHERE effect <> 'call'),
c AS (SELECT DISTINCT function_id AS caller, function_id * 3 % 150 AS callee, ord % 4 AS param, (ord + 1) % 4 AS arg FROM cg_effects WHERE effect = 'call'),
w AS (SELECT function_id, place, effect FROM o UNION SELECT c.caller, c.arg, w.effect FROM w JOIN c ON c.callee = w.function_id AND c.param = w.place)
SELECT w.function_id, w.place, w.effect, o.effect IS NOT NULL AS own FROM w LEFT JOIN o ON o.function_id = w.function_id AND o.place = w.place AND o.effect = w.effect""",
    recursive=True,
)
def composed_effects(x):
    own = x.effects.where("effect <> 'call'").select("function_id", (F.col("ord") % 4).alias("place"), "effect")
    calls = x.effects.where("effect = 'call'").select("function_id", (F.col("function_id") * 3 % 150).alias("callee"), (F.col("ord") % 4).alias("parameter"), ((F.col("ord") + 1) % 4).alias("argument"))
    return flow.composed_effects(own, calls)


@query("cg_effects", "SELECT function_id, string_agg(DISTINCT place, ',' ORDER BY place) AS fields FROM (SELECT function_id, 'p' || ord % 9 AS place FROM cg_effects WHERE effect <> 'call') t GROUP BY function_id")
def touched_fields(x):
    effects = x.effects.where("effect <> 'call'").select("function_id", F.concat(F.lit("p"), F.col("ord") % 9).alias("place"), "effect")
    return flow.touched_fields(effects).select("function_id", F.array_join("fields", ",").alias("fields"))


@query(
    "cg_effects",
    """WITH t AS (SELECT function_id, max(ord) AS top, max(effect_id) AS x FROM cg_effects GROUP BY 1)
SELECT e.function_id, CASE WHEN effect = 'free' THEN x ELSE effect_id END AS node_id, CASE WHEN effect = 'free' THEN 2 * top + 1 - ord ELSE ord END AS ord, effect FROM cg_effects e JOIN t ON t.function_id = e.function_id""",
)
def lowered_defers(x):
    effects = x.effects.select("function_id", F.col("effect_id").alias("node_id"), "ord", "effect", F.lit("p").alias("place"), (F.col("effect") == "free").alias("deferred"))
    exits = x.effects.groupBy("function_id").agg(F.max("effect_id").alias("node_id"))
    return flow.lowered_defers(effects, exits).drop("place")


@query()
def required_branches(x):
    e, edges = _cfg(x)
    first = Window.partitionBy("function_id").orderBy("node")
    nodes = e.select("function_id", F.col("node").alias("node_id"), F.when(F.row_number().over(first) == 1, "entry").otherwise("statement").alias("kind"))
    return flow.required_branches(nodes, edges, e.groupBy("function_id").agg(F.max("node").alias("node_id")))


@query()
def branch_frames(x):
    e, edges = _cfg(x)
    return flow.branch_frames(e.select("function_id", F.col("node").alias("node_id")), edges)


@query(
    "cg_effects cg_edges",
    """SELECT i.node AS function_id, i.depth, p.verdict, p.n_flags, coalesce(d.n, 0) AS n_issues FROM (SELECT target AS node, min(source % 5) AS depth FROM cg_edges GROUP BY 1) i
JOIN (SELECT function_id, CASE WHEN count(*) FILTER (WHERE effect = 'free') > 9 THEN 'suspicious' ELSE 'safe' END AS verdict, count(*) FILTER (WHERE effect = 'free') AS n_flags FROM cg_effects GROUP BY 1) p ON p.function_id = i.node
LEFT JOIN (SELECT function_id, count(*) AS n FROM cg_effects WHERE effect = 'nullify' GROUP BY 1) d ON d.function_id = i.node""",
)
def semantic_impact(x):
    impacted = x.edges.select(F.col("target").alias("node"), (F.col("source") % 5).alias("depth"))
    n = F.count(F.when(F.col("effect") == "free", 1))
    proofs = x.effects.groupBy("function_id").agg(F.when(n > 9, "suspicious").otherwise("safe").alias("verdict"), n.alias("n_flags"))
    return flow.semantic_impact(impacted, proofs, x.effects.where("effect = 'nullify'").select("function_id", F.col("effect").alias("issue")))


@query(
    "cg_effects",
    "SELECT function_id, branch_id, severity, row_number() OVER (PARTITION BY function_id ORDER BY CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, confidence DESC, branch_id) AS place FROM (SELECT function_id, ord AS branch_id, CASE effect WHEN 'free' THEN 'high' WHEN 'alloc' THEN 'medium' WHEN 'store' THEN 'low' ELSE 'info' END AS severity, ord % 10 / 10.0 AS confidence FROM cg_effects) t",
)
def sorted_issues(x):
    severity = F.when(F.col("effect") == "free", "high").when(F.col("effect") == "alloc", "medium").when(F.col("effect") == "store", "low").otherwise("info")
    rows = x.effects.select("function_id", F.col("ord").alias("branch_id"), F.lit("r").alias("resource"), severity.alias("severity"), (F.col("ord") % 10 / 10).alias("confidence"))
    return flow.sorted_issues(rows).select("function_id", "branch_id", "severity", F.col("place").cast("long"))


# --- derived joins ----------------------------------------------------------------------------


@query(
    "cg_files cg_symbols cg_refs",
    """SELECT DISTINCT decorator AS source, symbol_id AS target FROM (SELECT r.reference_id, r.source_symbol AS decorator, s.symbol_id, row_number() OVER (PARTITION BY r.reference_id ORDER BY s.end_byte - s.start_byte, s.symbol_id) AS n
 FROM (SELECT reference_id, source_symbol, pos % 200000 AS pos, pos % 200000 // 100 % (SELECT count(*) FROM cg_files) AS file_id FROM cg_refs) r JOIN cg_symbols s ON s.file_id = r.file_id AND r.pos BETWEEN s.start_byte AND s.end_byte WHERE s.kind IN ('function', 'method', 'class')) t WHERE n = 1 AND decorator <> symbol_id""",
)
def decorator_edges(x):
    n = x.files.agg(F.count("*").alias("n"))
    pos = F.col("pos") % 200000
    refs = x.refs.crossJoin(F.broadcast(n)).select(F.col("source_symbol").alias("decorator"), pos.alias("pos"), (F.floor(pos / 100) % F.col("n")).alias("file_id"))
    return joins.decorator_edges(refs, x.symbols).select("source", "target")


@query(
    "cg_files cg_symbols",
    "SELECT DISTINCT s.symbol_id FROM cg_symbols s JOIN (SELECT file_id, symbol_id * 100 AS pos FROM cg_symbols WHERE name = (SELECT min(name) FROM cg_symbols)) d ON d.file_id = s.file_id AND d.pos BETWEEN s.start_byte AND s.end_byte WHERE s.kind IN ('function', 'method', 'class') AND s.language = 'go'",
)
def decorated_symbols(x):
    name = x.symbols.agg(F.min("name")).first()[0]
    decorations = x.symbols.select("name", "file_id", (F.col("symbol_id") * 100).alias("pos"))
    return joins.decorated_symbols(decorations, x.symbols, "@" + name, language="go")


@query("cg_files cg_symbols cg_refs", "SELECT symbol_id, least(start_byte, coalesce((SELECT min(r.pos) FROM cg_refs r WHERE r.target = s.symbol_id), start_byte)) AS start_byte FROM cg_symbols s")
def extended_ranges(x):
    return joins.extended_ranges(x.symbols.select("symbol_id", "start_byte"), x.refs.select(F.col("target").alias("symbol_id"), F.col("pos").alias("start_byte")))


@query(
    "cg_files cg_symbols cg_refs",
    "SELECT DISTINCT s.symbol_id AS source, r.reference_id AS target, r.reference_id AS call_id FROM cg_refs r JOIN cg_symbols s ON s.file_id = r.target % 100 WHERE r.kind = 'call' AND s.kind = 'variable'",
)
def call_results(x):
    calls = x.refs.where("kind = 'call'")
    return joins.call_results(calls.select(F.col("reference_id").alias("node_id"), F.col("reference_id").alias("call_id")), calls.select(F.col("reference_id").alias("call_id"), (F.col("target") % 100).alias("callee")), x.symbols.where("kind = 'variable'").select(F.col("symbol_id").alias("node_id"), F.col("file_id").alias("function_id")))


@query(
    "cg_files cg_symbols cg_edges",
    """WITH f AS (SELECT file_id, name, min(symbol_id) AS symbol_id FROM cg_symbols WHERE kind = 'function' GROUP BY 1, 2),
w AS (SELECT symbol_id AS node_id, symbol_id AS p, 0 AS depth FROM cg_symbols WHERE kind = 'variable'
 UNION SELECT w.node_id, e.source, w.depth + 1 FROM w JOIN cg_edges e ON e.target = w.p AND e.kind = 'references' WHERE w.depth < 2),
l AS (SELECT node_id, p, min(depth) AS depth FROM w GROUP BY 1, 2)
SELECT node_id, symbol_id, depth FROM (SELECT l.node_id, f.symbol_id, l.depth, row_number() OVER (PARTITION BY l.node_id ORDER BY l.depth, f.symbol_id) AS n FROM l JOIN cg_symbols s ON s.symbol_id = l.p JOIN f ON f.file_id = s.file_id AND f.name = s.name WHERE l.depth > 0) t WHERE n = 1""",
    recursive=True,
)
def function_pointers(x):
    nodes = x.symbols.select(F.col("symbol_id").alias("node_id"), "file_id", "name")
    functions = x.symbols.where("kind = 'function'").groupBy("file_id", "name").agg(F.min("symbol_id").alias("symbol_id"))
    back = x.edges.where("kind = 'references'").select("source", "target", F.lit("assign").alias("kind"))
    return joins.function_pointers(x.symbols.where("kind = 'variable'").select(F.col("symbol_id").alias("node_id")), back, nodes, functions, 2)


@query("", "SELECT DISTINCT w.p_partkey AS source, r.s_suppkey AS target, r.k AS key FROM (SELECT s_suppkey, 'key' || s_suppkey % 50 AS k FROM supplier) r JOIN (SELECT p_partkey, 'key' || p_partkey % 60 AS k FROM part) w ON w.k = r.k")
def state_channels(x):
    readers = x.table("supplier").select(F.col("s_suppkey").alias("node_id"), F.concat(F.lit(" 'key"), F.col("s_suppkey") % 50, F.lit("' ")).alias("key"))
    writers = x.table("part").select(F.col("p_partkey").alias("node_id"), F.concat(F.lit('"key'), F.col("p_partkey") % 60, F.lit('"')).alias("key"))
    return joins.state_channels(readers, writers)


@query(
    "cg_files cg_symbols cg_refs",
    """WITH r AS (SELECT file_id, pos, min(reference_id) AS reference_id FROM cg_refs WHERE kind = 'call' GROUP BY 1, 2 HAVING count(*) = 1),
o AS (SELECT r.reference_id, s.symbol_id FROM (SELECT file_id, pos, target FROM cg_refs) c JOIN r ON r.file_id = c.file_id AND r.pos = c.pos JOIN cg_symbols s ON s.symbol_id = c.target)
SELECT reference_id, min(symbol_id) AS symbol_id FROM (SELECT DISTINCT * FROM o) t GROUP BY 1 HAVING count(*) = 1""",
)
def observed_calls(x):
    place = [F.col("file_id").cast("string").alias("path"), F.col("pos").alias("start_byte"), (F.col("pos") + 3).alias("end_byte")]
    seen = x.refs.select(*place, "target").join(x.symbols.select(F.col("symbol_id").alias("target"), F.col("path").alias("callee_path"), F.col("start_byte").alias("callee_start")), "target").drop("target")
    return joins.observed_calls(seen, x.refs.select("reference_id", "kind", *place), x.symbols.select("symbol_id", "path", "start_byte"))


@query(
    "cg_files cg_symbols",
    """WITH n AS (SELECT DISTINCT name, regexp_replace(path, '/[^/]*$', '') AS folder FROM cg_symbols), q AS (SELECT DISTINCT substring(name, 2, 100) AS query, folder FROM n),
p AS (SELECT q.query, q.folder, n.name, n.folder AS name_folder, levenshtein(lower(q.query), lower(n.name)) AS distance, q.folder = n.folder OR starts_with(q.folder, n.folder || '/') OR starts_with(n.folder, q.folder || '/') AS nearby
 FROM q JOIN n ON levenshtein(lower(q.query), lower(n.name)) <= 2),
m AS (SELECT *, bool_or(nearby) OVER (PARTITION BY query, folder) AS any_near FROM p)
SELECT query, folder, name, name_folder, distance, nearby FROM (SELECT *, row_number() OVER (PARTITION BY query, folder ORDER BY distance, name, name_folder) AS n FROM m WHERE nearby = any_near) t WHERE n <= 20""",
)
def fuzzy_nearby(x):
    folder = joins.place_columns(F.col("path"))["folder"].alias("folder")
    return joins.fuzzy_nearby(x.symbols.select(F.substring("name", 2, 100).alias("query"), folder), x.symbols.select("name", folder))


@query(
    "cg_files cg_symbols cg_refs",
    f"""WITH i AS (SELECT DISTINCT r.file_id, r.name, CASE WHEN r.reference_id % 2 = 0 THEN s.file_id ELSE -1 END AS target_file FROM cg_refs r JOIN cg_symbols s ON s.symbol_id = r.target WHERE r.kind = 'type'),
c AS (SELECT r.reference_id, r.file_id, r.name, s.symbol_id, s.file_id AS sf, f.path AS rp, s.path AS sp, CASE WHEN regexp_replace(f.path, '/[^/]*$', '') = regexp_replace(s.path, '/[^/]*$', '') THEN 0 WHEN split_part(f.path, '/', 1) = split_part(s.path, '/', 1) THEN 1 ELSE 2 END AS tier,
 NOT {_TEST_SQL.replace("path", "s.path")} OR {_TEST_SQL.replace("path", "f.path")} AS ok FROM cg_refs r JOIN cg_files f ON f.file_id = r.file_id JOIN cg_symbols s ON s.name = r.name),
own AS (SELECT reference_id, min(symbol_id) AS symbol_id FROM c WHERE sf = file_id GROUP BY 1),
imp AS (SELECT c.reference_id, min(c.symbol_id) AS symbol_id FROM c JOIN i ON i.file_id = c.file_id AND i.name = c.name AND i.target_file = c.sf WHERE c.reference_id NOT IN (SELECT reference_id FROM own) GROUP BY 1),
glo AS (SELECT reference_id, symbol_id FROM (SELECT c.reference_id, c.symbol_id, row_number() OVER (PARTITION BY c.reference_id ORDER BY c.tier, c.symbol_id) AS n FROM c WHERE ok AND c.reference_id NOT IN (SELECT reference_id FROM own) AND NOT EXISTS (SELECT 1 FROM i WHERE i.file_id = c.file_id AND i.name = c.name)) t WHERE n = 1)
SELECT reference_id, symbol_id, 1.0::DOUBLE AS confidence, 'same_file' AS strategy FROM own UNION ALL SELECT reference_id, symbol_id, 0.8::DOUBLE, 'import' FROM imp UNION ALL SELECT reference_id, symbol_id, 1.0::DOUBLE, 'exact_name' FROM glo""",
)
def resolve_rows(x):
    refs = x.refs.select("reference_id", "file_id", "name", "kind").join(x.files, "file_id")
    some = x.refs.where("kind = 'type'").join(x.symbols.select(F.col("symbol_id").alias("target"), F.col("file_id").alias("there")), "target")
    imports = some.select("file_id", "name", F.when(F.col("reference_id") % 2 == 0, F.col("there")).otherwise(F.lit(-1)).alias("target_file")).distinct()
    return resolve.resolve(refs, x.symbols, imports)


@query(
    "cg_files cg_symbols cg_refs",
    "SELECT r.reference_id, min(s.symbol_id) AS symbol_id FROM cg_refs r JOIN cg_symbols s ON s.file_id = r.file_id AND s.name = r.name WHERE r.file_id IN (SELECT file_id FROM cg_files WHERE language = 'rust') AND r.kind = 'call' GROUP BY 1",
)
def resolve_files(x):
    refs = x.refs.select("reference_id", "file_id", "name", "kind").join(x.files, "file_id")
    done = state.resolve_files(refs, x.symbols, None, x.files.where("language = 'rust'"), ("call",))
    return done.where("strategy = 'same_file'").select("reference_id", "symbol_id")


_WEIGHT = f"greatest(1.0, 1.0 + CASE WHEN e.kind = 'instantiates' THEN 1.0 ELSE 0.0 END + (1 - e.confidence) / 2 + CASE WHEN e.provenance = 'heuristic' THEN 0.3 ELSE 0.0 END + CASE WHEN {_TEST_SQL.replace('path', 's.path')} THEN 0.5 ELSE 0.0 END)"


def _costs(extra: str, where: str) -> str:
    return f"""WITH h AS (SELECT e.source, e.target, min({_WEIGHT}{extra}) AS weight FROM cg_edges e JOIN cg_symbols s ON e.target = s.symbol_id WHERE e.{_CALL_SQL}{where} GROUP BY 1, 2),
w AS (SELECT symbol_id AS seed, symbol_id AS node, 0.0::DOUBLE AS cost, 0 AS step FROM cg_symbols WHERE symbol_id < 10 UNION SELECT seed, h.target, round(cost + weight, 9), step + 1 FROM w JOIN h ON h.source = node WHERE step < 3)
SELECT seed, node, round(min(cost), 6) AS cost FROM w GROUP BY seed, node"""


@query("cg_files cg_symbols cg_edges", _costs(f" + CASE WHEN {_TEST_SQL.replace('path', 's.path')} THEN 5.0 ELSE 0.0 END", ""), recursive=True)
def production_paths(x):
    edges = graph.production_edges(graph.weighted(x.edges, x.symbols), x.symbols)
    return graph.shortest_costs(edges, x.symbols.where("symbol_id < 10"), 3).select("seed", "node", F.round("cost", 6).alias("cost"))


@query("cg_files cg_symbols cg_edges", _costs("", " AND NOT EXISTS (SELECT 1 FROM cg_refs r WHERE r.source_symbol = e.source AND r.target = e.target) AND e.source % 4 <> 1").replace(" AND NOT EXISTS (SELECT 1 FROM cg_refs r WHERE r.source_symbol = e.source AND r.target = e.target)", ""), recursive=True)
def paths_without_edges(x):
    gone = x.edges.where("source % 4 = 1").select("source", "target")
    edges = graph.without_edges(graph.weighted(x.edges, x.symbols), gone)
    return graph.shortest_costs(edges, x.symbols.where("symbol_id < 10"), 3).select("seed", "node", F.round("cost", 6).alias("cost"))


# --- index state ------------------------------------------------------------------------------


@query("", "SELECT user_id AS file_id, event_type AS layer, max(event_id) AS generation FROM events GROUP BY 1, 2")
def latest_states(x):
    return state.newest(x.table("events").select(F.col("user_id").alias("file_id"), F.col("event_type").alias("layer"), F.col("event_id").alias("generation")), ["file_id", "layer"], "generation")


@query("cg_state", "SELECT file_id, layer, CASE WHEN file_id % 4 = 0 THEN 'stale' ELSE status END AS status FROM cg_state WHERE file_id % 9 <> 0")
def put_states(x):
    table = x.state.select("file_id", "layer", "status")
    rows = table.where("file_id % 4 = 0").withColumn("status", F.lit("stale"))
    return state.drop(state.put(table, rows, ["file_id", "layer"]), table.where("file_id % 9 = 0").select("file_id"))


@query("cg_state", "SELECT count(*) AS n_units, count(*) FILTER (WHERE status = 'fresh') AS n_fresh, count(*) FILTER (WHERE status = 'stale') AS n_stale, count(DISTINCT scope) AS n_files, CAST(sum(mask) AS BIGINT) AS n_nodes, CAST(sum(file_id) AS BIGINT) AS n_edges FROM cg_state")
def lazy_stats(x):
    return state.lazy_stats(x.state.select(F.col("scope").alias("file_id"), F.col("file_id").alias("unit_id"), "status", F.col("mask").cast("long").alias("node_count"), F.col("file_id").alias("edge_count")))


@query(
    "",
    """WITH c AS (SELECT * FROM (SELECT o_custkey % 20 AS closure_id, o_orderkey % 500 AS file_id, o_orderkey AS generation, o_orderkey % 3 AS h, row_number() OVER (PARTITION BY o_custkey % 20, o_orderkey % 500 ORDER BY o_orderkey DESC) AS n FROM orders) t WHERE n = 1)
SELECT file_id FROM c WHERE closure_id = 3 AND h = file_id % 3""",
)
def covered_files(x):
    rows = x.table("orders").select((F.col("o_custkey") % 20).cast("string").alias("closure_id"), (F.col("o_orderkey") % 500).alias("file_id"), F.lit("s").alias("source"), F.col("o_orderkey").alias("generation"), (F.col("o_orderkey") % 3).cast("string").alias("content_hash"))
    table = state.cover(rows.where("generation % 2 = 0"), rows.where("generation % 2 = 1"))
    hashes = rows.select("file_id", (F.col("file_id") % 3).cast("string").alias("content_hash")).distinct()
    return state.covered_files(table, "3", hashes)


@query("cg_files cg_symbols", "SELECT name, file_id, max(start_byte) / 100.0 AS confidence FROM cg_symbols GROUP BY name, file_id")
def added_hints(x):
    rows = x.symbols.select("name", "file_id", "kind", F.col("start_byte").cast("int").alias("line"), (F.col("start_byte") / 100).alias("confidence"), F.lit("scan").alias("source"))
    return state.add_hints(rows.where("line % 2 = 0"), rows.where("line % 300 = 0 OR line % 2 = 1").unionByName(rows)).select("name", "file_id", "confidence")


@query("cg_edges", "SELECT source, target, kind, max(confidence) AS confidence FROM cg_edges GROUP BY source, target, kind")
def added_candidates(x):
    rows = x.edges.select("source", "target", "kind", "confidence")
    return state.add_candidates(rows.withColumn("confidence", F.col("confidence") - 0.5), rows)


@query("", "SELECT sha256(encode('c') || '\\xFF'::BLOB || encode('alloc') || '\\xFF'::BLOB || encode('exact') || '\\xFF'::BLOB || encode(p_name)) AS rule_id, p_name AS pattern, max(p_size) / 100.0 AS confidence FROM part GROUP BY p_name")
def put_rules(x):
    rows = x.table("part").select(F.lit("").alias("rule_id"), F.lit("c").alias("language"), F.lit("alloc").alias("rule_kind"), F.col("p_name").alias("pattern"), F.lit("exact").alias("pattern_kind"), F.lit("user").alias("source"), F.lit("enabled").alias("status"), (F.col("p_size") / 100).alias("confidence"))
    old = rows.where("pattern < 'm'").withColumn("rule_id", state.rule_id(F.col("language"), F.col("rule_kind"), F.col("pattern_kind"), F.col("pattern"))).withColumn("confidence", F.lit(0.0)).distinct()
    return state.list_rules(state.put_rules(old, rows), "c", "alloc").select("rule_id", "pattern", "confidence")


@query("cg_files cg_symbols", "SELECT DISTINCT symbol_id % 100 AS source_symbol, name AS field_name, file_id AS target_symbol, CASE WHEN symbol_id % 2 = 0 THEN 2 ELSE 1 END AS generation FROM cg_symbols WHERE symbol_id % 2 = 0 OR NOT EXISTS (SELECT 1 FROM cg_symbols o WHERE o.symbol_id % 2 = 0 AND o.symbol_id % 100 = cg_symbols.symbol_id % 100 AND o.name = cg_symbols.name AND o.file_id = cg_symbols.file_id)")
def put_annotations(x):
    rows = x.symbols.select("symbol_id", (F.col("symbol_id") % 100).alias("source_symbol"), F.col("name").alias("field_name"), F.col("file_id").alias("target_symbol"))
    table = rows.drop("symbol_id").distinct().withColumn("generation", F.lit(1))
    return state.put_annotations(table, rows.where("symbol_id % 2 = 0").drop("symbol_id"), 2)


@query("", "SELECT l_partkey AS file_id, l_suppkey AS depends_on, CASE WHEN bool_or(l_returnflag = 'A') THEN 'edges' ELSE 'manifest' END AS source FROM lineitem GROUP BY 1, 2")
def merged_dependencies(x):
    rows = x.table("lineitem").select(F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("depends_on"), "l_returnflag")
    return state.merged_dependencies(rows.where("l_returnflag = 'A'"), rows)


@query(
    "cg_files cg_symbols cg_refs",
    """WITH m AS (SELECT r.source_symbol AS source, r.target, CASE WHEN r.kind IN ('call', 'instantiation') THEN CASE WHEN s.kind IN ('class', 'struct') THEN 'instantiates' WHEN s.kind IN ('function', 'method') THEN 'calls' END WHEN r.kind = 'inheritance' THEN 'extends' ELSE 'references' END AS kind, max(r.reference_id % 10 / 10.0) AS c
 FROM cg_refs r JOIN cg_symbols s ON s.symbol_id = r.target WHERE r.reference_id % 4 = 1 AND r.source_symbol IN (SELECT symbol_id FROM cg_symbols) GROUP BY 1, 2, 3),
k AS (SELECT * FROM m WHERE kind IS NOT NULL), f AS (SELECT source, kind, count(DISTINCT target) AS fan FROM k GROUP BY 1, 2)
SELECT k.source, k.target, k.kind, CASE WHEN fan > 20 THEN 'candidate' WHEN c >= 0.75 THEN 'canonical' ELSE 'candidate' END AS decision FROM k JOIN f ON f.source = k.source AND f.kind = k.kind""",
)
def focus_graph(x):
    resolutions = x.refs.select("reference_id", (F.col("reference_id") % 4).alias("closure_id"), F.lit(1).alias("generation"), "target", (F.col("reference_id") % 10 / 10).alias("confidence"), F.lit(True).alias("is_visible"))
    symbols = x.symbols.select("symbol_id", "kind", F.lit(None).cast("long").alias("container_id"))
    none = x.spark.createDataFrame([], "source long, target long, kind string, confidence double, band string, coverage string")
    return state.focus_graph(resolutions, x.refs.select("reference_id", "source_symbol", "kind"), symbols, none, 1, 1).select("source", "target", "kind", "decision")


@query("cg_edges", "WITH w AS (SELECT unnest([1, 2, 3]) AS file_id UNION SELECT target FROM w JOIN cg_edges e ON e.source = w.file_id AND e.kind = 'instantiates') SELECT file_id FROM w", recursive=True)
def plan_dependencies(x):
    imports = x.edges.where("kind = 'instantiates'").select(F.col("source").alias("file_id"), F.col("target").alias("target_file"))
    return state.plan_dependencies(imports, x.spark.createDataFrame([(1,), (2,), (3,)], "file_id long"))


@query(
    "cg_files cg_symbols cg_edges",
    f"""WITH w AS (SELECT symbol_id AS unit_id, 0 AS d FROM cg_symbols WHERE symbol_id IN (5, 9) UNION SELECT target, d + 1 FROM w JOIN cg_edges e ON e.source = w.unit_id AND e.{_CALL_SQL} WHERE d < 2)
SELECT unit_id, min(d) AS distance FROM w GROUP BY unit_id ORDER BY distance, unit_id LIMIT 100""",
    recursive=True,
)
def lazy_window(x):
    units = x.symbols.select(F.col("symbol_id").alias("unit_id"), "file_id", "start_byte", "end_byte")
    at = x.symbols.where("symbol_id IN (5, 9)").select("file_id", F.col("start_byte").alias("pos"))
    return state.lazy_window(units, x.edges.where(F.col("kind").isin("calls", "instantiates", "implements")), at)


@query("cg_files cg_symbols", "SELECT DISTINCT file_id FROM cg_symbols WHERE language IN ('c', 'go', 'rust') AND kind IN ('class', 'struct') AND start_byte % 300 = 0")
def incomplete_types(x):
    line = F.col("start_byte").cast("int")
    return state.incomplete_types(x.symbols.select("file_id", "kind", "language", line.alias("start_line"), F.when(line % 300 == 0, line).otherwise(line + 5).alias("end_line")))


@query("cg_files cg_symbols cg_refs", "SELECT r.name, r.n AS n_calls, coalesce(s.n, 0) AS n_candidates FROM (SELECT lower(name) AS name, count(*) AS n FROM cg_refs WHERE kind = 'call' AND reference_id % 3 <> 0 GROUP BY 1) r LEFT JOIN (SELECT lower(name) AS name, count(*) AS n FROM cg_symbols GROUP BY 1) s ON s.name = r.name")
def unresolved_hints(x):
    return state.unresolved_hints(x.refs, x.refs.where("reference_id % 3 = 0"), x.symbols)


@query(
    "cg_files cg_symbols cg_edges",
    "SELECT subject, other, name, kind, confidence FROM (SELECT e.target AS subject, e.source AS other, kind, confidence, row_number() OVER (PARTITION BY e.target ORDER BY confidence DESC, e.source, kind) AS n FROM cg_edges e WHERE e.target IN (SELECT symbol_id FROM cg_symbols)) t JOIN (SELECT symbol_id, name FROM cg_symbols) s ON s.symbol_id = t.other WHERE n <= 10",
)
def relation_evidence(x):
    return state.evidence(x.edges, x.symbols, x.symbols.select("symbol_id")).drop("path")


@query(
    "cg_files cg_symbols cg_edges",
    f"""WITH e AS (SELECT target AS subject, source AS other, kind, confidence, 'callers' AS part FROM cg_edges WHERE {_CALL_SQL} UNION ALL SELECT source, target, kind, confidence, 'callees' FROM cg_edges WHERE {_CALL_SQL}),
t AS (SELECT subject, part, other FROM (SELECT *, row_number() OVER (PARTITION BY subject, part ORDER BY confidence DESC, other, kind) AS n FROM e WHERE subject IN (SELECT symbol_id FROM cg_symbols)) x WHERE n <= 10),
p AS (SELECT subject, 'peers' AS part, other FROM (SELECT a.symbol_id AS subject, b.symbol_id AS other, row_number() OVER (PARTITION BY a.symbol_id ORDER BY b.symbol_id) AS n FROM cg_symbols a JOIN cg_symbols b ON a.file_id = b.file_id AND a.symbol_id <> b.symbol_id) x WHERE n <= 10)
SELECT DISTINCT u.subject, u.part, u.other, s.name FROM (SELECT * FROM t UNION ALL SELECT * FROM p) u JOIN cg_symbols s ON s.symbol_id = u.other""",
)
def context_view(x):
    return state.context_view(x.edges, x.symbols, x.symbols.select("symbol_id"))


@query("cg_files", "SELECT '{\"file_id\":' || file_id || ',\"path\":\"' || path || '\"}' AS json FROM cg_files")
def json_rows(x):
    return state.to_json_rows(x.files.select("file_id", "path"))


@query("cg_files cg_symbols", "SELECT symbol_id, CAST(CASE WHEN name = 'red' THEN 1.0 WHEN starts_with(name, 'red') THEN 0.9 WHEN contains(name, 'red') THEN 0.75 WHEN contains(lower(qualified_name), 'red') THEN 0.6 ELSE 0.35 END AS DOUBLE) AS score FROM cg_symbols")
def simple_scores(x):
    return x.symbols.select("symbol_id", state.simple_score("RED", F.col("name"), F.col("qualified_name")).alias("score"))


@query("", "SELECT p_partkey, 'a-b' || p_partkey AS base, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE 'a-b' || p_partkey END AS parent FROM part")
def access_parts(x):
    k = F.col("p_partkey") % 5
    tail = F.when(k == 0, ".f").when(k == 1, "->f").when(k == 2, "::f").when(k == 3, "[0]").otherwise("")
    path = F.concat(F.lit("a-b"), F.col("p_partkey"), tail)
    return x.table("part").select("p_partkey", state.access_base(path).alias("base"), state.access_parent(path).alias("parent"))


@query("", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'closure_complete' ELSE 'boundary' END AS scope FROM events")
def resolution_scopes(x):
    strategy = F.when(F.col("event_type") == "click", "exact_name").when(F.col("event_type") == "view", "import").when(F.col("event_type") == "error", "fuzzy").otherwise("unknown")
    return x.table("events").select("event_id", state.scope_of(strategy).alias("scope"))


@query("", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value, 7 AS start_byte FROM events")
def decoded_arguments(x):
    text = F.concat(F.lit('[{"value":"'), F.get_json_object("props", "$.k"), F.lit('","start_byte":7}]'))
    args = state.decoded_arguments(text)
    return x.table("events").select("event_id", args[0]["value"].alias("value"), args[0]["start_byte"].alias("start_byte"))


# --- jobs, tickets, focus and resources --------------------------------------------------------

_JOBS_SQL = """j AS (SELECT o_orderkey AS job_id, o_custkey AS file_id, o_orderpriority AS layer, 5 - CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS priority,
 CASE WHEN o_orderkey > 100 AND o_orderpriority = '2-HIGH' THEN o_orderkey - o_orderkey % 100 END AS depends_on, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'building' ELSE 'complete' END AS status FROM orders)"""


def _jobs(x):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    waits = F.when((key > 100) & (F.col("o_orderpriority") == "2-HIGH"), key - key % 100)
    state_ = F.when(status == "O", "queued").when(status == "P", "building").otherwise("complete")
    return x.table("orders").select(key.alias("job_id"), F.col("o_custkey").alias("file_id"), F.lit(None).cast("string").alias("unit_id"), F.col("o_orderpriority").alias("layer"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), waits.alias("depends_on"), state_.alias("status"), F.lit(None).cast("string").alias("error"))


@query("", f"WITH {_JOBS_SQL} SELECT job_id, priority FROM j WHERE status = 'queued' AND (depends_on IS NULL OR depends_on IN (SELECT job_id FROM j WHERE status = 'complete')) ORDER BY priority DESC, job_id LIMIT 50")
def runnable_jobs(x):
    return state.runnable(_jobs(x), 50).select("job_id", "priority")


@query(
    "",
    f"""WITH {_JOBS_SQL}, n AS (SELECT 0 - max(event_id) AS job_id, user_id AS file_id, CASE event_type WHEN 'error' THEN '1-URGENT' ELSE '2-HIGH' END AS layer FROM events GROUP BY 2, 3)
SELECT job_id, file_id, layer, status FROM j UNION ALL SELECT job_id, file_id, layer, 'queued' FROM n WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.file_id = n.file_id AND j.layer = n.layer AND status <> 'complete')""",
)
def enqueued_jobs(x):
    event = F.col("event_id")
    asked = x.table("events").select((-event).alias("job_id"), F.col("user_id").alias("file_id"), F.lit(None).cast("string").alias("unit_id"), F.when(F.col("event_type") == "error", "1-URGENT").otherwise("2-HIGH").alias("layer"), event.cast("int").alias("priority"), F.lit(None).cast("long").alias("depends_on"))
    return state.enqueue(_jobs(x), asked).select("job_id", "file_id", "layer", "status")


@query(
    "",
    f"""WITH {_JOBS_SQL}, m AS (SELECT l_orderkey AS job_id, max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS s FROM lineitem GROUP BY 1)
SELECT job_id, CASE WHEN status = 'queued' AND s = 1 THEN 'building' WHEN status = 'building' AND s = 2 THEN 'complete' WHEN status = 'building' AND s = 3 THEN 'failed' ELSE status END AS status,
 CASE WHEN status = 'building' AND s = 3 THEN 'R' END AS error FROM j LEFT JOIN m USING (job_id)""",
)
def advanced_jobs(x):
    mark = F.col("l_returnflag")
    moves = x.table("lineitem").select(F.col("l_orderkey").alias("job_id"), F.when(mark == "A", "building").when(mark == "N", "complete").otherwise("failed").alias("status"), mark.alias("error"))
    return state.advance(_jobs(x), moves).select("job_id", "status", "error")


@query(
    "",
    f"WITH {_JOBS_SQL} SELECT l_suppkey AS ticket, count(*) AS n_jobs, count(*) FILTER (WHERE status <> 'complete') AS n_open, CASE WHEN count(*) FILTER (WHERE status <> 'complete') > 0 THEN 'pending' ELSE 'ready' END AS status FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) l LEFT JOIN j ON job_id = l_orderkey GROUP BY 1",
)
def ticket_states(x):
    return state.tickets(x.table("lineitem").select(F.col("l_suppkey").alias("ticket"), F.col("l_orderkey").alias("job_id")), _jobs(x)).drop("n_failed")


@query(
    "cg_files cg_symbols cg_edges",
    f"""WITH s AS (SELECT symbol_id, file_id FROM cg_symbols WHERE kind = 'class'), own AS (SELECT DISTINCT file_id FROM s),
e AS (SELECT source, target FROM cg_edges WHERE {_CALL_SQL} UNION SELECT target, source FROM cg_edges WHERE {_CALL_SQL})
SELECT file_id FROM own UNION SELECT y.file_id FROM e JOIN s ON s.symbol_id = e.source JOIN cg_symbols y ON y.symbol_id = e.target
UNION SELECT f.file_id + 1 FROM own f JOIN cg_files g ON g.file_id = f.file_id WHERE g.language = 'rust'""",
)
def focus_files(x):
    ways, _ = state.focus_plan("calls")
    imports = x.files.where("language = 'rust'").select("file_id", (F.col("file_id") + 1).alias("target_file"))
    return state.focus_files(x.edges, x.symbols, imports, x.files, x.symbols.where("kind = 'class'").select("symbol_id"), ways)


@query("cg_refs cg_files", """SELECT r.reference_id, CASE f.language WHEN 'python' THEN CASE WHEN n = 'db.connect' THEN 'new_owned' END WHEN 'go' THEN CASE WHEN n = 'os.open' THEN 'new_owned' END WHEN 'rust' THEN CASE WHEN n = 'box::new' THEN 'new_owned' END WHEN 'c' THEN CASE WHEN n = 'malloc' THEN 'new_owned' END END AS made,
 CASE WHEN n = 'f.close' AND f.language IN ('python', 'go') THEN 'method' WHEN n = 'buf_free' AND f.language = 'c' THEN 'explicit' END AS ended
FROM (SELECT reference_id, file_id, CASE reference_id % 6 WHEN 0 THEN 'db.connect' WHEN 1 THEN 'os.open' WHEN 2 THEN 'box::new' WHEN 3 THEN 'malloc' WHEN 4 THEN 'f.close' ELSE 'buf_free' END AS n FROM cg_refs) r JOIN cg_files f USING (file_id)""")
def resource_calls(x):
    names = F.array(*[F.lit(n) for n in ("db.connect", "os.Open", "Box::new", "malloc", "f.close", "buf_free")])
    calls = x.refs.select("reference_id", "file_id", F.get(names, (F.col("reference_id") % 6).cast("int")).alias("callee")).join(x.files, "file_id")
    return calls.select("reference_id", resources.returned(F.col("callee"), F.col("language")).alias("made"), resources.ended(F.col("callee"), F.col("language")).alias("ended"))

"""Queries over the lens, each with the DuckDB text that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.operators import graph, incremental, joins, resolve, search, semantic, trace
from weftgraph.plans.lens import Lens, with_views
from weftgraph.sources.tables import fresh_path
from weftgraph.streaming import sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(views: str = "", sql: str = "", recursive: bool = False):
    """Register a function of a Lens under its name; ``sql`` is its oracle over ``views``."""

    def add(make: Callable[[Lens], DataFrame]):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Lens(spark, sf_dir))
        if sql:
            ORACLE_SQL[make.__name__] = with_views(views, sql, recursive)
        return make

    return add


_TEST_SQL = (
    "(lower(path) LIKE '%test/%' OR lower(path) LIKE '%tests/%' OR lower(path) LIKE '%/spec/%' OR lower(path) LIKE '%/testing/%' OR lower(path) LIKE '%/\\_\\_tests\\_\\_/%' ESCAPE '\\')"
)

# --- scans, filters, projections ---------------------------------------------------------


@query("cg_files", "SELECT file_id, path, language FROM cg_files WHERE path = 'ASIA' OR starts_with(path, 'ASIA/')")
def files_in_scope(x):
    return x.files.where(C.in_scope(F.col("path"), "./ASIA/"))


@query("cg_files", "SELECT file_id, path FROM cg_files WHERE starts_with(path, 'EUROPE/') AND language = 'rust' ORDER BY path LIMIT 7")
def list_files_limit(x):
    return x.files.where(C.in_scope(F.col("path"), "EUROPE") & (F.col("language") == "rust")).orderBy("path").limit(7).select("file_id", "path")


@query("cg_files", "SELECT file_id, path FROM cg_files ORDER BY path LIMIT 10 OFFSET 20")
def files_page(x):
    return x.files.orderBy("path").offset(20).limit(10).select("file_id", "path")


@query("cg_files", "SELECT file_id, path FROM cg_files WHERE regexp_matches(path, '^A[^/]*/(.*/)?[^/]*3\\.src$')")
def files_glob(x):
    return x.files.where(F.col("path").rlike(C.glob_regex("A*/**/*3.src"))).select("file_id", "path")


@query("cg_files cg_symbols", "SELECT symbol_id, name, qualified_name FROM cg_symbols WHERE lower(name) LIKE '%gizmo%' OR lower(qualified_name) LIKE '%gizmo%'")
def symbols_like(x):
    return search.like(x.symbols, "%GIZMO_").select("symbol_id", "name", "qualified_name")


@query("cg_files cg_symbols", "SELECT symbol_id, qualified_name, path FROM cg_symbols WHERE name = (SELECT min(name) FROM cg_symbols) AND starts_with(path, 'AMERICA/') AND kind = 'function'")
def symbols_exact_scope(x):
    least = x.symbols.agg(F.min("name").alias("name"))
    some = x.symbols.where(C.in_scope(F.col("path"), "AMERICA") & (F.col("kind") == C.KIND_ALIASES["fn"]))
    return some.join(least, "name").select("symbol_id", "qualified_name", "path")


@query("cg_files cg_symbols", "SELECT symbol_id, kind, language FROM cg_symbols WHERE kind IN ('class', 'struct') AND language = 'go'")
def kind_language_filter(x):
    return x.symbols.where(F.col("kind").isin("class", "struct") & (F.col("language") == "go")).select("symbol_id", "kind", "language")


@query("cg_files cg_symbols", "SELECT symbol_id, name FROM cg_symbols WHERE symbol_id IN (1, 5, 8, 13, 100000000)")
def symbols_by_id(x):
    return x.symbols.where(F.col("symbol_id").isin(1, 5, 8, 13, 100000000)).select("symbol_id", "name")


@query("cg_files cg_symbols cg_edges", "SELECT source, target, kind, confidence FROM cg_edges e WHERE confidence >= 0.95 AND EXISTS (SELECT 1 FROM cg_symbols s WHERE s.symbol_id = e.source) AND EXISTS (SELECT 1 FROM cg_symbols s WHERE s.symbol_id = e.target)")
def snapshot_edges(x):
    return graph.snapshot_edges(x.edges, x.symbols, 0.95).select("source", "target", "kind", "confidence")


@query("cg_files cg_symbols", f"SELECT symbol_id, path FROM cg_symbols WHERE {_TEST_SQL}")
def test_path_symbols(x):
    return x.symbols.where(C.is_test_path(F.col("path"))).select("symbol_id", "path")


@query("cg_files", "SELECT file_id, path FROM cg_files WHERE len(list_filter(string_split(lower(path), '/'), lambda p: p IN ('test', 'tests', 'testing', 'selftests', 'spec', '__tests__'))) > 0")
def explicit_test_files(x):
    return x.files.where(C.is_explicit_test_path(F.col("path"))).select("file_id", "path")


@query("cg_state", "SELECT file_id, mask FROM cg_state WHERE mask & 16 = 16 AND status = 'fresh'")
def coverage_bit_filter(x):
    return x.state.where((F.col("mask").bitwiseAND(F.lit(16)) == 16) & (F.col("status") == "fresh")).select("file_id", "mask")


@query("cg_files cg_symbols", "SELECT symbol_id, CASE WHEN language = 'c' THEN kind <> 'variable' WHEN language = 'rust' THEN kind <> 'struct' WHEN language = 'go' THEN kind = 'function' ELSE true END AS visible FROM cg_symbols")
def visibility(x):
    s = x.symbols.withColumn("visibility", F.when(F.col("kind") == "struct", "private").otherwise("public"))
    return s.select("symbol_id", C.visible_across_files(F.col("language"), F.col("visibility"), F.col("kind") == "function", F.col("kind") == "variable").alias("visible"))


# --- joins ---------------------------------------------------------------------------------


@query("cg_files cg_symbols", "SELECT s.symbol_id, s.name, f.path AS file_path FROM cg_symbols s JOIN cg_files f ON s.file_id = f.file_id")
def symbols_with_files(x):
    return x.symbols.select("symbol_id", "name", "file_id").join(x.files.select("file_id", F.col("path").alias("file_path")), "file_id").select("symbol_id", "name", "file_path")


@query("cg_files cg_symbols cg_refs", "SELECT r.reference_id, s.name AS callee, f.path AS at FROM cg_refs r JOIN cg_symbols s ON r.target = s.symbol_id JOIN cg_files f ON r.file_id = f.file_id WHERE r.kind = 'call' AND f.language = 'c'")
def callsites_resolved(x):
    calls = x.refs.where("kind = 'call'").select("reference_id", "target", "file_id")
    at = x.files.where("language = 'c'").select("file_id", F.col("path").alias("at"))
    return calls.join(at, "file_id").join(x.symbols.select(F.col("symbol_id").alias("target"), F.col("name").alias("callee")), "target").select("reference_id", "callee", "at")


@query("cg_files cg_symbols cg_refs cg_resolutions", "SELECT reference_id, name FROM cg_refs r WHERE kind = 'call' AND NOT EXISTS (SELECT 1 FROM cg_resolutions v WHERE v.reference_id = r.reference_id AND v.is_visible)")
def unresolved_calls(x):
    return x.refs.where("kind = 'call'").join(x.resolutions.where("is_visible").select("reference_id"), "reference_id", "left_anti").select("reference_id", "name")


@query("cg_files cg_symbols cg_refs", "SELECT symbol_id, name FROM cg_symbols WHERE symbol_id IN (SELECT source_symbol FROM cg_refs WHERE kind = 'inheritance')")
def inheriting_symbols(x):
    return x.symbols.join(x.refs.where("kind = 'inheritance'").select(F.col("source_symbol").alias("symbol_id")), "symbol_id", "left_semi").select("symbol_id", "name")


@query("cg_resolutions", "SELECT reference_id, target FROM (SELECT reference_id, target, row_number() OVER (PARTITION BY reference_id ORDER BY id DESC, target DESC) AS n FROM cg_resolutions WHERE is_visible) x WHERE n = 1")
def latest_resolution(x):
    return incremental.newest_visible(x.resolutions)


@query("cg_resolutions", "SELECT id, reference_id, target FROM cg_resolutions r WHERE is_visible AND id < (SELECT max(id) FROM cg_resolutions v WHERE v.is_visible AND v.reference_id = r.reference_id)")
def superseded_edges(x):
    return incremental.superseded(x.resolutions).select("id", "reference_id", "target")


@query(
    "cg_files cg_symbols cg_refs",
    "SELECT reference_id, symbol_id FROM (SELECT r.reference_id, s.symbol_id, row_number() OVER (PARTITION BY r.reference_id ORDER BY s.end_byte - s.start_byte, s.symbol_id) AS n FROM cg_refs r JOIN cg_symbols s ON r.pos BETWEEN s.start_byte AND s.end_byte) x WHERE n = 1",
)
def locate_innermost(x):
    ranges = x.symbols.select("symbol_id", "start_byte", "end_byte")
    return joins.innermost(x.refs.select("reference_id", "pos"), ranges, []).select("reference_id", "symbol_id")


@query(
    "cg_files cg_symbols",
    "SELECT a.symbol_id AS a, b.symbol_id AS b FROM cg_symbols a JOIN cg_symbols b ON a.file_id = b.file_id AND a.start_byte < b.end_byte + 20000 AND b.start_byte < a.end_byte + 20000 AND a.kind = 'class' AND b.kind = 'function'",
)
def overlap_effects(x):
    left = x.symbols.where("kind = 'class'").select(F.col("symbol_id").alias("a"), "file_id", F.col("start_byte").alias("start"), (F.col("end_byte") + 20000).alias("end"))
    right = x.symbols.where("kind = 'function'").select(F.col("symbol_id").alias("b"), "file_id", F.col("start_byte").alias("r_start"), (F.col("end_byte") + 20000).alias("r_end"))
    return joins.overlapping(left, right, ["file_id"], 1 << 14).select("a", "b")


@query(
    "cg_bindings cg_uses",
    "SELECT u.use_id, b.binding_id FROM cg_uses u ASOF LEFT JOIN cg_bindings b ON u.scope_id = b.scope_id AND u.name = b.name AND u.pos >= b.visible_from",
)
def asof_binding(x):
    found = joins.asof(x.uses, x.bindings, ["scope_id", "name"])
    return found.select("use_id", "binding_id")


@query(
    "cg_scopes",
    """WITH up AS (SELECT scope_id, scope_id AS ancestor, parent_id, 0 AS depth FROM cg_scopes
 UNION ALL SELECT u.scope_id, s.scope_id, s.parent_id, u.depth + 1 FROM up u JOIN cg_scopes s ON u.parent_id = s.scope_id)
SELECT scope_id, ancestor, depth FROM up""",
    recursive=True,
)
def scope_closure(x):
    return joins.scope_closure(x.scopes)


@query(
    "cg_scopes",
    """SELECT u.use_id, CASE WHEN u.name = s.name THEN s.scope_id WHEN u.name = n.name THEN n.scope_id ELSE r.scope_id END AS declaration_id, CASE WHEN u.name = s.name THEN 0 WHEN u.name = n.name THEN 1 ELSE 2 END AS depth
FROM (SELECT o_orderkey AS use_id, 's' || o_custkey % n_sup AS scope_id, CASE o_orderkey % 3 WHEN 0 THEN 'ASIA' ELSE 'EUROPE' END AS name FROM orders CROSS JOIN (SELECT count(*) AS n_sup FROM supplier) c) u
JOIN cg_scopes s ON u.scope_id = s.scope_id JOIN cg_scopes n ON s.parent_id = n.scope_id JOIN cg_scopes r ON n.parent_id = r.scope_id WHERE u.name IN (s.name, n.name, r.name)""",
)
def scope_lookup(x):
    n = x.table("supplier").agg(F.count("*").alias("n_sup"))
    uses = x.table("orders").crossJoin(F.broadcast(n)).select(F.col("o_orderkey").alias("use_id"), F.concat(F.lit("s"), F.col("o_custkey") % F.col("n_sup")).alias("scope_id"), F.when(F.col("o_orderkey") % 3 == 0, "ASIA").otherwise("EUROPE").alias("name"))
    names = x.scopes.select(F.col("scope_id").alias("declaration_id"), "scope_id", "name")
    return joins.lookup_in_scopes(uses, names, joins.scope_closure(x.scopes)).select("use_id", "declaration_id", "depth")


_FOLDER = "regexp_replace({0}, '/[^/]*$', '')"


@query(
    "cg_files cg_symbols cg_refs",
    f"""SELECT reference_id, symbol_id, tier FROM (SELECT r.reference_id, s.symbol_id, CASE WHEN {_FOLDER.format("s.path")} = {_FOLDER.format("f.path")} THEN 0 WHEN split_part(s.path, '/', 1) = split_part(f.path, '/', 1) THEN 1 ELSE 2 END AS tier,
 row_number() OVER (PARTITION BY r.reference_id ORDER BY CASE WHEN s.name = r.name THEN 0 ELSE 1 END, CASE WHEN {_FOLDER.format("s.path")} = {_FOLDER.format("f.path")} THEN 0 WHEN split_part(s.path, '/', 1) = split_part(f.path, '/', 1) THEN 1 ELSE 2 END, s.symbol_id) AS n
 FROM cg_refs r JOIN cg_files f ON r.file_id = f.file_id JOIN cg_symbols s ON lower(s.name) = lower(r.name) WHERE r.kind = 'type') x WHERE n = 1""",
)
def resolve_proximity(x):
    refs = x.refs.where("kind = 'type'").join(x.files.select("file_id", "path"), "file_id").select("reference_id", "name", "path")
    return joins.proximity_choice(refs, x.symbols)


@query(
    "cg_files cg_symbols",
    """SELECT query, name, distance FROM (SELECT a AS query, b AS name, levenshtein(lower(a), lower(b)) AS distance, row_number() OVER (PARTITION BY a ORDER BY levenshtein(lower(a), lower(b)), b) AS n
 FROM (SELECT DISTINCT substring(name, 2, 100) AS a FROM cg_symbols UNION SELECT DISTINCT event_type FROM events UNION SELECT DISTINCT substring(n_name, 1, 4) FROM nation) q
 JOIN (SELECT DISTINCT name AS b FROM cg_symbols UNION SELECT DISTINCT substring(n_name, 2, 3) FROM nation UNION SELECT DISTINCT substring(r_name, 1, 5) FROM region UNION SELECT n_name FROM nation) n ON levenshtein(lower(a), lower(b)) <= 2) x WHERE n <= 20""",
)
def fuzzy_names(x):
    nations, regions, events = x.table("nation"), x.table("region"), x.table("events")
    queries = x.symbols.select(F.substring("name", 2, 100).alias("query")).unionByName(events.select(F.col("event_type").alias("query"))).unionByName(nations.select(F.substring("n_name", 1, 4).alias("query")))
    names = x.symbols.select("name").unionByName(nations.select(F.substring("n_name", 2, 3).alias("name"))).unionByName(regions.select(F.substring("r_name", 1, 5).alias("name"))).unionByName(nations.select(F.col("n_name").alias("name")))
    return joins.fuzzy_names(queries, names).select("query", "name", "distance")


@query("cg_imports", "SELECT module, count(DISTINCT file_id) AS n FROM cg_imports WHERE module <> '' GROUP BY module")
def dependents(x):
    return x.imports.where("module <> ''").groupBy("module").agg(F.countDistinct("file_id").alias("n"))


@query(
    "cg_files cg_symbols",
    "SELECT s.symbol_id AS source, t.symbol_id AS target, 'registers_callback' AS kind FROM cg_symbols s JOIN (SELECT name, file_id, min(symbol_id) AS symbol_id FROM cg_symbols GROUP BY name, file_id) t ON s.name = t.name AND s.file_id = t.file_id WHERE s.kind = 'method'",
)
def callback_edges(x):
    calls = x.symbols.where("kind = 'method'").select(F.col("symbol_id").alias("caller"), F.lit("atexit").alias("callee"), "file_id", F.array("name").alias("args"))
    return joins.callback_edges(calls, x.symbols).select("source", "target", "kind")


@query(
    "cg_files cg_symbols",
    "SELECT e.l_orderkey * 100 + e.n AS callsite_id, e.l_partkey AS argument, p.symbol_id AS parameter FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) e JOIN (SELECT symbol_id, row_number() OVER (PARTITION BY file_id ORDER BY start_byte) - 1 AS i, file_id FROM cg_symbols) p ON p.file_id = e.l_orderkey % 10 AND p.i = 0",
)
def arguments_to_parameters(x):
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    calls = x.table("lineitem").withColumn("n", F.row_number().over(order)).select((F.col("l_orderkey") * 100 + F.col("n")).alias("callsite_id"), (F.col("l_orderkey") % 10).alias("callee"), F.array("l_partkey").alias("args"))
    params = x.symbols.select(F.col("file_id").alias("function_id"), F.col("symbol_id").alias("node_id"), F.lit(None).cast("int").alias("arg_index"), "start_byte")
    return joins.arguments_to_parameters(calls, params).select("callsite_id", "argument", "parameter")


# --- aggregates, windows, set operations ---------------------------------------------------


@query("cg_files cg_symbols", "SELECT kind, count(*) AS n FROM cg_symbols GROUP BY kind")
def symbols_by_kind(x):
    return x.symbols.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


@query("cg_files cg_symbols cg_edges", "SELECT (SELECT count(*) FROM cg_files) AS files, (SELECT count(*) FROM cg_symbols) AS symbols, (SELECT count(*) FROM cg_edges) AS edges")
def index_stats(x):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(x.files, "files").crossJoin(one(x.symbols, "symbols")).crossJoin(one(x.edges, "edges"))


@query("cg_files", "SELECT language, n FROM (SELECT language, count(*) AS n FROM cg_files WHERE starts_with(path, 'AFRICA/') GROUP BY language) x ORDER BY n DESC, language LIMIT 1")
def dominant_language(x):
    return x.files.where(C.in_scope(F.col("path"), "AFRICA")).groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(1)


@query("cg_state", "SELECT layer, status, count(DISTINCT file_id) AS n FROM cg_state GROUP BY layer, status")
def layer_status_counts(x):
    return x.state.groupBy("layer", "status").agg(F.countDistinct("file_id").alias("n"))


@query("cg_state", "SELECT scope, bit_or(mask) AS mask, count(*) AS n FROM cg_state WHERE status = 'fresh' GROUP BY scope")
def coverage_bits(x):
    return x.state.where("status = 'fresh'").groupBy("scope").agg(F.bit_or("mask").alias("mask"), F.count("*").alias("n"))


@query("cg_state", "SELECT tier, count(*) AS n FROM (SELECT file_id, CASE WHEN bit_or(mask) & 56 = 56 THEN 'full' WHEN bit_or(mask) & 16 = 16 THEN 'dataflow' WHEN bit_or(mask) & 2 = 2 THEN 'structural' WHEN bit_or(mask) & 1 = 1 THEN 'manifest' ELSE 'none' END AS tier FROM cg_state WHERE status = 'fresh' GROUP BY file_id) x GROUP BY tier")
def coverage_tiers(x):
    return incremental.coverage(x.state.where("status = 'fresh'")).groupBy("tier").agg(F.count("*").alias("n"))


@query("cg_edges", "SELECT node, kind, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM (SELECT source AS node, kind, 1 AS o, 0 AS i FROM cg_edges UNION ALL SELECT target, kind, 0, 1 FROM cg_edges) x GROUP BY node, kind")
def relation_counts(x):
    return graph.relation_counts(x.edges)


@query("cg_edges", "SELECT node, count(*) AS degree FROM (SELECT source AS node FROM cg_edges UNION ALL SELECT target FROM cg_edges) x GROUP BY node ORDER BY degree DESC, node LIMIT 25")
def degree_top(x):
    return graph.degrees(x.edges).orderBy(F.desc("degree"), "node").limit(25)


@query("cg_files cg_symbols cg_refs", "SELECT r.name, n_refs, n_symbols, n_refs * n_symbols AS pairs FROM (SELECT lower(name) AS name, count(*) AS n_refs FROM cg_refs GROUP BY 1) r JOIN (SELECT lower(name) AS name, count(*) AS n_symbols FROM cg_symbols GROUP BY 1) s ON r.name = s.name ORDER BY pairs DESC, r.name LIMIT 30")
def name_fan_out(x):
    return search.top_fan_out(x.refs, x.symbols)


@query("cg_files cg_symbols cg_edges", "SELECT s.file_id, count(*) AS n, min(e.target) AS first_target FROM cg_edges e JOIN cg_symbols s ON e.target = s.symbol_id GROUP BY s.file_id")
def impact_by_file(x):
    return x.edges.join(x.symbols.select(F.col("symbol_id").alias("target"), "file_id"), "target").groupBy("file_id").agg(F.count("*").alias("n"), F.min("target").alias("first_target"))


@query("cg_resolutions", "SELECT closure_id, round(avg(confidence), 6) AS mean_confidence, count(*) AS n FROM cg_resolutions GROUP BY closure_id")
def mean_confidence(x):
    return x.resolutions.groupBy("closure_id").agg(F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count("*").alias("n"))


@query("cg_effects", "SELECT function_id, effect, lag(effect) OVER (PARTITION BY function_id ORDER BY ord) AS previous, ord FROM cg_effects")
def previous_sibling(x):
    return x.effects.select("function_id", "effect", F.lag("effect").over(Window.partitionBy("function_id").orderBy("ord")).alias("previous"), "ord")


@query("cg_resolutions", "SELECT closure_id, max(id) AS newest FROM cg_resolutions GROUP BY closure_id ORDER BY newest DESC LIMIT 5")
def pruned_closures(x):
    newest = x.resolutions.groupBy("closure_id").agg(F.max("id").alias("newest"))
    return incremental.prune(newest, 5, F.desc("newest"))


_KNOWN = "SELECT CAST(doc_id AS varchar(20)) AS path, md5(text) AS content_hash, 3 AS capability_mask FROM documents WHERE doc_id % 10 <> 3"
_FOUND = "SELECT CAST(doc_id AS varchar(20)) AS path, md5(CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END) AS content_hash FROM documents WHERE doc_id % 11 <> 5"


@query("", f"SELECT coalesce(k.path, f.path) AS path, CASE WHEN k.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'deleted' WHEN k.content_hash <> f.content_hash THEN 'modified' ELSE 'unchanged' END AS change FROM ({_KNOWN}) k FULL OUTER JOIN ({_FOUND}) f ON k.path = f.path")
def change_classes(x):
    x.table("documents").createOrReplaceTempView("documents")
    return incremental.change_classes(x.spark.sql(_KNOWN), x.spark.sql(_FOUND), C.BITS["structural"])


@query("cg_state", "SELECT DISTINCT scope FROM cg_state c WHERE NOT EXISTS (SELECT 1 FROM cg_state f WHERE f.scope = c.scope AND f.file_id NOT IN (SELECT file_id FROM cg_state WHERE status = 'fresh'))")
def covered_scopes(x):
    return incremental.covered_scopes(x.state.select("scope", "file_id"), x.state, C.BITS["manifest"])


@query("cg_files cg_symbols", "SELECT symbol_id, CASE WHEN p.n = 0 THEN 0 ELSE p.n END AS shared FROM (SELECT symbol_id, len(list_intersect(string_split(lower(name), '_'), ['blue', 'gear', 'green', 'small'])) AS n FROM cg_symbols) p WHERE p.n > 0")
def word_overlap(x):
    n = F.size(F.array_intersect(C.name_parts(F.col("name")), F.array(*[F.lit(w) for w in ("blue", "gear", "green", "small")])))
    return x.symbols.select("symbol_id", n.cast("long").alias("shared")).where("shared > 0")


# --- search --------------------------------------------------------------------------------


_BM25 = r"""WITH p AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents),
l AS (SELECT id, count(*) AS len FROM p GROUP BY id), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT avg(len) FROM l) AS avg_len),
m AS (SELECT id, CASE WHEN token = 'the' THEN 0 ELSE 1 END AS term, count(*) AS tf FROM p WHERE token = 'the' OR starts_with(token, 'thtion') GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM m GROUP BY term)
SELECT m.id, round(sum(ln((st.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM m JOIN d ON m.term = d.term JOIN l ON m.id = l.id CROSS JOIN st GROUP BY m.id HAVING count(*) = 2"""


@query("", _BM25)
def bm25_documents(x):
    docs = x.table("documents")
    postings = search.inverted_index(docs, "doc_id", ["text"])
    n, avg_len = docs.count(), postings.select("id", "len").distinct().agg(F.avg("len")).first()[0] or 1.0
    return search.bm25(postings, "the thtion", n, avg_len).select("id", F.round("score", 6).alias("score"))


@query("", _BM25)
def bm25_indexed(x):
    index = search.SearchIndex(x.spark, fresh_path(x.spark, "search-index")).build(x.table("documents"), "doc_id", ["text"])
    return index.search("the thtion").select("id", F.round("score", 6).alias("score"))


_SNAKE = "array_to_string(list_transform(regexp_extract_all({0}, '[A-Z]+|[a-z]+|[0-9]+'), lambda w: lower(w)), '_')"


@query(
    "cg_files cg_symbols",
    """SELECT symbol_id, round(CASE WHEN name = q THEN 1.0 WHEN starts_with(lower(name), q) THEN 0.92 WHEN o > 0 THEN 0.5 + 0.25 * o / greatest(2, len(list_distinct(w))) ELSE 0.7 * (1 - levenshtein(q, lower(name)) / greatest(strlen(q), strlen(name))::DOUBLE) END, 6) AS similarity
FROM (SELECT symbol_id, name, 'blue_gear' AS q, string_split(name, '_') AS w, len(list_intersect(string_split(name, '_'), ['blue', 'gear'])) AS o FROM cg_symbols) x""",
)
def name_similarity(x):
    return x.symbols.select("symbol_id", F.round(C.name_similarity(F.lit("blue_gear"), F.col("name")), 6).alias("similarity"))


@query("cg_files cg_symbols", "SELECT symbol_id, name, levenshtein(name, 'large_gear') AS distance FROM cg_symbols WHERE levenshtein(name, 'large_gear') <= 4")
def bounded_levenshtein(x):
    return x.symbols.select("symbol_id", "name", F.levenshtein("name", F.lit("large_gear"), 4).alias("distance")).where("distance >= 0")


@query("cg_files cg_symbols", "SELECT symbol_id, CAST(CASE WHEN qualified_name = (SELECT min(name) FROM cg_symbols) THEN 10000 ELSE 9000 END + 1200 * CAST(split_part(path, '/', -1) = 'x.src' AS INT) + CASE WHEN kind = 'function' THEN 200 ELSE 0 END + CASE WHEN language = 'c' THEN 100 ELSE 0 END AS BIGINT) AS score FROM cg_symbols WHERE name = (SELECT min(name) FROM cg_symbols) ORDER BY score DESC, symbol_id LIMIT 50")
def selector_scores(x):
    name = x.symbols.agg(F.min("name")).first()[0]
    return search.selector_scores(x.symbols, name, kind="function", language="c").select("symbol_id", "score")


@query("cg_files cg_symbols", "SELECT symbol_id, CAST(CASE kind WHEN 'class' THEN 0.8 WHEN 'function' THEN 0.6 WHEN 'method' THEN 0.6 WHEN 'struct' THEN 0.5 WHEN 'variable' THEN 0.3 ELSE 0.1 END AS DOUBLE) AS weight FROM cg_symbols")
def kind_weights(x):
    return x.symbols.select("symbol_id", C.kind_weight(F.col("kind")).alias("weight"))


# --- graph ---------------------------------------------------------------------------------


def _seeds(x, n: int = 40):
    return x.symbols.where(F.col("symbol_id") < n).select("symbol_id")


@query("cg_edges", "SELECT DISTINCT source AS seed, target AS node FROM cg_edges WHERE kind IN ('calls', 'instantiates', 'implements')")
def callees_1hop(x):
    return graph.one_hop(x.edges, x.symbols.select("symbol_id"), "outgoing")


@query("cg_edges", "SELECT DISTINCT target AS seed, source AS node FROM cg_edges WHERE kind IN ('calls', 'instantiates', 'implements')")
def callers_1hop(x):
    return graph.one_hop(x.edges, x.symbols.select("symbol_id"), "incoming")


_WALK = """WITH pairs AS (SELECT DISTINCT a, b FROM ({0}) p),
walk AS (SELECT symbol_id AS seed, symbol_id AS node, 0 AS depth FROM cg_symbols WHERE symbol_id < {1} UNION SELECT seed, b, depth + 1 FROM walk JOIN pairs ON a = node WHERE depth < {2})
SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node"""
_CALL_SQL = "kind IN ('calls', 'instantiates', 'implements')"


@query("cg_files cg_symbols cg_edges", _WALK.format(f"SELECT source AS a, target AS b FROM cg_edges WHERE {_CALL_SQL} UNION ALL SELECT target, source FROM cg_edges WHERE {_CALL_SQL}", 40, 3), recursive=True)
def callgraph_bfs(x):
    return graph.bfs(x.edges, _seeds(x), 3, "both")


@query("cg_files cg_symbols cg_edges", _WALK.format(f"SELECT source AS a, target AS b FROM cg_edges WHERE {_CALL_SQL}", 40, 4), recursive=True)
def impact_bfs(x):
    return graph.impact(x.edges, _seeds(x), 4, limit=None)


@query("cg_files cg_symbols cg_edges", "SELECT seed, node, depth FROM (" + _WALK.format(f"SELECT source AS a, target AS b FROM cg_edges WHERE {_CALL_SQL}", 40, 3).replace("WITH pairs", "WITH RECURSIVE pairs") + ") w WHERE depth = 3 OR node NOT IN (SELECT source FROM cg_edges WHERE " + _CALL_SQL + ")")
def forward_frontier(x):
    return graph.forward_frontier(x.edges, _seeds(x), 3)


@query(
    "cg_files cg_symbols cg_edges",
    f"""WITH w AS (SELECT e.source, e.target, min(greatest(1.0, 1.0 + CASE WHEN e.kind = 'instantiates' THEN 1.0 ELSE 0.0 END + (1 - e.confidence) / 2 + CASE WHEN e.provenance = 'heuristic' THEN 0.3 ELSE 0.0 END + CASE WHEN {_TEST_SQL.replace("path", "s.path")} THEN 0.5 ELSE 0.0 END)) AS weight
 FROM cg_edges e JOIN cg_symbols s ON e.target = s.symbol_id WHERE e.{_CALL_SQL} GROUP BY e.source, e.target),
walk AS (SELECT symbol_id AS seed, symbol_id AS node, CAST(0 AS DOUBLE) AS cost, 0 AS hops FROM cg_symbols WHERE symbol_id < 40 UNION SELECT seed, target, round(cost + weight, 9), hops + 1 FROM walk JOIN w ON source = node WHERE hops < 4)
SELECT seed, node, round(min(cost), 6) AS cost FROM walk GROUP BY seed, node""",
    recursive=True,
)
def shortest_path_cost(x):
    edges = graph.weighted(x.edges, x.symbols)
    return graph.shortest_costs(edges, _seeds(x), 4).select("seed", "node", F.round("cost", 6).alias("cost"))


@query(
    "cg_files cg_symbols cg_edges",
    f"""WITH h AS (SELECT e.source, e.target, greatest(1.0, 1.0 + CASE WHEN e.kind = 'instantiates' THEN 1.0 ELSE 0.0 END + (1 - e.confidence) / 2 + CASE WHEN e.provenance = 'heuristic' THEN 0.3 ELSE 0.0 END + CASE WHEN {_TEST_SQL.replace("path", "s.path")} THEN 0.5 ELSE 0.0 END) AS weight
 FROM cg_edges e JOIN cg_symbols s ON e.target = s.symbol_id WHERE e.{_CALL_SQL}),
pairs AS (SELECT DISTINCT a.source AS source_id, b.target AS target_id FROM h a JOIN h b ON a.target = b.source WHERE a.source < 40 AND a.source <> b.target),
walk AS (SELECT source_id, target_id, source_id AS node, [source_id] AS nodes, CAST(0 AS DOUBLE) AS cost FROM pairs
 UNION ALL SELECT source_id, target_id, h.target, list_append(nodes, h.target), cost + weight FROM walk JOIN h ON h.source = node WHERE node <> target_id AND len(nodes) <= 3 AND NOT list_contains(nodes, h.target))
SELECT source_id, target_id, rank, round(cost, 6) AS cost FROM (SELECT source_id, target_id, cost, row_number() OVER (PARTITION BY source_id, target_id ORDER BY cost, len(nodes)) AS rank FROM walk WHERE node = target_id) w WHERE rank <= 5""",
    recursive=True,
)
def ranked_paths(x):
    edges = graph.weighted(x.edges, x.symbols)
    hops = edges.where(F.col("kind").isin(*C.CALL)).select("source", "target")
    two = hops.join(hops.select(F.col("source").alias("target"), F.col("target").alias("target_id")), "target")
    pairs = two.where("source < 40 AND source <> target_id").select(F.col("source").alias("source_id"), "target_id").distinct()
    return graph.ranked_paths(edges, pairs, 3, 5).select("source_id", "target_id", F.col("rank").cast("long").alias("rank"), F.round("cost", 6).alias("cost"))


@query()
def path_scores(x):
    edges = graph.weighted(x.edges, x.symbols)
    pairs = x.edges.where(F.col("kind").isin(*C.CALL) & (F.col("source") < 20)).select(F.col("source").alias("source_id"), F.col("target").alias("target_id")).distinct()
    paths = graph.ranked_paths(edges, pairs, 2, 3)
    penalties = x.symbols.select(F.col("symbol_id").alias("node"), F.when(C.is_test_path(F.col("path")), 0.5).otherwise(0.0).alias("penalty"))
    scored = graph.path_scores(paths, graph.degrees(x.edges), penalties)
    return scored.select("source_id", "target_id", "rank", F.array_join("nodes", ">").alias("nodes"), F.round("overall", 6).alias("overall"))


@query(
    "cg_files cg_symbols cg_refs",
    """SELECT source, target, kind, count(*) AS n FROM (SELECT r.source_symbol AS source, r.target, CASE WHEN r.kind IN ('call', 'instantiation') THEN CASE WHEN s.kind IN ('class', 'struct') THEN 'instantiates' WHEN s.kind IN ('function', 'method') THEN 'calls' END WHEN r.kind = 'inheritance' THEN 'extends' ELSE 'references' END AS kind
 FROM cg_refs r JOIN cg_symbols s ON r.target = s.symbol_id WHERE r.source_symbol IN (SELECT symbol_id FROM cg_symbols)
 UNION ALL SELECT s.symbol_id % 100, r.target, 'contains' FROM cg_refs r JOIN cg_symbols s ON r.target = s.symbol_id WHERE r.source_symbol IN (SELECT symbol_id FROM cg_symbols)) x WHERE kind IS NOT NULL GROUP BY source, target, kind""",
)
def edges_derived(x):
    symbols = x.symbols.select("symbol_id", "kind", (F.col("symbol_id") % 100).alias("container_id"))
    refs = x.refs.select("reference_id", "source_symbol", "kind", "target", F.lit(1.0).alias("confidence"), F.lit("tree_sitter").alias("provenance"))
    return graph.derive_edges(refs, symbols).groupBy("source", "target", "kind").agg(F.count("*").alias("n"))


@query(
    "cg_edges",
    """SELECT i.source, i.target, i.kind, CASE WHEN fan > 12 THEN 'candidate' WHEN o.source IS NULL THEN CASE WHEN i.confidence >= 0.95 THEN 'canonical' ELSE 'candidate' END WHEN o.confidence >= 0.95 THEN 'keep' ELSE 'replace' END AS decision
FROM (SELECT source, target, kind, confidence FROM cg_edges) i JOIN (SELECT source, kind, count(DISTINCT target) AS fan FROM cg_edges GROUP BY 1, 2) f ON i.source = f.source AND i.kind = f.kind
LEFT JOIN (SELECT source, target, kind, confidence FROM cg_edges WHERE provenance = 'heuristic') o ON i.source = o.source AND i.target = o.target AND i.kind = o.kind""",
)
def edge_policy(x):
    band = F.when(F.col("confidence") >= 0.95, "certain").otherwise("medium")
    old = x.edges.where("provenance = 'heuristic'").select("source", "target", "kind", "confidence", band.alias("band"), F.lit("closure").alias("coverage"))
    new = x.edges.select("source", "target", "kind", "confidence", band.alias("band"), F.lit("repo").alias("coverage"))
    return graph.edge_policy(old, new, max_fan_out=12).select("source", "target", "kind", "decision")


# --- resolution, trace, semantics, streaming -------------------------------------------------


@query(
    "cg_files cg_symbols cg_refs",
    f"""SELECT strategy, count(*) AS n FROM (SELECT r.reference_id, CASE WHEN max(CASE WHEN s.file_id = r.file_id THEN 1 ELSE 0 END) = 1 THEN 'same_file' WHEN max(CASE WHEN NOT {_TEST_SQL.replace("path", "s.path")} OR {_TEST_SQL.replace("path", "f.path")} THEN 1 ELSE 0 END) = 1 THEN 'exact_name' END AS strategy
FROM cg_refs r JOIN cg_files f ON r.file_id = f.file_id JOIN cg_symbols s ON s.name = r.name GROUP BY r.reference_id) x WHERE strategy IS NOT NULL GROUP BY strategy""",
)
def resolve_strategies(x):
    refs = x.refs.select("reference_id", "file_id", "name", "kind").join(x.files, "file_id")
    return resolve.resolve(refs, x.symbols).groupBy("strategy").agg(F.count("*").alias("n"))


@query(
    "",
    """WITH flow AS (SELECT DISTINCT l_orderkey * 2 AS s, l_partkey * 2 + 1 AS t FROM lineitem)
SELECT s AS parameter, t AS sink, CAST(CASE WHEN count(*) OVER (PARTITION BY s) > 1 THEN 0.85 ELSE 1.0 END AS DOUBLE) AS confidence FROM flow""",
)
def param_reaches(x):
    flow = x.table("lineitem").select((F.col("l_orderkey") * 2).alias("source"), (F.col("l_partkey") * 2 + 1).alias("target")).distinct()
    nodes = flow.select(F.col("source").alias("node_id"), F.lit(1).alias("function_id"), F.lit("parameter").alias("kind")).unionByName(flow.select(F.col("target").alias("node_id"), F.lit(1).alias("function_id"), F.lit("call_arg").alias("kind"))).distinct()
    return trace.parameter_summaries(nodes, flow).select("parameter", "sink", "confidence")


@query(
    "cg_edges",
    """WITH best AS (SELECT target, max(source) AS source FROM cg_edges WHERE kind = 'references' GROUP BY target),
walk AS (SELECT DISTINCT target AS sink, target AS node, 0 AS step, [target] AS seen FROM cg_edges UNION ALL SELECT sink, source, step + 1, list_append(seen, source) FROM walk JOIN best ON best.target = node WHERE step < 12 AND NOT list_contains(seen, source))
SELECT sink, step, node FROM walk""",
    recursive=True,
)
def slice_path(x):
    edges = x.edges.where("kind = 'references'").select("source", "target", F.lit(1).alias("priority"))
    return trace.backward_slices(x.edges.select(F.col("target").alias("sink")), edges, 12).select("sink", "step", "node")


@query(
    "cg_files cg_symbols cg_edges",
    f"""WITH up AS (SELECT DISTINCT target AS t, source AS s FROM cg_edges WHERE {_CALL_SQL}),
walk AS (SELECT symbol_id AS seed, [symbol_id] AS chain, 0 AS depth FROM cg_symbols WHERE symbol_id < 20 UNION ALL SELECT seed, list_append(chain, s), depth + 1 FROM walk JOIN up ON chain[-1] = t WHERE depth < 4 AND NOT list_contains(chain, s)),
scored AS (SELECT seed, chain, depth, CASE WHEN {_TEST_SQL} THEN 0 ELSE 100 END + depth AS score FROM walk JOIN cg_symbols s ON s.symbol_id = chain[-1] WHERE depth = 4 OR NOT EXISTS (SELECT 1 FROM up WHERE up.t = chain[-1]))
SELECT seed, array_to_string(chain, '<') AS chain, depth, score FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, chain) AS n FROM scored) x WHERE n = 1""",
    recursive=True,
)
def caller_chains(x):
    chains = trace.caller_chains(x.edges, x.symbols, _seeds(x, 20), 4)
    return chains.select("seed", F.array_join("chain", "<").alias("chain"), "depth", "score")


_STEPS_SQL = """SELECT function_id, effect_id, effect, own, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY function_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'Unknown') AS before
FROM (SELECT *, CASE effect WHEN 'free' THEN 'Freed' WHEN 'alloc' THEN 'Assigned' WHEN 'store' THEN 'Assigned' WHEN 'nullify' THEN 'Nullified' END AS own FROM cg_effects) e"""


@query("cg_effects", f"SELECT function_id, effect_id, before, coalesce(own, before) AS after, CASE WHEN before = 'Freed' AND own = 'Freed' THEN 'double_free' WHEN before = 'Freed' AND own IS NOT NULL THEN 'use_after_free' END AS flag FROM ({_STEPS_SQL}) s")
def lifecycle_steps(x):
    return semantic.straight_lifecycle(x.effects).select("function_id", "effect_id", "before", "after", "flag")


@query("cg_effects", f"SELECT function_id, arg_max(coalesce(own, before), effect_id) AS final_state, count(*) FILTER (WHERE before = 'Freed' AND own IS NOT NULL) AS n_flags FROM ({_STEPS_SQL}) s GROUP BY function_id")
def lifecycle_final_state(x):
    return semantic.lifecycle_proofs(semantic.straight_lifecycle(x.effects)).select("function_id", "final_state", "n_flags")


@query("cg_effects", f"SELECT function_id, arg_max(coalesce(own, before), effect_id) AS state, count(*) FILTER (WHERE before = 'Freed' AND own IS NOT NULL) AS n_flags FROM ({_STEPS_SQL}) s GROUP BY function_id")
def lifecycle_stream(x):
    events = sync.read_stream(x.spark, x.sf_dir, "events")
    effect = F.when(F.col("event_type") == "signup", "alloc").when(F.col("event_type") == "purchase", "free").when(F.col("event_type") == "error", "nullify").when(F.col("event_type") == "click", "store").otherwise("call")
    return sync.lifecycle_states(events.select(F.col("user_id").alias("function_id"), F.col("event_id").alias("effect_id"), effect.alias("effect")))


@query("", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedup_latest_stream(x):
    events = sync.read_stream(x.spark, x.sf_dir, "events").select("user_id", "event_type", "event_id")
    return sync.latest_per_key(events, ["user_id", "event_type"], ["event_id"])


@query("", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_stream(x):
    events = sync.read_stream(x.spark, x.sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sync.windowed_counts(events, "ts", "1 hour", "30 days", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "cg_effects",
    """WITH c AS (SELECT DISTINCT function_id AS switch_id, ord % 6 AS case_id, effect, function_id % 7 AS resource FROM cg_effects WHERE effect <> 'call'),
n AS (SELECT switch_id, count(DISTINCT case_id) AS n FROM c GROUP BY 1), m AS (SELECT switch_id, resource, effect, count(DISTINCT case_id) AS k FROM c GROUP BY 1, 2, 3)
SELECT m.switch_id, m.resource, m.effect, e.case_id AS missing_case FROM m JOIN n ON m.switch_id = n.switch_id JOIN (SELECT DISTINCT switch_id, case_id FROM c) e ON e.switch_id = m.switch_id
WHERE n.n >= 3 AND m.k = n.n - 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.switch_id = m.switch_id AND c.case_id = e.case_id AND c.resource = m.resource AND c.effect = m.effect)""",
)
def all_but_one_outlier(x):
    cases = x.effects.where("effect <> 'call'").select(F.col("function_id").alias("switch_id"), (F.col("ord") % 6).alias("case_id"), (F.col("function_id") % 7).alias("resource"), "effect")
    return semantic.all_but_one(cases)


@query(
    "cg_effects",
    """WITH f AS (SELECT function_id, ord % 5 AS branch_id, bool_or(ord % 2 = 0 AND effect = 'free') AS ft, bool_or(ord % 2 <> 0 AND effect = 'free') AS ff, bool_or(ord % 2 = 0 AND effect = 'alloc') AS at_, bool_or(ord % 2 <> 0 AND effect = 'alloc') AS af, bool_or(ord % 2 = 0 AND effect = 'store') AS wt, bool_or(ord % 2 <> 0 AND effect = 'store') AS wf FROM cg_effects GROUP BY 1, 2)
SELECT function_id, branch_id, CASE WHEN (ft AND (at_ OR wt) AND NOT (ff OR af OR wf)) OR (ff AND (af OR wf) AND NOT (ft OR at_ OR wt)) THEN 'pair' WHEN ft <> ff THEN 'free' WHEN at_ <> af THEN 'alloc' ELSE 'write' END AS issue FROM f WHERE ft <> ff OR at_ <> af OR wt <> wf""",
)
def branch_asymmetry(x):
    rows = x.effects.select("function_id", (F.col("ord") % 5).alias("branch_id"), (F.col("ord") % 2 == 0).alias("side"), F.lit("r").alias("resource"), "effect")
    return semantic.branch_differences(rows).select("function_id", "branch_id", "issue")


_RULES = [("r1", "*", "alloc", "blue", "prefix", 0.9), ("r2", "go", "free", "gear", "suffix", 0.8), ("r3", "*", "escape", "*widg*", "glob", 0.7), ("r4", "c", "alloc", "^(red|large)_.*$", "regex", 0.6)]


@query(
    "cg_files cg_symbols",
    """SELECT name, language, rule_id FROM (SELECT n.name, n.language, r.rule_id, row_number() OVER (PARTITION BY n.name, n.language ORDER BY CASE WHEN r.language = '*' THEN 1 ELSE 0 END, r.c DESC, r.rule_id) AS n
FROM (SELECT DISTINCT name, language FROM cg_symbols) n JOIN (VALUES ('r1', '*', 0.9), ('r2', 'go', 0.8), ('r3', '*', 0.7), ('r4', 'c', 0.6)) r(rule_id, language, c) ON r.language IN ('*', n.language)
AND CASE r.rule_id WHEN 'r1' THEN starts_with(n.name, 'blue') WHEN 'r2' THEN ends_with(n.name, 'gear') WHEN 'r3' THEN contains(n.name, 'widg') ELSE regexp_matches(n.name, '^(red|large)_.*$') END) x WHERE n = 1""",
)
def rule_match(x):
    rules = x.spark.createDataFrame([(*r, "enabled") for r in _RULES], "rule_id string, language string, rule_kind string, pattern string, pattern_kind string, confidence double, status string")
    return semantic.match_rules(x.symbols, rules).select("name", "language", "rule_id")


@query("cg_files cg_symbols", "SELECT name, kind AS role, n FROM (SELECT name, kind, count(*) AS n, sum(count(*)) OVER (PARTITION BY name) AS t FROM cg_symbols GROUP BY name, kind) x WHERE n >= 5 AND n >= 0.3 * t")
def learned_rules(x):
    return semantic.learn_rules(x.symbols.select("name", F.col("kind").alias("role")), 5, 0.3).select("name", "role", "n")


@query("cg_imports", "SELECT DISTINCT module FROM cg_imports WHERE module <> ''")
def import_modules(x):
    return x.imports.where("module <> ''").select("module").distinct()

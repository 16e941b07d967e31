"""Point, keyed and ladder lookups over the lens."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.plans.registry import query


@query("cg_files cg_symbols cg_refs", "SELECT kind, count(*) AS n FROM cg_refs WHERE file_id IN (SELECT file_id FROM cg_files WHERE starts_with(path, 'ASIA/')) GROUP BY kind")
def references_by_kind(x):
    some = x.files.where(C.in_scope(F.col("path"), "ASIA")).select("file_id")
    return x.refs.join(some, "file_id", "left_semi").groupBy("kind").agg(F.count("*").alias("n"))


@query("cg_files cg_symbols cg_edges", "SELECT DISTINCT e.source, e.target, e.kind FROM cg_edges e JOIN cg_symbols s ON s.symbol_id IN (e.source, e.target) WHERE s.file_id IN (1, 2, 3)")
def edges_touching_files(x):
    mine = x.symbols.where("file_id IN (1, 2, 3)").select("symbol_id")
    edges = x.edges.select("source", "target", "kind")
    out = edges.join(mine, F.col("source") == F.col("symbol_id"), "left_semi")
    return out.unionByName(edges.join(mine, F.col("target") == F.col("symbol_id"), "left_semi")).distinct()


@query("cg_files cg_symbols", "SELECT DISTINCT name, file_id FROM cg_symbols WHERE lower(name) = lower('Blue_GEAR')")
def symbol_hints(x):
    return x.symbols.where(F.lower("name") == F.lower(F.lit("Blue_GEAR"))).select("name", "file_id").distinct()


@query("", "SELECT doc_id FROM documents WHERE contains(text, 'thtion')")
def candidate_files(x):
    return x.table("documents").where(F.col("text").contains("thtion")).select("doc_id")


@query("cg_files cg_symbols", "SELECT symbol_id FROM cg_symbols WHERE file_id = 3 AND kind = 'class' AND start_byte >= 300 AND end_byte <= 199999")
def nodes_in_range(x):
    return x.symbols.where("file_id = 3 AND kind = 'class' AND start_byte >= 300 AND end_byte <= 199999").select("symbol_id")


@query("cg_edges", "SELECT source AS node, target AS neighbour, kind FROM cg_edges UNION SELECT target, source, kind FROM cg_edges")
def neighbour_kinds(x):
    out = x.edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "kind")
    back = x.edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "kind")
    return out.unionByName(back).distinct()


@query("cg_edges", "SELECT target AS symbol_id, source AS used_by FROM cg_edges")
def usage_symbols(x):
    return x.edges.select(F.col("target").alias("symbol_id"), F.col("source").alias("used_by"))


@query(
    "cg_files",
    """SELECT q, file_id FROM (SELECT q, f.file_id, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN f.path = q THEN 0 WHEN ends_with(f.path, '/' || q) THEN 1 ELSE 2 END, f.path) AS n
FROM (SELECT CASE file_id % 3 WHEN 0 THEN path WHEN 1 THEN split_part(path, '/', -1) ELSE '/root/project/' || path END AS q FROM cg_files) s JOIN cg_files f ON split_part(f.path, '/', -1) = split_part(s.q, '/', -1) AND (f.path = q OR ends_with(f.path, '/' || q) OR ends_with(q, '/' || f.path))) x WHERE n = 1""",
)
def file_ladder(x):
    base = lambda p: F.substring_index(p, "/", -1)
    q = F.when(F.col("file_id") % 3 == 0, F.col("path")).when(F.col("file_id") % 3 == 1, base("path")).otherwise(F.concat(F.lit("/root/project/"), "path"))
    asked = x.files.select(q.alias("q")).withColumn("b", base("q"))
    found = asked.join(x.files.select("file_id", "path", base("path").alias("b")), "b")
    rank = F.when(F.col("path") == F.col("q"), 0).when(F.col("path").endswith(F.concat(F.lit("/"), F.col("q"))), 1).when(F.col("q").endswith(F.concat(F.lit("/"), F.col("path"))), 2)
    ranked = found.withColumn("rank", rank).where("rank IS NOT NULL")
    return ranked.groupBy("q").agg(F.min_by("file_id", F.struct("rank", "path")).alias("file_id"))


@query("cg_files cg_symbols", "SELECT symbol_id, array_to_string(list_filter([CASE WHEN kind <> 'class' THEN 'kind' END, CASE WHEN language <> 'go' THEN 'language' END, CASE WHEN NOT starts_with(path, 'ASIA/') THEN 'path' END], lambda m: m IS NOT NULL), ',') AS mismatches FROM cg_symbols WHERE name = 'blue_gear'")
def selector_mismatches(x):
    wrong = F.array_compact(F.array(F.when(F.col("kind") != "class", "kind"), F.when(F.col("language") != "go", "language"), F.when(~C.in_scope(F.col("path"), "ASIA"), "path")))
    return x.symbols.where("name = 'blue_gear'").select("symbol_id", F.array_join(wrong, ",").alias("mismatches"))


@query("cg_files cg_symbols cg_refs", "SELECT r.reference_id, s.kind AS source_kind FROM cg_refs r JOIN cg_symbols s ON r.source_symbol = s.symbol_id WHERE r.kind = 'call' AND s.kind NOT IN ('function', 'method', 'constructor')")
def non_callable_sources(x):
    calls = x.refs.where("kind = 'call'").select("reference_id", F.col("source_symbol").alias("symbol_id"))
    return calls.join(x.symbols.select("symbol_id", F.col("kind").alias("source_kind")), "symbol_id").where(~F.col("source_kind").isin("function", "method", "constructor")).select("reference_id", "source_kind")


@query("", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def job_status_counts(x):
    return x.table("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("", "SELECT concat_ws('|', (SELECT count(*) FROM documents), (SELECT count(*) FROM labels), (SELECT max(event_id) FROM events)) AS signature")
def index_signature(x):
    one = lambda t, c, name: x.table(t).agg(c.cast("string").alias(name))
    parts = one("documents", F.count("*"), "a").crossJoin(one("labels", F.count("*"), "b")).crossJoin(one("events", F.max("event_id"), "c"))
    return parts.select(F.concat_ws("|", "a", "b", "c").alias("signature"))

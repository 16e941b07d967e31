"""The driver tables seen as code facts.

Each view is one SQL text that Spark and DuckDB read alike, so queries and their
oracles start from the same facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "cg_files": """
SELECT s_suppkey AS file_id, concat(r_name, '/', n_name, '/', CASE WHEN s_suppkey % 7 = 0 THEN 'tests/' ELSE '' END, s_name, '.src') AS path,
 CASE s_suppkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'go' ELSE 'c' END AS language
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "cg_symbols": """
SELECT p_partkey AS symbol_id, f.file_id, replace(p_name, ' ', '_') AS name, concat(replace(p_brand, '#', '_'), '.', replace(p_name, ' ', '_')) AS qualified_name,
 CASE p_size % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'struct' ELSE 'variable' END AS kind, f.language, f.path,
 p_partkey * 100 AS start_byte, p_partkey * 100 + p_size AS end_byte
FROM part CROSS JOIN (SELECT count(*) AS n_sup FROM supplier) c JOIN cg_files f ON f.file_id = p_partkey % n_sup""",
    "cg_edges": """
SELECT source, target, kind, max(confidence) AS confidence, max(provenance) AS provenance FROM (
 SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS target,
  CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'references' ELSE 'instantiates' END AS kind, 1.0 - l_discount AS confidence,
  CASE l_linestatus WHEN 'O' THEN 'tree_sitter' ELSE 'heuristic' END AS provenance FROM lineitem) t
WHERE target IS NOT NULL AND source <> target GROUP BY source, target, kind""",
    "cg_refs": """
SELECT o_orderkey AS reference_id, o_orderkey % n_sup AS file_id, s.name AS name, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'call' WHEN '2' THEN 'instantiation' WHEN '3' THEN 'inheritance' WHEN '4' THEN 'type' ELSE 'call' END AS kind,
 o_orderkey * 7 % (n_part * 100) AS pos, o_custkey % n_part AS source_symbol, s.symbol_id AS target
FROM orders CROSS JOIN (SELECT count(*) AS n_sup FROM supplier) c CROSS JOIN (SELECT count(*) AS n_part FROM part) p JOIN cg_symbols s ON s.symbol_id = o_orderkey % n_part""",
    "cg_scopes": """
SELECT 'r' || r_regionkey AS scope_id, CAST(NULL AS varchar(20)) AS parent_id, r_name AS name FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier""",
    "cg_bindings": """
SELECT event_id AS binding_id, user_id AS scope_id, event_type AS name, event_id * 3 AS visible_from FROM events WHERE event_type <> 'view'""",
    "cg_uses": """
SELECT event_id AS use_id, user_id AS scope_id, CASE event_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'signup' WHEN 2 THEN 'error' ELSE 'purchase' END AS name, event_id * 3 + 1 AS pos FROM events WHERE event_type = 'view'""",
    "cg_effects": """
SELECT user_id AS function_id, event_id AS effect_id, CASE event_type WHEN 'signup' THEN 'alloc' WHEN 'purchase' THEN 'free' WHEN 'error' THEN 'nullify' WHEN 'click' THEN 'store' ELSE 'call' END AS effect, event_id AS ord FROM events""",
    "cg_imports": """
SELECT page_id AS file_id, url AS path, u.module AS module FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages) p, UNNEST(hrefs) AS u(module)""",
    "cg_state": """
SELECT d.doc_id AS file_id, CASE WHEN l.doc_id IS NULL THEN 'manifest' WHEN l.toxic = 1 THEN 'dataflow' ELSE 'structural' END AS layer,
 CASE WHEN l.doc_id IS NULL THEN 1 WHEN l.toxic = 1 THEN 23 ELSE 3 END AS mask, CASE WHEN l.quality = 0 THEN 'stale' ELSE 'fresh' END AS status, d.source AS scope
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "cg_resolutions": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS reference_id, l_partkey AS target, CASE WHEN l_linestatus = 'O' THEN true ELSE false END AS is_visible, l_suppkey AS closure_id, 1.0 - l_discount AS confidence FROM lineitem""",
}

#: What each view reads, so an oracle inlines only what it needs.
_NEEDS = {"cg_symbols": ("cg_files",), "cg_refs": ("cg_files", "cg_symbols")}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` preceded by the named views (and what they need) as common table expressions."""
    order: list[str] = []
    for name in names.split():
        for n in (*_NEEDS.get(name, ()), name):
            if n not in order:
                order.append(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if body.upper().startswith("WITH "):
        return head + (ctes + ",\n" if ctes else "") + body[5:]
    return (head + ctes + "\n" if ctes else "") + body


class Lens:
    """The views as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._known[name]

    def __getattr__(self, name: str) -> DataFrame:
        view = f"cg_{name}"
        if name.startswith("_") or view not in VIEWS:
            raise AttributeError(name)
        if view not in self._known:
            sql = VIEWS[view].replace("FROM (SELECT page_id, url, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS hrefs FROM pages) p, UNNEST(hrefs) AS u(module)", "FROM (SELECT page_id, url, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS hrefs FROM pages) p LATERAL VIEW explode(hrefs) u AS module")
            for used in _NEEDS.get(view, ()):
                getattr(self, used.removeprefix("cg_")).createOrReplaceTempView(used)
            for t in TABLES:
                if t in sql:
                    self.table(t).createOrReplaceTempView(t)
            self._known[view] = self.spark.sql(sql)
        return self._known[view]

"""What keeps queries in bounds on large tables: plans without products, and results of the plans that replace them."""

import re

from pyspark.sql import functions as F

from weftgraph.operators import joins, resolve
from weftgraph.plans import flows, registry  # noqa: F401  (each adds its queries)


def products(spark, name):
    """Joins of a query without an equal key, but for those with a lone count."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?:CartesianProduct|NestedLoopJoin)[^\n]*(?:n_sup|nonnulls)[^\n]*", plan)


def most_rows(df, kind="Join"):
    """The most rows that a join, or another kind of step, of a frame that has run gave."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, most = [plan], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if kind in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
    assert most
    return most


def test_rules_meet_names_without_a_product(spark):
    assert products(spark, "rule_match") == []


def test_close_names_nearby_without_a_product(spark):
    assert products(spark, "fuzzy_nearby") == []


def test_callbacks_reduce_functions_before_the_join(spark):
    functions = spark.createDataFrame([(1, "f", 10), (2, "f", 20), (3, "f", 20), (4, "g", 30), (5, None, 10), (6, "h", None)], "symbol_id long, name string, file_id long")
    calls = spark.createDataFrame([(7, "atexit", 20, ["f"]), (7, "atexit", 20, ["f"]), (8, "atexit", 30, ["f"]), (9, "atexit", 10, ["g"]), (7, "atexit", 10, ["none"]), (7, "atexit", None, ["f"]), (7, "other", 10, ["f"]), (7, "atexit", 10, [None]), (9, "atexit", 10, ["h"])], "caller long, callee string, file_id long, args array<string>")
    found = joins.callback_edges(calls, functions)
    assert sorted((r.source, r.target) for r in found.collect()) == [(7, 1), (7, 2), (8, 1), (9, 4), (9, 6)]
    many = spark.range(400).select(F.col("id").alias("symbol_id"), F.lit("f").alias("name"), (F.col("id") % 50).alias("file_id"))
    busy = many.select(F.col("symbol_id").alias("caller"), F.lit("atexit").alias("callee"), "file_id", F.array("name").alias("args"))
    found = joins.callback_edges(busy, many)
    assert sorted((r.source, r.target) for r in found.collect()) == [(k, k % 50) for k in range(400)]
    assert most_rows(found) <= 400


def test_relative_modules_are_looked_up_once(spark):
    paths = ["a/m.ts", "a/m.py", "a/m", "b/n/index.ts", "b/n.js", "b/p/mod.rs", "c.go", "a/q.py", "a/q.py"]
    files = spark.createDataFrame(list(enumerate(paths)), "file_id long, path string")
    asked = [("a/x.ts", "./m"), ("a/x.ts", "./m.py"), ("b/x.ts", "./n"), ("b/x.ts", "../b/p"), ("x.go", "./c"), (None, "c"), ("a/x.py", "./q"), ("a/x.py", "./none"), ("b/n/x.ts", None)]
    imports = spark.createDataFrame([(k, *a) for k, a in enumerate(asked)], "import_id long, importer_path string, module string")
    assert sorted(tuple(r) for r in joins.relative_modules(imports, files).collect()) == [(0, 2), (1, 1), (2, 4), (3, 5), (4, 6), (5, 6), (6, 7), (8, 4)]
    many = spark.range(1000).select(F.col("id").alias("import_id"), F.lit("a/x.ts").alias("importer_path"), F.lit("./m").alias("module"))
    found = joins.relative_modules(many, files)
    assert sorted(tuple(r) for r in found.collect()) == [(k, 2) for k in range(1000)]
    assert most_rows(found, "Generate") < 100


def test_resolution_broadcasts_no_table_of_references_or_symbols(spark):
    files = spark.range(20).select(F.col("id").alias("file_id"), F.concat(F.lit("a/f"), "id").alias("path"), F.lit("go").alias("language"))
    symbols = spark.range(60).select(F.col("id").alias("symbol_id"), (F.col("id") % 20).alias("file_id"), F.concat(F.lit("name"), F.col("id") % 30).alias("name"), F.lit("function").alias("kind")).join(files, "file_id")
    references = spark.range(90).select(F.col("id").alias("reference_id"), (F.col("id") % 20).alias("file_id"), F.concat(F.lit("name"), F.col("id") % 35).alias("name"), F.lit("type").alias("kind")).join(files, "file_id")
    imports = spark.createDataFrame([(0, "name5", 15)], "file_id long, name string, target_file long")
    store = spark._jsparkSession.sharedState().statusStore()
    began = store.executionsCount()
    assert {r.strategy for r in resolve.resolve(references, symbols, imports).collect()} >= {"same_file", "exact_name", "fuzzy"}
    plans = [store.executionsList(began, 10_000).apply(i).physicalPlanDescription() for i in range(store.executionsCount() - began)]
    keys = re.findall(r"BroadcastHashJoin[^\n]*\nLeft keys \[\d+\]: \[([^\]]*)\]", "\n".join(plans))
    assert any(k.startswith("k#") for k in keys)  # names of very many references still are
    assert [k for k in keys if re.match("reference_id|file_id#[0-9L]+, name|target_file", k)] == []


def test_strategies_are_counted_without_such_broadcasts(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    began = store.executionsCount()
    assert [r.strategy for r in registry.QUERIES["resolve_strategies"](spark, "/root/testdata/sf0.001").collect()] == ["same_file"]
    plans = [store.executionsList(began, 10_000).apply(i).physicalPlanDescription() for i in range(store.executionsCount() - began)]
    keys = re.findall(r"BroadcastHashJoin[^\n]*\nLeft keys \[\d+\]: \[([^\]]*)\]", "\n".join(plans))
    assert [k for k in keys if re.match("reference_id|file_id#[0-9L]+, name", k)] == []


def test_resolution_carries_no_paths(spark, monkeypatch):
    written = []
    monkeypatch.setattr(resolve, "cut", lambda df, name, f=resolve.cut: written.append((name, df.columns)) or f(df, name))
    assert [tuple(r) for r in registry.QUERIES["resolve_strategies"](spark, "/root/testdata/sf0.001").collect()] == [("same_file", 1500)]
    tables = [columns for name, columns in written if name == "refs"]
    assert tables and all({"path", "language"}.isdisjoint(c) for c in tables)

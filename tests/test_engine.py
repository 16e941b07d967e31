"""A small Python project end to end, and the registered queries against their oracles."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weftgraph.api import Engine
from weftgraph.plans import lookups, more, registry  # noqa: F401
from weftgraph.plans.lens import TABLES
from weftgraph.sources import files
from weftgraph.streaming.watch import Watcher

FIXTURE = "/root/testdata/sf0.001"
PROJECT = {
    "math_ops.py": "def add(a, b):\n    return a + b\n\ndef twice(x):\n    if x:\n        y = add(x, x)\n    else:\n        y = 0\n    return y\n",
    "greeter.py": "from math_ops import twice\n\nclass Base:\n    pass\n\nclass Greeter(Base):\n    def greet(self, n):\n        for i in range(n):\n            twice(i)\n        return helper()\n\ndef helper():\n    return Greeter()\n",
    "broken.py": "def (:\n",
    "notes.txt": "not a source",
    "latin.py": "# caf\xe9\nx = 1\n",
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in PROJECT.items():
        (root / name).write_bytes(text.encode("latin-1"))
    return str(root)


def test_discovery_and_decoding(spark, project):
    assert sorted(r.path for r in files.discover(spark, project, exclude=["bro*"]).collect()) == ["greeter.py", "latin.py", "math_ops.py"]
    assert files.discover(spark, project, limit=2).count() == 3
    assert files.decode_bytes("中文".encode("gbk")) == ("中文", "gbk")
    assert files.decode_bytes(b"caf\xe9") == ("café", "cp1252")
    texts = {r.path: r for r in files.read_sources(spark, project).collect()}
    assert texts["latin.py"].encoding == "cp1252" and texts["latin.py"].raw_hash != texts["latin.py"].text_hash
    assert files.path_aliases('{"compilerOptions": {"baseUrl": "./src", "paths": {"@a/*": ["./a/*"]}}}') == [("@a/*", "src/a/*")]


def test_index_and_questions(spark, project):
    engine = Engine.index(spark, project)
    assert [(r.kind, r.name) for r in engine.facts["facts"].where("fact = 'diagnostic'").select("kind", "name").collect()][0][0] == "SyntaxError"
    symbols = {r.name: r.symbol_id for r in engine.facts["symbols"].collect()}
    assert set(symbols) == {"add", "twice", "Base", "Greeter", "greet", "helper"}
    name = {v: k for k, v in symbols.items()}
    edges = {(name[r.source], name[r.target], r.kind) for r in engine.facts["edges"].collect()}
    assert {("twice", "add", "calls"), ("greet", "twice", "calls"), ("greet", "helper", "calls"), ("helper", "Greeter", "instantiates"), ("Greeter", "Base", "extends")} <= edges
    seed = spark.createDataFrame([(symbols["greet"],)], "symbol_id string")
    assert {name[r.node] for r in engine.calls(seed, "outgoing", 3).collect()} == {"greet", "twice", "add", "helper", "Greeter"}
    assert [r.name for r in engine.search("gree").collect()][0] in ("Greeter", "greet")
    assert engine.symbol("add")[0] == "single"
    pair = spark.createDataFrame([(symbols["greet"], symbols["add"])], "source_id string, target_id string")
    assert [[name[n] for n in r.nodes] for r in engine.path(pair).collect()] == [["greet", "twice", "add"]]
    at = engine.symbol_at("math_ops.py", PROJECT["math_ops.py"].index("y = add")).collect()
    assert [name[r.symbol_id] for r in at] == ["twice"]
    changes = engine.changes(spark.createDataFrame([("math_ops.py", "other"), ("new.py", "h")], "path string, content_hash string"))
    assert {r.path: r.change for r in changes.collect()}["math_ops.py"] == "modified"
    assert engine.explore(seed)["callees"].count() == 2 and engine.status().count() == len(engine.facts)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["seed", "node", "depth"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FIXTURE}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, bool)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, oracle, name):
    df = registry.QUERIES[name](spark, FIXTURE)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    found = oracle.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert sorted(columns) == order and got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, FIXTURE).count() >= 0


def test_pushdown(spark):
    from weftgraph.plans.lens import Lens

    plan = Lens(spark, FIXTURE).table("lineitem").where(F.col("l_orderkey") == 7).select("l_partkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,7)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan


def test_dependencies_between_files_and_watch(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    return 1\n")
    (tmp_path / "b.py").write_text("from a import f\n\ndef g():\n    return f()\n")
    (tmp_path / "c.py").write_text("import a\nimport os\n")
    engine = Engine.index(spark, str(tmp_path))
    rows = lambda df: {tuple(r) for r in df.select("file_id", "depends_on", "source").collect()}
    assert rows(engine.file_dependencies("edges")) == {("b.py", "a.py", "edges")}
    assert ("c.py", "a.py", "manifest") in rows(engine.file_dependencies()) and ("b.py", "a.py", "edges") in rows(engine.file_dependencies())
    assert {r[0] for r in rows(engine.dependents(spark.createDataFrame([("a.py",)], "file_id string")))} == {"b.py", "c.py"}
    watch = Watcher(spark, str(tmp_path))
    assert watch.poll().collect() == []
    (tmp_path / "a.py").write_text("def f():\n    return 22\n")
    (tmp_path / "c.py").unlink()
    (tmp_path / "d.py").write_text("x = 1\n")
    assert {r.path: r.change for r in watch.poll().collect()} == {"a.py": "modified", "c.py": "deleted", "d.py": "new"}
    assert list(watch.events(0, 2)) == []

"""Operators on small literal graphs, scopes, effects and names."""

import math

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.operators import graph, incremental, joins, resolve, search, semantic, trace
from weftgraph.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def edges(spark):
    data = [(1, 2, "calls", 0.9, "tree_sitter"), (2, 3, "calls", 0.8, "heuristic"), (3, 1, "calls", 1.0, "tree_sitter"), (2, 2, "calls", 1.0, "tree_sitter"), (1, 2, "references", 0.5, "tree_sitter"), (3, 4, "instantiates", 1.0, "tree_sitter"), (4, 99, "calls", 1.0, "tree_sitter"), (5, None, "calls", 1.0, "tree_sitter"), (1, 4, "calls", 0.1, "heuristic")]
    return spark.createDataFrame(data, "source int, target int, kind string, confidence double, provenance string")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(k, f"src/m{k}.py" if k != 4 else "tests/m4.py", f"m.f{k}") for k in range(1, 7)], "symbol_id int, path string, qualified_name string")


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "symbol_id int")


def test_bfs(spark, edges, nodes):
    assert rows(graph.bfs(edges, seeds(spark, 1), 5)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 1), (1, 99, 2)]
    assert rows(graph.bfs(edges, seeds(spark, 1), 3, include_start=False)) == [(1, 1, 3), (1, 2, 1), (1, 3, 2), (1, 4, 1), (1, 99, 2)]
    assert rows(graph.bfs(edges, seeds(spark, 4), 1, "incoming")) == [(4, 1, 1), (4, 3, 1), (4, 4, 0)]
    assert rows(graph.bfs(edges, seeds(spark, 1), 2, limit=2)) == [(1, 1, 0), (1, 2, 1)]
    assert rows(graph.bfs(edges, seeds(spark), 2)) == []
    assert rows(graph.bfs(edges.limit(0), seeds(spark, 7), 2)) == [(7, 7, 0)]
    with pytest.raises(ValueError):
        graph.kinds_filter(edges, ("*", "calls"), C.CALL)
    assert graph.kinds_filter(edges, ("*",), C.CALL).count() == graph.kinds_filter(edges, (), C.CALL).count() == 9


def test_snapshot_and_degrees(edges, nodes):
    assert graph.snapshot_edges(edges, nodes, 0.5).count() == 6
    assert dict(rows(graph.degrees(edges)))[2] == 5
    assert rows(graph.forward_frontier(edges, nodes.where("symbol_id = 1").select("symbol_id"), 4)) == [(1, 99, 2)]


def test_shortest_and_ranked_paths(spark, edges, nodes):
    weighted = graph.weighted(edges, nodes)
    cost = {(a, b): c for a, b, c, _ in rows(graph.shortest_costs(weighted, seeds(spark, 1), 4))}
    assert cost[1, 2] == 1.05 and math.isclose(cost[1, 3], 1.05 + 1.4) and math.isclose(cost[1, 4], 1 + 0.45 + 0.3 + 0.5)
    pairs = spark.createDataFrame([(1, 4), (1, 1), (1, 6)], "source_id int, target_id int")
    paths = graph.ranked_paths(weighted, pairs, 4, 5)
    assert [(r.nodes, r["rank"]) for r in paths.where("target_id = 4").orderBy("rank").collect()] == [([1, 4], 1), ([1, 2, 3, 4], 2)]
    penalty = spark.createDataFrame([(4, 0.5)], "node int, penalty double")
    scored = {tuple(r.nodes): r for r in graph.path_scores(paths, graph.degrees(edges), penalty).collect()}
    assert scored[(1,)].overall == 1.0
    assert math.isclose(scored[1, 4].overall, 0.4 * 0.75 + 0.35 * 0.1 + 0.25 * 0.7)
    assert math.isclose(scored[1, 2, 3, 4].topology, (0.9 + 0.8 + 0.7) / 3)


def test_impact_with_members(spark, edges):
    members = spark.createDataFrame([(6, 3)], "container int, symbol_id int")
    assert rows(graph.impact(edges, seeds(spark, 6), 1, children=members)) == [(6, 1, 1), (6, 3, 0), (6, 4, 1), (6, 6, 0)]


def test_edge_derivation_and_policy(spark):
    symbols = spark.createDataFrame([(1, "function", None), (2, "class", None), (3, "method", 2), (4, "trait", None), (5, "variable", None)], "symbol_id int, kind string, container_id int")
    refs = spark.createDataFrame([(1, 1, "call", 2), (2, 1, "call", 3), (3, 1, "call", 4), (4, 1, "call", 5), (5, 2, "inheritance", 4), (6, 1, "type", 5), (7, 1, "call", 77), (8, 88, "call", 2)], "reference_id int, source_symbol int, kind string, target int").selectExpr("*", "1.0D AS confidence", "'p' AS provenance")
    assert [r[:3] for r in rows(graph.derive_edges(refs, symbols).select("source", "target", "kind"))] == [(1, 2, "instantiates"), (1, 3, "calls"), (1, 4, "implements"), (1, 5, "references"), (2, 3, "contains"), (2, 4, "extends")]


def test_joins(spark):
    ranges = spark.createDataFrame([("f", 1, 0, 100), ("f", 2, 10, 50), ("f", 3, 50, 60), ("f", 4, 20, 20), ("g", 5, 0, 5000)], "file string, rid int, start_byte int, end_byte int")
    points = spark.createDataFrame([(1, "f", 20), (2, "f", 50), (3, "f", 100), (4, "f", 101), (5, "g", 4999), (6, None, 1)], "pid int, file string, pos int")
    assert [(r.pid, r.rid) for r in joins.innermost(points, ranges, ["file"], bucket=16).orderBy("pid").collect()] == [(1, 4), (2, 3), (3, 1), (5, 5)]
    uses = spark.createDataFrame([(1, "s", "x", 10), (2, "s", "x", 4), (3, "s", "x", 5), (4, None, "x", 9)], "use_id int, scope_id string, name string, pos int")
    binds = spark.createDataFrame([(1, "s", "x", 5), (2, "s", "x", 8), (3, "s", "x", 8)], "binding_id int, scope_id string, name string, visible_from int")
    assert {r.use_id: r.binding_id for r in joins.asof(uses, binds, ["scope_id", "name"]).collect()} == {1: 3, 2: None, 3: 1, 4: None}
    scopes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "scope_id string, parent_id string")
    closure = joins.scope_closure(scopes)
    assert ("c", "a", 2) in rows(closure) and ("x", "y", 1) in rows(closure)
    named = spark.createDataFrame([(1, "a", "n"), (2, "b", "n")], "declaration_id int, scope_id string, name string")
    asked = spark.createDataFrame([(1, "c", "n"), (2, "a", "n"), (3, "c", "m")], "use_id int, scope_id string, name string")
    assert rows(joins.lookup_in_scopes(asked, named, closure)) == [(1, 2, 1), (2, 1, 0)]


def test_import_joins(spark):
    exports = spark.createDataFrame([("a", "x", "b", "y"), ("b", "*", "c", None), ("d", "z", "e", "z"), ("e", "z", "d", "z")], "file_id string, name string, to_file string, to_name string")
    wanted = spark.createDataFrame([(1, "a", "x"), (2, "d", "z"), (3, "q", "w")], "import_id int, file_id string, name string")
    assert rows(joins.reexport_targets(wanted, exports)) == [(1, "c", "y", 2), (3, "q", "w", 0)]
    files = spark.createDataFrame([(1, "src/a.ts"), (2, "src/lib/index.ts"), (3, "inc/x.h"), (4, "src/x.h")], "file_id int, path string")
    imports = spark.createDataFrame([(1, "src/b.ts", "./a"), (2, "src/deep/c.ts", "../lib"), (3, "src/b.ts", "./none")], "import_id int, importer_path string, module string")
    assert rows(joins.relative_modules(imports, files)) == [(1, 1), (2, 2)]
    includes = spark.createDataFrame([(1, "src/b.c", "x.h"), (2, "other/b.c", "x.h")], "import_id int, importer_path string, module string")
    assert rows(joins.include_paths(includes, ["inc"], files)) == [(1, 4), (2, 3)]
    modules = spark.createDataFrame([(1, "@app/x"), (2, "@app/core/y"), (3, "z")], "import_id int, module string")
    assert rows(joins.alias_expansion(modules, [("@app/*", "src/*"), ("@app/core/*", "core/*")])) == [(1, "src/x"), (2, "core/y"), (3, "z")]


def test_names_and_search(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(C.name_parts(F.lit("XMLParser_v2"))) == ["xml", "parser", "v", "2"]
    ladder = [("User", "User", 1.0), ("user", "User", 0.9), ("user", "UserManager", 0.92), ("getUser", "get_user", 0.85), ("createUser", "user_find", 0.625), ("abc", "xyz", 0.0)]
    for q, n, s in ladder:
        assert math.isclose(one(C.name_similarity(F.lit(q), F.lit(n))), s, abs_tol=1e-9), (q, n)
    assert one(C.normal_path(F.lit("a/b"), F.lit("../c/./d"))) == "a/c/d"
    for path, test in (("latest/x.c", True), ("src/a_test.go", True), ("src/main.c", False), ("a/testimony.c", True), ("x/b.spec.ts", True)):
        assert one(C.is_test_path(F.lit(path))) is test, path
    names = ["UserManager", "createUser", "deleteUser", "UserRouter", "findUser", "get_user_name"]
    symbols = spark.createDataFrame([(k, n, f"m.{n}", "function", "a/b.py", "python") for k, n in enumerate(names)], "symbol_id int, name string, qualified_name string, kind string, path string, language string")
    assert [r.name for r in search.search(symbols, "user").collect()][:2] == ["UserManager", "UserRouter"]
    assert [r.name for r in search.search(symbols, "createUsr kind:fn").collect()] == ["createUser"]
    assert search.search(symbols, "").count() == 0 and search.search(symbols, "zzzzqqq").count() == 0
    assert search.parse_query("kind:fn foo: lang:go bar") == {"kind": "function", "lang": "go", "text": "foo: bar"}
    assert rows(joins.fuzzy_names(spark.createDataFrame([("creatUser",), (None,)], "query string"), symbols.select("name"))) == [("creatUser", "createUser", 1)]
    assert search.unique_selection(search.selector_scores(symbols, "findUser"))[0] == "single"
    assert search.unique_selection(search.selector_scores(symbols, "nothing"))[0] == "not_found"


def test_resolution_order(spark):
    symbols = spark.createDataFrame([(1, "f", "src/a.py", "run", "function"), (2, "g", "src/b.py", "walk", "function"), (3, "h", "lib/c.py", "walk", "function"), (4, "t", "tests/d.py", "helper", "function"), (5, "g", "src/b.py", "Configuration", "class")], "symbol_id int, file_id string, path string, name string, kind string")
    refs = spark.createDataFrame(
        [(1, "f", "src/a.py", "python", "run", "call"), (2, "f", "src/a.py", "python", "walk", "call"), (3, "f", "src/a.py", "python", "helper", "call"), (4, "f", "src/a.py", "python", "Configuratoin", "type"), (5, "f", "src/a.py", "python", "print", "call"), (6, "f", "src/a.py", "python", None, "call"), (7, "f", "src/a.py", "python", "WALK", "call"), (8, "f", "src/a.py", "python", "Configuratoin", "call")],
        "reference_id int, file_id string, path string, language string, name string, kind string",
    )
    got = {r[0]: r[1:] for r in rows(resolve.resolve(refs, symbols))}
    assert got[1] == (1, 1.0, "same_file") and got[2] == (2, 1.0, "exact_name") and got[7] == (2, 0.9, "exact_name")
    assert got[4][0] == 5 and got[4][2] == "fuzzy" and set(got) == {1, 2, 4, 7}
    imports = spark.createDataFrame([("f", "walk", "h"), ("f", "WALK", "h")], "file_id string, name string, target_file string")
    got = {r[0]: r[1:] for r in rows(resolve.resolve(refs, symbols, imports))}
    assert got[2] == (3, 0.8, "import") and 7 not in got


STATES = ["Unknown", "Assigned", "Freed", "Nullified", "Escaped", "MaybeFreed", "MaybeAssigned", "Top", "Bottom"]


def test_lattice():
    for a in STATES:
        for b in STATES:
            assert semantic.merge(a, b) == semantic.merge(b, a)
            assert semantic.merge(a, a) == a and semantic.merge("Bottom", a) == a
    assert semantic.merge("Freed", "Assigned") == "MaybeFreed" and semantic.merge("Assigned", "Unknown") == "MaybeAssigned" and semantic.merge("Nullified", "Escaped") == "Unknown"


def test_lifecycles(spark):
    nodes = spark.createDataFrame([(1, 0, "entry", None, None), (1, 1, "s", "alloc", "p"), (1, 2, "branch", None, None), (1, 3, "s", "free", "p"), (1, 4, "join", None, None), (1, 5, "s", "free", "p"), (1, 9, "s", "free", "p")], "function_id int, node_id int, kind string, effect string, place string")
    flow = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 2, 4), (1, 3, 4), (1, 4, 5), (1, 5, 4)], "function_id int, source int, target int")
    got = {r.node_id: (r.state, r.flag) for r in semantic.cfg_lifecycle(nodes, flow).collect()}
    assert got[3] == ("Freed", None) and got[4][0] == "MaybeFreed" and got[5] == ("Freed", "double_free") and 9 not in got
    effects = spark.createDataFrame([(1, k, e, k) for k, e in enumerate(["call", "alloc", "free", "call", "free", "store"])] + [(2, 10, "alloc", 10), (3, 11, "call", 11)], "function_id int, effect_id int, effect string, ord int")
    stepped = semantic.straight_lifecycle(effects)
    assert [r.flag for r in stepped.where("function_id = 1").orderBy("effect_id").collect()] == [None, None, None, None, "double_free", "use_after_free"]
    assert rows(semantic.lifecycle_proofs(stepped)) == [(1, "Assigned", 2, "suspicious"), (2, "Assigned", 0, "incomplete"), (3, "Unknown", 0, "incomplete")]


def test_branches_aliases_exits(spark):
    e = spark.createDataFrame([(1, 1, True, "p", "free"), (1, 1, True, "p", "write"), (1, 2, True, "p", "free"), (1, 2, False, "p", "write"), (1, 3, False, "q", "alloc"), (1, 4, True, "q", "write"), (1, 4, False, "q", "write")], "function_id int, branch_id int, side boolean, resource string, effect string")
    assert [(r[1], r[3], r[4], r[5]) for r in rows(semantic.branch_differences(e))] == [(1, "pair", "high", 0.85), (2, "free", "medium", 0.7), (3, "alloc", "medium", 0.65)]
    cases = spark.createDataFrame([(1, c, "p", "free") for c in (1, 2)] + [(1, 3, "q", "alloc"), (2, 1, "p", "free")], "switch_id int, case_id int, resource string, effect string")
    assert rows(semantic.all_but_one(cases)) == [(1, "p", "free", 3)]
    aliases = spark.createDataFrame([(1, "a", "b", 1), (1, "b", "c", 1), (1, "c", "d", 1), (1, "x", "y", 1), (1, "y", "x", 1), (1, "a", "z", 2)], "function_id int, name string, of string, ord int")
    roots = {r.name: r.root for r in semantic.alias_roots(aliases).collect()}
    assert (roots["a"], roots["b"], roots["c"]) == ("d", "d", "d")
    allocs = spark.createDataFrame([(1, "p", True), (1, "q", False), (1, "r", False)], "function_id int, place string, block_scoped boolean")
    assert rows(semantic.scope_exit_frees(allocs, allocs.where("place = 'r'"), allocs.limit(0))) == [(1, "p", 0.8), (1, "q", 0.7)]


def test_traces(spark, edges, nodes):
    flow = spark.createDataFrame([("b", "a", "return_to_call", "1"), ("c", "b", "arg_to_param", "1"), ("d", "b", "arg_to_param", "2"), ("e", "a", "assign", None), ("f", "e", "arg_to_param", "2")], "source string, target string, kind string, call_id string")
    sink = spark.createDataFrame([("a",)], "sink string")
    assert {r.node for r in trace.context_slices(sink, flow).collect()} == {"a", "b", "c", "e", "f"}
    best = flow.select("source", "target", F.lit(1).alias("priority"))
    assert [(r.step, r.node) for r in trace.backward_slices(sink, best).orderBy("step").collect()] == [(0, "a"), (1, "e"), (2, "f")]
    chains = trace.caller_chains(edges, nodes, seeds(spark, 99), 2)
    assert rows(chains.select("chain")) == [([99, 4, 1],)] or rows(chains.select("chain"))[0][0][:2] == [99, 4]
    assert rows(trace.caller_chains(edges, nodes, seeds(spark, 42), 2).select("chain", "depth")) == [([42], 0)]


def test_incremental(spark):
    known = spark.createDataFrame([("a", "1", 3), ("b", "1", 3), ("c", "1", 1), ("d", None, 3)], "path string, content_hash string, capability_mask int")
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("e", "1"), ("d", None)], "path string, content_hash string")
    changes = incremental.change_classes(known, found, C.BITS["structural"])
    assert dict(rows(changes)) == {"a": "unchanged", "b": "modified", "c": "incomplete", "d": "unchanged", "e": "new"}
    assert dict(rows(incremental.change_classes(known, found.limit(0))))["a"] == "deleted"
    closed = incremental.fixed_point(spark.createDataFrame([(1,)], "n int"), lambda new: new.selectExpr("n * 2 AS n").where("n < 40"), ["n"])
    assert [r.n for r in closed.orderBy("n").collect()] == [1, 2, 4, 8, 16, 32]
    files = spark.createDataFrame([("s", 1), ("s", 2), ("t", 3)], "scope string, file_id int")
    states = spark.createDataFrame([(1, "fresh", 3), (2, "stale", 3), (3, "fresh", 3)], "file_id int, status string, mask int")
    assert rows(incremental.covered_scopes(files, states, 3)) == [("t",)]


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(tables.upsert(old, spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string"), ["k"])) == [(1, "a"), (2, "c"), (3, "e")]
    parents = spark.createDataFrame([(1,)], "id int")
    assert rows(tables.guard_null(old, "k", parents, "id")) == [(1, "a"), (None, "b")]
    assert rows(tables.guard_drop(old, "k", parents, "id")) == [(1, "a")]
    catalog = tables.Catalog(spark, str(tmp_path / "facts"))
    assert catalog.read("symbol_hints").count() == 0
    assert catalog.write("symbol_hints", spark.createDataFrame([("n", "f")], "name string, file_id string")) == 1
    assert catalog.write("symbol_hints", spark.createDataFrame([("m",)], "name string")) == 2
    assert rows(catalog.read("symbol_hints")) == [("m", None)] and rows(catalog.read("symbol_hints", 1)) == [("n", "f")]
    catalog.keep("symbol_hints", 1)
    assert catalog.generations("symbol_hints") == [2]


@pytest.mark.parametrize("kind,pattern,name,hit", [("exact", "free", "free", True), ("prefix", "k", "kfree", True), ("suffix", "free", "kfree", True), ("glob", "k*e", "kfree", True), ("glob", "k.e", "kfe", False), ("regex", "^k.*e$", "kfree", True), ("method", "close", "file.close", True), ("other", "x", "y", False)])
def test_rule_patterns(spark, kind, pattern, name, hit):
    assert spark.range(1).select(C.rule_matches(F.lit(kind), F.lit(pattern), F.lit(name)).alias("v")).first().v is hit


def test_context_slices_query_takes_all_edges(spark):
    from weftgraph.plans.lens import Lens
    from weftgraph.plans.more import context_slices

    assert context_slices(Lens(spark, "/root/testdata/sf0.01")).where("node >= 300").limit(1).count() == 1

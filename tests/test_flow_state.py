"""Value flow, index state and the rebuilt joins against plain Python."""

import random

import pytest

from weftgraph.functions import resources
from weftgraph.operators import flow, graph, incremental, joins, state
from weftgraph.sources import tables


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_fuzzy_names_lose_no_pair(spark):
    rng = random.Random(4)
    names = {"".join(rng.choices("abcx", k=rng.randrange(0, 9))) for _ in range(300)} | {"abcd", "blugeer"}
    queries = {"".join(rng.choices("abcX", k=rng.randrange(0, 9))) for _ in range(60)} | {"axcy", "blxgexr", ""}
    df = lambda rows, c: spark.createDataFrame([(r,) for r in rows] + [(None,)], f"{c} string")
    got = {(r.query, r.name, r.distance) for r in joins.fuzzy_names(df(queries, "query"), df(names, "name"), 2, 10**6).collect()}
    want = {(q, n, d) for q in queries for n in names if (d := distance(q.lower(), n.lower())) <= 2}
    assert got == want and ("axcy", "abcd", 2) in got and ("blxgexr", "blugeer", 2) in got
    some = {(r.query, r.name) for r in joins.fuzzy_names(df(queries, "query"), df(names, "name"), 2, 10**6, True).collect()}
    assert some < {(q, n) for q, n, _ in want}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_chunks_follow_the_rule(spark, seed):
    rng = random.Random(seed)
    weights = [300, 300, *[rng.choice([0, 1, 5, 100, 300, 499, 500, 501, 2000]) for _ in range(400)]]
    budget, held, chunk, want = 500, None, 0, []
    for w in weights:
        if held is not None and held + w > budget:
            chunk, held = chunk + 1, w
        else:
            held = (held or 0) + w
        want.append(chunk)
    rows = spark.createDataFrame([*enumerate(weights)], "k long, w long").repartition(4)
    got = [r.chunk for r in incremental.greedy_chunks(rows, "k", "w", budget).orderBy("k").collect()]
    assert got == want
    assert incremental.greedy_chunks(rows.limit(0), "k", "w", budget).collect() == []


def test_innermost_keeps_equal_points(spark):
    points = spark.createDataFrame([(1, 5), (1, 5), (1, 50), (2, 5)], "file_id int, pos int")
    ranges = spark.createDataFrame([(1, 0, 10, "a"), (1, 4, 6, "b")], "file_id int, start_byte int, end_byte int, name string")
    assert sorted((r.pos, r.name) for r in joins.innermost(points, ranges, ["file_id"]).collect()) == [(5, "b"), (5, "b")]


def test_deep_and_cyclic_scopes(spark):
    deep = [(f"s{k}", f"s{k - 1}" if k else None) for k in range(70)]
    rows = spark.createDataFrame([*deep, ("x", "y"), ("y", "z"), ("z", "y")], "scope_id string, parent_id string")
    got = {(r.scope_id, r.ancestor): r.depth for r in joins.scope_closure(rows).collect()}
    assert got["s69", "s0"] == 69 and got["x", "z"] == 2 and ("y", "z") in got


def graph_of(spark, edges):
    nodes = sorted({n for a, b, *_ in edges for n in (a, b)})
    return (
        spark.createDataFrame([(1, n, "entry" if n == nodes[0] else "statement") for n in nodes], "function_id int, node_id long, kind string"),
        spark.createDataFrame([(1, a, b, "next") for a, b in edges], "function_id int, source long, target long, kind string"),
    )


def test_required_branches_and_frames(spark):
    rng = random.Random(3)
    for _ in range(4):
        edges = sorted({(a, a + 1) for a in range(9)} | {tuple(sorted(rng.sample(range(10), 2))) for _ in range(6)})
        nodes, flows = graph_of(spark, edges)

        def reach(some, start):
            seen, work = {start}, [start]
            while work:
                n = work.pop()
                for a, b in some:
                    if a == n and b not in seen:
                        seen.add(b)
                        work.append(b)
            return seen

        target = rng.randrange(3, 10)
        wanted = spark.createDataFrame([(1, target)], "function_id int, node_id long")
        want = {e for e in edges if sum(a == e[0] for a, _ in edges) > 1 and target not in reach([x for x in edges if x != e], 0)}
        assert {(r.source, r.target) for r in flow.required_branches(nodes, flows, wanted).collect()} == want
        frames = {r.branch: r.join for r in flow.branch_frames(nodes, flows).collect()}
        for branch, join in frames.items():
            common = set.intersection(*[reach(edges, b) for a, b in edges if a == branch])
            assert join in common
    nodes, flows = graph_of(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)])
    assert [(r.branch, r.join, r.inside) for r in flow.branch_frames(nodes, flows).collect()] == [(0, 3, 2)]


def test_ranked_paths_are_the_cheapest(spark):
    rng = random.Random(7)
    rows = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(40)})
    weight = {e: 1 + rng.randrange(50) / 10 for e in rows}
    edges = spark.createDataFrame([(a, b, "calls", 1.0, "x", weight[a, b]) for a, b in rows if a != b], "source long, target long, kind string, confidence double, provenance string, weight double")

    def paths(at, target, seen, cost):
        if at == target:
            yield round(cost, 9)
        elif len(seen) <= 5:
            for a, b in rows:
                if a == at and b not in seen:
                    yield from paths(b, target, {*seen, b}, cost + weight[a, b])

    pairs = [(a, b) for a in range(4) for b in range(4, 9)]
    got: dict = {}
    for r in graph.ranked_paths(edges, spark.createDataFrame(pairs, "source_id long, target_id long"), 5, 3).collect():
        got.setdefault((r.source_id, r.target_id), []).append(r.cost)
    for p in pairs:
        assert sorted(got.get(p, [])) == pytest.approx(sorted(paths(p[0], p[1], {p[0]}, 0.0))[:3])


def test_arguments_are_filled(spark):
    calls = spark.createDataFrame([(1, 7, [("a", None, 3), ("b", "old", 9)]), (2, 7, None)], "callsite_id int, file_id int, args array<struct<value:string,data_node_id:string,start_byte:int>>")
    nodes = spark.createDataFrame([("n2", 7, 3, "call_arg"), ("n1", 7, 3, "call_arg"), ("x", 7, 9, "local")], "node_id string, file_id int, start_byte int, kind string")
    got = {r.callsite_id: r.args and [tuple(a) for a in r.args] for r in flow.fill_arguments(calls, nodes).collect()}
    assert got == {1: [("a", "n1", 3), ("b", "old", 9)], 2: None}


def test_windows(spark):
    nodes = spark.createDataFrame([(1, 1, 0, 5), (2, 1, 6, 20), (3, 1, 30, 40)], "node_id int, file_id int, start_byte int, end_byte int")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "source int, target int")
    kept, inner = flow.in_window(nodes, edges, spark.createDataFrame([(1, 0, 20)], "file_id int, from_byte int, to_byte int"))
    assert sorted(r.node_id for r in kept.collect()) == [1, 2] and [tuple(r) for r in inner.collect()] == [(1, 2)]


def test_decisions(spark):
    with pytest.raises(ValueError):
        state.guard_precision("full", "structural")
    state.guard_precision("full", "structural", force=True)
    state.guard_precision("structural", "full")
    for bad in ("", "/a", "a/../b", "http://x/y", "C:\\x", ".."):
        with pytest.raises(ValueError):
            state.checked_path(bad)
    assert state.checked_path("./a//b\\c") == "a/b/c"
    one, changed = state.config_changed({"tsconfig.json": b"{}"}, None)
    assert not changed and state.config_changed({"tsconfig.json": b"{}"}, one) == (one, False)
    assert state.config_changed({"tsconfig.json": b"{ }"}, one)[1]
    files = spark.createDataFrame([(1,), (2,)], "file_id int")
    states = lambda *rows: spark.createDataFrame(list(rows), "file_id int, status string, mask int")
    assert state.graph_mode(files, states((1, "fresh", 3), (2, "fresh", 3))) == "full"
    assert state.graph_mode(files, states((1, "fresh", 3), (2, "stale", 3))) == "focus_partial"
    assert state.graph_mode(files, states((1, "stale", 3))) == "empty"
    assert [state.refresh_plan(files.limit(k), n) for k, n in ((0, 9), (1, 9), (2, 3))] == ["none", "incremental", "full"]
    text = state.to_markdown("t", {"rows": files.orderBy("file_id")}, most=1)
    assert "| 1 |" in text and "left out" in text
    with pytest.raises(ValueError):
        state.put_rules(spark.createDataFrame([], "rule_id string, language string, rule_kind string, pattern string, pattern_kind string, confidence double"), spark.createDataFrame([("", "c", "odd", "x", "exact", 1.0)], "rule_id string, language string, rule_kind string, pattern string, pattern_kind string, confidence double"))
    assert {n: d.count() for n, d in state.reset_session({"a": files, "b": files}, ["a"]).items()} == {"a": 0, "b": 2}


def test_catalog_generations_and_metadata(spark, tmp_path, monkeypatch):
    catalog = tables.Catalog(spark, str(tmp_path / "c"))
    rows = lambda n: spark.createDataFrame([(n, "f")], "name string, file_id string")
    assert catalog.write("symbol_hints", rows("a")) == 1
    monkeypatch.setattr(catalog, "generations", lambda name: [])  # a writer that has seen no generation
    assert catalog.write("symbol_hints", rows("b")) == 2
    monkeypatch.undo()
    assert catalog.generations("symbol_hints") == [1, 2]
    assert [catalog.read("symbol_hints", g).first().name for g in (1, 2)] == ["a", "b"] and catalog.read("symbol_hints").first().name == "b"
    catalog.keep("symbol_hints", 1)
    assert catalog.generations("symbol_hints") == [2] and catalog.read("symbol_hints").first().name == "b"
    assert catalog.metadata("k") is None
    catalog.set_metadata("k", "1")
    catalog.set_metadata("k", "2")
    assert catalog.metadata("k") == "2"


def test_search_index_reads_few_files(spark, tmp_path):
    from weftgraph.operators import search

    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha betas gamma"), (3, None), (4, "delta")], "id int, text string")
    index = search.SearchIndex(spark, str(tmp_path / "index")).build(docs, "id", ["text"])
    postings = search.inverted_index(docs, "id", ["text"])
    for q in ("alpha beta", "beta", "delta", "", "nothing"):
        want = {r.id: round(r.score, 9) for r in search.bm25(postings, q, 4, 2.0).collect()}
        assert {r.id: round(r.score, 9) for r in index.search(q).collect()} == want
    plan = index.postings().where("token = 'beta'")._jdf.queryExecution().toString()
    assert "EqualTo(token,beta)" in plan


def test_jobs_wait_run_and_end(spark):
    kind = "job_id long, file_id long, unit_id string, layer string, priority int, depends_on long, status string, error string"
    jobs = spark.createDataFrame([(1, 1, None, "s", 1, None, "queued", None), (2, 1, "u", "s", 9, 1, "queued", None), (3, 2, None, "s", 5, None, "building", None), (4, 3, None, "s", 5, None, "complete", None)], kind)
    asked = spark.createDataFrame([(10, 1, None, "s", 3, None), (11, 3, None, "s", 2, None), (12, 3, None, "s", 7, None), (13, 1, "v", "s", 1, None)], "job_id long, file_id long, unit_id string, layer string, priority int, depends_on long")
    assert {r.job_id for r in state.enqueue(jobs, asked).collect()} == {1, 2, 3, 4, 12, 13}
    assert {r.job_id for r in state.enqueue(jobs.limit(0), asked.limit(0)).collect()} == set()
    assert [r.job_id for r in state.runnable(jobs, 5).collect()] == [1]
    moves = lambda *rows: spark.createDataFrame(rows, "job_id long, status string, error string")
    after = state.advance(jobs, moves((1, "building", None), (2, "complete", None), (3, "building", None), (3, "failed", "why"), (4, "queued", None), (99, "failed", "x")))
    assert {r.job_id: (r.status, r.error) for r in after.collect()} == {1: ("building", None), 2: ("queued", None), 3: ("failed", "why"), 4: ("complete", None)}
    done = state.advance(after, moves((1, "complete", None)))
    assert [r.job_id for r in state.runnable(done, 5).collect()] == [2]
    asks = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3), ("c", 4), ("d", 77)], "ticket string, job_id long")
    assert {r.ticket: (r.n_jobs, r.status) for r in state.tickets(asks, done).collect()} == {"a": (1, "ready"), "b": (1, "pending"), "c": (2, "partial"), "d": (1, "ready")}


def test_focus_plans():
    assert state.focus_plan("calls", 9) == ([("calls", 1), ("imports", 1)], 0)
    assert state.focus_plan("impact", 9, True) == ([("calls", 1), ("types", 2), ("imports", 1)], 5)
    assert state.focus_plan("trace_variable", 1, True, "arkts")[0][-1] == ("state_channels", 1) and state.focus_plan("trace_variable", 1, True)[1] == 2
    assert state.focus_plan("search", None, True)[1] == 1 and state.focus_plan("semantic_function", 3, True) == ([], 0)


def test_peers_are_the_first_of_a_file(spark):
    nodes = spark.createDataFrame([(k, k % 2, f"n{k}", "p") for k in range(40)], "symbol_id long, file_id long, name string, path string")
    edges = spark.createDataFrame([], "source long, target long, kind string, confidence double")
    got = {}
    for r in state.context_view(edges, nodes, nodes.select("symbol_id"), 3).collect():
        got.setdefault(r.subject, set()).add(r.other)
    assert got == {k: set([j for j in range(k % 2, 40, 2) if j != k][:3]) for k in range(40)}


def test_calls_on_resources(spark):
    calls = [("malloc", "c"), ("REALLOC", "java"), ("x.connect", "python"), ("os.Open", "go"), ("conn.Close", "go"), ("buf_free", "c"), ("defer free", "c"), ("std::mem::forget", "rust"), ("clearTimeout", "javascript"), ("mine", "c"), ("free", None), (None, "c"), ("open", "cangjie")]
    df = spark.createDataFrame(calls, "callee string, language string")
    c, l = df["callee"], df["language"]
    none = df.select("callee", resources.returned(c, l, {"c": ("mi*",)}).alias("made"), resources.ended(c, l).alias("ended"), resources.escapes(c, l, df["language"]).alias("out"), resources.cleaned_at_exit(c, l).alias("clean")).collect()
    assert [r.made for r in none] == ["new_owned", "maybe_owned", "new_owned", "new_owned", None, None, None, None, None, "new_owned", None, None, None]
    assert [r.ended for r in none] == [None, None, None, None, "method", "explicit", None, "explicit", "explicit", None, None, None, None]
    assert [r.callee for r in none if r.out] == ["std::mem::forget"] and [r.callee for r in none if r.clean] == ["REALLOC", "std::mem::forget"]
    gone = spark.createDataFrame([("work", "go", "go_goroutine"), ("work", "go", None)], "c string, l string, x string")
    assert [r[0] for r in gone.select(resources.escapes(gone["c"], gone["l"], gone["x"])).collect()] == [True, False]

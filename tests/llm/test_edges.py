"""Every operator and stage on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib

import pytest

import corpus_pipeline
from weftgraph.llm import bpe, decontaminate, importance, ppm, pseudonyms, quality_rules, secrets, simhash, token_files, token_rollups
from weftgraph.llm.common import cut, fresh_path

LONG = "Some words go on, and on. " * 20000
ROWS = [(1, "A text with password=hunter22 in it."), (2, None), (3, ""), (None, "No id here."), (5, "twice"), (5, "twice"), (6, LONG), (7, " \t\n\x0b ")]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, fp long, id long, row long, key string, t int, kept boolean, ids binary, n_tokens long, bucket long, q string, component_id long"
CLASHING = [(i, t, "en", "s", None if t is None else len(t), 1, 2, 3, "k", 4, True, b"x", 5, 6, "q", 7) for i, t in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CLASHING, CLASH)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "some words go on and on some words go on"), (2, None), (None, ""), (3, "!!")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 1), (6, 0), (None, 1), (7, None), (5, 1)], "doc_id long, quality int")


def operators(docs, bench, labels):
    spark = docs.sparkSession

    def files():
        folder = fresh_path(spark, "tokens")
        manifest = token_files.write_token_files(docs, folder, shard_ids=1000)
        return token_files.read_token_files(spark, folder, manifest)

    def rollup():
        r = token_rollups.Rollup(spark, fresh_path(spark, "rollup"))
        counts = token_rollups.counted(docs, {"v1": r"[^\x20\x09-\x0D]+"}).withColumnRenamed("v1", "n_tokens").selectExpr("*", "'v1' AS tokenizer_version")
        r.commit("a", token_rollups.inserts(counts))
        return r.totals()

    return {
        "secrets": lambda: secrets.scan_secrets(docs),
        "token_files": files,
        "ppm": lambda: ppm.score(docs, order=2),
        "rollups": rollup,
        "leaks": lambda: decontaminate.leaks(docs, bench),
        "bpe": lambda: bpe.decode(bpe.encode(docs)),
        "importance": lambda: importance.resample(docs, labels),
        "pseudonyms": lambda: pseudonyms.protect(docs, b"key"),
        "rules": lambda: quality_rules.line_rules(docs),
        "simhash": lambda: simhash.near_duplicates(docs),
    }


ROW_PER_DOCUMENT = ("secrets", "token_files", "ppm", "bpe", "importance", "pseudonyms", "rules", "simhash")


@pytest.mark.parametrize("name", ["secrets", "token_files", "ppm", "rollups", "leaks", "bpe", "importance", "pseudonyms", "rules", "simhash"])
def test_odd_rows_and_empty_tables(name, docs, bench, labels):
    rows = operators(docs, bench, labels)[name]().collect()
    if name in ROW_PER_DOCUMENT:
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in ROWS)
    if name == "leaks":
        assert {(r.doc_id, r.item_id) for r in rows} == {(6, 1)}
    if name == "rollups":
        assert [(r.n_docs, r.n_tokens) for r in rows] == [(8, sum(len((t or "").split()) for _, t in ROWS))]
    if name == "simhash":
        component = {r.doc_id: r.component_id for r in rows}
        assert component[2] == component[3] == component[7] == 2 and component[5] == 5 and component[None] is None
    empty = operators(docs.limit(0), bench, labels)[name]().collect()
    assert empty == []


def test_empty_other_side(docs, bench, labels):
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(ROWS)
    assert all(r.kept for r in importance.resample(docs, labels.limit(0)).collect())


def test_stages_keep_columns(spark, docs, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for rows in (docs, docs.limit(0)):
            out = cut(stage(spark, rows, str(tmp_path)), "stage")
            if k < 4:
                assert out.columns == docs.columns
            out.collect()
    kept = {r.doc_id: r.text for r in corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).collect()}
    assert kept[1] == "A text with [SECRET] in it." and kept[2] is None and kept[6] == LONG
    assert sorted(r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs.where("doc_id is not null"), str(tmp_path)).collect()) == [1, 2, 3, 5, 5, 7]
    groups = corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in groups) == [(False, 1), (False, 2), (False, 5), (False, 6), (True, 0)]


def test_round_trip_of_long_text(spark):
    odd = spark.createDataFrame([(1, LONG), (2, "x" * 50_000), (3, "a  b c\n\n d e <|endoftext|> \U0001f600 'tis don't")], "doc_id long, text string")
    for r in bpe.decode(bpe.encode(odd, limit=1000)).collect():
        want = {1: LONG, 2: "x" * 50_000}.get(r.doc_id)
        assert want is None or r.decoded.decode() == want
        assert hashlib.sha256(r.decoded).digest() == hashlib.sha256(odd.where(f"doc_id = {r.doc_id}").first().text.encode()).digest()

"""Streams in several batches give what a batch query gives."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.joins import carry_forward
from weftgraph.streaming import sync


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stream")
    rows = spark.range(300).select(F.col("id").alias("effect_id"), (F.col("id") % 7).alias("function_id"), F.element_at(F.array(*[F.lit(e) for e in ("alloc", "free", "free", "call", "store")]), (F.col("id") * 13 % 5 + 1).cast("int")).alias("effect"))
    for k in range(3):
        rows.where(f"effect_id >= {k * 100} AND effect_id < {k * 100 + 100}").coalesce(1).write.parquet(f"{root}/part{k}")
    table = root / "events.parquet"
    table.mkdir()
    for k in range(3):
        next((root / f"part{k}").glob("*.parquet")).rename(table / f"{k}.parquet")
    return str(root)


def test_latest_over_batches(spark, folder):
    stream = sync.read_stream(spark, folder, "events", max_files=1)
    got = {r.function_id: r.effect_id for r in sync.latest_per_key(stream, ["function_id"], ["effect_id"]).collect()}
    assert got == {k: max(range(k, 300, 7)) for k in range(7)}


def test_lifecycle_state_over_batches(spark, folder):
    stream = sync.read_stream(spark, folder, "events", max_files=1)
    got = {r.function_id: (r.state, r.n_flags) for r in sync.lifecycle_states(stream).collect()}
    want = {}
    for k in range(7):
        state, flags = "Unknown", 0
        for i in range(k, 300, 7):
            after = {"alloc": "Assigned", "free": "Freed", "store": "Assigned"}.get(("alloc", "free", "free", "call", "store")[i * 13 % 5])
            flags += after is not None and state == "Freed"
            state = after or state
        want[k] = (state, flags)
    assert {k: v for k, v in got.items()} == want


@pytest.mark.parametrize("inclusive", [True, False])
def test_carry_forward_over_partitions(spark, inclusive):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("k"), "id", F.when(F.col("id") % 11 == 0, F.col("id")).alias("v"))
    got = {r.id: r.last for r in carry_forward(rows, ["k"], ["id"], "v", "last", inclusive).collect()}
    last = {}
    for i in range(1000):
        k = 0 if i % 3 == 0 else i % 5
        before = last.get(k)
        if i % 11 == 0:
            last[k] = i
        assert got[i] == (last.get(k) if inclusive else before)

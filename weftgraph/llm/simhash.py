"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared only inside buckets that agree on enough bit blocks
for the radius (pigeonhole, so no linked pair is missed).  Within a bucket bit
planes are stored vertically: one machine word holds one bit of 64 fingerprints.
Differences of many pairs are added by carry-save bitwise counters, and words
whose lanes all exceed the radius are abandoned before the next planes.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import arrow_schema, cut, map_rows, read_table
from weftgraph.operators.joins import spread_join

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, words: int = 4) -> int:
    """SimHash of a text's word shingles as an unsigned 64-bit integer; zero without words."""
    tokens = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(first[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, also: tuple[str, ...] = ()) -> DataFrame:
    """``(id_col, *also, fp)`` per row, fp the fingerprint's bits as a signed long; a null text counts as empty."""

    def make():
        def work(cols):
            fps = np.array([fingerprint(t or "", words) for t in cols[-1]], np.uint64)
            return [*cols[:-1], pa.array(fps.view(np.int64))]

        return work

    kept = [id_col, *also]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("fp", T.LongType())])
    return map_rows(docs, [*kept, text_col], schema, make, sized=len(kept))


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: 64 rows of words; lane i of the words is fingerprint i."""
    bits = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    bits[:, : len(fps)] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def within(left: np.ndarray, li: np.ndarray, right: np.ndarray, ri: np.ndarray, valid: np.ndarray, radius: int, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which lanes of word pairs differ in at most ``radius`` of the planes in ``order``.

    Pair k compares word ``li[k]`` of the planes ``left`` with word ``ri[k]`` of
    ``right`` in the lanes ``valid[k]``.  Returns the pairs with any such lane and
    their lanes.  Counters saturate into a sticky overflow bit, and after every
    eight planes the pairs whose lanes all exceed the radius are abandoned.
    """
    width = max(1, radius.bit_length())
    at = np.arange(len(li))
    count = [np.zeros(len(li), np.uint64) for _ in range(width)]
    over = np.zeros(len(li), np.uint64)
    ok = valid
    for group in range(0, len(order), 8):
        for b in order[group : group + 8]:
            carry = left[b][li] ^ right[b][ri]
            for t in range(width):
                count[t], carry = count[t] ^ carry, count[t] & carry
            over |= carry
        greater, equal = np.zeros_like(over), np.full_like(over, ALL)
        for t in reversed(range(width)):
            if radius >> t & 1:
                equal &= count[t]
            else:
                greater |= equal & count[t]
                equal &= ~count[t]
        ok = valid & ~(over | greater)
        live = np.flatnonzero(ok)
        if len(live) < len(ok):
            li, ri, valid, over, ok, at = li[live], ri[live], valid[live], over[live], ok[live], at[live]
            count = [c[live] for c in count]
        if not len(live):
            break
    return at, ok


def _lanes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and lane of every set bit."""
    return np.nonzero(np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def merge_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of u[k] and v[k]; a class's label is its least member."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        if not len(u):
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def _small_cells(fps, cell, size, mixed, side, radius, order):
    """Linked row pairs of small cells: all rows at once, row i against row i + lag for every lag."""
    by_size = np.lexsort((cell, -size))
    fps, cell, size, mixed, side = fps[by_size], cell[by_size], size[by_size], mixed[by_size], side[by_size]
    p = planes(fps)
    for lag in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -lag))  # rows of cells larger than the lag come first
        if n <= lag:
            break
        valid = np.zeros(-(-n // 64) * 64, bool)
        valid[: n - lag] = (cell[: n - lag] == cell[lag:n]) & (~mixed[: n - lag] | (side[: n - lag] != side[lag:n]))
        words = np.packbits(valid, bitorder="little").view(np.uint64)
        w, s = divmod(lag, 64)
        shifted = p[:, w : w + len(words)]
        if s:
            following = np.zeros_like(shifted)
            nxt = p[:, w + 1 : w + 1 + len(words)]
            following[:, : nxt.shape[1]] = nxt
            shifted = (shifted >> np.uint64(s)) | (following << np.uint64(64 - s))
        live = np.flatnonzero(words[: shifted.shape[1]])
        at, ok = within(p, live, shifted, live, words[live], radius, order)
        word, lane = _lanes(ok)
        i = live[at[word]] * 64 + lane
        yield by_size[i], by_size[i + lag]


def _large_cell(fps, mixed, side, radius, order, queries: int = 256):
    """Labels of the rows of one large cell: blocks of query rows against the planes of all rows."""
    n = len(fps)
    p, label = planes(fps), np.arange(n)
    for start in range(0, n, queries):
        q = np.arange(start, min(n, start + queries))
        bits = np.unpackbits(fps[q].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
        masks = np.where(bits, ALL, np.uint64(0))
        valid = np.zeros((len(q), p.shape[1] * 64), bool)
        valid[:, :n] = np.arange(n) > q[:, None]
        if mixed:
            valid[:, :n] &= side != side[q][:, None]
        words = np.packbits(valid, axis=1, bitorder="little").view(np.uint64).ravel()
        live = np.flatnonzero(words)
        li, ri = np.divmod(live, p.shape[1])
        at, ok = within(masks, li, p, ri, words[live], radius, order)
        word, lane = _lanes(ok)
        label = merge_labels(label, q[li[at[word]]], ri[at[word]] * 64 + lane)
    return label


def link_rows(table: np.ndarray, cell: np.ndarray, mixed: np.ndarray, side: np.ndarray, fps: np.ndarray, masks: list[int], radius: int, small: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, another of its class) that span all classes within the cells.

    Rows of a cell agree on ``masks[table]``; those planes are left out.
    """
    us, vs = [], []
    size = np.bincount(cell)[cell]
    for t in np.unique(table):
        order = [b for b in range(64) if not masks[t] >> b & 1]
        mine = table == t
        few = np.flatnonzero(mine & (size > 1) & (size <= small))
        if len(few):
            for i, j in _small_cells(fps[few], cell[few], size[few], mixed[few], side[few], radius, order):
                us.append(fps[few[i]])
                vs.append(fps[few[j]])
        for c in np.unique(cell[mine & (size > small)]):
            rows = np.flatnonzero(cell == c)
            label = _large_cell(fps[rows], bool(mixed[rows[0]]), side[rows], radius, order)
            linked = np.flatnonzero(label != np.arange(len(rows)))
            us.append(fps[rows[linked]])
            vs.append(fps[rows[label[linked]]])
    u, v = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (us, vs))
    names, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = merge_labels(np.arange(len(names)), index[: len(u)], index[len(u) :])
    linked = np.flatnonzero(label != np.arange(len(names)))
    return names[linked], names[label[linked]]


def band_masks(n: int, radius: int, blocks: int | None = None) -> list[int]:
    """Bit masks of the bucket tables for ``n`` distinct fingerprints.

    With B blocks, two fingerprints within the radius agree on B - radius of them:
    one table for each such choice.  More blocks mean more rows and smaller
    buckets; any B gives the same links, so B follows from the cheaper estimate.
    """

    def tables(b: int) -> list[int]:
        edges = [round(64 * k / b) for k in range(b + 1)]
        block = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(b)]
        return [sum(some) for some in itertools.combinations(block, b - radius)]

    def cost(b: int) -> float:
        return math.comb(b, radius) * (n + n * n * 0.02 / 2.0 ** (64 * (b - radius) / b))

    return tables(blocks or min(range(radius + 1, radius + 5), key=cost))


def links(distinct: DataFrame, radius: int = 4, blocks: int | None = None, chunk: int = 2048) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fp`` that span the classes of radius ``radius``.

    A bucket of over ``chunk`` fingerprints is divided into groups by hash, and
    each pair of groups becomes a cell of its own, so a hot bucket spreads over
    tasks and still loses no pair.
    """
    masks = band_masks(distinct.count(), radius, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    hot = cut(keyed.groupBy("t", "key").count().where(F.col("count") > chunk).select("t", "key", F.ceil(F.col("count") / chunk).cast("int").alias("parts")), "simhash-hot")
    rows = keyed.join(hot, ["t", "key"], "left") if not hot.isEmpty() else keyed.withColumn("parts", F.lit(None).cast("int"))
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.lit(0)))
    rows = rows.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    rows = rows.select("t", "key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), (F.col("part") > F.col("other")).cast("int").alias("side"), "fp")
    schema = T._parse_datatype_string("u long, v long")
    out = arrow_schema(schema)

    def run(batches):
        held: list[np.ndarray] = []

        def emit(rows_: np.ndarray):
            change = np.any(rows_[1:, :4] != rows_[:-1, :4], axis=1)
            cell = np.concatenate([[0], np.cumsum(change)])
            u, v = link_rows(rows_[:, 0], cell, rows_[:, 2] != rows_[:, 3], rows_[:, 4], np.ascontiguousarray(rows_[:, 5]).view(np.uint64), masks, radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], schema=out)

        n = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1))
            n += batch.num_rows
            if n >= 200_000:
                whole = np.concatenate(held)
                last = np.flatnonzero(np.any(whole[1:, :4] != whole[:-1, :4], axis=1))
                if len(last):  # the last cell may go on in the next batch
                    yield emit(whole[: last[-1] + 1])
                    whole = whole[last[-1] + 1 :]
                held, n = [whole], len(whole)
        if n:
            yield emit(np.concatenate(held))

    return rows.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b", "side").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)`` that is not the least of its component.

    Alternating star contraction: each round joins neighbours to the least one
    they know; every round is written, so a lost executor costs one round.  A hub's
    edges stay spread over tasks.
    """

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    mark = signature(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "star")
        large = cut(spread_join(both, least, "u", 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "star")
        small = spread_join(large, least, "u", 2 * mark[0])
        least = least.drop("n")
        now = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star")
        if (new := signature(now)) == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per document: ``id_col, fp, component_id``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the least id reachable over links.  Equal fingerprints are
    compared once.  A null or wordless text has fingerprint zero, linked like any
    other; null ids are no candidates for ``component_id`` (null if a component
    has no other); repeated rows are kept; an empty table gives no rows.
    """
    own = cut(fingerprints(docs, id_col, text_col, words).select(F.col(f"`{id_col}`").alias("id"), "fp"), "simhash")
    distinct = cut(own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    known = cut(_rooted(distinct, radius, blocks), "simhash-rooted")
    roots = cut(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "simhash-roots")
    classes = cut(spread_join(known, roots, "root", known.count(), "m").select("fp", "component_id", "n"), "simhash-classes")
    return spread_join(own, classes, "fp", own.count()).select(F.col("id").alias(id_col), "fp", "component_id")


def _rooted(distinct: DataFrame, radius: int, blocks: int | None) -> DataFrame:
    """The rows of ``distinct``, one per fingerprint, with the ``root`` of its class."""
    stars = components(links(distinct, radius, blocks))
    return distinct.join(stars, distinct.fp == stars.node, "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """One row of each near-duplicate group, the one with the least id; all columns stay.

    Rows get a number while they are written, so of repeated rows one is left;
    without texts, only numbers, ids and fingerprints are shuffled to choose, and
    the chosen numbers select the written rows.  A null id is chosen only where a
    group has no other; texts without words form one group with fingerprint zero.
    """
    mark = _free(docs, "__weft_row")
    numbered = cut(docs.withColumn(mark, F.monotonically_increasing_id()), "simhash-rows")
    rows = numbered.select(F.col(mark).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    own = fingerprints(rows, "id", "text", words, also=("row",))
    # the choice within equal fingerprints is made before anything is joined
    first = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best")
    distinct = cut(own.groupBy("fp").agg(first), "simhash-distinct")
    chosen = _rooted(distinct, radius, blocks).groupBy("root").agg(F.min("best")["row"].alias(mark))
    # the numbers grow with the corpus, so the join is a sort-merge at every size and never a broadcast
    return numbered.join(cut(chosen.select(mark), "simhash-kept").hint("merge"), mark, "left_semi").select([F.col(f"`{c}`") for c in docs.columns])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Language-model scores by prediction by partial matching over bytes.

A byte-context trie is trained on the training documents: counts of every byte
after each context of up to ``order`` bytes.  A byte's code length starts at the
longest known context; an unseen byte pays the escape (method C: as many counts
as the context has distinct followers, plus the counts of pruned followers) and
goes on at the next shorter context with the followers seen so far excluded.

Every n-gram of the training documents is kept, so the model grows with the
corpus.  It is never in one place: a code's cost needs only the n-grams whose
context ends in the same bytes, so the distinct codes of each block are dealt out
by the last ``LOW + 1`` bytes of their context, counted and costed there, and sent
back.  Only orders up to ``LOW``, at most 256 ** (LOW + 1) n-grams, are broadcast.

Very common words and context ends would gather in one task.  A few blocks tell
which they are (:class:`Hot`); their exact counts over all blocks are summed in
each task first and broadcast, and the codes of an end with more than ``END_PARTS``
parts' share of the text are dealt out by one byte more.  The sample decides only
the route: any choice gives the same scores.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import arrow_schema, cut, read_table

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Highest order that every task has whole.
LOW = 2


class Table:
    """Open-addressing hash table of distinct unsigned keys, filled and searched by numpy."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, EMPTY)
        self.index = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[at] == EMPTY
            self.keys[at[free]] = keys[left[free]]  # of several keys for a slot the last one stays
            mine = self.keys[at] == keys[left]
            self.index[at[mine]] = left[mine]
            left, at = left[~mine], at[~mine] + 1 & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where there is none."""
        at = self._slots(keys)
        here = self.keys[at]
        out = np.where(here == keys, self.index[at], -1)
        open_ = np.flatnonzero((here != keys) & (here != EMPTY))
        at, want = at[open_], keys[open_]
        while len(open_):
            at = at + 1 & self.mask
            here = self.keys[at]
            hit = here == want
            out[open_[hit]] = self.index[at[hit]]
            go = ~hit & (here != EMPTY)
            open_, at, want = open_[go], at[go], want[go]
        return out


class Model:
    """Code lengths in bits from n-gram counts by order.

    ``grams[k]`` holds (code, count) of order k, code being k context bytes and the
    byte itself as its lowest eight bits; ``totals[k]`` the full count of each kept context.
    """

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(grams) - 1
        self.grams, self.contexts, self.start, self.count_bits = [], [], [], []
        self.first_escape, self.escape, self.excluded_bits = [], [], []
        below = None
        for k, ((code, n), (context, total)) in enumerate(zip(grams, totals)):
            table, known = Table(code), Table(context)
            of = known.find(code >> np.uint64(8))
            distinct = np.bincount(of, minlength=len(context)).astype(np.float64)
            kept = np.bincount(of, weights=n, minlength=len(context))
            total = total.astype(np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.count_bits.append(np.log2(n.astype(np.float64)))
                self.start.append(np.log2(total + distinct)[of] - self.count_bits[k])
                self.first_escape.append(np.log2(total + distinct) - np.log2(distinct + total - kept))
                if below is not None:  # what remains one order lower when this context's followers are excluded
                    table_b, n_b, known_b, total_b, kept_b, distinct_b = below
                    up = known_b.find(context & np.uint64((1 << 8 * (k - 1)) - 1))
                    seen = np.bincount(of, weights=n_b[table_b.find(code & np.uint64((1 << 8 * k) - 1))], minlength=len(context))
                    room = total_b[up] - seen + distinct_b[up] - distinct
                    out = room - (kept_b[up] - seen)
                    self.excluded_bits.append(np.log2(room))
                    self.escape.append(np.where(room > 0, np.log2(room) - np.log2(out), 0.0))
                else:
                    self.excluded_bits.append(None)
                    self.escape.append(None)
                    self.last = np.log2(max(1.0, 256 - (distinct[0] if len(distinct) else 0)))
            self.grams.append(table)
            self.contexts.append(known)
            below = (table, n.astype(np.float64), known, total, kept, distinct)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the lowest byte of each code after the bytes above it."""
        cost = np.zeros(len(codes))
        left, came = np.arange(len(codes)), np.full(len(codes), -1, np.int64)
        for k in range(self.order, -1, -1):
            part = codes[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            hit = self.grams[k].find(part)
            found = hit >= 0
            fresh = came < 0
            a = found & fresh
            cost[left[a]] += self.start[k][hit[a]]
            b = found & ~fresh
            if b.any():
                cost[left[b]] += self.excluded_bits[k + 1][came[b]] - self.count_bits[k][hit[b]]
            lost = ~found
            left, came, fresh = left[lost], came[lost], fresh[lost]
            if not len(left):
                return cost
            context = self.contexts[k].find(part[lost] >> np.uint64(8))
            known = context >= 0
            a = known & fresh
            cost[left[a]] += self.first_escape[k][context[a]]
            b = known & ~fresh
            if b.any():
                cost[left[b]] += self.escape[k + 1][came[b]]
            came = context.astype(np.int64)
        cost[left] += self.last
        return cost


def codes_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram code of every byte and of the end (byte 0) of every text, and where each text's codes start.

    A text's first bytes have zero bytes for context.
    """
    pad = bytes(order)
    stream = np.frombuffer(b"".join(x for t in texts for x in (pad, t)) + bytes(max(1, order)), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    code = stream[order:].copy()
    for j in range(1, order + 1):
        code |= stream[order - j : len(stream) - j] << np.uint64(8 * j)
    # in code, text i starts at the sizes and pads before it and takes size + 1 places
    first = np.cumsum(sizes + order) - sizes - order
    keep = np.zeros(len(code) + 1, np.int32)
    np.add.at(keep, first, 1)
    np.add.at(keep, first + sizes + 1, -1)
    starts = np.cumsum(sizes + 1) - sizes - 1
    return code[np.cumsum(keep[:-1]) > 0] if order else code[: int((sizes + 1).sum())], starts


def _held_out(doc_id) -> bool:
    """Whether crc32 of the id as text is 2 modulo 7; a null id counts as empty text (training)."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _texts(sizes: list[int], data: bytes) -> list[str]:
    """Texts of a block from the byte length of each and all their bytes, packed."""
    whole, ends = _unpacked(data), np.cumsum([0, *sizes]).tolist()
    return [whole[a:b].decode() for a, b in zip(ends, ends[1:])]


def _in_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents packed into rows of about ``block_bytes`` bytes of text, written once so that later passes agree on them."""
    schema = T._parse_datatype_string("block long, ids array<long>, sizes array<long>, texts binary")
    out = arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            data = [t.encode() for t in texts]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, ids, [*map(len, data)], _packed(b"".join(data))), out)], schema=out)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1]) + 64
                if size >= block_bytes:
                    yield flush()
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield flush()

    return cut(docs.mapInArrow(run, schema), "ppm-blocks")


def _rows(batch: pa.RecordBatch):
    """Block, ids and texts of a batch's rows, one at a time in Python objects."""
    for k in range(batch.num_rows):
        block, ids, sizes, texts = (c[k].as_py() for c in batch.columns)
        yield block, ids, _texts(sizes, texts)


def _runs(texts: list[bytes], most: int = 1_000_000):
    """Consecutive texts of about ``most`` bytes."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def tokens_of(text: str) -> list[bytes]:
    """Words with A-Z lower-cased, split at ASCII white space."""
    return text.encode().lower().split()


#: Blocks that are looked at for common words and context ends, the most of each that are broadcast, and the parts that an end may fill.
SAMPLE_BLOCKS, HOT_WORDS, HOT_ENDS, END_PARTS = 8, 20_000, 2_000, 4


class Hot:
    """Common words (in at least half of a few blocks) and context ends (with over ``END_PARTS / parts`` of their places)."""

    def __init__(self, blocks: DataFrame, parts: int, end_parts: float = END_PARTS):
        n = blocks.count()
        share = F.pmod(F.xxhash64("block"), F.lit(1_000_000)) < (1_000_000 * SAMPLE_BLOCKS) // max(n, 1)
        some = blocks.where(share)
        schema = T._parse_datatype_string("word binary, ending long, n long")
        out = arrow_schema(schema)

        def run(batches):
            for batch in batches:
                for _, _, texts in _rows(batch):
                    count = Counter(w for t in texts for w in tokens_of(t) if len(w) <= 64)
                    ends = np.zeros(1 << 8 * (LOW + 1), np.int64)
                    for part in _runs([t.encode() for t in texts]):
                        np.add.at(ends, (codes_of(part, LOW + 1)[0] >> np.uint64(8)).astype(np.int64), 1)
                    found = np.flatnonzero(ends * float(parts) > end_parts * ends.sum())
                    none = lambda k, kind: pa.nulls(k, kind)
                    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), none(len(count), pa.int64()), pa.array(list(count.values()), pa.int64())], schema=out)
                    yield pa.RecordBatch.from_arrays([none(len(found), pa.binary()), pa.array(found), pa.array(ends[found])], schema=out)

        rows = some.mapInArrow(run, schema)
        words = rows.where("word is not null").groupBy("word").agg(F.count("*").alias("b"), F.sum("n").alias("n"))
        words = words.where(F.col("b") * 2 >= max(2, min(n, SAMPLE_BLOCKS))).orderBy(F.desc("n"), "word").limit(HOT_WORDS)
        self.words = frozenset(bytes(r[0]) for r in words.select("word").collect())
        ends = rows.where("ending is not null").groupBy("ending").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").limit(HOT_ENDS)
        self.ends = np.array(sorted(r[0] for r in ends.collect()), np.uint64)

    def table(self) -> np.ndarray:
        """For every possible end its place among the common ones, -1 if it is none."""
        out = np.full(1 << 8 * (LOW + 1), -1, np.int16)
        out[self.ends.astype(np.int64)] = np.arange(len(self.ends))
        return out

    def has(self, ends: np.ndarray) -> np.ndarray:
        if not len(self.ends):
            return np.zeros(len(ends), bool)
        at = np.minimum(np.searchsorted(self.ends, ends), len(self.ends) - 1)
        return self.ends[at] == ends


def _words_dealt(words: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by part and the first of each part."""
    part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
    return np.argsort(part, kind="stable"), np.cumsum([0, *np.bincount(part, minlength=parts)])


def word_counts(blocks: DataFrame, parts: int, hot: frozenset = frozenset()) -> tuple[DataFrame, dict[bytes, int]]:
    """``block, part, counts, n, vocabulary`` and the training counts of the words in ``hot``.

    ``counts`` holds the training counts of the block's distinct other words of a
    part, in order of first use; ``n`` and ``vocabulary`` add up to the training
    words and to the distinct ones among them.
    """
    dealt_schema = T._parse_datatype_string("block long, part int, words binary, sizes binary, counts binary")
    dealt = arrow_schema(dealt_schema)

    def deal(batches):
        from pyspark import TaskContext

        common: Counter = Counter()

        def rows(block, words, n, by, first, part_of):
            sizes = np.fromiter(map(len, words), "<u4", len(words))
            for p in np.flatnonzero(np.diff(first)).tolist():
                mine = by[first[p] : first[p + 1]]
                yield block, part_of(p), _packed(b"".join([words[k] for k in mine.tolist()])), _planes(sizes[mine]), _planes(n[mine])

        def batch_of(rows_):
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows_), dealt)] or [pa.array([], f.type) for f in dealt], schema=dealt)

        for batch in batches:
            for block, ids, texts in _rows(batch):
                count: Counter = Counter()
                order: dict = {}
                for i, t in zip(ids, texts):
                    words = tokens_of(t)
                    order.update(dict.fromkeys(words))
                    if not _held_out(i):
                        count.update(words)
                for w in hot.intersection(order):
                    common[w] += count[w]
                words = [w for w in order if w not in hot]
                n = np.fromiter(map(count.__getitem__, words), "<u4", len(words))
                if words:
                    yield batch_of(rows(block, words, n, *_words_dealt(words, parts), int))
        if common:  # of a task, in a part of its own
            words, n = list(common), np.fromiter(common.values(), "<u4", len(common))
            yield batch_of(rows(-1, words, n, np.arange(len(words)), np.array([0, len(words)]), lambda _, own=-1 - TaskContext.get().partitionId(): own))

    schema = T._parse_datatype_string("block long, part int, counts binary, n long, vocabulary long, hot array<struct<word:binary,n:long>>")
    out = arrow_schema(schema)

    def add(table: pa.Table) -> pa.Table:
        sizes = [_unplanes(x.as_py(), "<u4") for x in table.column("sizes")]
        n = np.concatenate([_unplanes(x.as_py(), "<u4") for x in table.column("counts")]).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        data = b"".join(_unpacked(x.as_py()) for x in table.column("words"))
        words = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        none = [None] * len(sizes)
        if table.column("part")[0].as_py() < 0:
            found = [{"word": w, "n": c} for w, c in zip(words.to_pylist(), n.tolist())]
            return pa.table([table.column("block"), table.column("part"), pa.array(none, pa.binary()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([found], out.field("hot").type)], schema=out)
        at = words.dictionary_encode().indices.to_numpy()
        c = np.bincount(at, weights=n).astype("<u8")
        every, ends = c[at], np.cumsum([len(x) for x in sizes])
        sums = [[int(x)] + [0] * (len(sizes) - 1) for x in (n.sum(), (c > 0).sum())]
        return pa.table([table.column("block"), table.column("part"), pa.array([_planes(every[b - len(x) : b]) for x, b in zip(sizes, ends)], pa.binary()), *[pa.array(x, pa.int64()) for x in sums], pa.array(none, out.field("hot").type)], schema=out)

    rows = cut(blocks.mapInArrow(deal, dealt_schema).groupBy("part").applyInArrow(add, schema), "ppm-words")
    totals = rows.where("block = -1").select(F.explode("hot").alias("h")).groupBy("h.word").agg(F.sum("h.n")).collect() if hot else []
    return rows.where("block >= 0").drop("hot"), {bytes(w): n for w, n in totals}


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order with the sums of their counts."""
    by = np.argsort(code, kind="stable")
    code, n = code[by], n[by]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[: len(code)])
    return code[first], np.add.reduceat(n, first) if len(first) else n


def grams_of(code: np.ndarray, n: np.ndarray, order: int, least_order: int = 0) -> tuple[list, list]:
    """``grams`` and ``totals`` of :class:`Model` for orders ``least_order`` to ``order``, from the counts of order ``order``."""
    grams, totals = [], []
    for k in range(order, least_order - 1, -1):
        if k < order:
            code, n = _summed(code & np.uint64((1 << 8 * (k + 1)) - 1), n)
        grams.append((code, n))
        totals.append(_summed(code >> np.uint64(8), n))
    return grams[::-1], totals[::-1]


def low_grams(blocks: DataFrame, order: int, hot: Hot | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the training documents' n-grams of ``order`` (at most ``LOW``), then those of order ``LOW + 1`` after the ends in ``hot``.

    They are summed in each task first; at most 256 ** (order + 1) + 256 * ``HOT_ENDS`` rows reach the driver.
    """
    schema = T._parse_datatype_string("code long, n long")
    out = arrow_schema(schema)
    more = hot is not None and len(hot.ends) > 0

    def run(batches):
        count = np.zeros(1 << 8 * (order + 1), np.int64)
        after = np.zeros(256 * len(hot.ends) if more else 0, np.int64)
        place = hot.table() if more else None
        for batch in batches:
            for _, ids, texts in _rows(batch):
                for some in _runs([t.encode() for i, t in zip(ids, texts) if not _held_out(i)]):
                    codes = codes_of(some, LOW + 1 if more else order)[0]
                    np.add.at(count, (codes & np.uint64((1 << 8 * (order + 1)) - 1)).astype(np.int64), 1)
                    if more:
                        at = place[(codes >> np.uint64(8)).astype(np.int64)]
                        mine = np.flatnonzero(at >= 0)
                        after += np.bincount(at[mine].astype(np.int64) << 8 | (codes[mine] & np.uint64(255)).astype(np.int64), minlength=len(after))
        code, tail = np.flatnonzero(count), np.flatnonzero(after)
        tail_code = (hot.ends[tail // 256].astype(np.int64) << 8 | tail % 256 | 1 << 40) if more else tail  # marked by a bit above any code
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([code, tail_code]), pa.int64()), pa.array(np.concatenate([count[code], after[tail]]), pa.int64())], schema=out)

    got = blocks.mapInArrow(run, schema).groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    code, n = got["code"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    low = code < 1 << 40
    return code[low].astype(np.uint64), n[low], (code[~low] & (1 << 40) - 1).astype(np.uint64), n[~low]


def _distinct(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of the texts and their counts."""
    parts = [np.unique(codes_of(some, order)[0], return_counts=True) for some in _runs(texts)]
    if len(parts) == 1:
        return parts[0]
    return _summed(np.concatenate([np.empty(0, np.uint64), *[c for c, _ in parts]]), np.concatenate([np.empty(0, np.int64), *[n for _, n in parts]]))


def _dealt(code: np.ndarray, parts: int, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """The order of codes by part and the first of each part; codes whose contexts end alike share one."""
    context = code >> np.uint64(8)
    end = context & np.uint64((1 << 8 * (LOW + 1)) - 1)
    longer = context & np.uint64((1 << 8 * (LOW + 2)) - 1) | np.uint64(1 << 48)
    end = np.where(hot.has(end), longer, end)
    part = ((end * _MIX >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.cumsum([0, *np.bincount(part, minlength=parts)])


def _planes(x: np.ndarray) -> bytes:
    """Bytes of ``x``, the first bytes of all values before the second ones: sorted values then compress well."""
    return _packed(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_unpacked(data), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def code_bits(blocks: DataFrame, order: int, parts: int, hot: Hot) -> DataFrame:
    """``block, part, bits``: code lengths (32-bit floats) of a block's distinct codes of a part, ascending by code."""
    dealt_schema = T._parse_datatype_string("block long, part int, codes binary, counts binary")
    dealt = arrow_schema(dealt_schema)

    def deal(batches):
        for batch in batches:
            for block, ids, texts in _rows(batch):
                train, n = _distinct([t.encode() for i, t in zip(ids, texts) if not _held_out(i)], order)
                held, _ = _distinct([t.encode() for i, t in zip(ids, texts) if _held_out(i)], order)
                code, n = _summed(np.concatenate([train, held]), np.concatenate([n, np.zeros(len(held), np.int64)]))
                by, first = _dealt(code, parts, hot)
                code, n = code[by].astype("<u8"), n[by].astype("<u4")
                some = np.flatnonzero(np.diff(first)).tolist()
                cuts = [(first[p], first[p + 1]) for p in some]
                arrays = [pa.array(np.full(len(some), block)), pa.array(some, pa.int32()), pa.array([_planes(code[a:b]) for a, b in cuts], pa.binary()), pa.array([_planes(n[a:b]) for a, b in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, schema=dealt)

    low = min(order, LOW)
    whole = blocks.sparkSession.sparkContext.broadcast(low_grams(blocks, low, hot if order > LOW else None))
    schema = T._parse_datatype_string("block long, part int, bits binary")
    out = arrow_schema(schema)

    def cost(table: pa.Table) -> pa.Table:
        each = [_unplanes(c.as_py(), "<u8") for c in table.column("codes")]
        n = np.concatenate([_unplanes(c.as_py(), "<u4") for c in table.column("counts")]).astype(np.int64)
        code, place = np.unique(np.concatenate(each), return_inverse=True)
        n = np.bincount(place, weights=n, minlength=len(code)).astype(np.int64)
        low_code, low_n, after, after_n = whole.value
        grams, totals = grams_of(low_code, low_n, low)
        more = grams_of(code[n > 0], n[n > 0], order, low + 1)
        if len(after):  # what follows a common end is counted over all parts
            part_code, part_n = more[0][0]
            own = ~hot.has(part_code >> np.uint64(8))
            more[0][0] = np.concatenate([part_code[own], after]), np.concatenate([part_n[own], after_n])
            more[1][0] = _summed(more[0][0][0] >> np.uint64(8), more[0][0][1])
        model = Model(grams + more[0], totals + more[1])
        bits = np.concatenate([model.bits(code[a : a + 250_000]) for a in range(0, len(code), 250_000)]).astype("<f4")[place]
        ends = np.cumsum([len(c) for c in each])
        return pa.table([table.column("block"), table.column("part"), pa.array([_planes(bits[b - len(c) : b]) for c, b in zip(each, ends)], pa.binary())], schema=out)

    return blocks.mapInArrow(deal, dealt_schema).groupBy("part").applyInArrow(cost, schema)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 5, block_bytes: int = 3_000_000, part_bytes: int = 8_000_000, end_parts: float = END_PARTS) -> DataFrame:
    """One row per document: id, ``held_out``, token figures, add-one unigram ``base_score`` and the model's ``score``.

    Documents whose crc32(id as text) modulo 7 is 2 are held out of all training.
    A null text counts as empty (one end token); a null id trains; repeated rows
    are kept and train as often; with an empty table there are no rows.  Other
    columns are not read.  Both scores are log10 probabilities.  The model is
    costed in parts, one for each ``part_bytes`` bytes of text.
    """
    schema = T._parse_datatype_string("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    blocks = _in_blocks(docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")), block_bytes)
    size = blocks.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, n) -> a + n)"))).first()[0] or 0
    parts = -(-size // part_bytes) or 1
    word_parts = -(-parts // 4)
    hot = Hot(blocks, parts, end_parts)
    counts, common = word_counts(blocks, word_parts, hot.words)
    shared = blocks.sparkSession.sparkContext.broadcast(common)
    ends_schema = T._parse_datatype_string("n long")

    def ends(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(not _held_out(i) for i in ids) for ids in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    n_ends = blocks.select("ids").mapInArrow(ends, ends_schema).agg(F.sum("n")).first()[0] or 0
    words, vocabulary = counts.agg(F.sum("n"), F.sum("vocabulary")).first()
    total = (words or 0) + sum(common.values()) + n_ends
    distinct = (vocabulary or 0) + sum(n > 0 for n in common.values()) + (n_ends > 0)
    bits = code_bits(blocks, order, parts, hot)
    # a block's rows beside its texts: the counts of its words and the code lengths of its codes, by part
    beside = counts.select("block", F.lit(True).alias("words"), "part", F.col("counts").alias("data"))
    beside = beside.unionByName(bits.select("block", F.lit(False).alias("words"), "part", F.col("bits").alias("data")))
    out = arrow_schema(schema)

    def of_block(texts: pa.Table, known: pa.Table) -> pa.Table:
        rest = np.log10(total + distinct + 1.0)
        known = known.sort_by("part")
        cost, word_count = (
            np.concatenate([np.empty(0, kind), *[_unplanes(b, kind) for b in known.filter(pc.equal(known.column("words"), of_words)).column("data").to_pylist()]])
            for of_words, kind in ((False, "<f4"), (True, "<u8"))
        )
        columns: list[list] = [[] for _ in out]
        for ids, sizes, packed in zip(*[texts.column(c).to_pylist() for c in ("ids", "sizes", "texts")]):
            each = _texts(sizes, packed)
            place: dict = {}
            places = [np.array([place.setdefault(w, len(place)) for w in tokens_of(t)], np.int64) for t in each]
            count = np.fromiter(map(shared.value.get, place, itertools.repeat(-1)), np.int64, len(place))
            rare = np.flatnonzero(count < 0)
            listed = list(place)
            count[rare[_words_dealt([listed[k] for k in rare.tolist()], word_parts)[0]]] = word_count
            gain = np.log10(count + 1.0)
            for i, at in zip(ids, places):
                base = gain[at].sum() + np.log10(n_ends + 1.0) - (len(at) + 1) * rest
                for c, v in zip(columns, (i, _held_out(i), len(at) + 1, int((count[at] > 0).sum()) + (n_ends > 0), total, base)):
                    c.append(v)
            runs = [codes_of(some, order) for some in _runs([t.encode() for t in each])]
            code, place_of = np.unique(np.concatenate([c for c, _ in runs]), return_inverse=True)
            by = _dealt(code, parts, hot)[0]
            of_code = np.empty(len(code))
            of_code[by] = cost
            done = 0
            for codes, starts in runs:
                lengths = of_code[place_of[done : done + len(codes)]]
                done += len(codes)
                columns[-1] += (-np.add.reduceat(lengths, starts) * np.log10(2.0)).tolist()
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    scored = blocks.groupBy("block").cogroup(beside.groupBy("block")).applyInArrow(of_block, schema)
    return scored.withColumnRenamed("doc_id", id_col)


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))

"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are word sequences.  The CGK random walk copies the word under its pointer
at every step and moves on or stays by a random bit of (step, word), so a small
edit distance becomes a small Hamming distance of the copies.  Walks start at
strided places of every document and at every place of an item's first half;
tables of a few sampled steps propose (document place, item) pairs, and the exact
word edit distance of the item to its best window there decides.

Walks may miss, more so for long items and moved words, so seeds propose too: an
item that may have k edits is divided into k + 1 pieces, of which k edits leave at
least one as it is.  Every place with a piece's words is proposed, so no held item
is missed, whatever its length and the kind of its edits.

Document words outside the benchmark's vocabulary share one symbol: they match no
item word in any case.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import arrow_schema, cut, read_table

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str) -> list[bytes]:
    """Words without ASCII punctuation, A-Z lower-cased, split at ASCII white space."""
    return text.encode().translate(_LOWER, _MARKS).split()


def allowed(n: int, similarity: float) -> int:
    """Word edits that an item of ``n`` words may have: its similarity 1 - edits / n stays at least ``similarity``."""
    return int((1 - similarity) * n + 1e-9)


def best_window(masks: dict[int, int], n: int, window: list[int]) -> tuple[int, int]:
    """Least edit distance of an item to any part of ``window``, and where that part ends (exclusive).

    Bit-parallel dynamic programming; bit i of ``masks[w]`` is set where word i of the item is ``w``.
    """
    top, full = 1 << n - 1, (1 << n) - 1
    plus, minus, score, best, end = full, 0, n, n, 0
    for j, w in enumerate(window):
        eq = masks.get(w, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        if score < best:
            best, end = score, j + 1
    return best, end


#: Most words of a seed.
SEED_WORDS = 8


class Index:
    """Items of one block with their embedding tables; built on the driver, used in the tasks."""

    def __init__(self, items: list[tuple], similarity: float, walks: int, tables: int, samples: int, seed: int):
        self.similarity, self.samples = similarity, samples
        texts = [(i, words_of(t or "")) for i, t in items]
        self.ids = [i for i, w in texts if w]
        words = [w for _, w in texts if w]
        self.vocabulary = {w: k + 1 for k, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(words)))}
        self.end = len(self.vocabulary) + 1  # the symbol after a text's last word; 0 is any unknown word
        self.items = [np.array([self.vocabulary[w] for w in each], np.int32) for each in words]
        self.masks = []
        for item in self.items:
            masks: dict[int, int] = {}
            for k, w in enumerate(item.tolist()):
                masks[w] = masks.get(w, 0) | 1 << k
            self.masks.append(masks)
        rng = np.random.default_rng(seed)
        lengths = sorted({len(x) for x in self.items})
        self.classes = []
        while lengths:
            low = lengths[0]
            high = max(x for x in lengths if x <= max(low, low * 5 // 4))
            lengths = [x for x in lengths if x > high]
            steps = max(low, samples + 1)
            bits = [rng.integers(0, 2, (steps, self.end + 1)).astype(np.int32) for _ in range(walks)]
            for b in bits:
                b[:, self.end] = 0  # a walk stays at the end
            picks = [[np.sort(rng.choice(steps, samples, replace=False)) for _ in range(tables)] for _ in range(walks)]
            mine = [k for k, x in enumerate(self.items) if low <= len(x) <= high]
            codes = np.concatenate([np.append(self.items[k], self.end) for k in mine])
            first = np.cumsum([0, *[len(self.items[k]) + 1 for k in mine]])[:-1]
            item, offset = (np.array(x) for x in zip(*[(k, o) for k in mine for o in range(max(1, len(self.items[k]) // 2))]))
            at = np.repeat(first, [max(1, len(self.items[k]) // 2) for k in mine]) + offset
            keys = self._keys(codes, at, bits, picks)
            found = []
            for key in keys:
                by = np.argsort(key, kind="stable")
                sieve = np.zeros(1 << 20, bool)
                sieve[(key >> np.uint64(44)).astype(np.int64)] = True
                found.append((key[by], item[by], offset[by], sieve))
            self.classes.append((low, high, max(1, low // 8), bits, picks, found))
        pieces: dict[int, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            n = min(allowed(len(item), similarity) + 1, len(item))
            for a, b in itertools.pairwise(j * len(item) // n for j in range(n + 1)):
                pieces.setdefault(min(b - a, SEED_WORDS), []).append((k, a))  # of a long piece its first words
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.most = np.array([allowed(len(x), similarity) for x in self.items], np.int64)
        self.seeds = []
        for words_, at in sorted(pieces.items()):
            item, offset = (np.array(x) for x in zip(*at))
            key = self._seed_keys(np.stack([self.items[k][o : o + words_] for k, o in at], 1))
            by = np.argsort(key, kind="stable")
            sieve = np.zeros(1 << 20, bool)
            sieve[(key >> np.uint64(44)).astype(np.int64)] = True
            self.seeds.append((words_, key[by], item[by], offset[by], sieve))

    @staticmethod
    def _seed_keys(words: np.ndarray | list[np.ndarray]) -> np.ndarray:
        """Hashes of the words in each column."""
        key = np.zeros(len(words[0]), np.uint64)
        for c in words:
            key += c.astype(np.uint64) + np.uint64(1)
            key *= np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key * np.uint64(0x9E3779B97F4A7C15)

    def _seeded(self, codes: np.ndarray, first: np.ndarray, known: np.ndarray) -> set[tuple[int, int, int]]:
        """Candidates ``(text, item, place // 8)`` from the places of pieces."""
        out: set[tuple[int, int, int]] = set()
        n = len(codes)
        for size, keys, item, offset, sieve in self.seeds:
            q = np.flatnonzero(known[size:] - known[: n + 1 - size] == size)
            key = self._seed_keys([codes[q + j] for j in range(size)])
            maybe = np.flatnonzero(sieve[(key >> np.uint64(44)).astype(np.int64)])
            left, right = np.searchsorted(keys, key[maybe]), np.searchsorted(keys, key[maybe], "right")
            counts = right - left
            entry = np.repeat(left - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            place = np.repeat(q[maybe], counts)
            start, who = place - offset[entry], item[entry]
            text = np.searchsorted(first, place, "right") - 1
            a = np.maximum(start - self.most[who], first[text])
            b = np.minimum(start + self.sizes[who] + self.most[who], first[text + 1])
            enough = known[b] - known[a] >= self.sizes[who] - self.most[who]
            out.update(zip(text[enough].tolist(), who[enough].tolist(), (start[enough] // 8).tolist()))
        return out

    def _keys(self, codes: np.ndarray, at: np.ndarray, bits: list, picks: list) -> list[np.ndarray]:
        """For each table the hashed sampled steps of the walks that start at ``at``."""
        out = []
        mix = np.uint64(0x9E3779B97F4A7C15)
        for walk, tables in zip(bits, picks):
            keys = [np.zeros(len(at), np.uint64) for _ in tables]
            i = at.astype(np.int64)
            last = max(int(p[-1]) for p in tables)
            for j in range(last + 1):
                c = codes[i]
                for key, pick in zip(keys, tables):
                    if j in pick:
                        key += c.astype(np.uint64) + np.uint64(1)
                        key *= mix
                        key ^= key >> np.uint64(29)
                i += walk[j][c]
            out += [k * mix for k in keys]
        return out

    def codes_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word symbols of the texts, each followed by the end symbol, and where each text starts."""
        get, zero = self.vocabulary.get, itertools.repeat(0)
        parts, sizes = [], []
        for t in texts:
            words = words_of(t)
            parts.append(np.fromiter(map(get, words, zero), np.int32, len(words)))
            parts.append(np.array([self.end], np.int32))
            sizes.append(len(words) + 1)
        return np.concatenate(parts), np.cumsum([0, *sizes])

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """Matches ``(text, item, edit distance, end word)``, the best of each text and item."""
        codes, first = self.codes_of(texts)
        known = np.concatenate([[0], np.cumsum((codes > 0) & (codes < self.end))])
        candidates: set[tuple[int, int, int]] = set()
        n = len(codes)
        for low, high, stride, bits, picks, found in self.classes:
            spare = allowed(high, self.similarity)
            # a match's window of ``low`` words has at most ``spare`` words from elsewhere: start only where one may lie
            ends = np.minimum(np.arange(n) + low, n)
            fits = known[ends] - known[:-1] >= low - spare
            if not fits.any():
                continue
            near = np.concatenate([[0], np.cumsum(fits)])
            q = np.arange(0, n, stride)
            q = q[near[q + 1] - near[np.maximum(q - (high // 2 + spare), 0)] > 0]
            for key, (keys, item, offset, sieve) in zip(self._keys(codes, q, bits, picks), found):
                maybe = np.flatnonzero(sieve[(key >> np.uint64(44)).astype(np.int64)])
                left, right = np.searchsorted(keys, key[maybe]), np.searchsorted(keys, key[maybe], "right")
                hit = np.flatnonzero(right > left)
                if not len(hit):
                    continue
                counts = (right - left)[hit]
                entry = np.repeat(left[hit] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                place = np.repeat(q[maybe[hit]], counts)
                text = np.searchsorted(first, place, "right") - 1
                start = place - offset[entry]
                # places a few words apart share one verification window
                candidates.update(zip(text.tolist(), item[entry].tolist(), (start // 8).tolist()))
        candidates |= self._seeded(codes, first, known)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for text, item, block in candidates:
            size = len(self.items[item])
            most = allowed(size, self.similarity)
            a = max(int(first[text]), block * 8 - most)
            b = min(int(first[text + 1]) - 1, block * 8 + 8 + size + most)
            window = codes[a:b].tolist()
            if sum(map(self.masks[item].__contains__, window)) < size - most:
                continue  # too few of its words are the item's
            distance, end = best_window(self.masks[item], size, window)
            if distance <= most:
                got = (distance, a + end - int(first[text]))
                if got < best.get((text, item), (1 << 60, 0)):
                    best[text, item] = got
        return sorted((t, i, *m) for (t, i), m in best.items())


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, **how) -> Iterator[tuple]:
    """Broadcast index of each block of at most about ``block_bytes`` of item text, and whether it is the only one.

    One block at a time is read and broadcast; it is freed when the next one is asked for.
    """
    items = benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    part = F.pmod(F.xxhash64("t", "i"), F.lit(max(1, blocks)))
    spark = benchmark.sparkSession
    for b in range(blocks):
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in items.where(part == b).orderBy("i", "t").collect()], **how))
        yield index, blocks == 1
        if blocks > 1:
            index.destroy()


def _chunks(batch: pa.RecordBatch, column: int, most: int = 8_000_000):
    import pyarrow.compute as pc

    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        total += n
        if total >= most or i == batch.num_rows - 1:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0


#: Production parameters: least similarity, walks, tables of a walk, sampled steps of a table, seed.
METHOD = {"similarity": 0.8, "walks": 3, "tables": 4, "samples": 4, "seed": 20240501}


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 2_000_000, **how) -> DataFrame:
    """One row per document row and benchmark item that it holds: id, item id, ``edit_distance``, ``end_word``.

    An item is held if some window of the text is within ``1 - similarity`` word
    edits per item word.  Ties go to the leftmost end.  Null and wordless texts
    and items match nothing; null ids stay null; repeated rows give repeated
    matches; other columns are not read; an empty table on either side gives no
    rows.  A benchmark beyond ``block_bytes`` is run in blocks against all
    rows, one broadcast at a time, each block's matches written.
    """
    kinds = [docs.schema[id_col].dataType, benchmark.schema[item_col].dataType]
    schema = T.StructType([T.StructField(id_col, kinds[0]), T.StructField(item_col, kinds[1]), T.StructField("edit_distance", T.LongType()), T.StructField("end_word", T.LongType())])
    out = arrow_schema(schema)
    some = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    result = docs.sparkSession.createDataFrame([], schema)
    for index, only in _indexes(benchmark, item_col, item_text_col, block_bytes, **(METHOD | how)):

        def run(batches, index=index):
            for batch in batches:
                for part in _chunks(batch, 1):
                    ids = part.column(0).to_pylist()
                    got = index.value.find([t or "" for t in part.column(1).to_pylist()])
                    rows = [(ids[t], index.value.ids[i], d, e) for t, i, d, e in got]
                    columns = list(zip(*rows)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

        found = some.mapInArrow(run, schema)
        result = result.unionByName(found if only else cut(found, "leaks"))
    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 2_000_000, **how) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item; all columns stay as they are.

    Null and wordless texts hold none and stay.
    """
    at = docs.columns.index(text_col)
    for index, only in _indexes(benchmark, item_col, item_text_col, block_bytes, **(METHOD | how)):

        def run(batches, index=index):
            for batch in batches:
                for part in _chunks(batch, at):
                    held = {t for t, *_ in index.value.find([t or "" for t in part.column(at).to_pylist()])}
                    yield part.filter(pa.array([k not in held for k in range(part.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
        docs = docs if only else cut(docs, "clean")
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))

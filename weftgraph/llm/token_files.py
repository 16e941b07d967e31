"""Token-id output: frequency-ranked ids in byte-aligned codes with separate control bytes.

A shard file holds whole documents in ascending id order.  Its ids are replaced
by their frequency rank within the shard (rank table in the header), a rank
takes 1 to 4 bytes, and the byte counts of four ranks share one control byte,
kept apart from the data bytes, so numpy decodes a shard by table lookup.

File layout, little-endian: ``<8sQQIQ`` (magic, documents, ids, ranks, data bytes), then
rank table u32, document ids i64, their validity u8, document lengths u64,
control bytes, data bytes.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import arrow_schema, cut, fresh_path, map_rows, read_table

MAGIC = b"WGTOKEN1"
_HEAD = struct.Struct("<8sQQIQ")
#: For each control byte the lengths of its four codes.
LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], 1).astype(np.uint8)

#: White space of the byte-level pattern (Unicode White_Space), a fixed set.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters, then marks without an apostrophe: two tokens of the pattern whatever comes before and after.
_WORD_MARKS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: Where the pattern starts a new match whatever surrounds it: an optional space and what is no white space, a run of
#: white space without the character before the next word, that character.
_PIECE = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]")
_UNEVEN = "[\t\x0b\x0c\r\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n]{3}|[ \n]{2}$"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible bytes of Latin-1 stand for themselves, the others for the letters from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + hidden.index(b)) for b in hidden}


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece once per worker.

    Texts are cut where the byte-level pattern must start a new match, so joined
    piece ids equal the ids of the whole text.  Arrow cuts a chunk of texts and
    finds its distinct pieces, the library's model encodes those not met before,
    and numpy gathers the ids of all.  Texts with an added token's literal, and
    all texts of a tokenizer of another kind, are encoded whole by the library.
    The memo is emptied when it holds over ``room`` pieces or ``8 * room`` ids.
    """

    def __init__(self, path: str, room: int = 900_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        how = json.loads(self.tok.to_str())
        before = how["pre_tokenizer"] or {}
        self.byte_level = how["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and how["model"]["type"] == "BPE"
        self.tokenize, self.letters = self.tok.model.tokenize, _byte_letters()
        self.space = self.letters[ord(" ")]
        self.room = room
        self._empty()

    def _empty(self) -> None:
        """Forget all pieces.  A piece is keyed without the space before it; a line end before it is part of the key."""
        self.memo: dict[str, int] = {}
        self.marks: dict[str, list[int]] = {}
        self.start, self.size, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _match_ids(self, match: str, lead: str = "") -> list[int]:
        """Ids of one match of the pattern, after ``lead`` (byte-level letters)."""
        if not (match.isascii() and match.isalpha()):
            match = match.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenize(lead + match)]

    def _piece_ids(self, piece: str, spaced: bool) -> list[int]:
        """Ids of ``piece``, after a space if ``spaced``."""
        if m := _WORD_MARKS.fullmatch(piece):
            ids = self._match_ids(m[1], self.space if spaced else "")
            if m[2]:
                if (tail := self.marks.get(m[2])) is None:
                    tail = self.marks[m[2]] = self._match_ids(m[2])
                ids += tail
            return ids
        return [t.id for match, _ in self.tok.pre_tokenizer.pre_tokenize_str(" " + piece if spaced else piece) for t in self.tokenize(match)]

    def _learn(self, pieces: list[str]) -> None:
        ids, sizes = [], []
        for p in pieces:
            if p[:1] == "\n":
                got = self.line_end + (self._piece_ids(p[1:], False) if len(p) > 1 else [])
            else:
                got = self._piece_ids(p, True)
            ids += got
            sizes.append(len(got))
        self.memo.update(zip(pieces, range(len(self.size), len(self.size) + len(pieces))))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.pool = np.concatenate([self.pool, np.array(ids, "<u4")])

    @functools.cached_property
    def line_end(self) -> list[int]:
        return self._ids("\n").tolist()

    def _slots(self, pieces: list[str]) -> np.ndarray:
        slots = np.fromiter(map(self.memo.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(slots < 0)
        if len(new):
            self._learn([pieces[k] for k in new.tolist()])
            slots[new] = np.arange(len(self.size) - len(new), len(self.size))
        return slots

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text that has other white space than single or double spaces and line ends."""
        if not self.byte_level or any(a in text for a in self.added):
            return self._ids(text)
        ids: list[int] = []
        for p in _PIECE.findall(text):
            if p.isspace():
                ids += self._match_ids(p)
            else:
                key = p[1:] if p[0] == " " else "\n" + p
                at = int(self._slots([key])[0])
                got = self.pool[self.start[at] : self.start[at] + self.size[at]].tolist()
                ids += got if p[0] == " " else got[len(self.line_end) :]
        return np.array(ids, "<u4")

    def encode_all(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and how many each text has with it; null texts count as empty."""
        if len(self.memo) > self.room or len(self.pool) > 8 * self.room:
            self._empty()
        texts = pc.fill_null(texts, "")
        if not self.byte_level or len(self.line_end) != 1:
            odd = np.ones(len(texts), bool)
        else:
            marked = pc.match_substring_regex(texts, _UNEVEN)
            for literal in self.added:
                marked = pc.or_(marked, pc.match_substring(texts, literal))
            odd = marked.to_numpy(zero_copy_only=False)
        some = texts if not odd.any() else pc.if_else(pa.array(odd), "", texts)
        # every text gets a line end in front, so its first piece is like that of any other line
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", texts.type), pc.replace_substring(some, "\n", " \n"), pa.scalar("", texts.type)), " ")
        first = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        first -= first[0]
        slot = self._slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes = self.size[slot]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.start[slot] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[first]
        # the line end in front of each text, but for the first, becomes the end of the text before it
        ids[edges[:-1]] = end
        ids = np.concatenate([ids[1:], np.array([end], "<u4")]) if len(texts) else ids
        lengths = np.diff(edges)
        if odd.any():
            parts, done = [], 0
            for k in np.flatnonzero(odd).tolist():
                got = self._whole(texts[k].as_py())
                parts += [ids[done : edges[k]], got]
                done, lengths[k] = edges[k], len(got) + 1
            ids = np.concatenate([*parts, ids[done:]])
        return ids.astype("<u4", copy=False), lengths

    def encode_many(self, texts: list[str]) -> list[bytes]:
        ids, lengths = self.encode_all(pa.array(texts, pa.string()), 0)
        ends = np.cumsum(lengths)
        return [ids[b - n : b - 1].tobytes() for n, b in zip(lengths.tolist(), ends.tolist())]


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank table, control bytes and data bytes of ``ids``.

    Ties of frequency are ranked by id, so a shard's bytes depend on its ids only.
    """
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    seen = np.flatnonzero(counts)
    table = seen[np.argsort(-counts[seen], kind="stable")].astype("<u4")
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[table] = np.arange(len(table), dtype=np.uint32)
    ranks = rank_of[ids] if len(ids) else np.zeros(0, np.uint32)
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    quads[: len(ids)] = sizes - 1
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    keep = np.arange(4) < sizes[:, None]
    return table, control.astype(np.uint8), ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[keep]


def unpack(table: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Ids of a packed shard, by lookup of each control byte's lengths."""
    sizes = LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(sizes, dtype=np.int64)
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    at = ends - sizes
    ranks = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        if not len(more):
            break
        ranks[more] |= padded[at[more] + k].astype(np.uint32) << (8 * k)
    return table[ranks] if n else np.zeros(0, "<u4")


def shard_bytes(doc_ids: list, lengths: list[int] | np.ndarray, ids: np.ndarray) -> bytes:
    table, control, data = pack(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join(
        (
            _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(table), len(data)),
            table.tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            known.tobytes(),
            np.asarray(lengths, "<u8").tobytes(),
            control.tobytes(),
            data.tobytes(),
        )
    )


def read_shard(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, document lengths and ids of a shard file's bytes."""
    magic, n_docs, n, n_ranks, n_data = _HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(content, kind, count, at)
        at += got.nbytes
        return got

    table, docs, known, lengths = take("<u4", n_ranks), take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    control, data = take("u1", -(-n // 4)), take("u1", n_data)
    return [d if k else None for d, k in zip(docs.tolist(), known.tolist())], lengths.astype(np.int64), unpack(table, control, data, n)


#: Shards of one write task at most.
_PLACES = 1_000_000


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 0, shard_ids: int = 4_000_000) -> DataFrame:
    """Encode all texts and write shard files to ``folder``; returns the written manifest.

    The manifest has a row per shard: ``shard`` (its place in the order), ``file``,
    ``n_docs``, ``n_ids``.  Documents are range-partitioned and sorted by id (integers;
    null ids first), equal ids by a hash of the text and equal rows by their place in
    the input, so that one id of very many rows spreads over tasks; shards in manifest
    order hold ascending ids.  A null text counts as empty and has the end id only; an
    empty table writes no shard.  A retried task writes the same bytes under the same
    name: a file is written under a temporary name, takes the place of an older one
    and is moved there when whole.
    """
    manifest = T.StructType([T.StructField("shard", T.LongType()), T.StructField("file", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])
    out = arrow_schema(manifest)

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        enc = piece_encoder(tokenizer_path or default_tokenizer())
        part, seq = TaskContext.get().partitionId(), 0
        docs_: list = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        n_held = 0

        def flush():
            nonlocal docs_, lengths, held, n_held, seq
            name = f"{part:08d}-{seq:06d}.wgt"
            store.create_dir(root, recursive=True)
            temporary = f"{root}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as sink:
                sink.write(shard_bytes(docs_, np.concatenate(lengths), np.concatenate(held)))
            if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                store.delete_file(f"{root}/{name}")  # of a lost attempt; some stores do not move onto a file
            store.move(temporary, f"{root}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part * _PLACES + seq, name, len(docs_), n_held), out)], schema=out)
            docs_, lengths, held, n_held, seq = [], [], [], 0, seq + 1
            return row

        def chunks():
            """Keys and texts of about 8 MB of text: the more texts, the fewer distinct pieces for each."""
            keys, texts, size = [], [], 0
            for batch in batches:
                ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
                done = 0
                while done < batch.num_rows:
                    stop = int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _CHUNK - size)) + 1
                    part_ = batch.slice(done, stop - done)
                    keys += part_.column(0).to_pylist()
                    texts.append(part_.column(1))
                    size += int(ends[min(stop, batch.num_rows) - 1] - (ends[done - 1] if done else 0))
                    done = stop
                    if size >= _CHUNK:
                        yield keys, pa.concat_arrays(texts)
                        keys, texts, size = [], [], 0
            if keys:
                yield keys, pa.concat_arrays(texts)

        for keys, texts in chunks():
            ids, sizes = enc.encode_all(texts, end_id)
            ends, done = np.cumsum(sizes), 0
            while done < len(keys):  # a shard ends with the document that fills it
                before = int(ends[done - 1]) if done else 0
                stop = min(int(np.searchsorted(ends, before + shard_ids - n_held)) + 1, len(keys))
                docs_ += keys[done:stop]
                lengths.append(sizes[done:stop])
                held.append(ids[before : ends[stop - 1]])
                n_held += int(ends[stop - 1]) - before
                done = stop
                if n_held >= shard_ids:
                    yield flush()
        if docs_:
            yield flush()

    some = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t"), F.xxhash64(f"`{text_col}`").alias("h"), F.monotonically_increasing_id().alias("r"))
    some = some.repartitionByRange("k", "h", "r").sortWithinPartitions("k", "h", "r")
    return cut(some.select("k", "t").mapInArrow(run, manifest), "token-manifest")


#: Bytes of text that are encoded at once.
_CHUNK = 8_000_000


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Read shard files back: ``doc_id, start, n_tokens, ids`` per document, ids as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before it, over all shards.
    """
    return _read(spark, folder, manifest, "ids binary", lambda: lambda part: part.tobytes())


def read_token_checks(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """As :func:`read_token_files`, with the unsigned crc32 of each document's ids in place of the ids."""
    return _read(spark, folder, manifest, "ids_crc32 long", lambda: lambda part: zlib.crc32(part.tobytes()))


def _read(spark: SparkSession, folder: str, manifest: DataFrame, column: str, make_value) -> DataFrame:
    if manifest.isEmpty():
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {column}")

    def make():
        value = make_value()

        def work(cols):
            rows = []
            for path, content in zip(*cols):
                docs, lengths, ids = read_shard(content)
                ends = np.cumsum(lengths)
                rows += [(os.path.basename(path), d, b - n, n, value(ids[b - n : b])) for d, n, b in zip(docs, lengths.tolist(), ends.tolist())]
            return [list(c) for c in zip(*rows)] or [[]] * 5

        return work

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wgt").load(folder)
    rows = map_rows(files, ["path", "content"], f"file string, doc_id long, at long, n_tokens long, {column}", make)
    # prefix sums in two steps: over write tasks (a row each reaches the driver, which ran them), then within each
    task = manifest.withColumn("task", F.expr(f"shard div {_PLACES}"))
    sums = sorted(map(tuple, task.groupBy("task").agg(F.sum("n_ids")).collect()))
    firsts = spark.createDataFrame([(t, sum_ - n) for (t, n), sum_ in zip(sums, itertools.accumulate(n for _, n in sums))], "task long, first long")
    order = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = task.join(firsts, "task").select("file", (F.col("first") + F.coalesce(F.sum("n_ids").over(order), F.lit(0))).alias("before"))
    return rows.join(starts, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", column.split()[0])


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    manifest = write_token_files(read_table(spark, sf_dir, "documents"), folder)
    return read_token_checks(spark, folder, manifest)

"""Byte-level BPE encoding and decoding with a local rank file.

The tiktoken library does the merges.  Texts beyond ``limit`` characters are
split first, only where the pattern must start a new match (a space between two
characters that are not white space), so pieces encode as the whole would.  Long
runs of white space, beyond which the library's regular expression fails, are
matches by the pattern's own rule and are encoded without it.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import map_rows, read_table

#: White space of the pattern (Unicode White_Space), a fixed set.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SAFE = re.compile(f"[^{SPACES}] (?=[^{SPACES}])")
#: Runs of white space that the library's regular expression does not see.
_LONG_RUN = re.compile(f"[{SPACES}]{{10000,}}")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def encoding(rank_path: str):
    """The tiktoken encoding of a rank file; one per worker process and file."""
    import public_tokenizers
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("weftgraph", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, limit: int) -> list[str]:
    """Cut ``text`` into pieces of about ``limit`` characters at safe boundaries only.

    A piece without any safe boundary stays whole, however long it is.
    """
    pieces, start = [], 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit - 1)
        if cut is None:
            break
        pieces.append(text[start : cut.start() + 1])
        start = cut.start() + 1
    pieces.append(text[start:])
    return pieces


def matches_and_rest(text: str) -> Iterator[tuple[bool, str]]:
    """Parts of ``text``, each with whether it is one match of the pattern (a long run of white space) or a text to split.

    A run at the end is a match as it is; before a word its last character is none of it
    (that one belongs to the word or is a match of its own).
    """
    done = 0
    for m in _LONG_RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        yield False, text[done : m.start()]
        yield True, text[m.start() : end]
        done = end
    yield False, text[done:]


def encode_text(text: str, rank_path: str, limit: int = 1 << 16) -> np.ndarray:
    """Token ids of one text as unsigned 32-bit integers."""
    enc = encoding(rank_path)
    parts = []
    for whole, part in matches_and_rest(text):
        if whole:
            parts.append(np.array(enc._encode_single_piece(part), "<u4"))
        else:
            parts += [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(part, limit) if p]
    return np.concatenate(parts).astype("<u4", copy=False) if parts else np.empty(0, "<u4")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None, limit: int = 1 << 16) -> DataFrame:
    """Encode every text; returns ``(id_col, n_tokens, ids)``, ids as little-endian unsigned 32-bit integers.

    A null text counts as empty and gives no ids; a null id is kept; repeated
    rows give repeated results; other columns are not read.  The rank file is a
    path on every executor (default: the installed vocabulary).
    """

    def make():
        path = rank_path or default_ranks()

        def work(cols):
            ids = [encode_text(t or "", path, limit) for t in cols[1]]
            return [cols[0], [len(x) for x in ids], [x.tobytes() for x in ids]]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, n_tokens long, ids binary", make)


def decode(encoded: DataFrame, id_col: str = "doc_id", rank_path: str | None = None) -> DataFrame:
    """Decode ``ids`` to raw bytes; returns ``(id_col, n_tokens, ids, decoded)``.

    Bytes are joined as they are, so ids that cut a character still round-trip.
    Null ids count as none.
    """

    def make():
        enc = encoding(rank_path or default_ranks())

        def work(cols):
            back = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in cols[2]]
            return [*cols, back]

        return work

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_rows(encoded, [id_col, "n_tokens", "ids"], f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary", make, sized=2)


def digests(decoded: DataFrame) -> DataFrame:
    """The digest columns of the contract from :func:`decode`'s output."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return digests(decode(encode(docs)))

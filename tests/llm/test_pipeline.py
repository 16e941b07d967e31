"""The whole pipeline against a plain Python version of its stages."""

import hashlib
import re

import numpy as np
import xxhash

import corpus_pipeline
from weftgraph.llm import bpe, decontaminate, secrets
from weftgraph.llm import quality_rules as q

from .test_methods import FIXTURE, brute_components, low, naive_rules, words


def cleaned(text):
    """Text without failing lines, or None if the document is rejected."""
    n, _, _, _, repeated = naive_rules(text)
    if n < 50 or 100 * repeated > 50 * n:
        return None

    def fails(line):
        w = len(words(line))
        if not w:
            return False
        over = lambda pattern, share: len(re.findall(pattern, line)) > max(0, share * w)
        return (
            (line.rstrip(" \t\n\x0b\x0c\r")[-1] not in q.TERMINAL and not re.search(q.SENTENCE_END, line))
            or over(q.SYMBOLS, q.MAX_SYMBOLS)
            or over(q.SHOUTS, q.MAX_SHOUTS)
            or over(q.SEPARATORS, q.MAX_SEPARATORS)
            or (len(line) <= 60 and re.search(q.MENU, line))
            or any(b in line.lower() for b in q.BOILERPLATE)
        )

    kept = "\n".join(line for line in text.split("\n") if not fails(line))
    return kept if n - len(words(kept)) <= q.MAX_LOST * n else None


def fingerprint(text):
    w = words(low(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_pipeline_matches_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FIXTURE}/documents.parquet").collect()}
    docs = {i: c for i, t in docs.items() if (c := cleaned(t)) is not None}
    component = brute_components({i: fingerprint(t) for i, t in docs.items()})
    docs = {i: t for i, t in docs.items() if component[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FIXTURE}/benchmark.parquet").collect()]
    index = decontaminate.Index(items, **decontaminate.METHOD)

    def held(text):
        code = index.codes_of([text])[0].tolist()[:-1]
        return any(decontaminate.best_window(m, len(x), code)[0] <= decontaminate.allowed(len(x), 0.8) for m, x in zip(index.masks, index.items))

    docs = {i: secrets.redact(t) for i, t in docs.items() if not held(t)}
    enc = bpe.encoding(bpe.default_ranks())
    want = {}
    for i, t in docs.items():
        ids = np.array(enc.encode_ordinary(t), "<u4").tobytes()
        want[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, FIXTURE).collect()}
    assert got == want and len(want) > 50

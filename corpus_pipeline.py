"""A training-corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontaminate, quality_rules, secrets, simhash
from weftgraph.llm.common import cut, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their failing lines.

    Null, empty and wordless texts are rejected; null ids stay; repeated rows are
    judged each by itself and stay repeated; an empty table gives no rows; other
    columns, whatever their names, are passed on (``n_chars`` follows a changed text).
    """
    return quality_rules.apply_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id.

    Of equal ids and of repeated rows one row is left; a null id is chosen only
    where its group has no other; null, empty and wordless texts form one group;
    an empty table gives no rows; other columns are passed on.
    """
    return simhash.deduplicate(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the edit similarity of the operator.

    Null and wordless texts hold none and stay, as do null ids and repeated rows;
    null and wordless items match nothing; with an empty table on either side
    the rows stay as they are; other columns are passed on.
    """
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark.

    Null texts stay null and empty ones empty; null ids and repeated rows stay;
    an empty table gives no rows; other columns are passed on (``n_chars``
    follows a changed text).
    """
    return secrets.redact_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the decoded bytes.

    A null or empty text has no ids; null ids and repeated rows stay; an empty
    table gives no rows; other columns are left out.
    """
    decoded = bpe.decode(bpe.encode(docs))
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", without_benchmarks),
    ("secret scans", without_secrets),
    ("byte-level BPE", tokens),
]

#: The stages decode, hash and compare in ways that SQL can't express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written once and read back.

    Nulls, empty texts, ties and repeated rows are as each stage says; an empty
    table passes all stages and gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs

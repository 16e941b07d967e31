"""Token counts as delta-maintained rollups with idempotent batch commits.

A batch of changes becomes signed additive deltas per (source, language,
tokenizer version): an insert adds a document and its tokens, a delete takes
them away, a revision takes away the old figures and adds the new ones.  Totals
are sums of committed deltas, so no batch reads earlier documents again.

A batch is staged under a name of its own.  It becomes visible when its commit
file, written whole under another name, is renamed to the batch's id, which the
file system does for one writer only: a writer lost at any point leaves either
nothing visible or the whole batch.  A batch id that has been committed is not
applied again, whoever retries it.  Compaction folds committed batches into a
snapshot of the totals, made visible in the same way, so reading costs the last
snapshot and the few batches after it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe
from weftgraph.llm.common import WORD, cut, fresh_path, map_rows, read_table
from weftgraph.sources.tables import publish, published, remove

KEYS = ("source", "lang", "tokenizer_version")
_SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
#: Letters and digits in runs, every other visible character alone.
WORD_OR_MARK = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"


def signed(rows: DataFrame, sign: int, tokens: str = "n_tokens") -> DataFrame:
    """Additive deltas of document rows with ``KEYS`` and a token count, a null count being zero."""
    return rows.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.coalesce(F.col(tokens), F.lit(0)).cast("long") * sign).alias("n_tokens"))


def inserts(rows: DataFrame) -> DataFrame:
    return signed(rows, 1)


def deletes(rows: DataFrame) -> DataFrame:
    return signed(rows, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas of rows whose figures or keys changed from ``old`` to ``new``."""
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    """A rollup below ``folder``, any path that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 100):
        self.spark, self.folder, self.compact_every = spark, folder.rstrip("/"), compact_every

    def _checked(self, batch_id: str) -> str:
        if not batch_id or not all(c.isalnum() or c in "-_." for c in batch_id) or batch_id.startswith((".", "_")):
            raise ValueError("a batch id has letters, digits, '-', '_' and '.' only and starts with none of the marks")
        return batch_id

    def committed(self, batch_id: str) -> bool:
        return self._checked(batch_id) in self.batches()

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Apply ``deltas`` once; False if the batch had been committed (nothing is then computed or changed).

        Rows are pre-aggregated per key before they are written.  Null keys form
        keys of their own; an empty batch is committed and changes nothing.
        """
        if self.committed(batch_id):
            return False
        stage = f"{self.folder}/staged/{batch_id}-{uuid.uuid4().hex}"
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.select(*KEYS, "n_docs", "n_tokens").write.parquet(stage)
        if not publish(self.spark, f"{self.folder}/commits", batch_id, stage):
            remove(self.spark, stage)  # another writer was first
            return False
        if len(self._pending()[1]) >= self.compact_every:
            self.compact()
        return True

    def batches(self) -> list[str]:
        return published(self.spark, f"{self.folder}/commits")

    def _read(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def _pending(self) -> tuple[str | None, list[str]]:
        """The folder of the last snapshot, if any, and the batches committed after it (names only reach the driver)."""
        snapshots = published(self.spark, f"{self.folder}/snapshots")
        if not snapshots:
            return None, self.batches()
        where = self._read(f"{self.folder}/snapshots/{snapshots[-1]}")
        folded = {r[0] for r in self.spark.read.text(f"{where}/folded").collect()}
        return where, [b for b in self.batches() if b not in folded]

    def compact(self) -> bool:
        """Fold the batches after the last snapshot into a new one; False if there are none or another writer was first."""
        where, pending = self._pending()
        if not pending:
            return False
        new = f"{self.folder}/folds/{uuid.uuid4().hex}"
        self._sums(where, pending).write.parquet(f"{new}/totals")
        folded = self.spark.createDataFrame([(b,) for b in pending], "value string")
        if where:
            folded = folded.unionByName(self.spark.read.text(f"{where}/folded"))
        folded.coalesce(1).write.text(f"{new}/folded")
        number = len(published(self.spark, f"{self.folder}/snapshots"))
        done = publish(self.spark, f"{self.folder}/snapshots", f"{number:08d}", new)
        if not done:
            remove(self.spark, new)
        return done

    def _sums(self, where: str | None, pending: list[str]) -> DataFrame:
        stages = [r[0] for r in self.spark.read.text([f"{self.folder}/commits/{b}" for b in pending], wholetext=True).collect()] if pending else []  # one short row per batch
        rows = self.spark.read.schema(_SCHEMA).parquet(*stages, *([f"{where}/totals"] if where else []))
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """Current totals per key; keys without documents and tokens are left out."""
        where, pending = self._pending()
        if not where and not pending:
            return self.spark.createDataFrame([], _SCHEMA)
        return self._sums(where, pending).where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def counted_by_tokenizers(docs: DataFrame, versions: dict[str, str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """As :func:`counted`, each version given as the rank file of a byte-level BPE tokenizer (a path on every executor)."""

    def make():
        def work(cols):
            counts = [[len(bpe.encode_text(t or "", path)) for t in cols[-1]] for path in versions.values()]
            return [*cols[:-1], *counts]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    some = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    return map_rows(some, ["doc_id", "source", "lang", "text"], f"doc_id {kind}, source string, lang string, " + ", ".join(f"`{v}` long" for v in versions), make, sized=3)


def counted(docs: DataFrame, versions: dict[str, str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``doc_id, source, lang`` and a count for each tokenizer version, given as its token pattern; a null text has none."""
    counts = [F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(pattern)), F.lit(0)).cast("long").alias(version) for version, pattern in versions.items()]
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{lang_col}`").alias("lang"), *counts)


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter with version v1, English ones move to v2, low-quality ones leave; each batch is sent twice."""
    docs = cut(counted(read_table(spark, sf_dir, "documents"), {"v1": WORD, "v2": WORD_OR_MARK}), "token-counts")
    low = read_table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()

    def as_of(rows: DataFrame, version: str) -> DataFrame:
        return rows.withColumn("tokenizer_version", F.lit(version)).withColumn("n_tokens", F.col(version))

    english = docs.where("lang = 'en'")
    gone = docs.join(low, "doc_id", "left_semi")
    now = gone.withColumn("tokenizer_version", F.when(F.col("lang") == "en", "v2").otherwise("v1")).withColumn("n_tokens", F.when(F.col("lang") == "en", F.col("v2")).otherwise(F.col("v1")))
    rollup = Rollup(spark, fresh_path(spark, "token-rollup"))
    for batch_id, deltas in (("load", inserts(as_of(docs, "v1"))), ("english-v2", revisions(as_of(english, "v1"), as_of(english, "v2"))), ("low-quality", deletes(now))) * 2:
        rollup.commit(batch_id, deltas)
    return rollup.totals()


OP4_SQL = f"""
SELECT source, lang, CASE WHEN lang = 'en' THEN 'v2' ELSE 'v1' END AS tokenizer_version, count(*) AS n_docs,
  CAST(sum(CASE WHEN lang = 'en' THEN len(regexp_extract_all(coalesce(text, ''), '{WORD_OR_MARK}')) ELSE len(regexp_extract_all(coalesce(text, ''), '{WORD}')) END) AS BIGINT) AS n_tokens
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)
GROUP BY 1, 2, 3
"""

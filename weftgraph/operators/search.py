"""Symbol search: inverted index, BM25, tiers, scores, selectors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.columns import KIND_ALIASES, in_scope, is_test_path, kind_weight, name_similarity, snake
from weftgraph.sources.tables import cut

_K1, _B = 1.2, 0.75


def parse_query(text: str) -> dict[str, str]:
    """``kind: lang: path: name:`` filters and the free ``text``; an unknown prefix is free text."""
    out, free = {}, []
    for word in text.split():
        key, colon, value = word.partition(":")
        if colon and value and key in ("kind", "lang", "path", "name"):
            out[key] = KIND_ALIASES.get(value.lower(), value.lower()) if key == "kind" else value
        else:
            free.append(word)
    return out | {"text": " ".join(free)}


def sanitize(query: str) -> str:
    return re.sub(r"[^\w\s]", "", query).strip()


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; ``_`` separates."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)


def inverted_index(docs: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """Postings ``token, id, tf, len``; null texts have no tokens."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.concat_ws(" ", *text_cols)).alias("w")).select("id", F.size("w").alias("len"), F.explode("w").alias("token"))
    return words.groupBy("token", "id", "len").agg(F.count("*").alias("tf"))


def bm25(postings: DataFrame, query: str, n_docs: int, avg_len: float) -> DataFrame:
    """``id, score`` of documents with all query tokens, the last being a prefix; an empty query has none."""
    words = [w.lower() for w in re.findall(r"[^\W_]+", sanitize(query))]
    if not words:
        return postings.select("id", F.lit(0.0).alias("score")).limit(0)
    terms = [F.col("token").startswith(w) if k == len(words) - 1 else F.col("token") == w for k, w in enumerate(words)]
    part = None
    for k, match in enumerate(terms):
        mine = postings.where(match).groupBy("id", "len").agg(F.sum("tf").alias("tf")).withColumn("term", F.lit(k))
        part = mine if part is None else part.unionByName(mine)
    part = cut(part, "matches")
    df = part.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (_K1 + 1) / (F.col("tf") + _K1 * (1 - _B + _B * F.col("len") / F.lit(avg_len)))
    return part.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(weight).alias("score"), F.count("*").alias("n")).where(F.col("n") == len(words)).select("id", "score")


class SearchIndex:
    """Postings and document figures below ``folder``, written once and read by every search.

    Postings are range-partitioned and sorted by (token, id): a common token spreads over files, and the
    statistics of the files leave out those without the tokens of a search.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, docs: DataFrame, id_col: str, text_cols: list[str]) -> SearchIndex:
        """Index ``docs`` in place of what was there; null texts have no tokens, ids are unique."""
        postings = inverted_index(docs, id_col, text_cols)
        postings.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{self.folder}/postings")
        lengths = self.postings().groupBy("id").agg(F.max("len").alias("len")).agg(F.avg("len").alias("avg_len"))
        docs.agg(F.count("*").alias("n_docs")).crossJoin(lengths).write.mode("overwrite").parquet(f"{self.folder}/figures")
        return self

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/postings")

    def search(self, query: str) -> DataFrame:
        """``id, score`` as :func:`bm25` gives them."""
        n_docs, avg_len = self.spark.read.parquet(f"{self.folder}/figures").select("n_docs", "avg_len").first()
        return bm25(self.postings(), query, n_docs, avg_len or 1.0)


def like(symbols: DataFrame, pattern: str) -> DataFrame:
    """Symbols whose name or qualified name holds the pattern, ignoring case; nothing for an empty one."""
    pattern = re.sub("[%_]", "", pattern).lower()
    if not pattern:
        return symbols.limit(0)
    return symbols.where(F.lower("name").contains(pattern) | F.lower("qualified_name").contains(pattern))


def fuzzy(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols within ceil(0.4 byte length) edits of the query, by raw or snake form; adds ``distance``."""
    most = -(-len(query.encode()) * 4 // 10)
    low, form = F.lit(query.lower()), snake(F.lit(query))
    distance = F.least(F.levenshtein(low, F.lower("name")), F.levenshtein(form, snake(F.col("name"))))
    return symbols.withColumn("distance", distance).where(F.col("distance") <= most)


def scored(symbols: DataFrame, query: str, degrees: DataFrame, fts: DataFrame) -> DataFrame:
    """``symbol_id, total`` from text match, name, degree, qualified name, kind and path.

    Weights .35 .25 .10 .15 .10 .05; text score and degree relative to the greatest one.
    """
    q = F.lit(query)
    joined = symbols.join(degrees.withColumnRenamed("node", "symbol_id"), "symbol_id", "left").join(fts.select(F.col("id").alias("symbol_id"), F.col("score").alias("fts")), "symbol_id", "left")
    known = symbols.select("symbol_id")
    best = fts.join(known, F.col("id") == F.col("symbol_id"), "left_semi").agg(F.max("score").alias("max_fts"))
    top = best.crossJoin(degrees.join(known, F.col("node") == F.col("symbol_id"), "left_semi").agg(F.max("degree").alias("max_degree")))
    joined = joined.crossJoin(F.broadcast(top))  # one row
    share = lambda x, most: F.when(F.coalesce(most, F.lit(0)) > 0, F.coalesce(x, F.lit(0)) / most).otherwise(0.0)
    qualified = F.when(F.lower("qualified_name") == F.lower(q), 1.0).when(F.lower("qualified_name").contains(query.lower()), 0.7).otherwise(0.0)
    total = (
        0.35 * share(F.col("fts"), F.col("max_fts"))
        + 0.25 * name_similarity(q, F.col("name"))
        + 0.10 * share(F.col("degree"), F.col("max_degree"))
        + 0.15 * qualified
        + 0.10 * kind_weight(F.col("kind"))
        + 0.05 * F.when(is_test_path(F.col("path")), 0.2).otherwise(0.5)
    )
    return joined.select("symbol_id", "qualified_name", F.round(total, 6).alias("total"))


def search(symbols: DataFrame, query: str, scope: str = ".", limit: int = 20) -> DataFrame:
    """Tiered search: token match, then substring, then fuzzy; each tier only if those before found nothing.

    Returns ``symbol_id, name, qualified_name, tier, similarity``, best first.
    """
    wanted = parse_query(query)
    rows = symbols.where(in_scope(F.col("path"), scope))
    for key, column in (("kind", "kind"), ("lang", "language")):
        if key in wanted:
            rows = rows.where(F.col(column) == wanted[key])
    if "path" in wanted:
        rows = rows.where(F.lower("path").contains(wanted["path"].lower()))
    if "name" in wanted:
        rows = rows.where(F.lower("name").contains(wanted["name"].lower()))
    text = wanted["text"]
    words = [w.lower() for w in re.findall(r"[^\W_]+", sanitize(text))]
    have = tokens(F.concat_ws(" ", "name", "qualified_name"))
    tiers = []
    if words:
        match = F.exists(have, lambda t: t.startswith(words[-1]))
        for w in words[:-1]:
            match = match & F.array_contains(have, w)
        tiers.append(("token", rows.where(match)))
        if len(text) >= 2:
            tiers.append(("like", like(rows, text)))
        tiers.append(("fuzzy", fuzzy(rows, text).drop("distance")))
    elif len(wanted) > 1:
        tiers.append(("filter", rows))
    for tier, found in tiers:
        ranked = found.withColumn("similarity", F.round(name_similarity(F.lit(text), F.col("name")), 6)).orderBy(F.desc("similarity"), "qualified_name", "symbol_id").limit(limit)
        if tier == tiers[-1][0] or not ranked.isEmpty():
            return ranked.select("symbol_id", "name", "qualified_name", F.lit(tier).alias("tier"), "similarity")
    return rows.limit(0).select("symbol_id", "name", "qualified_name", F.lit("none").alias("tier"), F.lit(0.0).alias("similarity"))


def selector_scores(symbols: DataFrame, name: str, path: str | None = None, line: Column | None = None, kind: str | None = None, language: str | None = None) -> DataFrame:
    """Candidates of a selector with ``score``: name, then path, line distance, kind and language hints; best 50."""
    score = F.when(F.col("qualified_name") == name, 10_000).when(F.col("name") == name, 9_000).otherwise(0)
    rows = symbols.where((F.col("qualified_name") == name) | (F.col("name") == name))
    if path:
        base = path.rsplit("/", 1)[-1]
        shared = F.size(F.array_intersect(F.split("path", "/"), F.array(*[F.lit(p) for p in path.split("/")])))
        score = score + F.when(F.col("path") == path, 3_000).when(F.col("path").endswith("/" + path), 2_000).when(F.substring_index("path", "/", -1) == base, 1_200).otherwise(F.least(F.lit(1_000), 200 * shared))
    if line is not None:
        d = F.abs(line)
        score = score + F.when(d == 0, 1_200).when(d <= 2, 800).when(d <= 10, 500).when(d <= 50, 200).when(d <= 100, F.least(100 - d, F.lit(100))).otherwise(0)
    if kind:
        score = score + F.when(F.col("kind") == kind, 200).otherwise(0)
    if language:
        score = score + F.when(F.col("language") == language, 100).otherwise(0)
    return rows.withColumn("score", score.cast("long")).orderBy(F.desc("score"), "symbol_id").limit(50)


def unique_selection(candidates: DataFrame, gap: int = 400) -> tuple[str, list]:
    """``single``, ``ambiguous`` or ``not_found`` with the candidates; single if the best leads by ``gap``."""
    rows = candidates.orderBy(F.desc("score"), "symbol_id").limit(50).collect()
    if not rows:
        return "not_found", []
    return ("single", rows[:1]) if len(rows) == 1 or rows[0]["score"] - rows[1]["score"] >= gap else ("ambiguous", rows)


def idf(n: Column, matches: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log((n - matches + 0.5) / (matches + 0.5) + 1)))


def path_match(path: Column, query: Column) -> Column:
    """Exact, suffix, same_basename, fuzzy (shared trailing folders) or none."""
    base = lambda p: F.substring_index(p, "/", -1)
    shared = F.size(F.array_intersect(F.split(path, "/"), F.split(query, "/")))
    return F.when(path == query, "exact").when(path.endswith(F.concat(F.lit("/"), query)), "suffix").when(base(path) == base(query), "same_basename").when(shared > 0, "fuzzy").otherwise("none")


def top_fan_out(references: DataFrame, symbols: DataFrame, most: int = 30) -> DataFrame:
    """Names with the most reference-symbol pairs: ``name, n_refs, n_symbols, pairs``."""
    a = references.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n_refs"))
    b = symbols.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n_symbols"))
    return a.join(b, "name").withColumn("pairs", F.col("n_refs") * F.col("n_symbols")).orderBy(F.desc("pairs"), "name").limit(most)


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of greatest ``order`` of each key; ties by the other columns."""
    w = Window.partitionBy(key).orderBy(F.desc(order), *[F.desc(c) for c in rows.columns if c not in (key, order)])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

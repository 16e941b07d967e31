"""Reference resolution as staged joins; each stage sees only what the stages before left.

Stages: builtin names never resolve; lexical scope (1.0), same file (exact name,
1.0), imports (0.8; an imported name that misses goes no further), exact name by
proximity (1.0, other case 0.9), fuzzy name (similarity of at least 0.4, not for calls).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import is_test_path, name_similarity
from weftgraph.operators.joins import fuzzy_names, nearest_by_key, place_columns, spread_join
from weftgraph.sources.tables import cut

CALLABLE = ("function", "method", "constructor", "class", "struct", "interface", "trait", "variable")
#: Builtin names by language.
BUILTINS = {
    "python": ("print", "len", "range", "str", "int", "list", "dict", "set", "tuple", "open", "super", "isinstance"),
    "javascript": ("console", "Object", "Array", "Promise", "JSON", "Math", "parseInt", "setTimeout"),
    "typescript": ("console", "Object", "Array", "Promise", "JSON", "Math", "parseInt", "setTimeout"),
    "java": ("System", "String", "Integer", "Object", "Math"),
    "c": ("printf", "malloc", "free", "memcpy", "memset", "strlen", "sizeof"),
    "cpp": ("printf", "malloc", "free", "memcpy", "std", "sizeof"),
}


def without_builtins(references: DataFrame) -> DataFrame:
    """References whose (language, name) is no builtin."""
    rows = [(lang, n) for lang, names in BUILTINS.items() for n in names]
    table = references.sparkSession.createDataFrame(rows, "language string, name string")
    return references.join(F.broadcast(table), ["language", "name"], "left_anti").select(*references.columns)


def fuzzy_eligible(references: DataFrame) -> DataFrame:
    return references.where((F.length("name") >= 3) & F.col("name").rlike("^[A-Za-z_$][A-Za-z0-9_$]*$") & (F.col("kind") != "call"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """``cut`` for tables with a row for each reference or symbol: their joins are shuffled.

    Ids and repeated names compress so well that millions of rows look small enough to broadcast, which the driver's memory would not hold.
    """
    return cut(df, name).hint("merge")


def resolve(references: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, min_similarity: float = 0.4) -> DataFrame:
    """``reference_id, symbol_id, confidence, strategy`` of every reference that resolves.

    ``references (reference_id, file_id, path, language, name, kind)``, ``symbols
    (symbol_id, file_id, path, name, kind)``, ``imports (file_id, name, target_file)``.
    Ties go to the least symbol id; null names never resolve.  Symbols of test
    files serve global stages only for references in test files.  Every stage joins
    references to symbols reduced to one row per name and place, so references are
    never multiplied by the number of symbols of a common name.  It ends where nothing is left.
    """
    placed = [c.alias(f"__{n}") for n, c in place_columns(F.col("path")).items()]
    # without the path, which is most of a row: a stage writes and shuffles all that it leaves
    todo = kept(without_builtins(references.where("name IS NOT NULL")).select("reference_id", "file_id", "name", "kind", is_test_path(F.col("path")).alias("__test"), *placed), "refs")
    own = symbols.where("name IS NOT NULL").select("symbol_id", "file_id", "name", F.col("kind").isin(*CALLABLE).alias("callable"), is_test_path(F.col("path")).alias("test"), *[c.alias(n) for n, c in place_columns(F.col("path")).items()])
    own = kept(own, "symbols")
    done = []

    def settle(found: DataFrame, confidence, strategy: str, last: bool = False) -> int:
        """Take what a stage found and keep the rest, of which it returns the number."""
        nonlocal todo
        found = kept(found.where("symbol_id IS NOT NULL").select("reference_id", "symbol_id", F.round(confidence, 6).alias("confidence"), F.lit(strategy).alias("strategy")), "resolved")
        done.append(found)
        if last:
            return 0
        todo = kept(todo.join(found, "reference_id", "left_anti").select(*todo.columns), "refs")
        return todo.count()

    in_file = own.groupBy("file_id", "name").agg(F.min("symbol_id").alias("any"), F.min(F.when(F.col("callable"), F.col("symbol_id"))).alias("called"))
    mine = F.when(F.col("kind") == "call", F.col("called")).otherwise(F.col("any")).alias("symbol_id")
    n = settle(todo.join(in_file, ["file_id", "name"]).select("reference_id", mine), F.lit(1.0), "same_file")
    if n and imports is not None:
        named = kept(imports.select("file_id", "name", "target_file").distinct(), "imports")
        reach = named.join(in_file.withColumnRenamed("file_id", "target_file"), ["target_file", "name"]).groupBy("file_id", "name").agg(F.min("any").alias("any"), F.min("called").alias("called"))
        settle(todo.join(reach, ["file_id", "name"]).select("reference_id", mine), F.lit(0.8), "import")
        todo = todo.join(named.select("file_id", "name").distinct(), ["file_id", "name"], "left_anti").select(*todo.columns)  # imported but unresolved: no global fallback
        todo = kept(todo, "refs")
        n = todo.count()
    choices = {"any": F.lit(True), "call": F.col("callable"), "main": ~F.col("test"), "main_call": F.col("callable") & ~F.col("test")}
    choice = F.when(F.col("kind") == "call", F.when(F.col("__test"), "call").otherwise("main_call")).otherwise(F.when(F.col("__test"), "any").otherwise("main"))
    for key, confidence in ((F.col("name"), 1.0), (F.lower("name"), 0.9)):
        if not n:
            break
        left = todo.select("reference_id", key.alias("k"), choice.alias("choice"), F.col("__folder").alias("folder"), F.col("__top").alias("top"))
        right = own.select("symbol_id", key.alias("k"), "folder", "top", "callable", "test")
        # each name and place is looked up once; a common one's references stay spread when the answer comes back
        place = ["k", "choice", "folder", "top"]
        asked = kept(left.groupBy(*place).agg(F.count("*").alias("n")), "places")
        answers = nearest_by_key(asked, right, choices, F.col("choice")).select(*place, "n", "symbol_id")
        n = settle(spread_join(left, kept(answers, "answers"), place, n), F.lit(confidence), "exact_name")
    if not n:
        return reduce(DataFrame.unionByName, done)
    left = fuzzy_eligible(todo)
    near = fuzzy_names(left.select(F.col("name").alias("query")), own.select("name"))
    near = near.withColumn("similarity", name_similarity(F.col("query"), F.col("name"))).where(F.col("similarity") >= min_similarity)
    least = own.groupBy("name").agg(F.min("symbol_id").alias("any"), F.min(F.when(~F.col("test"), F.col("symbol_id"))).alias("main"))
    close = near.select(F.col("query"), "name", "similarity").join(least, "name").select(F.col("query").alias("name"), "similarity", "any", "main")
    pairs = left.join(close, "name").withColumn("symbol_id", F.when(F.col("__test"), F.col("any")).otherwise(F.col("main"))).where("symbol_id IS NOT NULL")
    order = F.struct(-F.col("similarity"), "symbol_id")
    best = pairs.groupBy("reference_id").agg(F.min_by("symbol_id", order).alias("symbol_id"), F.max("similarity").alias("similarity"))
    settle(best, F.col("similarity"), "fuzzy", last=True)
    return reduce(DataFrame.unionByName, done)


def apply_resolutions(references: DataFrame, resolved: DataFrame) -> DataFrame:
    """References with the resolved columns of ``resolved``; others keep theirs."""
    new = resolved.select("reference_id", F.col("symbol_id").alias("__s"), F.col("confidence").alias("__c"), F.col("strategy").alias("__t"))
    out = references.join(new, "reference_id", "left")
    pairs = {"resolved_symbol_id": "__s", "resolved_confidence": "__c", "resolved_strategy": "__t"}
    return out.select(*[F.coalesce(pairs[c], c).alias(c) if c in pairs else c for c in references.columns])


def invalidate(references: DataFrame, gone: DataFrame) -> DataFrame:
    """References into the files of ``gone (symbol_id)`` lose their resolution."""
    lost = gone.select(F.col("symbol_id").alias("resolved_symbol_id"), F.lit(True).alias("__gone")).distinct()
    out = references.join(lost, "resolved_symbol_id", "left")
    return out.select(*[F.when(F.col("__gone"), None).otherwise(F.col(c)).alias(c) if c.startswith("resolved_") else F.col(c) for c in references.columns])

"""Column factories: paths, names, scores, confidences.  All stay inside the JVM."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edge-kind sets.
CALL = ("calls", "instantiates", "implements")
PATH = (*CALL, "registers_callback")
IMPACT = (*PATH, "imports", "includes")

#: Weight of a symbol kind in search.
KIND_WEIGHTS = {
    "class": 0.8, "interface": 0.8, "trait": 0.8, "function": 0.6, "method": 0.6, "constructor": 0.6,
    "struct": 0.5, "enum": 0.5, "type_alias": 0.5, "module": 0.4, "namespace": 0.4, "package": 0.4,
    "variable": 0.3, "field": 0.3, "property": 0.3, "constant": 0.25, "enum_member": 0.25,
    "parameter": 0.15, "macro": 0.15, "decorator": 0.15,
}
#: Kinds that a query may name by another word.
KIND_ALIASES = {"fn": "function", "func": "function", "cls": "class", "iface": "interface", "var": "variable", "const": "constant", "mod": "module"}
#: File extension to language.
LANGUAGES = {
    "ets": "arkts", "c": "c", "h": "c", "cj": "cangjie", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "go": "go",
    "java": "java", "js": "javascript", "jsx": "javascript", "kt": "kotlin", "php": "php", "py": "python", "rb": "ruby", "rs": "rust", "ts": "typescript", "tsx": "typescript",
}
#: Capability bits of a file, and the bits that each extraction layer proves.
BITS = {"manifest": 1, "structural": 2, "call_edges": 4, "cfg": 8, "dataflow": 16, "summaries": 32}
LAYER_BITS = {"manifest": 1, "structural": 3, "resolution_symbols": 1, "dataflow": 23, "cfg": 8, "summaries": 32}
#: Name parts of stand-ins, which make a hop dearer.
PROXY_WORDS = ("proxy", "socks", "fallback", "alternate", "backup", "spare", "alt_", "_alt")


def any_of(conditions) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def in_scope(path: Column, scope: str) -> Column:
    """Path prefix filter at a folder boundary; '' and '.' are the whole project."""
    scope = re.sub(r"^(\./)+|/+$", "", scope.strip())
    if scope in ("", "."):
        return F.lit(True)
    return (path == scope) | path.startswith(scope + "/")


def glob_regex(pattern: str) -> str:
    """Regular expression of a path glob: ``**`` spans folders, ``*`` and ``?`` stay within one."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def is_test_path(path: Column) -> Column:
    """Folder and stem heuristics for test files."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    folders = any_of([low.contains(p) for p in ("/test/", "/tests/", "/spec/", "/__tests__/", "/testing/", "test/", "tests/")])
    return folders | any_of([stem.endswith(e) for e in ("_test", ".test", "_spec", ".spec")]) | stem.startswith("test") | name.contains(".test.") | name.contains(".spec.")


def is_explicit_test_path(path: Column) -> Column:
    """Whether a path component is a test folder's name."""
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(x) for x in ("test", "tests", "testing", "selftests", "spec", "__tests__")]))


def is_test_name(name: Column) -> Column:
    return name.rlike("^(Test|Benchmark)|^test_|_test$")


def kind_weight(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(KIND_WEIGHTS), kind), F.lit(0.1))


def language_of(path: Column) -> Column:
    return F.try_element_at(literal_map(LANGUAGES), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def name_parts(name: Column) -> Column:
    """Words of a camel- or snake-case name, lower-cased: ``XMLParser`` gives xml, parser."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), F.lower)


def snake(name: Column) -> Column:
    return F.array_join(name_parts(name), "_")


def name_similarity(query: Column, name: Column) -> Column:
    """Similarity ladder of names; the last rungs are word overlap and edit distance over byte length."""
    q, n = name_parts(query), name_parts(name)
    overlap, most = F.size(F.array_intersect(q, n)), F.greatest(F.size(F.array_distinct(q)), F.size(F.array_distinct(n)))
    longest = F.greatest(F.octet_length(query), F.octet_length(name))
    return (
        F.when(query == name, 1.0)
        .when((F.length(query) >= 2) & F.lower(name).startswith(F.lower(query)) & (F.lower(name) != F.lower(query)), 0.92)
        .when(F.lower(query) == F.lower(name), 0.9)
        .when(snake(query) == snake(name), 0.85)
        .when(overlap > 0, 0.5 + 0.25 * overlap / most)
        .when(longest == 0, 0.0)
        .otherwise(0.7 * (1 - F.levenshtein(F.lower(query), F.lower(name)) / longest))
    )


def confidence(value: Column) -> Column:
    """Clamped to [0, 1]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def confidence_label(value: Column) -> Column:
    return F.when(value >= 0.9, "exact").when(value >= 0.6, "high").when(value >= 0.3, "medium").otherwise("inferred")


def semantic_band(value: Column) -> Column:
    return F.when(value >= 0.95, "certain").when(value >= 0.75, "high").when(value >= 0.5, "medium").otherwise("low")


def trace_decay(depth: Column, truncated: Column) -> Column:
    """Confidence of a trace of a depth, less where it was cut short."""
    base = F.greatest(F.lit(0.3), 1 - 0.033 * depth)
    return F.when(depth == 0, 1.0).otherwise(F.when(truncated, F.greatest(F.lit(0.1), base - 0.2)).otherwise(base))


def edge_weight(kind: Column, conf: Column, provenance: Column, path: Column, qualified_name: Column) -> Column:
    """Cost of a hop to the node with ``path`` and ``qualified_name``; at least 1."""
    low = F.lower(qualified_name)
    return F.greatest(
        F.lit(1.0),
        1.0
        + F.when(kind.isin("implements", "instantiates", "registers_callback"), 1.0).otherwise(0.0)
        + (1 - conf) / 2
        + F.when(provenance.isin("heuristic", "callback_pattern"), 0.3).otherwise(0.0)
        + F.when(is_test_path(path), 0.5).otherwise(0.0)
        + F.when(any_of([low.contains(w) for w in PROXY_WORDS]), 0.5).otherwise(0.0),
    )


def canonical_place(place: Column) -> Column:
    """Field path with ``->`` as ``.`` and without white space."""
    return F.regexp_replace(F.regexp_replace(place, "->", "."), r"\s+", "")


def normal_path(base: Column, relative: Column) -> Column:
    """``relative`` joined to folder ``base`` with ``.`` and ``..`` resolved; ``..`` above the root is dropped."""
    joined = F.replace(F.concat_ws("/", base, relative), F.lit("\\"), F.lit("/"))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step), "/")


def visible_across_files(language: Column, visibility: Column, exported: Column, static: Column) -> Column:
    """Whether another file may bind to a symbol of a language; other languages are permissive."""
    return (
        F.when(language.isin("c", "cpp"), ~F.coalesce(static, F.lit(False)))
        .when(language == "rust", ~F.coalesce(visibility, F.lit("")).isin("private"))
        .when(language.isin("typescript", "go"), F.coalesce(exported, F.lit(False)))
        .otherwise(F.lit(True))
    )


def rule_matches(pattern_kind: Column, pattern: Column, name: Column) -> Column:
    """Exact, prefix, suffix, method, glob or regex rule; only ``*`` and ``?`` are special in a glob."""
    as_regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"([.+^$(){}|\[\]\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    return (
        F.when(pattern_kind == "prefix", name.startswith(pattern))
        .when(pattern_kind == "suffix", name.endswith(pattern))
        .when(pattern_kind == "method", F.substring_index(name, ".", -1) == pattern)
        .when(pattern_kind == "glob", F.regexp_like(name, as_regex))
        .when(pattern_kind == "regex", F.regexp_like(name, pattern))
        .otherwise(name == pattern)
    )

"""Line-first quality rules in DataFrame functions only.

Punctuation, navigation and boilerplate rules judge each line (a line neither
ends in a mark nor has a sentence end, holds many symbols or shouts, or is a menu
or boilerplate); failing lines are removed, then documents that lost too much of
their words are rejected.  All of
it is one projection: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import WORD, read_table

#: Patterns and word lists that Java's and DuckDB's engines read alike.
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
TERMINAL = ".!?…:;,)]\"'»”’。！？"
SENTENCE_END = r"[.!?…。！？][\x20\x09-\x0D]"
SHOUTS = r"[!?]{2,}"
SHOUT_PAIRS = ("!!", "!?", "?!", "??")
SEPARATORS = r"\x20(\||»|›|>|•|·|::)\x20"
SEPARATOR_MARKS = (" | ", " » ", " › ", " > ", " • ", " · ", " :: ")
MENU = r"(?i)^[\x20\x09-\x0D]*(home|menu|log ?in|sign ?in|sign ?up|log ?out|next|previous|back to top|skip to [a-z ]+|share( on [a-z]+)?|read more|click here[a-z ]*)[^a-z0-9]*$"
BOILERPLATE = ("all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "copyright ©", "copyright (c)", "subscribe to our newsletter", "enable javascript")

#: Production parameters: marks per word of a line, separators per word, share of words a document may lose.
MAX_SYMBOLS, MAX_SHOUTS, MAX_SEPARATORS, MAX_LOST = 0.1, 0.3, 0.25, 0.3
#: Bits of a window's place in its packed sort key.
_PLACE = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def _words(text: Column) -> Column:
    """Words of a text; the plain split serves texts whose only white space is spaces and line ends."""
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ", -1)
    return F.array_remove(F.when(_any(text, ("\t", "\x0b", "\x0c", "\r")), F.split(text, r"[\x20\x09-\x0D]+", -1)).otherwise(plain), "")


def _covered(places: Column) -> Column:
    """Words in the 3-word windows that start at the sorted, distinct ``places``."""

    def gap(p: Column, k: Column) -> Column:
        return F.coalesce(F.least(F.lit(3), F.get(places, k + 1) - p), F.lit(3))

    return F.aggregate(F.transform(places, gap), F.lit(0).cast("long"), lambda a, x: a + x)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Texts whose window hashes are all distinct have none.  Else sort keys of 40
    hash bits and the window's place bring equal windows together, and neighbours
    compare word by word; where two different windows share a key's hash bits, or
    places need more bits, the windows themselves are sorted instead.
    """
    n = F.size(words) - 2
    starts = F.sequence(F.lit(0), F.size(words) - 3)

    def same(i: Column, j: Column) -> Column:
        return functools.reduce(lambda a, b: a & b, [F.get(words, i + k) == F.get(words, j + k) for k in range(3)])

    def place(key: Column) -> Column:
        return key.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")

    def by_text() -> Column:
        windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = lambda k: (F.get(s, k)["w"] == F.get(s, k - 1)["w"]) | (F.get(s, k)["w"] == F.get(s, k + 1)["w"])
            repeated = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(again(k), F.lit(False)))
            return F.sort_array(F.transform(repeated, lambda k: F.get(s, k)["i"]))

        return let(let(windows, places), _covered)

    def by_key(keys: Column) -> Column:
        near = F.filter(F.sequence(F.lit(0), F.size(keys) - 2), lambda k: F.shiftright(F.get(keys, k), _PLACE) == F.shiftright(F.get(keys, k + 1), _PLACE))
        pairs = F.transform(near, lambda k: F.struct(place(F.get(keys, k)).alias("i"), place(F.get(keys, k + 1)).alias("j")))

        def counted(p: Column) -> Column:
            both = F.sort_array(F.array_distinct(F.concat(p["i"], p["j"])))
            return F.when(F.exists(p, lambda x: ~same(x["i"], x["j"])), by_text()).otherwise(let(both, _covered))

        return let(pairs, counted)

    def of_hashes(h: Column) -> Column:
        keys = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, _PLACE).bitwiseOR(i.cast("long"))))
        return F.when(F.size(F.array_distinct(h)) == n, F.lit(0).cast("long")).when(n >= 1 << _PLACE, by_text()).otherwise(let(keys, by_key))

    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK)) != ""


def _over(line: Column, pattern: str, share: float) -> Column:
    """Whether ``pattern`` occurs in ``line`` more than ``share`` times a word; words are counted only if it occurs."""
    n = F.regexp_count(line, F.lit(pattern))
    return (n > 0) & (n > share * F.regexp_count(line, F.lit(WORD)))


def _of_words(text: Column, words: Column) -> Column:
    # whether the text has any such mark at all is asked once, so clean lines pay for few patterns
    marks = F.struct(
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _any(text, SHOUT_PAIRS).alias("shouts"),
        _any(text, SEPARATOR_MARKS).alias("separators"),
        _any(F.lower(text), BOILERPLATE).alias("boilerplate"),
        F.split(text, "\n", -1).alias("lines"),
    )

    def measured(m: Column) -> Column:
        def wrong(line: Column) -> Column:
            return (
                ((F.instr(F.lit(TERMINAL), F.right(F.rtrim(line, F.lit(BLANK)), F.lit(1))) == 0) & ~line.rlike(SENTENCE_END))
                | ((m["n_symbols"] > 0) & _over(line, SYMBOLS, MAX_SYMBOLS))
                | (m["shouts"] & _over(line, SHOUTS, MAX_SHOUTS))
                | (m["separators"] & _over(line, SEPARATORS, MAX_SEPARATORS))
                | ((F.length(line) <= 60) & line.rlike(MENU))
                | (m["boilerplate"] & _any(F.lower(line), BOILERPLATE))
            )

        kept_lines = F.filter(m["lines"], lambda x: ~_has_word(x) | ~wrong(x))
        worded = F.filter(m["lines"], _has_word)
        n_words = F.size(words).cast("long")

        def cleaned(lines: Column) -> Column:
            whole = F.struct(text.alias("text"), n_words.alias("n_words"))
            shorter = let(F.array_join(lines, "\n"), lambda x: F.struct(x.alias("text"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("n_words")))
            return F.when(F.size(lines) == F.size(m["lines"]), whole).otherwise(shorter)

        return F.struct(
            n_words.alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            m["n_symbols"].alias("n_symbols"),
            let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            let(kept_lines, cleaned).alias("cleaned"),
        )

    return let(marks, measured)


def judged(text: Column) -> Column:
    """Struct of a text's measures, cleaned text and verdict; a null text has no words and is rejected."""
    whole = F.coalesce(text, F.lit(""))
    measures = let(whole, lambda t: let(_words(t), lambda w: _of_words(t, w)))

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        lost = m["n_words"] - m["cleaned"]["n_words"]
        return F.struct(
            *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            failed.alias("base_failed"),
            (~failed & (lost <= MAX_LOST * m["n_words"])).alias("kept"),
            m["cleaned"]["text"].alias("cleaned_text"),
            lost.alias("n_lost_words"),
        )

    return let(measures, verdict)


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measures, ``base_failed``, ``kept``, ``cleaned_text``, ``n_lost_words``.

    A null or empty text has zero measures and fails; null ids and repeated rows
    are kept; other columns are not read; an empty table gives no rows.
    """
    return docs.select(F.col(f"`{id_col}`"), judged(F.col(f"`{text_col}`")).alias("q")).select(F.col(f"`{id_col}`"), "q.*")


def apply_rules(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """Rows of kept documents with the failing lines of ``text_col`` removed; all columns stay.

    ``size_col``, where there is such a column, is set to the cleaned length if the
    text changed.  Null and empty texts are rejected.
    """
    mark = "__weft_rules"
    while mark in docs.columns:
        mark += "_"
    # a generator, not a filter: a filter would be pushed down and judge every text twice
    out = docs.withColumn(mark, F.explode(F.filter(F.array(judged(F.col(f"`{text_col}`"))), lambda q: q["kept"])))
    cleaned = F.col(mark)["cleaned_text"]
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(cleaned.alias(c))
        elif c == size_col:
            kind = docs.schema[c].dataType
            columns.append(F.when(cleaned == F.col(f"`{text_col}`"), F.col(f"`{c}`")).otherwise(F.length(cleaned).cast(kind)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_over(pattern: str, share: float) -> str:
    n = f"len(regexp_extract_all(l, {_text(pattern)}))"
    return f"({n} > 0 AND {n} > {share} * n)"


_BLANK_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w, string_split(t, chr(10)) AS lines FROM d),
pos AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM pos),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) x GROUP BY r),
ln AS (SELECT r, l, len(regexp_extract_all(l, '{WORD}')) AS n FROM (SELECT r, unnest(lines) AS l FROM w) x),
ok AS (SELECT r, l, n, n > 0 AND ((strpos({_text(TERMINAL)}, right(rtrim(l, {_BLANK_SQL}), 1)) = 0 AND NOT regexp_matches(l, {_text(SENTENCE_END)}))
  OR {_sql_over(SYMBOLS, MAX_SYMBOLS)} OR {_sql_over(SHOUTS, MAX_SHOUTS)} OR {_sql_over(SEPARATORS, MAX_SEPARATORS)}
  OR (length(l) <= 60 AND regexp_matches(l, {_text(MENU)})) OR {" OR ".join(f"contains(lower(l), {_text(b)})" for b in BOILERPLATE)}) AS wrong FROM ln),
lost AS (SELECT r, sum(n) FILTER (WHERE wrong) AS n, count(*) FILTER (WHERE n > 0) - count(DISTINCT l) FILTER (WHERE n > 0) AS dups FROM ok GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, {_text(SYMBOLS)})) AS BIGINT) AS n_symbols, CAST(lost.dups AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost.n, 0) AS n_lost
  FROM w LEFT JOIN rep USING (r) JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost <= {MAX_LOST} * n_words AS kept FROM m
"""

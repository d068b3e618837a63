"""Operator 9: quality rules from a threshold table, compiled into one Spark projection.

Every figure is made from built-in expressions, so that there is neither a shuffle nor Python. A text's words are
bound once (``let``) and shared by the figures that need them. The rule of stop words knows four languages, so that it judges
only texts in these, by ``lang``, and texts whose ``lang`` is null or not among the columns.

Defined results: a null or empty text has 0 for each figure and fails (fewer than 10 words); ratios over zero words
or lines are 0; repeated rows are judged each for itself; further columns of the input are ignored by the query and
kept by ``quality_filter``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RUN, let, table

SYMBOLS = "#*$%&|<>"
#: Function words of the four languages, without those that are too short to tell anything.
STOP_WORDS = tuple(
    "the and of to in is that it on for by with as are be this an or not from at was "
    "la le de et les des un une que qui en dans pour par sur pas du au est "
    "der die und das von zu den mit ist ein eine auf für nicht im dem sich "
    "el los las y con para una se del al lo como es su no".split()
)


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= ratio <= high``; texts with fewer than ``least_words`` words, or in other languages than ``langs``, pass in any case."""

    name: str
    ratio: str
    low: float = 0.0
    high: float = float("inf")
    least_words: int = 0
    langs: tuple[str, ...] = ()


#: The languages of STOP_WORDS.
LANGS = ("en", "fr", "de", "es")
#: ratio: SQL over the columns that ``figures`` returns.
RULES = (
    Rule("mean word length", "word_chars / n_words", 2.0, 14.0, 20),
    Rule("symbols to words", "n_symbols / n_words", high=0.2),
    Rule("shouting to words", "n_bangs / n_words", high=0.5, least_words=20),
    Rule("stop words to words", "n_stop_words / n_words", low=0.05, least_words=30, langs=LANGS),
    Rule("equal lines to lines", "n_dup_lines / n_lines", high=0.5),
)


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside a window of ``window`` words which the text holds twice or more.

    Windows are told apart by a 64-bit hash over their words. Only texts with a repeated hash pay for the sort
    that brings equal windows together; it is of n log n, however often a window comes back.
    """

    def covered(hashes: Column) -> Column:
        def flagged(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, lambda s: let(flagged(s), total)))

    def grown(single: Column, hashes: Column, size: int) -> Column:
        """A hash for each window, from ``hashes`` of ``size`` words: two neighbours make one of twice the size, or a word is added. No word is hashed twice."""
        if size == window:
            return covered(hashes)
        after, step = (hashes, size) if 2 * size <= window else (single, 1)
        n = F.size(single) - (size + step) + 1
        joined = F.transform(F.slice(hashes, 1, n), lambda h, k: F.xxhash64(h, F.get(after, k + size)))
        return let(joined, lambda h: grown(single, h, size + step))

    singles = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(let(singles, lambda single: grown(single, single, 1)))


def figures(text: Column) -> Column:
    """A struct of whole numbers: what the rules of the table and the base rules are made of."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE_RUN, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        _repeat_words(w, 5).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: plain(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    of_lines = lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
    )
    return F.struct(
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        _count_of(text, "!").cast("long").alias("n_bangs"),
        let(words, of_words).alias("of_words"),
        let(lines, of_lines).alias("of_lines"),
    )


FLAT = {"word_chars": "word_chars", "n_symbols": "n_symbols", "n_bangs": "n_bangs", "n_words": "of_words.n_words", "n_repeat_words": "of_words.n_repeat_words", "n_stop_words": "of_words.n_stop_words", "n_lines": "of_lines.n_lines", "n_dup_lines": "of_lines.n_dup_lines"}


def compiled(rules: tuple[Rule, ...] = RULES) -> str:
    """The table as one SQL predicate, true for texts to keep."""
    one = []
    for r in rules:
        top, _, below = r.ratio.partition(" / ")
        value = f"coalesce(try_divide({top}, {below}), 0)"
        bounds = [f"{value} >= {r.low}D"] * (r.low > 0) + [f"{value} <= {r.high}D"] * (r.high != float("inf"))
        names = ", ".join(f"'{x}'" for x in r.langs)
        other = f" OR coalesce(lang NOT IN ({names}), false)" if names else ""
        one.append(f"(n_words < {r.least_words}{other} OR ({' AND '.join(bounds)}))")
    return " AND ".join(one)


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def _lang(docs: DataFrame) -> Column:
    return (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the figures, base_failed, kept: one row for each row of ``docs``."""
    flat = docs.select("doc_id", _lang(docs), figures(F.col("text")).alias("f")).select("doc_id", "lang", *(F.col(f"f.{at}").alias(name) for name, at in FLAT.items()))
    judged = flat.withColumn("base_failed", F.expr(BASE_FAILED))
    return judged.withColumn("kept", ~F.col("base_failed") & F.expr(compiled(rules))).drop("lang")


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), _lang(docs), figures(F.col("text")).alias("_f"))
    flat = packed.select("_row", "lang", *(F.col(f"_f.{at}").alias(name) for name, at in FLAT.items()))
    return flat.filter(f"NOT ({BASE_FAILED}) AND {compiled(rules)}").select(*(F.col("_row").getField(c).alias(c) for c in names))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_W = r"[^\x20\x09-\x0D]"
ORACLE = rf"""
WITH w AS (
  SELECT doc_id, lang, row_number() OVER () AS k, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines
  FROM documents),
g AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, words[i], words[i+1], words[i+2], words[i+3], words[i+4]) AS n
  FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
r AS (
  SELECT k, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT k, unnest(range(i, i + 5)) AS j FROM g WHERE n >= 2) GROUP BY k),
f AS (
  SELECT doc_id, lang, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '!')) AS n_bangs,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_STOP}))) AS n_stop_words
  FROM w LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed
       AND (n_words < 20 OR word_chars / n_words BETWEEN 2 AND 14)
       AND n_symbols / n_words <= 0.2
       AND (n_words < 20 OR n_bangs / n_words <= 0.5)
       AND (n_words < 30 OR coalesce(lang NOT IN ('en', 'fr', 'de', 'es'), false) OR n_stop_words / n_words >= 0.05)
       AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AS kept
FROM b
"""

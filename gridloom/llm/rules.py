"""Operator 9, quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a Spark expression of the whole text, and every rule is a row
``(name, measure, low, high)``; ``compile_rules`` turns the table into one
projection without user functions.

Defined cases: a null or empty text has no words, and every measure of it is 0
(ratios with a zero denominator are 0); ties and repeated rows are judged row by
row; extra columns are neither read nor returned; an empty table gives an empty
result; texts are measured whole.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

WINDOW = 8  # a power of two
WORD = r"[^\x20\x09-\x0D]"
UPPER = "A-ZÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÑÁÍÓÚ"
MARKS = ".,;:!?"


class Rule(NamedTuple):
    """A text passes if low <= measure <= high."""

    name: str
    measure: str
    low: float
    high: float


#: The function words of the languages the corpus is written in; a text of running prose has some of one language.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "by", "at", "this", "or", "from", "an", "a"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "avec"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para", "es", "al", "lo"),
}
ALL_STOP_WORDS = sorted({w for ws in STOP_WORDS.values() for w in ws})

RULES = (
    Rule("length", "n_words", 20, float("inf")),
    Rule("repeats", "repeat_ratio", 0, 0.30),
    Rule("word_length", "mean_word_chars", 2, 12),
    Rule("symbols", "symbol_ratio", 0, 0.10),
    Rule("shouting", "mark_ratio", 0, 0.50),
    Rule("upper", "upper_ratio", 0, 0.50),
    Rule("digits", "digit_ratio", 0, 0.30),
    Rule("stop_words", "stop_ratio", 0.02, 1.0),
    Rule("lines", "dup_line_ratio", 0, 0.30),
    Rule("distinct", "next_word_ratio", 0, 0.20),
)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a regex class the text has."""
    return (F.size(F.split(text, f"[{chars}]", -1)) - 1).cast("long")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and every measure of the text.

    Windows of WINDOW words are compared by a 64-bit hash of their words' hashes.
    Only texts that have a repeat sort their windows: equal ones are then
    neighbours, and a word counts for the first window that covers it.
    """
    out = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = out.withColumn("words", F.array_remove(F.split("text", SPACE + "+"), ""))
    out = out.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    out = out.withColumn("__h", F.transform("words", lambda w: F.xxhash64(w)))
    # hashes of 2, 4 and 8 words from here on, each from two of half the length; lambdas name no outer column, which could be inlined and evaluated per element
    for half, (new, old) in ((1, ("__h2", "__h")), (2, ("__h4", "__h2")), (4, ("__h8", "__h4"))):
        out = out.withColumn(new, F.zip_with(old, F.slice(old, half + 1, F.size(old)), lambda x, y: F.xxhash64(x, y)))
    out = out.withColumn("__w", F.slice("__h8", 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))))
    # (hash, position) sorted: a window repeats if a neighbour has its hash
    pairs = "array_sort(transform(__w, (h, i) -> struct(h, i)))"
    out = out.withColumn("__s", F.expr(f"CASE WHEN size(array_distinct(__w)) < size(__w) THEN {pairs} END"))
    again = "(i > 0 AND __s[i - 1].h = p.h) OR (i + 1 < size(__s) AND __s[i + 1].h = p.h)"
    out = out.withColumn("__r", F.expr(f"array_sort(transform(filter(__s, (p, i) -> {again}), p -> p.i))"))
    covered = f"aggregate(__r, struct(0L AS n, 0 AS till), (a, i) -> struct(a.n + (i + {WINDOW} - greatest(i, a.till)) AS n, i + {WINDOW} AS till), a -> a.n)"
    size = F.size("words").cast("long")
    return out.select(
        "id",
        size.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), "#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        count_of(F.col("text"), "!?").alias("n_marks"),
        count_of(F.col("text"), UPPER).alias("n_upper"),
        count_of(F.col("text"), "0-9").alias("n_digits"),
        F.size(F.filter("words", lambda w: F.lower(F.rtrim(w, F.lit(MARKS))).isin(ALL_STOP_WORDS))).cast("long").alias("n_stop"),
        F.size(F.filter(F.zip_with("__h", F.slice("__h", 2, F.size("__h")), lambda x, y: x == y), lambda x: x)).cast("long").alias("n_next_same"),
    )


def with_ratios(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "repeat_ratio": ratio(c("n_repeat_words"), c("n_words")),
        "mean_word_chars": ratio(c("word_chars"), c("n_words")),
        "symbol_ratio": ratio(c("n_symbols"), c("word_chars")),
        "mark_ratio": ratio(c("n_marks"), c("n_words")),
        "upper_ratio": ratio(c("n_upper"), c("word_chars")),
        "digit_ratio": ratio(c("n_digits"), c("word_chars")),
        "stop_ratio": ratio(c("n_stop"), c("n_words")),
        "dup_line_ratio": ratio(c("n_dup_lines"), c("n_lines")),
        "next_word_ratio": ratio(c("n_next_same"), c("n_words")),
    })


def passes(rule: Rule) -> Column:
    c = F.col(rule.measure)
    low = F.lit(True) if rule.low == float("-inf") else c >= rule.low
    return low if rule.high == float("inf") else low & (c <= rule.high)


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base measures, base_failed, kept, and the names of the rules that fail, in the table's order."""
    c = F.col
    out = with_ratios(measured(df, id_col, text_col))
    failed = (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))
    why = F.filter(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.size(why) == 0)).alias("kept"), why.alias("failed_rules"))

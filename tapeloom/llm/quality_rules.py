"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Everything is computed inside the row with built-in functions, so a document
never leaves its task and nothing is shuffled.  A null or empty text has no
words: all figures are zero, ``base_failed`` is true and ``kept`` false.
Further columns of the input pass through ``with_quality``; one with the name of a figure or of a verdict
is called ``<name>_in``.  Repeated rows get equal figures each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.util import WORD_GAP, aside

#: Function words of the corpus languages; a text of any length in one of them uses several.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "that", "is", "was", "with", "for", "on", "this", "are", "as", "an", "at", "be"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "von", "mit", "für", "ist", "als", "dem", "auf", "ein", "eine"],
    "fr": ["le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "que", "pour", "est", "dans", "par", "sur", "ou", "au"],
    "es": ["el", "la", "los", "las", "de", "y", "que", "en", "un", "una", "del", "con", "por", "para", "al", "se", "no", "su"],
}


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; an open side is None.  ``metric`` names a figure of ``METRICS``."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The production table.  Ratios are per word, per line or per character as the metric says.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", "mean_word_length", 2.0, 14.0),
    Rule("symbols_per_word", "symbols_per_word", None, 0.10),
    Rule("stop_word_ratio", "stop_word_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.30),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.30),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.90),
    Rule("alphabetic_words", "alpha_word_ratio", 0.70, None),
    Rule("shouting", "upper_ratio", None, 0.60),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def _repeat_words() -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are sorted as (hash, words, position) so equal ones are adjacent whatever the hash does;
    positions of repeated windows are sorted and the union of [p, p + 3) is summed.
    """
    return F.expr(
        """
        aggregate(
          transform(_quality_rep, (p, i) -> if(i = 0, 3, least(3, p - _quality_rep[i - 1]))),
          0L, (acc, x) -> acc + x)
        """
    )


def _pieces(df: DataFrame, text: str) -> DataFrame:
    """The arrays that several metrics share, each made once."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_quality_w", _words(t)).withColumn("_quality_j", F.array_join("_quality_w", "")).withColumn("_quality_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn(
        "_quality_g",
        F.expr(
            """
            if(size(_quality_w) < 3, array(),
               sort_array(transform(sequence(0, size(_quality_w) - 3), i ->
                 named_struct('h', xxhash64(_quality_w[i], _quality_w[i + 1], _quality_w[i + 2]), 'a', _quality_w[i], 'b', _quality_w[i + 1], 'c', _quality_w[i + 2], 'p', i))))
            """
        ),
    )
    same = "x.h = get(_quality_g, {o}).h and x.a = get(_quality_g, {o}).a and x.b = get(_quality_g, {o}).b and x.c = get(_quality_g, {o}).c"
    return df.withColumn(
        "_quality_rep",
        F.expr(
            f"""
            sort_array(transform(filter(transform(_quality_g, (x, i) ->
                if(coalesce({same.format(o="i - 1")}, false) or coalesce({same.format(o="i + 1")}, false), x.p, -1)),
              p -> p >= 0), p -> p))
            """
        ),
    )


def metrics(text: str = "text") -> dict[str, Column]:
    """The base figures and ratios over the arrays of ``_pieces``."""
    t = F.coalesce(F.col(text), F.lit(""))
    n_words = F.size("_quality_w").cast("long")
    n_lines = F.greatest(F.size("_quality_l"), F.lit(1))
    per_word = lambda x: x / F.greatest(n_words, F.lit(1))
    joined = F.col("_quality_j")
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    letters = F.length(F.regexp_replace(joined, r"\P{L}+", ""))
    return {
        "n_words": n_words,
        "word_chars": F.length(joined).cast("long"),
        "n_symbols": (F.octet_length(t) - F.octet_length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("_quality_l") - F.size(F.array_distinct("_quality_l"))).cast("long"),
        "n_repeat_words": _repeat_words(),
        "mean_word_length": per_word(F.length(joined)),
        "symbols_per_word": per_word(F.octet_length(t) - F.octet_length(F.regexp_replace(t, r"[#*$%&|<>]", ""))),
        "stop_word_ratio": per_word(F.size(F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: w.isin(stop)))),
        "dup_line_ratio": (F.size("_quality_l") - F.size(F.array_distinct("_quality_l"))) / n_lines,
        "ellipsis_line_ratio": F.size(F.filter("_quality_l", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))) / n_lines,
        "bullet_line_ratio": F.size(F.filter("_quality_l", lambda x: x.rlike(r"^\s*[-*•‣]"))) / n_lines,
        # From the first letter of a word to its end: one match a word with a letter.
        "alpha_word_ratio": per_word(F.regexp_count(t, F.lit(r"\p{L}[^\x20\x09-\x0D]*"))),
        "upper_ratio": F.length(F.regexp_replace(joined, r"\P{Lu}+", "")) / F.greatest(letters, F.lit(1)),
    }


def compile_rules(rules: Sequence[Rule]) -> Column:
    """One boolean expression over the metric columns."""
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (F.col(r.metric) >= r.low)
        if r.high is not None:
            ok = ok & (F.col(r.metric) <= r.high)
    return ok


def with_quality(df: DataFrame, text: str = "text", rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """``df`` with every figure, ``base_failed``, ``failed_rules`` and ``kept``."""
    source = df.select(F.struct("*").alias("_quality_row"), F.col(text).cast("string").alias("_quality_text"))
    made = metrics("_quality_text")
    out = _pieces(source, "_quality_text").withColumns(made).drop("_quality_w", "_quality_j", "_quality_l", "_quality_g", "_quality_rep")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = [
        F.when(~F.coalesce(compile_rules([r]), F.lit(False)), F.lit(r.name)) for r in rules
    ]
    verdicts = {
        "base_failed": base,
        "failed_rules": F.array_compact(F.array(*names)) if names else F.array().cast("array<string>"),
        "kept": ~base & compile_rules(rules),
    }
    own = aside(df, [*made, *verdicts]).columns
    given = [F.col("_quality_row").getField(c).alias(n) for c, n in zip(df.columns, own)]
    return out.select(*given, *made, *[x.alias(n) for n, x in verdicts.items()])

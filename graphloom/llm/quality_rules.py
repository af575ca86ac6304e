"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

`measures` adds one column per statistic, built from SQL functions and higher-order array functions;
`compile_rules` turns the table of thresholds into a single projection of booleans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORD_RE, without_characters, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "it", "that", "for", "as", "with", "on", "are", "be", "this", "was", "by", "from", "or", "an", "a", "at",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "dans", "en", "sur", "par", "pour", "au", "avec",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "ist", "auf", "für", "nicht", "ein", "eine", "dem",
    "el", "los", "las", "y", "se", "del", "por", "con", "su", "para", "al", "es", "lo", "como",
)


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= statistic <= high; a null statistic passes."""

    name: str
    statistic: str
    low: float | None = None
    high: float | None = None


#: The threshold table.  Ratios are per word or per line with a word.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.25),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.3),
    Rule("bullet_lines", "bullet_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_ratio", None, 0.3),
)


def _hashes(of: str, step: int) -> Column:
    """Hashes of runs of 2 * step words from those of runs of `step` words."""
    return F.transform(of, lambda h, i: F.xxhash64(h, F.get(of, i + step)))


def _with_repeat_words(d: DataFrame) -> DataFrame:
    """Add n_repeat_words: words covered by runs of eight words that occur twice or more, each word once.

    Runs are hashed by doubling (1, 2, 4, 8 words), each step a column of its own so that its two uses
    read one evaluation; without a repeated run of four words there is none of eight."""
    d = d.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    d = d.withColumn("h2", _hashes("h1", 1)).drop("h1")
    d = d.withColumn("h4", _hashes("h2", 2)).drop("h2")
    d = d.withColumn("h8", F.when(F.size(F.array_distinct("h4")) < F.size("h4"), _hashes("h4", 4))).drop("h4")
    # The last seven hashes stand for shorter runs.
    d = d.withColumn("windows", F.slice("h8", 1, F.greatest(F.size("h8") - (WINDOW - 1), F.lit(0)))).drop("h8")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("pairs", F.when(repeats, pairs)).drop("windows")
    twins = F.zip_with("pairs", F.slice("pairs", 2, F.size("pairs")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    d = d.withColumn("starts", F.sort_array(F.array_distinct(F.flatten(F.array_compact(twins))))).drop("pairs")
    fold = F.aggregate(
        "starts",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("covered")),
        lambda acc, i: F.struct(i.alias("last"), (acc["covered"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("covered")),
        lambda acc: acc["covered"],
    )
    return d.withColumn("n_repeat_words", F.coalesce(fold, F.lit(0).cast("long"))).drop("starts")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one column per statistic of the whole text.

    A null or blank text has no words: counts are 0 and ratios null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("body"))
    d = d.withColumns({"words": words_of(F.col("body")), "lines": F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD_RE))})
    d = d.withColumn("n_words", F.size("words").cast("long"))
    n = F.col("n_words")
    d = d.withColumns(
        {
            "word_chars": F.length(without_characters(F.col("body"), WHITE)).cast("long"),
            "n_symbols": F.regexp_count("body", F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_stop": F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)))),
            "n_bullet": F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))),
            "n_ellipsis": F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
        }
    )
    d = _with_repeat_words(d.drop("lines", "body"))
    per_word = lambda c: F.when(n > 0, F.col(c) / n)
    per_line = lambda c: F.when(F.col("n_lines") > 0, F.col(c) / F.col("n_lines"))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per_word("word_chars").alias("mean_word_chars"), per_word("n_symbols").alias("symbol_ratio"), per_word("n_stop").alias("stop_ratio"),
        per_line("n_dup_lines").alias("dup_line_ratio"), per_line("n_bullet").alias("bullet_ratio"), per_line("n_ellipsis").alias("ellipsis_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(all rules pass, array of the names of failed rules)."""
    passed = {}
    for r in rules:
        c = F.col(r.statistic)
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (c >= r.low)
        if r.high is not None:
            ok = ok & (c <= r.high)
        passed[r.name] = F.coalesce(ok, F.lit(True))
    verdict = F.lit(True)
    for ok in passed.values():
        verdict = verdict & ok
    return verdict, F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in passed.items()]))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts, base_failed, kept, failed_rules.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated windows of eight words.
    Null and blank texts fail the base; repeated rows are judged alike; an empty table gives an empty
    result; columns other than the two named are ignored.
    """
    m = measures(docs, id_col, text_col)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdict, failed = compile_rules(rules)
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & verdict).alias("kept"), failed.alias("failed_rules"))

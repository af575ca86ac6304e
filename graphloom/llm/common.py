"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import new_path, written  # noqa: F401

#: White space is the six characters space, tab, LF, VT, FF and CR; a word is a run of anything else.
WHITE = " \t\n\u000b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"


def keep_matching(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi", bound: int = 500_000) -> DataFrame:
    """Semi or anti join: keys are broadcast when a count shows at most `bound` of them, else both sides shuffle."""
    few = keys.limit(bound + 1).count() <= bound
    return df.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), on, how)


def join_counted(df: DataFrame, keys: DataFrame, on: str, size: str, how: str = "inner", bound: int = 200_000, share: int = 1000) -> DataFrame:
    """Inner or left join with a written table of one row per key; `size` tells how many rows of df a key has.

    Few keys are broadcast.  Of many, those that hold at least 1/share of the counted rows - so at most
    `share` keys - are broadcast, and only the rows of the others are dealt out by key."""
    n, total = keys.agg(F.count("*"), F.sum(size)).first()
    if n <= bound:
        return df.join(F.broadcast(keys), on, how)
    large = F.col(size) * share >= F.lit(total)
    hot = keys.where(large)
    if not hot.limit(1).count():
        return df.join(keys, on, how)
    rest = df.join(F.broadcast(hot.select(on)), on, "left_anti").join(keys.where(~large), on, how)
    return df.join(F.broadcast(hot), on).unionByName(rest)


def repeated(df: DataFrame, copies: str, step: int = 10_000) -> DataFrame:
    """Each row `copies` times, with the number of the copy (from 0) in place of the count; no long array is built."""
    first, inner = fresh(df.columns, "first"), fresh(df.columns, "inner")
    spread = df.withColumn(first, F.explode(F.sequence(F.lit(0), F.col(copies) - 1, F.lit(step))))
    spread = spread.withColumn(inner, F.explode(F.sequence(F.lit(0), F.least(F.lit(step), F.col(copies) - F.col(first)) - 1)))
    return spread.withColumn(copies, F.col(first) + F.col(inner)).drop(first, inner)


def fresh(columns: list[str], name: str) -> str:
    """A column name like `name` that none of the columns has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_white(text: Column) -> Column:
    """Text without the six white-space characters (null: empty)."""
    return without_characters(F.coalesce(text, F.lit("")), WHITE)


def words_of(text: Column) -> Column:
    """Array of the words of a text (null: empty array)."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE[1:]:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(out, " "), "")


def without_characters(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder by 5 (null id: crc32 of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0

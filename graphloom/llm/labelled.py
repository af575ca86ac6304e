"""Bounded samples of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, written

#: Code points of the sampled texts together.
MAX_CHARS = 24_000_000


def bounded_labels(labels: DataFrame, label_col: str, max_labelled: int, train_only: bool = True) -> DataFrame:
    """At most max_labelled rows (ticket, doc_id, label): the smallest md5 (ticket) of the id among usable labels.

    Null ids and labels are left out; of several labels of one id the largest counts."""
    rows = labels.select("doc_id", F.col(label_col).cast("double").alias("label")).na.drop("any")
    if train_only:
        rows = rows.where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("ticket"), "doc_id", "label").orderBy("ticket", "doc_id").limit(max_labelled)


def bounded_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_labelled: int, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ticket, label, text) of at most max_labelled whole documents of at most max_chars code points together.

    Documents are taken in the order of their tickets; one that would pass max_chars is left out and the next
    ones are tried, so a very long text costs its own place only.  An id on several rows counts once, with its
    smallest text; a null text counts as empty."""
    few = F.broadcast(bounded_labels(labels, label_col, max_labelled))
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(few, "doc_id")
    found = written(found.groupBy("ticket", "label").agg(F.min("text").alias("text")), "labelled-sample")
    left_out, chars = [], 0
    for ticket, n in found.select("ticket", F.length("text")).orderBy("ticket").collect():  # max_labelled short rows at most
        if chars + n > max_chars:
            left_out.append(ticket)
        else:
            chars += n
    return found.where(~F.col("ticket").isin(left_out)) if left_out else found

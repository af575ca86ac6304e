"""Mixing sources to target weights: capped water-filling, then seeded repetitions of whole documents.

Targets.  Every source i has a size S_i (words) and a weight w_i; the mix shares a budget by weight,
but no source may exceed max_epochs * S_i.  Sorted by S_i / w_i the capped sources form a prefix, and
source k belongs to it exactly when its cap is at most its share of what the prefix before it leaves:
cap_k * (W - W_before) <= w_k * (T - C_before).  One running sum over the table of sources (a row per
source) finds all caps; the rest share what remains by weight.

Repetitions.  A target of e epochs repeats every document floor(e) times.  The fraction is filled with
further repetitions in seeded hash order; the document at the cut gets a fractional one, so that each
source takes its target to the word.  The running sums behind that order are taken in buckets of the
hash, (source, bucket) -> sums -> offsets, so a hot source is spread over the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

BIG = "decimal(38,0)"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) for a table (source, size).

    Sources are ordered by code point, null last, and take the weights in turn.  If the budget exceeds
    all caps together every source gets its cap; a source of size 0 gets 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn).cast(BIG))
    per = per.withColumn("cap", (F.col("source_size") * max_epochs).cast(BIG))
    total = F.floor(F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))) if share != 1.0 else F.sum("source_size").over(Window.partitionBy())
    per = per.withColumns({"budget": total.cast(BIG), "all_weight": F.sum("weight").over(Window.partitionBy()).cast(BIG)})
    # Integer products compare cap/weight exactly: cap * (common multiple / weight).
    multiple = 1
    for w in weights:
        multiple *= int(w)
    filling = Window.orderBy((F.col("cap") * F.expr(f"cast({multiple} as {BIG})") / F.col("weight")).cast("decimal(38,6)"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(BIG), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)).cast(BIG)})
    room, rest = (F.col("budget") - F.col("cap_before")).cast(BIG), (F.col("all_weight") - F.col("weight_before")).cast("double")
    per = per.withColumn("capped", F.col("cap").cast("double") * rest <= F.col("weight").cast("double") * room.cast("double"))
    # What the first source that is not capped sees is what all such sources share.
    everyone = Window.partitionBy()
    left = F.col("budget").cast("double") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everyone), F.lit(0)).cast("double")
    open_weight = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everyone), F.lit(0)).cast("double")
    per = per.withColumns({"left_over": left, "open_weight": open_weight})
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("left_over") * F.col("weight").cast("double") / F.col("open_weight"))
    return per.select("source", "source_size", target.alias("target"))


def _source_key(source: Column) -> Column:
    """A key that joins null sources too."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, repeats, part, taken.

    repeats: whole repetitions; part: words of a fractional one, which at most one document of a source
    has; taken = repeats * size + part, never above max_epochs * size.  A null text has size 0 and takes
    0 words; a null source is a source of its own; a null id hashes as the empty text and comes last on
    a tie.  Repeated rows count each; rows equal in id, source and size are interchangeable.  An empty
    table gives an empty result; columns other than the three named are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    ticket = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    base = base.withColumns({"skey": _source_key(F.col("source")), "ticket": F.substring(ticket, 1, 16), "bucket": F.substring(ticket, 1, 3)})
    base = written(base, "mix-sizes")
    targets = source_targets(base.select("source", "size"), weights, max_epochs, share)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.least(F.floor(epochs), F.lit(max_epochs)).cast("int"))
    targets = targets.withColumn("fraction", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    targets = targets.withColumn("skey", _source_key(F.col("source"))).drop("source")

    sums = base.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset")).join(targets, "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("ticket", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    d = base.join(offsets, ["skey", "bucket"]).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("fraction") - before)))
    full = (F.col("extra") == F.col("size")) & (F.col("size") > 0)
    d = d.withColumns({"repeats": F.col("whole") + full.cast("int"), "part": F.when(full, F.lit(0)).otherwise(F.col("extra")).cast("long")})
    return d.select("doc_id", "source", "size", "source_size", "target", "repeats", "part", (F.col("repeats") * F.col("size") + F.col("part")).cast("long").alias("taken"))

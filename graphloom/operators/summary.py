"""Summaries over samples, folds, epochs and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written
from .detection import pooled_ap_ar
from .ordering import with_position

# Metrics whose best value is the largest; all others are best when smallest.
HIGHER_IS_BETTER = ("node_mAP", "node_mAR", "edge_mAP", "edge_mAR", "node_ap", "node_ar", "edge_ap", "edge_ar")


def fold_id(samples: DataFrame, folds: int = 5) -> DataFrame:
    """Add `fold`: contiguous parts in sample order, the first n mod k one longer; k = min(k, n)."""
    placed = with_position(samples.select("sample_id"), "sample_id")
    k = F.least(F.lit(folds), F.col("total"))
    size, longer = F.floor(F.col("total") / k), F.col("total") % k
    cut = longer * (size + 1)
    fold = F.when(F.col("position") < cut, F.floor(F.col("position") / (size + 1))).otherwise(longer + F.floor((F.col("position") - cut) / size))
    folded = placed.select("sample_id", fold.cast("int").alias("fold"))
    return folded if samples.columns == ["sample_id"] else samples.join(folded, "sample_id")


def to_long(metrics: DataFrame, names: list[str], *more: str) -> DataFrame:
    """(sample_id, more, name, value); NaN and infinite values become null."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    long = metrics.select("sample_id", *more, F.inline(rows))
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    return long.withColumn("value", F.when(finite, F.col("value")))


def summarize(metrics: DataFrame, names: list[str], folds: int = 5) -> DataFrame:
    """(name, samples, mean, std): mean over defined values, std of the fold means (0 with under 2 folds).

    The metrics are written once, for the folds and the means.  No sample at all raises."""
    metrics = written(metrics.select("sample_id", *names), "metrics")
    if not metrics.limit(1).count():
        raise ValueError("an evaluation needs at least one sample")
    long = to_long(metrics.join(fold_id(metrics.select("sample_id"), folds), "sample_id"), names, "fold")
    per_fold = long.groupBy("name", "fold").agg(F.avg("value").alias("fold_mean"), F.sum("value").alias("s"), F.count("value").alias("n"), F.count(F.lit(1)).alias("rows"))
    return per_fold.groupBy("name").agg(F.sum("rows").alias("samples"), (F.sum("s") / F.sum("n")).alias("mean"), F.coalesce(F.stddev_samp("fold_mean"), F.lit(0.0)).alias("std"))


def summarize_detection(hits: DataFrame, counts: DataFrame, folds: int = 5) -> DataFrame:
    """One row (ap, ap_std, ar, ar_std): hits pooled per fold, then mean and std over defined folds.

    hits as in pooled_ap_ar; with `hits` per threshold the folds join before the thresholds multiply rows.
    No sample at all raises."""
    counts = written(counts.select("sample_id", "target_count"), "target-counts")
    if not counts.limit(1).count():
        raise ValueError("an evaluation needs at least one sample")
    f = fold_id(counts.select("sample_id"), folds)
    per = pooled_ap_ar(hits.join(f, "sample_id"), counts.join(f, "sample_id"), "fold")
    std = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return per.agg(F.avg("ap").alias("ap"), std("ap").alias("ap_std"), F.avg("ar").alias("ar"), std("ar").alias("ar_std"))


def epoch_means(run_log: DataFrame) -> DataFrame:
    """(run_id, epoch, name, value): unweighted means."""
    return run_log.groupBy("run_id", "epoch", "name").agg(F.avg("value").alias("value"))


def known_records(records: DataFrame, mode: str) -> DataFrame:
    """(run_id, name, record) of stored bests (run_id, metric, mode, value) of one mode; values that are not finite are none."""
    pick = F.max if mode == "max" else F.min
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    usable = records.where((F.col("mode") == mode) & finite)
    return usable.groupBy("run_id", F.col("metric").alias("name")).agg(pick("value").alias("record"))


def best_so_far(history: DataFrame, mode: str = "max", records: DataFrame | None = None) -> DataFrame:
    """(run_id, name, epoch, value) rows with `best` (running) and `improved` (strictly better than before).

    Undefined values never improve.  records: stored bests (run_id, metric, mode, value) that a resumed run starts from."""
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    order = Window.partitionBy("run_id", "name").orderBy("epoch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    pick, better_of = (F.max, F.greatest) if mode == "max" else (F.min, F.least)
    h = history.withColumn("_record", F.lit(None).cast("double")) if records is None else history.join(known_records(records, mode).withColumnRenamed("record", "_record"), ["run_id", "name"], "left")
    h = h.withColumn("_v", finite).withColumn("_before", better_of(pick("_v").over(before), F.col("_record")))
    better = F.col("_v") > F.col("_before") if mode == "max" else F.col("_v") < F.col("_before")
    improved = F.col("_v").isNotNull() & (F.col("_before").isNull() | better)
    return h.withColumns({"best": better_of("_before", "_v"), "improved": improved}).select(*history.columns, "best", "improved")


def best_records(history: DataFrame, mode: str = "max", records: DataFrame | None = None) -> DataFrame:
    """(run_id, metric, mode, epoch, value): the best of every run and metric to store, with the epoch that set it.

    A record that no epoch beats stays; its epoch is null where it is not known."""
    h = best_so_far(history, mode, records).where("improved")
    last = h.groupBy("run_id", "name").agg(F.max_by(F.struct("epoch", "value"), "epoch").alias("set"))
    new = last.select("run_id", F.col("name").alias("metric"), F.lit(mode).alias("mode"), "set.epoch", "set.value")
    if records is None:
        return new
    old = known_records(records, mode).join(last.select("run_id", "name"), ["run_id", "name"], "left_anti")
    return new.unionByName(old.select("run_id", F.col("name").alias("metric"), F.lit(mode).alias("mode"), F.lit(None).cast("int").alias("epoch"), F.col("record").alias("value")))


def select_checkpoint(history: DataFrame, policy: str, interval: int = 1, mode: str = "max", records: DataFrame | None = None) -> DataFrame:
    """Epochs to keep: none, best_only, interval or interval_and_best; an interval always keeps the last."""
    h = best_so_far(history, mode, records).withColumn("_last", F.max("epoch").over(Window.partitionBy("run_id", "name")))
    on_interval = (F.col("epoch") % interval == 0) | (F.col("epoch") == F.col("_last"))
    rules = {"none": F.lit(False), "best_only": F.col("improved"), "interval": on_interval, "interval_and_best": F.col("improved") | on_interval}
    if policy not in rules:
        raise ValueError(f"unknown policy {policy}")
    return h.where(rules[policy]).drop("_last")


def run_summaries(run_log: DataFrame) -> DataFrame:
    """(run_id, name, best): maximum for metrics that grow, minimum for the others."""
    value = F.when(F.col("name").isin(*HIGHER_IS_BETTER), F.max("value")).otherwise(F.min("value"))
    return run_log.groupBy("run_id", "name").agg(value.alias("best"))


def compare_outputs(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], rtol: float = 2e-4, atol: float = 2e-5) -> DataFrame:
    """(name, rows, left_only, right_only, max_abs, all_close) of two result tables."""
    a = left.select(*keys, F.struct(*values).alias("a"))
    b = right.select(*keys, F.struct(*values).alias("b"))
    both = a.join(b, keys, "full_outer")
    rows = F.array(*[F.struct(F.lit(v).alias("name"), F.col("a")[v].cast("double").alias("x"), F.col("b")[v].cast("double").alias("y")) for v in values])
    flat = both.select(F.col("a").isNull().alias("no_a"), F.col("b").isNull().alias("no_b"), F.inline(rows))
    gap = F.abs(F.col("x") - F.col("y"))
    close = F.when(F.col("no_a") | F.col("no_b"), False).when(F.col("x").isNull() & F.col("y").isNull(), True).otherwise(F.coalesce(gap <= atol + rtol * F.abs("y"), F.lit(False)))
    return flat.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("no_b").cast("int")).alias("left_only"), F.sum(F.col("no_a").cast("int")).alias("right_only"), F.max(gap).alias("max_abs"), F.min(close).alias("all_close"))

"""Assignment of queries to targets and forward values of the graph losses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import AXES, EPS32, box, corners, giou, softmax2, uniform
from .inference import candidate_pairs, object_probability


def match_cost(queries: DataFrame, targets: DataFrame, class_weight: float = 2.0, node_weight: float = 5.0) -> DataFrame:
    """(sample_id, query_id, target_id, cost) of every query and target of a sample."""
    q = queries.select("sample_id", "query_id", "box", object_probability().alias("p"))
    t = targets.select("sample_id", "target_id", *[F.col(a).alias("t" + a) for a in AXES])
    l1 = sum((F.abs(F.col("box")[a] - F.col("t" + a)) for a in AXES), F.lit(0.0))
    return q.join(t, "sample_id").select("sample_id", "query_id", "target_id", (node_weight * l1 - class_weight * F.col("p")).alias("cost"))


def cheapest_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost matching of all rows of a matrix with rows <= columns (shortest augmenting paths)."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], column = row, 0
        least, previous, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[column]:
            seen[column] = True
            slack = np.append(0, cost[owner[column] - 1] - u[owner[column]] - v[1:])
            better = ~seen & (slack < least)
            better[0] = False
            least[better], previous[better] = slack[better], column
            nxt = int(np.argmin(np.where(seen, np.inf, least)))
            step = least[nxt]
            u[owner[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            column = nxt
        while column:
            owner[column] = owner[previous[column]]
            column = previous[column]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def assign(costs: DataFrame) -> DataFrame:
    """(sample_id, query_id, target_id, cost) of the cheapest assignment of each sample.

    One packed row per sample; samples without targets have no rows."""
    packed = costs.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("query_id", "target_id", "cost"))).alias("c"))
    packed = packed.select("sample_id", *[F.col("c")[n].alias(n) for n in ("query_id", "target_id", "cost")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for sample, q, t, c in zip(frame["sample_id"], frame["query_id"], frame["target_id"], frame["cost"]):
                qs, ts = np.unique(q), np.unique(t)
                matrix = np.asarray(c, float).reshape(len(qs), len(ts))
                pairs = cheapest_assignment(matrix) if len(qs) <= len(ts) else [(i, j) for j, i in cheapest_assignment(matrix.T)]
                rows += [(sample, int(qs[i]), int(ts[j]), float(matrix[i, j])) for i, j in sorted(pairs)]
            yield pd.DataFrame(rows, columns=["sample_id", "query_id", "target_id", "cost"])

    s = costs.schema
    return packed.mapInPandas(run, ", ".join(f"{c} {s[c].dataType.simpleString()}" for c in ("sample_id", "query_id", "target_id", "cost")))


def node_labels(queries: DataFrame, assignments: DataFrame) -> DataFrame:
    """Queries with label 1 where assigned, else 0."""
    taken = assignments.select("sample_id", "query_id", F.lit(1).alias("label"))
    return queries.join(taken, ["sample_id", "query_id"], "left").na.fill(0, ["label"])


def _log_p(label: Column, l0: Column, l1: Column) -> Column:
    other, own = F.when(label == 1, l0).otherwise(l1), F.when(label == 1, l1).otherwise(l0)
    d = other - own
    return -(F.greatest(d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d))))


def weighted_ce(rows: DataFrame, weights: tuple[float, float] = (1.0, 1.0), by: list[str] | None = None) -> DataFrame:
    """sum(w ce) / sum(w) over rows (l0, l1, label)."""
    return focal(rows, weights, 0.0, by).withColumnRenamed("focal", "ce")


def focal(rows: DataFrame, weights: tuple[float, float] | None = None, gamma: float = 2.0, by: list[str] | None = None, reduction: str = "mean") -> DataFrame:
    """Focal loss of rows (l0, l1, label): mean is sum(loss) / sum(weight), the plain mean without weights."""
    log_p = _log_p(F.col("label"), F.col("l0"), F.col("l1"))
    alpha = F.lit(1.0) if weights is None else F.when(F.col("label") == 1, float(weights[1])).otherwise(float(weights[0]))
    each = -F.pow(F.greatest(1 - F.exp(log_p), F.lit(EPS32)), F.lit(gamma)) * log_p * alpha if gamma else -log_p * alpha
    scored = rows.withColumns({"_loss": each, "_alpha": alpha})
    if reduction == "none":
        return scored.withColumnRenamed("_loss", "focal").drop("_alpha")
    total = F.sum("_loss") if reduction == "sum" else F.sum("_loss") / F.sum("_alpha")
    return scored.groupBy(*(by or [])).agg(total.alias("focal"))


def cardinality_error(queries: DataFrame, assignments: DataFrame) -> DataFrame:
    """One row: sum over samples of |predicted - matched| / number of queries."""
    predicted = queries.groupBy("sample_id").agg(F.sum((F.col("logits")[1] > F.col("logits")[0]).cast("int")).alias("predicted"), F.count(F.lit(1)).alias("queries"))
    matched = assignments.groupBy("sample_id").agg(F.count(F.lit(1)).alias("matched"))
    both = predicted.join(matched, "sample_id", "left").na.fill(0, ["matched"])
    return both.agg((F.sum(F.abs(F.col("predicted") - F.col("matched"))) / F.sum("queries")).alias("cardinality_error"))


def _matched(queries: DataFrame, targets: DataFrame, assignments: DataFrame) -> DataFrame:
    a = assignments.select("sample_id", "query_id", "target_id")
    t = targets.select("sample_id", "target_id", *[F.col(x).alias("t" + x) for x in AXES])
    return queries.select("sample_id", "query_id", "box").join(a, ["sample_id", "query_id"]).join(t, ["sample_id", "target_id"])


def node_l1(queries: DataFrame, targets: DataFrame, assignments: DataFrame) -> DataFrame:
    """One row: summed absolute offsets over the number of matched pairs, 0 without any."""
    l1 = sum((F.abs(F.col("box")[a] - F.col("t" + a)) for a in AXES), F.lit(0.0))
    return _matched(queries, targets, assignments).agg(F.coalesce(F.sum(l1) / F.count(F.lit(1)), F.lit(0.0)).alias("node_l1"))


def box_giou_loss(queries: DataFrame, targets: DataFrame, assignments: DataFrame, size: float = 0.2) -> DataFrame:
    """One row: mean of 1 - GIoU of matched boxes against target boxes of fixed size."""
    t = box({a: F.col("t" + a) for a in AXES}, {a: F.lit(float(size)) for a in AXES})
    m = _matched(queries, targets, assignments).withColumns({"p": corners(F.col("box"), clip=False), "tb": t})
    m = m.withColumn("t", corners(F.col("tb"), clip=False))
    return m.agg(F.coalesce(F.sum(1 - giou(F.col("p"), F.col("t"))) / F.count(F.lit(1)), F.lit(0.0)).alias("giou_loss"))


def matched_nodes(assignments: DataFrame) -> DataFrame:
    """Assignments with `local`: the position among the sample's matched queries."""
    order = Window.partitionBy("sample_id").orderBy("query_id")
    return assignments.withColumn("local", F.row_number().over(order) - 1)


def local_true_edges(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """(sample_id, src, dst) in local positions of target edges whose ends are both assigned; loops are dropped."""
    m = matched_nodes(assignments)
    end = lambda p: m.select("sample_id", F.col("target_id").alias(p), F.col("local").alias("l" + p))
    e = edges.join(end("src"), ["sample_id", "src"]).join(end("dst"), ["sample_id", "dst"]).where("lsrc <> ldst")
    return e.select("sample_id", F.least("lsrc", "ldst").alias("src"), F.greatest("lsrc", "ldst").alias("dst"))


def edge_pool(assignments: DataFrame, true_edges: DataFrame, maximum: int, positive_cap: int, seed: int = 0) -> DataFrame:
    """(sample_id, src, dst, label): up to positive_cap true pairs in order, then other pairs in hash order
    up to `maximum` rows a sample."""
    nodes = matched_nodes(assignments).select("sample_id", F.col("local").alias("node_id"))
    truth = true_edges.select("sample_id", "src", "dst")
    in_order = Window.partitionBy("sample_id").orderBy("src", "dst")
    positive = truth.withColumn("n", F.row_number().over(in_order)).where(F.col("n") <= positive_cap)
    used = positive.groupBy("sample_id").agg(F.max("n").alias("used"))
    by_hash = Window.partitionBy("sample_id").orderBy(uniform(seed, "pool", F.col("sample_id"), F.col("src"), F.col("dst")), "src", "dst")
    negative = candidate_pairs(nodes).join(truth, ["sample_id", "src", "dst"], "left_anti").withColumn("n", F.row_number().over(by_hash))
    negative = negative.join(used, "sample_id", "left").where(F.col("n") <= maximum - F.coalesce("used", F.lit(0)))
    row = lambda df, label: df.select("sample_id", "src", "dst", F.lit(label).alias("label"))
    return row(positive, 1).unionByName(row(negative, 0))


def ratio_upsample(rows: DataFrame, ratio: float = 0.15, tolerance: float = 0.02, by: str = "batch", order: str = "row_id") -> DataFrame:
    """Repeat the rows of the smaller class in order until positives / negatives is about `ratio`.

    rows: by, order, label and any others; adds `copy` (0 for the original).  Unchanged when a class is
    empty or the ratio lies within the tolerance."""
    counts = rows.groupBy(by).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    pos, neg = F.col("pos"), F.col("neg")
    actual = pos / neg
    extra_pos = F.when((pos > 0) & (neg > 0) & (actual < ratio - tolerance), F.floor(neg * ratio - pos)).otherwise(0)
    extra_neg = F.when((pos > 0) & (neg > 0) & (actual > ratio + tolerance), F.floor(pos / ratio - neg)).otherwise(0)
    counts = counts.withColumns({"extra_pos": F.greatest(extra_pos, F.lit(0)), "extra_neg": F.greatest(extra_neg, F.lit(0))})
    place = Window.partitionBy(by, "label").orderBy(order)
    r = rows.withColumn("n", F.row_number().over(place)).join(counts, by)
    extra = F.when(F.col("label") == 1, F.col("extra_pos")).otherwise(F.col("extra_neg"))
    size = F.when(F.col("label") == 1, pos).otherwise(neg)
    more = F.floor(extra / size) + F.when(F.col("n") <= extra % size, 1).otherwise(0)
    return r.withColumn("copy", F.explode(F.sequence(F.lit(0), more.cast("int")))).select(*rows.columns, "copy")


def active_unmatched(queries: DataFrame, assignments: DataFrame, threshold: float = 0.5, k: int = 20) -> DataFrame:
    """(sample_id, query_id, score): the k best unassigned queries with probability of at least the threshold."""
    free = queries.join(assignments.select("sample_id", "query_id"), ["sample_id", "query_id"], "left_anti")
    free = free.select("sample_id", "query_id", object_probability().alias("score")).where(F.col("score") >= threshold)
    order = Window.partitionBy("sample_id").orderBy(F.col("score").desc(), "query_id")
    return free.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def unmatched_pairs(active: DataFrame, assignments: DataFrame) -> DataFrame:
    """(sample_id, left, right): active unmatched with every matched query, then pairs within the active."""
    u = active.select("sample_id", F.col("query_id").alias("left"))
    m = assignments.select("sample_id", F.col("query_id").alias("right"))
    v = active.select("sample_id", F.col("query_id").alias("right"))
    return u.join(m, "sample_id").unionByName(u.join(v, "sample_id").where(F.col("left") < F.col("right")))


def hard_negatives(pairs: DataFrame, k: int) -> DataFrame:
    """The k pairs of each sample with the largest edge probability (l0, l1); 0 keeps all."""
    scored = pairs.withColumn("score", softmax2(F.col("l0"), F.col("l1")))
    order = Window.partitionBy("sample_id").orderBy(F.col("score").desc(), *[c for c in ("left", "right", "src", "dst") if c in pairs.columns])
    return scored if k == 0 else scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def edge_loss(matched: DataFrame, hard: DataFrame, hard_weight: float) -> DataFrame:
    """One row: (Lm nm + Lh w nh) / max(1, nm + w nh) from tables with a `loss` per row."""
    m = matched.agg(F.coalesce(F.sum("loss"), F.lit(0.0)).alias("lm"), F.count("loss").alias("nm"))
    h = hard.agg(F.coalesce(F.sum("loss"), F.lit(0.0)).alias("lh"), F.count("loss").alias("nh"))
    both = m.join(F.broadcast(h))
    return both.select(((F.col("lm") + hard_weight * F.col("lh")) / F.greatest(F.col("nm") + hard_weight * F.col("nh"), F.lit(1.0))).alias("edge_loss"))


def candidate_weight(epoch: Column, weight: float, warm_up: int, ramp: int) -> Column:
    """0 up to the end of the warm-up, then linear to `weight` over the ramp, or at once without one.

    Epochs count from 1, a smaller one is the first; negative weights and durations are 0."""
    weight, warm_up, ramp = max(0.0, float(weight)), max(0, warm_up), max(0, ramp)
    epoch = F.greatest(epoch, F.lit(1))
    share = F.least(F.lit(1.0), (epoch - warm_up) / float(ramp)) if ramp else F.lit(1.0)
    return F.when(epoch <= warm_up, F.lit(0.0)).otherwise(weight * share)


def linear_progress(percent: Column, start: float, target: float, first: float, last: float) -> Column:
    """start up to `first` percent and there, target from `last` on, linear between; with equal bounds a step after them."""
    if not 0 <= first <= last <= 100:
        raise ValueError("bounds must satisfy 0 <= first <= last <= 100")
    start, target = float(start), float(target)
    between = start + (percent - first) / float(last - first or 1) * (target - start)
    return F.when(percent <= first, F.lit(start)).when(percent >= last, F.lit(target)).otherwise(between)


def total_loss(components: DataFrame, weights: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Weighted sum of (name, value) rows; names without a weight do not count."""
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("name") == name, F.lit(float(w))).otherwise(weight)
    return components.groupBy(*(by or [])).agg(F.sum(weight * F.col("value")).alias("total"))

"""Detection metrics on boxes: IoU pairs, greedy matching, average precision and recall.

det tables: targets (sample_id, target_id, corners), predictions (sample_id, pred_id, corners, score).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import AXES, box, corner_struct, corners, giou, iou
from ..functions.storage import written
from .kernels import numbers, per_sample
from .ordering import with_running
from .topology import with_ends

# The evaluation protocol's IoU thresholds.
IOU_THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
RECALL_POINTS = 101
MAX_DETECTIONS = 40
#: Totals of so many groups are broadcast.
FEW_GROUPS = 10_000
CORNERS = ("d0", "h0", "d1", "h1", "w0", "w1")


def node_boxes(nodes: DataFrame, size: float = 0.2) -> DataFrame:
    """Nodes (d, h, w) with corners of a box of fixed size around them, clipped to the volume."""
    b = box({a: F.col(a) for a in AXES}, {a: F.lit(float(size)) for a in AXES})
    return nodes.withColumn("_box", b).withColumn("corners", corners(F.col("_box"))).drop("_box")


def edge_boxes(nodes: DataFrame, edges: DataFrame, half_width: float = 0.1) -> DataFrame:
    """Edges with the corners of the box around both ends, widened by half_width and clipped."""
    both = with_ends(nodes, edges)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    low = {a: clip(F.least(f"src_{a}", f"dst_{a}") - half_width) for a in AXES}
    high = {a: clip(F.greatest(f"src_{a}", f"dst_{a}") + half_width) for a in AXES}
    return both.select(*edges.columns, corner_struct(low, high).alias("corners"))


def pair_iou(predictions: DataFrame, targets: DataFrame, minimum: float = 0.0, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """(keys, pred_id, target_id, iou) of pairs within a sample that reach the minimum."""
    p = predictions.select(*keys, "pred_id", F.col("corners").alias("p"))
    t = targets.select(*keys, "target_id", F.col("corners").alias("t"))
    pairs = p.join(t.hint("merge"), list(keys)).select(*keys, "pred_id", "target_id", iou(F.col("p"), F.col("t")).alias("iou"))
    return pairs.where((F.col("iou") >= minimum) & (F.col("iou") > 0)) if minimum > 0 else pairs


def pair_giou(predictions: DataFrame, targets: DataFrame) -> DataFrame:
    """(sample_id, pred_id, target_id, giou) of all pairs within a sample, from unclipped boxes."""
    p = predictions.select("sample_id", "pred_id", corners(F.col("box"), clip=False).alias("p"))
    t = targets.select("sample_id", "target_id", corners(F.col("box"), clip=False).alias("t"))
    return p.join(t.hint("merge"), "sample_id").select("sample_id", "pred_id", "target_id", giou(F.col("p"), F.col("t")).alias("giou"))


def top_detections(predictions: DataFrame, k: int = MAX_DETECTIONS) -> DataFrame:
    """The k best of each sample by (score descending, id), with `rank` from 1."""
    order = Window.partitionBy("sample_id").orderBy(F.col("score").desc(), "pred_id")
    return predictions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def walk(code: np.ndarray, rank: np.ndarray, p_corner: np.ndarray, t_code: np.ndarray, t_corner: np.ndarray, limits: np.ndarray, k: int) -> np.ndarray:
    """hits [predictions, limits] of greedy_hits: predictions by sample and rank (from 0, below k), targets by sample and id.

    Corners are [CORNERS, boxes].  The ranks of all samples are walked at once."""
    start = np.searchsorted(t_code, np.arange(max(code.max(initial=-1), t_code.max(initial=-1)) + 2))
    count = np.diff(start)[code]
    left = np.repeat(np.arange(len(code)), count)
    right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[code], count)
    one, two = (dict(zip(CORNERS, x)) for x in (p_corner[:, left], t_corner[:, right]))
    volume = lambda c: np.maximum(c["d1"] - c["d0"], 0) * np.maximum(c["h1"] - c["h0"], 0) * np.maximum(c["w1"] - c["w0"], 0)
    side = lambda x: np.maximum(np.minimum(one[x + "1"], two[x + "1"]) - np.maximum(one[x + "0"], two[x + "0"]), 0)
    inter = side("d") * side("h") * side("w")
    union = volume(one) + volume(two) - inter
    iou = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
    near = np.flatnonzero((iou >= limits.min()) & (iou > 0))
    left, right, iou = left[near], right[near], iou[near]
    order = np.lexsort((right, -iou, left, rank[left]))
    left, right, iou = left[order], right[order], iou[order]
    turn = np.searchsorted(rank[left], np.arange(k + 1))
    used, hits = np.zeros((len(limits), len(t_code)), bool), np.zeros((len(code), len(limits)), bool)
    for i, j in zip(turn[:-1], turn[1:]):
        if i == j:
            continue
        of, at = left[i:j], right[i:j]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        free = (iou[i:j] >= limits[:, None]) & ~used[:, at]
        best = np.minimum.reduceat(np.where(free, np.arange(j - i), j - i), first, axis=1)
        which, segment = np.nonzero(best < j - i)
        used[which, at[best[which, segment]]] = True
        hits[of[first[segment]], which] = True
    return hits


def average_precision(code: np.ndarray, rank: np.ndarray, hits: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ap, ar) of pooled_ap_ar with every sample as its own group, NaN without targets; hits: by sample and rank, targets: their number by sample."""
    start = np.searchsorted(code, np.arange(len(targets)))
    running = np.concatenate((np.zeros((1, hits.shape[1]), np.int64), np.cumsum(hits, 0)))
    tps = running[1:] - running[start[code]]
    of = np.maximum(targets[code], 1)[:, None]
    recall, precision = tps / of, np.where(hits, tps / (rank + 1)[:, None], 0.0)

    def reach(recall: np.ndarray) -> np.ndarray:
        """_reach, 0 without a hit."""
        k = np.floor(recall * 100) + 1
        last = np.where(recall >= k * 0.01, k, np.where(recall >= (k - 1) * 0.01, k - 1, k - 2))
        return np.where(recall >= 1, RECALL_POINTS, np.where(recall > 0, np.minimum(last, RECALL_POINTS - 2) + 1, 0))

    gain = np.where(hits, reach(recall) - reach((tps - 1) / of), 0)
    top, total, most = (np.zeros((len(targets), hits.shape[1])) for _ in range(3))
    np.maximum.at(most, code, recall)
    # From the last rank down: the best precision so far holds for the points that a hit adds.
    for r in range(int(rank.max(initial=-1)), -1, -1):
        at = np.flatnonzero(rank == r)
        top[code[at]] = np.maximum(top[code[at]], precision[at])
        total[code[at]] += gain[at] * top[code[at]]
    known = np.where(targets > 0, 1.0, np.nan)
    return (total / RECALL_POINTS).sum(1) / hits.shape[1] * known, most.sum(1) / hits.shape[1] * known


def greedy_hits(predictions: DataFrame, targets: DataFrame, thresholds: tuple[float, ...] = IOU_THRESHOLDS, k: int = MAX_DETECTIONS) -> DataFrame:
    """(sample_id, rank, score, hits): in order of score each of the k best predictions takes the free target of
    highest IoU of at least the threshold (ties: smallest target id); hits: whether it found one, per threshold.

    Boxes of all samples go through one shuffle; a kernel walks the ranks of a batch of samples at once (walk)."""
    ids = {x: df.schema[x].dataType.simpleString() for df, x in ((predictions, "pred_id"), (targets, "target_id"))}
    none = lambda x: F.lit(None).cast(ids[x]).alias(x)
    sides = [F.col("corners")[x].cast("double").alias(x) for x in CORNERS]
    p = predictions.select("sample_id", F.lit(0).alias("kind"), F.col("score").cast("double").alias("score"), "pred_id", none("target_id"), *sides)
    t = targets.select("sample_id", F.lit(1).alias("kind"), F.lit(0.0).alias("score"), none("pred_id"), "target_id", *sides)
    limits = np.array(thresholds)

    def kernel(table: pa.Table, code: np.ndarray) -> pa.Table:
        kind, score = numbers(table, "kind", "score")
        corner = np.stack(numbers(table, *CORNERS))
        is_p = kind == 0
        rank = np.arange(len(code)) - np.searchsorted(code, np.arange(int(code[-1]) + 1))[code]
        pred, target = np.flatnonzero(is_p & (rank < k)), np.flatnonzero(~is_p)
        hits = walk(code[pred], rank[pred], corner[:, pred], code[target], corner[:, target], limits, k)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pred) + 1) * len(limits), pa.int32()), pa.array(hits.ravel()))
        return pa.table({"sample_id": table["sample_id"].take(pa.array(pred)), "rank": (rank[pred] + 1).astype(np.int32), "score": score[pred], "hits": lists})

    rows = p.unionByName(t)
    schema = f"sample_id {rows.schema['sample_id'].dataType.simpleString()}, rank int, score double, hits array<boolean>"
    return per_sample(rows, kernel, schema, ["kind", F.desc("score"), "pred_id", "target_id"], limit=1 << 15)


def greedy_match(predictions: DataFrame, targets: DataFrame, thresholds: tuple[float, ...] = IOU_THRESHOLDS, k: int = MAX_DETECTIONS) -> DataFrame:
    """(sample_id, iou_t, rank, score, hit): greedy_hits with a row per threshold."""
    wide = greedy_hits(predictions, targets, thresholds, k)
    flat = wide.select("sample_id", "rank", "score", F.posexplode("hits").alias("i", "hit"))
    return flat.select("sample_id", F.get(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("i")).alias("iou_t"), "rank", "score", "hit")


def target_counts(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """(sample_id, target_count) for every sample."""
    counts = targets.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    return samples.select("sample_id").join(counts.hint("merge"), "sample_id", "left").select("sample_id", F.coalesce("n", F.lit(0)).alias("target_count"))


def _reach(recall: Column) -> Column:
    """Number of recall points 0, 0.01, .. 0.99, 1 that a recall reaches."""
    k = F.floor(recall * 100) + 1
    last = F.when(recall >= k * 0.01, k).when(recall >= (k - 1) * 0.01, k - 1).otherwise(k - 2)
    return F.when(recall >= 1, RECALL_POINTS).otherwise(F.least(last, F.lit(RECALL_POINTS - 2)) + 1).cast("int")


def pooled_ap_ar(hits: DataFrame, counts: DataFrame, by: str = "sample_id", thresholds: tuple[float, ...] = IOU_THRESHOLDS) -> DataFrame:
    """(by, ap, ar): hits pooled per group, ordered by score (ties: sample, rank).

    hits: by, sample_id, rank, score and either `hits` per threshold or iou_t and `hit`; counts: by,
    target_count.  Running sums of all thresholds come from one order.  The precision at a recall point
    is the largest precision of any rank with at least that recall, so no reverse scan is needed; only
    hits can be that rank.  A group without targets has null metrics, one without predictions 0.
    """
    total = counts.groupBy(by).agg(F.sum("target_count").alias("targets"))
    if by != "sample_id":
        total = written(total, "targets")
    wide = "hits" in hits.columns
    groups = [by] if wide else [by, "iou_t"]
    tp = [f"tp{i}" for i in range(len(thresholds) if wide else 1)]
    flags = [F.coalesce(F.col("hits")[i] if wide else F.col("hit"), F.lit(False)).cast("int").alias(x) for i, x in enumerate(tp)]
    rows = hits.select(*dict.fromkeys([*groups, "sample_id"]), "score", "rank", *flags)
    order = [F.col("score").desc(), F.col("sample_id").asc(), F.col("rank").asc()]
    if by == "sample_id":
        # A sample's detections are few.
        run = Window.partitionBy(*groups).orderBy(*order)
        ranked = rows.withColumns({"position": F.row_number().over(run) - 1, **{f"{x}_sum": F.sum(x).over(run.rowsBetween(Window.unboundedPreceding, 0)) for x in tp}})
    else:
        ranked = with_running(rows, groups, order, tp)
    at = lambda i: F.lit(float(thresholds[i])) if wide else F.col("iou_t")
    found = [F.when(F.col(x) == 1, F.struct(at(i).alias("iou_t"), F.col(f"{x}_sum").alias("tps"))) for i, x in enumerate(tp)]
    ranked = ranked.select(by, (F.col("position") + 1).alias("seen"), F.inline(F.array_compact(F.array(*found))))
    # Few groups are broadcast, so that a large one does not become one task.
    ranked = ranked.join(F.broadcast(total) if by != "sample_id" and total.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else total.hint("merge"), by)
    ranked = ranked.select(by, "iou_t", (F.col("tps") / F.col("targets")).alias("recall"), (F.col("tps") / F.col("seen")).alias("precision"))
    ranked = ranked.withColumn("reach", _reach(F.col("recall")))
    if by != "sample_id":
        ranked = ranked.groupBy(by, "iou_t", "reach").agg(F.max("precision").alias("precision"), F.max("recall").alias("recall"))
    steps = F.array_sort(F.collect_list(F.struct((-F.col("reach")).alias("less"), "precision")))
    per = ranked.groupBy(by, "iou_t").agg(steps.alias("steps"), F.max("recall").alias("recall"))
    # From the largest reach down, the best precision so far holds for the points that the next step leaves out.
    start = F.struct(F.lit(0).alias("reach"), F.lit(0.0).alias("top"), F.lit(0.0).alias("total"))
    step = lambda s, x: F.struct((-x["less"]).alias("reach"), F.greatest(s["top"], x["precision"]).alias("top"), (s["total"] + s["top"] * (s["reach"] + x["less"])).alias("total"))
    mean = F.aggregate("steps", start, step, lambda s: (s["total"] + s["top"] * s["reach"]) / RECALL_POINTS)
    both = per.groupBy(by).agg((F.sum(mean) / len(thresholds)).alias("ap"), (F.sum("recall") / len(thresholds)).alias("ar"))
    zero = lambda c: F.when(F.col("targets") > 0, F.coalesce(c, F.lit(0.0)))
    return total.join(both.hint("merge"), by, "left").select(by, zero("ap").alias("ap"), zero("ar").alias("ar"))


def sample_ap_ar(predictions: DataFrame, targets: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, ap, ar) with every sample as its own group."""
    return pooled_ap_ar(greedy_hits(predictions, targets), target_counts(samples, targets))

"""Evaluation of predicted graphs: 17 metrics per sample in one plan keyed by sample_id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import AXES
from ..operators import detection as det
from ..operators import topology as topo
from ..operators import transport
from ..operators.graphs import Graph, graph_of, per_graph, whole_graphs

METRICS = (
    "smd", "node_mAP", "node_mAR", "edge_mAP", "edge_mAR", "beta0_absolute_error", "beta1_absolute_error", "node_count_absolute_error", "edge_count_absolute_error",
    "target_beta0", "target_beta1", "predicted_beta0", "predicted_beta1", "target_nodes", "target_edges", "predicted_nodes", "predicted_edges",
)


def graph_counts(samples: DataFrame, target_nodes: DataFrame, target_edges: DataFrame, pred_nodes: DataFrame, pred_edges: DataFrame) -> DataFrame:
    """Betti numbers, counts and their absolute errors for every sample."""

    both = topo.betti_of_graphs(samples, {"target_": (target_nodes, target_edges), "predicted_": (pred_nodes, pred_edges)})
    both = both.withColumnsRenamed({f"{side}_n_{x}": f"{side}_{x}" for side in ("target", "predicted") for x in ("nodes", "edges")})
    gap = lambda x: F.abs(F.col(f"target_{x}") - F.col(f"predicted_{x}"))
    return both.withColumns({"beta0_absolute_error": gap("beta0"), "beta1_absolute_error": gap("beta1"), "node_count_absolute_error": gap("nodes"), "edge_count_absolute_error": gap("edges")})


INTS = METRICS[5:]


def _clip(x: np.ndarray) -> np.ndarray:
    return np.fmax(0.0, np.fmin(1.0, x))


def _ranked(code: np.ndarray, score: pa.Array, *ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(predictions that count by sample, score descending and id, their ranks); as in Spark, NaN is the largest score and null the least."""
    values, null = score.to_numpy(zero_copy_only=False).astype(float), ~score.is_valid().to_numpy(zero_copy_only=False)
    order = np.lexsort((*ids[::-1], -values, ~np.isnan(values), null, code))
    rank = np.arange(len(order)) - np.searchsorted(code[order], code[order])
    kept = rank < det.MAX_DETECTIONS
    return order[kept], rank[kept]


def _detections(target: Graph, predicted: Graph, half_width: float = 0.1, size: float = 0.2) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """kind -> (ap, ar): boxes around the nodes of the target against the predicted corners, and boxes around the edges of both."""
    limits, n = np.array(det.IOU_THRESHOLDS), target.rows
    t_at, p_at = target.at, predicted.at

    def around(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        side = dict(zip([a + "0" for a in AXES] + [a + "1" for a in AXES], [*_clip(low).T, *_clip(high).T]))
        return np.stack([side[x] for x in det.CORNERS])

    def judged(at: np.ndarray, rank: np.ndarray, code: np.ndarray, corner: np.ndarray, t_code: np.ndarray, t_corner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hits = det.walk(code[at], rank, corner[:, at], t_code, t_corner, limits, det.MAX_DETECTIONS)
        return det.average_precision(code[at], rank, hits, np.bincount(t_code, minlength=n))

    ends = lambda at, a, b, w: around(np.fmin(at[a], at[b]) - w, np.fmax(at[a], at[b]) + w)
    by_id = np.argsort(target.number, kind="stable")
    best = _ranked(predicted.code, predicted.items.field("score"), predicted.number)
    corner = np.stack([predicted.field(x).astype(float) for x in det.CORNERS])
    nodes = judged(*best, predicted.code, corner, target.code[by_id], around(t_at - size / 2, t_at + size / 2)[:, by_id])
    known = np.flatnonzero((predicted.src >= 0) & (predicted.dst >= 0))
    src, dst, code = predicted.src[known], predicted.dst[known], predicted.edge_code[known]
    best = _ranked(code, predicted.edge_items.field("score").take(pa.array(known)), predicted.number[src], predicted.number[dst])
    edges = judged(*best, code, ends(p_at, src, dst, half_width), target.owner[target.low], ends(t_at[target.place], target.low, target.high, half_width))
    return {"node": nodes, "edge": edges}


def evaluate_graphs(samples: DataFrame, target_nodes: DataFrame, target_edges: DataFrame, pred_nodes: DataFrame, pred_edges: DataFrame, points: int = 100, with_smd: bool = True) -> DataFrame:
    """One row per sample with all METRICS (without smd if that is not asked for); undefined ones are null.

    pred_nodes carry corners and score, pred_edges a score."""
    return evaluate_whole(whole_graphs(samples, {"target": (target_nodes, target_edges), "predicted": (pred_nodes, pred_edges)}), points, with_smd)


def evaluate_whole(graphs: DataFrame, points: int = 100, with_smd: bool = True) -> DataFrame:
    """evaluate_graphs of whole graphs `target` and `predicted`: one kernel makes all metrics of a sample."""
    metrics = METRICS if with_smd else METRICS[1:]
    if with_smd:
        for name in ("target", "predicted"):
            graphs = transport.graph_point_cloud(graphs, name, points)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = {name: graph_of(batch, name) for name in ("target", "predicted")}
        found = {f"{side}_{x.removeprefix('n_')}": v for side, g in both.items() for x, v in g.counts().items()}
        for metric, x in (("beta0_absolute_error", "beta0"), ("beta1_absolute_error", "beta1"), ("node_count_absolute_error", "nodes"), ("edge_count_absolute_error", "edges")):
            found[metric] = np.abs(found[f"target_{x}"] - found[f"predicted_{x}"])
        for kind, (ap, ar) in _detections(**both).items():
            found |= {f"{kind}_mAP": ap, f"{kind}_mAR": ar}
        if with_smd:
            found["smd"] = transport.distances_of(batch, both)
        columns = [pa.array(found[x]) if x in INTS else pa.array(found[x], mask=np.isnan(found[x])) for x in metrics]
        return pa.RecordBatch.from_arrays([batch.column("sample_id"), *columns], ["sample_id", *metrics])

    types = ", ".join(f"{x} {'int' if x in INTS else 'double'}" for x in metrics)
    return per_graph(graphs, kernel, f"sample_id {graphs.schema['sample_id'].dataType.simpleString()}, {types}")

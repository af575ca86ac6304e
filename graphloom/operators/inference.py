"""From object queries to graphs: retained nodes, candidate pairs, relation scores, edges.

queries: (sample_id, query_id, logits ARRAY<DOUBLE>, box STRUCT<d,h,w,sd,sh,sw>, token ARRAY<DOUBLE>).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import softmax2
from .kernels import per_sample


def object_probability(logits: str = "logits") -> Column:
    return softmax2(F.col(logits)[0], F.col(logits)[1])


def retain_nodes(queries: DataFrame, threshold: float | None = None) -> DataFrame:
    """(sample_id, node_id, query_id, box, token, score) of kept queries, numbered in query order.

    Kept: class 1 wins strictly, or its probability exceeds the threshold."""
    score = object_probability()
    kept = F.col("logits")[1] > F.col("logits")[0] if threshold is None else score > threshold
    order = Window.partitionBy("sample_id").orderBy("query_id")
    return queries.where(kept).select("sample_id", (F.row_number().over(order) - 1).alias("node_id"), "query_id", "box", "token", score.alias("score"))


def candidate_pairs(nodes: DataFrame, *columns: str) -> DataFrame:
    """All pairs src < dst of a sample's nodes with both sides' columns as src_<c>, dst_<c>.

    A sample has a bounded number of queries, so its pairs are bounded too."""
    side = lambda p: nodes.select("sample_id", F.col("node_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    a, b = side("src"), side("dst")
    return a.join(b, (a["sample_id"] == b["sample_id"]) & (a["src"] < b["dst"])).drop(b["sample_id"])


Layers = list[tuple[np.ndarray, np.ndarray]]

#: Nodes of samples that a scoring task holds at a time, pairs that it scores at a time.
SCORED_NODES, SCORED_PAIRS = 2048, 4096


def relation_head(layers: Layers, x: np.ndarray) -> np.ndarray:
    """A ReLU network; the last layer is linear."""
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i + 1 < len(layers):
            x = np.maximum(x, 0)
    return x


def pair_logits(layers: Layers, tokens: np.ndarray, src: np.ndarray, dst: np.ndarray, relation: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Logits of the pairs src, dst of one sample's nodes in both orders.

    The first layer reads [left; right; relation], so its products are made once for each node and for the
    relation tokens; a pair adds up three of them, whichever way round."""
    (w, b), rest = layers[0], layers[1:]
    width = tokens.shape[1]
    left, right = tokens @ w[:width], tokens @ w[width : 2 * width]
    left = left + (b if relation is None else b + relation @ w[2 * width :])

    def logits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x = left[i] + right[j]
        return relation_head(rest, np.maximum(x, 0, out=x)) if rest else x

    parts = [slice(at, at + SCORED_PAIRS) for at in range(0, max(len(src), 1), SCORED_PAIRS)]
    return np.vstack([logits(src[p], dst[p]) for p in parts]), np.vstack([logits(dst[p], src[p]) for p in parts])


def score_relations(nodes: DataFrame, layers: Layers, relations: DataFrame | None = None) -> DataFrame:
    """All pairs src < dst of each sample's nodes with l0, l1 (mean of both orders' logits), score (their softmax) and p (mean of both orders' probabilities).

    nodes: (sample_id, node_id, token); a token travels once, pairs are made where they are scored.
    relations: (sample_id, token), the relation tokens of a sample one after another, if the head reads them;
    samples without a row there are left out."""
    rows = nodes.select("sample_id", "node_id", "token")
    if relations is not None:
        rows = rows.join(relations.select("sample_id", F.col("token").alias("relation")), "sample_id")
    id_type, with_relations = rows.schema["sample_id"].dataType.simpleString(), relations is not None

    def run(table: pa.Table, code: np.ndarray) -> pa.Table:
        node = table["node_id"].to_numpy()
        matrix = lambda name, a, b: table[name].slice(a, b - a).combine_chunks().flatten().to_numpy().reshape(b - a, -1).astype(np.float64)
        cuts = np.searchsorted(code, np.arange(code[-1] + 2))
        first, pairs, logits = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            src, dst = np.triu_indices(b - a, 1)
            relation = matrix("relation", a, a + 1)[0] if with_relations else None
            both = pair_logits(layers, matrix("token", a, b), src, dst, relation)
            first.append(np.full(len(src), a))
            pairs.append(np.stack([node[a:b][src], node[a:b][dst]]))
            logits.append(np.hstack([*both]))
        x, (src, dst) = np.vstack(logits), np.hstack(pairs)
        one = lambda low, high: 1 / (1 + np.exp(np.clip(low - high, -700, 700)))
        mean = (x[:, :2] + x[:, 2:]) / 2
        p = (one(x[:, 0], x[:, 1]) + one(x[:, 2], x[:, 3])) / 2
        return pa.table({"sample_id": table["sample_id"].take(pa.array(np.concatenate(first))), "src": src.astype(np.int32), "dst": dst.astype(np.int32), "l0": mean[:, 0], "l1": mean[:, 1], "p": p})

    scored = per_sample(rows, run, f"sample_id {id_type}, src int, dst int, l0 double, l1 double, p double", ["node_id"], SCORED_NODES)
    return scored.withColumn("score", softmax2(F.col("l0"), F.col("l1")))


def symmetric_logits(ordered: DataFrame) -> DataFrame:
    """Mean logits per unordered pair from logits of ordered pairs (sample_id, left, right, l0, l1)."""
    keyed = ordered.select("sample_id", F.least("left", "right").alias("src"), F.greatest("left", "right").alias("dst"), "l0", "l1")
    mean = keyed.groupBy("sample_id", "src", "dst").agg(F.avg("l0").alias("l0"), F.avg("l1").alias("l1"))
    return mean.withColumn("score", softmax2(F.col("l0"), F.col("l1")))


def symmetric_probability(ordered: DataFrame) -> DataFrame:
    """(sample_id, src, dst, p): mean over both orders of the softmaxed probability, from logits of ordered pairs.

    The topology losses average probabilities, scores average logits."""
    keyed = ordered.select("sample_id", F.least("left", "right").alias("src"), F.greatest("left", "right").alias("dst"), softmax2(F.col("l0"), F.col("l1")).alias("p"))
    return keyed.groupBy("sample_id", "src", "dst").agg(F.avg("p").alias("p"))


def retain_edges(pairs: DataFrame, threshold: float | None = None) -> DataFrame:
    """(sample_id, src, dst, score) where class 1 wins strictly or its probability exceeds the threshold."""
    kept = F.col("l1") > F.col("l0") if threshold is None else F.col("score") > threshold
    return pairs.where(kept).select("sample_id", "src", "dst", "score")


def infer_graphs(queries: DataFrame, layers: Layers, node_threshold: float | None = None, edge_threshold: float | None = None, relations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pred_nodes, pred_edges); no suppression of overlapping nodes.  relations: as in score_relations."""
    nodes = retain_nodes(queries, node_threshold)
    edges = retain_edges(score_relations(nodes, layers, relations), edge_threshold)
    return nodes.drop("token"), edges

"""Quality classifier: attention-based multiple-instance learning over passages.

Every passage of 64 words is encoded (surface features, then a learned layer); gated attention weighs
the passages of a document and the weighted representation is scored.  Only document labels are used:

    h = tanh(x W + b)        a = softmax over the document of ((tanh(h V) * sigmoid(h U)) w)
    z = sum a h              score = sigmoid(z c + d)

The labelled documents for fitting are a bounded sample (`max_labelled`, the smallest md5 of the id),
encoded on the executors; the model has a few thousand numbers and travels inside the plan.  All
documents are scored in one pass without shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import text_slices
from .common import held_out
from .labelled import MAX_CHARS, bounded_sample
from .passage_features import N_FEATURES, N_SURFACE, passages

THRESHOLD = 0.3


class Model:
    """Weights of the classifier and its forward pass."""

    def __init__(self, features: int = N_FEATURES, hidden: int = 24, gate: int = 12, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.w = {
            "W": r.normal(0, features**-0.5, (features, hidden)), "b": np.zeros(hidden),
            "V": r.normal(0, hidden**-0.5, (hidden, gate)), "U": r.normal(0, hidden**-0.5, (hidden, gate)), "w": np.zeros(gate),
            "c": np.zeros(hidden), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, owner: np.ndarray, first: np.ndarray) -> dict:
        """owner: index of each passage's document, ascending; first: each document's first passage."""
        w = self.w
        h = np.tanh((x - self.mean) / self.scale @ w["W"] + w["b"])
        g, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (g * s) @ w["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[owner])
        a = e / np.add.reduceat(e, first)[owner]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        t = np.clip(z @ w["c"] + w["d"][0], -30, 30)
        return {"h": h, "g": g, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-t))}

    def fit(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.scale[N_SURFACE:] = max(3 * self.scale[N_SURFACE:].mean(), 1e-3) if x.shape[1] > N_SURFACE else 1.0  # many weak inputs: none is to outweigh the surface
        bounds = np.searchsorted(owner, np.arange(len(y) + 1))
        r, m1, m2, step = np.random.default_rng(seed), {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                docs = order[i : i + batch]
                size = bounds[docs + 1] - bounds[docs]
                first = np.concatenate(([0], np.cumsum(size)[:-1]))
                index = np.repeat(bounds[docs] - first, size) + np.arange(size.sum())
                grad = self._gradient(x[index], np.repeat(np.arange(len(docs)), size), first, y[docs])
                step += 1
                for k, gk in grad.items():
                    gk = gk + decay * self.w[k]
                    m1[k] = 0.9 * m1[k] + 0.1 * gk
                    m2[k] = 0.999 * m2[k] + 0.001 * gk * gk
                    self.w[k] = self.w[k] - rate * (1 - epoch / (epochs + 1)) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)

    def _gradient(self, x: np.ndarray, owner: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
        w, f = self.w, self.forward(x, owner, first)
        h, g, s, a = f["h"], f["g"], f["s"], f["a"]
        dt = (f["p"] - y) / len(y)
        dz = (dt[:, None] * w["c"])[owner]
        da = (dz * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[owner])
        dgs = de[:, None] * w["w"]
        dg, ds = dgs * s * (1 - g * g), dgs * g * s * (1 - s)
        dh = a[:, None] * dz + dg @ w["V"].T + ds @ w["U"].T
        dpre = dh * (1 - h * h)
        xs = (x - self.mean) / self.scale
        return {"W": xs.T @ dpre, "b": dpre.sum(0), "V": h.T @ dg, "U": h.T @ ds, "w": (g * s).T @ de, "c": f["z"].T @ dt, "d": np.array([dt.sum()])}


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_chars: int = MAX_CHARS) -> Model | None:
    """Fit on at most max_labelled labelled documents of at most max_chars code points together; None without any of them."""
    rows = bounded_sample(docs, labels, label_col, max_labelled, max_chars, id_col, text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column("label").to_numpy(zero_copy_only=False)
            for first, end, data, offsets in text_slices(b.column("text")):
                x, owner = passages(data, offsets)
                bounds = np.searchsorted(owner, np.arange(end - first + 1))
                packed = pa.array([x[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("ticket").slice(first, end - first), pa.array(label[first:end]), packed], ["ticket", "label", "x"])

    got = rows.mapInArrow(encode, "ticket string, label double, x binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values("ticket", ignore_index=True)  # the fit must not depend on the order of partitions
    xs = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in got["x"]]
    model = Model()
    model.fit(np.concatenate(xs).astype(np.float64), np.repeat(np.arange(len(xs)), [len(x) for x in xs]), got["label"].to_numpy())
    return model


def score_quality(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_passages, top_passage, top_weight.

    Null, blank and empty texts are scored as one passage of zero features; without a model every score
    is 0.5.  Repeated rows are scored alike, texts of any length as a whole, other columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = d.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_slices(b.column("text")):
                x, owner = passages(data, offsets)
                n = end - first
                start = np.searchsorted(owner, np.arange(n))
                count = np.bincount(owner, minlength=n)
                if model is None:
                    p, top, weight = np.full(n, 0.5), np.zeros(n, np.int32), 1.0 / count
                else:
                    f = model.forward(x, owner, start)
                    best = np.lexsort((-f["a"], owner))[start]
                    p, top, weight = f["p"], (best - start).astype(np.int32), f["a"][best]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, n), pa.array(p), pa.array(count.astype(np.int32)), pa.array(top), pa.array(weight)], ["doc_id", "score", "n_passages", "top_passage", "top_weight"])

    out = d.mapInArrow(score, f"doc_id {id_type}, score double, n_passages int, top_passage int, top_weight double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", "top_passage", "top_weight")

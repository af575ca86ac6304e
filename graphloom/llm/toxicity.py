"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

p(instance) = sigmoid(b + sum of the weights of its features), p(document) = 1 - prod(1 - p(instance)).
Instances are the sentences, whose features are their words and the beginnings of four to seven bytes of
their words, and the document itself, whose features are the beginnings that occur at least twice or three
times in it.  So a sentence's own score depends on nothing outside it.  Only document labels are used; the
gradient of the document likelihood reaches the sentences through the noisy-or.  Features of the bounded
sample that at least `min_docs` documents hold compete for a vocabulary of `max_words` by their gain in
likelihood, counted on the executors; they are known by a 64-bit hash of lower-case letters.  The model is
a short array of hashes and weights inside the plan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import RunHasher, mix, runs, text_slices
from .common import held_out, written
from .labelled import MAX_CHARS, bounded_sample

THRESHOLD = 0.5
PREFIXES = (4, 5, 6, 7)
#: Times that a word beginning stands in a document.
RECURRENCES = (2, 3)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def instances(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, its row, its instance within the row, number of sentences per row), by row.

    Instances 0, 1, .. of a row are its sentences, with their words and word beginnings as features; the
    instance after the last sentence is the document itself, with the beginnings that recur in it.
    Sentences end at . ! ? or a line end; those without a letter do not count."""
    rows = len(offsets) - 1
    starts, ends, row = runs(_LETTER[data], offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), row, row, np.zeros(rows, np.int64)
    stops = np.cumsum(_STOP[data])[starts]
    new = np.concatenate(([True], (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])))
    sentence = np.cumsum(new) - 1
    begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    base = np.zeros(rows, np.int64)
    base[row[begin]] = sentence[begin]
    count = np.zeros(rows, np.int64)
    count[row[begin]] = np.diff(np.concatenate((sentence[begin], [sentence[-1] + 1])))
    hasher, sentence = RunHasher(_LOWER[data]), sentence - base[row]
    features, owner, at = [hasher(starts, ends)], [row], [sentence]
    for k in PREFIXES:
        longer = np.flatnonzero(ends - starts > k)
        stem, of = mix(hasher(starts[longer], starts[longer] + k) + np.uint64(k)), row[longer]
        features.append(mix(stem + np.uint64(1)))
        owner.append(of)
        at.append(sentence[longer])
        _, first, often = np.unique(mix(stem ^ mix(of.astype(np.uint64))), return_index=True, return_counts=True)
        for least in RECURRENCES:
            again = first[often >= least]
            features.append(mix(stem[again] + np.uint64(least)))
            owner.append(of[again])
            at.append(count[of[again]])
    features, owner, at = np.concatenate(features), np.concatenate(owner), np.concatenate(at)
    order = np.argsort(owner, kind="stable")
    return features[order], owner[order], at[order], count


class Model:
    """Known features (ascending hashes), their weights, and the weight of any instance."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias


def _softplus(t: np.ndarray) -> np.ndarray:
    return np.maximum(t, 0) + np.log1p(np.exp(-np.abs(t)))


def train(words: np.ndarray, col: np.ndarray, doc: np.ndarray, instance: np.ndarray, counts: np.ndarray, y: np.ndarray, steps: int = 1000, rate: float = 0.1, decay: float = 1e-6, share_kept: float = 0.8, seed: int = 3) -> Model:
    """Weights of `words` by gradient descent on the likelihood of document labels.

    col, doc, instance: one entry per feature of an instance, each once; counts: instances per document; y: labels.
    Every step leaves out a random part of the features (1 - share_kept), so that each marker learns to
    count without those that often stand beside it."""
    base = np.concatenate(([0], np.cumsum(counts)))
    key, s = np.unique(base[doc] + instance, return_inverse=True)
    owner = np.searchsorted(base, key, "right") - 1
    plain = counts - np.bincount(owner, minlength=len(y))
    w, b = np.zeros(len(words)), -5.0
    m1, m2 = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    r = np.random.default_rng(seed)
    for i in range(1, steps + 1):
        mask = r.random(len(w)) < share_kept
        t = b + np.bincount(s, (w * mask)[col], len(key))
        total = np.bincount(owner, _softplus(t), len(y)) + plain * _softplus(np.float64(b))
        total = np.maximum(total, 1e-9)
        pull = np.where(y > 0.5, -1 / np.expm1(np.minimum(total, 500)), 1.0) / max(len(y), 1)
        dt = pull[owner] / (1 + np.exp(-t))
        grad = np.append(np.bincount(col, dt[s], len(words)) * mask + decay * w, dt.sum() + (pull * plain).sum() / (1 + np.exp(-b)))
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        move = rate * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.999**i)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    strong = np.abs(w) > 0.05
    return Model(words[strong], w[strong], float(b))


def sample_features(sample: DataFrame) -> DataFrame:
    """(ticket, label, instances, feature, instance) from (ticket, label, text): features of whole texts, each once in an instance."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_slices(b.column("text")):
                feature, row, instance, count = instances(data, offsets)
                order = np.lexsort((feature, instance, row))
                feature, row, instance = feature[order], row[order], instance[order]
                new = np.concatenate(([True], (feature[1:] != feature[:-1]) | (instance[1:] != instance[:-1]) | (row[1:] != row[:-1])))[: len(row)]
                bounds = pa.array(np.searchsorted(row[new], np.arange(end - first + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (feature[new].view(np.int64), instance[new].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column("ticket").slice(first, end - first), b.column("label").slice(first, end - first), pa.array(count + (count > 0)), *lists], ["ticket", "label", "instances", "feature", "instance"])

    return sample.mapInArrow(encode, "ticket string, label double, instances long, feature array<bigint>, instance array<int>")


def select_features(features: DataFrame, min_docs: int = 3, max_words: int = 3000) -> np.ndarray:
    """At most max_words feature hashes, ascending: the largest gains of likelihood from a rate of their own.

    Documents and hits are counted on the executors; only gains that chance among so many features cannot give count."""
    n, toxic = features.agg(F.count("*"), F.sum("label")).first()
    rate = min(max((toxic or 0) / max(n, 1), 1e-6), 1 - 1e-6)
    counted = features.select("label", F.explode(F.array_distinct("feature")).alias("feature")).groupBy("feature").agg(F.count("*").alias("df"), F.sum("label").alias("hits"))
    counted = written(counted.where(F.col("df") >= min_docs), "toxicity-counts")
    share = F.col("hits") / F.col("df")
    misses = F.when(F.col("df") > F.col("hits"), (F.col("df") - F.col("hits")) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    gain = counted.where(share > rate).select("feature", (F.col("hits") * F.log(share / rate) + misses).alias("gain"))
    gain = gain.where(F.col("gain") >= math.log(max(counted.count(), 2)))
    best = gain.orderBy(F.desc("gain"), "feature").limit(max_words).collect()
    return np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64))


def _known(words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the hashes that are among ascending words, their places there)."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    found = np.flatnonzero(words[at] == h)
    return found, at[found]


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_chars: int = MAX_CHARS) -> Model | None:
    """Fit on at most max_labelled labelled documents of at most max_chars code points together; None without any of them.

    The driver receives the cells (document, instance, feature) of chosen features only."""
    features = written(sample_features(bounded_sample(docs, labels, label_col, max_labelled, max_chars, id_col, text_col)), "toxicity-features")
    words = select_features(features)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, h = b.column("feature").offsets.to_numpy(), b.column("feature").values.to_numpy().view(np.uint64)
            found, col = _known(words, h)
            cut = np.searchsorted(found, bounds)
            pack = lambda a: pa.array([a[i:j].astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column("ticket"), b.column("label"), b.column("instances"), pack(col), pack(b.column("instance").values.to_numpy()[found])], ["ticket", "label", "instances", "col", "instance"])

    got = features.mapInArrow(cells, "ticket string, label double, instances long, col binary, instance binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values("ticket", ignore_index=True)  # the fit must not depend on the order of partitions
    doc = np.repeat(np.arange(len(got), dtype=np.int32), [len(x) // 4 for x in got["col"]])
    col, instance = (np.frombuffer(b"".join(got[x]), np.int32) for x in ("col", "instance"))
    return train(words, col, doc, instance, got["instances"].to_numpy(), got["label"].to_numpy())


def score_toxicity(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_sentences, offending.

    offending: (sentence, score, text) of every sentence whose own score reaches the threshold, in order;
    the text runs from its first to its last letter.  Texts without a letter (also null) have no
    sentence and score 0; without a model every score is 0.  Repeated rows are scored alike, texts of
    any length as a whole, other columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = d.schema["doc_id"].dataType.simpleString()
    found_type = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_slices(b.column("text")):
                n = end - first
                p, found, count = np.zeros(n), [[] for _ in range(n)], np.zeros(n, np.int64)
                if model is not None:
                    feature, row, instance, count = instances(data, offsets)
                    base = np.concatenate(([0], np.cumsum(count + (count > 0))))
                    hot, at = _known(model.words, feature)
                    # A feature counts once in an instance.
                    cell = np.unique((base[row[hot]] + instance[hot]) * len(model.words) + at) if len(hot) else np.zeros(0, np.int64)
                    t = model.bias + np.bincount(cell // max(len(model.words), 1), model.weights[cell % max(len(model.words), 1)], int(base[-1]))
                    owner = np.repeat(np.arange(n), np.diff(base))
                    p = -np.expm1(-np.bincount(owner, _softplus(t), n))
                    sentence = np.ones(int(base[-1]), bool)
                    sentence[base[1:][count > 0] - 1] = False
                    t, owner, base = t[sentence], owner[sentence], np.concatenate(([0], np.cumsum(count)))
                    own = 1 / (1 + np.exp(-t))
                    bad = np.flatnonzero(own >= threshold)
                    if len(bad):
                        starts, ends, own_row = runs(_LETTER[data], offsets)
                        stops = np.cumsum(_STOP[data])[starts]
                        which = np.cumsum(np.concatenate(([0], (stops[1:] != stops[:-1]) | (own_row[1:] != own_row[:-1]))))
                        lo, hi = np.searchsorted(which, bad), np.searchsorted(which, bad, "right") - 1
                        for k, i, j in zip(bad, lo, hi):
                            found[owner[k]].append({"sentence": int(k - base[owner[k]]), "score": float(own[k]), "text": data[starts[i] : ends[j]].tobytes().decode("utf-8", "replace")})
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, n), pa.array(p), pa.array(count.astype(np.int32)), pa.array(found, found_type)], ["doc_id", "score", "n_sentences", "offending"])

    out = d.mapInArrow(score, f"doc_id {id_type}, score double, n_sentences int, offending array<struct<sentence:int,score:double,text:string>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending")

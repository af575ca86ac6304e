"""N-gram Jaccard join by the chosen-path method.

Sets are the distinct five-word shingles of whole texts.  A path of tokens is chosen at random but alike
for all sets: at every node a set x follows token t when a hash of (path, t) falls below c / (lambda |x|).
Two sets with Jaccard similarity of at least lambda share an expected c children of a shared node, so the
paths that both follow are a branching process.  With c > 1 it survives any number of levels with a
probability of at least p = 1 - exp(-c p); runs are repeated until the target recall.

In tables:

1. texts -> (document, 128-bit signature of its set, |set|, first-level paths of all runs, embedding of
   64 MinHash values), one pass;
2. equal sets form a class; only one row per class goes on, however many copies it has;
3. paths with one class are dropped.  Paths with up to `leaf_size` classes are leaves.  Larger ones are
   split on further sampled tokens, which the embedding holds (coordinate i is the set's smallest token
   under hash i, so two sets share it with a probability of their similarity).  A path whose classes
   mostly agree in one coordinate, of which two bits are counted beforehand, would not fall apart: it is
   a leaf of any size;
4. inside leaves the embeddings of all pairs are compared, and only classes with a likely partner stay.
   A leaf of one block falls into the components of its likely pairs, which are named by their members, so
   that a component that several leaves hold goes on once.
   A pair at the threshold is lost here with a probability of at most a hundredth of what
   `target_recall` leaves, whatever the threshold and the number of coordinates;
5. leaves that lie inside another are dropped, the others compared by brute force on the token sets, as the
   product of the set-by-token matrix, large ones in pairs of blocks of bounded rows and tokens.  A pair
   that meets in several leaves counts in the smallest of them only, so links are counted without ever
   emitting the pairs;
6. blocks return, for each class, its number of links and a spanning forest of them; connected
   components over the forests give the groups.

Joins on paths, groups and classes have plain tables on both sides, so that Spark can split a hot one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import IS_WHITE, mix, run_hashes, runs, text_slices
from .common import keep_matching, written

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
TOP = float(1 << 64)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    target_recall: float = 0.999
    leaf_size: int = 200
    max_depth: int = 10
    block: int = 1000
    block_tokens: int = 400_000
    coordinates: int = 64
    children: float = 1.75
    #: A path whose classes agree to this degree does not fall apart and is not split on.
    tight: float = 0.7

    @property
    def sketch_loss(self) -> float:
        """Bound on the share of pairs at the threshold that the comparison of embeddings loses."""
        return (1 - self.target_recall) / 100

    @property
    def likely(self) -> int:
        """Equal coordinates of a likely pair: a lower quantile of the binomial (36 of 64 at 0.8)."""
        below = 0.0
        for k in range(self.coordinates + 1):
            below += self._equal(k)
            if below > self.sketch_loss:
                return k
        return self.coordinates

    def _equal(self, k: int) -> float:
        """Probability that a pair at the threshold agrees in k coordinates."""
        n, p = self.coordinates, self.threshold
        return math.comb(n, k) * p**k * (1 - p) ** (n - k)

    @property
    def runs(self) -> int:
        """Runs that miss a pair at the threshold with a probability of at most 1 - target_recall.

        All runs split on the same coordinates, so the number of those that agree is averaged over."""
        chances = []
        for k in range(self.coordinates + 1):
            below = 1.0
            for _ in range(self.max_depth - 1):
                below = 1 - math.exp(-self.children * k / (self.coordinates * self.threshold) * below)
            chances.append((self._equal(k), math.exp(-self.children * below)))
        for n in range(1, 10_000):
            if sum(p * missed**n for p, missed in chances) <= 1 - self.target_recall - self.sketch_loss:
                return n
        raise ValueError("no number of runs reaches target_recall")

    @property
    def ratio(self) -> tuple[int, int]:
        """The threshold as a fraction, for exact comparison."""
        return round(self.threshold * 10_000), 10_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, row), sorted by row and token, each token once per row.

    A row with fewer words than a shingle has one token for all of its words; without words none."""
    starts, ends, row = runs(~IS_WHITE[data], offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), row
    h = run_hashes(data, starts, ends)
    n = len(h)
    count = np.bincount(row, minlength=len(offsets) - 1)
    left = np.concatenate(([0], np.cumsum(count)))[row + 1] - np.arange(n)  # words from here to the row's end
    token = np.zeros(n, np.uint64)
    for k in range(words):
        nxt = np.zeros(n, np.uint64)
        nxt[: max(n - k, 0)] = h[k:]
        token = np.where(left > k, mix(token * _K1 + nxt + np.uint64(k + 1)), token)
    whole = (left >= words) | ((left == count[row]) & (count[row] < words))
    token, row = token[whole], row[whole]
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (row[1:] != row[:-1])))
    return token[new], row[new]


def _chosen(token: np.ndarray, size: np.ndarray, path: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of each chosen token, child path): about `share` tokens of a set; size: the set size at each token."""
    h = mix(token ^ mix(path + _K2))
    limit = np.minimum(TOP * share / size, TOP * (1 - 2.0**-53))
    take = np.flatnonzero((h.astype(np.float64) < limit) | (size <= share))
    return take, mix(h[take] * _K1 + token[take])


def embedding(token: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash values [rows, coordinates] of 16 bits of consecutive sets that begin at `bounds`."""
    out = np.empty((len(bounds), coordinates), np.uint16)
    seeds = mix(np.arange(1, coordinates + 1, dtype=np.uint64) * _K1)
    for i, seed in enumerate(seeds):
        h = (token ^ seed) * (seed | np.uint64(1))
        h ^= h >> np.uint64(32)
        h *= _K2
        out[:, i] = (mix(np.minimum.reduceat(h, bounds)) >> np.uint64(48)).astype(np.uint16)
    return out


def _probe(sketch: np.ndarray, row: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Two bits of one coordinate of each row's sketch, in lanes of 32 bits; the path chooses the coordinate."""
    value = sketch[row, (mix(path ^ _K1) % np.uint64(sketch.shape[1])).astype(np.int64)]
    h = mix(value.astype(np.uint64) + path * _K1)
    return ((h & np.uint64(1)) | ((h & np.uint64(2)) << np.uint64(31))).view(np.int64)


def signatures(docs: DataFrame, s: Settings, id_col: str, text_col: str, with_paths: bool, with_text: bool) -> DataFrame:
    """(doc_id, key, n [, paths, probes, sketch] [, text]): one row per document with words."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_slices(b.column("text")):
                token, row = shingle_sets(data, offsets, s.words)
                bounds = np.searchsorted(row, np.arange(end - first + 1))
                have = np.flatnonzero(np.diff(bounds))
                if not len(have):
                    continue
                size = np.diff(bounds)[have]
                one = np.add.reduceat(mix(token + _K1), bounds[have])
                two = np.add.reduceat(mix(token * _K2), bounds[have])
                key = np.stack([mix(one + size.astype(np.uint64)), mix(two)], 1)
                columns = {"doc_id": b.column("doc_id").slice(first, end - first).take(pa.array(have)), "key": pa.array([k.tobytes() for k in key], pa.binary()), "n": pa.array(size.astype(np.int32))}
                if with_paths:
                    per, owner, child = np.diff(bounds)[row].astype(np.float64), [], []
                    for r in range(s.runs):
                        take, path = _chosen(token, per, np.full(1, r, np.uint64), s.children / s.threshold)
                        owner.append(row[take])
                        child.append(path)
                    owner, child = np.concatenate(owner), np.concatenate(child)
                    order = np.argsort(owner, kind="stable")
                    ends = np.searchsorted(owner[order], have, "right")
                    sketch, child = embedding(token, bounds[have], s.coordinates), child[order]
                    probes = _probe(sketch, np.searchsorted(have, owner[order]), child)
                    for name, values in (("paths", child.view(np.int64)), ("probes", probes)):
                        columns[name] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values))
                    columns["sketch"] = pa.array([x.tobytes() for x in sketch], pa.binary())
                if with_text:
                    columns["text"] = b.column("text").slice(first, end - first).take(pa.array(have))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return d.mapInArrow(run, f"doc_id {id_type}, key binary, n int" + ", paths array<bigint>, probes array<bigint>, sketch binary" * with_paths + ", text string" * with_text)


def _split(rows: DataFrame, s: Settings) -> DataFrame:
    """(key, path, probe) of the children of (key, path, sketch): coordinates sampled alike for all rows of a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = mix(np.arange(1, s.coordinates + 1, dtype=np.uint64) * _K2)
        limit = np.uint64(min(TOP * s.children / (s.threshold * s.coordinates), TOP * (1 - 2.0**-53)))
        for b in batches:
            if not len(b):
                continue
            path = b.column("path").to_numpy().view(np.uint64)
            sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint16).reshape(len(b), s.coordinates)
            row, i = np.nonzero(mix(mix(path + _K1)[:, None] ^ place) < limit)
            child = mix(mix(path[row] * _K1 + place[i]) + sketch[row, i].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(row)), pa.array(child.view(np.int64)), pa.array(_probe(sketch, row, child))], ["key", "path", "probe"])

    return rows.select("key", "path", "sketch").mapInArrow(run, "key binary, path bigint, probe bigint")


def _placed(leaf: DataFrame, s: Settings, tokens: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(leaf, left, right, part, parts, key, *more) for every pair of blocks of a leaf, from (path, members, key, *more).

    Blocks have about s.block rows and, where a column tells the tokens of the leaf, at most about s.block_tokens tokens."""
    parts = F.ceil(F.col("members") / s.block).cast("int")
    if tokens:
        parts = F.least(F.col("members"), F.greatest(parts, F.ceil(F.col(tokens) / s.block_tokens))).cast("int")
    placed = leaf.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("key"), parts).cast("int")})
    placed = placed.select("path", "key", "part", "parts", *more, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return placed.select(F.col("path").alias("leaf"), F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part", "parts", "key", *more)


def _together(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("leaf", "left", "right").sortWithinPartitions("leaf", "left", "right")


def _with_likely_partner(blocks: DataFrame, s: Settings) -> DataFrame:
    """(path, key, n) of the rows that have a likely partner in their block, by size and embedding.

    The path is that of a component of likely pairs, or the leaf's own where it has several blocks.
    blocks: leaf, left, right, part, parts, key, n, sketch; rows of a block lie together."""
    (top, bottom), least = s.ratio, s.likely
    count = np.uint8 if s.coordinates < 256 else np.uint16

    def likely(n: np.ndarray, sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        small, large = np.minimum(n[a][:, None], n[b]), np.maximum(n[a][:, None], n[b])
        if len(a) * len(b) <= 4096:
            equal = (sketch[a][:, None, :] == sketch[b]).sum(2)
        else:
            equal = np.zeros((len(a), len(b)), count)
            for i in range(sketch.shape[1]):
                equal += sketch[a, i][:, None] == sketch[b, i]
        return (equal >= least) & (small * bottom >= large * top)

    def named(keys: list[bytes], n: np.ndarray, members: np.ndarray) -> list[tuple]:
        """Rows of a component, under a path that follows from its keys."""
        total = sum(int.from_bytes(keys[i][:8], "little") for i in members) * int(_K1) % (1 << 64)
        path = total - (1 << 64) * (total >> 63)
        return [(path, keys[i], int(n[i])) for i in members]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # parts of the block that the last batch ended in

        def solve(pieces: list[tuple]) -> list[tuple]:
            head, rest = pieces[0][0], [x[1:] for x in pieces]
            part, n, sketch = (np.concatenate([x[i] for x in rest]) for i in range(3))
            keys = [k for x in rest for k in x[3]]
            (leaf, left, right, parts), everyone = head, np.arange(len(n))
            if len(n) == 2 and parts == 1:
                good = (sketch[0] == sketch[1]).sum() >= least and min(n) * bottom >= max(n) * top
                return named(keys, n, everyone) if good else []
            if left != right:
                a, b = np.flatnonzero(part == left), np.flatnonzero(part != left)
                if not len(a) or not len(b):
                    return []
                pair = likely(n, sketch, a, b)
                return [(leaf, keys[i], int(n[i])) for i in np.concatenate((a[pair.any(1)], b[pair.any(0)]))]
            pair = likely(n, sketch, everyone, everyone)
            np.fill_diagonal(pair, False)
            if parts > 1:
                return [(leaf, keys[i], int(n[i])) for i in np.flatnonzero(pair.any(1))]
            return [row for members in _components(pair) for row in named(keys, n, members)]

        def emit(found: list[tuple]) -> pa.RecordBatch:
            at, key, n = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(key, pa.binary()), pa.array(n, pa.int64())], ["path", "key", "n"])

        for b in batches:
            if not len(b):
                continue
            leaf, left, right, part, parts = (b.column(x).to_numpy(zero_copy_only=False) for x in ("leaf", "left", "right", "part", "parts"))
            n, keys = b.column("n").to_numpy().astype(np.int64), b.column("key").to_pylist()
            sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint16).reshape(len(b), s.coordinates)
            new = np.flatnonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
            out: list[tuple] = []
            for i, j in zip(new, [*new[1:], len(b)]):
                head = (int(leaf[i]), int(left[i]), int(right[i]), int(parts[i]))
                if held and held[0][0] != head:
                    out += solve(held)
                    held = []
                held.append((head, part[i:j].copy(), n[i:j].copy(), sketch[i:j].copy(), keys[i:j]))
            yield emit(out)
        if held:
            yield emit(solve(held))

    return blocks.select("leaf", "left", "right", "part", "parts", "key", "n", "sketch").mapInArrow(run, "path bigint, key binary, n bigint")


def _compare(sizes: np.ndarray, sets: list[np.ndarray], marks: list[np.ndarray], left: int, here: int, s: Settings) -> np.ndarray:
    """Boolean matrix of linked pairs of a block that count in this leaf (`here`).

    left: pairs inside the block if 0, else rows before `left` against the others."""
    m = len(sets)
    a, b = (np.arange(m), np.arange(m)) if not left else (np.arange(left), np.arange(left, m))

    def product(lists: list[np.ndarray]) -> np.ndarray:
        owner = np.repeat(np.arange(m), [len(x) for x in lists])
        values = np.concatenate(lists)
        _, code, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = count[code] > 1
        owner = owner[shared]
        _, code = np.unique(code[shared], return_inverse=True)
        out = np.zeros((len(a), len(b)), np.float32)
        width, order = 1024, np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        for first in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            i, j = np.searchsorted(code, [first, first + width])
            x = np.zeros((m, min(width, int(code[-1]) + 1 - first)), np.float32)
            x[owner[i:j], code[i:j] - first] = 1
            out += x[a] @ x[b].T
        return out

    common = np.rint(product(sets)).astype(np.int64)
    top, bottom = s.ratio
    union = sizes[a][:, None] + sizes[b][None, :] - common
    linked = common * bottom >= union * top
    if not left:
        np.fill_diagonal(linked, False)
    if linked.any():
        earlier = [x[x < here] for x in marks]
        if any(len(x) for x in earlier):
            linked &= product(earlier) < 0.5
    return linked


def _components(linked: np.ndarray) -> list[np.ndarray]:
    """Components of two members or more of a symmetric boolean matrix."""
    left, out = linked.any(1), []
    while left.any():
        front = np.zeros(len(left), bool)
        front[np.argmax(left)] = True
        mine = front.copy()
        while front.any():
            front = linked[front].any(0) & ~mine
            mine |= front
        left &= ~mine
        out.append(np.flatnonzero(mine))
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    seen, out = np.zeros(len(linked), bool), []
    for root in np.flatnonzero(linked.any(1)):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & ~seen)
            seen[new] = True
            out += [(int(at), int(x)) for x in new]
            front += new.tolist()
    return out


def _brute_force(blocks: DataFrame, s: Settings) -> DataFrame:
    """(key, parent, n_links, n_link_docs) from rows of blocks that lie together.

    blocks: leaf, left, right (block numbers), part, key, copies, n, text, leaves; sorted by block.
    Texts take less room than their tokens until they are here."""
    names = ["leaf", "left", "right", "part", "key", "copies", "n", "text", "leaves"]

    def solve(rows: list[tuple]) -> list[tuple]:
        leaf, left, right = rows[0][:3]
        rows = sorted(rows, key=lambda r: (r[3], r[4]))
        keys, copies = [r[4] for r in rows], np.array([r[5] for r in rows], np.int64)
        edge = 0 if left == right else sum(r[3] == left for r in rows)
        if left != right and edge in (0, len(rows)):
            return []
        linked = _compare(np.array([r[6] for r in rows], np.int64), [r[7] for r in rows], [r[8] for r in rows], edge, leaf, s)
        if not linked.any():
            return []
        if edge:
            whole = np.zeros((len(rows), len(rows)), bool)
            whole[:edge, edge:] = linked
            linked = whole | whole.T
        links, docs = linked.sum(1), linked @ copies
        out = [(keys[i], None, int(links[i]), int(docs[i])) for i in np.flatnonzero(links)]
        return out + [(keys[j], keys[i], 0, 0) for i, j in _forest(linked)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            key, parent, links, docs = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(parent, pa.binary()), pa.array(links, pa.int64()), pa.array(docs, pa.int64())], ["key", "parent", "n_links", "n_link_docs"])

        for b in batches:
            c = {x: b.column(x) for x in names}
            plain = {x: c[x].to_numpy(zero_copy_only=False) for x in ("leaf", "left", "right", "part", "copies", "n")}
            keys = c["key"].to_pylist()
            l_at, l_all = c["leaves"].offsets.to_numpy(), c["leaves"].values.to_numpy()
            for first, end, data, offsets in text_slices(c["text"]):
                token, row = shingle_sets(data, offsets, s.words)
                t_at = np.searchsorted(row, np.arange(end - first + 1))
                for i in range(first, end):
                    head = (int(plain["leaf"][i]), int(plain["left"][i]), int(plain["right"][i]))
                    if held and held[0][:3] != head:
                        out += solve(held)
                        held = []
                    tokens = token[t_at[i - first] : t_at[i - first + 1]].copy()
                    held.append((*head, int(plain["part"][i]), keys[i], int(plain["copies"][i]), int(plain["n"][i]), tokens, l_all[l_at[i] : l_at[i + 1]].copy()))
            if len(out) > 20_000:
                yield emit()
        if held:
            out += solve(held)
        if out:
            yield emit()

    return blocks.select(names).mapInArrow(run, "key binary, parent binary, n_links bigint, n_link_docs bigint")


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(key, root): smallest key of each component of undirected edges (key, parent).

    Min-label propagation with pointer jumping; each round is written to the shared folder."""
    both = edges.select("key", "parent").unionByName(edges.select(F.col("parent").alias("key"), F.col("key").alias("parent"))).distinct()
    both = written(both, "jaccard-edges")
    labels = written(both.groupBy("key").agg(F.min("parent").alias("near")).select("key", F.least("key", "near").alias("root")), "jaccard-labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("key").alias("parent"), F.col("root").alias("other")), "parent").groupBy("key").agg(F.min("other").alias("other"))
        hop = labels.join(near, "key").select("key", "root", F.least("root", "other").alias("low"))
        jump = hop.join(labels.select(F.col("key").alias("low"), F.col("root").alias("lower")), "low", "left")
        new = written(jump.select("key", F.least("low", F.coalesce("lower", "low")).alias("next"), "root"), "jaccard-labels")
        moved = new.where("next <> root").limit(1).count()
        labels = new.select("key", F.col("next").alias("root"))
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def jaccard_join(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, group_id, n_shingles, n_copies, n_links, n_link_docs.

    class_id: smallest id of the documents with the same set; group_id: smallest id of those linked to
    it, directly or through others; n_copies: rows in the class; n_links: other classes with similarity
    of at least the threshold, n_link_docs: rows in them.  A text with fewer words than a shingle is one
    shingle of all its words.  Null and blank texts have no set: each is a class and group of its own,
    with n_copies 1.  A null id is larger than all others.  Repeated rows are copies; other columns are
    ignored; an empty table gives an empty result.
    """
    s = settings or Settings()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    member = written(signatures(source, s, "doc_id", "text", True, False), "jaccard-members")
    # Ids are counted apart, so that paths and embeddings are shuffled once.
    per_id = member.groupBy("key", "doc_id").agg(F.count("*").alias("rows"))
    counts = per_id.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.sum("rows").alias("copies"), F.max("rows").alias("most_rows"))
    classes = counts.join(member.groupBy("key").agg(*[F.first(x).alias(x) for x in ("n", "paths", "probes", "sketch")]), "key")
    classes = written(classes, "jaccard-classes")
    about = classes.select("key", "n", "sketch")

    def grouped(rows: DataFrame) -> DataFrame:
        """rows (path, key) with `members` and `tight` of paths with two classes or more."""
        counted = rows.groupBy("path").agg(F.count("*").alias("members"), F.sum("probe").alias("bits")).where("members > 1")
        agree = lambda ones: F.abs(ones * 2 - F.col("members")) > F.col("members") * s.tight
        tight = agree(F.col("bits").bitwiseAND(F.lit((1 << 32) - 1))) & agree(F.shiftright("bits", 32))
        counted = written(counted.select("path", "members", tight.alias("tight")), "jaccard-counted")
        return written(rows.drop("probe").join(counted, "path"), "jaccard-level")

    rows = classes.select("key", F.inline(F.arrays_zip(F.col("paths").alias("path"), F.col("probes").alias("probe"))))
    level, leaves = grouped(rows), []
    for depth in range(1, s.max_depth + 1):
        end = F.lit(depth == s.max_depth) | (F.col("members") <= s.leaf_size) | F.col("tight")
        leaves.append(level.where(end).select("path", "members", "key"))
        large = level.where(~end).select("path", "key")
        if not large.limit(1).count():
            break
        level = grouped(written(_split(large.join(about, "key"), s), "jaccard-split"))
    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.unionByName(more)
    likely = written(_with_likely_partner(_together(_placed(leaf, s).join(about, "key")), s).distinct(), "jaccard-likely")

    # Leaves with the same members are compared once.
    member_sum = lambda seed: F.sum(F.xxhash64("key", F.lit(seed)).cast("decimal(38,0)")).alias(f"sum{seed}")
    marks = likely.groupBy("path").agg(F.count("*").alias("members"), F.sum("n").alias("leaf_tokens"), member_sum(1), member_sum(2)).where("members > 1")
    kept = written(marks.groupBy("members", "sum1", "sum2").agg(F.min(F.struct("path", "leaf_tokens")).alias("one")).select("one.path", "members", "one.leaf_tokens"), "jaccard-kept")
    leaf = written(likely.drop("n").join(kept, "path"), "jaccard-leaves")
    # A leaf whose members all have one and the same other leaf as their largest lies inside that leaf.
    largest = leaf.groupBy("key").agg(F.max(F.struct("members", "path")).alias("big")).select("key", F.col("big.path").alias("big"))
    inner = leaf.join(largest, "key").groupBy("path").agg(F.min("big").alias("low"), F.max("big").alias("high")).where("low = high and low <> path")
    leaf = written(leaf.join(written(inner.select("path"), "jaccard-inner"), "path", "left_anti"), "jaccard-outer-leaves")
    mine = leaf.groupBy("key").agg(F.collect_list(F.struct("path", "members", "leaf_tokens")).alias("leaves"))
    live = classes.select("key", "class_id", "copies", "most_rows").join(mine, "key")
    live = written(live, "jaccard-live")
    again = keep_matching(source, live.select(F.col("class_id").alias("doc_id")), ["doc_id"])
    if live.where("class_id is null").limit(1).count():
        again = again.unionByName(source.where("doc_id is null"))
    texts = signatures(again, s, "doc_id", "text", False, True)
    # One row of each class: that of its smallest id, of which there can be several.
    info = texts.join(live.select("key", "class_id", "copies", "leaves"), "key").where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    if live.where("most_rows > 1").limit(1).count():
        info = info.dropDuplicates(["key"])
    # Texts go to their blocks from here; a table of them in between would be one more copy and one more shuffle.
    info = info.select("key", "n", "text", "copies", F.col("leaves.path").alias("leaves"), F.inline("leaves"))
    blocks = _together(_placed(info, s, "leaf_tokens", ("copies", "n", "text", "leaves")))
    found = written(_brute_force(blocks, s), "jaccard-found")
    links = found.groupBy("key").agg(F.sum("n_links").alias("n_links"), F.sum("n_link_docs").alias("n_link_docs"))
    roots = connected(found.where("parent is not null"))
    named = roots.join(classes.select("key", "class_id"), "key").withColumn("order", F.struct(F.col("class_id").isNull(), "class_id"))
    groups = written(named.groupBy("root").agg(F.min("order").alias("low")), "jaccard-groups")
    linked = roots.join(groups, "root").join(links, "key").select("key", F.col("low.class_id").alias("group_id"), "n_links", "n_link_docs")
    described = classes.select("key", "class_id", "copies", "n").join(linked, "key", "left")
    described = described.select("key", "class_id", F.when(F.col("n_links").isNull(), F.col("class_id")).otherwise(F.col("group_id")).alias("group_id"), F.col("n").alias("n_shingles"), F.col("copies").alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_link_docs", F.lit(0)).alias("n_link_docs"))
    whole = member.select("doc_id", "key").join(written(described, "jaccard-described"), "key").drop("key")
    blank = source.where(F.coalesce(F.regexp_instr("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) == 0)
    zero = lambda name, kind: F.lit(0).cast(kind).alias(name)
    none = blank.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), zero("n_shingles", "int"), F.lit(1).cast("long").alias("n_copies"), zero("n_links", "long"), zero("n_link_docs", "long"))
    return whole.unionByName(none)

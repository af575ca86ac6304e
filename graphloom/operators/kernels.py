"""Array kernels over whole samples: Spark deals rows by sample and sorts them, NumPy works on batches of samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a kernel gets at a time, if no single sample has more.
BATCH_ROWS = 1 << 17

Kernel = Callable[[pa.Table, np.ndarray], pa.Table]


def sample_codes(table: pa.Table) -> np.ndarray:
    """Number of each row's sample, 0, 1, .. in order of appearance."""
    return table["sample_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy()


def per_sample(rows: DataFrame, kernel: Kernel, schema: str, order: list[str | Column] | None = None, limit: int = BATCH_ROWS) -> DataFrame:
    """Apply `kernel` to batches of complete samples: it gets their rows, by sample and `order`, and sample_codes of them.

    Rows are numbered within samples, which sorts them by sample and shuffles them only if they are not dealt
    out by sample_id yet; a task holds `limit` rows or its largest sample."""
    names = rows.columns
    dealt = rows.withColumn("_place", F.row_number().over(Window.partitionBy("sample_id").orderBy(*(order or ["sample_id"]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, wait = [], 0, limit
        for b in batches:
            if not len(b):
                continue
            b = b.select(names)
            held.append(b)
            size += len(b)
            if size < wait:
                continue
            table = pa.Table.from_batches(held)
            code = sample_codes(table)
            last = int(np.searchsorted(code, code[-1]))
            if last:
                yield from kernel(table.slice(0, last), code[:last]).to_batches()
            held = table.slice(last).to_batches()
            size -= last
            wait = max(limit, 2 * size)
        if size:
            table = pa.Table.from_batches(held)
            yield from kernel(table, sample_codes(table)).to_batches()

    return dealt.mapInArrow(run, schema)


def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy() for n in names]


def dense(code: np.ndarray, *nodes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(numbers of (sample, node) for each array, sample and node by number); numbers ascend by both."""
    known, at = np.unique(np.concatenate(nodes), return_inverse=True)
    keys = np.concatenate([code] * len(nodes)).astype(np.int64) * len(known) + at
    key, place = np.unique(keys, return_inverse=True)
    return np.split(place, len(nodes)), key // max(len(known), 1), known[key % max(len(known), 1)]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges of the spanning forest, component of each node) of edges a-b given in order of entry; nodes below n.

    Rounds in which every component takes its first edge to another; the order is total, so the forest is
    the one of edges that enter one after the other.  Components are named by their smallest node."""
    kept, label, alive = np.zeros(len(a), bool), np.arange(n), np.arange(len(a))
    while True:
        x, y = label[a[alive]], label[b[alive]]
        apart = x != y
        alive, x, y = alive[apart], x[apart], y[apart]
        if not len(alive):
            break
        first = np.full(n, len(a))
        np.minimum.at(first, x, alive)
        np.minimum.at(first, y, alive)
        root = np.flatnonzero(first < len(a))
        edge = first[root]
        kept[edge] = True
        ends = label[a[edge]], label[b[edge]]
        parent = np.arange(n)
        parent[root] = np.where(ends[0] == root, ends[1], ends[0])
        # Two components that chose the same edge point at each other; the smaller one leads.
        mutual = (parent[parent[root]] == root) & (root < parent[root])
        parent[root[mutual]] = root[mutual]
        while not np.array_equal(following := parent[parent], parent):
            parent = following
        label = parent[label]
    least = np.full(n, n)
    np.minimum.at(least, label, np.arange(n))
    return kept, least[label]


def grouped_list(values: pa.Array, owner: np.ndarray, groups: int) -> pa.ListArray:
    """Lists of values per group; owner: ascending group of each value."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(groups + 1)), pa.int32()), values)

"""Whole graphs: a row a sample with nodes and edges of several graphs as arrays, for kernels that need all of a sample.

A graph `name` has the columns <name>_nodes, an array of (node_id, d, h, w, ..), and <name>_edges, an array of
(src, dst, ..); null is empty.  Rows are complete, so that a kernel needs no order and no shuffle of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import AXES
from .kernels import forest

#: Nodes and edges that a kernel gets at a time, if no single sample has more.
ITEMS = 1 << 16


def whole_graphs(samples: DataFrame, graphs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(sample_id, <name>_nodes, <name>_edges) for every sample; graphs: name -> (nodes, edges).

    Scores and corners go along where tables have them."""
    out = samples.select("sample_id").where("sample_id is not null")
    for name, tables in graphs.items():
        for kind, keys, table in zip(("nodes", "edges"), (("node_id", *AXES), ("src", "dst")), tables):
            more = [*(["score"] if "score" in table.columns else []), *(["corners.*"] if "corners" in table.columns else [])]
            flat = table.select("sample_id", *keys, *more)
            lists = flat.groupBy("sample_id").agg(F.collect_list(F.struct(*flat.columns[1:])).alias(f"{name}_{kind}"))
            out = out.join(lists.hint("merge"), "sample_id", "left")
    return out


def _items(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """(row of each item, items)."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return np.repeat(np.arange(len(n)), n), lists.flatten()


@dataclass
class Graph:
    """One graph of each row of a batch: tables of nodes and edges, and what follows from them."""

    rows: int
    #: Row, number (ascending by row and id), items and coordinates of the nodes.
    code: np.ndarray
    number: np.ndarray
    items: pa.StructArray
    #: Row, items and ends of the edges: the place of a node, -1 where it is unknown.
    edge_code: np.ndarray
    edge_items: pa.StructArray
    src: np.ndarray
    dst: np.ndarray
    #: Row and place of each different node by number.
    owner: np.ndarray
    place: np.ndarray
    #: Canonical edges: numbers low < high of known nodes, each pair once, ascending.
    low: np.ndarray
    high: np.ndarray

    def field(self, name: str) -> np.ndarray:
        return self.items.field(name).to_numpy(zero_copy_only=False)

    @property
    def at(self) -> np.ndarray:
        """Coordinates of nodes [nodes, axes]."""
        return np.stack([self.field(a).astype(float) for a in AXES], 1)

    def counts(self) -> dict[str, np.ndarray]:
        """Nodes, edges and Betti numbers of each row."""
        total = lambda of: np.bincount(of, minlength=self.rows).astype(np.int32)
        _, label = forest(self.low, self.high, len(self.owner))
        n_nodes, n_edges, beta0 = total(self.owner), total(self.owner[self.low]), total(self.owner[label == np.arange(len(label))])
        return {"n_nodes": n_nodes, "n_edges": n_edges, "beta0": beta0, "beta1": n_edges - n_nodes + beta0}


def graph_of(batch: pa.RecordBatch, name: str) -> Graph:
    code, items = _items(batch.column(f"{name}_nodes"))
    edge_code, edges = _items(batch.column(f"{name}_edges"))
    ids, src, dst = items.field("node_id"), edges.field("src"), edges.field("dst")
    if src.null_count or dst.null_count:
        keep = pc.and_(src.is_valid(), dst.is_valid())
        edge_code, edges = edge_code[keep.to_numpy(zero_copy_only=False)], edges.filter(keep)
        src, dst = edges.field("src"), edges.field("dst")
    known, rank = np.unique(np.concatenate([x.to_numpy(zero_copy_only=False) for x in (ids, src, dst)]), return_inverse=True)
    own, a, b = np.split(rank, np.cumsum((len(ids), len(src))))
    wide = max(len(known), 1)
    key, place, number = np.unique(code * wide + own, return_index=True, return_inverse=True)

    def end(of: np.ndarray) -> np.ndarray:
        asked = edge_code * wide + of
        i = np.minimum(np.searchsorted(key, asked), max(len(key) - 1, 0))
        return np.where(key[i] == asked, i, -1) if len(key) else np.full(len(asked), -1)

    x, y = end(a), end(b)
    fit = (x >= 0) & (y >= 0) & (x != y)
    pairs = np.unique(np.minimum(x[fit], y[fit]) * max(len(key), 1) + np.maximum(x[fit], y[fit]))
    at = lambda i: np.where(i >= 0, place[i], -1) if len(place) else i
    return Graph(batch.num_rows, code, number, items, edge_code, edges, at(x), at(y), key // wide, place, pairs // max(len(key), 1), pairs % max(len(key), 1))


def per_graph(graphs: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply `kernel` to rows of whole graphs, of about ITEMS nodes and edges at a time."""
    lists = [x for x in graphs.columns if x.endswith(("_nodes", "_edges"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            items = np.cumsum(1 + sum(pc.fill_null(pc.list_value_length(b.column(x)), 0).to_numpy().astype(np.int64) for x in lists))
            cuts = [0, *(np.flatnonzero(np.diff(items // ITEMS)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:]):
                yield kernel(b.slice(i, j - i))

    return graphs.mapInArrow(run, schema)

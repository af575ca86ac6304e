"""Topology of sample graphs: components, Betti numbers, filtrations, forests, H0 and H1 matching.

Rows of all samples go through one shuffle on sample_id; forests of whole batches of samples come from one
array kernel, and what walks a forest step by step sees its few edges only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import AXES
from ..functions.storage import written
from .kernels import dense, forest, grouped_list, numbers, per_sample

TOLERANCE = 1e-12


def canonical_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected edges src < dst, each once; loops and edges to unknown nodes are dropped."""
    e = edges.select("sample_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct()
    known = nodes.groupBy("sample_id").agg(F.collect_set("node_id").alias("known"))  # a sample's nodes are few
    both = F.array_contains("known", F.col("src")) & F.array_contains("known", F.col("dst"))
    return e.join(known.hint("merge"), "sample_id").where(both).select("sample_id", "src", "dst")


def with_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with the coordinates src_d .. dst_w of both ends; edges to unknown nodes are dropped.

    A sample's nodes meet its edges as one array, so that all is by sample alone."""
    near = nodes.groupBy("sample_id").agg(F.collect_list(F.struct("node_id", *AXES)).alias("_nodes"))
    at = lambda p: F.get(F.filter("_nodes", lambda x: x["node_id"] == F.col(p)), F.lit(0)).alias(f"_{p}")
    both = edges.join(near.hint("merge"), "sample_id").select(*edges.columns, at("src"), at("dst")).where("_src is not null and _dst is not null")
    return both.select(*edges.columns, *[F.col(f"_{p}")[a].alias(f"{p}_{a}") for p in ("src", "dst") for a in AXES])


def _rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as rows (sample_id, kind, src, dst): kind 1 and 2."""
    kind = lambda k: F.lit(k).alias("kind")
    return nodes.select("sample_id", kind(1), F.col("node_id").alias("src"), F.col("node_id").alias("dst")).unionByName(edges.select("sample_id", kind(2), "src", "dst"))


def _graphs(kind: np.ndarray, src: np.ndarray, dst: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sample, node, component number) per known node, (sample of each canonical edge), known-node places, of _rows."""
    (a, b), sample, node = dense(code, src, dst)
    known = np.zeros(len(node), bool)
    known[a[kind == 1]] = True
    edge = (kind == 2) & (a != b)
    edge[edge] = known[a[edge]] & known[b[edge]]
    pairs = np.unique(np.stack((np.minimum(a[edge], b[edge]), np.maximum(a[edge], b[edge])), 1), axis=0)
    _, label = forest(pairs[:, 0], pairs[:, 1], len(node))
    return sample, node, label, sample[pairs[:, 0]], known


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, node_id, component): the component is named by its smallest node id."""

    def kernel(table: pa.Table, code: np.ndarray) -> pa.Table:
        sample, node, label, _, known = _graphs(*numbers(table, "kind", "src", "dst"), code)
        first = np.searchsorted(code, sample[known])
        return pa.table({"sample_id": table["sample_id"].take(pa.array(first)), "node_id": node[known], "component": node[label[known]]})

    types = {x: nodes.schema[x].dataType.simpleString() for x in ("sample_id", "node_id")}
    return per_sample(_rows(nodes, edges), kernel, f"sample_id {types['sample_id']}, node_id {types['node_id']}, component {types['node_id']}")


COUNTS = ("n_nodes", "n_edges", "beta0", "beta1")


def betti_numbers(samples: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, n_nodes, n_edges, beta0, beta1) for every sample; an empty graph has zeros."""
    return betti_of_graphs(samples, {"": (nodes, edges)})


def betti_of_graphs(samples: DataFrame, graphs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """betti_numbers of several graphs a sample, from one kernel; graphs: prefix of the columns -> (nodes, edges)."""
    zero = F.lit(0).cast(next(iter(graphs.values()))[0].schema["node_id"].dataType)
    rows = samples.select("sample_id", F.lit(0).alias("graph"), F.lit(0).alias("kind"), zero.alias("src"), zero.alias("dst"))
    for k, (nodes, edges) in enumerate(graphs.values()):
        rows = rows.unionByName(_rows(nodes, edges).withColumn("graph", F.lit(k)))
    count = len(graphs)

    def kernel(table: pa.Table, code: np.ndarray) -> pa.Table:
        kind, src, dst, graph = numbers(table, "kind", "src", "dst", "graph")
        sample, _, label, edge_sample, known = _graphs(kind, src, dst, code.astype(np.int64) * count + graph)
        n = (int(code[-1]) + 1) * count
        total = lambda of: np.bincount(of, minlength=n).astype(np.int32).reshape(-1, count)
        asked = np.unique(code[kind == 0])
        n_nodes, n_edges, beta0 = total(sample[known]), total(edge_sample), total(sample[known & (label == np.arange(len(label)))])
        found = dict(zip(COUNTS, (n_nodes, n_edges, beta0, n_edges - n_nodes + beta0)))
        return pa.table({"sample_id": table["sample_id"].take(pa.array(np.searchsorted(code, asked))), **{p + c: v[asked, k] for k, p in enumerate(prefixes) for c, v in found.items()}})

    prefixes = list(graphs)
    columns = ", ".join(f"{p}{c} int" for p in prefixes for c in COUNTS)
    return per_sample(rows, kernel, f"sample_id {samples.schema['sample_id'].dataType.simpleString()}, {columns}")


def graph_filtration(nodes: DataFrame, candidates: DataFrame, terminal: float = 1.0) -> DataFrame:
    """(sample_id, node_id, f): terminal * (1 - largest incident probability); isolated: terminal."""
    none = F.lit(None).cast(candidates.schema["p"].dataType)
    ends = candidates.select("sample_id", F.explode(F.array("src", "dst")).alias("node_id"), "p").groupBy("sample_id", "node_id").agg(F.max("p").alias("p")).withColumn("known", F.lit(False))
    rows = nodes.select("sample_id", "node_id", none.alias("p"), F.lit(True).alias("known")).unionByName(ends)
    best = rows.groupBy("sample_id", "node_id").agg(F.max("p").alias("p"), F.max("known").alias("known")).where("known")
    return best.select("sample_id", "node_id", (terminal * (1 - F.coalesce("p", F.lit(0.0)))).alias("f"))


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """edges (sample_id, src, dst, f) with `in_forest`; edges enter by (f, src, dst), and one that closes a cycle stays outside."""

    def kernel(table: pa.Table, code: np.ndarray) -> pa.Table:
        src, dst = numbers(table, "src", "dst")
        (a, b), sample, _ = dense(code, src, dst)
        return table.append_column("in_forest", pa.array(forest(a, b, len(sample))[0]))

    rows = edges.select("sample_id", "src", "dst", "f")
    return per_sample(rows, kernel, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema) + ", in_forest boolean", ["f", "src", "dst"])


# --- H0 -----------------------------------------------------------------------------------------


def elder_walk(edges: np.ndarray, a: np.ndarray, b: np.ndarray, sample: np.ndarray, births: list[np.ndarray]) -> list[np.ndarray]:
    """For each birth order, the vertex whose component ends at each of the forest `edges`, given in order of entry.

    Of two components that meet, the one whose eldest vertex is younger (later in birth, then number) ends.
    The walk is in lockstep: at step i the i-th edges of all samples enter at once."""
    owner = sample[a[edges]]
    by_sample = np.argsort(owner, kind="stable")
    sizes = np.bincount(owner, minlength=1)
    rank = np.empty(len(edges), np.int64)
    rank[by_sample] = np.arange(len(edges)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    turn = np.argsort(rank, kind="stable")
    steps = np.split(turn, np.cumsum(np.bincount(rank))[:-1]) if len(edges) else []
    n, ended = len(sample), [np.empty(len(edges), np.int64) for _ in births]
    for birth, ends in zip(births, ended, strict=True):
        eldest = np.arange(n)
        for step in steps:
            x, y = eldest[a[edges[step]]], eldest[b[edges[step]]]
            first = (birth[x] < birth[y]) | ((birth[x] == birth[y]) & (x < y))
            ends[step] = np.where(first, y, x)
            after = np.arange(n)
            after[ends[step]] = np.where(first, x, y)
            eldest = after[eldest]
    return ended


def _filtration(a: np.ndarray, b: np.ndarray, p: np.ndarray, n: int, terminal: float) -> tuple[np.ndarray, np.ndarray]:
    """(births of vertices, values of edges) of edge probabilities."""
    best = np.zeros(n)
    np.maximum.at(best, a, p)
    np.maximum.at(best, b, p)
    births = terminal * (1 - best)
    return births, np.maximum(terminal * (1 - p), np.maximum(births[a], births[b]))


def h0_matching(samples: DataFrame, candidates: DataFrame, terminal: float = 1.0) -> DataFrame:
    """H0 pairs of both sides: (sample_id, side, birth_vertex, birth, death, death_src, death_dst, matched, partner).

    samples: (sample_id, n_vertices); candidates: (sample_id, src, dst, p, is_true), each pair once.
    Components only meet at forest edges, so a walk has fewer steps than the largest sample has vertices."""
    marks = samples.select("sample_id", F.lit(True).alias("known"))
    id_type = samples.schema["sample_id"].dataType.simpleString()

    def kernel(table: pa.Table, code: np.ndarray) -> pa.Table:
        src, dst, p = numbers(table, "src", "dst", "p")
        truth = table["is_true"].to_numpy().astype(float)
        again = np.flatnonzero((src[1:] == src[:-1]) & (dst[1:] == dst[:-1]) & (code[1:] == code[:-1]))
        if len(again):
            raise ValueError(f"duplicate candidate edge in sample {table['sample_id'][int(again[0])]}")
        (a, b), sample, node = dense(code, src, dst)
        n = len(node)
        sides = {"prediction": _filtration(a, b, p, n, terminal), "target": _filtration(a, b, truth, n, terminal)}
        lower = tuple(np.minimum(x, y) for x, y in zip(*sides.values()))

        def entered(values: np.ndarray) -> np.ndarray:
            """Edges of the spanning forest in order of entry."""
            order = np.lexsort((b, a, values))
            return order[forest(a[order], b[order], n)[0]]

        death, partner = {}, {side: np.full(n, -1) for side in sides}
        for side, (births, values) in sides.items():
            edges = entered(values)
            (ends,) = elder_walk(edges, a, b, sample, [births])
            lasting = values[edges] - births[ends] > TOLERANCE
            death[side] = np.full(n, -1)
            death[side][ends[lasting]] = edges[lasting]
        # Both sides' components as the joint filtration merges them: ends at one edge are partners.
        edges = entered(lower[1])
        joint, x, y = elder_walk(edges, a, b, sample, [lower[0], sides["prediction"][0], sides["target"][0]])
        met = (lower[1][edges] - lower[0][joint] > TOLERANCE) & (death["prediction"][x] >= 0) & (death["target"][y] >= 0)
        partner["prediction"][x[met]], partner["target"][y[met]] = y[met], x[met]
        found = {side: np.flatnonzero(death[side] >= 0) for side in sides}
        names = np.repeat(list(sides), [len(v) for v in found.values()])
        vertex = np.concatenate(list(found.values()))
        edge, mate = (np.concatenate([x[side][found[side]] for side in sides]) for x in (death, partner))
        predicted = names == "prediction"
        pick = lambda i, at: np.where(predicted, sides["prediction"][i][at], sides["target"][i][at])
        return pa.table({
            "sample_id": table["sample_id"].take(pa.array(np.searchsorted(code, sample[vertex]))), "side": pa.array(names, pa.string()), "birth_vertex": node[vertex].astype(np.int32),
            "birth": pick(0, vertex), "death": pick(1, edge), "death_src": src[edge].astype(np.int32), "death_dst": dst[edge].astype(np.int32),
            "partner": pa.array(node[mate].astype(np.int32), mask=mate < 0),
        })

    known = candidates.join(marks.hint("merge"), "sample_id", "left_semi").select("sample_id", "src", "dst", F.col("p").cast("double").alias("p"), "is_true")
    out = per_sample(known, kernel, f"sample_id {id_type}, side string, birth_vertex int, birth double, death double, death_src int, death_dst int, partner int", ["src", "dst"])
    return out.withColumn("matched", F.col("partner").isNotNull())


def h0_pairs(samples: DataFrame, candidates: DataFrame, terminal: float = 1.0) -> DataFrame:
    """Persistence pairs of the predicted filtration alone."""
    return h0_matching(samples, candidates.withColumn("is_true", F.lit(False)), terminal).where("side = 'prediction'").drop("matched", "partner", "side")


def h0_loss(matching: DataFrame, unmatched_weight: float = 1.0, diagonal: float = 0.5) -> DataFrame:
    """(sample_id, matched, false, missed, loss) from the rows of h0_matching."""
    p = matching.where("side = 'prediction'")
    t = matching.where("side = 'target'").select("sample_id", F.col("birth_vertex").alias("partner"), F.col("birth").alias("t_birth"), F.col("death").alias("t_death"))
    pairs = p.where("matched").join(t.hint("merge"), ["sample_id", "partner"])
    term = F.pow(F.col("birth") - F.col("t_birth"), 2) + F.pow(F.col("death") - F.col("t_death"), 2)
    matched = pairs.select("sample_id", term.alias("term"), F.lit("matched").alias("kind"))
    alone = matching.where("not matched").select("sample_id", (unmatched_weight * diagonal * F.pow(F.col("death") - F.col("birth"), 2)).alias("term"), F.when(F.col("side") == "prediction", "false").otherwise("missed").alias("kind"))
    rows = matched.unionByName(alone)
    count = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k)
    out = rows.groupBy("sample_id").agg(count("matched"), count("false"), count("missed"), F.sum("term").alias("total"))
    ranks = F.col("matched") + F.col("false") + F.col("missed")
    return out.select("sample_id", "matched", "false", "missed", (F.col("total") / F.greatest(ranks, F.lit(1))).alias("loss"))


# --- H1 -----------------------------------------------------------------------------------------


def h1_classes(candidates: DataFrame) -> DataFrame:
    """(sample_id, src, dst, birth): live edges (p > 1e-12) that close a cycle, at f = 1 - p."""
    live = candidates.where(F.col("p") > TOLERANCE).withColumn("f", 1 - F.col("p"))
    return minimum_spanning_forest(live).where("not in_forest").select("sample_id", "src", "dst", F.col("f").alias("birth"))


def h1_matching(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranks, classes) of the H1 matching in closed form; a candidate that stands twice raises.

    ranks: sample_id, shared, false, missed, union_only; classes: h1_classes with `matched`.
    Prediction classes are the edges outside the forest of the live edges; shared ones those outside the
    forest of the live true edges; the rest follows from Betti numbers of edge sets.  One pass finds the
    four forests of a sample; its result, a row per sample, is written once for both tables."""

    def kernel(table: pa.Table, code: np.ndarray) -> pa.Table:
        src, dst, p, f = numbers(table, "src", "dst", "p", "f")
        true, live = table["is_true"].to_numpy(), p > TOLERANCE
        (a, b), node_sample, _ = dense(code, src, dst)
        pair = a.astype(np.int64) * len(node_sample) + b
        _, first = np.unique(pair, return_index=True)
        if len(first) < len(pair):
            twice = np.setdiff1d(np.arange(len(pair)), first)[0]
            raise ValueError(f"duplicate candidate edge in sample {table['sample_id'][int(twice)]}")
        n = int(code[-1]) + 1

        def outside(members: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(members)
            return at[~forest(a[at], b[at], len(node_sample))[0]]

        classes, shared = outside(live), outside(live & true)
        hit = np.zeros(len(a), bool)
        hit[shared] = True
        count = lambda at: np.bincount(code[at], minlength=n).astype(np.int64)
        flat = pa.StructArray.from_arrays([pa.array(src[classes]), pa.array(dst[classes]), pa.array(f[classes]), pa.array(hit[classes])], ["src", "dst", "birth", "matched"])
        ranks = {"predicted": count(classes), "shared": count(shared), "target": count(outside(true)), "union": count(outside(live | true))}
        return pa.table({"sample_id": table["sample_id"].take(pa.array(np.searchsorted(code, np.arange(n)))), **ranks, "classes": grouped_list(flat, code[classes], n)})

    c = candidates.select("sample_id", "src", "dst", F.col("p").cast("double").alias("p"), (1 - F.col("p").cast("double")).alias("f"), "is_true")
    types = {x.name: x.dataType.simpleString() for x in c.schema}
    schema = f"sample_id {types['sample_id']}, predicted long, shared long, target long, union long, classes array<struct<src:{types['src']},dst:{types['dst']},birth:double,matched:boolean>>"
    found = written(per_sample(c, kernel, schema, ["f", "src", "dst"]), "h1-matching")
    ranks = found.select("sample_id", "shared", (F.col("predicted") - F.col("shared")).alias("false"), (F.col("target") - F.col("shared")).alias("missed"), (F.col("union") - F.col("predicted") - F.col("target") + F.col("shared")).alias("union_only"))
    return ranks, found.select("sample_id", F.inline("classes"))


def h1_loss(ranks: DataFrame, classes: DataFrame, false_weight: float = 1.0, missed_weight: float = 1.0, diagonal: float = 0.5) -> DataFrame:
    """(sample_id, loss): matched births squared, false ones by their distance to the end, missed ones whole."""
    term = F.when(F.col("matched"), F.pow("birth", 2)).otherwise(diagonal * false_weight * F.pow(1 - F.col("birth"), 2))
    sums = classes.groupBy("sample_id").agg(F.sum(term).alias("found"))
    total = F.coalesce("found", F.lit(0.0)) + F.col("missed") * (diagonal * missed_weight)
    count = F.greatest(F.col("shared") + F.col("false") + F.col("missed"), F.lit(1))
    return ranks.join(sums.hint("merge"), "sample_id", "left").select("sample_id", (total / count).alias("loss"))


def matched_candidates(pairs: DataFrame, matched: DataFrame, target_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, candidates) of the topology losses: all pairs of matched queries of a sample.

    pairs: (sample_id, src, dst, p) of query ids, src < dst, with the mean of both orders' softmaxed
    probabilities (inference.symmetric_probability); matched: (sample_id, query_id, target_id);
    target_edges: (sample_id, src, dst) of target ids.  A vertex is a query's position in the order of ids.
    """
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy("query_id")) - 1
    m = matched.select("sample_id", "query_id", "target_id", place.alias("vertex"))
    samples = m.groupBy("sample_id").agg(F.count(F.lit(1)).cast("int").alias("n_vertices"))
    end = lambda side: m.select("sample_id", F.col("query_id").alias(side), F.col("vertex").alias(f"{side}_vertex"), F.col("target_id").alias(f"{side}_target"))
    both = pairs.join(end("src"), ["sample_id", "src"]).join(end("dst"), ["sample_id", "dst"])
    ends = both.select("sample_id", F.col("src_vertex").alias("src"), F.col("dst_vertex").alias("dst"), "p", F.least("src_target", "dst_target").alias("t_src"), F.greatest("src_target", "dst_target").alias("t_dst"))
    true = target_edges.select("sample_id", F.least("src", "dst").alias("t_src"), F.greatest("src", "dst").alias("t_dst"), F.lit(True).alias("true")).distinct()
    marked = ends.join(true, ["sample_id", "t_src", "t_dst"], "left")
    return samples, marked.select("sample_id", "src", "dst", "p", F.coalesce("true", F.lit(False)).alias("is_true"))


def topology_report(samples: DataFrame, h0: DataFrame, h1: DataFrame) -> DataFrame:
    """One row: mean H0 loss over samples with 2 matched nodes or more, mean H1 loss with 3 or more.

    samples: (sample_id, n_vertices); a sample without candidate pairs of either kind has loss 0.  Losses
    that are not finite take no part, and their samples are not counted."""
    s = samples.select("sample_id", "n_vertices").join(h0.select("sample_id", F.col("loss").alias("l0")), "sample_id", "left").join(h1.select("sample_id", F.col("loss").alias("l1")), "sample_id", "left")

    def usable(c: str, least: int) -> Column:
        value = F.coalesce(c, F.lit(0.0))
        return F.when((F.col("n_vertices") >= least) & ~F.isnan(value) & (F.abs(value) < float("inf")), value)

    l0, l1 = usable("l0", 2), usable("l1", 3)
    return s.agg(F.avg(l0).alias("h0_loss"), F.avg(l1).alias("h1_loss"), F.count(l0).alias("h0_samples"), F.count(l1).alias("h1_samples"))

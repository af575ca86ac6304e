"""Whole graphs in one kernel against the operators that work on rows."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.columns import AXES
from graphloom.operators import detection as det
from graphloom.operators import graphs as whole
from graphloom.operators import topology as topo
from graphloom.operators import transport
from graphloom.plans import canonical as c
from graphloom.plans import evaluate, registry

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def odd_graphs(spark):
    """Nodes and edges of both graphs, with loops, copies, unknown and missing ends, equal and NaN scores, missing places."""
    r, nodes, edges, pred, moved = random.Random(3), [], [], [], []
    score = lambda: r.choice([0.1, 0.5, 0.5, float("nan"), 1.0])
    for s in range(40):
        n = r.randrange(0, 9) if s else 60
        at = [[None if r.random() < 0.02 else r.randrange(6) / 5 for _ in AXES] for _ in range(n)]
        nodes += [(s, i * 3, *p) for i, p in enumerate(at)]
        moved += [(s, i * 3, *[x and x + 0.05 for x in p], score()) for i, p in enumerate(at) if r.random() < 0.9]
        end = lambda: None if r.random() < 0.03 else r.randrange(max(n, 1) + 1) * 3  # noqa: B023, E731
        edges += [(s, end(), end()) for _ in range(r.randrange(0, 2 * n + 1))]
        pred += [(s, end(), end(), score()) for _ in range(r.randrange(0, 2 * n + 1))]
    places = "sample_id long, node_id int, d double, h double, w double"
    p = c.predicted_nodes(spark.createDataFrame([x[:5] for x in moved], places)).drop("score")
    p = p.join(spark.createDataFrame([(*x[:2], x[5]) for x in moved], "sample_id long, node_id int, score double"), ["sample_id", "node_id"])
    return (
        spark.range(42).select(F.col("id").alias("sample_id")), spark.createDataFrame(nodes, places), spark.createDataFrame(edges, "sample_id long, src int, dst int"),
        p.cache(), spark.createDataFrame(pred, "sample_id long, src int, dst int, score double"),
    )


def rows(df, *columns):
    near = lambda x: None if x is None else pytest.approx(x, abs=1e-9)
    return {r["sample_id"]: [near(r[x]) for x in columns] for r in df.collect()}


@pytest.mark.parametrize("items", [1 << 16, 30])
def test_one_kernel_agrees_with_operators_on_rows(spark, monkeypatch, items):
    monkeypatch.setattr(whole, "ITEMS", items)
    samples, nodes, edges, p, e = odd_graphs(spark)
    got = evaluate.evaluate_graphs(samples, nodes, edges, p, e, 20).cache()
    counts = evaluate.INTS
    assert rows(evaluate.graph_counts(samples, nodes, edges, p, e), *counts) == rows(got, *counts)
    name = F.struct("src", "dst")
    kinds = {
        "node": (p.withColumn("pred_id", F.col("node_id")), det.node_boxes(nodes).withColumn("target_id", F.col("node_id"))),
        "edge": (det.edge_boxes(p, e).withColumn("pred_id", name), det.edge_boxes(nodes, topo.canonical_edges(nodes, edges)).withColumn("target_id", name)),
    }
    for kind, (a, b) in kinds.items():
        want = det.pooled_ap_ar(det.greedy_hits(a, b), det.target_counts(samples, b))
        assert rows(want, "ap", "ar") == rows(got, f"{kind}_mAP", f"{kind}_mAR")
    smd = transport.sinkhorn_distance(*[transport.graph_point_cloud(x, y, 20, packed=True) for x, y in ((nodes, edges), (p, e))])
    assert rows(smd, "distance") == rows(got.where("smd is not null"), "smd")
    assert got.count() == 42 and got.where("smd is null").count() > 0


def clouds(seed, samples=12, k=30):
    r = np.random.default_rng(seed)
    start, way = r.random((2, samples, 1, 3)) * np.geomspace(1e-5, 1, samples)[:, None, None]
    return start + way * np.linspace(0, 1, k)[:, None]


@pytest.mark.parametrize("epsilon", [1e-7, 1e-4, 0.05])
@pytest.mark.parametrize("shift", [0.0, 3e4])
def test_cells_that_are_left_out_do_not_matter(epsilon, shift):
    left, right = clouds(1) + shift, clouds(2, k=20) + shift
    right[3, :] = right[3, 0]
    for iterations, stop in ((1, 0.1), (100, 0.1), (100, 1e-5)):
        want = transport._whole(left, right, epsilon, iterations, stop)
        assert transport.sinkhorn(left, right, epsilon, iterations, stop) == pytest.approx(want, rel=1e-5, abs=1e-9)


def test_odd_clouds_are_solved_with_all_cells():
    left, right = clouds(1, 4), clouds(2, 4)
    left[1, 2], right[2] = np.nan, 1e9
    want = transport._whole(left, right, 1e-7, 100, 0.1)
    assert transport.sinkhorn(left, right) == pytest.approx(want, rel=1e-6, nan_ok=True)
    assert np.isnan(want[1]) and transport.sinkhorn(left, right, iterations=0)[0] == pytest.approx(transport._whole(left, right, 1e-7, 0, 0.1)[0])


def test_clouds_of_the_protocol_need_few_cells(monkeypatch):
    monkeypatch.setattr(transport, "_whole", None)  # the way through all cells is not taken
    assert np.isfinite(transport.sinkhorn(clouds(1, k=100), clouds(2, k=100))).all()


def test_marked_places():
    r = np.random.default_rng(0)
    for n in (0, 8, 64, 13):
        found = r.random(n) < 0.2
        assert transport._marked(found).tolist() == np.flatnonzero(found).tolist()


@tables
def test_graphs_of_samples_agree_with_tables_of_edges(spark):
    n = c.nodes(spark, SF)
    g = c.graphs(n).cache()
    flat = lambda x, *more: g.select("sample_id", F.inline(x)).select("sample_id", *more)
    for table, x, columns in ((n, "target_nodes", ("node_id", *AXES)), (c.target_edges(n), "target_edges", ("src", "dst")), (c.predicted_edges(n), "predicted_edges", ("src", "dst", "score"))):
        want = table.select("sample_id", *columns)
        assert want.count() == g.select(F.sum(F.size(x))).first()[0] and want.exceptAll(flat(x, *columns)).isEmpty()
    p = c.predicted_nodes(n).select("sample_id", "node_id", *AXES, "score", "corners.*")
    assert p.exceptAll(flat("predicted_nodes", *p.columns[1:])).isEmpty()


@tables
@pytest.mark.parametrize("name", ["m01_evaluate_graphs", "m11_evaluate_without_transport", "p02_sinkhorn_distance", "p03_street_mover_distance"])
def test_lines_are_shuffled_once_and_meet_one_kernel(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert text.count("REPARTITION_BY_NUM") == 1 and text.count("MapInArrow") == 1


@tables
@pytest.mark.parametrize("name", ["p04_point_cloud_of_protocol", "p05_sinkhorn_small"])
def test_branches_share_the_shuffle_of_the_lines(spark, name):
    df = registry.queries()[name](spark, SF)
    df.collect()
    text = plan(df)
    assert text.count("ReusedExchange") == text.count("REPARTITION_BY_NUM") - 1

"""Detection, topology, transport and summaries on hand-made graphs and by brute force."""

import inspect
import itertools
import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.functions.columns import box, corners, giou, iou, volume
from graphloom.operators import detection as det
from graphloom.operators import inference as inf
from graphloom.operators import kernels
from graphloom.operators import summary as summ
from graphloom.operators import topology as topo
from graphloom.operators import transport
from graphloom.operators.ordering import with_position, with_running
from graphloom.plans import registry
from graphloom.plans.evaluate import METRICS, evaluate_graphs

AXES = "dhw"
SF = "/root/testdata/sf0.001"


def det_tables(spark, targets, predictions):
    """targets: (sample, id, centre); predictions: (sample, id, centre, score); cubes of side .2."""
    t = det.node_boxes(spark.createDataFrame([(s, i, *map(float, c)) for s, i, c in targets], "sample_id string, target_id int, d double, h double, w double"))
    p = det.node_boxes(spark.createDataFrame([(s, i, *map(float, c), x) for s, i, c, x in predictions], "sample_id string, pred_id int, d double, h double, w double, score double"))
    return p, t


def one(df):
    return df.collect()[0]


def test_box_corners_volumes_and_ious(spark):
    b = lambda c, s: box({a: F.lit(x) for a, x in zip(AXES, c)}, {a: F.lit(x) for a, x in zip(AXES, s)})
    df = spark.range(1).select(corners(b((0.5, 0.4, 0.3), (0.2, 0.4, 0.6))).alias("k"), corners(b((0.1,) * 3, (0.2,) * 3), False).alias("x"), corners(b((0.2,) * 3, (0.2,) * 3), False).alias("y"))
    r = one(df.select("k.*", volume(F.col("x")).alias("v"), iou(F.col("x"), F.col("y")).alias("iou"), giou(F.col("x"), F.col("y")).alias("giou")))
    assert [r[c] for c in ("d0", "h0", "d1", "h1", "w0", "w1")] == pytest.approx([0.4, 0.2, 0.6, 0.6, 0, 0.6])
    assert (r["v"], r["iou"], r["giou"]) == pytest.approx((0.008, 1 / 15, 1 / 15 - 12 / 27))


def ap_ar(spark, targets, predictions, group=None):
    p, t = det_tables(spark, targets, predictions)
    samples = spark.createDataFrame([(s,) for s in sorted({x[0] for x in targets})], "sample_id string")
    hits, counts = det.greedy_match(p, t), det.target_counts(samples, t)
    if group:
        r = one(summ.summarize_detection(hits, counts, 1))
        return r["ap"], r["ar"], r["ap_std"]
    r = one(det.pooled_ap_ar(hits, counts))
    return r["ap"], r["ar"]


Q, T = (0.25,) * 3, (0.75,) * 3


def test_perfect_and_false_detections(spark):
    assert ap_ar(spark, [("a", 0, Q), ("a", 1, T)], [("a", 0, Q, 0.9), ("a", 1, T, 0.8)]) == pytest.approx((1, 1))
    ap, ar = ap_ar(spark, [("a", 0, Q)], [("a", 0, T, 0.99), ("a", 1, Q, 0.9)])
    assert ap < 1 and ar == pytest.approx(1)


def test_pooling_two_samples(spark):
    ap, ar, std = ap_ar(spark, [("a", 0, Q), ("b", 0, Q)], [("a", 0, Q, 0.9), ("b", 0, T, 0.8)], group=True)
    assert ar == pytest.approx(0.5) and 0.45 < ap < 0.55 and std == 0


def test_undefined_and_zero_metrics(spark):
    p, t = det_tables(spark, [("a", 0, Q)], [("b", 0, Q, 0.5)])
    samples = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    got = {r["sample_id"]: (r["ap"], r["ar"]) for r in det.sample_ap_ar(p, t, samples).collect()}
    assert got == {"a": (0.0, 0.0), "b": (None, None)}


def test_top_detections(spark):
    p, _ = det_tables(spark, [], [("a", k, Q, k / 100) for k in range(45)])
    assert sorted(r["pred_id"] for r in det.top_detections(p).collect()) == list(range(5, 45))


def overlap_by_hand(a, b):
    side = [max(0.0, min(x, y) + 0.1 - (max(x, y) - 0.1)) for x, y in zip(a, b)]
    inter = math.prod(side)
    return inter / (0.016 - inter)


def test_greedy_match_by_hand(spark):
    r = random.Random(4)
    point = lambda: tuple(0.3 + 0.08 * r.random() for _ in AXES)
    targets = [(f"s{k}", i, point()) for k in range(12) for i in range(r.randint(1, 5))]
    predictions = [(f"s{k}", i, point(), r.choice([0.2, 0.5, 0.5, 0.9])) for k in range(12) for i in range(r.randint(1, 6))]
    p, t = det_tables(spark, targets, predictions)
    got = {(x["sample_id"], x["iou_t"], x["rank"]): x["hit"] for x in det.greedy_match(p, t).collect()}
    want = {}
    for s in {x[0] for x in predictions}:
        order = sorted((x for x in predictions if x[0] == s), key=lambda x: (-x[3], x[1]))
        for th in det.IOU_THRESHOLDS:
            free = {x[1]: x[2] for x in targets if x[0] == s}
            for rank, x in enumerate(order, 1):
                options = sorted((-overlap_by_hand(x[2], c), i) for i, c in free.items() if overlap_by_hand(x[2], c) >= th)
                want[(s, th, rank)] = bool(options)
                if options:
                    free.pop(options[0][1])
    assert got == want


def ap_by_hand(rows, targets):
    """rows: (score, hit) in order."""
    tp = np.cumsum([h for _, h in rows])
    recall, precision = tp / targets, tp / np.arange(1, len(rows) + 1)
    return np.mean([max([p for p, r in zip(precision, recall) if r >= (i * 0.01 if i < 100 else 1.0)], default=0) for i in range(101)])


def test_pooled_ap_against_the_definition(spark):
    r = random.Random(6)
    rows = [(f"s{k}", 0.5, i, r.random(), r.random() < 0.6) for k in range(5) for i in range(9)]
    counts = spark.createDataFrame([(f"s{k}", 10, 0) for k in range(5)], "sample_id string, target_count int, g int")
    hits = spark.createDataFrame([(*x, 0) for x in rows], "sample_id string, iou_t double, rank int, score double, hit boolean, g int")
    got = one(det.pooled_ap_ar(hits, counts, "g", (0.5,)))
    ordered = sorted(((s, h) for _, _, _, s, h in rows), key=lambda x: -x[0])
    assert got["ap"] == pytest.approx(ap_by_hand(ordered, 50)) and got["ar"] == pytest.approx(sum(h for _, h in ordered) / 50)


def graph(spark, n, edges, sample="a"):
    nodes = spark.createDataFrame([(sample, i) for i in range(n)], "sample_id string, node_id int")
    return nodes, spark.createDataFrame([(sample, *e) for e in edges], "sample_id string, src int, dst int")


def test_components_and_betti_numbers(spark):
    nodes, edges = graph(spark, 6, [(1, 0), (0, 1), (2, 2), (1, 2), (0, 2), (3, 4), (9, 1)])
    assert sorted(tuple(r)[1:] for r in topo.canonical_edges(nodes, edges).collect()) == [(0, 1), (0, 2), (1, 2), (3, 4)]
    assert sorted((r["node_id"], r["component"]) for r in topo.connected_components(nodes, edges).collect()) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5)]
    samples = spark.createDataFrame([("a",), ("empty",)], "sample_id string")
    got = {r["sample_id"]: (r["n_nodes"], r["n_edges"], r["beta0"], r["beta1"]) for r in topo.betti_numbers(samples, nodes, edges).collect()}
    assert got == {"a": (6, 4, 3, 1), "empty": (0, 0, 0, 0)}


K4 = list(itertools.combinations(range(4), 2))


def cand(spark, p, truth, pairs=K4, sample="a"):
    return spark.createDataFrame([(sample, *e, float(x), e in truth) for e, x in zip(pairs, p)], "sample_id string, src int, dst int, p double, is_true boolean")


def test_filtration_and_forest(spark):
    nodes, _ = graph(spark, 4, [(0, 1)])
    f = topo.graph_filtration(nodes, cand(spark, (0.95, 0, 0, 0.1, 0, 0.9), ()))
    assert [r["f"] for r in f.orderBy("node_id").collect()] == pytest.approx([0.05, 0.05, 0.1, 0.1])
    c = cand(spark, (0.95, 0.85, 0, 0.9, 0.75, 0.8), {(0, 1), (0, 2), (1, 2), (2, 3)}).where("p > 1e-12").withColumn("f", 1 - F.col("p"))
    rows = topo.minimum_spanning_forest(c).collect()
    assert {(r["src"], r["dst"]) for r in rows if r["in_forest"]} == {(0, 1), (1, 2), (2, 3)}
    assert sorted(round(r["f"], 6) for r in rows if not r["in_forest"]) == [0.15, 0.25]


def h0(spark, p, truth):
    c = cand(spark, p, truth)
    m = topo.h0_matching(spark.createDataFrame([("a", 4)], "sample_id string, n_vertices int"), c)
    return m, one(topo.h0_loss(m))


def test_h0_missing_and_false_bridge(spark):
    _, r = h0(spark, (0.95, 0, 0, 0.10, 0, 0.90), {(0, 1), (1, 2), (2, 3)})
    assert r["false"] == 1
    m, r = h0(spark, (0.95, 0, 0, 0.80, 0, 0.90), {(0, 1), (2, 3)})
    assert r["matched"] == 1
    pair = one(m.where("side = 'prediction' and matched"))
    target = one(m.where("side = 'target' and matched"))
    terms = [(pair["birth"] - target["birth"]) ** 2 + (pair["death"] - target["death"]) ** 2]
    terms += [0.5 * (x["death"] - x["birth"]) ** 2 for x in m.where("not matched").collect()]
    assert r["loss"] == pytest.approx(sum(terms) / max(1, r["matched"] + r["false"] + r["missed"]))


def h1(spark, p, truth, pairs=K4):
    ranks, classes = topo.h1_matching(cand(spark, p, truth, pairs))
    r = one(ranks)
    return (r["shared"], r["false"], r["missed"], r["union_only"]), ranks, classes


def test_h1_ranks_and_loss(spark):
    ranks, table, classes = h1(spark, (0.95, 0.85, 0, 0.9, 0.75, 0.8), {(0, 1), (0, 2), (1, 2), (2, 3)})
    assert ranks == (1, 1, 0, 0)
    assert one(topo.h1_loss(table, classes))["loss"] == pytest.approx(0.151875)
    some = [e for e in K4 if e != (1, 3)]
    assert h1(spark, [0.55 + 0.07 * i for i in range(5)], set(some), some)[0][:3] == (2, 0, 0)
    square = [(0, 1), (0, 3), (1, 2), (2, 3)]
    assert h1(spark, (0.9, 0, 0, 0.8), {(1, 2), (0, 3)}, square)[0] == (0, 0, 0, 1)


def rank_gf2(vectors):
    rows, rank = list(vectors), 0
    while rows:
        x = rows.pop()
        if x:
            rank += 1
            low = x & -x
            rows = [r ^ x if r & low else r for r in rows]
    return rank


def cycle_space(edges):
    """Basis of the cycle space over GF(2) as bit sets of K5 edges, by enumeration."""
    pairs = list(itertools.combinations(range(5), 2))
    found = []
    for choice in itertools.product((0, 1), repeat=len(edges)):
        degree = [0] * 5
        for bit, e in zip(choice, edges):
            if bit:
                degree[e[0]] ^= 1
                degree[e[1]] ^= 1
        if not any(degree):
            found.append(sum(1 << pairs.index(e) for bit, e in zip(choice, edges) if bit))
    return found


def test_h1_shared_rank_is_that_of_the_common_cycle_space(spark):
    r = random.Random(8)
    pairs = list(itertools.combinations(range(5), 2))
    frames, want = [], {}
    for k in range(12):
        p, truth = [r.choice([0, 0.3, 0.6, 0.9]) for _ in pairs], {e for e in pairs if r.random() < 0.5}
        frames.append(cand(spark, p, truth, pairs, f"s{k}"))
        live = [e for e, x in zip(pairs, p) if x > 0]
        a, b = cycle_space(live), cycle_space(sorted(truth))
        shared = rank_gf2(set(a) & set(b))
        want[f"s{k}"] = (shared, rank_gf2(a) - shared, rank_gf2(b) - shared)
    c = frames[0]
    for f in frames[1:]:
        c = c.unionByName(f)
    got = {x["sample_id"]: (x["shared"], x["false"], x["missed"]) for x in topo.h1_matching(c)[0].collect()}
    assert got == want


def placed(spark, points, edges, sample="a"):
    nodes = spark.createDataFrame([(sample, i, *map(float, p)) for i, p in enumerate(points)], "sample_id string, node_id int, d double, h double, w double")
    return nodes, spark.createDataFrame([(sample, *e) for e in edges], "sample_id string, src int, dst int")


def test_point_cloud_along_one_edge(spark):
    cloud = transport.graph_point_cloud(*placed(spark, [(0, 0, 0), (10, 10, 10), (0, 0, 1)], [(0, 2)]), 5)
    assert [(r["d"], r["h"], r["w"]) for r in cloud.orderBy("i").collect()] == [(0, 0, z) for z in (0, 0.25, 0.5, 0.75, 1)]


def test_point_cloud_has_every_point_once(spark):
    r = random.Random(9)
    points = [[r.random() for _ in AXES] for _ in range(12)]
    nodes, edges = placed(spark, points, [(i, j) for i in range(12) for j in range(i) if r.random() < 0.4] + [(3, 3)])
    assert sorted(x["i"] for x in transport.graph_point_cloud(nodes, edges).collect()) == list(range(100))


def test_distances_of_equal_and_missing_graphs(spark):
    nodes, edges = placed(spark, [(0.1, 0.2, 0.3), (0.9, 0.8, 0.1), (0.4, 0.4, 0.4)], [(0, 1), (1, 2)])
    samples = spark.createDataFrame([("a",), ("none",)], "sample_id string")
    got = {r["sample_id"]: r["smd"] for r in transport.street_mover_distance(samples, nodes, edges, nodes, edges).collect()}
    assert got["none"] is None and abs(got["a"]) < 1e-6


def test_evaluation_of_a_perfect_graph(spark):
    nodes, edges = placed(spark, [(0.2,) * 3, (0.8,) * 3], [(0, 1)])
    b = box({a: F.col(a) for a in AXES}, {a: F.lit(0.2) for a in AXES})
    pred = nodes.withColumn("box", b).withColumn("corners", corners(F.col("box"))).withColumn("score", 0.9 - F.col("node_id") * 0.1)
    r = one(evaluate_graphs(nodes.select("sample_id").distinct(), nodes, edges, pred, edges.withColumn("score", F.lit(0.7))))
    assert all(r[m] == pytest.approx(1) for m in ("node_mAP", "node_mAR", "edge_mAP", "edge_mAR", "target_beta0", "predicted_beta0"))
    assert all(abs(r[m]) < 1e-6 for m in METRICS if m.endswith("error") or m in ("smd", "target_beta1"))


def test_folds_and_summary(spark):
    df = spark.createDataFrame([(f"s{k}", float(k), float("nan") if k < 2 else 1.0) for k in range(6)], "sample_id string, x double, y double")
    r = {x["name"]: x for x in summ.summarize(df, ["x", "y"]).collect()}
    assert (r["x"]["samples"], r["x"]["mean"]) == (6, pytest.approx(2.5)) and r["x"]["std"] == pytest.approx(np.std([0.5, 2, 3, 4, 5], ddof=1))
    assert r["y"]["mean"] == 1 and r["y"]["std"] == 0
    assert [x["fold"] for x in summ.fold_id(df.select("sample_id")).orderBy("sample_id").collect()] == [0, 0, 1, 2, 3, 4]


def test_runs(spark):
    log = spark.createDataFrame([("r", e, "edge_mAP", v) for e, v in ((1, 0.1), (2, 0.3), (3, 0.3), (4, float("nan")), (5, 0.2))], "run_id string, epoch int, name string, value double")
    assert [r["improved"] for r in summ.best_so_far(log).orderBy("epoch").collect()] == [True, True, False, False, False]
    assert [r["epoch"] for r in summ.select_checkpoint(log, "interval_and_best", 3).orderBy("epoch").collect()] == [1, 2, 3, 5]
    assert summ.select_checkpoint(log, "none").count() == 0
    low = log.withColumn("name", F.lit("validation_total")).where("epoch < 4")
    best = {r["name"]: r["best"] for r in summ.run_summaries(log.where("epoch < 4").unionByName(low)).collect()}
    assert best == {"edge_mAP": 0.3, "validation_total": 0.1}


def test_comparison_of_outputs(spark):
    a = spark.createDataFrame([(k, float(k)) for k in range(5)], "k int, v double")
    assert one(summ.compare_outputs(a, a, ["k"], ["v"]))["all_close"]
    r = one(summ.compare_outputs(a, a.withColumn("v", F.col("v") + 0.5).where("k < 4"), ["k"], ["v"]))
    assert (r["max_abs"], r["left_only"], r["all_close"]) == (0.5, 1, False)


@pytest.mark.parametrize("rows", [40, 10_000])
def test_positions_and_running_sums_do_not_depend_on_the_ranges(spark, rows):
    df = spark.range(500).select((F.col("id") * 7919 % 104729).alias("k"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("v"))
    placed = with_position(df, "k", ["g"], range_rows=rows).collect()
    summed = with_running(df, ["g"], [F.col("k").desc()], ["v"], range_rows=rows).collect()
    for g in range(3):
        mine = sorted((r["k"], r["position"], r["total"]) for r in placed if r["g"] == g)
        assert [p for _, p, _ in mine] == list(range(len(mine))) and all(t == len(mine) for _, _, t in mine)
        down = sorted((r for r in summed if r["g"] == g), key=lambda r: -r["k"])
        assert [r["v_sum"] for r in down] == list(itertools.accumulate(r["v"] for r in down)) and [r["position"] for r in down] == list(range(len(down)))


def test_running_sums_across_batches_and_null_groups(spark):
    df = spark.range(300).select(F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"), F.col("id").alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") / 2).alias("v"))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        got = with_running(df.where("g is not null"), ["g"], [F.col("k")], ["v"], range_rows=100).orderBy("g", "k").collect()
        whole = with_running(df, [], [F.col("k")], ["v"], range_rows=50).orderBy("k").collect()
    finally:
        spark.conf.set(size, before)
    for g in (1, 2, 3):
        mine = [r for r in got if r["g"] == g]
        assert [r["v_sum"] for r in mine] == list(itertools.accumulate(r["v"] or 0 for r in mine)) and [r["position"] for r in mine] == list(range(75)) and mine[0]["total"] == 75
    assert [r["v_sum"] for r in whole] == list(itertools.accumulate(r["v"] or 0 for r in whole)) and [r["position"] for r in whole] == list(range(300))


def slow_sinkhorn(left, right, epsilon=1e-7, iterations=100, stop=0.1):
    """One sample, one potential after another."""
    cost = [[sum((a - b) ** 2 for a, b in zip(p, q)) for q in right] for p in left]
    soft = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    u, v = [0.0] * len(left), [0.0] * len(right)
    mu, nu = math.log(1 / len(left) + 1e-8), math.log(1 / len(right) + 1e-8)
    for _ in range(iterations):
        new = [x + epsilon * (mu - soft([(x + y - c) / epsilon for y, c in zip(v, row)])) for x, row in zip(u, cost)]
        v = [y + epsilon * (nu - soft([(x + y - row[j]) / epsilon for x, row in zip(new, cost)])) for j, y in enumerate(v)]
        moved, u = sum(abs(a - b) for a, b in zip(new, u)), new
        if moved < stop:
            break
    return sum(math.exp(min((x + y - c) / epsilon, 700)) * c for x, row in zip(u, cost) for y, c in zip(v, row))


def test_transport_of_many_samples_at_once(spark, monkeypatch):
    monkeypatch.setattr(transport, "CELLS", 40)
    r = np.random.default_rng(4)
    clouds = {k: (r.random((n, 3)) * size, r.random((m, 3)) * size) for k, (n, m, size) in enumerate([(3, 3, 1), (3, 3, 0.01), (5, 2, 1), (3, 3, 2), (1, 1, 1), (3, 3, 0.3)])}
    frame = lambda side: spark.createDataFrame([(k, i, *map(float, p)) for k, c in clouds.items() for i, p in enumerate(c[side])], "sample_id int, i int, d double, h double, w double")
    for epsilon in (1e-7, 0.05):
        got = {r["sample_id"]: r["distance"] for r in transport.sinkhorn_distance(frame(0), frame(1), epsilon).collect()}
        assert got == {k: pytest.approx(slow_sinkhorn(*c, epsilon), rel=1e-6) for k, c in clouds.items()}
    # Samples stop on their own: with a stop that some reach at once and others later.
    left, right = (np.stack([c[side] for k, c in clouds.items() if k in (0, 1, 3, 5)]) for side in (0, 1))
    together = transport.sinkhorn(left, right, 0.05, stop=0.02)
    assert together == pytest.approx([slow_sinkhorn(a, b, 0.05, stop=0.02) for a, b in zip(left, right)], rel=1e-6)


def slow_elders(edges, births):
    eldest, ended = list(range(len(births))), []
    for a, b in edges:
        x, y = sorted((eldest[a], eldest[b]), key=lambda k: (births[k], k))
        ended.append(y)
        eldest = [x if k == y else k for k in eldest]
    return ended


def test_walks_in_lockstep():
    r, sample, births, edges = random.Random(6), [], [], []
    for s, n in enumerate((1, 5, 2, 40, 3)):
        first = len(sample)
        sample += [s] * n
        births += [r.randrange(4) / 4 for _ in range(n)]
        edges += [(first + r.randrange(k), first + k) for k in range(1, n)]
    a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    order = np.array(r.sample(range(len(edges)), len(edges)))
    slow = {}
    for s in set(sample):
        mine = [e for e in order if sample[a[e]] == s]
        for e, v in zip(mine, slow_elders([(a[e], b[e]) for e in mine], births)):
            slow[int(e)] = v
    (got,) = topo.elder_walk(order, a, b, np.array(sample), [np.array(births)])
    assert {int(e): int(v) for e, v in zip(order, got)} == slow
    assert topo.elder_walk(order[:0], a, b, np.array(sample), [np.array(births)])[0].tolist() == []


def slow_forest(n, edges):
    of, kept = list(range(n)), []
    for a, b in edges:
        kept.append(of[a] != of[b])
        low, high = min(of[a], of[b]), max(of[a], of[b])
        of = [low if x == high else x for x in of]
    return kept, of


def test_forests_of_the_documented_size():
    r, a, b, base = np.random.default_rng(1), [], [], 0
    want, want_label = [], []
    for n in (120, 1, 7, 60, 120):
        pairs = np.array(list(itertools.combinations(range(n), 2))).reshape(-1, 2)
        pairs = pairs[r.permutation(len(pairs))[: len(pairs) if n > 7 else 3]]
        kept, label = slow_forest(n, pairs.tolist())
        want, want_label = want + kept, want_label + [x + base for x in label]
        a, b, base = np.append(a, pairs[:, 0] + base), np.append(b, pairs[:, 1] + base), base + n
    kept, label = kernels.forest(a.astype(int), b.astype(int), base)
    assert kept.tolist() == want and label.tolist() == want_label


def test_samples_reach_kernels_whole(spark):
    rows = [(f"s{k}", i) for k, n in enumerate([1, 500, 3, 40, 2000, 7]) for i in range(n)] + [(None, 1), (None, 2)]
    seen = kernels.per_sample(
        spark.createDataFrame(rows, "sample_id string, i int").repartition(5),
        lambda t, code: pa.table({"sample_id": t["sample_id"].take(pa.array(np.unique(code, return_index=True)[1])), "n": np.bincount(code)}), "sample_id string, n long", ["i"], limit=100,
    ).collect()
    assert sorted(map(tuple, seen), key=str) == sorted([("s0", 1), ("s1", 500), ("s2", 3), ("s3", 40), ("s4", 2000), ("s5", 7), (None, 2)], key=str)


def test_h1_refuses_candidates_that_stand_twice(spark):
    c = spark.createDataFrame([(1, 0, 1, 0.5, True), (1, 1, 2, 0.5, True), (1, 0, 1, 0.7, False)], "sample_id int, src int, dst int, p double, is_true boolean")
    with pytest.raises(Exception, match="duplicate candidate edge"):
        topo.h1_matching(c)


def test_report_leaves_out_losses_that_are_not_finite(spark):
    v = spark.createDataFrame([(k, n) for k, n in enumerate([1, 2, 3, 5, 4])], "sample_id int, n_vertices int")
    l0 = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, 4.0), (0, 9.0)], "sample_id int, loss double")
    l1 = spark.createDataFrame([(2, 1.0), (3, float("inf"))], "sample_id int, loss double")
    assert tuple(one(topo.topology_report(v, l0, l1))) == (pytest.approx(2.0), pytest.approx(0.5), 3, 2)


def test_topology_candidates_average_probabilities(spark):
    ordered = spark.createDataFrame([(1, 4, 9, 0.0, 2.0), (1, 9, 4, 1.0, 0.0), (1, 4, 7, 0.0, 0.0), (1, 7, 4, 0.0, 0.0), (1, 7, 9, 3.0, 0.0), (1, 9, 7, 0.0, 3.0), (1, 4, 5, 0.0, 9.0)], "sample_id int, left int, right int, l0 double, l1 double")
    matched = spark.createDataFrame([(1, 9, 0), (1, 4, 2), (1, 7, 1)], "sample_id int, query_id int, target_id int")
    edges = spark.createDataFrame([(1, 0, 2)], "sample_id int, src int, dst int")
    samples, c = topo.matched_candidates(inf.symmetric_probability(ordered), matched, edges)
    assert tuple(one(samples)) == (1, 3)
    soft = lambda a, b: 1 / (1 + math.exp(a - b))
    got = {(r["src"], r["dst"]): (r["p"], r["is_true"]) for r in c.collect()}
    assert got == {(0, 2): (pytest.approx((soft(0, 2) + soft(1, 0)) / 2), True), (0, 1): (pytest.approx(0.5), False), (1, 2): (pytest.approx((soft(3, 0) + soft(0, 3)) / 2), False)}


def test_an_empty_evaluation_raises(spark):
    with pytest.raises(ValueError, match="at least one sample"):
        summ.summarize(spark.createDataFrame([], "sample_id int, x double"), ["x"])
    with pytest.raises(ValueError, match="at least one sample"):
        summ.summarize_detection(spark.createDataFrame([], "sample_id int, rank int, score double, hits array<boolean>"), spark.createDataFrame([], "sample_id int, target_count int"))


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["p02_sinkhorn_distance", "p03_street_mover_distance", "m01_evaluate_graphs"])
def test_registered_distances_use_the_points_of_the_protocol(spark, monkeypatch, name):
    points, made = [], transport.graph_point_cloud

    def cloud(*args, **more):
        call = inspect.signature(made).bind(*args, **more)
        call.apply_defaults()
        points.append(call.arguments["k"])
        return made(*args, **more)

    monkeypatch.setattr(transport, "graph_point_cloud", cloud)
    registry.queries()[name](spark, SF)
    assert points == [100, 100]

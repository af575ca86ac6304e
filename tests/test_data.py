"""Geometry, voxels, composition, queries, losses, sources and streams on hand-made inputs."""

import base64
import gzip
import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import compose as comp
from graphloom.operators import geometry as geo
from graphloom.operators import inference as inf
from graphloom.operators import losses as loss
from graphloom.operators import packed
from graphloom.operators import summary as summ
from graphloom.operators import voxels as vox
from graphloom.sources import files
from graphloom.streaming import runs

AXES = "dhw"


def nodes(spark, rows):
    return spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(rows)], "sample_id string, node_id int, d double, h double, w double")


def voxels(spark, array, kind="image"):
    return spark.createDataFrame([("a", kind, *map(int, at), float(v)) for at, v in np.ndenumerate(array) for at in [at]], "sample_id string, kind string, d int, h int, w int, value double")


def points(df):
    return [tuple(r[a] for a in AXES) for r in df.orderBy("node_id").collect()]


def dense(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["d"], r["h"], r["w"]] = r["value"]
    return out


def test_index_round_trip(spark):
    shape, at = (7, 9, 11), [(0, 0, 0), (6, 8, 10), (3, 4, 5)]
    n = geo.normalize(nodes(spark, at), shape)
    assert points(n)[1] == pytest.approx((6 / 7, 8 / 9, 10 / 11))
    back = geo.to_voxel_index(n, shape).orderBy("node_id").collect()
    assert [(r["vd"], r["vh"], r["vw"]) for r in back] == at
    assert [r["valid"] for r in geo.valid_coordinates(nodes(spark, [(1.0, 0, 0), (6 / 7, 0, 0)]), shape).orderBy("node_id").collect()] == [False, True]


def test_degrees(spark):
    df = spark.createDataFrame([(90.0,), (180.0,), (270.0,), (-90.0,)], "a double").select(geo.degrees_to_turns(F.col("a")))
    assert [r[0] for r in df.collect()] == [1, 2, 3, 3]
    with pytest.raises(Exception, match="multiple of 90"):
        spark.createDataFrame([(45.0,)], "a double").select(geo.degrees_to_turns(F.col("a"))).collect()


@pytest.mark.parametrize("shape, landmark, turns", [((7, 7, 7), (1, 3, 5), t) for t in itertools.product(range(4), repeat=3) if sum(t) % 3 == 1][:8] + [((5, 7, 9), (1, 4, 7), (1, 3, 1))])
def test_nodes_and_voxels_turn_alike(spark, shape, landmark, turns):
    volume = np.zeros(shape)
    volume[landmark] = 1
    n = geo.rotate_nodes(geo.normalize(nodes(spark, [landmark]), shape), turns, shape).collect()[0]
    v = vox.rotate_voxels(voxels(spark, volume), turns, shape).where("value = 1").collect()[0]
    size = n["new_shape"]
    assert [round(n[a] * size[a]) for a in AXES] == [v[a] for a in AXES]
    want = np.rot90(np.rot90(np.rot90(volume, turns[0], (0, 1)), turns[1], (0, 2)), turns[2], (1, 2))
    assert want.shape == tuple(size) and want[v["d"], v["h"], v["w"]] == 1


@pytest.mark.parametrize("flip", [(True, False, True), (False, True, False)])
def test_nodes_and_voxels_flip_alike(spark, flip):
    shape, landmark = (7, 9, 11), (1, 4, 8)
    n = geo.flip_nodes(geo.normalize(nodes(spark, [landmark]), shape), flip, shape).collect()[0]
    want = tuple(s - 1 - x if f else x for s, x, f in zip(shape, landmark, flip))
    assert tuple(round(n[a] * s) for a, s in zip(AXES, shape)) == want
    volume = np.zeros(shape)
    volume[landmark] = 1
    assert dense(vox.flip_voxels(voxels(spark, volume), flip, shape), shape)[want] == 1


@pytest.mark.parametrize("factor", [0.6, 0.75, 1.0])
def test_zoomed_nodes_stay_in_the_foreground(spark, factor):
    shape = (17,) * 3
    volume = np.zeros(shape)
    volume[4:7, 7:10, 10:13] = 1
    n = geo.zoom_nodes(geo.normalize(nodes(spark, [(5, 8, 11)]), shape), factor, shape)
    mask = dense(vox.zoom_voxels(voxels(spark, volume), factor, shape), shape)
    at = geo.to_voxel_index(n, shape).collect()[0]
    assert mask[at["vd"], at["vh"], at["vw"]] == 1 and set(np.unique(mask)) == {0, 1}


def test_resampling_against_direct_interpolation(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(3, 4, 5))

    def linear(shape):
        out = np.zeros(shape)
        for at in np.ndindex(shape):
            p = [min(max((o + 0.5) * s / t - 0.5, 0), s - 1) for o, s, t in zip(at, x.shape, shape)]
            for corner in itertools.product((0, 1), repeat=3):
                i = [min(int(np.floor(q)) + c, s - 1) for q, c, s in zip(p, corner, x.shape)]
                out[at] += np.prod([1 - abs(np.floor(q) + c - q) for q, c in zip(p, corner)]) * x[tuple(i)]
        return out

    got = dense(vox.resize_voxels(voxels(spark, x), x.shape, (4, 2, 7), "trilinear"), (4, 2, 7))
    assert np.allclose(got, linear((4, 2, 7)))
    assert np.allclose(dense(vox.resize_voxels(voxels(spark, x), x.shape, (2, 4, 9)), (2, 4, 9)), x[np.ix_([0, 1], [0, 1, 2, 3], [int(o * 5 / 9) for o in range(9)])])
    cells = lambda s, t: [slice(i * s // t, -(-(i + 1) * s // t)) for i in range(t)]
    blocks = [[[x[a, b, c] for c in cells(5, 3)] for b in cells(4, 3)] for a in cells(3, 2)]
    assert np.allclose(dense(vox.occupancy_downsample(voxels(spark, x), x.shape, (2, 3, 3)), (2, 3, 3)), [[[z.max() for z in y] for y in w] for w in blocks])
    assert np.allclose(dense(vox.area_resize(voxels(spark, x), x.shape, (2, 3, 3)), (2, 3, 3)), [[[z.mean() for z in y] for y in w] for w in blocks])


def volumes(spark, arrays, kind="image"):
    rows = [(k, kind, x.shape, x.ravel().tolist()) for k, x in enumerate(arrays)]
    return spark.createDataFrame(rows, "sample_id int, kind string, shape struct<d:int,h:int,w:int>, data array<double>")


def unpacked(rows):
    return {r["sample_id"]: np.array(r["data"]).reshape(tuple(r["shape"])) for r in rows.collect()}


@pytest.mark.parametrize("mode", ["nearest", "trilinear"])
def test_packed_resampling_is_that_of_voxel_tables(spark, mode):
    r = np.random.default_rng(6)
    x, shape = r.normal(size=(3, 5, 4)), (3, 5, 4)
    v, rows = volumes(spark, [x]), voxels(spark, x)
    for factor in (0.6, 0.75, 1.0, 1.7):
        assert np.allclose(unpacked(packed.zoom_volumes(v, factor, mode))[0], dense(vox.zoom_voxels(rows, factor, shape, mode), shape))
    for target in ((2, 3, 4), (6, 5, 9), (1, 1, 1)):
        assert np.allclose(unpacked(packed.resize_volumes(v, target, mode))[0], dense(vox.resize_voxels(rows, shape, target, mode), target))


def test_packed_pooling_is_that_of_voxel_tables(spark):
    x = np.random.default_rng(7).normal(size=(7, 5, 6))
    v, rows = volumes(spark, [x]), voxels(spark, x)
    for target in ((3, 2, 4), (7, 5, 6), (1, 1, 1), (2, 5, 5)):
        assert np.allclose(unpacked(packed.area_resize_volumes(v, target))[0], dense(vox.area_resize(rows, x.shape, target), target))
        assert np.allclose(unpacked(packed.occupancy_downsample_volumes(v, target))[0], dense(vox.occupancy_downsample(rows, x.shape, target), target))
    assert np.allclose(unpacked(packed.occupancy_downsample_volumes(v, (9, 2, 2)))[0], dense(vox.occupancy_downsample(rows, x.shape, (9, 2, 2)), (9, 2, 2)))
    plane = np.zeros((12, 12, 1))
    plane[1, 7, 0] = 255
    assert (unpacked(packed.occupancy_downsample_volumes(volumes(spark, [plane]), (6, 6, 1)))[0] > 0).sum() == 1


def test_packed_volumes_of_many_shapes_in_one_pass(spark):
    r = np.random.default_rng(8)
    arrays = [r.normal(size=tuple(r.integers(1, 6, 3))) for _ in range(9)]
    v = volumes(spark, arrays).withColumn("zoom", F.lit(0.5) + F.col("sample_id") / 9).coalesce(1)
    plan = packed.zoom_volumes(v, "zoom", "trilinear")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    got = unpacked(plan)
    for k, x in enumerate(arrays):
        assert np.allclose(got[k], packed.zoomed(x, 0.5 + k / 9, True)) and got[k].shape == x.shape
    assert packed.zoom_volumes(v.limit(0), 0.5).count() == 0


def test_packed_augmentation_is_that_of_voxel_tables(spark):
    x = np.random.default_rng(9).normal(size=(4, 4, 4))
    samples = spark.createDataFrame([(k, "mri", "train" if k else "val") for k in range(6)], "sample_id int, dataset string, split string")
    p = comp.sample_params(samples, 5)
    for kind in ("image", "seg"):
        v = volumes(spark, [x] * 6, kind)
        cells = lambda rows: {tuple(r)[:5]: r["value"] for r in rows.select("sample_id", "kind", "d", "h", "w", "value").collect()}  # noqa: E731, B023
        for mode in ("nearest", "trilinear"):
            fast, slow = cells(packed.augment_volumes(v, p, mode, 5)), cells(comp.augment_voxels(vox.explode_volume(v), p, (4, 4, 4), mode, 5))
            assert fast.keys() == slow.keys() and len(fast) == 6 * 64
            assert all(fast[k] == pytest.approx(slow[k]) for k in slow)
    assert packed.augment_volumes(volumes(spark, [x] * 7), p).count() == 6 * 64


def test_turned_volumes_move_as_voxels(spark):
    x = np.arange(24.0).reshape(2, 3, 4)
    for turns in itertools.product(range(4), repeat=3):
        y = packed.turned(x, dict(zip(("dh", "dw", "hw"), turns)))
        if turns in ((1, 0, 0), (0, 3, 1), (2, 1, 3)):
            assert np.allclose(y, dense(vox.rotate_voxels(voxels(spark, x), turns, x.shape), y.shape))
        assert sorted(y.ravel()) == sorted(x.ravel())


def test_occupancy_keeps_a_thin_branch(spark):
    plane = np.zeros((12, 12, 1))
    plane[1, 7, 0] = 255
    occupied = vox.occupancy_downsample(voxels(spark, plane), (12, 12, 1), (6, 6, 1))
    averaged = vox.binarize(vox.area_resize(voxels(spark, plane), (12, 12, 1), (6, 6, 1)), 0.3)
    assert occupied.where("value > 0").count() == 1 and averaged.where("value > 0").count() == 0
    n = geo.normalize(nodes(spark, [(0, 3, 0)]), (6, 6, 1))
    assert comp.alignment_report(n, occupied, (6, 6, 1), 1).collect()[0]["hit_rate"] == 1


def test_volumes_pad_project_scale_and_noise(spark):
    ramp = np.arange(24.0).reshape(2, 3, 4)
    packed = vox.pack_volume(voxels(spark, ramp), (2, 3, 4))
    assert np.allclose(dense(vox.explode_volume(packed), (2, 3, 4)), ramp)
    padded = dense(vox.pad_voxels(voxels(spark, ramp), (2, 3, 4), (4, 5, 6)), (4, 5, 6))
    assert np.allclose(padded[1:3, 1:4, 1:5], ramp) and padded[0, 0, 0] == -0.5 and np.isfinite(padded).all()
    plane = np.zeros((6, 6, 1))
    plane[2, 4, 0] = 1
    slab = dense(vox.project_2d_to_3d(voxels(spark, plane).drop("w"), 0.5, 5, 6, dense_shape=(6, 6)), (6, 6, 6))
    assert slab.shape == (6, 6, 6) and list(slab[2, 4]) == [-0.5] + [0.5] * 5
    with pytest.raises(ValueError):
        vox.project_2d_to_3d(voxels(spark, plane).drop("w"), 0.5, 4, 6)
    three = voxels(spark, np.array([0.0, 1, 2]).reshape(3, 1, 1))
    assert dense(vox.scale_intensity(three, -0.5, 0.5), (3, 1, 1)).ravel().tolist() == [-0.5, 0, 0.5]
    assert dense(vox.scale_intensity(voxels(spark, np.ones((2, 1, 1))), -0.5, 0.5), (2, 1, 1)).ravel().tolist() == [-0.5, -0.5]
    raw = voxels(spark, np.array([-0.75, 0, 0.75]).reshape(3, 1, 1))
    assert dense(vox.add_noise(raw, 0.0, clamp=(-0.5, 0.5)), (3, 1, 1)).ravel().tolist() == [-0.5, 0, 0.5]
    noise = dense(vox.add_noise(voxels(spark, np.zeros((20, 20, 10))), 0.1, seed=4), (20, 20, 10))
    assert abs(noise.mean()) < 0.01 and abs(noise.std() - 0.1) < 0.01
    assert [r["value"] for r in vox.binarize(voxels(spark, np.array([76.5, 70]).reshape(2, 1, 1))).orderBy("d").collect()] == [0.5, -0.5]
    assert vox.shift(voxels(spark, np.full((1, 1, 1), 2.0)), -0.5).collect()[0]["value"] == 1.5


def test_foreground_points_are_evenly_thinned(spark):
    x = voxels(spark, np.arange(1.0, 31).reshape(30, 1, 1))
    got = sorted(r["d"] for r in vox.foreground_points(x, 7).collect())
    assert got == sorted({i * 29 // 6 for i in range(7)})


def test_coordinates_of_planes_and_padding(spark):
    xy = spark.createDataFrame([("a", 0, 4 / 6, 2 / 6)], "sample_id string, node_id int, x double, y double")
    padded = geo.pad_nodes(geo.embed_2d(xy, 0.5), (6, 6, 6), (8, 8, 8)).collect()[0]
    assert [padded[a] * 8 for a in AXES] == pytest.approx([3, 5, 4])
    assert geo.pad_inner_nodes(nodes(spark, [(0.25,) * 3]), 64, 5).collect()[0]["d"] == pytest.approx(0.2890625)
    r = geo.to_plot_xyz(nodes(spark, [(0.5, 0.25, 0.75)]), (10, 20, 40)).collect()[0]
    assert (r["x"], r["y"], r["z"]) == (30, 5, 5)


def samples(spark, n=300, split="train"):
    return spark.createDataFrame([(f"s{k:04d}", "mri" if k % 2 else "plants", split) for k in range(n)], "sample_id string, dataset string, split string")


def test_augmentation_parameters(spark):
    assert comp.sample_params(samples(spark, 20, "val"), 1).where("zoom <> 1 or turns.dh + turns.dw + turns.hw > 0 or flip.d or add_noise").count() == 0
    a, b = (sorted(map(str, comp.sample_params(samples(spark).repartition(n), 1).collect())) for n in (2, 5))
    assert a == b
    mri = comp.sample_params(samples(spark), 1).where("clamp_lo is not null").collect()
    assert all(0.6 <= r["zoom"] <= 1 and 0 <= r["noise_std"] <= 0.015 for r in mri) and 0.2 < sum(r["add_noise"] for r in mri) / len(mri) < 0.5
    with pytest.raises(Exception, match="no policy"):
        comp.policy_for(spark.createDataFrame([("a", "ct", "train")], "sample_id string, dataset string, split string")).collect()


def test_augmented_nodes_and_voxels_stay_aligned(spark):
    shape = (17,) * 3
    volume = np.zeros(shape)
    volume[4:7, 7:10, 10:13] = 1
    p = spark.createDataFrame([("a", (1, 2, 3), (True, False, True), 0.75, False, 0.0, None, None)], "sample_id string, turns struct<dh:int,dw:int,hw:int>, flip struct<d:boolean,h:boolean,w:boolean>, zoom double, add_noise boolean, noise_std double, clamp_lo double, clamp_hi double")
    n = comp.augment_nodes(geo.normalize(nodes(spark, [(5, 8, 11)]), shape), p, shape)
    v = comp.augment_voxels(voxels(spark, volume, "seg"), p, shape)
    assert n.collect()[0]["valid"] and comp.alignment_report(n, v, shape).collect()[0]["hit_rate"] == 1


def test_composition_and_balanced_draws(spark):
    s, t = samples(spark, 10), samples(spark, 14).where("sample_id >= 's0010'")
    both = comp.compose(s, t)
    assert both.count() == 14
    draws = comp.balanced_sample(both, 3).collect()
    assert len(draws) == 20 and {r["domain"] for r in draws} == {0, 1}
    with pytest.raises(ValueError):
        comp.compose(s, t.limit(0))
    batches = comp.make_batches(s, 4, ["split"]).orderBy("batch_id").collect()
    assert [len(r["items"]) for r in batches] == [4, 4, 2]
    assert comp.filter_supervised(both, False).count() == 10


def three_queries(spark):
    b = (0.5,) * 6
    rows = [("a", 0, [0.0, 4.0], b, [4.0, 1.0]), ("a", 1, [0.0, 3.0], b, [1.0, 5.0]), ("a", 2, [4.0, 0.0], b, [2.0, 3.0])]
    return spark.createDataFrame(rows, "sample_id string, query_id int, logits array<double>, box struct<d:double,h:double,w:double,sd:double,sh:double,sw:double>, token array<double>")


def test_queries_to_graphs(spark):
    # A linear head that returns the first two numbers of (left, right): its mean is (2.5, 2.5).
    head = [(np.eye(4)[:, [0, 1]], np.zeros(2))]
    n, e = inf.infer_graphs(three_queries(spark), head, edge_threshold=0.49)
    assert [r["query_id"] for r in n.orderBy("node_id").collect()] == [0, 1]
    row = e.collect()
    assert [(r["src"], r["dst"]) for r in row] == [(0, 1)] and row[0]["score"] == pytest.approx(1 / (1 + np.exp(-0.5)))
    n, e = inf.infer_graphs(three_queries(spark), head, 0.97, 0.9)
    assert n.count() == 1 and e.count() == 0


@pytest.mark.parametrize("layers", [1, 2, 3])
@pytest.mark.parametrize("relation", [0, 3])
def test_relations_in_both_orders_as_a_plain_network(spark, layers, relation, monkeypatch):
    monkeypatch.setattr(inf, "SCORED_PAIRS", 5)
    r = np.random.default_rng(layers)
    sizes = [8 + relation, *[6] * (layers - 1), 2]
    head = [(r.normal(size=(i, o)), r.normal(size=o)) for i, o in zip(sizes, sizes[1:])]
    tokens = {(s, k): r.normal(size=4) for s, n in (("a", 7), ("b", 1), ("c", 2), ("d", 4)) for k in range(n)}
    shared = {s: r.normal(size=relation) for s in "abc"}
    nodes = spark.createDataFrame([(s, k, x.tolist()) for (s, k), x in tokens.items()], "sample_id string, node_id int, token array<double>").repartition(3)
    rel = spark.createDataFrame([(s, x.tolist()) for s, x in shared.items()], "sample_id string, token array<double>") if relation else None
    got = {(x["sample_id"], x["src"], x["dst"]): (x["l0"], x["l1"], x["score"], x["p"]) for x in inf.score_relations(nodes, head, rel).collect()}
    soft = lambda x: 1 / (1 + np.exp(x[0] - x[1]))
    want = {}
    for (s, i), x in tokens.items():
        for j in range(i + 1, 9):
            if (s, j) in tokens and (not relation or s in shared):
                y, z = tokens[s, j], shared[s] if relation else []
                both = [inf.relation_head(head, np.concatenate(parts)) for parts in ((x, y, z), (y, x, z))]
                mean = (both[0] + both[1]) / 2
                want[s, i, j] = (*mean, soft(mean), (soft(both[0]) + soft(both[1])) / 2)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_relations_of_no_nodes(spark):
    nodes = spark.createDataFrame([], "sample_id string, node_id int, token array<double>")
    assert inf.score_relations(nodes, [(np.zeros((4, 2)), np.zeros(2))]).count() == 0


def test_schedules_at_their_bounds(spark):
    e = spark.createDataFrame([(k,) for k in (0, 1, 9, 10, 11, 20, 30)], "e int")
    values = lambda x: [r[0] for r in e.select(x).collect()]
    assert values(loss.linear_progress(F.col("e"), 20, 2, 10, 10)) == [20, 20, 20, 20, 2, 2, 2]
    assert values(loss.linear_progress(F.col("e"), 4, 2, 10, 20)) == pytest.approx([4, 4, 4, 4, 3.8, 2, 2])
    assert values(loss.linear_progress(F.col("e"), 4, 2, 0, 0)) == [4, 2, 2, 2, 2, 2, 2]
    assert values(loss.candidate_weight(F.col("e"), 0.5, 10, 0)) == [0, 0, 0, 0, 0.5, 0.5, 0.5]
    assert values(loss.candidate_weight(F.col("e"), 0.5, 0, 10)) == pytest.approx([0.05, 0.05, 0.45, 0.5, 0.5, 0.5, 0.5])
    assert values(loss.candidate_weight(F.col("e"), -0.5, 0, 0)) == [0] * 7
    assert values(loss.candidate_weight(F.col("e"), 0.5, -3, -4)) == [0.5] * 7
    for bounds in ((20, 10), (-1, 10), (10, 101)):
        with pytest.raises(ValueError):
            loss.linear_progress(F.col("e"), 0, 1, *bounds)


def loss_rows(spark, logits, labels):
    return spark.createDataFrame([(float(a), float(b), y) for (a, b), y in zip(logits, labels)], "l0 double, l1 double, label int")


def test_classification_losses(spark):
    rows = loss_rows(spark, [(1, -0.5), (-1, 2)], [0, 1])
    p = [1 / (1 + np.exp(-1.5)), 1 / (1 + np.exp(-3))]
    want = -(0.25 * np.log(p[0]) + 0.75 * np.log(p[1]))
    assert loss.weighted_ce(rows, (0.25, 0.75)).collect()[0][0] == pytest.approx(want)
    assert loss.focal(rows, (0.25, 0.75), 0.0).collect()[0][0] == pytest.approx(want)
    extreme = loss.focal(loss_rows(spark, [(100, -100), (-100, 100)], [0, 1]), gamma=0.5).collect()[0][0]
    assert np.isfinite(extreme) and abs(extreme) < 1e-6


def test_assignment_is_the_cheapest(spark):
    r = np.random.default_rng(2)
    for n, m in ((2, 2), (3, 5), (4, 4), (1, 3)):
        cost = np.round(r.normal(size=(n, m)), 1)
        got = loss.cheapest_assignment(cost)
        assert sorted(i for i, _ in got) == list(range(n)) and len({j for _, j in got}) == n
        best = min(sum(cost[i, j] for i, j in enumerate(pick)) for pick in itertools.permutations(range(m), n))
        assert sum(cost[i, j] for i, j in got) == pytest.approx(best)


def test_matching_of_queries_and_edges(spark):
    at = [(0.15, 0.20, 0.25), (0.45, 0.50, 0.55), (0.75, 0.70, 0.65), (0.05, 0.90, 0.10)]
    rows = [("a", i, g, (*p, 0.2, 0.2, 0.2)) for i, (g, p) in enumerate(zip([[0.0, 4.0], [0.0, 3.0], [0.0, 2.0], [3.0, 0.0]], at))]
    q = spark.createDataFrame(rows, "sample_id string, query_id int, logits array<double>, box struct<d:double,h:double,w:double,sd:double,sh:double,sw:double>")
    t = spark.createDataFrame([("a", i, *p) for i, p in enumerate(at[:3])], "sample_id string, target_id int, d double, h double, w double")
    a = loss.assign(loss.match_cost(q, t))
    assert sorted((r["query_id"], r["target_id"]) for r in a.collect()) == [(0, 0), (1, 1), (2, 2)]
    assert loss.assign(loss.match_cost(q, t.limit(0))).count() == 0
    assert loss.node_l1(q, t, a).collect()[0][0] == pytest.approx(0) and loss.box_giou_loss(q, t, a).collect()[0][0] == pytest.approx(0)
    assert loss.cardinality_error(q, a).collect()[0][0] == 0
    e = spark.createDataFrame([("a", 0, 1), ("a", 1, 2)], "sample_id string, src int, dst int")
    pool = loss.edge_pool(a, loss.local_true_edges(e, a), 10, 10).collect()
    assert {(r["src"], r["dst"]): r["label"] for r in pool} == {(0, 1): 1, (1, 2): 1, (0, 2): 0}
    some = spark.createDataFrame([("a", 0, 0), ("a", 2, 1)], "sample_id string, query_id int, target_id int")
    e = spark.createDataFrame([("a", 0, 1), ("a", 0, 2)], "sample_id string, src int, dst int")
    pool = loss.edge_pool(some, loss.local_true_edges(e, some), 10, 10).collect()
    assert [(r["src"], r["dst"], r["label"]) for r in pool] == [(0, 1, 1)]


def test_upsampling_and_hard_selection(spark):
    rows = spark.createDataFrame([(0, k, int(k < 2)) for k in range(7)], "batch int, row_id int, label int")
    got = loss.ratio_upsample(rows, 0.75, 0.0).collect()
    assert len(got) == 8 and sum(r["label"] for r in got) == 3 and [r["row_id"] for r in got if r["copy"]] == [0]
    pairs = spark.createDataFrame([("a", 0, 1, 2.0, -1.0), ("a", 0, 2, 0.0, 2.0), ("a", 1, 2, -1.0, 3.0)], "sample_id string, left int, right int, l0 double, l1 double")
    assert [(r["left"], r["right"]) for r in loss.hard_negatives(pairs, 1).collect()] == [(1, 2)] and loss.hard_negatives(pairs, 0).count() == 3
    q = spark.createDataFrame([("a", 0, [3.0, -2.0]), ("a", 1, [-1.0, 2.0]), ("a", 2, [0.0, 1.0])], "sample_id string, query_id int, logits array<double>")
    taken = spark.createDataFrame([("a", 0)], "sample_id string, query_id int")
    active = loss.active_unmatched(q, taken, 0.5, 2)
    assert active.count() == 2 and loss.unmatched_pairs(active, taken).count() == 3


def test_schedules_and_totals(spark):
    e = spark.createDataFrame([(10,), (20,), (30,)], "e int")
    assert [r[0] for r in e.select(loss.candidate_weight(F.col("e"), 0.1, 10, 20)).collect()] == pytest.approx([0, 0.05, 0.1])
    assert [r[0] for r in e.select(loss.linear_progress(F.col("e"), 0, 2, 10, 30)).collect()] == [0, 1, 2]
    one = lambda v: spark.createDataFrame([(float(x),) for x in v], "loss double")
    assert loss.edge_loss(one([2, 2, 2]), one([1, 1]), 0.5).collect()[0][0] == pytest.approx(1.75)
    parts = spark.createDataFrame([("nodes", 2.0), ("edges", 3.0), ("other", 9.0)], "name string, value double")
    assert loss.total_loss(parts, {"nodes": 1.0, "edges": 2.0}).collect()[0][0] == 8


# --- files and streams --------------------------------------------------------------------------


def nifti(array):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *array.shape, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 16)
    struct.pack_into("<3f", head, 108, 352.0, 0.0, 0.0)
    return bytes(head) + array.astype("<f4").tobytes(order="F")


def png(array):
    raw = b"".join(b"\x00" + bytes(row) for row in array.astype(np.uint8))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", array.shape[1], array.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def vtp(points, lines):
    flat = np.array(points, "<f4").tobytes()
    coded = base64.b64encode(struct.pack("<I", len(flat)) + flat).decode()
    cells = " ".join(str(x) for e in lines for x in e)
    ends = " ".join(str(2 * (i + 1)) for i in range(len(lines)))
    return f'<VTKFile type="PolyData"><PolyData><Piece><Points><DataArray type="Float32" format="binary">{coded}</DataArray></Points><Lines><DataArray Name="connectivity" type="Int32" format="ascii">{cells}</DataArray><DataArray Name="offsets" type="Int32" format="ascii">{ends}</DataArray></Lines></Piece></PolyData></VTKFile>'.encode()


def make_split(root):
    for d in ("raw", "seg", "vtp"):
        (root / "train" / d).mkdir(parents=True)
    x = np.arange(24.0).reshape(2, 3, 4)
    for name, packed in (("sample_b", False), ("sample_a", True)):
        end, body = (".nii.gz", gzip.compress(nifti(x))) if packed else (".nii", nifti(x))
        (root / "train/raw" / f"{name}_data{end}").write_bytes(body)
        (root / "train/seg" / f"{name}_seg{end}").write_bytes(body)
        (root / "train/vtp" / f"{name}_graph.vtp").write_bytes(vtp([(0, 0, 0), (0.5, 0.25, 0.125), (1, 1, 1)], [(0, 1), (1, 2)]))
    return x


def test_listing_and_readers(spark, tmp_path):
    x = make_split(tmp_path)
    s = files.discover_triplets(spark, str(tmp_path), "train", "mri")
    assert [r["sample_id"] for r in s.collect()] == ["sample_a", "sample_b"]
    for r in files.load_volumes(spark, s).collect():
        assert np.allclose(np.array(r["data"]).reshape(r["shape"]["d"], r["shape"]["h"], r["shape"]["w"]), x)
    n, e = files.load_graphs(spark, s)
    assert n.count() == 6 and sorted((r["src"], r["dst"]) for r in e.where("sample_id = 'sample_a'").collect()) == [(0, 1), (1, 2)]
    assert [r["d"] for r in n.where("sample_id = 'sample_b'").orderBy("node_id").collect()] == [0, 0.5, 1]
    manifest = files.checksum_manifest(spark, str(tmp_path)).collect()
    assert len(manifest) == 6 and all(r["sha256"] == hashlib.sha256(open(r["path"].removeprefix("file:"), "rb").read()).hexdigest() for r in manifest)
    (tmp_path / "train/vtp/sample_a_graph.vtp").unlink()
    with pytest.raises(ValueError, match="Incomplete sample"):
        files.discover_triplets(spark, str(tmp_path), "train", "mri")


def test_png(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 256, (5, 7))
    (tmp_path / "p.png").write_bytes(png(x))
    s = spark.createDataFrame([("p", f"file:{tmp_path}/p.png")], "sample_id string, image_path string")
    r = files.load_volumes(spark, s).collect()[0]
    assert np.array(r["data"]).reshape(5, 7).tolist() == x.tolist()


def filtered(x, kinds):
    """PNG bytes of pixels (h, w, channels), each line with a filter of its own."""
    h, w, c = x.shape
    flat, raw = x.reshape(h, w * c).astype(int), b""
    for y in range(h):
        line = bytearray([kinds[y % len(kinds)]])
        for i in range(w * c):
            a = flat[y, i - c] if i >= c else 0
            b = flat[y - 1, i] if y else 0
            d = flat[y - 1, i - c] if y and i >= c else 0
            paeth = min((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d))[2]
            line.append(int(flat[y, i] - (0, a, b, (a + b) // 2, paeth)[line[0]]) % 256)
        raw += bytes(line)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (3,), (4,), (4, 0, 3, 1, 2)])
def test_png_filters_and_channels(channels, kinds):
    x = np.random.default_rng(3).integers(0, 256, (9, 6, channels))
    grey = x[:, :, 0] if channels < 3 else (x[:, :, 0] * 19595 + x[:, :, 1] * 38470 + x[:, :, 2] * 7471 + 32768) >> 16
    assert (files._png(filtered(x, kinds))[:, :, 0] == grey).all()


def test_plants_layout_and_written_png(spark, tmp_path):
    x = np.random.default_rng(4).integers(0, 256, (6, 5))
    v = spark.createDataFrame([("test/raw/p_data.png", (6, 5, 1), x.ravel().tolist()), ("test/seg/p_seg.png", (6, 5, 1), x.ravel().tolist())], "path string, shape struct<d:int,h:int,w:int>, data array<long>")
    assert files.write_files(files.encode_png(v), str(tmp_path)) == 2
    (tmp_path / "test/vtp").mkdir()
    (tmp_path / "test/vtp/p_graph.vtp").write_bytes(vtp([(0, 0, 0), (1, 1, 1)], [(0, 1)]))
    found = files.discover_triplets(spark, str(tmp_path), "test", "plants", layout="plants")
    for column in ("image_path", "seg_path"):
        r = files.load_volumes(spark, found, column).first()
        assert np.array(r["data"]).reshape(6, 5).tolist() == x.tolist()
    with pytest.raises(ValueError, match="no mri images"):
        files.discover_triplets(spark, str(tmp_path), "test", "plants")


def test_splits_do_not_mix(spark, tmp_path):
    make_split(tmp_path)
    (tmp_path / "train").rename(tmp_path / "val")
    for folder, end in (("raw", "_data.nii"), ("seg", "_seg.nii"), ("vtp", "_graph.vtp")):
        for path in (tmp_path / "val" / folder).iterdir():
            path.rename(str(path).replace("sample", "other"))
    make_split(tmp_path)
    ids = lambda root, split, **k: [r["sample_id"] for r in files.discover_triplets(spark, str(root), split, "mri", **k).collect()]
    assert ids(tmp_path, "train") == ids(tmp_path, "train", allow_direct=False) == ["sample_a", "sample_b"]
    assert ids(tmp_path, " VAL ") == ids(tmp_path / "val", "test") == ["other_a", "other_b"]
    with pytest.raises(ValueError, match="no folder"):
        ids(tmp_path / "val", "test", allow_direct=False)
    with pytest.raises(ValueError, match="no folder"):
        ids(tmp_path, "test")
    with pytest.raises(ValueError, match="unknown split"):
        ids(tmp_path, "training")


def test_an_image_with_both_ends_is_two_samples_with_masks_of_their_own(spark, tmp_path):
    make_split(tmp_path)
    for kind, name in (("raw", "data"), ("seg", "seg")):
        packed = (tmp_path / "train" / kind / f"sample_a_{name}.nii.gz").read_bytes()
        (tmp_path / "train" / kind / f"sample_a_{name}.nii").write_bytes(gzip.decompress(packed))
    rows = files.discover_triplets(spark, str(tmp_path), "train", "mri").collect()
    ends = [(r["sample_id"], r["image_path"].rpartition("_data")[2], r["seg_path"].rpartition("_seg")[2]) for r in rows]
    assert ends == [("sample_a", ".nii", ".nii"), ("sample_a", ".nii.gz", ".nii.gz"), ("sample_b", ".nii", ".nii")]
    (tmp_path / "train/seg/sample_a_seg.nii").unlink()
    with pytest.raises(ValueError, match="Incomplete sample: sample_a"):
        files.discover_triplets(spark, str(tmp_path), "train", "mri")


def test_line_cells(spark):
    flat = lambda rows: files.decode_line_cells(spark.createDataFrame([("a", x) for x in rows], "sample_id string, cells array<int>"))
    assert [(r["src"], r["dst"]) for r in flat([[2, 0, 1, 2, 1, 2], []]).collect()] == [(0, 1), (1, 2)]
    for wrong in ([3, 0, 1], [2, 0]):
        with pytest.raises(Exception, match="lines of two points"):
            flat([wrong]).collect()


def test_selection_and_caps(spark):
    pick = lambda n, k: [r["id"] for r in files.select_evenly_spaced(spark.range(n), "id", k).orderBy("id").collect()]
    assert pick(10, 4) == [0, 3, 6, 9] and pick(2, 8) == [0, 1] and pick(5, 1) == [0]
    with pytest.raises(ValueError):
        pick(3, 0)
    s = samples(spark, 3)
    assert [r["sample_id"] for r in files.cap_samples(s, 2).collect()] == ["s0000", "s0001"] and files.cap_samples(s, None).count() == 3
    with pytest.raises(ValueError):
        files.cap_samples(s, 0)


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([("a", 1.0, float("nan"))], "sample_id string, beta0_absolute_error double, smd double")
    files.write_per_sample_metrics(m, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()[0].asDict() == {"sample_id": "a", "beta0_absolute_error": "1.0", "smd": None}
    files.write_summary(m.drop("sample_id"), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).collect()[0][0] == '{"beta0_absolute_error":1.0,"smd":null}'
    n = spark.createDataFrame([("a", 0, 0.9), ("a", 1, 0.8)], "sample_id string, node_id int, score double")
    e = spark.createDataFrame([("a", 0, 1, 0.7)], "sample_id string, src int, dst int, score double")
    files.write_predictions(n, e, m, str(tmp_path / "pred"))
    r = spark.read.json(str(tmp_path / "pred")).collect()[0]
    assert [(x["src"], x["dst"]) for x in r["edges"]] == [(0, 1)] and len(r["nodes"]) == 2 and r["metrics"]["smd"] is None


def test_history_and_streams(spark, tmp_path):
    path, schema = str(tmp_path / "history"), files.METRICS
    values = [("r", 1, "edge_mAP", 0.2), ("r", 2, "edge_mAP", 0.5), ("r", 3, "edge_mAP", 0.4)]
    for v in values[:2]:
        files.append_metric_history(spark.createDataFrame([v], schema), path)
    assert files.read_metric_history(spark, path).count() == 2
    got = str(tmp_path / "best")

    def follow():
        rows = runs.stream_best(files.read_metric_history(spark, path, stream=True).select("run_id", "name", "epoch", "value"))
        sink = lambda batch, _: batch.write.mode("append").parquet(got)
        rows.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
        return max(r["value"] for r in spark.read.parquet(got).collect()), spark.read.parquet(got).count()

    assert follow()[0] == 0.5
    files.append_metric_history(spark.createDataFrame([values[2]], schema), path)
    # After a restart the record still holds.
    before = spark.read.parquet(got).count()
    assert follow() == (0.5, before)


def test_a_resumed_run_ignores_epochs_that_do_not_beat_its_record(spark):
    history = spark.createDataFrame([("r", "m", 1, 0.4), ("r", "m", 2, 0.6), ("r", "m", 3, float("nan")), ("s", "m", 1, 0.1), ("t", "m", 1, None)], "run_id string, name string, epoch int, value double")
    records = spark.createDataFrame([("r", "m", "max", 0.5), ("r", "m", "min", 9.0), ("s", "m", "min", 0.05), ("s", "m", "max", float("nan")), ("t", "m", "max", 0.3), ("u", "m", "max", 0.7)], "run_id string, metric string, mode string, value double")
    got = {(r["run_id"], r["epoch"]): (r["best"], r["improved"]) for r in summ.best_so_far(history, "max", records).collect()}
    assert got == {("r", 1): (0.5, False), ("r", 2): (0.6, True), ("r", 3): (0.6, False), ("s", 1): (0.1, True), ("t", 1): (0.3, False)}
    kept = summ.select_checkpoint(history, "best_only", records=records).collect()
    assert sorted((r["run_id"], r["epoch"]) for r in kept) == [("r", 2), ("s", 1)]
    stored = {r["run_id"]: (r["epoch"], r["value"]) for r in summ.best_records(history, "max", records).collect()}
    assert stored == {"r": (2, 0.6), "s": (1, 0.1), "t": (None, 0.3), "u": (None, 0.7)}
    low = {(r["run_id"], r["epoch"]): r["improved"] for r in summ.best_so_far(history, "min", records).collect()}
    assert low == {("r", 1): True, ("r", 2): False, ("r", 3): False, ("s", 1): False, ("t", 1): False}


def test_a_resumed_stream_starts_from_its_record(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("history", "out", "state"))
    records = spark.createDataFrame([("r", "m", "max", 0.5)], "run_id string, metric string, mode string, value double")
    add = lambda *rows: files.append_metric_history(spark.createDataFrame([("r", e, "m", v) for e, v in rows], files.METRICS), path)

    def follow():
        stream = runs.stream_best(files.read_metric_history(spark, path, stream=True).select("run_id", "name", "epoch", "value"), records=records)
        runs.write_once(stream, out, state).awaitTermination()
        return sorted((r["epoch"], r["value"]) for r in runs.read_written(stream, out).collect())

    add((1, 0.3), (2, 0.5))
    assert follow() == []
    add((3, 0.6), (4, 0.55))
    assert follow() == [(3, 0.6)]
    add((5, 0.6))
    assert follow() == [(3, 0.6)]


def test_a_batch_that_failed_after_writing_stands_there_once(spark, tmp_path, monkeypatch):
    path, out, state = (str(tmp_path / x) for x in ("history", "out", "state"))
    for e in range(4):
        files.append_metric_history(spark.createDataFrame([("r", e, "m", float(e))], files.METRICS).coalesce(1), path)
    stream = runs.stream_best(files.read_metric_history(spark, path, stream=True, files_per_batch=1).select("run_id", "name", "epoch", "value"))
    writer, failed = type(spark.range(1).write), []
    parquet = writer.parquet

    def dies(self, to, *args, **more):
        parquet(self, to, *args, **more)
        if to.endswith("batch=1") and not failed:
            failed.append(to)
            raise RuntimeError("killed")

    monkeypatch.setattr(writer, "parquet", dies)
    with pytest.raises(Exception, match="killed"):
        runs.write_once(stream, out, state).awaitTermination()
    assert failed and len(runs.read_written(stream, out).collect()) == 2
    runs.write_once(stream, out, state).awaitTermination()
    rows = [(r["epoch"], r["value"]) for r in runs.read_written(stream, out).collect()]
    assert len(rows) == len(set(rows)) and max(rows) == (3, 3.0)


def test_a_watermark_drops_late_rows_and_bounds_the_state(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    schema = "run_id string, epoch int, name string, value double, at timestamp"

    def add(*rows):
        spark.createDataFrame([("r", d, "m", v) for d, v in rows], "run_id string, epoch int, name string, value double").selectExpr("*", "timestamp('2024-01-01 12:00:00') + make_interval(0, 0, 0, epoch) AS at").coalesce(1).write.mode("append").json(path)

    def follow():
        means = runs.stream_epoch_means(spark.readStream.schema(schema).json(path), "at")
        query = runs.write_once(means, out, state)
        query.awaitTermination()
        operators = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        rows = sorted((r["epoch"], r["value"], r["n"]) for r in runs.read_written(means, out).collect())
        return rows, operators[-1]["numRowsTotal"], sum(o["numRowsDroppedByWatermark"] for o in operators)

    add((0, 1.0), (0, 3.0), (2, 5.0))
    assert follow() == ([(0, 2.0, 2)], 1, 0)
    add((0, 100.0), (2, 7.0))  # the first day has left the state
    assert follow() == ([(0, 2.0, 2)], 1, 1)
    add((5, 1.0))
    assert follow() == ([(0, 2.0, 2), (2, 6.0, 2)], 1, 0)


def test_nodes_outside_before_the_motion_are_not_valid(spark):
    inside = {"d": 0.5, "h": 0.5, "w": 0.5}
    n = spark.createDataFrame([(1, 0, *inside.values()), (1, 1, 1.2, 0.5, 0.5)], "sample_id int, node_id int, d double, h double, w double")
    p = spark.createDataFrame([(1, (0, 0, 0), (False, False, False), 0.6)], "sample_id int, turns struct<dh:int,dw:int,hw:int>, flip struct<d:boolean,h:boolean,w:boolean>, zoom double")
    assert {r["node_id"]: r["valid"] for r in comp.augment_nodes(n, p, (10, 10, 10)).collect()} == {0: True, 1: False}

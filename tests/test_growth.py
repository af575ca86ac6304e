"""What a task, the driver and the shuffles hold must not grow with the tables."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.functions import storage
from graphloom.functions.storage import dealt
from graphloom.operators import compose as comp
from graphloom.operators import detection as det
from graphloom.operators import packed
from graphloom.operators import topology as topo
from graphloom.operators import transport
from graphloom.plans import canonical as c
from graphloom.plans import registry
from graphloom.sources import files
from graphloom.streaming import runs

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_follow_the_rows(spark):
    assert [dealt(spark.range(n), "id", rows=100, least=1000).rdd.getNumPartitions() for n in (0, 100, 1000, 4000)] == [1, 1, 10, 40]


@tables
@pytest.mark.parametrize("make", [
    lambda n: c.target_edges(n), lambda n: c.candidates(n), lambda n: topo.graph_filtration(n, c.candidates(n)), lambda n: topo.h1_classes(c.candidates(n)),
    lambda n: topo.canonical_edges(n, c.target_edges(n)), lambda n: transport.graph_point_cloud(n, c.target_edges(n)),
    lambda n: transport.sinkhorn_distance(*[transport.graph_point_cloud(n, e, packed=True) for e in (c.target_edges(n), c.predicted_edges(n))]),
])
def test_samples_are_dealt_out_once(spark, make):
    assert "ENSURE_REQUIREMENTS" not in plan(make(c.nodes(spark, SF)))


@tables
@pytest.mark.parametrize("name", ["p05_sinkhorn_small", "m11_evaluate_without_transport", "p02_sinkhorn_distance", "p03_street_mover_distance", "m01_evaluate_graphs"])
def test_rows_of_samples_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in plan(registry.queries()[name](spark, SF))


def test_large_volumes_leave_a_task_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(packed, "BATCH_VALUES", 100)

    class Rows:
        schema = StructType().add("sample_id", "long")
        select = lambda self, *names: self
        mapInArrow = lambda self, f, schema: f

    shape = [{"d": 2, "h": 1, "w": 1}] * 40
    batch = pa.RecordBatch.from_pydict({"sample_id": list(range(40)), "kind": ["image"] * 40, "shape": shape, "data": [[float(i), 1.0] for i in range(40)]})
    out = list(packed.per_volume(Rows(), lambda x: np.repeat(x, 20, 1))(iter([batch])))
    assert max(len(b.column("data").values) for b in out) <= 140 and len(out) == 14
    assert [r[0] for b in out for r in b.column("data").to_pylist()] == list(range(40))


def test_tasks_list_and_read_files(spark, tmp_path):
    for name in ("train/raw/a b%20_data.nii", "train/raw/.hidden", "train/raw/_SUCCESS", "top.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    listed = files.listing(spark, str(tmp_path))
    assert "binaryFile" not in plan(listed)
    spark_lists = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    assert sorted(r["path"] for r in listed.collect()) == sorted(r["path"] for r in spark_lists.select("path").collect())
    got = files._decoded(spark, listed.withColumn("sample_id", F.col("file")), "path", lambda frames: (f[["sample_id", "content"]] for f in frames), "sample_id string, content binary")
    assert {r[0]: bytes(r[1]).decode() for r in got.collect()} == {"a b%20_data.nii": "train/raw/a b%20_data.nii", "top.txt": "top.txt"}


def test_totals_of_few_groups_do_not_make_one_task_of_a_group(spark):
    hits = spark.range(100).select((F.col("id") % 2).alias("fold"), F.col("id").alias("sample_id"), F.lit(1).alias("rank"), (F.col("id") / 100).alias("score"), F.array(*[F.lit(True)] * 10).alias("hits"))
    counts = spark.range(100).select((F.col("id") % 2).alias("fold"), F.lit(1).alias("target_count"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pooled = det.pooled_ap_ar(hits, counts, "fold")
        assert "BroadcastHashJoin [fold" in plan(pooled)
        assert sorted(map(tuple, pooled.collect())) == [(0, 1.0, 1.0), (1, 1.0, 1.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("mode", ["max", "min"])
def test_a_stream_is_called_once_a_bucket_of_pairs(spark, tmp_path, monkeypatch, mode):
    monkeypatch.setattr(runs, "BUCKETS", 8, raising=False)
    path, out, state = (str(tmp_path / x) for x in ("history", "out", "state"))
    value = F.when(F.col("id") % 11 == 0, float("nan")).when(F.col("id") % 13 == 0, None).otherwise(F.pmod(F.hash("id"), F.lit(50)) / 10)
    log = spark.range(2000).select(F.when(F.col("id") % 100 > 0, (F.col("id") % 100).cast("string")).alias("run_id"), F.concat(F.lit("m"), F.col("id") % 3).alias("name"), F.floor(F.col("id") / 300).cast("int").alias("epoch"), value.alias("value"))
    records = spark.createDataFrame([(str(k), "m1", mode, 3.0) for k in range(1, 60)], "run_id string, metric string, mode string, value double")
    for part in ("epoch < 3", "epoch >= 3"):
        files.append_metric_history(log.where(part), path)
        stream = runs.stream_best(files.read_metric_history(spark, path, stream=True).select("run_id", "name", "epoch", "value"), mode, records)
        query = runs.write_once(stream, out, state, "append")
        query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
    best, want = {(str(k), "m1"): 3.0 for k in range(1, 60)}, []
    for r in sorted(log.collect(), key=lambda r: (r["epoch"], r["value"] is None, r["value"] or 0)):
        pair, v = (r["run_id"], r["name"]), r["value"]
        if v is not None and v == v and (pair not in best or (v > best[pair] if mode == "max" else v < best[pair])):
            best[pair] = v
            want.append((*pair, r["epoch"], v))
    assert sorted(map(str, map(tuple, runs.read_written(stream, out).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_improvements_of_a_bucket_agree_with_one_row_after_the_other(sign):
    rng = np.random.default_rng(5)
    for n in (0, 1, 300):
        pairs = [(r, m) for r in ("a", "b", None, "d") for m in ("m", "n", None)]
        known = pairs[:5] if n else []
        rows = [pairs[i] for i in rng.integers(0, len(pairs), n)]
        run, name = (np.array([p[k] for p in known + rows], object) for k in (0, 1))
        epoch = np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 9, n))
        value = rng.choice([-np.inf, np.nan, -1.0, -0.0, 0.0, 0.5, 1.0, 2.0], n)
        record = np.array([1.0 if p[1] == "n" else np.nan for p in rows])
        first, best, better = runs._improvements(run, name, np.arange(len(known)) / 4, epoch, value, record, sign)
        have = {p: 1.0 for p in rows if p[1] == "n"} | {p: i / 4 for i, p in enumerate(known)}
        want = []
        for i in sorted(range(n), key=lambda i: (np.isnan(epoch[i]), epoch[i], np.isnan(value[i]), sign * value[i])):
            if np.isfinite(value[i]) and value[i] > have.get(rows[i], -np.inf):
                have[rows[i]] = value[i]
                want.append(i)
        assert {p: b for p, b in zip(zip(run[first], name[first]), best) if np.isfinite(b)} == have
        at = lambda i: (rows[i], str(epoch[i]), value[i])
        assert sorted(map(str, map(at, better))) == sorted(map(str, map(at, want)))


def test_nodes_of_an_alignment_report_are_not_multiplied(spark):
    shape, n = (51, 11, 9), c.nodes(spark, SF) if Path(SF).exists() else None
    if n is not None:
        text = plan(comp.alignment_report(n, c.foreground(n).where("(d + h) % 2 = 0"), shape, 1))
        assert "Generate" not in text and "ENSURE_REQUIREMENTS" not in text
    rows = [("a", 0, 0.0, 0.0, 0.0), ("a", 1, 50 / 51, 10 / 11, 8 / 9), ("a", 2, 25 / 51, 0.0, 0.0), ("a", 3, None, 0.0, 0.0), ("b", 0, 0.0, 0.0, 0.0), ("c", 0, None, None, None), (None, 0, 0.0, 0.0, 0.0)]
    nodes = spark.createDataFrame(rows, "sample_id string, node_id int, d double, h double, w double").repartition(3)
    ground = [("a", 1, 1, 1, 1.0), ("a", 49, 9, 10, 1.0), ("a", 24, 0, -2, 1.0), ("a", 25, 0, 2, 1.0), ("a", 26, 1, 0, 0.0), ("z", 0, 0, 0, 1.0), (None, 0, 0, 0, 1.0), ("a", None, 0, 0, 1.0), ("a", 10**9, 10**9, 10**9, 1.0)]
    found = spark.createDataFrame(ground, "sample_id string, d int, h int, w int, value double")
    got = {radius: {r["sample_id"]: r["hit_rate"] for r in comp.alignment_report(nodes, found, shape, radius).collect()} for radius in (0, 1, 2)}
    assert got == {0: {"a": 0.0, "b": 0.0, "c": 0.0, None: 0.0}, 1: {"a": 0.25, "b": 0.0, "c": 0.0, None: 0.0}, 2: {"a": 0.75, "b": 0.0, "c": 0.0, None: 0.0}}


def test_many_tasks_are_dealt_out_through_few(spark, monkeypatch):
    monkeypatch.setattr(storage, "DIRECT_TASKS", 4, raising=False)
    for n, exchanges in ((400, 1), (4000, 2)):
        got = dealt(spark.range(n), "id", rows=100, least=1000)
        assert plan(got).count("REPARTITION_BY_NUM") == exchanges
        assert got.rdd.getNumPartitions() == n // 100 and sorted(r[0] for r in got.collect()) == list(range(n))


@tables
def test_written_predictions_are_compressed_and_points_rounded_without_decimals(spark):
    assert all(x.endswith(".json.gz") for x in registry.queries()["s15_written_predictions"](spark, SF).inputFiles())
    assert ", 6) AS" not in plan(registry.queries()["p04_point_cloud_of_protocol"](spark, SF))
    values = spark.range(20000).select((F.col("id") / 51 % 1).alias("x"))
    assert values.select(*registry.n6("x")).exceptAll(values.select(*registry.r6("x"))).count() == 0

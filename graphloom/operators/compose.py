"""Augmentation parameters, composition of training sets and batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import AXES, uniform
from . import geometry as g
from . import voxels as v
from .kernels import numbers, per_sample
from .ordering import with_position

# Training policies (zoom range, flips, noise, clamp); other splits change nothing.
POLICIES = {
    "mri": {"zoom": (0.6, 1.0), "flip": 0.5, "noise_p": 0.35, "noise_std": (0.0, 0.015), "clamp": (-0.5, 0.5)},
    "plants": {"zoom": (0.6, 1.0), "flip": 0.5, "noise_p": 0.0, "noise_std": (0.0, 0.0), "clamp": None},
}

#: Kinds of rows of alignment_report: foreground voxels, nodes, and nodes without a position.
GROUND, NODE, NOWHERE = 0, 1, 2


def policy_for(samples: DataFrame) -> DataFrame:
    """Add `policy`: 'identity' for val and test, the data set's name for train; anything else raises."""
    known = F.col("dataset").isin(*POLICIES)
    unknown = F.raise_error(F.concat(F.lit("no policy for "), F.col("dataset"), F.lit("/"), F.col("split"))).cast("string")
    policy = F.when(~known, unknown).when(F.col("split").isin("val", "test"), F.lit("identity")).when(F.col("split") == "train", F.col("dataset")).otherwise(unknown)
    return samples.withColumn("policy", policy)


def sample_params(samples: DataFrame, seed: int) -> DataFrame:
    """One row of augmentation parameters per sample, from hashes of (seed, field, sample_id)."""
    p = policy_for(samples)
    u = lambda field: uniform(seed, field, F.col("sample_id"))
    live = F.col("policy") != "identity"

    def by_policy(value, default) -> Column:
        out = F.lit(default)
        for name, spec in POLICIES.items():
            out = F.when(F.col("policy") == name, value(spec)).otherwise(out)
        return out

    between = lambda r, x: F.lit(r[0]) + x * (r[1] - r[0])
    turns = F.struct(*[F.when(live, F.floor(u("turn." + n) * 4)).otherwise(F.lit(0)).cast("int").alias(n) for n in ("dh", "dw", "hw")])
    flip = F.struct(*[by_policy(lambda s, a=a: u("flip." + a) < s["flip"], False).alias(a) for a in AXES])
    noisy = by_policy(lambda s: u("noise") < s["noise_p"], False)
    clamp = lambda i: by_policy(lambda s: F.lit(s["clamp"][i] if s["clamp"] else None).cast("double"), None).cast("double")
    return p.select(
        "sample_id", turns.alias("turns"), flip.alias("flip"), by_policy(lambda s: between(s["zoom"], u("zoom")), 1.0).alias("zoom"), noisy.alias("add_noise"),
        F.when(noisy, by_policy(lambda s: between(s["noise_std"], u("noise_std")), 0.0)).otherwise(F.lit(0.0)).alias("noise_std"), clamp(0).alias("clamp_lo"), clamp(1).alias("clamp_hi"),
    )


def augment_nodes(nodes: DataFrame, params: DataFrame, shape) -> DataFrame:
    """Rotate, zoom and flip nodes by the parameters of their sample; adds `valid`: within the volume before and after."""
    size = g.axis_sizes(shape)
    n = g.valid_coordinates(nodes, shape).withColumnRenamed("valid", "_before").join(params.select("sample_id", "turns", "flip", "zoom"), "sample_id")
    n = n.withColumn("new_shape", F.struct(*[size[a].alias(a) for a in AXES]))
    n = g.rotate_nodes(n, "turns", "new_shape")
    n = g.flip_nodes(g.zoom_nodes(n, "zoom", "new_shape"), "flip", "new_shape")
    n = g.valid_coordinates(n, "new_shape")
    return n.withColumn("valid", F.col("valid") & F.col("_before")).drop("turns", "flip", "zoom", "_before")


def augment_voxels(voxels: DataFrame, params: DataFrame, shape, mode: str = "nearest", seed: int = 0) -> DataFrame:
    """The same motion on voxels (the zoom samples nearest or trilinear), then noise and clamp of images."""
    size = g.axis_sizes(shape)
    x = voxels.join(params, "sample_id").withColumn("s0", F.struct(*[size[a].alias(a) for a in AXES]))
    p, s = g.turn({a: F.col(a) for a in AXES}, g.axis_sizes("s0"), g._turns("turns"))
    x = x.withColumns({**{"r" + a: p[a].cast("int") for a in AXES}, "s1": F.struct(*[s[a].alias(a) for a in AXES])})
    x = x.select("sample_id", "kind", *[F.col("r" + a).alias(a) for a in AXES], "value", "s1")
    frames = x.groupBy("sample_id", "kind").agg(F.first("s1").alias("s1")).join(params.select("sample_id", "zoom"), "sample_id")
    cells = v.grid(frames, "s1")
    t = g.axis_sizes("s1")
    source = {a: (F.col(a) - (t[a] - 1) / 2) / F.col("zoom") + (t[a] - 1) / 2 for a in AXES}
    zoomed = v._resample(x.drop("s1"), cells, source, t, mode == "trilinear", 0.0)
    y = zoomed.join(frames.select("sample_id", "kind", "s1"), ["sample_id", "kind"]).join(params.drop("zoom", "turns"), "sample_id")
    y = v.flip_voxels(y, "flip", "s1")
    y = y.withColumn("noise_std", F.when(F.col("kind") == "image", F.col("noise_std")).otherwise(F.lit(0.0)))
    noisy = v.add_noise(y, "noise_std", seed=seed)
    low, high = F.coalesce("clamp_lo", F.lit(float("-inf"))), F.coalesce("clamp_hi", F.lit(float("inf")))
    image = F.greatest(low, F.least(F.col("value"), high))
    return noisy.select("sample_id", "kind", *AXES, F.when(F.col("kind") == "image", image).otherwise(F.col("value")).alias("value"))


def alignment_report(nodes: DataFrame, voxels: DataFrame, shape, radius: int = 0) -> DataFrame:
    """Per sample of `nodes`: share of nodes with foreground within a Chebyshev radius of their voxel."""
    # Both kinds of rows meet by sample, so that what is dealt out by sample stays there and no node is multiplied.
    rows = lambda df, kind, *at: df.select("sample_id", kind.alias("kind"), *[F.col(x).cast("long").alias(a) for x, a in zip(at, AXES)])
    at = g.to_voxel_index(nodes, shape)
    nowhere = F.col("vd").isNull() | F.col("vh").isNull() | F.col("vw").isNull()
    at = rows(at, F.when(nowhere, NOWHERE).otherwise(NODE), "vd", "vh", "vw").na.fill(0, list(AXES))
    ground = rows(voxels.where("value > 0 and sample_id is not null and d is not null and h is not null and w is not null"), F.lit(GROUND), *AXES)

    def kernel(table: pa.Table, code: np.ndarray) -> pa.Table:
        kind = table["kind"].to_numpy()
        voxel = np.stack(numbers(table, *AXES), 1)
        n, found = np.bincount(code[kind != GROUND], minlength=int(code[-1]) + 1), np.zeros(len(code), bool)
        placed = kind == NODE
        if placed.any():
            # Voxels as numbers of a box around all nodes, which has `radius` voxels to spare on each side.
            low, high = voxel[placed].min(0) - radius, voxel[placed].max(0) + radius
            number = lambda at, v: ((at * (high - low + 1)[0] + v[:, 0] - low[0]) * (high - low + 1)[1] + v[:, 1] - low[1]) * (high - low + 1)[2] + v[:, 2] - low[2]
            near = (kind == GROUND) & ((voxel >= low) & (voxel <= high)).all(1)
            solid = np.sort(number(code[near].astype(np.int64), voxel[near]))
            sample, v, hit = code[placed].astype(np.int64), voxel[placed], np.zeros(int(placed.sum()), bool)
            for d in range(-radius, radius + 1):
                for h in range(-radius, radius + 1):
                    middle = number(sample, v + (d, h, 0))
                    hit |= np.searchsorted(solid, middle + radius, "right") > np.searchsorted(solid, middle - radius, "left")
            found[placed] = hit
        asked = np.flatnonzero(n)
        hits = np.bincount(code[found], minlength=len(n))
        return pa.table({"sample_id": table["sample_id"].take(pa.array(np.searchsorted(code, asked))), "hit_rate": hits[asked] / n[asked]})

    return per_sample(at.unionByName(ground), kernel, f"sample_id {at.schema['sample_id'].dataType.simpleString()}, hit_rate double")


def compose(source: DataFrame, target: DataFrame) -> DataFrame:
    """Both roles in one table, domain 0 and 1; an empty side raises when the result is built."""
    for name, side in (("source", source), ("target", target)):
        if not side.limit(1).count():
            raise ValueError(f"the {name} side is empty")
    return source.withColumn("domain", F.lit(0)).unionByName(target.withColumn("domain", F.lit(1)), allowMissingColumns=True)


def balanced_sample(samples: DataFrame, seed: int) -> DataFrame:
    """2 |S| draws with replacement, half of them from each domain on average: (draw, domain, sample_id).

    Source rows weigh 1 and target rows |S| / |T|, so both domains have the same total weight."""
    placed = with_position(samples.select("sample_id", "domain"), "sample_id", ["domain"])
    sizes = {r["domain"]: r["n"] for r in samples.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        raise ValueError("both domains need samples")
    draws = samples.sparkSession.range(2 * sizes[0]).withColumnRenamed("id", "draw")
    domain = F.when(uniform(seed, "domain", F.col("draw")) < 0.5, 0).otherwise(1)
    count = F.when(F.col("domain") == 0, sizes[0]).otherwise(sizes[1])
    draws = draws.withColumn("domain", domain).withColumn("position", F.floor(uniform(seed, "index", F.col("draw")) * count).cast("int"))
    return draws.join(placed, ["domain", "position"]).select("draw", "domain", "sample_id")


def make_batches(samples: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """Consecutive samples in lists of `size`: (batch_id, items)."""
    placed = with_position(samples, "sample_id")
    items = F.array_sort(F.collect_list(F.struct("sample_id", *[c for c in columns if c != "sample_id"])))
    return placed.groupBy(F.floor(F.col("position") / size).cast("int").alias("batch_id")).agg(items.alias("items"))


def filter_supervised(samples: DataFrame, target_supervised: bool) -> DataFrame:
    """Only the source domain where target graphs are not used for supervision."""
    return samples if target_supervised else samples.where("domain = 0")


def collate(rows: DataFrame, order: str, columns: list[str], name: str = "items") -> DataFrame:
    """One ordered list of structs per sample."""
    return rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name))

"""Coordinate geometry on nodes (columns d, h, w; coordinate = voxel index / axis size)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import AXES

#: Quarter turns act in these planes, in this order.
PLANES = (("dh", "d", "h"), ("dw", "d", "w"), ("hw", "h", "w"))


def axis_sizes(shape) -> dict[str, Column]:
    """Sizes per axis from a triple of numbers or the name of a struct column with d, h, w."""
    if isinstance(shape, str):
        return {a: F.col(shape)[a] for a in AXES}
    return {a: F.lit(int(s)) for a, s in zip(AXES, shape)}


def axis_max(shape) -> dict[str, Column]:
    """Largest coordinate per axis: (S - 1) / S."""
    return {a: (s - 1) / s for a, s in axis_sizes(shape).items()}


def normalize(nodes: DataFrame, shape) -> DataFrame:
    return nodes.withColumns({a: F.col(a) / s for a, s in axis_sizes(shape).items()})


def denormalize(nodes: DataFrame, shape) -> DataFrame:
    return nodes.withColumns({a: F.col(a) * s for a, s in axis_sizes(shape).items()})


def to_voxel_index(nodes: DataFrame, shape, clamp: bool = True) -> DataFrame:
    """Add vd, vh, vw: the nearest voxel (half to even), inside the volume with clamp."""

    def index(a: str, s: Column) -> Column:
        v = F.rint(F.col(a) * s)
        return (F.greatest(F.lit(0.0), F.least(v, (s - 1).cast("double"))) if clamp else v).cast("int")

    return nodes.withColumns({"v" + a: index(a, s) for a, s in axis_sizes(shape).items()})


def valid_coordinates(nodes: DataFrame, shape, atol: float = 1e-6) -> DataFrame:
    """Add `valid`: every coordinate within [-atol, max + atol]."""
    ok = F.lit(True)
    for a, top in axis_max(shape).items():
        ok = ok & (F.col(a) >= -atol) & (F.col(a) <= top + atol)
    return nodes.withColumn("valid", ok)


def violations(nodes: DataFrame, shape, atol: float = 1e-6) -> DataFrame:
    """Per sample with invalid nodes: their number and the extent of the coordinates."""
    bad = valid_coordinates(nodes, shape, atol).where("not valid")
    extent = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    return bad.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_invalid"), *extent)


def degrees_to_turns(angle: Column) -> Column:
    """Quarter turns 0..3 of a multiple of 90 degrees; anything else raises."""
    quarter = angle / 90
    wrong = F.raise_error(F.concat(F.lit("not a multiple of 90 degrees: "), angle.cast("string")))
    return F.when(quarter == F.rint(quarter), F.pmod(F.rint(quarter).cast("int"), F.lit(4))).otherwise(wrong.cast("int"))


def turn(position: Mapping[str, Column], size: Mapping[str, Column], turns: Mapping[str, Column]) -> tuple[dict, dict]:
    """Positions (in voxels) and sizes after quarter turns in the three planes."""
    p, s = dict(position), dict(size)
    for name, a, b in PLANES:
        k, pa, pb, sa, sb = turns[name], p[a], p[b], s[a], s[b]
        p[a] = F.when(k == 1, sb - 1 - pb).when(k == 2, sa - 1 - pa).when(k == 3, pb).otherwise(pa)
        p[b] = F.when(k == 1, pa).when(k == 2, sb - 1 - pb).when(k == 3, sa - 1 - pa).otherwise(pb)
        odd = (k % 2) == 1
        s[a], s[b] = F.when(odd, sb).otherwise(sa), F.when(odd, sa).otherwise(sb)
    return p, s


def _turns(turns) -> dict[str, Column]:
    if isinstance(turns, str):
        return {name: F.col(turns)[name] for name, _, _ in PLANES}
    return {name: F.lit(int(k)) for (name, _, _), k in zip(PLANES, turns)}


def rotate_nodes(nodes: DataFrame, turns, shape) -> DataFrame:
    """Rotate nodes by quarter turns; adds `new_shape`, the size of the turned volume."""
    size = axis_sizes(shape)
    p, s = turn({a: F.col(a) * size[a] for a in AXES}, size, _turns(turns))
    return nodes.withColumns({**{a: p[a] / s[a] for a in AXES}, "new_shape": F.struct(*[s[a].alias(a) for a in AXES])})


def _flags(flip) -> dict[str, Column]:
    if isinstance(flip, str):
        return {a: F.col(flip)[a] for a in AXES}
    return {a: F.lit(bool(f)) for a, f in zip(AXES, flip)}


def flip_nodes(nodes: DataFrame, flip, shape) -> DataFrame:
    """v -> S - 1 - v on flagged axes."""
    size, flags = axis_sizes(shape), _flags(flip)
    return nodes.withColumns({a: F.when(flags[a], (size[a] - 1 - F.col(a) * size[a]) / size[a]).otherwise(F.col(a)) for a in AXES})


def zoom_nodes(nodes: DataFrame, factor, shape) -> DataFrame:
    """v -> (v - c) f + c with c = (S - 1) / 2."""
    f = F.col(factor) if isinstance(factor, str) else F.lit(float(factor))

    def moved(a: str, s: Column) -> Column:
        c = (s - 1) / 2
        return ((F.col(a) * s - c) * f + c) / s

    return nodes.withColumns({a: moved(a, s) for a, s in axis_sizes(shape).items()})


def embed_2d(nodes: DataFrame, z) -> DataFrame:
    """(x, y) of a plane to (d, h, w) = (y, x, z)."""
    z = F.col(z) if isinstance(z, str) else F.lit(float(z))
    return nodes.withColumns({"d": F.col("y"), "h": F.col("x"), "w": z}).drop("x", "y")


def pad_nodes(nodes: DataFrame, src, dst) -> DataFrame:
    """Centre a volume of size src in one of size dst; a smaller dst raises."""
    s, t = axis_sizes(src), axis_sizes(dst)

    def moved(a: str) -> Column:
        shifted = (F.col(a) * s[a] + F.floor((t[a] - s[a]) / 2)) / t[a]
        return F.when(t[a] >= s[a], shifted).otherwise(F.raise_error(F.lit("the padded size is smaller")).cast("double"))

    return nodes.withColumns({a: moved(a) for a in AXES})


def pad_inner_nodes(nodes: DataFrame, size: int, padding: int, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Coordinates of an inner square of size - 2 p inside a padded one."""
    return nodes.withColumns({a: (F.col(a) * (size - 2 * padding) + padding) / size for a in axes})


def to_plot_xyz(nodes: DataFrame, shape) -> DataFrame:
    """(x, y, z) = (w, h, d) in voxels."""
    s = axis_sizes(shape)
    return nodes.select("sample_id", "node_id", (F.col("w") * s["w"]).alias("x"), (F.col("h") * s["h"]).alias("y"), (F.col("d") * s["d"]).alias("z"))

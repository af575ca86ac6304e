"""Voxel operators on long tables (sample_id, kind, d, h, w, value).

Tables may be sparse: a voxel that is missing has the value `fill` of the operator.  Everything is keyed
by sample_id and kind; only resampling joins, on the voxel index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import AXES, normal
from .geometry import _flags, _turns, axis_sizes, turn

KEY = ["sample_id", "kind"]


def explode_volume(volumes: DataFrame, *more: str) -> DataFrame:
    """(sample_id, kind, shape, data) to voxels, with further columns of the volume; data is row-major in (d, h, w)."""
    long = volumes.select(*KEY, "shape", *more, F.posexplode("data").alias("pos", "value"))
    h, w = F.col("shape")["h"], F.col("shape")["w"]
    pos = F.col("pos")
    return long.select(*KEY, F.floor(pos / (h * w)).cast("int").alias("d"), (F.floor(pos / w) % h).cast("int").alias("h"), (pos % w).cast("int").alias("w"), F.col("value").cast("double").alias("value"), *more)


def pack_volume(voxels: DataFrame, shape) -> DataFrame:
    """The inverse: one row with the row-major array per sample and kind."""
    s = axis_sizes(shape)
    pos = (F.col("d") * s["h"] + F.col("h")) * s["w"] + F.col("w")
    packed = voxels.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(pos.alias("pos"), "value"))).alias("cells"))
    return packed.select(*KEY, F.struct(*[s[a].alias(a) for a in AXES]).alias("shape"), F.transform("cells", lambda c: c["value"]).alias("data"))


def rotate_voxels(voxels: DataFrame, turns, shape) -> DataFrame:
    p, _ = turn({a: F.col(a) for a in AXES}, axis_sizes(shape), _turns(turns))
    return voxels.withColumns({a: p[a].cast("int") for a in AXES})


def flip_voxels(voxels: DataFrame, flip, shape) -> DataFrame:
    s, flags = axis_sizes(shape), _flags(flip)
    return voxels.withColumns({a: F.when(flags[a], s[a] - 1 - F.col(a)).otherwise(F.col(a)).cast("int") for a in AXES})


def grid(keys: DataFrame, shape) -> DataFrame:
    """Every voxel of a volume for every row of keys."""
    out = keys
    for a, s in axis_sizes(shape).items():
        out = out.withColumn(a, F.explode(F.sequence(F.lit(0), s - 1)))
    return out


def _resample(voxels: DataFrame, cells: DataFrame, source: dict[str, Column], size: dict[str, Column], linear: bool, fill: float) -> DataFrame:
    """Values of output cells whose source positions are given; positions are clamped to the volume."""
    inside = lambda x, s: F.greatest(F.lit(0), F.least(x, s - 1)).cast("int")
    if not linear:
        at = cells.withColumns({"s" + a: inside(F.rint(source[a]), size[a]) for a in AXES})
        vox = voxels.select(*KEY, *[F.col(a).alias("s" + a) for a in AXES], "value")
        return at.join(vox, [*KEY, "sd", "sh", "sw"], "left").select(*KEY, *AXES, F.coalesce("value", F.lit(fill)).alias("value"))
    at = cells.withColumns({"p" + a: F.greatest(F.lit(0.0), F.least(source[a], (size[a] - 1).cast("double"))) for a in AXES})
    for a in AXES:
        low = F.floor("p" + a)
        part = F.col("p" + a) - low
        two = F.array(F.struct(low.cast("int").alias("i"), (1 - part).alias("q")), F.struct(inside(low + 1, size[a]).alias("i"), part.alias("q")))
        at = at.withColumn("c" + a, F.explode(two)).withColumn("s" + a, F.col("c" + a)["i"])
    at = at.withColumn("weight", F.col("cd")["q"] * F.col("ch")["q"] * F.col("cw")["q"]).where("weight > 0")
    vox = voxels.select(*KEY, *[F.col(a).alias("s" + a) for a in AXES], "value")
    joined = at.join(vox, [*KEY, "sd", "sh", "sw"], "left")
    return joined.groupBy(*KEY, *AXES).agg(F.sum(F.col("weight") * F.coalesce("value", F.lit(fill))).alias("value"))


def zoom_voxels(voxels: DataFrame, factor: float, shape, mode: str = "nearest", fill: float = 0.0) -> DataFrame:
    """Zoom about the centre at constant shape; borders repeat; factor 1 changes nothing."""
    if factor == 1:
        return voxels
    s = axis_sizes(shape)
    cells = grid(voxels.select(*KEY).distinct(), shape)
    source = {a: (F.col(a) - (s[a] - 1) / 2) / F.lit(float(factor)) + (s[a] - 1) / 2 for a in AXES}
    return _resample(voxels, cells, source, s, mode == "trilinear", fill)


def resize_voxels(voxels: DataFrame, shape, target, mode: str = "nearest", fill: float = 0.0) -> DataFrame:
    """Resize: trilinear without aligned corners for images, nearest (floor) for masks."""
    s, t = axis_sizes(shape), axis_sizes(target)
    cells = grid(voxels.select(*KEY).distinct(), target)
    if mode == "trilinear":
        source = {a: (F.col(a) + 0.5) * s[a] / t[a] - 0.5 for a in AXES}
    else:
        source = {a: F.floor(F.col(a) * s[a] / t[a]) for a in AXES}
    return _resample(voxels, cells, source, s, mode == "trilinear", fill)


def _covering(voxels: DataFrame, shape, target) -> DataFrame:
    """Each voxel once for each adaptive cell that covers it; cell columns cd, ch, cw."""
    out = voxels
    for a, s, t in zip(AXES, axis_sizes(shape).values(), axis_sizes(target).values()):
        first, last = F.floor(F.col(a) * t / s), F.ceil((F.col(a) + 1) * t / s) - 1
        out = out.withColumn("c" + a, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return out


def occupancy_downsample(voxels: DataFrame, shape, target, fill: float = 0.0) -> DataFrame:
    """Adaptive maximum; nearest when an axis grows.  In a sparse table cells without voxels stay absent."""
    if any(t > s for s, t in zip(shape, target)):
        return resize_voxels(voxels, shape, target, "nearest", fill)
    cells = _covering(voxels, shape, target).groupBy(*KEY, "cd", "ch", "cw").agg(F.max("value").alias("value"))
    return cells.select(*KEY, *[F.col("c" + a).alias(a) for a in AXES], "value")


def area_resize(voxels: DataFrame, shape, target) -> DataFrame:
    """Adaptive mean; voxels that are absent count as 0."""
    s, t = axis_sizes(shape), axis_sizes(target)
    extent = F.lit(1)
    for a in AXES:
        c = F.col("c" + a)
        extent = extent * (F.ceil((c + 1) * s[a] / t[a]) - F.floor(c * s[a] / t[a]))
    cells = _covering(voxels, shape, target).groupBy(*KEY, "cd", "ch", "cw").agg(F.sum("value").alias("total"))
    return cells.select(*KEY, *[F.col("c" + a).alias(a) for a in AXES], (F.col("total") / extent).alias("value"))


def project_2d_to_3d(plane: DataFrame, z: float, thickness: int, depth: int, background: float = -0.5, dense_shape: tuple[int, int] | None = None) -> DataFrame:
    """Copies of a plane (sample_id, kind, d, h, value) around round(z * depth) on the last axis.

    Everything is shifted by the background.  With dense_shape (d, h) all other voxels appear as background.
    """
    if not 0 <= z < 1 or thickness <= 0 or thickness % 2 == 0 or depth < thickness:
        raise ValueError("needs 0 <= z < 1 and an odd thickness of at most the depth")
    centre, radius = round(z * depth), thickness // 2
    if centre - radius < 0 or centre + radius >= depth:
        raise ValueError("the slab leaves the volume")
    slab = plane.withColumn("w", F.explode(F.sequence(F.lit(centre - radius), F.lit(centre + radius))))
    slab = slab.select(*KEY, *AXES, (F.col("value") + background).alias("value"))
    if dense_shape is None:
        return slab
    cells = grid(plane.select(*KEY).distinct(), (*dense_shape, depth))
    return cells.join(slab, [*KEY, *AXES], "left").select(*KEY, *AXES, F.coalesce("value", F.lit(float(background))).alias("value"))


def pad_voxels(voxels: DataFrame, src, dst, value: float = -0.5, dense: bool = True) -> DataFrame:
    """Centre in a larger volume; with dense, the border is filled with `value`."""
    if any(t < s for s, t in zip(src, dst)):
        raise ValueError("the padded size is smaller")
    moved = voxels.withColumns({a: (F.col(a) + (t - s) // 2).cast("int") for a, s, t in zip(AXES, src, dst)})
    if not dense:
        return moved
    cells = grid(voxels.select(*KEY).distinct(), dst)
    return cells.join(moved, [*KEY, *AXES], "left").select(*KEY, *AXES, F.coalesce("value", F.lit(float(value))).alias("value"))


def scale_intensity(voxels: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Min-max scaling per sample and kind; a constant image becomes `low`."""
    each = Window.partitionBy(*KEY)
    bottom, top = F.min("value").over(each), F.max("value").over(each)
    span = top - bottom
    return voxels.withColumn("value", F.when(span > 0, low + (F.col("value") - bottom) / span * (high - low)).otherwise(F.lit(float(low))))


def shift(voxels: DataFrame, by: float) -> DataFrame:
    """value + by: -mean for images, -0.5 for masks."""
    return voxels.withColumn("value", F.col("value") + by)


def binarize(voxels: DataFrame, threshold: float = 0.3, scale: float = 255.0) -> DataFrame:
    """0.5 where value / scale reaches the threshold, else -0.5."""
    return voxels.withColumn("value", F.when(F.col("value") / scale >= threshold, F.lit(0.5)).otherwise(F.lit(-0.5)))


def add_noise(voxels: DataFrame, std, mean: float = 0.0, seed: int = 0, clamp: tuple[float, float] | None = None) -> DataFrame:
    """Gaussian noise keyed by sample and voxel, then the clamp (also when std is 0)."""
    std = F.col(std) if isinstance(std, str) else F.lit(float(std))
    noise = normal(seed, "noise", F.col("sample_id"), F.col("kind"), *[F.col(a) for a in AXES])
    value = F.col("value") + F.when(std > 0, noise * std + mean).otherwise(F.lit(0.0))
    if clamp:
        value = F.greatest(F.lit(float(clamp[0])), F.least(value, F.lit(float(clamp[1]))))
    return voxels.withColumn("value", value)


def foreground_points(voxels: DataFrame, cap: int = 5000) -> DataFrame:
    """Foreground voxels (value > 0), evenly thinned to at most cap per sample and kind."""
    points = voxels.where("value > 0")
    each = Window.partitionBy(*KEY)
    points = points.withColumns({"position": F.row_number().over(each.orderBy(*AXES)) - 1, "total": F.count(F.lit(1)).over(each)})
    # Row p is taken when it is floor(i (n - 1) / (cap - 1)) for some i: the first such i is tested.
    steps = F.lit(float(cap - 1)) / F.greatest(F.col("total") - 1, F.lit(1))
    i = F.ceil(F.col("position") * steps)
    taken = (F.col("total") <= cap) | ((F.floor(i / steps) == F.col("position")) & (i <= cap - 1))
    return points.where(taken).drop("position", "total")

"""Packed volumes (sample_id, kind, shape, data): whole arrays, moved and resampled by NumPy in one Arrow pass.

data is row-major in (d, h, w), as files are read.  Nothing is shuffled: a volume is changed where it is, and
only parameters by sample join it.  Sparse voxel tables have operators of their own in `voxels`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import AXES
from . import voxels as v
from .geometry import PLANES

#: Parameter rows up to this number are broadcast to the volumes; each has less than 200 bytes.
FEW_PARAMS = 200_000
#: Values of the volumes that leave a task together, if no single volume has more.
BATCH_VALUES = 1 << 20

Change = Callable[..., np.ndarray]


def per_volume(volumes: DataFrame, change: Change, *columns: str) -> DataFrame:
    """`change` applied to each volume as an array, with the values of further columns of its row.

    Results leave the task in batches of BATCH_VALUES.  A chain of changes that grow a volume belongs into one
    `change`, since Spark hands the rows between two of them over in batches of their number."""
    rows = volumes.select("sample_id", "kind", "shape", "data", *columns)
    id_type = rows.schema["sample_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shapes, data = b.column(2).to_pylist(), b.column(3)
            values, ends = data.values.to_numpy(), data.offsets.to_numpy()
            more = [b.column(4 + k).to_pylist() for k in range(len(columns))]
            first, made, held = 0, [], 0
            for i, s in enumerate(shapes):
                made.append(np.asarray(change(values[ends[i] : ends[i + 1]].reshape([s[a] for a in AXES]), *[m[i] for m in more]), np.float64))
                held += made[-1].size
                if held >= BATCH_VALUES or i + 1 == len(shapes):
                    yield packed(b.slice(first, len(made)), made)
                    first, made, held = i + 1, [], 0

    def packed(b: pa.RecordBatch, made: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([x.shape for x in made], np.int32).reshape(-1, 3)
        shape = pa.StructArray.from_arrays([pa.array(sizes[:, k]) for k in range(3)], list(AXES))
        offsets = np.concatenate(([0], np.cumsum(sizes.prod(1, dtype=np.int64)))).astype(np.int32)
        flat = np.concatenate([x.ravel() for x in made])
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), shape, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["sample_id", "kind", "shape", "data"])

    return rows.mapInArrow(run, f"sample_id {id_type}, kind string, shape struct<d:int,h:int,w:int>, data array<double>")


def resample(x: np.ndarray, positions: list[np.ndarray], linear: bool) -> np.ndarray:
    """x at the source positions of each axis, clamped to it: between neighbours, axis by axis, or at the nearest (half to even)."""
    positions = [np.clip(p, 0, n - 1) for p, n in zip(positions, x.shape)]
    if not linear:
        return x[np.ix_(*[np.rint(p).astype(int) for p in positions])]
    for axis, p in enumerate(positions):
        low = np.floor(p).astype(int)
        part = (p - low).reshape([-1 if k == axis else 1 for k in range(3)])
        above = x.take(np.minimum(low + 1, x.shape[axis] - 1), axis)
        x = x.take(low, axis) * (1 - part) + above * part
    return x


def zoomed(x: np.ndarray, factor: float, linear: bool) -> np.ndarray:
    centre = [(n - 1) / 2 for n in x.shape]
    return x if factor == 1 else resample(x, [(np.arange(n) - c) / factor + c for n, c in zip(x.shape, centre)], linear)


def turned(x: np.ndarray, turns: dict[str, int]) -> np.ndarray:
    for name, a, b in PLANES:
        x = np.rot90(x, turns[name], (AXES.index(a), AXES.index(b)))
    return x


def flipped(x: np.ndarray, flags: dict[str, bool]) -> np.ndarray:
    return np.flip(x, [k for k, a in enumerate(AXES) if flags[a]])


def resized(x: np.ndarray, target: tuple[int, int, int], linear: bool) -> np.ndarray:
    at = [np.arange(t) for t in target]
    return resample(x, [(o + 0.5) * n / t - 0.5 if linear else o * n // t for o, n, t in zip(at, x.shape, target)], linear)


def _cells(size: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 position of each adaptive cell of an axis."""
    o = np.arange(target)
    return o * size // target, -(-(o + 1) * size // target)


def cell_means(x: np.ndarray, target: tuple[int, int, int]) -> np.ndarray:
    """Adaptive mean: differences of running sums, axis by axis."""
    for axis, t in enumerate(target):
        first, last = _cells(x.shape[axis], t)
        total = np.concatenate([np.zeros_like(x.take([0], axis)), np.cumsum(x, axis)], axis)
        x = (total.take(last, axis) - total.take(first, axis)) / (last - first).reshape([-1 if k == axis else 1 for k in range(3)])
    return x


def cell_maxima(x: np.ndarray, target: tuple[int, int, int]) -> np.ndarray:
    """Adaptive maximum, axis by axis; the nearest voxel where an axis grows."""
    if any(t > n for t, n in zip(target, x.shape)):
        return resized(x, target, False)
    for axis, t in enumerate(target):
        first, last = _cells(x.shape[axis], t)
        closed = np.concatenate([x, x.take([-1], axis)], axis)  # so that a cell may end with the axis
        x = np.maximum.reduceat(closed, np.stack([first, last], 1).ravel(), axis).take(np.arange(0, 2 * t, 2), axis)
    return x


def zoom_volumes(volumes: DataFrame, factor: float | str, mode: str = "nearest") -> DataFrame:
    """Zoom about the centre at constant shape; borders repeat.  factor: a number or a column of the volumes."""
    linear = mode == "trilinear"
    if isinstance(factor, str):
        return per_volume(volumes, lambda x, f: zoomed(x, f, linear), factor)
    return per_volume(volumes, lambda x: zoomed(x, factor, linear))


def resize_volumes(volumes: DataFrame, target: tuple[int, int, int], mode: str = "nearest") -> DataFrame:
    """Trilinear without aligned corners for images, nearest (floor) for masks."""
    return per_volume(volumes, lambda x: resized(x, target, mode == "trilinear"))


def area_resize_volumes(volumes: DataFrame, target: tuple[int, int, int]) -> DataFrame:
    return per_volume(volumes, lambda x: cell_means(x, target))


def occupancy_downsample_volumes(volumes: DataFrame, target: tuple[int, int, int]) -> DataFrame:
    return per_volume(volumes, lambda x: cell_maxima(x, target))


def augment_volumes(volumes: DataFrame, params: DataFrame, mode: str = "nearest", seed: int = 0) -> DataFrame:
    """Voxels (sample_id, kind, d, h, w, value) after turns, zoom and flips by the parameters of the sample, then noise and clamp of images.

    params: compose.sample_params; volumes of samples without parameters are left out."""
    wanted = params.select("sample_id", "turns", "flip", "zoom", "noise_std", "clamp_lo", "clamp_hi")
    few = wanted.limit(FEW_PARAMS + 1).count() <= FEW_PARAMS
    later = wanted.select("sample_id", "noise_std", "clamp_lo", "clamp_hi")
    rows = volumes.join(F.broadcast(wanted) if few else wanted, "sample_id")
    linear = mode == "trilinear"
    moved = per_volume(rows, lambda x, turns, zoom, flip: flipped(zoomed(turned(x, turns), zoom, linear), flip), "turns", "zoom", "flip")
    y = v.explode_volume(moved.join(F.broadcast(later) if few else later, "sample_id"), "noise_std", "clamp_lo", "clamp_hi")
    image = F.col("kind") == "image"
    noisy = v.add_noise(y.withColumn("noise_std", F.when(image, F.col("noise_std")).otherwise(F.lit(0.0))), "noise_std", seed=seed)
    low, high = F.coalesce("clamp_lo", F.lit(float("-inf"))), F.coalesce("clamp_hi", F.lit(float("inf")))
    return noisy.select("sample_id", "kind", *AXES, F.when(image, F.greatest(low, F.least(F.col("value"), high))).otherwise(F.col("value")).alias("value"))

"""Positions and running sums in a total order, without one task for all rows of a large table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written

#: Rows of a range; beyond MOST_RANGES ranges grow instead of their number.
RANGE_ROWS = 250_000
MOST_RANGES = 4096
#: Fewer rows than this are not worth a range of their own, however many cores there are.
LEAST_ROWS = 20_000


def with_running(df: DataFrame, by: list[str], order: list[Column], sums: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add `position` (0-based) and `total` per group `by` in `order`, which must be total, and <name>_sum up to each row.

    The rows are cut into ranges of (by, order), as many as their count and the cores ask for, and sorted
    there; one pass over each range counts and sums, and the result is written.  Sums per range, a small
    table, give the offsets.  df should hold narrow rows; `by` columns are numbers, texts or dates."""
    sums = sums or []
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    ranges = min(MOST_RANGES, max(-(-n // range_rows), min(cores, n // LEAST_ROWS)))
    cut = df.repartitionByRange(ranges, *by, *order) if ranges > 1 else df.coalesce(1)
    ranged = cut.sortWithinPartitions(*by, *order).withColumn("_range", F.spark_partition_id())
    scanned = written(_scan(ranged, by, sums), "ranges")
    counts = scanned.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(x).alias(f"_{x}") for x in sums])
    everyone = Window.partitionBy(*by)
    earlier = everyone.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x: F.coalesce(F.sum(x).over(earlier), F.lit(0))
    offsets = counts.select(*by, "_range", before("_n").alias("_n"), F.sum("_n").over(everyone).alias("total"), *[before(f"_{x}").alias(f"_{x}") for x in sums])
    placed = scanned.join(offsets, [*by, "_range"])
    placed = placed.withColumns({"position": F.col("position") + F.col("_n"), **{f"{x}_sum": F.col(f"{x}_sum") + F.col(f"_{x}") for x in sums}})
    return placed.drop("_range", "_n", *[f"_{x}" for x in sums])


def _scan(ordered: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Add position (from 0) and <name>_sum within each group `by` of each partition, whose rows are in order."""
    kinds = {x: "long" if ordered.schema[x].dataType.typeName() in ("byte", "short", "integer", "long") else "double" for x in sums}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, {}
        for b in batches:
            n = len(b)
            if not n:
                continue
            starts = np.zeros(n, bool)
            for x in by:
                column = b.column(x)
                a, c = column.slice(1), column.slice(0, n - 1)
                differs = pc.or_(pc.fill_null(pc.not_equal(a, c), False), pc.xor(pc.is_null(a), pc.is_null(c)))
                starts[1:] |= differs.to_numpy(zero_copy_only=False)
            first = tuple(b.column(x)[0].as_py() for x in by)
            if last != (first,):
                carried = {}
            begins = np.flatnonzero(starts)
            group = np.cumsum(starts)
            place = np.arange(n)
            origin = np.concatenate(([-carried.get("", 0)], begins))[group]
            columns = {"position": place - origin}
            for x in sums:
                values = pc.fill_null(b.column(x), 0).to_numpy().astype(np.int64 if kinds[x] == "long" else np.float64)
                running = np.cumsum(values)
                ahead = np.concatenate(([-carried.get(x, 0)], (running - values)[begins]))[group]
                columns[f"{x}_sum"] = running - ahead
            last = (tuple(b.column(x)[n - 1].as_py() for x in by),)
            carried = {"": int(columns["position"][-1]) + 1, **{x: columns[f"{x}_sum"][-1] for x in sums}}
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(v) for v in columns.values()]], [*b.schema.names, *columns])

    added = ["position long", *[f"{x}_sum {kinds[x]}" for x in sums]]
    return ordered.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema], *added]))


def with_position(df: DataFrame, key: str, by: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add `position` (0-based, ascending in `key`, which must be unique and not null) and `total`; `by`: per group.

    Only the keys are ordered; other columns join them afterwards."""
    by = by or []
    placed = with_running(df.select(*by, key), by, [F.col(key)], range_rows=range_rows)
    return placed if set(df.columns) == {*by, key} else df.join(placed, [*by, key])

"""Streaming run logs: epoch means and strict improvements of a metric."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.summary import known_records

OUTPUT = "run_id string, name string, epoch int, value double"
#: Pairs of run and name share a call of the update and its state by a hash; a stream keeps this number for its life.
BUCKETS = 1024
KNOWN = pa.schema([("run_id", pa.string()), ("name", pa.string()), ("best", pa.float64())])


def stream_epoch_means(run_log: DataFrame, time_column: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Running means per run, epoch and name (update mode); with a time column, a watermark bounds the state."""
    if time_column:
        # A watermark needs TIMESTAMP; TIMESTAMP_NTZ is cast.
        run_log = run_log.withColumn("_at", F.col(time_column).cast("timestamp")).withWatermark("_at", delay)
        window = F.window("_at", "1 day")
        return run_log.groupBy(window, "run_id", "epoch", "name").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return run_log.groupBy("run_id", "epoch", "name").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


def stream_best(history: DataFrame, mode: str = "max", records: DataFrame | None = None) -> DataFrame:
    """A row whenever a run's metric strictly improves; the state is one number per (run, name),
    kept as a table a bucket.

    history: run_id string, name string, epoch int, value double.  Values are compared, not epochs, so late
    rows cannot undo a record; within a batch rows count in epoch order.  records: (run_id, metric, mode,
    value), a table of earlier bests (summary.best_records), which a run without state starts from; those of
    another mode do not count."""
    if records is None:
        joined = history.withColumn("record", F.lit(None).cast("double"))
    else:
        joined = history.join(known_records(records, mode), ["run_id", "name"], "left")

    sign = 1.0 if mode == "max" else -1.0

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        given = list(frames)
        column = lambda name: np.concatenate([f[name].to_numpy(object) for f in given])
        number = lambda name: np.concatenate([f[name].to_numpy(np.float64, na_value=np.nan) for f in given])
        run, name, best = (x.to_numpy(zero_copy_only=False) for x in pa.ipc.open_stream(state.get[0]).read_all()) if state.exists else ((),) * 3
        old, epoch, value = len(run), number("epoch"), number("value")
        run, name = np.concatenate((run, column("run_id"))), np.concatenate((name, column("name")))
        first, best, better = _improvements(run, name, sign * np.asarray(best, np.float64), epoch, sign * value, sign * number("record"), sign)
        has = np.isfinite(best)
        if len(better) or has.sum() > old:
            kept = first[has]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, KNOWN) as file:
                file.write_batch(pa.RecordBatch.from_arrays([pa.array(run[kept], pa.string()), pa.array(name[kept], pa.string()), pa.array(sign * best[has])], schema=KNOWN))
            state.update((sink.getvalue().to_pybytes(),))
        at = epoch[better]
        yield pd.DataFrame({"run_id": run[old + better], "name": name[old + better], "epoch": pd.array(at, "Float64").astype("Int32") if np.isnan(at).any() else at.astype(np.int32), "value": value[better]})

    bucket = F.pmod(F.xxhash64("run_id", "name"), F.lit(BUCKETS)).alias("bucket")
    joined = joined.select("run_id", "name", "epoch", "value", "record", bucket)
    return joined.groupBy("bucket").applyInPandasWithState(update, OUTPUT, "known binary", "append", "NoTimeout")


def _improvements(run: np.ndarray, name: np.ndarray, known: np.ndarray, epoch: np.ndarray, value: np.ndarray, record: np.ndarray, sign: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of each pair of run and name, its best from now on, rows that improve it); larger values are better.

    run, name: first the pairs with a known best, each once, then those of the rows; record: a best from elsewhere, which
    holds for a pair without a known one.  Values come times sign; rows of an epoch count in the order of those without."""
    codes = [pd.factorize(x)[0].astype(np.int64) + 1 for x in (run, name)]
    _, first, code = np.unique(codes[0] * (codes[1].max(initial=0) + 1) + codes[1], return_index=True, return_inverse=True)
    old, at = code[: len(known)], code[len(known) :]
    best = np.full(len(first), -np.inf)
    stored = ~np.isnan(record)
    best[at[stored]] = record[stored]
    best[old] = known
    order = np.lexsort((sign * value, epoch, at))
    order = order[np.isfinite(value[order])]
    pair, now = at[order], value[order]
    # Ranks instead of values, above those of all pairs before: one running maximum serves all pairs.
    values, rank = np.unique(now, return_inverse=True)
    above = pair * len(values)
    running = values[np.maximum.accumulate(above + rank) - above]
    before = best[pair]
    same = np.flatnonzero(pair[1:] == pair[:-1]) + 1
    before[same] = np.maximum(before[same], running[same - 1])
    np.maximum.at(best, pair, now)
    return first, best, order[now > before]


def write_once(stream: DataFrame, path: str, state: str, mode: str = "append") -> StreamingQuery:
    """Start a stream that ends with the data at hand and writes every batch to a folder of its own, <path>/batch=<id>.

    A batch that is run again after a failure replaces its folder, so each row stands there once."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink).start()


def read_written(stream: DataFrame, path: str) -> DataFrame:
    """What write_once has written of a stream."""
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{path}/batch=*")

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without that setting gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a task whose number follows from a count; fewer than LEAST_ROWS are not worth a task of their own.
TASK_ROWS, LEAST_ROWS = 100_000, 20_000

#: Up to so many targets a task writes its rows straight to files; beyond, it would first hold all rows of its part of
#: the input, whose size is the file's and not ours.  Rows pass through this many parts then, which are small.
DIRECT_TASKS = 200


def dealt(df: DataFrame, *keys: str, rows: int = TASK_ROWS, least: int = LEAST_ROWS) -> DataFrame:
    """df, which is counted, dealt out by keys into tasks of about `rows` rows, however large it is; steps by these keys need no other shuffle."""
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-n // rows), min(cores, n // least))
    if tasks > DIRECT_TASKS:
        # The condition always holds; without a step between them Spark would make the two shuffles one.
        df = df.repartition(DIRECT_TASKS, *keys).where(F.spark_partition_id() >= 0)
    return df.repartition(tasks, *keys)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

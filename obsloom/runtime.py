"""Session facts shared by the operators: shared folder, lineage cuts."""
from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or the folder set on the context.

    On a local master a fresh temporary folder stands in, as driver and executors are one process there.
    Any other master without a configured folder is an error: a machine-local path would lose data."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="obsloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative operators restart from it after executor loss."""
    spark = df.sparkSession
    shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a staged folder once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


ROWS_PER_TASK = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` cut by a hash of ``keys`` into partitions whose number follows ``rows``, its counted rows.

    Aggregates and joins on the keys then run where the rows are, and no task grows with the table; shuffles that Spark sizes
    itself are shared out over the cores, so that their tasks do. One task's worth of rows stays as it is. With fewer partitions
    than Spark's default a join would shuffle the rows again."""
    n = math.ceil(rows / ROWS_PER_TASK)
    return df if n <= 1 else df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For tables that several passes read: the upstream joins run once, later passes read only
    the columns they need, and the result survives lost executors.
    """
    path = fresh_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Shared helpers: plain document columns, batches of bounded size, ranges of an ordered key, distributed running totals."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

NO_KEY = -(1 << 63)
BROADCAST_ROWS = 4_000_000  # rows of one or two 64-bit numbers that go to every executor, about 100 MB there; more are joined by a shuffle


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) only, a null text as the empty one; other columns, whatever their names, are left behind."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Arrow batches cut so that their texts hold about ``most`` characters; a longer text comes alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        first, total = 0, 0
        values = []
        for i in range(len(column)):
            value = column[i].as_py()
            if values and total + len(value) > most:
                yield batch.slice(first, len(values)), values
                first, total, values = i, 0, []
            values.append(value)
            total += len(value)
        if values:
            yield batch.slice(first, len(values)), values


def bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """Lowest key of each of about ``parts`` equally filled ranges, ascending; empty for an empty table."""
    grid = [i / parts for i in range(parts)]
    low, cuts = df.agg(F.min(key), F.percentile_approx(key, grid, 50 * parts)).first()
    return [] if low is None else sorted({low, *cuts})


def range_of(key: str, cuts: list[int], step: int = 64) -> Column:
    """Number of the range that holds ``key``: a coarse and a fine look-up, so that many ranges stay cheap."""
    coarse = F.array(*[F.lit(c).cast("long") for c in cuts[::step]])
    block = F.greatest(F.size(F.filter(coarse, lambda c: c <= F.col(key))) - 1, F.lit(0))
    fine = F.slice(F.array(*[F.lit(c).cast("long") for c in cuts]), block * step + 1, F.lit(step))
    return (block * step + F.greatest(F.size(F.filter(fine, lambda c: c <= F.col(key))) - 1, F.lit(0))).cast("int")


def running(df: DataFrame, by: list[str], order: list[str], weight: Column, cells: int, name: str = "before") -> DataFrame:
    """Adds the sum of ``weight`` over the rows before each row, per ``by``, in the order of a hash of ``order`` (then ``order``).

    Rows fall into ``cells`` hash ranges per group; totals of cells are added up in a small table, rows only within their cell. So no
    task holds a whole group, however large; ``cells`` should grow with the rows."""
    keyed = df.withColumn("_h", F.xxhash64(*order)).withColumn("_w", weight.cast("long")).withColumn("_cell", F.pmod(F.shiftright("_h", 24), F.lit(cells)))
    totals = keyed.groupBy(*by, "_cell").agg(F.sum("_w").alias("_sum"))
    start = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_cell").alias("_c"), F.coalesce(F.sum("_sum").over(start), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*by, "_cell").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    inside = keyed.withColumn("_inside", F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    on = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by] + [F.col("_cell") == F.col("_c")]
    joined = inside.join(totals, on, "left")
    return joined.select(*df.columns, (F.col("_start") + F.col("_inside")).alias(name))


def small_side(numbers: DataFrame) -> DataFrame:
    """A staged table of one or two numbers a row as a side of a join: broadcast while its counted rows allow it."""
    return F.broadcast(numbers) if numbers.count() <= BROADCAST_ROWS else numbers


@contextmanager
def batch_bytes(spark: SparkSession, most: int):
    """Within it, jobs that are run hand about ``most`` bytes at a time to Python. An executor holds a batch several times outside its heap and
    once more in the worker, and neither gives the room back; ten thousand texts a batch, Spark's default, are bounded by no size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)

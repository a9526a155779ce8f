"""Multiplicity control over p-value tables (one row per test).

Tests are ranked in buckets of p; a bucket hands its best step to the ones behind it, so a family of any
size is spread over many tasks. A NULL p is no test: it is not counted and its adjusted value is NULL.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import stage
from . import order


def _stepwise(df: DataFrame, p: str, tie, family, out: str, step, pick, back: bool, rows_per_bucket: int) -> DataFrame:
    """``pick`` (min or max) of ``step(p, position, tests)`` over all positions up to the row's own; from the largest p if ``back``."""
    columns = df.columns
    # own names, as the ranks add columns of theirs; staged, as the buckets need a count of their own
    d = stage(df.withColumnsRenamed({c: "_in_" + c for c in columns}))
    keys, value = ["_in_" + c for c in family], F.col("_in_" + p)
    d = order._bucketed(d.withColumn("_test", value.isNotNull().cast("long")), "_in_" + p, rows_per_bucket).withColumn("_at", F.col("_bucket"))
    d = order._running(d, keys, ["_in_" + p, *["_in_" + c for c in tie]], "_test")
    d = d.withColumn("_step", F.when(value.isNotNull(), step(value, F.col("cum"), F.col("n"))))
    turn = F.desc if back else F.asc
    best = d.groupBy(*keys, "_at").agg(pick("_step").alias("_best"))
    before = Window.partitionBy(*keys).orderBy(turn("_at")).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_best", pick("_best").over(before))
    inside = Window.partitionBy(*keys, "_at").orderBy(turn("cum")).rowsBetween(Window.unboundedPreceding, 0)
    d = order.same_keys(d.withColumn("_own", pick("_step").over(inside)), best, [*keys, "_at"])
    both = (F.least if pick is F.min else F.greatest)("_own", "_best")  # NULL is skipped
    return d.select(*[F.col("_in_" + c).alias(c) for c in columns], F.when(value.isNotNull(), both).alias(out))


def holm(df: DataFrame, p: str, tie, family=(), out="p_holm", rows_per_bucket: int = order.ROWS_PER_BUCKET) -> DataFrame:
    """Step-down adjustment: running maximum of (m - i + 1) p, at most 1."""
    def step(v: Column, i: Column, m: Column) -> Column:
        return F.least(F.lit(1.0), (m - i + 1) * v)
    return _stepwise(df, p, tie, list(family), out, step, F.max, False, rows_per_bucket)


def bh(df: DataFrame, p: str, tie, family=(), out="p_bh", rows_per_bucket: int = order.ROWS_PER_BUCKET) -> DataFrame:
    """Step-up adjustment: running minimum from the largest p of p m / rank."""
    def step(v: Column, i: Column, m: Column) -> Column:
        return F.least(F.lit(1.0), v * m / i)
    return _stepwise(df, p, tie, list(family), out, step, F.min, True, rows_per_bucket)

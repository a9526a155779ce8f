"""Grouped statistics over the long form (id, class, feature, value)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import cascade
from . import order

def g1() -> Column:
    return F.skewness("value")


def skew_ddof1(g, n) -> Column:
    """Mean cubed score with the sample standard deviation."""
    return g * F.pow((n - 1) / n, F.lit(1.5))


def skew_adjusted(g, n) -> Column:
    return F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))


def descriptive(long: DataFrame, keys=("feature", "class")) -> DataFrame:
    """N, moments and exact quartiles per key. Moments come from the distinct-value counts
    only through plain aggregates, so both halves combine map-side."""
    keys = list(keys)
    m = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
                                F.var_samp("value").alias("variance"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = order.quantiles(long, keys, "value", {"q1": .25, "median": .5, "q3": .75})
    sem = F.col("sd") / F.sqrt("n")
    return (m.join(q, keys).withColumn("sem", sem).withColumn("ci_low", F.col("mean") - 1.96 * sem)
            .withColumn("ci_high", F.col("mean") + 1.96 * sem).withColumn("iqr", F.col("q3") - F.col("q1")))


def descriptive_shape(long: DataFrame, keys=("feature", "class")) -> DataFrame:
    return long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.skewness("value").alias("skew"),
        F.kurtosis("value").alias("excess_kurtosis"),
        F.abs(F.try_divide(F.stddev_samp("value") * 100, F.avg("value"))).alias("cv_percent"))


def wide_missingness(df: DataFrame, features, limit=0.20) -> DataFrame:
    """One pass over the wide table; a feature is excluded only above the limit."""
    s = [F.struct(F.lit(f).alias("feature"), F.count(f).alias("n_observed"), F.count("*").alias("n_total")) for f in features]
    out = df.agg(F.array(*s).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    rate = (F.col("n_total") - F.col("n_observed")) / F.col("n_total")
    return (out.withColumn("n_missing", F.col("n_total") - F.col("n_observed")).withColumn("rate", rate)
            .withColumn("excluded", rate > limit))


def row_missing(features) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f).isNull().cast("long") for f in features])


def pattern(features) -> Column:
    named = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in features]), lambda x: x.isNotNull())
    return F.when(F.size(named) > 0, F.array_join(named, "; ")).otherwise("Complete")


def shares(counts: DataFrame, group, n="n", out="percent") -> DataFrame:
    """Percent of the group total; totals are a small table joined back, not a window over rows."""
    group = [group] if isinstance(group, str) else list(group)
    tot = counts.groupBy(*group).agg(F.sum(n).alias("_t"))
    return counts.join(tot, group).withColumn(out, F.try_divide(F.col(n) * F.lit(100.0), F.col("_t"))).drop("_t")


def near_zero_variance(long: DataFrame, freq_ratio=19.0, unique_percent=10.0) -> DataFrame:
    """Top two value counts per feature by max aggregates over distinct values."""
    vc = order.value_counts(long, ["feature"], "value")
    agg = vc.groupBy("feature").agg(F.sum("c").alias("n"), F.count("*").alias("n_unique"),
                                    F.max("c").alias("top"), F.min_by("value", F.struct(-F.col("c"), F.col("value"))).alias("top_value"))
    second = vc.join(agg.select("feature", "top_value"), "feature").where(F.col("value") != F.col("top_value")) \
        .groupBy("feature").agg(F.max("c").alias("second"))
    out = agg.join(second, "feature", "left")
    ratio = F.col("top") / F.col("second")
    uniq = 100.0 * F.col("n_unique") / F.col("n")
    return (out.withColumn("freq_ratio", ratio).withColumn("unique_percent", uniq)
            .withColumn("top_fraction", F.col("top") / F.col("n"))
            .withColumn("zero_variance", F.col("n_unique") <= 1)
            .withColumn("near_zero", (F.col("n_unique") <= 1) | (F.coalesce(ratio >= freq_ratio, F.lit(False)) & (uniq <= unique_percent))))


def mode_vote(votes: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Modal label per key, smallest label on ties, and its share of the votes."""
    c = votes.groupBy(key, label).agg(F.count("*").alias("c"))
    return c.groupBy(key).agg(F.sum("c").alias("n_votes"), F.max("c").alias("top"),
                              F.min_by(label, F.struct(-F.col("c"), F.col(label))).alias("modal")) \
        .select(key, "modal", "n_votes", (F.col("top") / F.col("n_votes")).alias("agreement"))


def flag_rollup(df: DataFrame, z: dict, limit: float) -> DataFrame:
    """Per row: number of flagged features, largest |z|, sorted names, review priority."""
    hits = F.array_sort(F.filter(F.array(*[F.when(F.abs(c) >= limit, F.lit(f)) for f, c in z.items()]), lambda x: x.isNotNull()))
    n = F.size(hits)
    top = F.greatest(*[F.abs(c) for c in z.values()])
    return (df.withColumn("n_flags", n.cast("long")).withColumn("max_abs_z", top).withColumn("flagged", F.array_join(hits, ";"))
            .withColumn("priority", cascade([((n >= 2) | (top > 2 * limit), "high"), (n == 1, "medium")], "none")))


def consensus_rank(df: DataFrame, scores, key: str) -> DataFrame:
    """Mean of the descending tie-averaged ranks of several scores, then a final order with ties broken by key."""
    neg = df.select(key, *[(-F.col(s)).alias(s) for s in scores]).unpivot([key], list(scores), "feature", "value")
    ranked = order.rank_rows(neg, ["feature"], "value")
    return ranked.groupBy(key).agg(F.avg("rank").alias("mean_rank"))


def window_rank(df: DataFrame, order_by, out="position") -> DataFrame:
    """Position over a small result table."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order_by)).cast("long"))

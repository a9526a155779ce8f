"""Rank tests and variance tests from per-value counts; rows are never ranked one by one."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import special
from ..functions.scalar import chi2_sf_even
from ..runtime import stage
from . import multiplicity, order


def rank_sums(long: DataFrame, keys=("feature",), group="class") -> DataFrame:
    """Per key and group: n_g, rank sum; with the key's N and tie sum on each row."""
    keys = list(keys)
    cells = order.rank_cells(long, keys, "value", group)
    # each cell carries its share of the tie term of its value; the window runs on one row per group
    tie = F.col("c_by").cast("double") * (F.col("c").cast("double") * F.col("c") - 1)
    g = cells.groupBy(*keys, group).agg(F.sum("c_by").alias("n_g"), F.sum(F.col("c_by") * F.col("rank")).alias("rank_sum"),
                                        F.max("n").alias("n"), F.sum(tie).alias("_t"))
    return g.withColumn("tie_sum", F.sum("_t").over(Window.partitionBy(*keys))).drop("_t")


def kruskal_wallis(sums: DataFrame, keys=("feature",), even_df: int | None = None) -> DataFrame:
    """H with tie correction, degrees of freedom, p and the epsilon-squared effect."""
    n = F.col("n").cast("double")
    k = sums.groupBy(*keys).agg(F.max("n").alias("n"), F.count("*").alias("k"), F.max("tie_sum").alias("tie_sum"),
                                F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n_g")).alias("s"))
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    corr = 1 - F.col("tie_sum") / (n * n * n - n)
    k = k.withColumn("h", F.when(corr > 0, raw / corr).otherwise(F.lit(0.0))).withColumn("df", F.col("k") - 1)
    p = chi2_sf_even(F.col("h"), even_df) if even_df else special.chi2_sf_col(F.col("h"), F.col("df").cast("double"))
    return (k.withColumn("p", p).withColumn("epsilon2", epsilon2(F.col("h"), F.col("k"), n)).drop("s", "tie_sum"))


def epsilon2(h: Column, k: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), (h - k + 1) / (n - k))


def dunn(sums: DataFrame, keys=("feature",), group="class", p_value=True) -> DataFrame:
    """z and effect r for each pair of groups of a key; Holm inside the key, BH over all.

    The self-join runs on the rank-sum table, one row per group, not on observations.
    """
    keys = list(keys)
    sums = stage(sums)
    a = sums.select(*keys, F.col(group).alias("g1"), F.col("n_g").alias("n1"), (F.col("rank_sum") / F.col("n_g")).alias("m1"),
                    "n", "tie_sum")
    b = sums.select(*keys, F.col(group).alias("g2"), F.col("n_g").alias("n2"), (F.col("rank_sum") / F.col("n_g")).alias("m2"))
    j = a.join(b, keys).where(F.col("g1") < F.col("g2"))
    n = F.col("n").cast("double")
    var = (n * (n + 1) / 12 - F.col("tie_sum") / (12 * (n - 1))) * (1 / F.col("n1") + 1 / F.col("n2"))
    z = F.when(var > 0, (F.col("m1") - F.col("m2")) / F.sqrt(var)).otherwise(F.lit(0.0))
    out = j.withColumn("z", z).withColumn("r", F.abs("z") / F.sqrt(n)).select(*keys, "g1", "g2", "n1", "n2", "m1", "m2", "z", "r")
    if not p_value:
        return out
    out = out.withColumn("p", special.norm_two_sided_col(F.col("z")))
    out = multiplicity.holm(out, "p", ["g1", "g2"], family=keys)
    return multiplicity.bh(out, "p", [*keys, "g1", "g2"])


def mann_whitney(sums: DataFrame, keys, group: str, first: str, second: str, continuity: bool) -> DataFrame:
    """U of ``first``, tie-corrected z, two-sided normal p and Cliff's delta."""
    keys = list(keys)
    pick = lambda c, g: F.max(F.when(F.col(group) == g, F.col(c)))
    s = sums.groupBy(*keys).agg(pick("n_g", first).alias("n1"), pick("n_g", second).alias("n2"), pick("rank_sum", first).alias("r1"),
                                F.max("tie_sum").alias("t"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    s = s.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("t") / (n * (n - 1))))
    dev = F.col("u") - n1 * n2 / 2
    if continuity:
        dev = F.signum(dev) * F.greatest(F.abs(dev) - 0.5, F.lit(0.0))
    s = s.withColumn("z", F.try_divide(dev, sd)).withColumn("delta", 2 * F.col("u") / (n1 * n2) - 1)
    return s.select(*keys, "n1", "n2", "u", "z", "delta")


def brown_forsythe(long: DataFrame, keys=("feature",), group="class", p_value=True) -> DataFrame:
    """F test on absolute deviations from the group median, with the largest / smallest variance ratio."""
    keys = list(keys)
    med = stage(order.quantiles(long, [*keys, group], "value", {"med": .5}))
    dev = long.where(F.col("value").isNotNull()).join(med, [*keys, group]).withColumn("d", F.abs(F.col("value") - F.col("med")))
    g = dev.groupBy(*keys, group).agg(F.count("*").alias("n_g"), F.avg("d").alias("m"), F.var_pop("d").alias("v"), F.var_samp("value").alias("var"))
    g = stage(g)
    tot = g.groupBy(*keys).agg(F.sum("n_g").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n_g") * F.col("m")) / F.sum("n_g")).alias("gm"),
                               F.sum(F.col("n_g") * F.col("v")).alias("ssw"), (F.max("var") / F.min("var")).alias("variance_ratio"))
    ssb = g.join(tot.select(*keys, "gm"), keys).groupBy(*keys).agg(F.sum(F.col("n_g") * F.pow(F.col("m") - F.col("gm"), F.lit(2.0))).alias("ssb"))
    out = tot.join(ssb, keys).select(*keys, "n", (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"),
                                     ((F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))).alias("f"), "variance_ratio")
    if not p_value:
        return out
    out = out.withColumn("p", special.f_sf_col(F.col("f"), F.col("df1").cast("double"), F.col("df2").cast("double")))
    return multiplicity.bh(out, "p", keys)


def one_vs_rest_auc(long: DataFrame, keys, group: str) -> DataFrame:
    """Rank-sum AUC of each group against all other rows of the key."""
    s = rank_sums(long, keys, group)
    n1 = F.col("n_g").cast("double")
    n0 = F.col("n").cast("double") - n1
    return s.withColumn("auc", F.try_divide(F.col("rank_sum") - n1 * (n1 + 1) / 2, n1 * n0))

"""Tables behind distribution displays."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import clip
from ..runtime import stage
from . import order


def pooled_quantiles(long: DataFrame, probs) -> DataFrame:
    """Quantiles of all values pooled over features, with counts beyond 2, 2.5 and 3."""
    one = long.select(F.lit(1).alias("g"), "value")
    q = order.quantiles(one, ["g"], "value", probs)
    n = one.groupBy("g").agg(F.count("value").alias("n"), *[F.count_if(F.abs("value") > z).alias(n) for n, z in (("beyond_2", 2.0), ("beyond_2_5", 2.5), ("beyond_3", 3.0))])
    return q.join(n, "g").drop("g")


def trimmed_core(df: DataFrame, x: str, y: str, key: str, prob: float = 0.95) -> DataFrame:
    """Rows within the given percentile of the median-centred, MAD-scaled distance of their class."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in (x, y)])).alias("s")).select(key, "s.*")
    from .transforms import median_mad
    m = median_mad(long, [key, "feature"])
    w = m.groupBy(key).agg(*[F.max(F.when(F.col("feature") == c, F.col(s))).alias(f"_{s}_{i}") for i, c in enumerate((x, y)) for s in ("med", "mad")])
    part = lambda c, i: F.pow((F.col(c) - F.col(f"_med_{i}")) / F.greatest(F.col(f"_mad_{i}"), F.lit(1e-12)), F.lit(2.0))
    d = df.join(stage(w), key).withColumn("distance", F.sqrt(part(x, 0) + part(y, 1)))
    d = d.drop(*[f"_{s}_{i}" for i in (0, 1) for s in ("med", "mad")])
    cut_at = order.quantiles(d, [key], "distance", {"_cut": prob})
    return d.join(stage(cut_at), key).where(F.round("distance", 9) <= F.round("_cut", 9)).drop("_cut")


def fd_histogram(long: DataFrame, keys=("feature",), lo: int = 8, hi: int = 28, fallback: int = 12) -> DataFrame:
    """Freedman-Diaconis bins, clamped; the last bin is closed."""
    keys = list(keys)
    q = order.quantiles(long, keys, "value", {"q1": .25, "q3": .75})
    m = long.groupBy(*keys).agg(F.count("value").alias("n_all"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = 2 * (F.col("q3") - F.col("q1")) / F.cbrt("n_all")
    bins = F.when(width > 0, F.least(F.greatest(F.ceil(F.try_divide(F.col("hi") - F.col("lo"), width)), F.lit(lo)), F.lit(hi))).otherwise(F.lit(fallback))
    p = stage(m.join(q, keys).withColumn("n_bins", bins.cast("long")))
    pos = F.floor(F.try_divide((F.col("value") - F.col("lo")) * F.col("n_bins"), F.col("hi") - F.col("lo")))
    j = long.where(F.col("value").isNotNull()).join(p, keys).withColumn("bin", F.least(F.coalesce(pos, F.lit(0).cast("long")), F.col("n_bins") - 1))
    out = j.groupBy(*keys, "bin", "n_bins", "lo", "hi").agg(F.count("*").alias("n"))
    step = (F.col("hi") - F.col("lo")) / F.col("n_bins")
    return out.select(*keys, "bin", "n_bins", (F.col("lo") + F.col("bin") * step).alias("left"), "n")


def integer_histogram(long: DataFrame, keys=("feature",)) -> DataFrame:
    return long.where(F.col("value").isNotNull()).groupBy(*keys, F.floor(F.col("value") + 0.5).alias("bin")).agg(F.count("*").alias("n"))


def kde_grid(long: DataFrame, keys=("feature",), cells: int = 400, points: int = 50) -> DataFrame:
    """Gaussian density on a fixed grid from pre-binned counts, scaled to its maximum.

    Rows are reduced to at most ``cells`` counts per key first, so the kernel sum costs
    cells x points per key instead of rows x rows.
    """
    keys = list(keys)
    m = long.groupBy(*keys).agg(F.count("value").alias("n"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    bw = 1.06 * F.col("sd") * F.pow("n", F.lit(-0.2))
    m = m.withColumn("bw", F.when(bw > 1e-12, bw).otherwise(F.greatest((F.col("hi") - F.col("lo")) * 0.08, F.lit(1e-3))))
    m = stage(m)
    step = (F.col("hi") - F.col("lo")) / cells
    b = long.where(F.col("value").isNotNull()).join(m, keys)
    cell = F.least(F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("lo"), step)), F.lit(0).cast("long")), F.lit(cells - 1))
    b = b.groupBy(*keys, "lo", "hi", "bw", "n", cell.alias("cell")).agg(F.count("*").alias("c"))
    g = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)
    mid = F.col("lo") + (F.col("cell") + 0.5) * step
    z = (at - mid) / F.col("bw")
    d = g.groupBy(*keys, "i", at.alias("x")).agg((F.sum(F.col("c") * F.exp(-z * z / 2)) / F.max(F.col("n") * F.col("bw"))).alias("density"))
    top = d.groupBy(*keys).agg(F.max("density").alias("_t"))
    return d.join(top, keys).withColumn("scaled", F.col("density") / F.greatest("_t", F.lit(1e-12))).drop("_t", "density")


def heatmap(long: DataFrame, positions: DataFrame, limit: float = 2.0) -> DataFrame:
    """Clipped z with the display position of each row; ``long`` carries ``z``."""
    return long.join(positions, "obs_id").withColumn("shown", clip("z", -limit, limit))

"""Feature transforms as fit (aggregate to a parameter table) and apply (join and expression).

Parameter tables hold one row per feature, or per (split, feature), and join back by key. They are
staged first: the planner then knows their true size and broadcasts them only when they are small,
instead of shuffling the rows on a handful of feature names.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import MAD_Z, yeo_johnson
from ..runtime import stage
from . import order
from .aggs import skew_adjusted

BLOCK = 1 << 16  # values of a feature that a fit keeps together
TARGET_SUM = 10000.0  # fixed value: column sum after shift and scaling


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def zscore(long: DataFrame, ddof: int, keys="feature", value="value", out="z") -> DataFrame:
    """(x - mean) / sd with the stated ddof; a constant feature gives 0."""
    keys = _keys(keys)
    sd = F.stddev_samp if ddof else F.stddev_pop
    fit = long.groupBy(*keys).agg(F.avg(value).alias("_m"), sd(value).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).when(F.col(value).isNotNull(), F.lit(0.0))
    return long.join(stage(fit), keys).withColumn(out, z).drop("_m", "_s")


def shift_sum(long: DataFrame, keys="feature") -> DataFrame:
    """log1p of the shifted value scaled to a fixed column sum; one aggregate, since sum(x - min) = sum(x) - n min."""
    keys = _keys(keys)
    fit = long.groupBy(*keys).agg(F.min("value").alias("_lo"), (F.sum("value") - F.count("value") * F.min("value")).alias("_sum"))
    bad = F.when(F.col("_sum") <= 0, F.raise_error(F.lit("shifted column sum is not positive")).cast("double")).otherwise(F.col("_sum"))
    return long.join(stage(fit), keys).withColumn("t", F.log1p((F.col("value") - F.col("_lo")) / bad * TARGET_SUM)).drop("_lo", "_sum")


def shift_sum_log1p_z(long: DataFrame, ddof: int = 1, keys="feature") -> DataFrame:
    return zscore(shift_sum(long, keys), ddof, keys, "t", "z")


def shift_sum_split_params(folded: DataFrame, fold="fold", ddof: int = 1) -> DataFrame:
    """(split, feature) parameters fitted on every fold but one, for all splits together.

    Per-fold minimum and sum combine over the small fold table; only the log moments need
    the rows again, once per split.
    """
    per = folded.groupBy("feature", fold).agg(F.min("value").alias("lo"), F.sum("value").alias("s"), F.count("value").alias("n"))
    per = stage(per)
    splits = per.select("feature", F.col(fold).alias("split")).distinct()
    train = per.join(splits, "feature").where(F.col(fold) != F.col("split"))
    p = train.groupBy("split", "feature").agg(F.min("lo").alias("lo"), (F.sum("s") - F.sum("n") * F.min("lo")).alias("total"))
    p = p.withColumn("total", F.when(F.col("total") > 0, F.col("total")).otherwise(F.lit(1.0)))
    p = stage(p)
    t = folded.join(p, "feature").where(F.col(fold) != F.col("split")).withColumn("t", scaled(F.col("value"), F.col("lo"), F.col("total")))
    sd = F.stddev_samp if ddof else F.stddev_pop
    return p.join(t.groupBy("split", "feature").agg(F.avg("t").alias("mean"), sd("t").alias("sd")), ["split", "feature"])


def scaled(x, lo, total):
    """Held-out values below the training minimum are clipped to it."""
    return F.log1p(F.greatest(x - lo, F.lit(0.0)) / total * TARGET_SUM)


def apply_split_params(folded: DataFrame, params: DataFrame, fold="fold") -> DataFrame:
    params = stage(params)
    j = folded.join(params, (folded["feature"] == params["feature"]) & (folded[fold] == params["split"])).drop(params["feature"])
    z = (scaled(F.col("value"), F.col("lo"), F.col("total")) - F.col("mean")) / F.col("sd")
    return j.withColumn("z", F.when(F.col("sd") > 0, z).otherwise(F.lit(0.0))).drop("lo", "total", "mean", "sd", "split")


def ratio_branch(long: DataFrame) -> DataFrame:
    """log2 for features named as ratios (must be positive), shift-sum-log1p for the rest; z with ddof 0."""
    is_ratio = F.contains(F.lower(F.col("feature")), F.lit("ratio"))
    lg = F.when(F.col("value") <= 0, F.raise_error(F.lit("ratio is not positive")).cast("double")).otherwise(F.log2("value"))
    a = long.where(is_ratio).withColumn("t", lg)
    return zscore(a.unionByName(shift_sum(long.where(~is_ratio))), 0, "feature", "t", "z")


def _power_moments(logs: np.ndarray, lam: float) -> tuple[float, float]:
    """Mean and sum of squared deviations of the transformed values; ``logs`` holds signum(x) * log1p(abs(x))."""
    up, down = logs[logs >= 0], -logs[logs < 0]
    rest = logs[np.isnan(logs)]
    y = np.concatenate([up if abs(lam) < 1e-8 else np.expm1(lam * up) / lam,
                        -down if abs(lam - 2) < 1e-8 else -np.expm1((2 - lam) * down) / (2 - lam), rest])
    mean = y.mean()
    return float(mean), float(np.square(y - mean).sum())


def fit_yeo_johnson(long: DataFrame, lo=-5.0, hi=5.0, passes=5, steps=16) -> DataFrame:
    """Power per feature that maximises the profile likelihood, by a shrinking grid.

    Values are packed once into blocks of their signed logarithms, which every pass reads; a task gives a few numbers per
    (feature, power), merged in Spark, and only the winning power of each feature reaches the driver.
    """
    spark = long.sparkSession

    def pack(batches):
        held: dict = {}
        for b in batches:
            for f, v in b["value"].groupby(b["feature"]):
                x = v.to_numpy(float)
                held.setdefault(f, []).append(np.sign(x) * np.log1p(np.abs(x)))
            for f in [f for f, parts in held.items() if sum(map(len, parts)) >= BLOCK]:
                yield pd.DataFrame({"feature": [f], "logs": [np.concatenate(held.pop(f)).tobytes()]})
        for f, parts in held.items():
            yield pd.DataFrame({"feature": [f], "logs": [np.concatenate(parts).tobytes()]})

    present = long.where("value IS NOT NULL AND feature IS NOT NULL").select("feature", F.col("value").cast("double").alias("value"))
    blocks = stage(present.mapInPandas(pack, "feature string, logs binary"))
    bracket = {r["feature"]: (lo, hi) for r in blocks.select("feature").distinct().collect()}
    best: dict = {}
    for _ in range(passes):
        grid = {f: [a + (b - a) * i / steps for i in range(steps + 1)] for f, (a, b) in bracket.items()}

        def measure(batches, grid=grid):
            with np.errstate(all="ignore"):
                for b in batches:
                    rows = []
                    for f, raw in zip(b["feature"], b["logs"]):
                        x = np.frombuffer(raw, float)
                        rows += [(f, lam, len(x), *_power_moments(x, lam), float(x.sum()), float(x.min()), float(x.max())) for lam in grid.get(f, [])]
                    yield pd.DataFrame(rows, columns=["feature", "lam", "n", "mean", "sq", "jac", "lo", "hi"])

        parts = stage(blocks.mapInPandas(measure, "feature string, lam double, n long, mean double, sq double, jac double, lo double, hi double"))
        total = parts.groupBy("feature", "lam").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all"))
        off = F.col("mean") - F.col("all")
        s = order.same_keys(parts, total, ["feature", "lam"]).groupBy("feature", "lam").agg(
            F.sum("n").alias("n"), (F.sum(F.col("sq") + F.col("n") * off * off) / F.sum("n")).alias("var"), F.sum("jac").alias("jac"),
            F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        # merged means of equal values may differ by rounding
        ll = s.where("var > 0 AND (hi > lo OR isnan(hi))").withColumn("ll", -F.col("n") / 2 * F.log("var") + (F.col("lam") - 1) * F.col("jac"))
        for r in ll.groupBy("feature").agg(F.max_by(F.struct("lam", "ll"), "ll").alias("b")).select("feature", "b.*").collect():
            best[r["feature"]] = (r["lam"], r["ll"])
        bracket = {f: (max(lo, best[f][0] - (b - a) / steps), min(hi, best[f][0] + (b - a) / steps))
                   for f, (a, b) in bracket.items() if f in best}
    fitted = [(f, float(lam), float(ll), lam <= lo + 1e-6 or lam >= hi - 1e-6) for f, (lam, ll) in best.items()]
    return spark.createDataFrame(fitted, "feature string, lam double, log_lik double, at_boundary boolean")


def adaptive_plan(long: DataFrame, limit: float = 0.5) -> DataFrame:
    """Yeo-Johnson for clearly skewed features, identity (power 1) for the rest."""
    s = long.groupBy("feature").agg(F.count("value").alias("n"), F.skewness("value").alias("g"))
    s = s.select("feature", skew_adjusted(F.col("g"), F.col("n").cast("double")).alias("skew"))
    p = s.join(fit_yeo_johnson(long), "feature", "left")
    use = F.coalesce(F.abs("skew") >= limit, F.lit(False)) & F.col("lam").isNotNull()
    return p.select("feature", "skew", F.when(use, "yeo_johnson").otherwise("identity").alias("rule"),
                    F.when(use, F.col("lam")).otherwise(F.lit(1.0)).alias("lam"))


def adaptive_transform(long: DataFrame, limit: float = 0.5, plan: DataFrame | None = None) -> DataFrame:
    plan = stage(adaptive_plan(long, limit) if plan is None else plan)
    t = long.join(plan, "feature").withColumn("t", F.when(F.col("rule") == "yeo_johnson", yeo_johnson(F.col("value"), F.col("lam")))
                                              .otherwise(F.col("value")))
    return zscore(t, 1, "feature", "t", "z")


def log1p_if_skewed(long: DataFrame, limit: float = 1.0) -> DataFrame:
    s = long.groupBy("feature").agg(F.count("value").alias("n"), F.skewness("value").alias("g"), F.min("value").alias("_lo"))
    rule = F.when((F.col("_lo") >= 0) & (skew_adjusted(F.col("g"), F.col("n").cast("double")) > limit), "log1p").otherwise("none")
    t = long.join(stage(s.select("feature", rule.alias("rule"))), "feature")
    t = t.withColumn("t", F.when(F.col("rule") == "log1p", F.log1p("value")).otherwise(F.col("value")))
    return zscore(t, 1, "feature", "t", "z")


def median_mad(long: DataFrame, keys="feature") -> DataFrame:
    keys = _keys(keys)
    med = stage(order.quantiles(long, keys, "value", {"med": .5}))
    dev = long.join(med, keys).withColumn("_d", F.abs(F.col("value") - F.col("med")))
    return stage(med.join(order.quantiles(dev, keys, "_d", {"mad": .5}), keys))


def robust_z(long: DataFrame, keys="feature", fallback_sd: bool = False) -> DataFrame:
    """0.67448975 (x - median) / MAD; MAD 0 gives NULL, or the SD form when asked for."""
    keys = _keys(keys)
    j = long.join(median_mad(long, keys), keys)
    z = F.when(F.col("mad") > 0, MAD_Z * (F.col("value") - F.col("med")) / F.col("mad"))
    if fallback_sd:
        sd = stage(long.groupBy(*keys).agg(F.stddev_samp("value").alias("_sd")))
        j = j.join(sd, keys)
        z = F.coalesce(z, F.when(F.col("_sd") > 0, (F.col("value") - F.col("med")) / F.col("_sd")))
    return j.withColumn("rz", z).drop("_sd")


def tukey_fences(long: DataFrame, keys="feature") -> DataFrame:
    """Rows outside the 1.5 and 3 IQR fences and beyond a modified z of 3.5."""
    keys = _keys(keys)
    q = stage(order.quantiles(long, keys, "value", {"q1": .25, "q3": .75}))
    j = robust_z(long, keys).join(q, keys)
    iqr, v = F.col("q3") - F.col("q1"), F.col("value")
    out = lambda k: F.count_if((v < F.col("q1") - k * iqr) | (v > F.col("q3") + k * iqr))
    return j.groupBy(*keys).agg(F.max("q1").alias("q1"), F.max("q3").alias("q3"), out(1.5).alias("n_mild"), out(3.0).alias("n_extreme"),
                                F.count_if(F.abs("rz") > 3.5).alias("n_modified_z"))


def median_impute(long: DataFrame, keys=("class", "feature")) -> DataFrame:
    """Cohort median in place of NULL, with a flag per filled field."""
    keys = _keys(keys)
    med = stage(order.quantiles(long, keys, "value", {"med": .5}))
    return (long.join(med, keys, "left").withColumn("imputed", F.col("value").isNull())
            .withColumn("value", F.coalesce("value", "med")))


def lognorm_counts(counts: DataFrame, target: float = TARGET_SUM) -> DataFrame:
    """log1p(count / library * target); zeros stay absent; an empty library counts as 1."""
    lib = counts.groupBy("obs_id").agg(F.greatest(F.sum("value"), F.lit(1.0)).alias("_lib"))
    return counts.join(lib, "obs_id").withColumn("logn", F.log1p(F.col("value") / F.col("_lib") * target)).drop("_lib")


def max_normalize(df: DataFrame, key: str, value: str) -> DataFrame:
    top = stage(df.groupBy(key).agg(F.max(value).alias("_top")))
    return df.join(top, key).withColumn("scaled", F.col(value) / F.when(F.col("_top") > 0, F.col("_top")).otherwise(F.lit(1.0))).drop("_top")


def gene_moments(logn: DataFrame, n_total: DataFrame, value="logn") -> DataFrame:
    """Mean and both variances per gene over all observations; absent triplets are zeros."""
    v = F.col(value)
    g = logn.groupBy("gene").agg(F.count_if(v > 0).alias("n_detected"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"))
    g = g.withColumn("one", F.lit(1)).join(n_total.withColumn("one", F.lit(1)), "one").drop("one")
    n = F.col("n_total")
    mean = F.col("s1") / n
    return g.select("gene", "n_detected", mean.alias("mean"), (F.col("s2") / n - mean * mean).alias("var_pop"),
                    ((F.col("s2") - F.col("s1") * mean) / (n - 1)).alias("var_samp"))


def hvg_select(moments: DataFrame, n: int, variance: str) -> DataFrame:
    return moments.orderBy(F.desc(variance), "gene").limit(n)


def dispersion_rank(moments: DataFrame, bins: int = 20) -> DataFrame:
    """variance / mean, standardised inside mean-quantile bins of the gene table, then ranked."""
    m = moments.where("mean > 0").withColumn("dispersion", F.col("var_samp") / F.col("mean"))
    m = order.positions(m, F.col("mean"), ["gene"], "_i", "_n")
    i, base, extra = F.col("_i"), F.floor(F.col("_n") / bins), F.col("_n") % bins
    # the first bins are one row longer when the rows do not divide evenly
    long_rows = extra * (base + 1)
    m = m.withColumn("bin", F.when(i <= long_rows, F.ceil(i / (base + 1))).otherwise(extra + F.ceil(F.try_divide(i - long_rows, base)))).drop("_i", "_n")
    s = m.groupBy("bin").agg(F.avg("dispersion").alias("_m"), F.stddev_samp("dispersion").alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("dispersion") - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return m.join(s, "bin").withColumn("dispersion_z", z).drop("_m", "_s")


def transform_audit(stages: dict) -> DataFrame:
    """Same moments for each stage of a transform, stacked; ``stages`` maps a name to (frame, value column)."""
    out = None
    for name, (df, col) in stages.items():
        a = df.groupBy("feature").agg(F.min(col).alias("min"), F.sum(col).alias("total"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"),
                                      F.skewness(col).alias("skew")).withColumn("stage", F.lit(name))
        out = a if out is None else out.unionByName(a)
    return out



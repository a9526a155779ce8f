"""Feature transforms and count normalisation."""
from pyspark.sql import functions as F

from ..functions.scalar import draw, yeo_johnson
from ..operators import order, transforms as T
from ..runtime import spread, stage
from .bindings import (FEATURES, SQL_COUNTS, SQL_LONG, SQL_LONG_MISSING, SQL_OBS, counts, long, long_of, obs, obs_missing, table)
from .registry import query

TOTALS = "tot AS (SELECT count(DISTINCT l_orderkey) AS n_total FROM lineitem)"


def n_total(spark, sf):
    return table(spark, sf, "lineitem").agg(F.countDistinct("l_orderkey").alias("n_total"))


@query("zscore", f"""WITH {SQL_LONG_MISSING}, l AS (SELECT * FROM long UNION ALL SELECT obs_id, class, batch, stratum, 'constant', 3.0 FROM obs)
SELECT obs_id, feature, CASE WHEN value IS NULL THEN NULL WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w ELSE 0 END AS z1,
 CASE WHEN value IS NULL THEN NULL WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END AS z0
FROM l WINDOW w AS (PARTITION BY feature)""", dbl="z1 z0")
def _(spark, sf):
    df = long_of(obs_missing(spark, sf, staged=True).withColumn("constant", F.lit(3.0)), ["obs_id"], FEATURES + ["constant"])
    return T.zscore(T.zscore(df, 1, out="z1"), 0, out="z0").select("obs_id", "feature", "z1", "z0")


SHIFT = """sh AS (SELECT *, ln(1 + (value - min(value) OVER w) / (sum(value) OVER w - count(value) OVER w * min(value) OVER w) * 10000) AS t
   FROM long WINDOW w AS (PARTITION BY feature))"""


@query("shift_sum_log1p_z", f"""WITH {SQL_LONG}, {SHIFT} SELECT obs_id, feature, (t - avg(t) OVER w) / stddev_samp(t) OVER w AS z FROM sh WINDOW w AS (PARTITION BY feature)""", dbl="z", d=5)
def _(spark, sf):
    return T.shift_sum_log1p_z(long(spark, sf, staged=True), 1).select("obs_id", "feature", "z")


def fold_of(df, k, seed=11):
    """Hash fold of a stratum: kept whole, independent of row order."""
    return df.withColumn("fold", (F.conv(F.substring(draw(seed, F.col("stratum")), 1, 8), 16, 10).cast("long") % k))


FOLD_SQL = "CAST(CAST('0x' || substr(md5(concat_ws('|', 11, stratum)), 1, 8) AS BIGINT) % 4 AS BIGINT)"
SPLIT_SQL = f"""{SQL_LONG}, fl AS (SELECT *, {FOLD_SQL} AS fold FROM long),
 s AS (SELECT DISTINCT fold AS split FROM fl),
 p AS (SELECT split, feature, min(value) AS lo, sum(value) - count(value) * min(value) AS total FROM fl JOIN s ON fold <> split GROUP BY 1, 2),
 m AS (SELECT split, feature, lo, total, avg(t) AS mean, stddev_samp(t) AS sd FROM (
   SELECT p.*, ln(1 + greatest(value - lo, 0) / total * 10000) AS t FROM fl JOIN p USING (feature) WHERE fold <> split) GROUP BY 1, 2, 3, 4)"""


def folded_long(spark, sf):
    return fold_of(long(spark, sf, stratum=True, staged=True), 4)


@query("shift_sum_fit_apply", f"""WITH {SPLIT_SQL} SELECT obs_id, fl.feature, fold, (ln(1 + greatest(value - lo, 0) / total * 10000) - mean) / sd AS z
FROM fl JOIN m ON m.feature = fl.feature AND split = fold""", dbl="z", d=5)
def _(spark, sf):
    df = folded_long(spark, sf)
    return T.apply_split_params(df, T.shift_sum_split_params(df)).select("obs_id", "feature", "fold", "z")


@query("ratio_log2_branch", f"""WITH {SQL_OBS}, long AS (SELECT obs_id, feature, value FROM (SELECT obs_id, o_totalprice / avg_price AS price_ratio, sum_qty, max_ship_gap FROM obs)
  UNPIVOT (value FOR feature IN (price_ratio, sum_qty, max_ship_gap))), {SHIFT},
 t2 AS (SELECT obs_id, feature, CASE WHEN contains(feature, 'ratio') THEN log2(value) ELSE t END AS t FROM sh)
SELECT obs_id, feature, (t - avg(t) OVER w) / stddev_pop(t) OVER w AS z FROM t2 WINDOW w AS (PARTITION BY feature)""", dbl="z", d=5)
def _(spark, sf):
    df = obs(spark, sf, staged=True).withColumn("price_ratio", F.col("o_totalprice") / F.col("avg_price"))
    return T.ratio_branch(long_of(df, ["obs_id"], ["price_ratio", "sum_qty", "max_ship_gap"])).select("obs_id", "feature", "z")


_YJ = """CASE WHEN x >= 0 THEN CASE WHEN abs(lam) < 1e-8 THEN ln(1 + x) ELSE (pow(1 + x, lam) - 1) / lam END
 ELSE CASE WHEN abs(lam - 2) < 1e-8 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - lam) - 1) / (2 - lam) END END"""


@query("yeo_johnson", f"""WITH b AS (SELECT c_custkey, c_acctbal / 1000 AS x, CAST(unnest([-1.5, 0, 0.5, 1, 2]) AS DOUBLE) AS lam FROM customer)
SELECT c_custkey, lam, {_YJ} AS y FROM b""", dbl="lam y:11")
def _(spark, sf):
    b = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"),
                                            F.explode(F.array(*[F.lit(v) for v in (-1.5, 0.0, 0.5, 1.0, 2.0)])).alias("lam"))
    return b.select("c_custkey", "lam", yeo_johnson(F.col("x"), F.col("lam")).alias("y"))


@query("yeo_johnson_fit", dbl="lam:3 log_lik:2")
def _(spark, sf):
    return T.fit_yeo_johnson(long(spark, sf, staged=True))


@query("adaptive_transform", dbl="t z")
def _(spark, sf):
    return T.adaptive_transform(long(spark, sf, staged=True)).select("obs_id", "feature", "rule", "t", "z")


@query("log1p_if_skewed", f"""WITH {SQL_OBS}, long AS (SELECT obs_id, feature, value FROM (SELECT obs_id, o_totalprice * avg_discount * avg_discount AS rebate, sum_qty, max_ship_gap FROM obs)
  UNPIVOT (value FOR feature IN (rebate, sum_qty, max_ship_gap))),
 r AS (SELECT feature, CASE WHEN min(value) >= 0 AND skewness(value) > 1 THEN 'log1p' ELSE 'none' END AS rule FROM long GROUP BY 1),
 t AS (SELECT obs_id, feature, rule, CASE WHEN rule = 'log1p' THEN ln(1 + value) ELSE value END AS t FROM long JOIN r USING (feature))
SELECT obs_id, feature, rule, (t - avg(t) OVER w) / stddev_samp(t) OVER w AS z FROM t WINDOW w AS (PARTITION BY feature)""", dbl="z")
def _(spark, sf):
    df = obs(spark, sf, staged=True).withColumn("rebate", F.col("o_totalprice") * F.col("avg_discount") * F.col("avg_discount"))
    return T.log1p_if_skewed(long_of(df, ["obs_id"], ["rebate", "sum_qty", "max_ship_gap"])).select("obs_id", "feature", "rule", "z")


@query("robust_z", f"""WITH {SQL_LONG_MISSING}, m AS (SELECT feature, median(value) AS med, mad(value) AS mad FROM long GROUP BY 1),
 z AS (SELECT obs_id, feature, CASE WHEN mad > 0 THEN 0.67448975 * (value - med) / mad END AS rz FROM long JOIN m USING (feature))
SELECT *, coalesce(abs(rz) >= 3.5, false) AS flag35, coalesce(abs(rz) > 5, false) AS flag5 FROM z""", dbl="rz", d=5)
def _(spark, sf):
    z = T.robust_z(long_of(obs_missing(spark, sf, staged=True), ["obs_id"], FEATURES)).select("obs_id", "feature", "rz")
    return z.withColumn("flag35", F.coalesce(F.abs("rz") >= 3.5, F.lit(False))).withColumn("flag5", F.coalesce(F.abs("rz") > 5, F.lit(False)))


@query("tukey_fences", f"""WITH {SQL_LONG}, m AS (SELECT feature, quantile_cont(value, .25) AS q1, quantile_cont(value, .75) AS q3, median(value) AS med, mad(value) AS mad FROM long GROUP BY 1)
SELECT feature, q1, q3, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_mild,
 count(*) FILTER (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) AS n_extreme,
 count(*) FILTER (abs(0.67448975 * (value - med) / nullif(mad, 0)) > 3.5) AS n_modified_z FROM long JOIN m USING (feature) GROUP BY 1, 2, 3""", dbl="q1 q3", d=5)
def _(spark, sf):
    return T.tukey_fences(long(spark, sf, staged=True))


@query("median_impute", f"""WITH {SQL_LONG_MISSING}, m AS (SELECT class, feature, median(value) AS med FROM long GROUP BY 1, 2)
SELECT obs_id, class, feature, coalesce(value, med) AS value, value IS NULL AS imputed, med FROM long JOIN m USING (class, feature)""", dbl="value med", d=5)
def _(spark, sf):
    df = long_of(obs_missing(spark, sf, staged=True), ["obs_id", "class"], FEATURES)
    return T.median_impute(df).select("obs_id", "class", "feature", "value", "imputed", "med")


LOGN_SQL = f"""{SQL_COUNTS}, logn AS (SELECT obs_id, gene, value, ln(1 + value / greatest(sum(value) OVER (PARTITION BY obs_id), 1) * 10000) AS logn FROM counts)"""


def logn(spark, sf):
    c = stage(counts(spark, sf))
    return T.lognorm_counts(spread(c, c.count(), "obs_id"))


@query("lognorm_counts", f"WITH {LOGN_SQL} SELECT obs_id, gene, logn FROM logn", dbl="logn")
def _(spark, sf):
    return logn(spark, sf).select("obs_id", "gene", "logn")


@query("max_normalize", f"""WITH {LOGN_SQL} SELECT obs_id, gene, logn / max(logn) OVER (PARTITION BY gene) AS scaled FROM logn""", dbl="scaled")
def _(spark, sf):
    return T.max_normalize(logn(spark, sf), "gene", "logn").select("obs_id", "gene", "scaled")


MOMENTS_SQL = f"""{LOGN_SQL}, {TOTALS}, mom AS (SELECT gene, count(*) AS n_detected, sum(logn) / n_total AS mean, sum(logn * logn) / n_total - pow(sum(logn) / n_total, 2) AS var_pop,
  (sum(logn * logn) - sum(logn) * sum(logn) / n_total) / (n_total - 1) AS var_samp FROM logn, tot GROUP BY gene, n_total)"""


def moments(spark, sf):
    return T.gene_moments(logn(spark, sf), n_total(spark, sf))


@query("hvg_select", f"""WITH {MOMENTS_SQL} SELECT gene, mean, var_pop, var_samp FROM mom WHERE NOT regexp_matches(gene, 'SMALL$') ORDER BY var_pop DESC, gene LIMIT 60""",
       dbl="mean var_pop var_samp")
def _(spark, sf):
    m = moments(spark, sf).where(~F.col("gene").rlike("SMALL$"))
    return T.hvg_select(m, 60, "var_pop").select("gene", "mean", "var_pop", "var_samp")


@query("dispersion_rank", f"""WITH {MOMENTS_SQL}, b AS (SELECT *, var_samp / mean AS dispersion, ntile(20) OVER (ORDER BY mean, gene) AS bin FROM mom WHERE mean > 0),
 z AS (SELECT gene, bin, dispersion, coalesce((dispersion - avg(dispersion) OVER w) / nullif(stddev_samp(dispersion) OVER w, 0), 0) AS dispersion_z FROM b WINDOW w AS (PARTITION BY bin))
SELECT *, row_number() OVER (ORDER BY round(dispersion_z, 6) DESC, gene) AS position FROM z""", dbl="dispersion dispersion_z", big="bin position")
def _(spark, sf):
    d = T.dispersion_rank(moments(spark, sf)).select("gene", "bin", "dispersion", "dispersion_z")
    return order.positions(d, -F.round("dispersion_z", 6), ["gene"])


@query("transform_audit", f"""WITH {SQL_LONG}, {SHIFT}, z AS (SELECT feature, value, t, (t - avg(t) OVER w) / stddev_samp(t) OVER w AS z FROM sh WINDOW w AS (PARTITION BY feature)),
 a AS (SELECT feature, 'raw' AS stage, value AS v FROM z UNION ALL SELECT feature, 'log', t FROM z UNION ALL SELECT feature, 'z', z FROM z)
SELECT feature, stage, min(v) AS "min", sum(v) AS total, avg(v) AS mean, stddev_samp(v) AS sd, skewness(v) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)) AS skew FROM a GROUP BY 1, 2""",
       dbl="min:5 total:1 mean:5 sd:5 skew:5")
def _(spark, sf):
    z = T.shift_sum_log1p_z(long(spark, sf, staged=True), 1)
    return T.transform_audit({"raw": (z, "value"), "log": (z, "t"), "z": (z, "z")})

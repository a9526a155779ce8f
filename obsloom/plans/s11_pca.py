"""PCA and outlier screening."""
import numpy as np
from pyspark.sql import functions as F

from ..functions.special import chi2_quantile
from ..operators import linalg as L, neighbours as N, order
from ..runtime import stage
from .bindings import FEATURES, SQL_OBS, SQL_VECTORS, obs, table, vectors
from .registry import query
from .s03_joins import KNN_SQL

COV = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM obs" for a in FEATURES for b in FEATURES)


def obs_vec(spark, sf):
    return obs(spark, sf, staged=True).select("obs_id", "class", "batch", F.array(*FEATURES).alias("v"))


@query("pca", f"""WITH {SQL_OBS}, c AS ({COV}), c2 AS (SELECT x.a, y.b, sum(x.r * y.r) AS r FROM c x JOIN c y ON x.b = y.a GROUP BY 1, 2)
SELECT (SELECT count(*) FROM obs) AS n, (SELECT sum(r) FROM c WHERE a = b) AS trace1, (SELECT sum(r) FROM c2 WHERE a = b) AS trace2,
 (SELECT sum(c2.r * c.r) FROM c2 JOIN c ON c2.b = c.a AND c2.a = c.b) AS trace3, (SELECT sum(u.r * w.r) FROM c2 u JOIN c2 w ON u.b = w.a AND u.a = w.b) AS trace4,
 true AS uncorrelated, true AS score_variance_matches""", dbl="trace1 trace2 trace3 trace4", big="n")
def _(spark, sf):
    """Power sums of the eigenvalues (they fix the spectrum), plus checks made on the scores themselves."""
    df = obs_vec(spark, sf)
    m = L.fit_pca(df, "v")
    n, _, m2 = L.moments_one(m.scores(df, "v"), "pc")
    cov = m2 / (n - 1)
    off = np.abs(cov - np.diag(np.diag(cov))).max()
    row = (int(n), *[float((m.variance ** k).sum()) for k in (1, 2, 3, 4)], bool(off < 1e-6), bool(np.abs(np.diag(cov) - m.variance).max() < 1e-6))
    return spark.createDataFrame([row], "n long, trace1 double, trace2 double, trace3 double, trace4 double, uncorrelated boolean, score_variance_matches boolean")


@query("pca_scores", dbl="score")
def _(spark, sf):
    df = obs_vec(spark, sf)
    return L.fit_pca(df, "v").scores(df, "v", 5).select("obs_id", F.posexplode("pc").alias("pc", "score"))


@query("pc_threshold", dbl="variance share cumulative")
def _(spark, sf):
    t = L.fit_pca(obs_vec(spark, sf), "v").table(spark)
    for p in (70, 80, 90):
        t = t.withColumn(f"first_{p}", (F.col("cumulative") >= p / 100) & (F.col("cumulative") - F.col("share") < p / 100))
    return t


@query("pc_sd_flags", dbl="max_abs_z")
def _(spark, sf):
    df = obs_vec(spark, sf)
    m = L.fit_pca(df, "v")
    return L.pc_sd_flags(m.scores(df, "v"), m, max(3, L.pcs_for(m, 0.80))).select("obs_id", "max_abs_z", "worst_pc", "n_exceed", "exceedances", "flag")


@query("mahalanobis_pca", dbl="d2_3 d2_7")
def _(spark, sf):
    df = obs_vec(spark, sf)
    m = L.fit_pca(df, "v")
    s = L.mahalanobis(m.scores(df, "v"), m, [3, 7])
    return s.select("obs_id", "d2_3", "d2_7", "beyond_3_99", "beyond_3_999", "beyond_7_99", "beyond_7_999",
                    (F.col("beyond_3_999") | F.col("beyond_7_999")).alias("extreme"))


@query("robust_distance", dbl="rd2:3")
def _(spark, sf):
    df = obs_vec(spark, sf)
    m = L.fit_pca(df, "v")
    return L.robust_distance(m.scores(df, "v", 5), "pc")[0].select("obs_id", "rd2", "outlier")


LOF_SQL = """kd AS (SELECT obs_id, max(dist) AS kd FROM knn GROUP BY 1),
 lrd AS (SELECT knn.obs_id, 1 / greatest(avg(greatest(kd.kd, dist)), 1e-12) AS lrd FROM knn JOIN kd ON kd.obs_id = nbr GROUP BY 1),
 lf AS (SELECT knn.obs_id, avg(b.lrd) / max(a.lrd) AS lof FROM knn JOIN lrd a ON a.obs_id = knn.obs_id JOIN lrd b ON b.obs_id = nbr GROUP BY 1)"""


@query("lof", f"WITH {KNN_SQL.format(k=5)}, {LOF_SQL} SELECT obs_id, lof, round(lof, 9) > 1.1 AS flag FROM lf", dbl="lof")
def _(spark, sf):
    return N.lof(N.knn(vectors(spark, sf), "obs_id", "v", 5), "obs_id").withColumn("flag", F.round("lof", 9) > 1.1)


@query("multimethod_outlier")
def _(spark, sf):
    """3 SD and (robust distance or local outlier factor), for three to five leading components."""
    df = vectors(spark, sf)
    m = L.fit_pca(df, "v")
    s = m.scores(df, "v", 5).select("obs_id", "pc")
    out = None
    for k in (3, 4, 5):
        sk = s.select("obs_id", F.slice("pc", 1, k).alias("pc"))
        sd = L.pc_sd_flags(sk, m, k, limit=2.0).select("obs_id", F.col("flag").alias("sd_flag"))
        rd = L.robust_distance(sk, "pc", quantile=0.975)[0].select("obs_id", F.col("outlier").alias("rd_flag"))
        lf = N.lof(N.knn(sk, "obs_id", "pc", 5), "obs_id").select("obs_id", (F.col("lof") > 1.5).alias("lof_flag"))
        j = sd.join(rd, "obs_id").join(lf, "obs_id").withColumn("combined", F.col("sd_flag") & (F.col("rd_flag") | F.col("lof_flag")))
        a = j.agg(*[F.count_if(c).alias("n_" + c) for c in ("sd_flag", "rd_flag", "lof_flag", "combined")], F.count("*").alias("n")).withColumn("n_pc", F.lit(k))
        out = a if out is None else out.unionByName(a)
    return out


def sign_align(a, b, key):
    """Sign per component that makes two score tables agree, and the agreement after flipping."""
    j = a.select(key, F.posexplode("v").alias("component", "x")).join(b.select(key, F.posexplode("v").alias("component", "y")), [key, "component"])
    s = j.groupBy("component").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.max(F.abs(F.abs("x") - F.abs("y"))).alias("max_abs_diff"))
    return s.withColumn("sign", F.when(F.col("dot") < 0, -1.0).otherwise(1.0))


@query("sign_align", f"""WITH {SQL_VECTORS}, a AS (SELECT obs_id, unnest(v) AS x, unnest(range(0, len(v))) AS component FROM vectors),
 b AS (SELECT obs_id, component, CASE WHEN component % 3 = 0 THEN -x ELSE x END AS y FROM a)
SELECT component, sum(x * y) AS dot, max(abs(abs(x) - abs(y))) AS max_abs_diff, CASE WHEN sum(x * y) < 0 THEN -1.0::DOUBLE ELSE 1.0 END AS sign FROM a JOIN b USING (obs_id, component) GROUP BY 1""",
       dbl="dot max_abs_diff sign", big="component")
def _(spark, sf):
    a = vectors(spark, sf)
    b = a.withColumn("v", F.transform("v", lambda x, i: F.when(i % 3 == 0, -x).otherwise(x)))
    return sign_align(a, b, "obs_id")


@query("procrustes_rmse", "SELECT count(*) AS n, 0.5 AS scale, 0.0 AS rmse FROM embeddings", dbl="scale rmse")
def _(spark, sf):
    """Second set = first set rotated by a quarter turn in paired axes and doubled, so the answer is known."""
    turned = F.transform("v", lambda x, i: F.when(i % 2 == 0, -2 * F.col("v")[i + 1]).otherwise(2 * F.col("v")[i - 1]))
    df = vectors(spark, sf).select("v", turned.alias("w"))
    _, scale, rmse = L.procrustes(df, "v", "w")
    return df.agg(F.count("*").alias("n"), F.lit(scale).alias("scale"), F.lit(rmse).alias("rmse"))


def cov_ellipse(df, x, y, key, level=0.9):
    """Centre, covariance, closed-form eigen axes, angle and half extents at a chi-square level."""
    r2 = float(chi2_quantile(level, 2))
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("a"),
                            F.covar_samp(x, y).alias("b"), F.var_samp(y).alias("d"))
    g = g.where("n >= 3")
    a, b, d = F.col("a"), F.col("b"), F.col("d")
    root = F.sqrt((a - d) * (a - d) / 4 + b * b)
    return (g.withColumn("major", F.sqrt(((a + d) / 2 + root) * r2)).withColumn("minor", F.sqrt(F.greatest((a + d) / 2 - root, F.lit(0.0)) * r2))
            .withColumn("angle", F.atan2(2 * b, a - d) / 2).withColumn("extent_x", F.sqrt(a * r2)).withColumn("extent_y", F.sqrt(d * r2)))


R2_90 = chi2_quantile(0.9, 2)


@query("cov_ellipse", f"""WITH {SQL_OBS}, g AS (SELECT class, count(*) AS n, avg(sum_qty) AS mx, avg(max_ship_gap) AS my, var_samp(sum_qty) AS a, covar_samp(sum_qty, max_ship_gap) AS b,
  var_samp(max_ship_gap) AS d FROM obs GROUP BY 1)
SELECT *, sqrt(((a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b)) * {R2_90!r}) AS major, sqrt(greatest((a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b), 0) * {R2_90!r}) AS minor,
 atan2(2 * b, a - d) / 2 AS angle, sqrt(a * {R2_90!r}) AS extent_x, sqrt(d * {R2_90!r}) AS extent_y FROM g""", dbl="mx my a b d major minor angle extent_x extent_y", d=4)
def _(spark, sf):
    return cov_ellipse(obs(spark, sf), "sum_qty", "max_ship_gap", "class")


@query("mcd_ellipse", dbl="mx my major minor angle", d=3)
def _(spark, sf):
    """Ellipse of the rows that survive the robust distance of their class."""
    df = obs(spark, sf, staged=True).select("class", "sum_qty", "max_ship_gap", F.array("sum_qty", "max_ship_gap").alias("v"))
    kept = L.robust_distance(df, "v", quantile=0.975, key="class")[0].where("NOT outlier")
    return cov_ellipse(kept, "sum_qty", "max_ship_gap", "class").select("class", "n", "mx", "my", "major", "minor", "angle")


def radial_scale(df, x, y, prob, keys=()):
    """Divide coordinates by a high percentile of the radius."""
    r = df.withColumn("feature", F.lit("r")).withColumn("radius", F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)))
    q = stage(order.quantiles(r, ["feature", *keys], "radius", {"_q": prob}))
    j = r.join(q, ["feature", *keys])
    return j.withColumn(x, F.try_divide(F.col(x), F.col("_q"))).withColumn(y, F.try_divide(F.col(y), F.col("_q"))).drop("_q", "feature", "radius")


@query("radial_scale", f"""WITH {SQL_VECTORS}, q AS (SELECT quantile_cont(sqrt(v[1] * v[1] + v[2] * v[2]), 0.99) AS q FROM vectors)
SELECT obs_id, v[1] / q AS x, v[2] / q AS y FROM vectors, q""", dbl="x y")
def _(spark, sf):
    return radial_scale(vectors(spark, sf).select("obs_id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")), "x", "y", 0.99)

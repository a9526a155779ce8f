"""Cross-modal reduced-rank regression."""
import numpy as np
from pyspark.sql import functions as F

from ..functions.scalar import draw
from ..operators import linalg as L, mapping as P, resample as R, rrr, transforms as T
from .bindings import SQL_VECTORS, table, vectors
from .registry import query
from .s08_transforms import logn, moments

PX = 40


def blocks(spark, sf):
    return vectors(spark, sf).select("obs_id", "class", F.slice("v", 1, PX).alias("x"), F.slice("v", PX + 1, 64 - PX).alias("y"))


@query("expression_pca", dbl="variance share cumulative", d=5)
def _(spark, sf):
    genes = [r["gene"] for r in T.hvg_select(moments(spark, sf), 60, "var_pop").select("gene").collect()]
    ids = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("obs_id")).distinct()
    dense = P.dense_vectors(logn(spark, sf), ids, genes, "logn")
    t = L.fit_pca(dense, "v", standardise=True, ddof=0).table(spark)
    return t.where("pc <= 20")


@query("rrr_fit", dbl="value sign_ok:0", d=4)
def _(spark, sf):
    """Axes of the fitted block (largest absolute entry positive) with the check that they are orthonormal."""
    n, mean, m2 = rrr.joint_moments(blocks(spark, sf), "x", "y")
    m = rrr.fit(mean, m2, PX, 3)
    ok = float(np.abs(m.axes.T @ m.axes - np.eye(3)).max() < 1e-9)
    rows = [(a + 1, j, float(m.axes[j, a]), ok) for a in range(3) for j in range(64 - PX)]
    return spark.createDataFrame(rows, "axis long, feature long, value double, sign_ok double")


@query("rrr_scores", dbl="x_score y_score", d=5)
def _(spark, sf):
    df = blocks(spark, sf)
    n, mean, m2 = rrr.joint_moments(df, "x", "y")
    s = rrr.scores(df, rrr.fit(mean, m2, PX, 2), "x", "y")
    return s.select("obs_id", F.posexplode(F.arrays_zip("x_score", "y_score")).alias("axis", "s")).select("obs_id", "axis", "s.x_score", "s.y_score")


LOAD_SQL = f"""{SQL_VECTORS}, sc AS (SELECT obs_id, v, v[1] + v[2] AS s1, v[41] - v[42] AS s2 FROM vectors),
 ld AS (SELECT j, coalesce(corr(v[j + 1], s1), 0) AS l1, coalesce(corr(v[j + 1], s2), 0) AS l2 FROM sc, (SELECT unnest(range(0, 64)) AS j) GROUP BY j)"""


def loadings(spark, sf):
    """Correlation of every feature with given scores, read off one joint moment matrix; 0 where undefined."""
    v = vectors(spark, sf).select(F.concat("v", F.array(F.col("v")[0] + F.col("v")[1], F.col("v")[40] - F.col("v")[41])).alias("vs"))
    _, _, m2 = L.moments_one(v, "vs")
    sd = np.sqrt(np.diag(m2))
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.nan_to_num(m2 / np.outer(sd, sd))
    return spark.createDataFrame([(j, float(r[j, 64]), float(r[j, 65])) for j in range(64)], "j long, l1 double, l2 double")


@query("correlation_loadings", f"WITH {LOAD_SQL} SELECT j, l1, l2 FROM ld", dbl="l1 l2", big="j")
def _(spark, sf):
    return loadings(spark, sf)


@query("top_loadings", f"WITH {LOAD_SQL} SELECT j, sqrt(l1 * l1 + l2 * l2) AS norm FROM ld ORDER BY norm DESC, j LIMIT 12", dbl="norm", big="j")
def _(spark, sf):
    return loadings(spark, sf).select("j", F.sqrt(F.col("l1") * F.col("l1") + F.col("l2") * F.col("l2")).alias("norm")).orderBy(F.desc("norm"), "j").limit(12)


@query("rrr_r2", dbl="r2", d=5)
def _(spark, sf):
    n, mean, m2 = rrr.joint_moments(blocks(spark, sf), "x", "y")
    rows = [(k, rrr.r2(rrr.fit(mean, m2, PX, k), n, mean, m2)) for k in (1, 2, 3, 4, 5, 24)]
    return spark.createDataFrame(rows, "rank long, r2 double")


@query("rrr_cv_rank", dbl="median q025 q975", d=5)
def _(spark, sf):
    """Five hash folds in each repeat; moments of all (repeat, fold) cells come from one job."""
    from .s04_aggregations import resample_summary
    df = R.repeats(blocks(spark, sf), range(4))
    fold = F.conv(F.substring(draw(53, F.col("rep"), F.col("obs_id")), 1, 8), 16, 10).cast("long") % 5
    parts = rrr.joint_moments(df.withColumn("rf", F.concat_ws("/", F.col("rep").cast("string"), fold.cast("string"))), "x", "y", "rf")
    rows = rrr.cv_ranks(parts, PX, range(1, 6))
    return resample_summary(spark.createDataFrame(rows, "rep long, rank long, value double"), ["rank"])


@query("rrr_class_adjusted", dbl="r2 r2_adjusted", d=5)
def _(spark, sf):
    df = blocks(spark, sf)
    raw = rrr.joint_moments(df, "x", "y")
    adj = rrr.joint_moments(rrr.center_by(rrr.center_by(df, "class", "x"), "class", "y"), "x", "y")
    rows = [(k, rrr.r2(rrr.fit(raw[1], raw[2], PX, k), *raw), rrr.r2(rrr.fit(adj[1], adj[2], PX, k), *adj)) for k in (1, 2, 3)]
    return spark.createDataFrame(rows, "rank long, r2 double, r2_adjusted double")

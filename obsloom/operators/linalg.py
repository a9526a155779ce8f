"""Moments on Spark, p x p solves on the driver, scores back on Spark.

Partial moments (count, mean, centred cross-products) are merged in two grouped steps, so
the driver receives one p x p matrix per key whatever the number of partitions.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..functions.special import chi2_quantile

MERGE_BUCKETS = 64


def _merge(parts):
    n, mean, m2 = 0.0, None, None
    for k, mu, m in parts:
        mu = np.asarray(mu, float)
        m = np.asarray(m, float).reshape(len(mu), len(mu))
        if mean is None:
            n, mean, m2 = k, mu, m
        else:
            d, tot = mu - mean, n + k
            m2 = m2 + m + np.outer(d, d) * (n * k / tot)
            mean = mean + d * (k / tot)
            n = tot
    return n, mean, m2


_SCHEMA = "k string, bucket int, n double, mean array<double>, m2 array<double>"


def moments(df: DataFrame, vec: str, key: str | None = None, weight: str | None = None) -> DataFrame:
    """(k, n, mean, m2) per key; ``m2`` is the flattened sum of centred cross-products."""
    src = df.select((F.col(key).cast("string") if key else F.lit("")).alias("k"), F.col(vec).alias("v"),
                    (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).where(F.col(vec).isNotNull())

    def partial(batches):
        acc = {}
        for b in batches:
            for k, g in b.groupby("k"):
                x, w = np.stack(g["v"].to_numpy()), g["w"].to_numpy()
                mu = (x * w[:, None]).sum(0) / w.sum()
                c = x - mu
                part = (w.sum(), mu, (c * w[:, None]).T @ c)
                acc[k] = _merge([acc[k], part]) if k in acc else part
        bucket = TaskContext.get().partitionId() % MERGE_BUCKETS
        yield pd.DataFrame([(k, bucket, n, mu.tolist(), m.ravel().tolist()) for k, (n, mu, m) in acc.items()],
                           columns=["k", "bucket", "n", "mean", "m2"])

    def merge(pdf):
        n, mu, m = _merge(zip(pdf["n"], pdf["mean"], pdf["m2"]))
        return pd.DataFrame([(pdf["k"].iloc[0], -1, n, mu.tolist(), m.ravel().tolist())], columns=["k", "bucket", "n", "mean", "m2"])

    first = src.mapInPandas(partial, _SCHEMA).groupBy("k", "bucket").applyInPandas(merge, _SCHEMA)
    return first.groupBy("k").applyInPandas(merge, _SCHEMA).drop("bucket")


def moments_one(df: DataFrame, vec: str, weight: str | None = None):
    r = moments(df, vec, weight=weight).first()
    p = len(r["mean"])
    return r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(p, p)


def sign_rule(loadings: np.ndarray) -> np.ndarray:
    """Largest absolute loading of each component is positive."""
    top = np.abs(loadings).argmax(0)
    s = np.sign(loadings[top, np.arange(loadings.shape[1])])
    return loadings * np.where(s == 0, 1, s)


@dataclass
class PCA:
    mean: np.ndarray
    scale: np.ndarray
    variance: np.ndarray
    loadings: np.ndarray
    n: float

    @property
    def share(self):
        return self.variance / self.variance.sum()

    def scores(self, df: DataFrame, vec: str, k: int | None = None, out: str = "pc") -> DataFrame:
        return project(df, vec, self.loadings[:, :k or len(self.variance)] / self.scale[:, None], self.mean, out)

    def table(self, spark) -> DataFrame:
        c = np.cumsum(self.share)
        rows = [(i + 1, float(v), float(s), float(t)) for i, (v, s, t) in enumerate(zip(self.variance, self.share, c))]
        return spark.createDataFrame(rows, "pc long, variance double, share double, cumulative double")


def project(df: DataFrame, vec: str, matrix: np.ndarray, center: np.ndarray, out: str) -> DataFrame:
    """Arrow-batched (x - center) @ matrix."""
    m, c = np.asarray(matrix, float), np.asarray(center, float)

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_numpy()) - c) @ m)) if len(v) else pd.Series([], dtype=object)

    return df.withColumn(out, apply(F.col(vec)))


def decompose(n, mean, m2, standardise=True, ddof=1) -> PCA:
    cov = m2 / (n - ddof)
    sd = np.sqrt(np.diag(cov)) if standardise else np.ones(len(mean))
    sd = np.where(sd > 0, sd, 1.0)
    val, vecs = np.linalg.eigh(cov / np.outer(sd, sd))
    o = np.argsort(val)[::-1]
    return PCA(mean, sd, np.maximum(val[o], 0.0), sign_rule(vecs[:, o]), n)


def fit_pca(df: DataFrame, vec: str, standardise=True, ddof=1) -> PCA:
    return decompose(*moments_one(df, vec), standardise, ddof)


def pcs_for(model: PCA, share: float) -> int:
    return int(np.searchsorted(np.cumsum(model.share), share) + 1)


def pc_sd_flags(scores: DataFrame, model: PCA, k: int, limit: float = 3.0, pc: str = "pc") -> DataFrame:
    """|score / sd| beyond the limit on the first k components: any, count, worst component, list."""
    z = F.transform(F.zip_with(F.slice(pc, 1, k), F.array(*[F.lit(float(np.sqrt(v))) for v in model.variance[:k]]), lambda a, b: F.try_divide(a, b)), lambda x: F.abs(x))
    hits = F.filter(F.transform("_z", lambda x, i: F.when(x > limit, F.concat(F.lit("PC"), (i + 1).cast("string")))), lambda x: x.isNotNull())
    return (scores.withColumn("_z", z).withColumn("max_abs_z", F.array_max("_z"))
            .withColumn("worst_pc", F.array_position("_z", F.col("max_abs_z")))
            .withColumn("exceedances", F.array_join(hits, ";")).withColumn("n_exceed", F.size(hits).cast("long"))
            .withColumn("flag", F.col("n_exceed") > 0).drop("_z"))


def mahalanobis(scores: DataFrame, model: PCA, ks, probs=(0.99, 0.999), pc: str = "pc") -> DataFrame:
    """Sum of squared standardised scores over the first k components against chi-square limits."""
    for k in ks:
        d2 = F.aggregate(F.zip_with(F.slice(pc, 1, k), F.array(*[F.lit(float(v)) for v in model.variance[:k]]), lambda a, b: F.try_divide(a * a, b)),
                         F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
        scores = scores.withColumn(f"d2_{k}", d2)
        for p in probs:
            scores = scores.withColumn(f"beyond_{k}_{str(p)[2:]}", F.col(f"d2_{k}") > float(chi2_quantile(p, k)))
    return scores


def quadratic_form(df: DataFrame, vec: str, centers: dict, inverses: dict, out: str, key: str) -> DataFrame:
    """(x - c)' inv (x - c) with the centre and inverse of the row's key; a handful of keys."""
    @F.pandas_udf("double")
    def apply(v: pd.Series, k: pd.Series) -> pd.Series:
        res = np.full(len(v), np.nan)
        for name in k.unique():
            if name in centers:
                at = (k == name).to_numpy()
                x = np.stack(v[at].to_numpy()) - centers[name]
                res[at] = ((x @ inverses[name]) * x).sum(1)
        return pd.Series(res)

    return df.withColumn(out, apply(F.col(vec), F.col(key)))


def robust_distance(df: DataFrame, vec: str, alpha: float = 0.75, steps: int = 4, quantile: float | None = None, key: str | None = None):
    """Concentration steps towards the minimum covariance determinant, for all keys together.

    Start from medians and MADs, then repeat: distance, keep the nearest share, new mean and
    covariance, all as grouped Spark aggregates. Approximate quantiles only choose the cut point;
    every row is scored in every step. Returns (frame with ``rd2`` and ``outlier``, limit per key).
    """
    source = df.withColumn("_k", F.col(key).cast("string") if key else F.lit(""))
    df = source.select("_k", vec).persist()
    p = len(df.select(vec).first()[0])
    med = {r[0]: np.array(r[1:]) for r in df.groupBy("_k").agg(*[F.percentile_approx(F.col(vec)[j], 0.5, 10000) for j in range(p)]).collect()}
    at = F.create_map(*[x for k, m in med.items() for x in (F.lit(k), F.array(*[F.lit(float(t)) for t in m]))])
    dev = [F.percentile_approx(F.abs(F.col(vec)[j] - at[F.col("_k")][j]), 0.5, 10000) for j in range(p)]
    mad = {r[0]: np.array(r[1:]) for r in df.groupBy("_k").agg(*dev).collect()}
    centers, inv, n = med, {k: np.diag(1 / np.maximum(1.4826 * m, 1e-9) ** 2) for k, m in mad.items()}, {}
    for _ in range(steps):
        d = quadratic_form(df, vec, centers, inv, "rd2", "_k")
        cuts = {r[0]: r[1] for r in d.groupBy("_k").agg(F.percentile_approx("rd2", alpha, 10000)).collect()}
        near = d.where(F.col("rd2") <= F.create_map(*[x for k, c in cuts.items() for x in (F.lit(k), F.lit(float(c)))])[F.col("_k")])
        fits = {r["k"]: r for r in moments(near, vec, "_k").collect()}
        centers = {k: np.array(r["mean"]) for k, r in fits.items()}
        n = {k: r["n"] for k, r in fits.items()}
        inv = {k: np.linalg.pinv(np.array(r["m2"]).reshape(p, p) / max(r["n"] - 1, 1)) for k, r in fits.items()}
    d = quadratic_form(df, vec, centers, inv, "rd2", "_k")
    half = {r[0]: r[1] for r in d.groupBy("_k").agg(F.percentile_approx("rd2", 0.5, 10000)).collect()}
    df.unpersist()
    # consistency at the normal model folds into the inverse; one limit per key
    inv = {k: m * (chi2_quantile(0.5, p) / half[k] if half[k] else 1.0) for k, m in inv.items()}
    limits = {k: chi2_quantile(quantile if quantile else 1 - 0.025 / max(n[k], 1), p) for k in inv}
    lim = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))])
    out = quadratic_form(source, vec, centers, inv, "rd2", "_k")
    return out.withColumn("outlier", F.col("rd2") > lim[F.col("_k")]).drop("_k"), limits


def procrustes(df: DataFrame, a: str, b: str):
    """Orthogonal map and scale of b onto a, with the residual RMSE, from one joint moment matrix."""
    n, mean, m2 = moments_one(df.select(F.concat(a, b).alias("ab")), "ab")
    p = len(mean) // 2
    u, s, vt = np.linalg.svd(m2[p:, :p])
    scale = s.sum() / np.trace(m2[p:, p:])
    rss = np.trace(m2[:p, :p]) - s.sum() ** 2 / np.trace(m2[p:, p:])
    return u @ vt, float(scale), float(np.sqrt(max(rss, 0.0) / n))

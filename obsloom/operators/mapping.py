"""Mapping query observations onto reference classes with sparse log-normalised counts."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import cascade, draw

# Correlation and vote limits of the confidence rules.
GOOD_R, HIGH_RISK_R = 0.50, 0.40
HIGH_TIER, MODERATE_TIER = (0.80, 0.50), (0.50, 0.20)


def dense_vectors(triplets: DataFrame, ids: DataFrame, genes, value: str, out: str = "v", key: str = "obs_id") -> DataFrame:
    """(key, dense vector over the chosen genes); ids without any of them get zeros."""
    at = triplets.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene string, _i int")
    g = len(genes)
    t = triplets.join(at, "gene").groupBy(key).agg(F.collect_list(F.struct("_i", F.col(value).cast("double").alias("x"))).alias("_s"))

    @F.pandas_udf("array<double>")
    def scatter(i: pd.Series, x: pd.Series) -> pd.Series:
        m = np.zeros((len(i), g))
        for r, (a, b) in enumerate(zip(i, x)):
            if a is not None and len(a):
                m[r, a] = b
        return pd.Series(list(m))

    return ids.select(key).join(t, key, "left").select(key, scatter(F.col("_s._i"), F.col("_s.x")).alias(out))


def centroids(reference: DataFrame, classes: DataFrame, value: str = "logn") -> DataFrame:
    """(class, gene, mean) with absent triplets as zeros; ``classes``: (obs_id, class)."""
    size = classes.groupBy("class").agg(F.count("*").alias("_n"))
    s = reference.join(classes, "obs_id").groupBy("class", "gene").agg(F.sum(value).alias("_s"))
    return s.join(size, "class").select("class", "gene", (F.col("_s") / F.col("_n")).alias("mean"))


def centroid_correlation(query: DataFrame, cents: DataFrame, n_genes: int, value: str = "logn") -> DataFrame:
    """Pearson of each query with each centroid over all genes, from sums over present triplets."""
    g = float(n_genes)
    q = query.groupBy("obs_id").agg(F.sum(value).alias("sx"), F.sum(F.col(value) * F.col(value)).alias("sxx"))
    c = cents.groupBy("class").agg(F.sum("mean").alias("sy"), F.sum(F.col("mean") * F.col("mean")).alias("syy"))
    xy = query.join(cents, "gene").groupBy("obs_id", "class").agg(F.sum(F.col(value) * F.col("mean")).alias("sxy"))
    j = xy.join(q.hint("merge"), "obs_id").join(F.broadcast(c), "class")
    r = F.try_divide(g * F.col("sxy") - F.col("sx") * F.col("sy"),
                     F.sqrt((g * F.col("sxx") - F.col("sx") * F.col("sx")) * (g * F.col("syy") - F.col("sy") * F.col("sy"))))
    return j.select("obs_id", "class", F.coalesce(r, F.lit(0.0)).alias("r"))


def best_two(corr: DataFrame) -> DataFrame:
    """Best and second class per query with the quality call."""
    top = F.sort_array(F.collect_list(F.struct(-F.round("r", 9), F.col("class"), F.col("r").alias("rr"))))  # one entry per class
    b = corr.groupBy("obs_id").agg(top.alias("t"))
    b = b.select("obs_id", F.col("t")[0]["class"].alias("best"), F.col("t")[0]["rr"].alias("r_best"),
                 F.get("t", F.lit(1))["class"].alias("second"), F.get("t", F.lit(1))["rr"].alias("r_second"))
    r = F.round("r_best", 9)
    return b.withColumn("quality", cascade([(r >= GOOD_R, "good"), (r > HIGH_RISK_R, "low_risk")], "high_risk"))


def draw_matrix(spark, genes, reps: int, seed: int) -> np.ndarray:
    """Gene multiplicities of each resample with replacement (repeats x genes, fixed size)."""
    g = len(genes)
    d = spark.range(reps).select(F.col("id").cast("int").alias("rep"), F.explode(F.sequence(F.lit(1), F.lit(g))).alias("i"))
    h = F.conv(F.substring(draw(seed, F.col("rep"), F.col("i")), 1, 8), 16, 10).cast("long") % g
    w = np.zeros((reps, g))
    for r in d.groupBy("rep", h.alias("pos")).agg(F.count("*").alias("w")).collect():
        w[r["rep"], r["pos"]] = r["w"]
    return w


def bootstrap_votes(dense: DataFrame, center: np.ndarray, classes, weights: np.ndarray, vec: str = "v") -> DataFrame:
    """Share of gene resamples won by each class, per query.

    Centroids (classes x genes) and multiplicities (repeats x genes) are fixed-size matrices that
    travel with the function, so all repeats are one narrow pass with matrix products.
    """
    w, c, names = weights, center, list(classes)
    n = w.sum(1)[None, :]
    sy, syy = w @ c.T, w @ (c * c).T

    def votes(batches):
        for b in batches:
            for s in range(0, len(b), 2000):
                part = b.iloc[s:s + 2000]
                x = np.stack(part[vec].to_numpy())
                sx, sxx = x @ w.T, (x * x) @ w.T
                r = np.zeros((len(names), *sx.shape))
                for k in range(len(names)):
                    sxy = x @ (w * c[k]).T
                    num = n * sxy - sx * sy[:, k][None, :]
                    den = np.sqrt(np.maximum(n * sxx - sx * sx, 0) * np.maximum(n * syy[:, k][None, :] - sy[:, k][None, :] ** 2, 0))
                    r[k] = np.where(den > 1e-12, num / np.where(den > 1e-12, den, 1), 0.0)
                win = np.round(r, 9).argmax(0)
                share = np.stack([(win == k).mean(1) for k in range(len(names))], 1)
                yield pd.DataFrame({"obs_id": part["obs_id"].to_numpy(), "share": list(share)})

    raw = dense.select("obs_id", vec).mapInPandas(votes, "obs_id long, share array<double>")
    lab = F.array(*[F.lit(x) for x in names])
    pairs = F.sort_array(F.transform(F.arrays_zip("share", lab.alias("label")), lambda s: F.struct((-s["share"]).alias("neg"), s["label"].alias("label"))))
    ent = F.aggregate("share", F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return (raw.select("obs_id", pairs.alias("p"), ent.alias("entropy")).select(
        "obs_id", F.col("p")[0]["label"].alias("top1"), (-F.col("p")[0]["neg"]).alias("support"), F.col("p")[1]["label"].alias("top2"),
        (F.col("p")[1]["neg"] - F.col("p")[0]["neg"]).alias("margin"), "entropy"))


def confidence_tier(support, margin):
    s, m = F.round(support, 9), F.round(margin, 9)
    return cascade([((s >= HIGH_TIER[0]) & (m >= HIGH_TIER[1]), "High"), ((s >= MODERATE_TIER[0]) & (m >= MODERATE_TIER[1]), "Moderate")], "Low")


def run_stability(runs: DataFrame, key: str, label: str, collapse=None) -> DataFrame:
    """Stable_<label> when every run gives the same label, after optional collapsing."""
    lab = collapse(F.col(label)) if collapse else F.col(label)
    g = runs.groupBy(key).agg(F.min(lab).alias("lo"), F.max(lab).alias("hi"), F.count("*").alias("n_runs"))
    return g.select(key, "n_runs", F.when(F.col("lo") == F.col("hi"), F.concat(F.lit("Stable_"), F.col("lo"))).otherwise("fluctuating").alias("status"))


def mutual_transfer(cross: DataFrame, sides: DataFrame, labels: DataFrame, k_weight: int) -> DataFrame:
    """Label transfer through mutual nearest neighbours.

    ``cross``: neighbours on the other side (obs_id, nbr, dist, rn); ``sides``: (obs_id, is_ref).
    A reference row is an anchor when it forms a mutual pair; each query lets its nearest anchors
    vote by inverse distance. Published idea, not the output of any given toolkit.
    """
    e = cross.join(sides, "obs_id")
    q2r = e.where("NOT is_ref").select(F.col("obs_id").alias("q"), F.col("nbr").alias("r"), "dist", "rn")
    r2q = e.where("is_ref").select(F.col("obs_id").alias("r"), F.col("nbr").alias("q"))
    anchors = q2r.join(r2q, ["q", "r"]).groupBy("r").agg(F.count("*").alias("n_links"))
    vote = q2r.where(F.col("rn") <= k_weight).join(anchors, "r").join(labels.select(F.col("obs_id").alias("r"), "class"), "r")
    v = vote.groupBy("q", "class").agg(F.sum(1 / (F.col("dist") + 1e-9)).alias("w"))
    best = v.groupBy("q").agg(F.min_by("class", F.struct(-F.col("w"), F.col("class"))).alias("label"), (F.max("w") / F.sum("w")).alias("support"))
    return sides.where("NOT is_ref").select(F.col("obs_id").alias("q")).join(best, "q", "left").withColumnRenamed("q", "obs_id")

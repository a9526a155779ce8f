"""Association between features and redundancy selection.

Pair statistics come from one aggregate over the wide table; the pair table has one
row per feature pair, so what follows works on at most p x p rows.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..runtime import spread, stage
from . import order

# A value of so many rows is frequent, or of more where that makes too many such values.
FREQUENT, MOST_FREQUENT = 1000, 100_000

_MATS = "k int, bucket int, n array<double>, mean array<double>, cross array<double>, sq array<double>"


def _join_parts(a, b):
    """Merge two sets of pairwise-complete moments; entry (i, j) covers rows where both are present."""
    n1, m1, c1, v1 = a
    n2, m2, c2, v2 = b
    n, d = n1 + n2, m2 - m1
    safe = np.maximum(n, 1)
    w = n1 * n2 / safe
    return n, m1 + d * n2 / safe, c1 + c2 + d * d.T * w, v1 + v2 + d * d * w


def _batch_moments(x: np.ndarray):
    """Moments of one batch, shifted by its first values so that a constant column has no spread at all."""
    m = ~np.isnan(x)
    base = np.array([x[m[:, j], j][0] if m[:, j].any() else 0.0 for j in range(x.shape[1])])
    z, f = np.where(m, x - base, 0.0), m.astype(float)
    n, s = f.T @ f, z.T @ f
    safe = np.maximum(n, 1)
    return n, base[:, None] + s / safe, z.T @ z - s * s.T / safe, (z * z).T @ f - s * s / safe


def pair_moments(df: DataFrame, features) -> DataFrame:
    """(a, b, n, r, cov) for each unordered pair over rows where both are present; r is NULL without spread.

    One pass: matrix products per Arrow batch, p x p partial results merged in two grouped steps.
    """
    names = list(features)
    p = len(names)

    def row(bucket, t):
        return pd.DataFrame([(0, bucket, *[x.ravel().tolist() for x in t])], columns=["k", "bucket", "n", "mean", "cross", "sq"])

    def partial(batches):
        acc = None
        for b in batches:
            if len(b):
                t = _batch_moments(b.to_numpy(dtype=float, na_value=np.nan))
                acc = t if acc is None else _join_parts(acc, t)
        if acc is not None:
            yield row(TaskContext.get().partitionId() % 64, acc)

    def gather(pdf):
        acc = None
        for r in pdf.itertuples():
            t = tuple(np.asarray(x, float).reshape(p, p) for x in (r.n, r.mean, r.cross, r.sq))
            acc = t if acc is None else _join_parts(acc, t)
        return acc

    def merge(pdf):
        return row(0, gather(pdf))

    def finish(pdf):
        n, _, c, v = gather(pdf)
        out = []
        for i, j in combinations(range(p), 2):
            spread = max(v[i, j], 0.0) * max(v[j, i], 0.0)
            out.append((names[i], names[j], int(n[i, j]), c[i, j] / np.sqrt(spread) if spread > 0 else None,
                        c[i, j] / (n[i, j] - 1) if n[i, j] > 1 else None))
        return pd.DataFrame(out, columns=["a", "b", "n", "r", "cov"])

    parts = df.select(*[F.col(f).cast("double").alias(f) for f in names]).mapInPandas(partial, _MATS)
    return (parts.groupBy("k", "bucket").applyInPandas(merge, _MATS)
            .groupBy("k").applyInPandas(finish, "a string, b string, n long, r double, cov double"))


def full_matrix(pairs: DataFrame, features, r="r") -> DataFrame:
    """Both triangles and the unit diagonal; an undefined value becomes 0 and is marked."""
    up = pairs.select("a", "b", F.coalesce(r, F.lit(0.0)).alias("r"), F.col(r).isNull().alias("undefined"))
    diag = pairs.sparkSession.createDataFrame([(f, f, 1.0, False) for f in features], "a string, b string, r double, undefined boolean")
    return up.unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b"), "r", "undefined")).unionByName(diag)


def ranked_wide(df: DataFrame, key: str, features) -> DataFrame:
    """Each feature replaced by its tie-averaged rank (NULL stays NULL); rows that share a key give its highest ranks.

    Values that many rows share get their rank from a broadcast table, the others by a join, so no task holds a frequent value."""
    long = df.select(key, *features).unpivot([key], list(features), "feature", "value")
    fold = F.col("value") + F.lit(0.0) if dict(long.dtypes)["value"] in ("double", "float") else F.col("value")
    # the value as text, as Spark shuffles doubles once more where they are already together; +0.0 folds -0.0
    long, rows = long.withColumn("_v", fold.cast("string")), df.count() * len(features)
    on, present = ["feature", "_v"], long.where("value IS NOT NULL")
    counts = stage(spread(present, rows, *on).groupBy(*on).agg(F.max("value").alias("value"), F.count("*").alias("c")))
    ranks = order.cumulative_counts(counts, ["feature"], "value")
    ranks = stage(ranks.select(*on, "c", (F.col("cum") - (F.col("c") - 1) / 2).alias("rank")))
    often = F.col("c") >= max(FREQUENT, rows // MOST_FREQUENT)
    heavy, light = F.broadcast(ranks.where(often).drop("c")), ranks.where(~often).drop("c")
    rare = spread(present.join(heavy.select(*on), on, "left_anti"), rows, *on).join(light, on)
    lost = long.where("value IS NULL").withColumn("rank", F.lit(None).cast("double"))
    ranked = present.join(heavy, on).unionByName(rare).unionByName(lost).select(key, "feature", "rank")
    return spread(ranked, rows, key).groupBy(key).agg(*[F.max(F.when(F.col("feature") == f, F.col("rank"))).alias(f) for f in features])


def spearman_pairs(df: DataFrame, key: str, features) -> DataFrame:
    """Spearman over complete columns: rank once, then one pair aggregate."""
    return pair_moments(ranked_wide(df, key, features), features)


def spearman_pairwise(df: DataFrame, features, min_periods: int = 20) -> DataFrame:
    """Pairwise-complete Spearman: both members are ranked again inside every pair.

    Rows are reduced to distinct (pair, x, y) counts before ranking.
    """
    st = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
          for a, b in combinations(features, 2)]
    xy = (df.select(F.explode(F.array(*st)).alias("s")).select("s.*").where("x IS NOT NULL AND y IS NOT NULL")
          .groupBy("a", "b", "x", "y").agg(F.count("*").alias("c_xy")))

    def ranks(v):
        c = xy.groupBy("a", "b", v).agg(F.sum("c_xy").alias("c"))
        t = order.cumulative_counts(c, ["a", "b"], v)
        return t.select("a", "b", v, (F.col("cum") - (F.col("c") - 1) / 2 - (F.col("n") + 1) / 2).alias("r" + v))

    j = xy.join(ranks("x"), ["a", "b", "x"]).join(ranks("y"), ["a", "b", "y"])
    w = F.col("c_xy")
    g = j.groupBy("a", "b").agg(F.sum(w).alias("n"), F.sum(w * F.col("rx") * F.col("ry")).alias("sxy"),
                                F.sum(w * F.col("rx") * F.col("rx")).alias("sxx"), F.sum(w * F.col("ry") * F.col("ry")).alias("syy"))
    rho = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    return g.select("a", "b", "n", F.when(F.col("n") >= min_periods, rho).alias("r"))


def redundant_pairs(pairs: DataFrame, limit: float = 0.80) -> DataFrame:
    return pairs.where(F.abs("r") >= limit).orderBy(F.abs("r").desc(), "a", "b")


def max_partner(pairs: DataFrame) -> DataFrame:
    """Most correlated partner of each feature, smallest name on ties."""
    both = pairs.select("a", "b", "r").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    best = both.where(F.col("r").isNotNull()).groupBy("a").agg(F.min_by(F.struct("b", "r"), F.struct(-F.abs("r"), F.col("b"))).alias("m"))
    return best.select(F.col("a").alias("feature"), F.col("m.b").alias("partner"), F.col("m.r").alias("r"))


def greedy_nonredundant(pairs: DataFrame, priority: DataFrame, limit: float = 0.80) -> DataFrame:
    """Walk features by priority; drop one when it correlates at or above the limit with a kept one.

    Works on the pair table (p x p rows, p features), which is a result of fixed size in the data.
    """
    def walk(pdf: pd.DataFrame, prio: pd.DataFrame) -> pd.DataFrame:
        names = list(prio.sort_values(["priority", "feature"])["feature"])
        at = {f: i for i, f in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for a, b, r in zip(pdf["a"], pdf["b"], pdf["r"]):
            m[at[a], at[b]] = m[at[b], at[a]] = 0.0 if r is None or np.isnan(r) else abs(r)
        kept, rep = [], []
        for i in range(len(names)):
            clash = [j for j in kept if m[i, j] >= limit]
            rep.append(names[max(clash, key=lambda j: m[i, j])] if clash else names[i])
            if not clash:
                kept.append(i)
        return pd.DataFrame({"feature": names, "kept": [r == f for r, f in zip(rep, names)], "representative": rep})

    one = F.lit(1)
    return (pairs.withColumn("g", one).groupBy("g").cogroup(priority.withColumn("g", one).groupBy("g"))
            .applyInPandas(walk, "feature string, kept boolean, representative string"))


def recompute_compare(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Spearman, median ratio, median absolute relative error of a recomputed column."""
    rho = spearman_pairs(df, key, [old, new]).select("n", F.col("r").alias("spearman"))
    one = df.select(F.lit("x").alias("m"), F.try_divide(F.col(new), F.col(old)).alias("ratio"),
                    F.try_divide(F.abs(F.col(new) - F.col(old)), F.abs(old)).alias("rel"))
    long = one.unpivot(["m"], ["ratio", "rel"], "feature", "value")
    med = order.quantiles(long, ["feature"], "value", {"q": .5})
    wide = med.agg(F.max(F.when(F.col("feature") == "ratio", F.col("q"))).alias("median_ratio"),
                   F.max(F.when(F.col("feature") == "rel", F.col("q"))).alias("median_abs_rel_error"))
    return rho.withColumn("g", F.lit(1)).join(wide.withColumn("g", F.lit(1)), "g").drop("g")

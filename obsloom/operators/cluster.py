"""Clustering on Spark: ml estimators, Ward over weighted micro-clusters, modularity on edges."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import cut


def _features(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("_f", array_to_vector(F.col(vec)))


def kmeans(df: DataFrame, vec: str, k: int, seed: int = 1, restarts: int = 20, max_iter: int = 50, out: str = "cluster"):
    """Best of several seeded runs by training cost; (assigned frame, centers, cost)."""
    x = _features(df.select(vec), vec).select("_f").persist()
    best = None
    for r in range(restarts):
        m = KMeans(k=k, seed=seed + r, maxIter=max_iter, featuresCol="_f", predictionCol=out).fit(x)
        if best is None or m.summary.trainingCost < best.summary.trainingCost:
            best = m
    x.unpersist()
    return (best.transform(_features(df, vec)).drop("_f").withColumn(out, F.col(out).cast("long")),
            np.array(best.clusterCenters()), best.summary.trainingCost)


def gmm(df: DataFrame, vec: str, k: int, seed: int = 1, restarts: int = 5, out: str = "cluster"):
    """Full-covariance mixture, best log-likelihood over restarts."""
    x = _features(df.select(vec), vec).select("_f").persist()
    fits = [GaussianMixture(k=k, seed=seed + r, featuresCol="_f", predictionCol=out).fit(x) for r in range(restarts)]
    x.unpersist()
    best = max(fits, key=lambda m: m.summary.logLikelihood)
    return best.transform(_features(df, vec)).drop("_f", "probability").withColumn(out, F.col(out).cast("long")), best


def spectral(neigh: DataFrame, id_col: str, k: int, max_iter: int = 30) -> DataFrame:
    """Power iteration clustering of the symmetric neighbour graph (BIGINT ids)."""
    e = neigh.select(F.least(id_col, "nbr").alias("src"), F.greatest(id_col, "nbr").alias("dst")).distinct().withColumn("w", F.lit(1.0))
    pic = PowerIterationClustering(k=k, maxIter=max_iter, initMode="degree", srcCol="src", dstCol="dst", weightCol="w")
    return pic.assignClusters(e).select(F.col("id").alias(id_col), F.col("cluster").cast("long").alias("cluster"))


# ---- Ward ------------------------------------------------------------------------------------

def micro_clusters(df: DataFrame, id_col: str, vec: str, budget: int = 2000, seed: int = 1):
    """(id -> micro, centroids, sizes). Distinct vectors themselves while they fit the budget."""
    distinct = df.groupBy(vec).agg(F.count("*").alias("n"))
    if distinct.count() <= budget:
        rows = distinct.orderBy(vec).collect()
        table = df.sparkSession.createDataFrame([(r[vec], i) for i, r in enumerate(rows)], f"{vec} array<double>, micro long")
        mapped = df.join(table, vec).select(id_col, vec, "micro")
        return mapped, np.array([r[vec] for r in rows], float), np.array([r["n"] for r in rows], float)
    mapped, _, _ = kmeans(df.select(id_col, vec), vec, budget, seed, restarts=1, max_iter=8, out="micro")
    p = len(df.select(vec).first()[0])
    stats = mapped.groupBy("micro").agg(F.count("*").alias("n"), F.array(*[F.avg(F.col(vec)[j]) for j in range(p)]).alias("c")).orderBy("micro").collect()
    at = df.sparkSession.createDataFrame([(int(r["micro"]), i) for i, r in enumerate(stats)], "micro long, pos long")
    mapped = mapped.join(at, "micro").select(id_col, vec, F.col("pos").alias("micro"))
    return mapped, np.array([r["c"] for r in stats], float), np.array([r["n"] for r in stats], float)


def ward_merges(centers: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    """Weighted Ward tree by the nearest-neighbour chain; heights on the distance scale."""
    m = len(sizes)
    c, n = centers.astype(float).copy(), sizes.astype(float).copy()
    node, alive = np.arange(m), np.ones(m, bool)
    merges, chain = [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        i = chain[-1]
        d = ((c - c[i]) ** 2).sum(1) * (2 * n * n[i] / (n + n[i]))
        d[~alive] = np.inf
        d[i] = np.inf
        j = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[j]:
            j = chain[-2]
            chain = chain[:-2]
            merges.append((i, j, float(np.sqrt(d[j])), n[i] + n[j]))
            c[i] = (c[i] * n[i] + c[j] * n[j]) / (n[i] + n[j])
            n[i] += n[j]
            alive[j] = False
        else:
            chain.append(j)
    order = sorted(range(len(merges)), key=lambda t: merges[t][2])
    parent, label, rows = list(range(m)), list(range(m)), []

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for step, t in enumerate(order):
        i, j, h, size = merges[t]
        a, b = find(i), find(j)
        rows.append((m + step, min(label[a], label[b]), max(label[a], label[b]), h, size))
        parent[b] = a
        label[a] = m + step
    return pd.DataFrame(rows, columns=["node", "left", "right", "height", "n"])


def leaves_under(merges: pd.DataFrame, m: int) -> dict[int, list[int]]:
    under = {i: [i] for i in range(m)}
    for r in merges.itertuples():
        under[r.node] = under[r.left] + under[r.right]
    return under


def cut_tree(merges: pd.DataFrame, m: int, k: int) -> np.ndarray:
    """Micro-cluster -> cluster after undoing the last k - 1 merges; clusters numbered in leaf order."""
    under = leaves_under(merges, m)
    top = set(merges["node"][: max(0, m - k)]) | set(range(m))
    for r in merges.iloc[: max(0, m - k)].itertuples():
        top -= {r.left, r.right}
    order = {leaf: i for i, leaf in enumerate(leaf_sequence(merges, m))}
    label = np.zeros(m, int)
    for c, t in enumerate(sorted(top, key=lambda t: min(order[x] for x in under[t]))):
        label[under[t]] = c + 1
    return label


def leaf_sequence(merges: pd.DataFrame, m: int) -> list[int]:
    return leaves_under(merges, m)[int(merges["node"].iloc[-1])] if len(merges) else list(range(m))


def ward(df: DataFrame, id_col: str, vec: str, k: int, budget: int = 2000):
    """(id, cluster) and the merge table. Equal to exact Ward while distinct rows fit the budget."""
    mapped, centers, sizes = micro_clusters(df, id_col, vec, budget)
    merges = ward_merges(centers, sizes)
    lab = cut_tree(merges, len(sizes), k)
    t = df.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(lab)], "micro long, cluster long")
    return mapped.join(t, "micro").select(id_col, "micro", "cluster"), merges, sizes


def tree_topology(merges: pd.DataFrame, sizes: np.ndarray, k: int) -> pd.DataFrame:
    """Internal nodes that separate the final k classes: parent, depth, class sets, sizes, height."""
    m = len(sizes)
    label, under = cut_tree(merges, m, k), leaves_under(merges, m)
    top = merges.iloc[max(0, m - k):]
    parent = {int(c): int(r.node) for r in top.itertuples() for c in (r.left, r.right)}
    rows = []
    for r in top.iloc[::-1].itertuples():
        depth, x = 0, int(r.node)
        while x in parent:
            depth, x = depth + 1, parent[x]
        names = lambda t: ";".join(map(str, sorted(set(label[under[t]]))))
        rows.append((int(r.node), parent.get(int(r.node)), depth, names(r.left), names(r.right),
                     int(sizes[under[r.left]].sum()), int(sizes[under[r.right]].sum()), float(r.height)))
    return pd.DataFrame(rows, columns=["node", "parent", "depth", "left_classes", "right_classes", "n_left", "n_right", "height"])


# ---- modularity -------------------------------------------------------------------------------

def _move(edges: DataFrame, labels: DataFrame, degree: DataFrame, two_m: float, gamma: float, parity: int) -> DataFrame:
    """One synchronous pass over half of the nodes: each goes to the neighbouring community of best gain."""
    lab = labels.join(degree, "id")
    total = lab.groupBy("c").agg(F.sum("k").alias("tot"))
    into = (edges.where(F.col("src") != F.col("dst")).join(labels.select(F.col("id").alias("dst"), "c"), "dst")
            .groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("w")))
    stay = lab.select("id", "c").withColumn("w", F.lit(0.0))
    cand = into.unionByName(stay).groupBy("id", "c").agg(F.sum("w").alias("w")).join(
        lab.select("id", F.col("c").alias("own"), "k"), "id").join(total, "c")
    rest = F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(F.lit(0.0))
    cand = cand.withColumn("gain", F.col("w") - gamma * F.col("k") * rest / two_m)
    best = cand.groupBy("id").agg(F.max_by("c", F.struct("gain", -F.col("c"))).alias("to"), F.max("gain").alias("g"),
                                  F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("g0"), F.max("own").alias("own"))
    turn = F.pmod(F.hash("id", F.lit(parity // 2)), F.lit(2)) == parity % 2
    return best.select("id", F.when(turn & (F.col("g") > F.col("g0") + 1e-12), F.col("to")).otherwise(F.col("own")).alias("c"))


def modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> float:
    """Quality of a partition of a symmetric edge table (each edge stored both ways)."""
    l1 = labels.select(F.col("id").alias("src"), F.col("c").alias("cs"))
    l2 = labels.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
    j = edges.join(l1, "src").join(l2, "dst")
    tot = j.groupBy(F.col("cs")).agg(F.sum("w").alias("t"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inside"))
    r = tot.agg(F.sum("inside").alias("i"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum("t").alias("m")).first()
    return r["i"] / r["m"] - gamma * r["tt"] / r["m"] ** 2


def communities(edges: DataFrame, gamma: float = 1.0, rounds: int = 8, levels: int = 3) -> DataFrame:
    """Local moving by joins, then contraction, until quality stops growing; keeps the best partition seen.

    ``edges``: (src, dst, w) once per pair. Halves of the nodes move in turn so that two
    neighbours do not swap for ever. Each round is checkpointed.
    """
    sym = cut(edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    member = cut(sym.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id")))
    graph, two_m = sym, float(sym.agg(F.sum("w")).first()[0])
    best_q, best = modularity(sym, member, gamma), member
    for _ in range(levels):
        degree = cut(graph.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
        lab = degree.select("id", F.col("id").alias("c"))
        q_level, keep = modularity(graph, lab, gamma), lab
        for r in range(rounds):
            new = cut(_move(graph, lab, degree, two_m, gamma, r))
            q = modularity(graph, new, gamma)
            still = r % 2 == 1 and new.join(lab.withColumnRenamed("c", "c0"), "id").where("c != c0").isEmpty()
            lab = new
            if q > q_level:
                q_level, keep = q, new
            if still:
                break
        member = cut(member.join(keep.select(F.col("id").alias("c"), F.col("c").alias("c2")), "c").select("id", F.col("c2").alias("c")))
        if q_level <= best_q + 1e-9:
            break
        best_q, best = q_level, member
        graph = cut(graph.join(keep.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src")
                    .join(keep.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
                    .groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("w").alias("w")))
    return best.select("id", F.col("c").alias("community"))


# ---- quality of a partition ---------------------------------------------------------------------

def silhouette(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Per-row silhouette with squared Euclidean distances from cluster sums: rows x K, not rows squared."""
    p = len(df.select(vec).first()[0])
    st = df.groupBy(label).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(vec)[j]) for j in range(p)]).alias("s"),
                               F.sum(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x)).alias("q")).collect()
    names = [r[label] for r in st]
    n, s, q = np.array([r["n"] for r in st], float), np.array([r["s"] for r in st]), np.array([r["q"] for r in st])

    @F.pandas_udf("double")
    def score(v: pd.Series, c: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        x, own = np.stack(v.to_numpy()), np.array([names.index(i) for i in c])
        d = (x * x).sum(1)[:, None] - 2 * x @ (s / n[:, None]).T + (q / n)[None, :]
        rows = np.arange(len(x))
        a = d[rows, own] * n[own] / np.maximum(n[own] - 1, 1)
        d[rows, own] = np.inf
        b = d.min(1)
        return pd.Series(np.where(n[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0))

    return df.withColumn("silhouette", score(F.col(vec), F.col(label)))


def k_score(df: DataFrame, min_size: int = 8) -> DataFrame:
    """0.55 ARI + 0.35 smallest Jaccard + 0.10 rescaled silhouette; too small clusters are out."""
    s = 0.55 * F.col("ari") + 0.35 * F.col("min_jaccard") + 0.10 * (F.col("silhouette") + 1) / 2
    d = df.withColumn("score", F.when(F.col("min_size") >= min_size, s))
    return d.withColumn("chosen", F.coalesce((F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), "k")) == 1) & F.col("score").isNotNull(), F.lit(False)))

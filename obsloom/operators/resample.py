"""Repeats as a key column: draws by hash order, statistics from per-stratum sums."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import draw
from . import order
from .agreement import best_matching
from .cluster import cut_tree, ward_merges
from .linalg import decompose


def repeats(df: DataFrame, reps) -> DataFrame:
    return df.withColumn("rep", F.explode(F.array(*[F.lit(int(r)) for r in reps])))


def group_resample(df: DataFrame, stratum: str, reps, fraction: float, seed: int) -> DataFrame:
    """(rep, stratum): the first ceil(fraction x strata) strata of each repeat in hash order."""
    s = repeats(df.select(stratum).where(F.col(stratum).isNotNull()).distinct(), reps)
    pos = order.hash_rank(s, ["rep"], draw(seed, F.col("rep"), F.col(stratum)), stratum)
    return pos.where(F.col("pos") <= F.ceil(F.lit(fraction) * F.col("n") - 1e-9)).select("rep", stratum)


def micro_sums(df: DataFrame, vec: str, stratum: str, micro: str, label: str) -> DataFrame:
    """Counts, sums and square sums per (stratum, micro-cluster, label): all that repeats need."""
    p = len(df.select(vec).first()[0])
    return df.groupBy(stratum, micro, label).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(vec)[j]) for j in range(p)]).alias("s"))


def resample_stability(sums: DataFrame, stratum: str, picked: DataFrame, micro: str, label: str, n_pc: int, k: int) -> DataFrame:
    """Per repeat: standardise + PCA + Ward on the micro-cluster centroids of the drawn strata, against the label.

    Work per repeat depends on the number of micro-clusters (a fixed budget), not on rows.
    """
    j = sums.join(picked, stratum)
    p = len(sums.select("s").first()[0])
    cells = j.groupBy("rep", micro, label).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(p)]).alias("s"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.groupby(micro)
        n = g["n"].sum().to_numpy(float)
        c = np.stack([np.sum(np.stack(x.to_numpy()), 0) for _, x in g["s"]]) / n[:, None]
        mu = (c * n[:, None]).sum(0) / n.sum()
        m = decompose(n.sum(), mu, ((c - mu) * n[:, None]).T @ (c - mu), True, 1)
        x = ((c - mu) / m.scale) @ m.loadings[:, :n_pc]
        lab = cut_tree(ward_merges(x, n), len(n), min(k, len(n)))
        at = dict(zip(g.groups.keys(), lab))
        t = pdf.assign(c=pdf[micro].map(at)).pivot_table(index="c", columns=label, values="n", aggfunc="sum", fill_value=0).to_numpy(float)
        pairs = lambda v: (v * (v - 1) / 2).sum()
        e = pairs(t.sum(1)) * pairs(t.sum(0)) / pairs(np.array([t.sum()]))
        top = (pairs(t.sum(1)) + pairs(t.sum(0))) / 2
        ari = (pairs(t.ravel()) - e) / (top - e) if top > e else 1.0
        tt = t if t.shape[0] <= t.shape[1] else t.T
        acc = sum(tt[i, j] for i, j in enumerate(best_matching(tt)) if j < tt.shape[1]) / t.sum()
        return pd.DataFrame([(int(pdf["rep"].iloc[0]), int(t.sum()), float(ari), float(acc), int(t.sum(1).min()))],
                            columns=["rep", "n", "ari", "mapped_accuracy", "min_size"])

    return cells.groupBy("rep").applyInPandas(run, "rep long, n long, ari double, mapped_accuracy double, min_size long")


def bootstrap_weights(df: DataFrame, stratum: str, reps, seed: int) -> DataFrame:
    """(rep, stratum, w): how often each stratum is drawn when as many strata are drawn with replacement.

    The draw index hashes to a position in the ordered stratum list, so weights are exact counts.
    """
    s = df.select(stratum).where(F.col(stratum).isNotNull()).distinct().withColumn("c", F.lit(1).cast("long"))
    listed = order.cumulative_counts(s, [], stratum).select(stratum, F.col("cum").alias("pos"), F.col("n").alias("g"))
    draws = repeats(listed.select(F.col("pos").alias("i"), "g"), reps)
    h = F.conv(F.substring(draw(seed, F.col("rep"), F.col("i")), 1, 8), 16, 10).cast("long")
    return draws.select("rep", (h % F.col("g") + 1).alias("pos")).join(listed.select(stratum, "pos"), "pos").groupBy("rep", stratum).agg(F.count("*").alias("w"))

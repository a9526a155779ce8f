"""Contingency tables: chi-square, Cramer's V and stratified permutation nulls."""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import draw
from ..runtime import stage
from . import order


def cell_counts(df: DataFrame, a: str, b: str, keys=()) -> DataFrame:
    return df.groupBy(*keys, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n_ab"))


def chi_square(cells: DataFrame, keys=()) -> DataFrame:
    """Chi-square without continuity correction, V, bias-corrected V, expected counts below 5.

    Sum over present cells of o^2 / e, minus n, covers absent cells as well; margins are windows
    over the cell table, so the rows behind it are read once.
    """
    keys = list(keys)
    k = keys or ["_k"]
    c = cells if keys else cells.withColumn("_k", F.lit(1))
    c = c.withColumn("n_a", F.sum("n_ab").over(Window.partitionBy(*k, "a"))).withColumn("n_b", F.sum("n_ab").over(Window.partitionBy(*k, "b")))
    s = c.groupBy(*k).agg(F.sum("n_ab").alias("n"), F.sum(F.col("n_ab").cast("double") * F.col("n_ab") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("_s"),
                          F.collect_set(F.struct("a", "n_a")).alias("_a"), F.collect_set(F.struct("b", "n_b")).alias("_b"))
    low = F.aggregate("_a", F.lit(0).cast("long"), lambda t, x: t + F.size(F.filter(
        "_b", lambda y: x["n_a"].cast("double") * y["n_b"] / F.col("n") < 5)))
    s = s.select(*k, "n", F.size("_a").cast("long").alias("r"), F.size("_b").cast("long").alias("c"),
                 F.greatest(F.col("n") * F.col("_s") - F.col("n"), F.lit(0.0)).alias("chi2"), low.alias("n_low_expected"))
    n, r, q = F.col("n").cast("double"), F.col("r"), F.col("c")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (q - 1) * (r - 1) / (n - 1))
    rc, qc = r - (r - 1) * (r - 1) / (n - 1), q - (q - 1) * (q - 1) / (n - 1)
    out = (s.withColumn("df", (r - 1) * (q - 1)).withColumn("v", F.sqrt(F.try_divide(F.col("chi2") / n, F.least(r, q) - 1)))
           .withColumn("v_corrected", F.sqrt(F.try_divide(phi, F.least(rc, qc) - 1))))
    return out if keys else out.drop("_k")


def permuted_labels(df: DataFrame, id_col: str, label: str, stratum: str, reps, seed: int) -> DataFrame:
    """(rep, id, permuted label): labels re-dealt inside each stratum, one plan for all repeats.

    Linear in rows x repeats; call with slices of ``reps`` to bound one job.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(stratum).alias("stratum"))
    dealt = order.cumulative_counts(base.withColumn("c", F.lit(1).cast("long")), ["stratum"], "id").select(
        "stratum", F.col("cum").alias("pos"), "label")
    many = base.select("id", "stratum").withColumn("rep", F.explode(F.array(*[F.lit(int(r)) for r in reps])))
    pos = order.hash_rank(many, ["rep", "stratum"], draw(seed, F.col("rep"), F.col("id")), "id").select("rep", "id", "stratum", "pos")
    return pos.join(dealt, ["stratum", "pos"]).select("rep", "id", F.col("label").alias("permuted"))


def summarise_null(null: DataFrame, observed: DataFrame, stat: str = "v") -> DataFrame:
    """Empirical p with the +1 rule, and quantiles of the null (one row per repeat)."""
    one = stage(null.select(F.lit(1).alias("_g"), stat))
    q = order.quantiles(one, ["_g"], stat, {"null_median": .5, "null_q025": .025, "null_q975": .975})
    obs = observed.select(F.lit(1).alias("_g"), F.col(stat).alias("observed"))
    p = one.join(obs, "_g").groupBy("_g", "observed").agg(
        F.count("*").alias("n_rep"), ((1 + F.count_if(F.col(stat) >= F.col("observed") - 1e-12)) / (F.count("*") + 1)).alias("p"))
    return p.join(q, "_g").drop("_g")


def permuted_cells(cells: DataFrame, stratum: str, n_reps: int, seed: int) -> DataFrame:
    """Null tables drawn directly as counts: with fixed margins inside each stratum the re-dealt
    table is multivariate hypergeometric, so the cost does not depend on the number of rows.

    ``cells`` has (stratum, a, b, n_ab); returns (rep, a, b, n_ab) summed over strata.
    """
    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        name = str(pdf[stratum].iloc[0])
        t = pdf.pivot_table(index="a", columns="b", values="n_ab", fill_value=0, aggfunc="sum")
        cols, rows = t.sum(0).to_numpy().astype(int), t.sum(1).to_numpy().astype(int)
        out = []
        for rep in range(n_reps):
            rng = np.random.default_rng(int(hashlib.md5(f"{seed}|{rep}|{name}".encode()).hexdigest()[:16], 16))
            left = cols.copy()
            for a, n in zip(t.index, rows):
                got = rng.multivariate_hypergeometric(left, n, method="marginals")
                left = left - got
                out += [(rep, a, b, int(v)) for b, v in zip(t.columns, got) if v]
        return pd.DataFrame(out, columns=["rep", "a", "b", "n_ab"])

    return (cells.groupBy(stratum).applyInPandas(deal, "rep long, a string, b string, n_ab long")
            .groupBy("rep", "a", "b").agg(F.sum("n_ab").alias("n_ab")))


def rank_anova(cells: DataFrame, a: str = "a", b: str = "b", key: str = "feature") -> DataFrame:
    """Type II sums of squares of ranks on two factors from cell counts, sums and square sums.

    ``cells``: (key, a, b, n, s, q). Each key is solved on its table of factor levels only.
    """
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = pdf["n"].to_numpy(float), pdf["s"].to_numpy(float)
        mean, within = s / n, float(pdf["q"].sum() - (s * s / n).sum())
        da, db = (pd.get_dummies(pdf[c], drop_first=True).to_numpy(float) for c in (a, b))
        one = np.ones((len(pdf), 1))

        def rss(*parts):
            x = np.hstack([one, *parts])
            w = np.sqrt(n)[:, None]
            beta = np.linalg.lstsq(x * w, mean * w[:, 0], rcond=None)[0]
            return float((n * (mean - x @ beta) ** 2).sum()) + within, np.linalg.matrix_rank(x)

        full, rank = rss(da, db)
        df_res = n.sum() - rank
        rows = []
        for term, reduced in ((a, rss(db)), (b, rss(da))):
            ss, df = reduced[0] - full, rank - reduced[1]
            rows.append((pdf[key].iloc[0], term, ss, df, df_res, (ss / df) / (full / df_res), ss / (ss + full)))
        return pd.DataFrame(rows, columns=[key, "term", "ss", "df", "df_res", "f", "partial_eta2"])

    return cells.groupBy(key).applyInPandas(
        solve, f"{key} string, term string, ss double, df double, df_res double, f double, partial_eta2 double")

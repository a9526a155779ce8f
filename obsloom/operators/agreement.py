"""Agreement of labelings; every metric comes from one contingency table per key."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def contingency(df: DataFrame, a: str, b: str, keys=()) -> DataFrame:
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(*keys, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").cast("double").alias("n_ab")))


def agreement(cells: DataFrame, keys=()) -> DataFrame:
    """n, ARI, NMI (geometric and arithmetic), purity both ways.

    Margins are windows over the contingency table; the first cell of each margin carries its
    term, so one aggregate per key yields every sum. H = ln n - sum(m ln m) / n.
    """
    keys = list(keys)
    k = keys or ["_k"]
    c = cells if keys else cells.withColumn("_k", F.lit(1))
    pairs = lambda x: x * (x - 1) / 2
    sums = [F.sum("n_ab").alias("n"), F.sum(pairs(F.col("n_ab"))).alias("s_ab"), F.sum(F.col("n_ab") * F.log("n_ab")).alias("l_ab")]
    for s, o in (("a", "b"), ("b", "a")):
        w = Window.partitionBy(*k, s)
        c = (c.withColumn("m_" + s, F.sum("n_ab").over(w)).withColumn("t_" + s, F.max("n_ab").over(w))
             .withColumn("f_" + s, F.row_number().over(w.orderBy(o)) == 1))
        m, first = F.col("m_" + s), F.col("f_" + s)
        sums += [F.sum(F.when(first, pairs(m))).alias("s_" + s), F.sum(F.when(first, m * F.log(m))).alias("l_" + s),
                 F.sum(F.when(first, F.col("t_" + s))).alias("top_" + s)]
    out = c.groupBy(*k).agg(*sums)
    n = F.col("n")
    h = {s: F.log(n) - F.col("l_" + s) / n for s in ("a", "b", "ab")}
    out = out.select(*k, n, "s_ab", "s_a", "s_b", *[h[s].alias("h_" + s) for s in h], (F.col("top_a") / n).alias("purity_a"), (F.col("top_b") / n).alias("purity_b"))
    expected = F.try_divide(F.col("s_a") * F.col("s_b"), pairs(n))
    ari = F.try_divide(F.col("s_ab") - expected, (F.col("s_a") + F.col("s_b")) / 2 - expected)
    mi = F.greatest(F.col("h_a") + F.col("h_b") - F.col("h_ab"), F.lit(0.0))
    return out.select(*keys, n.cast("long").alias("n"), F.coalesce(ari, F.lit(1.0)).alias("ari"),
                      F.coalesce(F.try_divide(mi, F.sqrt(F.col("h_a") * F.col("h_b"))), F.lit(1.0)).alias("nmi_sqrt"),
                      F.coalesce(F.try_divide(2 * mi, F.col("h_a") + F.col("h_b")), F.lit(1.0)).alias("nmi_mean"), "purity_a", "purity_b")


def overlap_map(cells: DataFrame, keys=()) -> DataFrame:
    """Each raw cluster ``a`` to the reference class ``b`` of largest overlap, smallest class on ties."""
    return cells.groupBy(*keys, "a").agg(F.min_by("b", F.struct(-F.col("n_ab"), F.col("b"))).alias("merged"))


def best_matching(table: np.ndarray) -> list[int]:
    """Column chosen for each row so that the matched total is largest.

    Shortest augmenting paths over row and column prices, O(K^3). With fewer columns than rows
    some rows get a column beyond the table.
    """
    r, c = table.shape
    cost = np.hstack([-table, np.zeros((r, max(0, r - c)))])
    width = cost.shape[1]
    row_price, col_price = np.zeros(r), np.zeros(width)
    owner = np.full(width, -1)  # row that holds a column
    for row in range(r):
        dist, back, done = cost[row] - row_price[row] - col_price, np.full(width, -1), np.zeros(width, bool)
        while True:
            j = int(np.where(done, np.inf, dist).argmin())
            done[j] = True
            if owner[j] < 0:
                break
            through = dist[j] + cost[owner[j]] - row_price[owner[j]] - col_price
            closer = ~done & (through < dist)
            dist[closer], back[closer] = through[closer], j
        end = dist[j]
        for k in np.flatnonzero(done):
            if owner[k] >= 0:
                row_price[owner[k]] += end - dist[k]
            col_price[k] -= end - dist[k]
        row_price[row] += end
        while back[j] >= 0:
            owner[j] = owner[back[j]]
            j = back[j]
        owner[j] = row
    return [int(np.flatnonzero(owner == i)[0]) for i in range(r)]


def optimal_matching(cells: DataFrame, keys=(), by: str = "overlap") -> DataFrame:
    """One-to-one map a -> b per key with the per-pair overlap and Jaccard (K x K table per key).

    ``by`` names what the map maximises in total: the ``overlap`` or the ``jaccard`` of the pairs.
    """
    keys = list(keys) or ["_k"]
    c = cells if keys != ["_k"] else cells.withColumn("_k", F.lit(1))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.pivot_table(index="a", columns="b", values="n_ab", fill_value=0.0, aggfunc="sum")
        n = t.to_numpy(float)
        jac = n / (n.sum(1)[:, None] + n.sum(0)[None, :] - n)
        score = jac if by == "jaccard" else n
        pairs = [(i, j) for i, j in enumerate(best_matching(score)) if j < n.shape[1]]
        rows = [[pdf[k].iloc[0] for k in keys] + [t.index[i], t.columns[j], n[i, j], jac[i, j], n[i, j] / n.sum()] for i, j in pairs]
        return pd.DataFrame(rows, columns=keys + ["a", "b", "n_match", "jaccard", "share"])

    types = dict(c.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["a string", "b string", "n_match double", "jaccard double", "share double"])
    out = c.groupBy(*keys).applyInPandas(match, schema)
    return out.drop("_k") if keys == ["_k"] else out


def relabel_by(df: DataFrame, label: str, medians: DataFrame, value: str, out: str = "ordered") -> DataFrame:
    """Cluster numbers 1..K by ascending statistic (``medians`` has one row per cluster)."""
    o = medians.select(label, F.row_number().over(Window.orderBy(value, label)).cast("long").alias(out))
    return df.join(o, label)


def stack_runs(runs: dict, id_col: str, label: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("run"), id_col, F.col(label).cast("string").alias("label")) for n, d in runs.items()])


def run_pairs(runs: DataFrame, id_col: str, names) -> DataFrame:
    """Contingency for every pair of runs. Labels of a row are put side by side first, so pairs are
    made inside a row (runs x runs), never between rows."""
    names = list(names)
    wide = runs.groupBy(id_col).pivot("run", names).agg(F.first("label"))
    pairs = [F.struct(F.lit(x).alias("run_a"), F.lit(y).alias("run_b"), F.col(x).alias("la"), F.col(y).alias("lb"))
             for i, x in enumerate(names) for y in names[i + 1:]]
    p = wide.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")
    return contingency(p, "la", "lb", ["run_a", "run_b"])


# ---- co-clustering over repeats ------------------------------------------------------------

def coclustering(pairs: DataFrame, assign: DataFrame) -> DataFrame:
    """n_seen, n_together and their ratio for a given pair table (i, j) over (rep, id, cluster).

    Both sides join by id, so the work is pairs x repeats; no pair is made from a cluster.
    """
    a = assign.select(F.col("id").alias("i"), "rep", F.col("cluster").alias("ci"))
    b = assign.select(F.col("id").alias("j"), "rep", F.col("cluster").alias("cj"))
    t = pairs.select("i", "j").join(a, "i").join(b, ["j", "rep"])
    return t.groupBy("i", "j").agg(F.count("*").alias("n_seen"), F.count_if(F.col("ci") == F.col("cj")).alias("n_together")) \
        .withColumn("share", F.col("n_together") / F.col("n_seen"))


def stability_margin(assign: DataFrame, rows: DataFrame) -> DataFrame:
    """Mean co-clustering with the own class minus the best other class, per row, without pairs.

    ``rows``: (id, class, stratum); ``assign``: (rep, id, cluster), where a repeat sees whole
    strata. How often two rows are seen together then depends on their strata only, so the sum over
    partners folds into counts by (rep, cluster, class, stratum). Exact.
    """
    j = assign.join(rows, "id")
    cells = j.groupBy("rep", "cluster", "class", "stratum").agg(F.count("*").alias("m"))
    seen = j.select("rep", "stratum").distinct()
    together = seen.join(seen.withColumnRenamed("stratum", "other"), "rep").groupBy("stratum", "other").agg(F.count("*").alias("n_seen"))
    weight = (cells.select("rep", "cluster", F.col("class").alias("partner"), F.col("stratum").alias("other"), "m").join(together, "other")
              .groupBy("rep", "cluster", "stratum", "partner").agg(F.sum(F.col("m") / F.col("n_seen")).alias("w")))
    # partners that are ever seen with a stratum, counted once
    size = rows.groupBy(F.col("class").alias("partner"), F.col("stratum").alias("other")).agg(F.count("*").alias("m")).join(
        together, "other").groupBy("stratum", "partner").agg(F.sum("m").alias("n_partners"))
    got = j.join(weight, ["rep", "cluster", "stratum"]).groupBy("id", "class", "stratum", "partner").agg(F.sum("w").alias("s"))
    # the row itself is always in its own cluster and adds exactly 1 to its own class
    own = F.col("class") == F.col("partner")
    full = rows.join(size, "stratum").join(got.select("id", "partner", "s"), ["id", "partner"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    mean = F.try_divide(F.col("s") - own.cast("double"), F.col("n_partners") - own.cast("double"))
    out = full.withColumn("mean", mean).groupBy("id", "class").agg(F.max(F.when(own, F.col("mean"))).alias("same"), F.max(F.when(~own, F.col("mean"))).alias("other"))
    return (out.withColumn("margin", F.col("same") - F.col("other")).withColumn(
        "risk", F.when(F.col("margin") <= 0, "high").when(F.col("margin") < 0.10, "watch").otherwise("ok")))

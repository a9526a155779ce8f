"""Clusterings of all repeats in shared passes against one fit at a time."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from obsloom.operators import batched as B

KS, REPEATS = [2, 3], 3


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(3)
    group = rng.integers(0, 3, 240)
    x = rng.normal(size=(240, 4)) + 6 * np.eye(4)[group]
    stratum = np.arange(240) % 6
    rows = [(i, x[i].tolist(), f"s{stratum[i]}") for i in range(240)] + [(240, None, "s0"), (241, x[0].tolist(), None)]
    df = spark.createDataFrame(rows, "obs long, vec array<double>, place string").repartition(5)
    weight = np.array([[1, 2, 0, 1, 1, 1], [0, 1, 1, 3, 0, 1], [2, 2, 2, 0, 0, 0]])
    picked = spark.createDataFrame([(r, f"s{s}", int(weight[r, s])) for r in range(REPEATS) for s in range(6) if weight[r, s]], "rep int, place string, w int")
    full = np.vstack([x, x[:1]])
    per_row = [np.append(weight[r][stratum], 0) for r in range(REPEATS)] + [np.ones(241, int)]
    return df, picked, full, per_row, B.resamples(df, "obs", "vec", "place", picked, REPEATS, 2)


def direct(x, w, n_pc=2):
    rep = np.repeat(x, w, axis=0)
    sd = rep.std(0, ddof=1)
    val, vec = np.linalg.eigh(np.cov((rep / sd).T))
    vec = vec[:, np.argsort(val)[::-1][:n_pc]]
    vec *= np.sign(vec[np.abs(vec).argmax(0), range(n_pc)])
    return (rep - rep.mean(0)) / sd @ vec


def test_components_of_each_repeat(case):
    _, _, x, w, data = case
    for r in range(REPEATS + 1):
        got = (np.repeat(x, w[r], axis=0) - data.mean[r]) @ data.load[r]
        assert np.allclose(got, direct(x, w[r]))


def test_kmeans_equals_single_fits(case):
    _, _, x, w, data = case
    first = B.seeds(data, 3, 2, 7)
    fits = B.kmeans(data, KS, 2, 7, tol=0.0)
    for r in range(REPEATS + 1):
        y = direct(x, w[r])
        for k in KS:
            best = None
            for s in range(2):
                c = first[r, s, :k]
                assert all(np.abs(y - row).sum(1).min() < 1e-9 for row in c)  # seeds are drawn rows
                for _ in range(100):
                    lab = ((y[:, None] - c) ** 2).sum(2).argmin(1)
                    c = np.array([y[lab == i].mean(0) if (lab == i).any() else c[i] for i in range(k)])
                cost = ((y - c[lab]) ** 2).sum()
                if best is None or cost < best[0] - 1e-9:
                    best = cost, c
            got, settled = fits[r, k]
            assert settled and np.allclose(got, best[1])


def test_mixture_step_equals_direct(case):
    _, _, x, w, data = case
    begun = B.kmeans(data, KS, 2, 7)
    fits = B.mixtures(data, begun, most=3, tol=0.0)
    for r in (0, REPEATS):
        y = direct(x, w[r])
        for k in KS:
            c = begun[r, k][0]
            resp = np.eye(k)[((y[:, None] - c) ** 2).sum(2).argmin(1)]
            for step in range(4):
                n = resp.sum(0)
                mean = resp.T @ y / n[:, None]
                cov = [(resp[:, i, None] * (y - mean[i])).T @ (y - mean[i]) / n[i] + 1e-5 * np.eye(2) for i in range(k)]
                dens = np.column_stack([n[i] / n.sum() * np.exp(-0.5 * np.einsum("nd,de,ne->n", y - mean[i], np.linalg.inv(cov[i]), y - mean[i]))
                                        / np.sqrt(np.linalg.det(2 * np.pi * cov[i])) for i in range(k)])
                resp = dens / dens.sum(1, keepdims=True)
            assert np.allclose(fits[r, k][1], mean) and np.allclose(fits[r, k][2], np.array(cov))


def test_stability_finds_planted_groups(spark, case):
    df, picked, x, w, data = case
    out = B.stability(df, "obs", "vec", "place", picked, REPEATS, [2, 3, 4], n_pc=2).toPandas()
    assert len(out) == 2 * REPEATS * 3
    three = out[out.k == 3]
    assert (three.ari > 0.97).all() and (three.min_jaccard > 0.95).all() and (three.mapped_accuracy > 0.98).all() and three.settled.all()
    assert sorted(set(three.n)) == sorted({int((w[r] > 0).sum()) for r in range(REPEATS)})
    assert (out.min_jaccard <= out.mean_jaccard + 1e-12).all()


def test_equal_rows_and_empty_repeats(spark):
    same = spark.range(20).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"), (F.col("id") % 2).alias("s"))
    picked = spark.createDataFrame([(0, 0, 1)], "rep int, s long, w int")
    out = B.stability(same, "id", "v", "s", picked, 1, [2], n_pc=1).toPandas()
    assert (out.n == 10).all() and (out.ari == 1).all()
    with pytest.raises(ValueError):
        B.resamples(same, "id", "v", "s", picked, 2, 1)


def test_few_rows_are_many_parts(case):
    """A small table is shared out too, as every row meets every repeat."""
    assert len(case[4].rows.inputFiles()) > 20


def test_sums_with_ties_and_mixed_numbers_of_clusters(case):
    """Fits of several sizes in one pass; a row between equal centres counts once, for the first."""
    _, _, x, w, data = case
    c = np.array([[0.5, -1.0], [2.0, 0.0]])
    fits = {(r, k): B.centre_scores(np.vstack([c] * k)[:k]) for r in range(REPEATS) for k in (1, 2, 4)}
    got = B._sums(data, fits, True)
    for (r, k), sums in got.items():
        y = (x - data.mean[r]) @ data.load[r]
        lab = ((y[:, None] - np.vstack([c] * k)[:k]) ** 2).sum(2).round(9).argmin(1)
        assert sums.shape == (k + 1, 6) and np.allclose(sums[:-1, 0], np.bincount(lab, weights=w[r], minlength=k))
        assert np.allclose(sums[:-1, 1:3], [w[r][lab == i] @ y[lab == i] for i in range(k)])


def test_first_order_sums_equal_the_full_ones(case):
    """Without products a pass gives the same counts and sums by cluster, and the squares of all drawn rows; rows that a repeat leaves out and ties included."""
    data = case[-1]
    rng = np.random.default_rng(6)
    fits = {(r, k): B.centre_scores(np.vstack([rng.normal(size=(k, 2)), np.zeros((2, 2))])) for r in range(REPEATS) for k in (1, 3)}
    full, first = B._sums(data, fits, True), B._sums(data, fits, True, products=False)
    for f in fits:
        assert np.allclose(first[f][:-1], full[f][:-1, :3], rtol=1e-12, atol=1e-12) and first[f].shape[1] == 3
        assert first[f][-1, 0] == pytest.approx(full[f][:-1][:, [3, 5]].sum())

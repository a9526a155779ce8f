"""Keyed deals: bijections, even use of all orders, the same labels in every view, direct refits."""
import math
from collections import Counter

import numpy as np
import pytest

from obsloom.operators import contingency, permute, validate


def keys(seed, rep, name, n):
    return np.array([permute.round_keys(seed, rep, name)] * n).T


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 99_991])
def test_places_are_permuted(n):
    for rep in range(3):
        got = permute.permuted_place(np.arange(n), np.full(n, n), keys(4, rep, "s", n))
        assert np.array_equal(np.sort(got), np.arange(n))


def test_strata_of_many_sizes_at_once():
    sizes = [1, 7, 2, 30, 64, 65]
    place, n = np.concatenate([np.arange(s) for s in sizes]), np.repeat(sizes, sizes)
    k = np.hstack([keys(1, 9, str(s), s) for s in sizes])
    got, at = permute.permuted_place(place, n, k), 0
    for s in sizes:
        assert np.array_equal(got[at:at + s], permute.permuted_place(np.arange(s), np.full(s, s), keys(1, 9, str(s), s)))
        at += s


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_orders_are_used_evenly(n):
    reps = 4000
    seen = Counter(tuple(permute.permuted_place(np.arange(n), np.full(n, n), keys(3, rep, "x", n)).tolist()) for rep in range(reps))
    orders = math.factorial(n)
    even = reps / orders
    chi = sum((v - even) ** 2 / even for v in seen.values()) + even * (orders - len(seen))
    assert chi < orders - 1 + 5 * math.sqrt(2 * orders)  # five standard deviations


def table(spark, n=400):
    rng = np.random.default_rng(2)
    rows = [(i, ["p", "q", "r", None][int(rng.integers(4))], [f"s{int(rng.integers(3))}", None][int(rng.random() < 0.1)], f"a{int(rng.integers(2))}",
             rng.normal(size=3).tolist(), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label string, stratum string, a string, v array<double>, fold long").repartition(5), rows


def test_deals_keep_the_labels_of_each_stratum_and_all_views_agree(spark):
    df, rows = table(spark)
    placed = permute.with_places(df, "id", "label", "stratum").cache()
    reps = range(-1, 12)
    dealt = {}
    for r in permute.permuted_labels(placed, "id", reps, 8).collect():
        dealt.setdefault(r.rep, {})[r.id] = r.permuted
    assert dealt[-1] == {i: label for i, label, *_ in rows}
    real = Counter((s, label) for _, label, s, *_ in rows)
    for rep in reps:
        assert Counter((s, dealt[rep][i]) for i, _, s, *_ in rows) == real
    assert len({tuple(sorted(d.items())) for d in dealt.values()}) == len(reps)
    cells = {(r.rep, r.a, r.b): r.n_ab for r in permute.null_cells(placed, "a", reps, 8).collect()}
    assert cells == Counter((rep, a, dealt[rep][i]) for rep in reps for i, _, _, a, *_ in rows)
    sums = {(r.rep, r.by, r.label): (r.n, r.s) for r in permute.null_sums(placed, "fold", "v", 3, reps, 8).collect()}
    for (rep, fold, label), (n, s) in sums.items():
        own = [np.array(v) for i, _, _, _, v, f in rows if str(f) == fold and dealt[rep][i] == label]
        assert n == len(own) and np.allclose(s, np.sum(own, 0))
    models = {(rep, f): validate.LDA(["p", "q"], np.array([[1.0, 0, rep], [0, 1, 0]]), np.array([0.0, int(f)])) for rep in reps for f in "01"}
    got = {(r.rep, r.truth, r.pred): r.n for r in permute.null_confusion(placed, "fold", "v", models, reps, 8).collect()}
    want = Counter((rep, dealt[rep][i], "pq"[int(models[rep, str(f)].log_scores(np.array([v]))[0].argmax())]) for rep in reps for i, _, _, _, v, f in rows)
    assert got == want
    placed.unpersist()


def test_one_count_for_each_value_of_the_other_column(spark):
    df, _ = table(spark, 60)
    placed = permute.with_places(df, "id", "label", "stratum")
    want = sorted(map(tuple, permute.null_cells(placed, "id", range(4), 1).collect()), key=str)
    assert len(want) == 240 and sum(w[3] for w in want) == 240


def test_null_agrees_with_counts_drawn_directly(spark):
    """Mean of the permutation null of chi-square against the multivariate hypergeometric one."""
    df, _ = table(spark, 900)
    df = df.where("label is not null and stratum is not null")
    placed = permute.with_places(df, "id", "label", "stratum")
    a = contingency.chi_square(permute.null_cells(placed, "a", range(400), 3), ["rep"]).toPandas()["chi2"]
    cells = contingency.cell_counts(df, "a", "label", ["stratum"])
    b = contingency.chi_square(contingency.permuted_cells(cells, "stratum", 400, 3), ["rep"]).toPandas()["chi2"]
    assert abs(a.mean() - b.mean()) < 5 * math.sqrt((a.var() + b.var()) / 400)


def test_empty_table(spark):
    df, _ = table(spark, 10)
    placed = permute.with_places(df.where("id < 0"), "id", "label", "stratum")
    assert permute.null_cells(placed, "a", range(3), 1).collect() == []


def test_rows_are_shuffled_once_whatever_the_repeats(spark):
    df, _ = table(spark)
    plans = [permute.null_cells(permute.with_places(df, "id", "label", "stratum"), "a", range(n), 1)._jdf.queryExecution().executedPlan().toString().count("Exchange") for n in (2, 900)]
    assert plans[0] == plans[1]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1003, 40000])
def test_counts_of_look_up_walk(n):
    """Counts by look-ups equal those of every place walked by itself, in strata of any size and with an empty code."""
    rng = np.random.default_rng(n)
    place, starts = rng.permutation(n).astype(np.int64), np.array([0, n // 3, n // 3, n])
    ends = np.unique(np.append(rng.integers(1, n + 1, 3), n))
    for rep in range(3):
        keys = permute.round_keys(5, rep, "s")
        label = np.searchsorted(ends, permute.permuted_place(place, np.full(n, n), np.repeat(np.array(keys)[:, None], n, 1)), side="right")
        want = [np.bincount(label[a:b], minlength=len(ends)) for a, b in zip(starts[:-1], starts[1:])]
        assert (permute._label_counts(place, n, keys, ends, starts) == np.stack(want)).all()


def test_repeats_are_shared_out_over_blocks(spark, monkeypatch):
    """Many small blocks give the cells of one; the real labels count as repeat -1, nulls as values of their own."""
    df, _ = table(spark, 200)
    placed = permute.with_places(df, "id", "label", "stratum")
    cells = lambda: sorted(map(tuple, permute.null_cells(placed, "a", [-1, *range(5)], 4).collect()), key=str)
    whole = cells()
    monkeypatch.setattr(permute, "BLOCK", 16)
    assert cells() == whole and sum(c[3] for c in whole) == 6 * df.count()

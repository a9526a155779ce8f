"""Ensembles grown in Spark against the same trees grown row by row."""
import hashlib
import math

import numpy as np
import pytest

from obsloom.operators import trees, validate


def table(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = np.column_stack([rng.normal(size=n) + 1.5 * (y == 0), rng.normal(size=n) + 1.5 * (y == 1), np.round(rng.normal(size=n), 1), np.full(n, 2.0), rng.normal(size=n)])
    fold = rng.integers(0, 2, n)
    rows = [(i, x[i].tolist(), "abc"[y[i]], int(fold[i])) for i in range(n)] + [(n, None, "a", 0), (n + 1, [0.0] * 5, None, 1)]
    return spark.createDataFrame(rows, "id long, v array<double>, label string, fold long").repartition(4), x, y, fold


SPLITS = {"0": ({"0"}, slice(0, 5)), "1": ({"1"}, slice(0, 4))}


def unit(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def one_extra_tree(x, y, name, t, depth, seed, k=3):
    """{node: (feature, threshold) or class shares}, grown recursively."""
    out, weight = {}, 1 / np.bincount(y, minlength=k)

    def grow(node, rows, level):
        n = np.bincount(y[rows], minlength=k)
        varying = [f for f in range(x.shape[1]) if x[rows, f].min() < x[rows, f].max()]
        if level == depth or len(rows) < 2 or (n > 0).sum() == 1 or not varying:
            out[node] = n * weight / (n * weight).sum()
            return
        key = f"{name}|{t}|{node}"
        drawn = sorted(varying, key=lambda f: (unit(seed, key, f, "order"), f))[:max(1, math.isqrt(x.shape[1]))]
        best = None
        for c, f in enumerate(drawn):
            lo, hi = x[rows, f].min(), x[rows, f].max()
            cut = lo + int(unit(seed, key, f, "threshold")[:8], 16) / 2**32 * (hi - lo)
            right = x[rows, f] > cut
            score = 0.0
            for side in (rows[~right], rows[right]):
                v = np.bincount(y[side], minlength=k) * weight
                score += (v * v).sum() / v.sum()
            if best is None or round(score, 9) > best[0]:
                best = (round(score, 9), f, cut, right)
        out[node] = best[1:3]
        grow(2 * node, rows[~best[3]], level + 1)
        grow(2 * node + 1, rows[best[3]], level + 1)

    grow(1, np.arange(len(x)), 0)
    return out


def test_extra_trees_equal_recursive_ones(spark):
    df, x, y, fold = table(spark)
    rows, classes, counts = trees.prepare(df, "v", "label", "fold")
    models = trees.extra_trees(rows, classes, counts, SPLITS, 12, 5, 7)
    for name, (held, block) in SPLITS.items():
        train = fold != int(name)
        forest = models[name].trees[0]
        for t in range(12):
            for node, want in one_extra_tree(x[train][:, block], y[train], name, t, 5, 7).items():
                if isinstance(want, tuple):
                    assert (forest.feature[t, node], forest.threshold[t, node]) == pytest.approx(want)
                else:
                    assert forest.feature[t, node] == -1 and np.allclose(forest.value[t, node], want)
        held_rows = fold == int(name)
        assert (models[name].probabilities(x[held_rows]).argmax(1) == y[held_rows]).mean() > 0.6


def direct_boosting(x, y, edges, rounds, depth, rate, least, k=3):
    prior = np.log(np.bincount(y, minlength=k) / len(y))
    m, trained = np.tile(prior, (len(x), 1)), []
    for _ in range(rounds):
        p = np.exp(m) / np.exp(m).sum(1, keepdims=True)
        step, own = np.zeros_like(m), []
        for c in range(k):
            g, h = p[:, c] - (y == c), p[:, c] * (1 - p[:, c])
            tree = {}

            def grow(node, rows, level):
                step[rows, c] = -rate * g[rows].sum() / h[rows].sum()
                best = None
                for f in range(x.shape[1]) if level < depth else []:
                    for cut in edges[f]:
                        left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                        if min(len(left), len(right)) >= least:
                            gain = g[left].sum()**2 / h[left].sum() + g[right].sum()**2 / h[right].sum() - g[rows].sum()**2 / h[rows].sum()
                            if gain > 1e-9 and (best is None or round(gain, 9) > best[0]):
                                best = (round(gain, 9), f, cut, left, right)
                if best:
                    tree[node] = best[1:3]
                    grow(2 * node, best[3], level + 1)
                    grow(2 * node + 1, best[4], level + 1)

            grow(1, np.arange(len(x)), 0)
            own.append(tree)
        m = m + step
        trained.append(own)
    return m, trained


def test_boosting_equals_direct_computation(spark):
    df, x, y, fold = table(spark)
    rows, classes, counts = trees.prepare(df, "v", "label", "fold")
    edges = trees.bin_edges(rows, SPLITS, 16)
    models = trees.boosting(rows, classes, counts, SPLITS, edges, 5, 2, rate=0.3, least=8, restage=2)
    for name, (held, block) in SPLITS.items():
        train = fold != int(name)
        margins, trained = direct_boosting(x[train][:, block], y[train], edges[name], 5, 2, 0.3, 8)
        assert np.allclose(models[name].margins(x[train][:, block]), margins)
        for forest, own in zip(models[name].trees, trained):
            for c, tree in enumerate(own):
                assert {n: (f, forest.threshold[c, n]) for n, f in enumerate(forest.feature[c]) if f >= 0} == tree


def test_boosting_learns_and_weights_classes(spark):
    df, x, y, fold = table(spark, 500, 3)
    rows, classes, counts = trees.prepare(df.where("label <> 'c' or id % 8 = 0"), "v", "label", "fold")
    edges = trees.bin_edges(rows, SPLITS, 16)
    plain, even = (trees.boosting(rows, classes, counts, SPLITS, edges, 6, 2, rate=0.3, least=5, balanced=b) for b in (False, True))
    recall = lambda m: np.mean([(m[f].probabilities(x[(fold == int(f)) & (y == 2)]).argmax(1) == 2).mean() for f in "01"])
    assert recall(even) > recall(plain)
    scored = validate.score_models(df.where("v is not null"), "v", even, "label", {f: {f} for f in SPLITS})
    assert scored.count() == 500 + 1

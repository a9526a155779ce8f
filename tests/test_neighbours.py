"""Neighbour search against brute force: leaves, duplicates, one hot point, salted leaves, two sides."""
import numpy as np
import pytest

from obsloom.operators import cluster, graph, neighbours


def brute(x, ids, k, side=None):
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        ok = np.array([j != i and (side is None or side[j] != side[i]) for j in range(len(x))])
        cand = sorted((d[j], ids[j]) for j in np.flatnonzero(ok))[:k]
        out[ids[i]] = [b for _, b in cand]
    return out


def frame(spark, x, side=None):
    rows = [(int(i), [float(t) for t in r]) + ((bool(side[i]),) if side is not None else ()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>" + (", s boolean" if side is not None else ""))


@pytest.mark.parametrize("kw", [{"leaf_rows": 5000}, {"leaf_rows": 32}, {"leaf_rows": 32, "queries_per_task": 20}])
def test_knn_exact(spark, kw):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(260, 3)), 3)
    x[:90] = x[0]          # a third of the rows are one point
    x[100:110] = x[110]
    got = neighbours.knn(frame(spark, x), "id", "v", 6, **kw).toPandas().sort_values(["id", "rn"])
    want = brute(x, list(range(260)), 6)
    assert {i: list(g["nbr"]) for i, g in got.groupby("id")} == want


def test_knn_two_sides(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(150, 2)), 3)
    side = rng.random(150) < 0.2
    got = neighbours.knn(frame(spark, x, side), "id", "v", 5, leaf_rows=16, side="s").toPandas().sort_values(["id", "rn"])
    assert {i: list(g["nbr"]) for i, g in got.groupby("id")} == brute(x, list(range(150)), 5, side)


def test_leaves_stay_small_with_many_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, size=(12000, 20)) * (rng.random((12000, 20)) < 0.1)
    x = np.unique(x, axis=0).astype(float)
    rows = [(i, [float(t) for t in r], False) for i, r in enumerate(x)]
    points = spark.createDataFrame(rows, "pid long, v array<double>, sd boolean")
    levels, placed = neighbours.placed_in_leaves(points, len(x), 512)
    sizes = [r["count"] for r in placed.groupBy("leaf").count().collect()]
    assert levels >= 3 and sum(sizes) == len(x) and max(sizes) <= 1024


def test_components_of_a_long_path(spark):
    n = 60
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(n, n + 1)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[n] == got[n + 1] == n


def naive_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                ca, cb = x[groups[a]].mean(0), x[groups[b]].mean(0)
                na, nb = len(groups[a]), len(groups[b])
                d = 2 * na * nb / (na + nb) * ((ca - cb) ** 2).sum()
                if best is None or d < best[0]:
                    best = (d, a, b)
        _, a, b = best
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_ward_equals_plain_ward(spark):
    x = np.random.default_rng(4).normal(size=(40, 2))
    lab, merges, sizes = cluster.ward(frame(spark, x), "id", "v", 5)
    got = lab.toPandas().groupby("cluster")["id"].apply(frozenset)
    assert set(got) == naive_ward(x, 5)
    assert (np.diff(merges["height"]) >= -1e-12).all() and merges["n"].iloc[-1] == 40
    topo = cluster.tree_topology(merges, sizes, 5)
    assert len(topo) == 4 and topo["parent"].isna().sum() == 1


def test_modularity_finds_two_cliques(spark):
    e = [(a, b, 1.0) for s in (0, 6) for a in range(s, s + 6) for b in range(a + 1, s + 6)] + [(5, 6, 0.1)]
    lab = cluster.communities(spark.createDataFrame(e, "src long, dst long, w double"), rounds=6, levels=2)
    got = lab.toPandas().groupby("community")["id"].apply(frozenset)
    assert set(got) == {frozenset(range(6)), frozenset(range(6, 12))}


def test_many_dimensions_in_blocks(spark):
    """Blocks meet pairwise whatever their size: equal to all distances, copies and ties included, and no task holds more than a block a side."""
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(400, 24)), 1)
    x[300:320] = x[:20]
    points = spark.createDataFrame([(i, v.tolist(), False) for i, v in enumerate(x[:300])], "pid long, v array<double>, sd boolean")
    blocks = neighbours._all_blocks(points, 300, 6, False, 40)
    assert blocks.toPandas().groupby("pid").size().between(6, 6 * 8).all()
    spread, least, rows = neighbours.ROWS_FOR_A_BLOCK, neighbours.LEAST_BLOCKS, neighbours.BLOCK_ROWS
    neighbours.ROWS_FOR_A_BLOCK, neighbours.LEAST_BLOCKS, neighbours.BLOCK_ROWS = 50, 3, 100
    try:
        got = neighbours.knn(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", 6).toPandas()
    finally:
        neighbours.ROWS_FOR_A_BLOCK, neighbours.LEAST_BLOCKS, neighbours.BLOCK_ROWS = spread, least, rows
    d = np.sqrt(sum((x[:, None, j] - x[None, :, j]) ** 2 for j in range(24)))
    np.fill_diagonal(d, np.inf)
    got = got.sort_values(["id", "rn"])
    for i in range(400):
        want = np.lexsort((np.arange(400), d[i]))[:6]
        mine = got[got["id"] == i]
        assert list(mine["nbr"]) == list(want) and (mine["dist"].to_numpy() == d[i, want]).all()


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-9, 1e6), (1e-170, 0.0), (1e12, 0.0)])
def test_products_only_choose_whom_to_measure(scale, shift):
    """Nearest pairs by matrix products equal those by differences for any scale, infinite and missing numbers included."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 20)) * scale + shift
    x[3, 1], x[4, 2] = np.inf, np.nan
    ids = rng.permutation(700)
    got = neighbours._nearest(x, ids, x, ids, 5).sort_values(["pid", "dist", "nid"])
    with np.errstate(all="ignore"):
        d = sum((x[:, None, j] - x[None, :, j]) ** 2 for j in range(20))
    d[np.arange(700), np.arange(700)] = np.inf
    want = {int(ids[i]): [int(ids[c]) for c in np.lexsort((ids, d[i]))[:5]] for i in range(700) if np.isfinite(d[i]).any()}
    assert got.groupby("pid")["nid"].apply(list).to_dict() == want


def test_shared_neighbours_link_rows_that_are_no_neighbours(spark, monkeypatch):
    """Every pair whose lists overlap enough is linked, whether or not one is in the other's list; a member in many lists is met in blocks."""
    monkeypatch.setattr(neighbours, "HOLDERS", 7)
    rng = np.random.default_rng(21)
    lists = {i: {int(j) for j in rng.choice(60, 5, replace=False) if j != i} | ({99} if i % 2 else set()) for i in range(60)} | {99: {0, 1}}
    neigh = spark.createDataFrame([(i, j) for i, js in lists.items() for j in js], "id long, nbr long")
    got = {(r["src"], r["dst"]): r["w"] for r in neighbours.snn_edges(neigh, "id", 5, 0.15).collect()}
    own = {i: js | {i} for i, js in lists.items()}
    want = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a in own for b in own if a < b}
    want = {e: w for e, w in want.items() if w >= 0.15}
    assert got == pytest.approx(want)
    assert any(b not in lists[a] and a not in lists[b] for a, b in got)

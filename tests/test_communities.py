"""Communities: settled, connected, and no worse than plain greedy merging."""
import numpy as np
import pytest

from obsloom.operators import cluster, communities as C, neighbours
from obsloom.plans import registry, s12_clustering

SCHEMA = "src long, dst long, w double"


def groups(table):
    return set(table.toPandas().groupby("community")["id"].apply(frozenset))


def matrix(edges, n):
    w = np.zeros((n, n))
    for a, b, v in edges:
        w[a, b] += v
        w[b, a] += v
    return w


def quality(w, c, gamma):
    k, two_m = w.sum(1), w.sum()
    same = c[:, None] == c[None, :]
    return ((w - gamma * np.outer(k, k) / two_m) * same).sum() / two_m


def assert_settled(w, c, gamma):
    """No single node gains by any neighbour's community or by one of its own; every community has a path inside."""
    q = quality(w, c, gamma)
    for i in range(len(c)):
        for to in {*c[w[i] > 0], -1}:
            other = c.copy()
            other[i] = to
            assert quality(w, other, gamma) <= q + 1e-9
    for g in set(c):
        at = np.flatnonzero(c == g)
        seen, todo = {at[0]}, [at[0]]
        while todo:
            for j in np.flatnonzero((w[todo.pop()] > 0) & (c == g)):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert len(seen) == len(at) and g == at.min()


def greedy(w, gamma):
    """Merge the pair of communities with the largest rise until none rises."""
    c = np.arange(len(w))
    while True:
        best = (quality(w, c, gamma) + 1e-12, None)
        for a in set(c):
            for b in set(c):
                if a < b:
                    d = np.where(c == b, a, c)
                    best = max(best, (quality(w, d, gamma), (a, b)), key=lambda t: t[0])
        if best[1] is None:
            return best[0]
        c = np.where(c == best[1][1], best[1][0], c)


def test_settled_connected_and_good(spark, gamma=1.3):
    rng = np.random.default_rng(5)
    part = rng.integers(0, 4, 36)
    edges = [(a, b, float(rng.uniform(0.2, 1))) for a in range(36) for b in range(a) if rng.random() < (0.5 if part[a] == part[b] else 0.06)]
    edges += [(i, (i + 1) % 36, 0.05) for i in range(36)]
    w = matrix(edges, 36)
    got = C.communities(spark.createDataFrame(edges, SCHEMA).repartition(3), gamma).orderBy("id").toPandas()
    c = got["community"].to_numpy()
    assert got["id"].tolist() == list(range(36))
    assert_settled(w, c, gamma)
    assert quality(w, c, gamma) >= greedy(w, gamma) - 0.01
    sym = C.symmetric(spark.createDataFrame(edges, SCHEMA))
    lab = spark.createDataFrame([(i, int(x)) for i, x in enumerate(c)], "id long, c long")
    assert cluster.modularity(sym, lab, gamma) == pytest.approx(quality(w, c, gamma))


def test_ring_of_cliques(spark):
    e = [(a, b, 1.0) for s in range(0, 30, 5) for a in range(s, s + 5) for b in range(a + 1, s + 5)] + [(s, (s + 6) % 30, 0.2) for s in range(0, 30, 5)]
    assert groups(C.communities(spark.createDataFrame(e, SCHEMA))) == {frozenset(range(s, s + 5)) for s in range(0, 30, 5)}


def test_each_set_of_moves_raises_quality(spark):
    """A star, where every leaf wants the same community at once."""
    e = [(0, i, 1.0) for i in range(1, 12)] + [(12, i, 1.0) for i in range(13, 24)] + [(0, 12, 1.0)]
    w, sym = matrix(e, 24), C.symmetric(spark.createDataFrame(e, SCHEMA))
    degree = sym.groupBy(sym.src.alias("id")).agg({"w": "sum"}).toDF("id", "k")
    lab, q = np.arange(24), quality(w, np.arange(24), 1.0)
    for turn in range(3):
        table = spark.createDataFrame([(i, int(c)) for i, c in enumerate(lab)], "id long, c long")
        prop = C.proposals(sym, table, degree, float(w.sum()), 1.0, turn, False)
        for go in (C._coloured(prop, float(w.sum()), 1.0).collect(), C._matched(prop).collect()):
            new = lab.copy()
            for r in go:
                new[r["id"]] = r["to"]
            assert quality(w, new, 1.0) > q or not go
            best = new
        lab, q = best, quality(w, best, 1.0)


def test_odd_edges_and_limit(spark):
    odd = [(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (4, 4, 5.0), (0, 3, 0.0), (None, 1, 1.0), (1, 2, None), (1, 2, -1.0)]
    assert groups(C.communities(spark.createDataFrame(odd, SCHEMA))) == {frozenset({0, 1}), frozenset({2, 3})}
    empty = C.communities(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["id", "community"] and empty.isEmpty()
    with pytest.raises(ValueError, match="settle"):
        C.communities(spark.createDataFrame(odd, SCHEMA), rounds=1)


def noisy_groups(seed, n, parts):
    rng = np.random.default_rng(seed)
    part = rng.integers(0, parts, n)
    return [(a, b, float(rng.uniform(0.2, 1))) for a in range(n) for b in range(a) if rng.random() < (0.4 if part[a] == part[b] else 0.02)] + [(i, (i + 1) % n, 0.05) for i in range(n)]


def test_blocks_settle_as_one_task_does(spark, monkeypatch):
    edges = noisy_groups(6, 30, 3)
    w, table = matrix(edges, 30), spark.createDataFrame(edges, SCHEMA)
    here = C.communities(table).orderBy("id").toPandas()["community"].to_numpy()
    monkeypatch.setattr(C, "LOCAL", 60)
    sym = C.symmetric(table)
    degree = sym.groupBy(sym.src.alias("id")).agg({"w": "sum"}).toDF("id", "k")
    lab = spark.createDataFrame([(i, i) for i in range(30)], "id long, c long")
    prop = C.proposals(sym, lab, degree, float(w.sum()), 1.0, 1, False)
    go = {r["id"]: r["to"] for r in C._blocks(sym, lab, degree, prop, float(w.sum()), 1.0, 1, False).collect()}
    assert go and quality(w, np.array([go.get(i, i) for i in range(30)]), 1.0) > quality(w, np.arange(30), 1.0)
    dealt = C.communities(table).orderBy("id").toPandas()["community"].to_numpy()
    for c in (here, dealt):
        assert_settled(w, c, 1.0)
        assert quality(w, c, 1.0) >= greedy(w, 1.0) - 0.01


def test_query_goes_on_until_no_node_gains(spark, tmp_path):
    """The query's communities are those of the settled graph, which six rounds on two levels did not reach."""
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=(300, 6)), axis=0)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.QUERIES["modularity_communities"](spark, str(tmp_path)).toPandas()
    e = [tuple(r) for r in neighbours.snn_edges(neighbours.knn(s12_clustering.pcs(spark, str(tmp_path)), "obs_id", "pc", 20), "obs_id", 20).select("src", "dst", "w").collect()]
    w, c = matrix(e, 300), C.communities(spark.createDataFrame(e, SCHEMA)).orderBy("id").toPandas()["community"].to_numpy()
    assert_settled(w, c, 1.0)
    assert dict(zip(got["community"], got["n"])) == {int(g): int((c == g).sum()) for g in set(c)}
    assert got["q"].iloc[0] == pytest.approx(quality(w, c, 1.0), abs=1e-4)
    capped = cluster.communities(spark.createDataFrame(e, SCHEMA), 1.0, rounds=6, levels=2).orderBy("id").toPandas()["community"].to_numpy()
    with pytest.raises(AssertionError):
        assert_settled(w, np.unique(capped, return_inverse=True)[1], 1.0)

"""Block eigenvectors of the normalised Laplacian against dense ones."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from obsloom.operators import laplacian as L, neighbours

SCHEMA = "src long, dst long, w double"


def dense(edges, n):
    w = np.zeros((n, n))
    for a, b, v in edges:
        w[a, b] += v
        w[b, a] += v
    d = w.sum(1)
    return d, np.eye(n) - w / np.sqrt(np.outer(d, d))


def check(spark, edges, n, k, **kw):
    d, lap = dense(edges, n)
    val, table = L.eigenvectors(spark.createDataFrame(edges, SCHEMA).repartition(5), k, **kw)
    got = table.orderBy("id").toPandas()
    assert got["id"].tolist() == list(range(n)) and np.allclose(got["d"], d)
    x = np.stack(got["x"])
    assert np.allclose(val, np.linalg.eigvalsh(lap)[:k], atol=1e-9)
    assert np.allclose(x.T @ x, np.eye(k), atol=1e-9) and np.abs(lap @ x - x * val).max() < 2e-6
    return val, x


def blobs(seed, sizes, spread):
    rng = np.random.default_rng(seed)
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, rng.normal(size=(len(group), 3)) + spread * np.eye(3)[group]


def ring(n, rng):
    return [(i, (i + 1) % n, float(rng.uniform(0.5, 2))) for i in range(n)]


def test_eigenvalues_equal_dense_ones(spark):
    rng = np.random.default_rng(1)
    more = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 60), rng.integers(30, 60, 60), rng.uniform(0.1, 3, 60))]
    check(spark, ring(60, rng) + more, 60, 5)


def test_separate_parts_share_the_value_zero(spark):
    rng = np.random.default_rng(2)
    edges = [(a + s, b + s, w) for s in (0, 8, 16) for a, b, w in ring(8, rng)]
    val, x = check(spark, edges, 24, 4)
    assert np.abs(val[:3]).max() < 1e-9 and val[3] > 1e-3


def test_bipartite_graph(spark):
    """The eigenvalue two of the Laplacian is the largest of all and must not be taken for a leading one."""
    check(spark, [(a, 5 + b, 1.0 + a) for a in range(5) for b in range(6)], 11, 3)


def test_fewer_nodes_than_vectors(spark):
    val, x = check(spark, [(0, 1, 1.0), (1, 2, 2.0)], 3, 3)
    assert x.shape == (3, 3)
    val, table = L.eigenvectors(spark.createDataFrame([(0, 1, 1.0)], SCHEMA), 5)
    assert np.allclose(val, [0, 2]) and table.count() == 2


def test_odd_edges(spark):
    odd = [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 2, 9.0), (0, 2, 0.0), (0, 3, None), (None, 1, 1.0), (2, 4, -1.0)]
    val, table = L.eigenvectors(spark.createDataFrame(odd, SCHEMA), 2)
    _, lap = dense([(0, 1, 2.0), (1, 2, 1.0)], 3)
    assert np.allclose(val, np.linalg.eigvalsh(lap)[:2], atol=1e-9) and table.count() == 3
    val, table = L.eigenvectors(spark.createDataFrame([], SCHEMA), 2)
    assert len(val) == 0 and table.columns == ["id", "d", "x"] and table.isEmpty()


def test_limit_raises(spark):
    with pytest.raises(ValueError, match="settle"):
        L.eigenvectors(spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], SCHEMA), 2, rounds=1)


def test_mutual_neighbours_weigh_one(spark):
    neigh = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (3, 3)], "id long, nbr long")
    got = {(r.src, r.dst): r.w for r in L.mutual_weights(neigh, "id").collect()}
    assert got == {(1, 2): 1.0, (1, 3): 0.5}


def test_spectral_finds_planted_groups(spark):
    group, x = blobs(3, [40, 70, 25], 9.0)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    e = L.mutual_weights(neighbours.knn(df, "id", "v", 8), "id")
    got = L.spectral(e, 3, restarts=3).orderBy("id").toPandas()["cluster"].to_numpy()
    assert len(set(zip(got, group))) == 3

"""Leading eigenvectors of the normalised adjacency of a graph; the block of vectors is a node table, products are joins on the edges."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import stage
from .cluster import kmeans

GROWTH = 1e4  # a filter grows no direction beyond this against the damped ones, so the p x p products stay well conditioned
CHAIN = 3  # products in one plan; longer plans cost more to analyse than a staged table


def mutual_weights(neigh: DataFrame, id_col: str) -> DataFrame:
    """(src, dst, w), once per pair: 1 where both rows name each other as neighbours, 0.5 where one does."""
    e = neigh.where(F.col(id_col) != F.col("nbr")).select(id_col, "nbr").distinct()
    return e.groupBy(F.least(id_col, "nbr").alias("src"), F.greatest(id_col, "nbr").alias("dst")).agg((F.count("*") * 0.5).alias("w"))


def normalised(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, w, loop) with w / sqrt(d_src d_dst) both ways and a zero loop a node, and (id, d).

    ``edges`` holds a pair once, in either direction; repeated pairs add up. Loops, NULL ends and weights that
    are not positive are left out, and a node without an edge is not in the result."""
    e = edges.where((F.col("src") != F.col("dst")) & (F.col("w") > 0)).select("src", "dst", F.col("w").cast("double").alias("w"))
    sym = stage(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    degree = stage(sym.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d")))
    ends = degree.select(F.col("id").alias("src"), F.col("d").alias("ds")), degree.select(F.col("id").alias("dst"), F.col("d").alias("dd"))
    scaled = sym.join(ends[0], "src").join(ends[1], "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"), F.lit(False).alias("loop"))
    loops = degree.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"), F.lit(True).alias("loop"))
    return stage(scaled.unionByName(loops)), degree


def _step(links: DataFrame, state: DataFrame, p: int, scale: float, shift: float, before: float) -> DataFrame:
    """y <- scale (N - shift) y - before z, z <- y. The state (id, y*, z*) is read once, so a chain of steps stays a chain."""
    out = [e for j in range(p) for e in (
        F.expr(f"sum(if(loop, {-scale * shift!r}D * y{j} - {before!r}D * z{j}, {scale!r}D * w * y{j}))").alias(f"y{j}"),
        F.expr(f"sum(if(loop, y{j}, 0D))").alias(f"z{j}"))]
    return links.join(state.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*out)


def _filtered(links: DataFrame, state: DataFrame, p: int, top: float, bound: float, degree: int) -> DataFrame:
    """Chebyshev polynomial that stays within one on [-1, bound] and grows beyond."""
    half, mid = (bound + 1) / 2, (bound - 1) / 2
    reach = max((top - mid) / half, 1.0)
    steps = degree if reach <= 1 + 1e-12 else max(1, min(degree, int(np.arccosh(GROWTH) / np.arccosh(reach))))
    for s in range(steps):
        if s and s % CHAIN == 0:
            state = stage(state)
        state = _step(links, state, p, float((2 if s else 1) / half), float(mid), 1.0 if s else 0.0)
    return state


def _products(state: DataFrame, p: int) -> np.ndarray:
    """z'z, z'y and y'y: a sum a partition, added up in Spark."""
    ys, zs = [f"y{j}" for j in range(p)], [f"z{j}" for j in range(p)]

    def part(batches):
        g = np.zeros((3, p, p))
        for b in batches:
            y, z = b[ys].to_numpy(), b[zs].to_numpy()
            g += np.stack([z.T @ z, z.T @ y, y.T @ y])
        yield pd.DataFrame({"at": np.arange(g.size), "s": g.ravel()})

    rows = state.select(*ys, *zs).mapInPandas(part, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    g = np.zeros(3 * p * p)
    for r in rows:
        g[r["at"]] = r["s"]
    return g.reshape(3, p, p)


def _ritz(g: np.ndarray):
    """(values descending, rotation, residual norms) of the block; directions that depend on others are dropped."""
    size, u = np.linalg.eigh(g[0])
    keep = size > max(size[-1], 0) * 1e-13
    white = u[:, keep] / np.sqrt(size[keep])
    h = white.T @ ((g[1] + g[1].T) / 2) @ white
    val, v = np.linalg.eigh((h + h.T) / 2)
    val, turn = val[::-1], white @ v[:, ::-1]
    left = np.einsum("ij,ik,kj->j", turn, g[2], turn) - val ** 2
    return val, turn, np.sqrt(np.maximum(left, 0))


def _rotated(state: DataFrame, p: int, turn: np.ndarray) -> DataFrame:
    zs, q = [f"z{j}" for j in range(p)], turn.shape[1]
    id_type = state.schema["id"].dataType.simpleString()

    def apply(batches):
        for b in batches:
            x = b[zs].to_numpy() @ turn
            out = pd.DataFrame(np.hstack([x, np.zeros_like(x)]), columns=[f"{c}{j}" for c in "yz" for j in range(q)])
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    return state.select("id", *zs).mapInPandas(apply, f"id {id_type}, " + ", ".join(f"{c}{j} double" for c in "yz" for j in range(q)))


def eigenvectors(edges: DataFrame, k: int, extra: int = 6, degree: int = 10, tol: float = 1e-6, rounds: int = 200):
    """The k smallest eigenvalues of I - D^-1/2 W D^-1/2 with unit vectors: (values, table of id, d, x array<double>).

    Block iteration with ``k + extra`` vectors begun from hashes of the ids. A round applies a Chebyshev filter, each
    step one join with the edges and one grouped sum, and rotates by p x p products. It ends once all k residual norms
    are at most ``tol``; ``rounds`` is a safety limit that raises. Fewer nodes than k give as many vectors as nodes.
    Signs, and the basis inside equal eigenvalues, are arbitrary. No edges: no values and an empty table."""
    links, nodes = normalised(edges)
    n = nodes.count()
    if not n:
        return np.zeros(0), nodes.withColumn("x", F.array().cast("array<double>"))
    p = min(k + extra, n)
    k = min(k, n)
    draw = [(F.xxhash64("id", F.lit(j)) / F.lit(2.0 ** 63)).alias(f"y{j}") for j in range(p)]
    state = nodes.select("id", *draw, *[F.lit(0.0).alias(f"z{j}") for j in range(p)])
    for _ in range(rounds):
        state = stage(_step(links, state, p, 1.0, 0.0, 0.0))
        val, turn, left = _ritz(_products(state, p))
        if len(val) >= k and left[:k].max() <= tol:
            done = _rotated(state, p, turn[:, :k])
            return 1 - val[:k], done.select("id", F.array(*[f"y{j}" for j in range(k)]).alias("x")).join(nodes, "id").select("id", "d", "x")
        if len(val) < k:
            raise ValueError("the block lost directions")
        state, p = _rotated(state, p, turn), len(val)
        state = _filtered(links, state, p, val[0], max(val[-1], -0.9), degree)
    raise ValueError("eigenvectors did not settle")


def spectral(edges: DataFrame, k: int, seed: int = 1, restarts: int = 10) -> DataFrame:
    """(id, cluster): k-means on the k leading eigenvectors, each row scaled by d^-1/2."""
    _, table = eigenvectors(edges, k)
    rows = stage(table.select("id", F.transform("x", lambda v: v / F.sqrt("d")).alias("_at")))
    return kmeans(rows, "_at", k, seed, restarts)[0].select("id", "cluster")

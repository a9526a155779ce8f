"""Exact k-nearest neighbours by space partitioning, and graph operators built on the edges.

Identical vectors are collapsed first. A median-split tree, planned from a hash
sample, assigns every distinct vector to a leaf. Each leaf is searched on its own, which
bounds the k-th distance of its points; a point is sent on only to leaves whose box is
nearer than that bound. Leaves asked by very many points are split by salt. The result
is exact whatever the plan; the plan only decides how much is sent. In many dimensions
boxes stop pruning: there hashed blocks of rows meet pairwise, so work is rows squared, in
tasks of bounded size.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import draw, draw_unit
from ..runtime import stage

MAX_LEAVES = 16384
PLAN_POINTS_PER_LEAF = 24
QUERIES_PER_TASK = 20_000
# Beyond so many dimensions boxes prune nothing; blocks of this many rows then meet pairwise, small tables in at least 8 x 8 tasks.
MOST_DIMENSIONS = 16
BLOCK_ROWS = 65_536
LEAST_BLOCKS, ROWS_FOR_A_BLOCK = 8, 2048


def _plan_tree(points: DataFrame, n: int, leaf_rows: int):
    """(dimension, split, tie share) per inner node in heap order, from a hash sample of about leaves x 24 vectors.

    Vectors that tie at a split go right by their own draw in the share that halves the node."""
    levels = 0
    while (1 << levels) * leaf_rows < n and (1 << levels) < MAX_LEAVES:
        levels += 1
    if levels == 0:
        return 0, np.zeros(1, int), np.zeros(1), np.zeros(1)
    want = (1 << levels) * PLAN_POINTS_PER_LEAF
    rows = points if n <= want else points.where(draw_unit(draw("tree", F.col("pid"))) < want / n)
    drawn = rows.select("v", "pid").collect()
    x = np.array([r["v"] for r in drawn])
    ids = np.array([r["pid"] for r in drawn], "int64")
    dims, cuts, ties = np.zeros(1 << levels, int), np.zeros(1 << levels), np.zeros(1 << levels)
    groups = {1: np.arange(len(x))}
    for node in range(1, 1 << levels):
        at = groups.pop(node)
        g = x[at]
        if len(g):
            dims[node] = int(np.argmax(g.max(0) - g.min(0)))
            v = g[:, dims[node]]
            cuts[node] = np.sort(v)[(len(v) - 1) // 2]
            ties[node] = np.clip((len(v) / 2 - (v > cuts[node]).sum()) / (v == cuts[node]).sum(), 0, 1)
            right = _goes_right(v, ids[at], node, cuts[node], ties[node])
        else:
            right = np.zeros(0, bool)
        groups[2 * node], groups[2 * node + 1] = at[~right], at[right]
    return levels, dims, cuts, ties


def _goes_right(v, ids, node, cut, tie):
    """Side of a split; ties draw a number of (id, node), fresh at every node."""
    z = ids.astype("uint64") + np.broadcast_to(node, ids.shape).astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
    for mul in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        z = (z ^ (z >> np.uint64(29))) * np.uint64(mul)
    unit = (z >> np.uint64(11)).astype(float) / float(1 << 53)
    return (v > cut) | ((v == cut) & (unit < tie))


def placed_in_leaves(points: DataFrame, n: int, leaf_rows: int) -> tuple[int, DataFrame]:
    """Depth of the plan and (pid, v, sd, leaf) for every distinct vector."""
    levels, dims, cuts, ties = _plan_tree(points, n, leaf_rows)

    @F.pandas_udf("int")
    def leaf_of(v: pd.Series, pid: pd.Series) -> pd.Series:
        m, ids, node = _matrix(v), pid.to_numpy(), np.ones(len(v), int)
        for _ in range(levels):
            node = 2 * node + _goes_right(m[np.arange(len(m)), dims[node]], ids, node, cuts[node], ties[node])
        return pd.Series(node.astype("int32"))

    return levels, points.select("pid", "v", "sd", leaf_of("v", "pid").alias("leaf"))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()) if len(col) else np.zeros((0, 0))


def _no_pairs() -> pd.DataFrame:
    return pd.DataFrame({"pid": [], "nid": [], "dist": []}).astype({"pid": "int64", "nid": "int64", "dist": "float64"})


def _nearest(q, qid, x, xid, k, bound=None, chunk=128, qs=None, xs=None):
    """Rows (query id, neighbour id, distance): the k smallest by (distance, id), self left out.

    With sides given, only points of the other side count. A matrix product gives squared distances up to a rounding error
    of known size; pairs that may be among the k smallest under it are computed from their differences and ranked by those."""
    if qs is not None:
        side = pd.factorize(np.concatenate([np.asarray(qs, object), np.asarray(xs, object)]), use_na_sentinel=False)[0]
        sq, sx = side[:len(q)], side[len(q):]
        parts = [_nearest(q[sq == s], qid[sq == s], x[sx != s], xid[sx != s], k, None if bound is None else bound[sq == s], chunk) for s in np.unique(sq)]
        return pd.concat(parts) if parts else _no_pairs()
    if not len(q) or not len(x):
        return _no_pairs()
    with np.errstate(all="ignore"):
        meet = _Products(q, x)
        limit = np.full(len(q), np.inf) if bound is None else bound ** 2 * (1 + 1e-9) - meet.nq
        return pd.concat([_block(meet, slice(s, s + chunk), qid, xid, k, limit[s:s + chunk].copy()) for s in range(0, len(q), chunk)])


class _Products:
    """|x|^2 - 2 q.x for tiles of queries and points, around the mean of the points, with a bound of its error for each query."""

    def __init__(self, q, x):
        fine = np.isfinite(x).all(1)
        center = x[fine].mean(0) if fine.any() else np.zeros(x.shape[1])
        self.q, self.x, self.zq, self.zx = q, x, q - center, x - center
        self.nq, nx = (self.zq ** 2).sum(1), (self.zx ** 2).sum(1)
        self.points = np.column_stack([-2 * self.zx, nx])
        longest = np.sqrt(nx[np.isfinite(nx)].max(initial=0.0))
        reach = np.sqrt(self.nq) + longest
        self.slack = {t: (q.shape[1] + 8) * np.finfo(t).eps * reach ** 2 + 1e-300 for t in (np.float32, np.float64)}
        # single precision first where nothing leaves its range
        self.fast = 1e-15 < longest < 1e15 and bool(fine.all() and (reach < 1e15).all())
        self.tables = {np.float64: (np.column_stack([self.zq, np.ones(len(q))]), self.points)}
        if self.fast:
            self.tables[np.float32] = tuple(t.astype(np.float32) for t in self.tables[np.float64])

    def tile(self, rows, at, wide, kind):
        a, b = self.tables[kind]
        return a[rows] @ b[at:at + wide].T

    def exact(self, r, c):
        diff = np.ascontiguousarray((self.q[r] - self.x[c]).T)
        diff *= diff
        return np.add.reduce(diff, axis=0)  # dimension by dimension, as a plain sum adds up


def _block(meet, rows, qid, xid, k, limit, wide=2048):
    """The k nearest of one block of queries, over ``wide`` points at a time; what is held is k pairs a query and one such table.

    ``limit``: for each query, a value of |x|^2 - 2 q.x that no wanted pair exceeds; a NaN leaves all points in."""
    q0, qid = rows.start, qid[rows]
    held = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    for at in range(0, len(xid), wide):
        for kind in (np.float32, np.float64) if meet.fast else (np.float64,):
            part, slack = meet.tile(rows, at, wide, kind), meet.slack[kind][rows]
            m = part.shape[1]
            if m > k and np.isinf(limit).any():
                # one more than k, as the query itself may be among them
                limit = np.fmin(limit, np.partition(part, k, axis=1)[:, k] + slack)
            top = limit + slack
            if kind is np.float32:
                top = np.nextafter(top.astype(kind), kind(np.inf))
            hit = np.flatnonzero(~(part > top[:, None]))
            if len(hit) * 16 < part.size:
                break
        r, c = hit // m, hit % m + at
        other = qid[r] != xid[c]
        r, c = r[other], c[other]
        d = meet.exact(r + q0, c)
        near = np.isfinite(d)
        r, c, d = (np.concatenate([h, n[near]]) for h, n in zip(held, (r, c, d)))
        o = np.lexsort((xid[c], d, r))
        r, c, d = r[o], c[o], d[o]
        keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
        held = r[keep], c[keep], d[keep]
        full = np.flatnonzero(np.bincount(held[0], minlength=len(qid)) == k)
        if len(full):
            kth = held[2][np.searchsorted(held[0], full, side="right") - 1]
            limit[full] = np.fmin(limit[full], kth - meet.nq[rows][full] + meet.slack[np.float64][rows][full])
    r, c, d = held
    return pd.DataFrame({"pid": qid[r], "nid": xid[c], "dist": np.sqrt(d)})


def _all_blocks(points: DataFrame, n: int, k: int, cross: bool, block_rows: int) -> DataFrame:
    """(pid, nid, dist): every block of queries against every block of points, a task a pair of blocks."""
    blocks = max(math.ceil(n / block_rows), min(LEAST_BLOCKS, math.ceil(n / ROWS_FOR_A_BLOCK)), 1)
    numbered = points.select("pid", "v", "sd", F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asks = numbered.select("pid", "v", "sd", F.col("own").alias("qb"), every.alias("xb"))
    kept = numbered.select(F.col("pid").alias("xpid"), F.col("v").alias("xv"), F.col("sd").alias("xsd"), every.alias("xqb"), F.col("own").alias("xxb"))
    at = lambda q, x: (F.col(q) * blocks + F.col(x)).cast("int")
    asks, kept = asks.withColumn("pair", at("qb", "xb")), kept.withColumn("xpair", at("xqb", "xxb"))

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return _no_pairs()
        return _nearest(_matrix(q["v"]), q["pid"].to_numpy(), _matrix(p["xv"]), p["xpid"].to_numpy(), k,
                        qs=q["sd"].to_numpy() if cross else None, xs=p["xsd"].to_numpy() if cross else None)

    tasks = blocks * blocks  # given, as small exchanges would be joined into few tasks
    asks = asks.drop("qb", "xb").repartition(tasks, "pair")
    kept = kept.drop("xqb", "xxb").repartition(tasks, "xpair")
    return asks.groupBy("pair").cogroup(kept.groupBy("xpair")).applyInPandas(search, "pid long, nid long, dist double")


def knn(df: DataFrame, id_col: str, vec: str, k: int, leaf_rows: int = 2048,
        queries_per_task: int = QUERIES_PER_TASK, side: str | None = None) -> DataFrame:
    """(id, nbr, dist, rn) for the k nearest others, Euclidean, ties by id. Ids are BIGINT.

    ``side`` (boolean column): neighbours are looked for on the other side only.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"),
                     (F.col(side) if side else F.lit(False)).alias("sd"))
    cross = side is not None
    first = Window.partitionBy("v", "sd").orderBy("id")
    heads = rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)
    points = heads.groupBy("v", "sd").agg(F.min("id").alias("pid"), F.sort_array(F.collect_list("id")).alias("ids"))
    points = stage(points)
    n = points.count()
    some = points.select("v").first()
    if n > ROWS_FOR_A_BLOCK and some["v"] is not None and len(some["v"]) > MOST_DIMENSIONS:
        return _with_copies(rows, points, _all_blocks(points, n, k, cross, BLOCK_ROWS), id_col, k, cross)
    levels, placed = placed_in_leaves(points, n, leaf_rows)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(pdf["v"]), pdf["pid"].to_numpy()
        if len(x) == 1:
            return pd.DataFrame({"pid": ids, "nid": [None], "dist": [float("inf")]})
        sd = pdf["sd"].to_numpy() if cross else None
        return _nearest(x, ids, x, ids, k, qs=sd, xs=sd)

    placed = stage(placed) if levels else placed
    own = placed.groupBy("leaf").applyInPandas(inside, "pid long, nid long, dist double")
    own = stage(own) if levels else own
    found = own.where(F.col("nid").isNotNull())
    if levels:
        dim = len(points.select("v").first()["v"])
        boxes = placed.groupBy("leaf").agg(*[F.min(F.col("v")[j]).alias(f"l{j}") for j in range(dim)],
                                           *[F.max(F.col("v")[j]).alias(f"h{j}") for j in range(dim)]).collect()
        leaf_ids = np.array([b["leaf"] for b in boxes], "int32")
        lo = np.array([[b[f"l{j}"] for j in range(dim)] for b in boxes])
        hi = np.array([[b[f"h{j}"] for j in range(dim)] for b in boxes])

        @F.pandas_udf("array<int>")
        def reach(v: pd.Series, r: pd.Series, own_leaf: pd.Series) -> pd.Series:
            x, rad, at, out = _matrix(v), r.to_numpy(), own_leaf.to_numpy(), []
            # blocks of points against all boxes, dimension by dimension
            for s in range(0, len(x), 256):
                q, d = x[s:s + 256], np.zeros((len(x[s:s + 256]), len(leaf_ids)))
                for j in range(dim):
                    gap = np.maximum(lo[None, :, j] - q[:, j, None], 0) + np.maximum(q[:, j, None] - hi[None, :, j], 0)
                    d += gap * gap
                near = (d <= (rad[s:s + 256] ** 2 * (1 + 1e-9))[:, None]) & (leaf_ids[None, :] != at[s:s + 256, None])
                out += [leaf_ids[row] for row in near]
            return pd.Series(out, dtype=object)

        radius = found.groupBy("pid").agg(F.count("*").alias("m"), F.max("dist").alias("d"))
        radius = radius.select("pid", F.when(F.col("m") >= k, F.col("d")).otherwise(F.lit(float("inf"))).alias("r"))
        asks = (placed.join(radius, "pid", "left").withColumn("r", F.coalesce("r", F.lit(float("inf"))))
                .select("pid", "v", "sd", "r", F.explode(reach("v", "r", "leaf")).alias("leaf")))
        load = asks.groupBy("leaf").agg(F.ceil(F.count("*") / queries_per_task).cast("int").alias("parts"))
        asks = asks.join(load, "leaf").withColumn("salt", F.pmod(F.hash("pid"), F.col("parts")))
        # fresh names keep the two sides of the co-grouping apart
        copies = placed.join(load, "leaf").select(
            F.col("pid").alias("xpid"), F.col("v").alias("xv"), F.col("sd").alias("xsd"), F.col("leaf").alias("xleaf"),
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("xsalt"))

        def across(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(x):
                return pd.DataFrame({"pid": [], "nid": [], "dist": []}).astype(
                    {"pid": "int64", "nid": "int64", "dist": "float64"})
            return _nearest(_matrix(q["v"]), q["pid"].to_numpy(), _matrix(x["xv"]), x["xpid"].to_numpy(), k,
                            q["r"].to_numpy(), qs=q["sd"].to_numpy() if cross else None, xs=x["xsd"].to_numpy() if cross else None)

        more = asks.groupBy("leaf", "salt").cogroup(copies.groupBy("xleaf", "xsalt")).applyInPandas(
            across, "pid long, nid long, dist double")
        found = found.unionByName(more)
    return _with_copies(rows, points, found, id_col, k, cross)


def _with_copies(rows: DataFrame, points: DataFrame, found: DataFrame, id_col: str, k: int, cross: bool) -> DataFrame:
    """The k nearest rows of every row, from the nearest distinct vectors ``found`` and the ids that share a vector."""
    best = (found.withColumn("rn", F.row_number().over(Window.partitionBy("pid").orderBy("dist", "nid")))
            .where(F.col("rn") <= k))
    ids = points.select(F.col("pid").alias("nid"), "ids")
    others = best.join(ids, "nid").select("pid", F.transform("ids", lambda i: F.struct(
        F.col("dist").alias("dist"), i.alias("nbr"))).alias("c"))
    selfs = points.select("pid", F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("dist"), i.alias("nbr"))).alias("c"))
    # at most (k + 1) squared candidates per distinct vector
    cand = (others if cross else others.unionByName(selfs)).groupBy("pid").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("c"))), 1, k + 1).alias("c"))
    members = rows.join(points.select("v", "sd", "pid"), ["v", "sd"]).select("id", "pid")
    near = members.join(cand, "pid").select(
        "id", F.posexplode(F.slice(F.filter("c", lambda s: s["nbr"] != F.col("id")), 1, k)).alias("p", "s"))
    return near.select(F.col("id").alias(id_col), F.col("s.nbr").alias("nbr"), F.col("s.dist").alias("dist"),
                       (F.col("p") + 1).cast("long").alias("rn"))


HOLDERS = 1024  # rows of a member that meet as many others at a time


def snn_edges(neigh: DataFrame, id_col: str, k: int, prune: float = 1 / 15) -> DataFrame:
    """Jaccard weight of the neighbour lists (self included) of every pair of rows that share a member, pruned.

    Rows that hold a member meet in blocks, so a member in very many lists is spread over tasks; a row's later partners then
    come together as arrays and are counted where they are. Work follows the squared numbers of lists that hold a member.
    """
    lists = stage(neigh.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.collect_list("nbr").alias("l")).select(
        F.col(id_col).alias("id"), F.array_append("l", F.col(id_col)).alias("l")))
    size = lists.select("id", F.size("l").alias("n"))
    holds = lists.select("id", F.explode(F.array_distinct("l")).alias("m"))
    every = holds.groupBy("m").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / HOLDERS).cast("int")), lambda i: F.slice("ids", i * HOLDERS + 1, HOLDERS))
    parts = stage(every.select("m", blocks.alias("all")).select("m", (F.size("all") - 1).alias("last"), F.posexplode("all").alias("b", "ids")))
    own = parts.select("m", F.col("ids").alias("own"), F.explode(F.sequence("b", "last")).alias("b"))
    met = own.join(parts.select("m", "b", "ids"), ["m", "b"]).select(F.explode("own").alias("src"), "ids")
    met = met.withColumn("ids", F.filter("ids", lambda x: x > F.col("src"))).where(F.size("ids") > 0)
    pairs = met.repartition("src").select("src", F.explode("ids").alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("shared"))
    j = (pairs.join(size.select(F.col("id").alias("src"), F.col("n").alias("a")), "src")
         .join(size.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst"))
    return (j.select("src", "dst", (F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))).alias("w"))
            .where(F.col("w") >= prune))


def preservation(a: DataFrame, b: DataFrame, id_col: str, k: int) -> DataFrame:
    """Share of each row's neighbours that both spaces agree on, averaged."""
    both = a.select(id_col, "nbr").join(b.select(id_col, "nbr"), [id_col, "nbr"]).groupBy(id_col).agg(F.count("*").alias("s"))
    return (a.select(id_col).distinct().join(both, id_col, "left")
            .agg(F.count("*").alias("n"), (F.sum(F.coalesce("s", F.lit(0))) / (F.count("*") * F.lit(float(k)))).alias("preserved")))


def lof(neigh: DataFrame, id_col: str) -> DataFrame:
    """Local outlier factor from a neighbour table."""
    kd = neigh.groupBy(id_col).agg(F.max("dist").alias("kd"))
    reach = neigh.join(kd.select(F.col(id_col).alias("nbr"), "kd"), "nbr").withColumn("reach", F.greatest("kd", "dist"))
    lrd = reach.groupBy(id_col).agg((1 / F.greatest(F.avg("reach"), F.lit(1e-12))).alias("lrd"))
    j = (neigh.join(lrd.select(F.col(id_col).alias("nbr"), F.col("lrd").alias("lrd_n")), "nbr")
         .groupBy(id_col).agg(F.avg("lrd_n").alias("m")))
    return j.join(lrd, id_col).select(id_col, (F.col("m") / F.col("lrd")).alias("lof"))

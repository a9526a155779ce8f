"""Clusterings of many resamples, cluster numbers and starts in the same passes.

A repeat gives every stratum a multiplicity. It has its own scaling and leading components, from the merged moments of its strata, and
every (repeat, K, start) its own centres. Rows are staged once with the multiplicities of their stratum and stay in their tasks: a pass
adds up 1, y and yy' by cluster for all fits, so only sums are shuffled, and the next centres go to the tasks. What the driver holds is
repeats x starts x clusters numbers, set by the arguments and not by the rows. A fit that has settled leaves the passes.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import stage
from . import agreement, linalg

CHUNK = 2048  # rows scored at a time in a task; the scores of one fit stay in a core's cache
LEAST_PARTS, PART_ROWS = 32, 16384  # of the staged rows
MASK = (1 << 64) - 1


@dataclass
class Resamples:
    """Staged rows (id, v, w, h) and the fitted components of each repeat; the last one is the full table."""
    rows: DataFrame
    mean: np.ndarray  # repeats x dimensions
    load: np.ndarray  # repeats x dimensions x components

    @property
    def count(self):
        return len(self.mean)


def resamples(df: DataFrame, id_col: str, vec: str, stratum: str, picked: DataFrame, repeats: int, n_pc: int) -> Resamples:
    """``picked``: (rep, stratum, w) with repeats 0.. and multiplicities. Rows without a vector are left out; rows without a stratum are
    in the full table only. Repeats are standardised and turned to components by the moments of their own rows."""
    zero = F.array_repeat(F.lit(0).cast("short"), repeats)
    drawn = F.map_from_entries(F.collect_list(F.struct(F.col("rep").cast("int").alias("rep"), "w")))
    name = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))  # no stratum has a name of its own
    weights = picked.groupBy("rep", name.alias("s")).agg(F.sum("w").cast("short").alias("w")).groupBy("s").agg(drawn.alias("m"))
    weights = weights.select("s", F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: F.coalesce(F.try_element_at("m", r), F.lit(0).cast("short"))).alias("w"))
    one = F.array(F.lit(1).cast("short"))
    rows = df.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), name.alias("s"), F.col(vec).cast("array<double>").alias("v"))
    rows = rows.join(stage(weights), "s", "left").select("id", "s", "v", F.concat(F.coalesce("w", zero), one).alias("w"), F.xxhash64("id").alias("h"))
    rows = stage(rows)
    # every row meets every repeat: few rows are much work too, and one file would be one task
    rows = stage(rows.repartition(max(LEAST_PARTS, -(-rows.count() // PART_ROWS))))
    by_stratum = linalg.moments(rows.select("s", "v"), "v", "s")
    weighted = by_stratum.join(rows.select("s", "w").distinct(), F.col("k") == F.col("s"))

    def partial(batches):
        acc: dict = {}
        for b in batches:
            for t in b.itertuples():
                for r in np.flatnonzero(t.w):
                    part = (t.n * t.w[r], t.mean, np.asarray(t.m2) * t.w[r])
                    acc[r] = linalg._merge([acc[r], part] if r in acc else [part])
        yield pd.DataFrame([(int(r), n, mu.tolist(), m.ravel().tolist()) for r, (n, mu, m) in acc.items()], columns=["rep", "n", "mean", "m2"])

    def model(pdf):
        m = linalg.decompose(*linalg._merge(zip(pdf["n"], pdf["mean"], pdf["m2"])))
        return pd.DataFrame([(int(pdf["rep"].iloc[0]), m.mean.tolist(), (m.loadings[:, :n_pc] / m.scale[:, None]).ravel().tolist())], columns=["rep", "mean", "load"])

    fits = weighted.select("n", "mean", "m2", "w").mapInPandas(partial, "rep long, n double, mean array<double>, m2 array<double>")
    got = {r["rep"]: r for r in fits.groupBy("rep").applyInPandas(model, "rep long, mean array<double>, load array<double>").collect()}
    if len(got) <= repeats:
        raise ValueError(f"{repeats + 1 - len(got)} repeats have no rows")
    mean = np.array([got[r]["mean"] for r in range(repeats + 1)])
    return Resamples(rows, mean, np.array([got[r]["load"] for r in range(repeats + 1)]).reshape(*mean.shape, -1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _smaller(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b[:, :1] < a[:, :1], b, a)


def _gather(data: Resamples, active: list[int], begin, combine=np.add) -> DataFrame:
    """(rep, sums): ``begin(x, h)`` takes a chunk of rows and gives a function of (repeat, components, weights) to a table of numbers;
    tables of a repeat are combined inside tasks first, then over tasks."""
    mean, load = data.mean, data.load

    def out(acc):
        flat = pa.array([a.ravel() for a in acc.values()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int64()), pa.array([a.shape[1] for a in acc.values()], pa.int32()), flat], ["rep", "wide", "sums"])

    def scan(batches):
        acc: dict = {}
        for b in batches:
            if not len(b):
                continue
            x, w, h = _matrix(b.column("v")), _matrix(b.column("w")).astype(float), b.column("h").to_numpy().view(np.uint64)
            for at in range(0, len(x), CHUNK):
                part = slice(at, at + CHUNK)
                work = begin(x[part], h[part])
                for r in active:
                    got = work(r, (x[part] - mean[r]) @ load[r], w[part, r])
                    acc[r] = combine(acc[r], got) if r in acc else got
        yield out(acc)

    def merge(batches):
        acc: dict = {}
        for b in batches:
            for r, wide, sums in zip(b.column("rep").to_pylist(), b.column("wide").to_pylist(), b.column("sums")):
                got = sums.values.to_numpy().reshape(-1, wide)
                acc[r] = combine(acc[r], got) if r in acc else got
        yield out(acc)

    schema = "rep long, wide int, sums array<double>"
    return data.rows.select("v", "w", "h").mapInArrow(scan, schema).repartition("rep").mapInArrow(merge, schema)


def _tables(df: DataFrame) -> dict[int, np.ndarray]:
    return {r["rep"]: np.array(r["sums"]).reshape(-1, r["wide"]) for r in df.collect()}


def _uniform(h: np.ndarray, *parts: int) -> np.ndarray:
    """A number in (0, 1] for each row hash and the parts: rounds of the 64-bit finaliser of splitmix (fixed constants)."""
    x = h.copy()
    for p in parts:
        x = x + np.uint64((p + 1) * 0x9E3779B97F4A7C15 & MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(float) + 1) / 2**53


def seeds(data: Resamples, most: int, starts: int, seed: int) -> np.ndarray:
    """repeats x starts x ``most`` seeds: each drawn with probability proportional to weight times squared distance from those before it,
    as the first of an exponential race, so one pass finds the next seed of all repeats. The seeds of K are the first K."""
    reps, d = range(data.count), data.load.shape[2]
    found = np.zeros((data.count, starts, 0, d))
    for step in range(most):
        at = found

        def begin(x, h):
            def work(r, y, w):
                rows = []
                for s in range(starts):
                    far = ((y[:, None, :] - at[r, s]) ** 2).sum(2).min(1) if step else np.ones(len(y))
                    with np.errstate(divide="ignore"):
                        key = np.where(w * far > 0, -np.log(_uniform(h, seed, r, s, step)) / (w * far), np.inf)
                    i = int(key.argmin())
                    rows.append([key[i], *y[i]])
                return np.array(rows)
            return work

        got = _tables(_gather(data, list(reps), begin, _smaller))
        new = np.stack([got[r] for r in reps])
        # fewer distinct rows than seeds: the first seed again, whose cluster then stays empty
        pick = np.where(np.isfinite(new[:, :, :1]), new[:, :, 1:], found[:, :, 0] if step else new[:, :, 1:])
        found = np.concatenate([found, pick[:, :, None, :]], axis=2)
    return found


def _terms(y: np.ndarray) -> np.ndarray:
    """1, y and the products of its components: scores of centres and of normal densities are linear in these."""
    i, j = np.triu_indices(y.shape[1])
    return np.column_stack([np.ones(len(y)), y, y[:, i] * y[:, j]])


def centre_scores(centers: np.ndarray) -> np.ndarray:
    """Coefficients of -|y - c|^2 / 2, but for |y|^2."""
    k, d = centers.shape
    return np.column_stack([-(centers ** 2).sum(1) / 2, centers, np.zeros((k, d * (d + 1) // 2))])


def normal_scores(share: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Coefficients of the log of share times normal density."""
    d = mean.shape[1]
    i, j = np.triu_indices(d)
    inv = np.linalg.inv(cov)
    lin = np.einsum("kij,kj->ki", inv, mean)
    with np.errstate(divide="ignore"):
        const = np.log(share) - 0.5 * (np.linalg.slogdet(cov)[1] + d * np.log(2 * np.pi) + (lin * mean).sum(1))
    return np.column_stack([const, lin, -0.5 * inv[:, i, j] * np.where(i == j, 1, 2)])


def normals(sums: np.ndarray, ridge: float):
    """Shares, means and covariances from sums of the terms by component; an empty component keeps share zero."""
    d = int((np.sqrt(8 * sums.shape[1] + 1) - 3) / 2)
    n = np.maximum(sums[:, 0], 1e-300)
    mean = sums[:, 1:d + 1] / n[:, None]
    cov = np.zeros((len(sums), d, d))
    i, j = np.triu_indices(d)
    cov[:, i, j] = cov[:, j, i] = sums[:, d + 1:] / n[:, None] - mean[:, i] * mean[:, j]
    # a component of one place has no spread but for rounding
    cov[:, range(d), range(d)] = np.maximum(cov[:, range(d), range(d)], 0) + ridge
    return sums[:, 0] / sums[:, 0].sum(), mean, cov


def _sums(data: Resamples, fits: dict, hard: bool, products: bool = True) -> dict:
    """Sums of the terms by cluster of every fit, with a last row whose first number is the log-likelihood. ``fits``: (rep, ...) -> scores.

    Without ``products`` (nearest centres) only 1 and y are added up by cluster, and the last row begins with the sum of |y|^2 of all rows."""
    by_rep: dict = {}
    for f in fits:
        by_rep.setdefault(f[0], []).append(f)
    stacked = {r: (np.vstack([fits[f] for f in fs]), np.array([len(fits[f]) for f in fs])) for r, fs in by_rep.items()}
    linear = data.load.shape[2] + 1

    def begin(x, h):
        def work(r, y, w):
            coef, sizes = stacked[r]
            drawn = w > 0
            if not drawn.all():
                y, w = y[drawn], w[drawn]
            t = _terms(y) if products or not hard else np.column_stack([np.ones(len(y)), y])
            ends, tw = np.zeros((len(sizes), t.shape[1])), t * w[:, None]
            blocks = [slice(at, at + k) for at, k in zip(np.cumsum(sizes) - sizes, sizes)]
            # clusters of all fits below each other, rows side by side
            s = coef[:, :linear] @ t[:, :linear].T if hard else coef @ t.T
            for i, block in enumerate(blocks):
                part = s[block]
                top = part.max(0)
                if hard:
                    np.equal(part, top, out=part)
                else:
                    part -= top
                    np.exp(part, out=part)
                    tot = part.sum(0)
                    ends[i, 0] = (np.log(tot) + top) @ w
                    part /= tot
            sums = s @ tw
            if hard and sums[:, 0].sum() > w.sum() * len(sizes):  # a tie: the first cluster of a fit has the row
                for block in blocks:
                    s[block] = s[block].argmax(0) == np.arange(block.stop - block.start)[:, None]
                sums = s @ tw
            if not products:
                ends[:, 0] = ((y * y).sum(1) @ w)
            return np.vstack([sums, ends])
        return work

    got, out = _tables(_gather(data, list(by_rep), begin)), {}
    for r, fs in by_rep.items():
        sizes = stacked[r][1]
        for i, (f, at, k) in enumerate(zip(fs, np.cumsum(sizes) - sizes, sizes)):
            out[f] = np.vstack([got[r][at:at + k], got[r][sizes.sum() + i]])
    return out


def kmeans(data: Resamples, ks, starts: int = 4, seed: int = 1, tol: float = 1e-4, most: int = 300):
    """{(rep, k): (centres, settled)}: Lloyd steps of all fits together, the best start of each. A fit has settled when its centres move by
    less than ``tol`` of the mean variance of its components; ``settled`` is false after ``most`` passes."""
    first = seeds(data, max(ks), starts, seed)
    centers = {(r, k, s): first[r, s, :k].copy() for r in range(data.count) for k in ks for s in range(starts)}
    todo, cost, settled = set(centers), {}, set()
    d = data.load.shape[2]
    for _ in range(most):
        got = _sums(data, {f: centre_scores(centers[f]) for f in sorted(todo)}, True, products=False)
        for f, sums in got.items():
            squares, sums = sums[-1, 0], sums[:-1]
            n = sums[:, 0]
            new = np.where(n[:, None] > 0, sums[:, 1:] / np.maximum(n, 1)[:, None], centers[f])
            every = sums.sum(0)
            spread = (squares / every[0] - ((every[1:] / every[0]) ** 2).sum()) / d
            if ((new - centers[f]) ** 2).sum() <= tol * spread:
                settled.add(f)
            centers[f], cost[f] = new, float(squares - ((sums[:, 1:] ** 2).sum(1) / np.maximum(n, 1e-300)).sum())
        todo -= settled
        if not todo:
            break
    best = {(r, k): min(((r, k, s) for s in range(starts)), key=lambda f: (round(cost[f], 9), f)) for r in range(data.count) for k in ks}
    return {f: (centers[b], b in settled) for f, b in best.items()}


def mixtures(data: Resamples, begun: dict, ridge: float = 1e-5, tol: float = 1e-3, most: int = 100):
    """{(rep, k): (shares, means, covariances, settled)}: full covariances, begun at the clusters of the k-means fits ``begun``. A fit has
    settled when its mean log-likelihood grows by less than ``tol``."""
    got = _sums(data, {f: centre_scores(c) for f, (c, _) in begun.items()}, True)
    model = {f: normals(s[:-1], ridge) for f, s in got.items()}
    todo, last, settled = set(model), {}, set()
    for _ in range(most):
        got = _sums(data, {f: normal_scores(*model[f]) for f in sorted(todo)}, False)
        for f, s in got.items():
            ll = s[-1, 0] / s[:-1, 0].sum()
            if f in last and abs(ll - last[f]) < tol:
                settled.add(f)
            last[f], model[f] = ll, normals(s[:-1], ridge)
        todo -= settled
        if not todo:
            break
    return {f: (*m, f in settled) for f, m in model.items()}


def against_full(data: Resamples, scores: dict, ks) -> DataFrame:
    """(rep, k, a, b, n_ab): drawn rows by their cluster in the full fit and in the repeat, counted once each. ``scores``: (rep, k) -> coefficients."""
    ks, full = list(ks), data.count - 1
    mean, load = data.mean[full], data.load[full]

    def begin(x, h):
        t = _terms((x - mean) @ load)
        own = {k: (t @ scores[full, k].T).argmax(1) for k in ks}

        def work(r, y, w):
            t, out = _terms(y), []
            for k in ks:
                cell = own[k] * k + (t @ scores[r, k].T).argmax(1)
                out.append(np.bincount(cell, weights=(w > 0).astype(float), minlength=k * k))
            return np.concatenate(out)[:, None]
        return work

    layout = [(k, a, b) for k in ks for a in range(k) for b in range(k)]
    names = data.rows.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(layout)], "pos int, k int, a int, b int")
    cells = _gather(data, list(range(full)), begin).select("rep", F.posexplode("sums").alias("pos", "n_ab")).where("n_ab > 0")
    return cells.join(F.broadcast(names), "pos").select("rep", "k", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "n_ab")  # a row for each pair of clusters


def stability(df: DataFrame, id_col: str, vec: str, stratum: str, picked: DataFrame, repeats: int, ks, n_pc: int = 3, starts: int = 4, seed: int = 1) -> DataFrame:
    """Per (algorithm, rep, k): agreement of the clusters of a repeat with those of the full table, on the drawn rows.

    Adjusted Rand, normalised information (arithmetic), share of rows under the best one-to-one map, least and mean matched Jaccard, and whether
    the fit of the repeat settled. K-means takes the best of ``starts``; the mixture begins at its clusters."""
    ks = sorted(ks)
    data = resamples(df, id_col, vec, stratum, picked, repeats, n_pc)
    flat = kmeans(data, ks, starts, seed)
    mixed = mixtures(data, flat)
    runs = {"kmeans": ({f: centre_scores(m[0]) for f, m in flat.items()}, flat), "mixture": ({f: normal_scores(*m[:3]) for f, m in mixed.items()}, mixed)}
    keys, cells, ends = ["algorithm", "rep", "k"], None, []
    for name, (scores, fits) in runs.items():
        part = against_full(data, scores, ks).withColumn("algorithm", F.lit(name))
        cells = part if cells is None else cells.unionByName(part)
        ends += [(name, r, k, bool(m[-1])) for (r, k), m in fits.items() if r < repeats]
    cells = stage(cells)
    settled = df.sparkSession.createDataFrame(ends, "algorithm string, rep long, k int, settled boolean")
    jac = agreement.optimal_matching(cells, keys, "jaccard").groupBy(*keys).agg(F.min("jaccard").alias("min_jaccard"), F.avg("jaccard").alias("mean_jaccard"))
    share = agreement.optimal_matching(cells, keys).groupBy(*keys).agg(F.sum("share").alias("mapped_accuracy"))
    out = agreement.agreement(cells, keys).join(jac, keys).join(share, keys).join(settled, keys)
    return out.select(*keys, "n", "ari", "nmi_mean", "mapped_accuracy", "min_jaccard", "mean_jaccard", "settled")

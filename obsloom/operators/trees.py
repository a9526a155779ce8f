"""Tree ensembles grown level by level: extremely randomised trees and multiclass histogram boosting.

All trees, classes and train-test splits of a level share one pass over the rows: a task routes its rows through the trees so far and
passes on sums by (tree, node, candidate); the best candidate of each node is found in Spark, and the driver only receives it. What the
driver and the tasks hold are the trees, whose size the parameters bound."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import draw, draw_unit
from ..runtime import stage

DIGITS = 9  # scores that agree to so many digits are ties, which feature and threshold decide


@dataclass
class Trees:
    """Binary trees of bounded depth. Node 1 is the root, the children of node i are 2 i and 2 i + 1; a leaf has feature -1."""
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, n: int, depth: int, width: int) -> "Trees":
        size = 2 << depth
        return cls(depth, np.full((n, size), -1, np.int32), np.zeros((n, size)), np.zeros((n, size, width)))

    def route(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The node of each row in each tree: rows x trees."""
        every = np.arange(len(self.feature))
        node = np.ones((len(x), len(every)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth if depth is None else depth):
            f = self.feature[every, node]
            node = np.where(f >= 0, 2 * node + (x[rows, f] > self.threshold[every, node]), node)
        return node

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.value[np.arange(len(self.feature)), self.route(x)]


@dataclass
class TreeModel:
    """Scores the columns ``block`` of a vector."""
    classes: list
    block: slice
    trees: list = field(default_factory=list)
    prior: np.ndarray | None = None  # margins before the first round of boosting; None for an average of leaf shares

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum(t.values(x)[:, :, 0] for t in self.trees)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = x[:, self.block]
        if self.prior is None:
            return self.trees[0].values(x).mean(1)
        m = self.margins(x)
        e = np.exp(m - m.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def prepare(df: DataFrame, vec: str, label: str, fold: str) -> tuple[DataFrame, list, dict]:
    """Staged rows (x, y, fold) without null vectors and labels, the classes in order, and the rows of each (fold, class)."""
    rows = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(
        F.col(vec).cast("array<double>").alias("x"), F.col(label).cast("string").alias("class"), F.col(fold).cast("string").alias("fold"))
    counts = {(r["fold"], r["class"]): r["count"] for r in rows.groupBy("fold", "class").count().collect()}
    classes = sorted({c for _, c in counts})
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class")) - 1
    return stage(rows.select("x", code.cast("int").alias("y"), "fold")), classes, counts


def class_counts(counts: dict, classes: list, held: set) -> np.ndarray:
    return np.array([sum(n for (f, k), n in counts.items() if k == c and f not in held) for c in classes], float)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pass(rows: DataFrame, splits: dict, start: Callable, work: Callable, finish: Callable, schema: str) -> DataFrame:
    """One pass over the training rows of every split: ``work(state, split, x, y, more)`` for each batch, ``finish(state)`` gives
    the arrays that the task passes on."""
    names = schema.replace(",", " ").split()[::2]

    def run(batches):
        state = start()
        for batch in batches:
            if not len(batch):
                continue
            x, y = _matrix(batch.column("x")), batch.column("y").to_numpy()
            fold = np.array(batch.column("fold").to_pylist(), object)
            more = _matrix(batch.column("margin")) if "margin" in batch.schema.names else None
            for s, (held, block) in enumerate(splits.values()):
                mine = ~np.isin(fold, list(held))
                if mine.any():
                    work(state, s, x[mine][:, block], y[mine], None if more is None else more[mine])
        columns = finish(state)
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return rows.mapInArrow(run, schema)


# ---- extremely randomised trees -----------------------------------------------------------------------------


def extra_trees(rows: DataFrame, classes: list, counts: dict, splits: dict, n_trees: int, depth: int, seed: int, candidates: int | None = None,
                least: int = 2) -> dict:
    """split -> TreeModel. ``splits``: name -> (held-out folds, block of the vector). Classes weigh the same.

    At every node ``candidates`` features (the root of their number if not given) that vary in the node are drawn by hash, each with a
    threshold drawn between its bounds in the node; the split with the least weighted Gini impurity stays. Nodes with fewer than ``least``
    rows, one class, or no varying feature are leaves, and so are those at ``depth``. Two passes a level, whatever the number of trees."""
    names, k = list(splits), len(classes)
    blocks = [b for _, b in splits.values()]
    forests = [Trees.empty(n_trees, depth, k) for _ in names]
    weights = [1 / np.maximum(class_counts(counts, classes, held), 1) for held, _ in splits.values()]
    for forest, (held, _) in zip(forests, splits.values()):
        forest.value[:, 1] = (class_counts(counts, classes, held) > 0) / max((class_counts(counts, classes, held) > 0).sum(), 1)
    active = [(s, t, 1) for s in range(len(names)) for t in range(n_trees)]
    for level in range(depth):
        if not active:
            break
        at = [np.full(f.feature.shape, -1, np.int64) for f in forests]
        for i, (s, t, node) in enumerate(active):
            at[s][t, node] = i
        wide = max(b.stop - b.start for b in blocks)
        drawn = _drawn(_bounds(rows, splits, forests, at, len(active), wide, level), active, names, candidates, seed, rows.sparkSession)
        most = max((r["c"] for r in drawn), default=-1) + 1
        if not most:
            break
        feature, threshold = np.zeros((len(active), most), np.int64), np.full((len(active), most), np.nan)
        for r in drawn:
            feature[r["id"], r["c"]], threshold[r["id"], r["c"]] = r["feature"], r["threshold"]
        active = _grow(_best(_sides(rows, splits, forests, at, feature, threshold, k, level), active, weights), active, forests, feature, threshold, weights, k, least)
    return {n: TreeModel(classes, b, [f]) for n, b, f in zip(names, blocks, forests)}


def _bounds(rows, splits, forests, at, n, wide, level) -> DataFrame:
    """(id, feature, lo, hi) of the rows in each active node."""
    def work(state, s, x, y, _):
        node = forests[s].route(x, level)
        ids = at[s][np.arange(node.shape[1]), node].ravel()
        row = np.repeat(np.arange(len(x)), node.shape[1])[ids >= 0]
        ids = ids[ids >= 0]
        by = np.argsort(ids, kind="stable")
        if len(by):
            found, first = np.unique(ids[by], return_index=True)
            values, p = x[row[by]], x.shape[1]
            state[0][found, :p] = np.minimum(state[0][found, :p], np.minimum.reduceat(values, first))
            state[1][found, :p] = np.maximum(state[1][found, :p], np.maximum.reduceat(values, first))

    def finish(state):
        i, f = np.nonzero(state[0] <= state[1])
        return i, f, state[0][i, f], state[1][i, f]

    part = _pass(rows, splits, lambda: (np.full((n, wide), np.inf), np.full((n, wide), -np.inf)), work, finish, "id long, feature long, lo double, hi double")
    return part.groupBy("id", "feature").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _drawn(bounds: DataFrame, active: list, names: list, candidates: int | None, seed: int, spark) -> list:
    """Candidates of each node: id, c (their order), feature, threshold."""
    named = spark.createDataFrame([(i, f"{names[s]}|{t}|{node}") for i, (s, t, node) in enumerate(active)], "id long, name string")
    b = bounds.join(named, "id")
    key = lambda what: draw(seed, F.col("name"), F.col("feature"), what)
    share = F.sqrt(F.count("*").over(Window.partitionBy("id")).cast("double"))
    b = b.withColumn("want", F.lit(candidates) if candidates else F.greatest(F.floor(share), F.lit(1))).where("lo < hi")
    b = b.withColumn("c", F.row_number().over(Window.partitionBy("id").orderBy(key("order"), "feature")) - 1).where("c < want")
    # the upper bound itself would leave the right side empty
    at = F.col("lo") + draw_unit(key("threshold")) * (F.col("hi") - F.col("lo"))
    return b.select("id", "c", "feature", F.when(at < F.col("hi"), at).otherwise(F.col("lo")).alias("threshold")).collect()


def _sides(rows, splits, forests, at, feature, threshold, k, level) -> DataFrame:
    """(id, c, side, class, n) of every candidate."""
    most = feature.shape[1]

    def work(state, s, x, y, _):
        node = forests[s].route(x, level)
        ids = at[s][np.arange(node.shape[1]), node].ravel()
        row = np.repeat(np.arange(len(x)), node.shape[1])[ids >= 0]
        ids = ids[ids >= 0]
        for c in range(most):
            known = ~np.isnan(threshold[ids, c])
            i, r = ids[known], row[known]
            right = x[r, feature[i, c]] > threshold[i, c]
            code, n = np.unique(((i * most + c) * 2 + right) * k + y[r], return_counts=True)
            state[code] += n

    def finish(state):
        code = np.flatnonzero(state)
        return code // (2 * k * most), code // (2 * k) % most, code // k % 2, code % k, state[code]

    part = _pass(rows, splits, lambda: np.zeros(len(feature) * most * 2 * k, np.int64), work, finish, "id long, c long, side long, class long, n long")
    return part.groupBy("id", "c", "side", "class").agg(F.sum("n").alias("n"))


def _best(sides: DataFrame, active: list, weights: list) -> list:
    """Rows of the best candidate of each node."""
    spark = sides.sparkSession
    split_of = spark.createDataFrame([(i, a[0]) for i, a in enumerate(active)], "id long, split long")
    each = spark.createDataFrame([(s, c, float(v)) for s, w in enumerate(weights) for c, v in enumerate(w)], "split long, class long, weight double")
    own = sides.join(split_of, "id").join(F.broadcast(each), ["split", "class"])  # splits x classes
    share = F.col("n") * F.col("weight")
    side = own.groupBy("id", "c", "side").agg(F.sum(share).alias("w"), F.sum(share * share).alias("q"), F.collect_list(F.struct("side", "class", "n")).alias("cells"))  # a cell a class
    each_c = side.groupBy("id", "c").agg(F.round(F.sum(F.col("q") / F.col("w")), DIGITS).alias("score"), F.flatten(F.collect_list("cells")).alias("cells"))
    best = each_c.groupBy("id").agg(F.min_by(F.struct("c", "cells"), F.struct(-F.col("score"), F.col("c"))).alias("best"))
    return best.select("id", "best.c", F.explode("best.cells").alias("cell")).select("id", "c", "cell.side", "cell.class", "cell.n").collect()


def _grow(best: list, active: list, forests: list, feature, threshold, weights, k: int, least: int) -> list:
    """Puts the chosen splits into the trees; the children that may be split further."""
    found: dict = {}
    for r in best:
        found.setdefault((r["id"], r["c"]), np.zeros((2, k)))[r["side"], r["class"]] = r["n"]
    below = []
    for (i, c), n in sorted(found.items()):
        s, t, node = active[i]
        forests[s].feature[t, node], forests[s].threshold[t, node] = feature[i, c], threshold[i, c]
        for side in (0, 1):
            child, share = 2 * node + side, n[side] * weights[s]
            forests[s].value[t, child] = share / share.sum()
            if n[side].sum() >= least and (n[side] > 0).sum() > 1:
                below.append((s, t, child))
    return below


# ---- boosting ---------------------------------------------------------------------------------------------------


def bin_edges(rows: DataFrame, splits: dict, bins: int) -> dict:
    """split -> cut points of each of its features, at even shares of the training rows; fewer where values repeat."""
    grid = [i / bins for i in range(1, bins)]
    out = {}
    for name, (held, block) in splits.items():
        got = rows.where(~F.col("fold").isin(list(held))).agg(*[F.percentile_approx(F.col("x")[j], grid, 20 * bins) for j in range(block.start, block.stop)]).first()
        out[name] = [np.unique(np.array(g or [], float)) for g in got]
    return out


def boosting(rows: DataFrame, classes: list, counts: dict, splits: dict, edges: dict, rounds: int, depth: int, rate: float = 0.06, least: int = 20,
             ridge: float = 0.0, balanced: bool = False, restage: int = 10) -> dict:
    """split -> TreeModel. Softmax over the classes: each round adds a tree a class, fitted to gradients and second derivatives that are
    summed by (class, node, feature, bin), one aggregate a level for all classes and splits.

    ``edges``: cut points per split and feature; a split goes right above one. A leaf holds ``least`` rows at least and moves its margin by
    ``rate`` times the Newton step with ``ridge`` on the second derivatives. Margins start at the log shares of the classes and are written
    to the shared folder every ``restage`` rounds, so that a pass runs through the trees since then only."""
    names, k = list(splits), len(classes)
    n_of = {n: class_counts(counts, classes, held) for n, (held, _) in splits.items()}
    weight = {n: (c.sum() / (k * np.maximum(c, 1)) if balanced else np.ones(k)) for n, c in n_of.items()}
    share = {n: np.maximum(c * weight[n], 1e-12) / (c * weight[n]).sum() for n, c in n_of.items()}
    models = {n: TreeModel(classes, splits[n][1], [], np.log(share[n])) for n in names}
    now = stage(rows.withColumn("margin", F.array(*[F.lit(float(v)) for n in names for v in models[n].prior])))
    recent: dict = {n: [] for n in names}
    for turn in range(rounds):
        grown = {n: Trees.empty(k, depth, 1) for n in names}
        open_nodes = {(s, c, 1) for s in range(len(names)) for c in range(k)}
        for level in range(depth):
            if not open_nodes:
                break
            best = _best_bins(_histograms(now, splits, recent, grown, open_nodes, edges, weight, k, level), least, ridge).collect()
            open_nodes = _apply(best, names, grown, edges, rate, ridge, level == depth - 1)
        for n in names:
            models[n].trees.append(grown[n])
            recent[n].append(grown[n])
        if (turn + 1) % restage == 0 and turn + 1 < rounds:
            now, recent = stage(_moved(now, splits, recent, k)), {n: [] for n in names}
    return models


def _margins(x, base, trees, s, k):
    m = base[:, s * k:(s + 1) * k]
    return m + sum(t.values(x)[:, :, 0] for t in trees) if trees else m


def _moved(now: DataFrame, splits: dict, recent: dict, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if len(batch):
                x, base = _matrix(batch.column("x")), _matrix(batch.column("margin"))
                own = np.hstack([_margins(x[:, block], base, recent[n], s, k) for s, (n, (_, block)) in enumerate(splits.items())])
                yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), batch.column("fold"), pa.array(list(own), pa.list_(pa.float64()))], ["x", "y", "fold", "margin"])

    return now.mapInArrow(run, "x array<double>, y int, fold string, margin array<double>")


def _histograms(now, splits, recent, grown, open_nodes, edges, weight, k, level) -> DataFrame:
    """(split, class, node, feature, bin, g, h, n) over the open nodes."""
    names = list(splits)
    index = {key: i for i, key in enumerate(sorted(open_nodes))}
    keys = np.array(sorted(open_nodes))
    at = np.full((len(names), k, 2 << level), -1, np.int64)
    for (s, c, node), i in index.items():
        at[s, c, node] = i
    wide = max(b.stop - b.start for _, b in splits.values())
    bins = max(len(e) for own in edges.values() for e in own) + 1

    def work(state, s, x, y, base):
        name = names[s]
        m = _margins(x, base, recent[name], s, k)
        e = np.exp(m - m.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        w = weight[name][y][:, None]
        g, h = w * (p - np.eye(k)[y]), w * p * (1 - p)
        node = grown[name].route(x, level)
        place = np.column_stack([np.searchsorted(edges[name][f], x[:, f], side="left") for f in range(x.shape[1])])
        for c in range(k):
            ids = at[s, c][node[:, c]]
            own = ids >= 0
            for f in range(x.shape[1]):
                code = (ids[own] * wide + f) * bins + place[own, f]
                for j, v in enumerate((g[own, c], h[own, c], None)):
                    state[j] += np.bincount(code, v, minlength=state.shape[1])

    def finish(state):
        code = np.flatnonzero(state[2])
        i = code // (wide * bins)
        return keys[i, 0], keys[i, 1], keys[i, 2], code // bins % wide, code % bins, state[0][code], state[1][code], state[2][code].astype(np.int64)

    part = _pass(now, splits, lambda: np.zeros((3, len(index) * wide * bins)), work, finish,
                 "split long, class long, node long, feature long, bin long, g double, h double, n long")
    # a task passes on a row a bin already; dealt by feature, the sums and the running sums after them need no further shuffle
    return part.repartition("split", "class", "node", "feature").groupBy("split", "class", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])


def _best_bins(hist: DataFrame, least: int, ridge: float) -> DataFrame:
    """The best cut of each node, with the sums of both sides; ``cut`` is null where no cut leaves enough rows and gains."""
    one = Window.partitionBy("split", "class", "node", "feature")
    upto = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = hist.select("split", "class", "node", "feature", "bin", *[F.sum(v).over(upto).alias("l" + v) for v in "ghn"], *[F.sum(v).over(one).alias(v) for v in "ghn"])
    gain = lambda g, h: F.try_divide(g * g, h + ridge)
    up: Column = gain(F.col("lg"), F.col("lh")) + gain(F.col("g") - F.col("lg"), F.col("h") - F.col("lh")) - gain(F.col("g"), F.col("h"))
    ok = (F.col("ln") >= least) & (F.col("n") - F.col("ln") >= least) & (up > 1e-9)
    c = c.withColumn("gain", F.when(ok, F.round(up, DIGITS)))
    cut = F.struct("feature", "bin", "lg", "lh")
    return c.groupBy("split", "class", "node").agg(F.min_by(cut, F.when(F.col("gain").isNotNull(), F.struct(-F.col("gain"), F.col("feature"), F.col("bin")))).alias("cut"),
                                                   F.max_by("g", -F.col("feature")).alias("g"), F.max_by("h", -F.col("feature")).alias("h"))


def _apply(best: list, names: list, grown: dict, edges: dict, rate: float, ridge: float, last: bool) -> set:
    step = lambda g, h: -rate * g / max(h + ridge, 1e-12)
    below = set()
    for r in best:
        name, c, node, cut = names[r["split"]], r["class"], r["node"], r["cut"]
        trees = grown[name]
        trees.value[c, node, 0] = step(r["g"], r["h"])
        if cut is not None:
            trees.feature[c, node], trees.threshold[c, node] = cut["feature"], edges[name][cut["feature"]][cut["bin"]]
            trees.value[c, 2 * node, 0] = step(cut["lg"], cut["lh"])
            trees.value[c, 2 * node + 1, 0] = step(r["g"] - cut["lg"], r["h"] - cut["lh"])
            if not last:
                below |= {(r["split"], c, 2 * node), (r["split"], c, 2 * node + 1)}
    return below

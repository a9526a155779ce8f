"""Split plans, out-of-fold tables and metrics.

Splits are tables keyed by (split, stratum). Discriminant models are built from class moments
per fold, so every training set is a merge of fold moments and no fold is scanned twice.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import draw
from ..runtime import stage
from . import linalg, order
from .resample import repeats


# ---- split plans ------------------------------------------------------------------------------

def group_shuffle_splits(df: DataFrame, stratum: str, label: str, n_splits: int, test_share: float, seed: int, tries: int) -> DataFrame:
    """First ``n_splits`` seeds whose hash-ordered stratum hold-out has every class on both sides; an error if ``tries`` seeds hold fewer."""
    table = df.groupBy(stratum, label).agg(F.count("*").alias("n"))
    strata = repeats(table.select(stratum).distinct(), range(tries))
    pos = order.hash_rank(strata, ["rep"], draw(seed, F.col("rep"), F.col(stratum)), stratum)
    side = pos.select("rep", stratum, (F.col("pos") <= F.ceil(F.lit(test_share) * F.col("n") - 1e-9)).alias("is_test"))
    cover = side.join(table, stratum).groupBy("rep", label).agg(F.max("is_test").alias("t"), F.min("is_test").alias("f"))
    k = table.agg(F.countDistinct(label).alias("k")).withColumn("one", F.lit(1))
    ok = cover.groupBy("rep").agg(F.count_if(F.col("t") & ~F.col("f")).alias("covered")).withColumn("one", F.lit(1)).join(k, "one").where("covered = k")
    found = ok.count()
    if found < n_splits:
        raise ValueError(f"{found} of {tries} seeds give a split with every class on both sides, {n_splits} are needed")
    chosen = ok.select("rep", (F.row_number().over(Window.orderBy("rep")) - 1).cast("long").alias("split")).where(F.col("split") < n_splits)
    return side.join(chosen, "rep").select("split", F.col("rep").alias("seed"), stratum, "is_test")


def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int, seed: int) -> DataFrame:
    pos = order.hash_rank(df, [label], draw(seed, F.col(id_col)), id_col)
    return pos.withColumn("fold", (F.col("pos") - 1) % k).drop("pos", "n")


def stratified_group_kfold(df: DataFrame, stratum: str, label: str, k: int) -> DataFrame:
    """Whole strata to folds: inside each majority class, strata go by size in snake order."""
    t = df.groupBy(stratum, label).agg(F.count("*").alias("n"))
    s = t.groupBy(stratum).agg(F.sum("n").alias("size"), F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("major"))
    s = s.withColumn("key", F.struct(-F.col("size"), F.col(stratum)))
    start = order.cumulative_counts(s.withColumn("neg", -F.col("size")).groupBy("major", "neg").agg(F.count("*").alias("c")), ["major"], "neg")
    tie = order.cumulative_counts(s.withColumn("neg", -F.col("size")).withColumn("c", F.lit(1).cast("long")), ["major", "neg"], stratum)
    pos = tie.select(stratum, "size", "major", "neg", F.col("cum").alias("inside")).join(
        start.select("major", "neg", (F.col("cum") - F.col("c")).alias("before")), ["major", "neg"])
    p = (F.col("before") + F.col("inside") - 1) % (2 * k)
    return pos.select(stratum, "size", "major", F.when(p < k, p).otherwise(2 * k - 1 - p).alias("fold"))


def covering_group_folds(df: DataFrame, stratum: str, label: str, k: int) -> DataFrame:
    """(stratum, fold): ``stratified_group_kfold`` where that gives every class to every fold, else ``deal_by_class``.

    The snake starts anew in each majority class, so with few strata a class the last folds can stay empty."""
    named = df.where(F.col(stratum).isNotNull() & F.col(label).isNotNull())
    cells = stage(named.groupBy(stratum, label).agg(F.count("*").alias("n")))
    snake = stage(stratified_group_kfold(named, stratum, label, k).select(stratum, "fold"))
    if snake.join(cells, stratum).select("fold", label).distinct().count() == k * cells.select(label).distinct().count():
        return snake
    held: dict = {}
    for r in cells.collect():  # strata x classes
        held.setdefault(r[stratum], {})[r[label]] = r["n"]
    return df.sparkSession.createDataFrame(list(deal_by_class(held, k).items()), snake.schema)


def deal_by_class(held: dict, k: int) -> dict:
    """stratum -> fold, for ``held``: stratum -> {class: rows}. While a fold lacks a class, the one in the fewest strata left goes first, to the
    fold where the stratum brings most classes that it lacks. The rest go by size to the fold with the fewest rows of their majority class."""
    left, have, folds = dict(held), [{} for _ in range(k)], {}
    rows = lambda f: sum(have[f].values())

    def put(s, f):
        folds[s] = f
        for c, n in left.pop(s).items():
            have[f][c] = have[f].get(c, 0) + n

    while True:
        count: dict = {}
        for cells in left.values():
            for c in cells:
                count[c] = count.get(c, 0) + 1
        open_classes = [c for c in count if any(c not in h for h in have)]
        if not open_classes:
            break
        rare = min(open_classes, key=lambda c: (count[c], c))
        brings = lambda s, f: sum(c not in have[f] for c in left[s])
        put(*min(((s, f) for s in left if rare in left[s] for f in range(k) if rare not in have[f]),
                 key=lambda t: (-brings(*t), rows(t[1]), -sum(left[t[0]].values()), t[1], t[0])))
    for s in sorted(left, key=lambda s: (-sum(left[s].values()), s)):
        major = min(left[s], key=lambda c: (-left[s][c], c))
        put(s, min(range(k), key=lambda f: (have[f].get(major, 0), rows(f), f)))
    return folds


def held_out_pairs(strata: DataFrame, col: str) -> DataFrame:
    """All unordered pairs of batches to hold out together (a table of batches, not of rows).

    Each batch lists the later positions and meets them by an equi-join on the position.
    """
    s = strata.select(col).distinct().withColumn("c", F.lit(1).cast("long"))
    at = order.cumulative_counts(s, [], col).select(col, F.col("cum").alias("i"), "n")
    a = at.where("i < n").select(F.col(col).alias("a"), F.explode(F.sequence(F.col("i") + 1, F.col("n"))).alias("i"))
    return a.join(at.select(F.col(col).alias("b"), "i"), "i").select("a", "b")


# ---- metrics from a confusion table -------------------------------------------------------------

def confusion(oof: DataFrame, keys=(), levels=None) -> DataFrame:
    """Counts over the complete truth x prediction grid of the given levels."""
    c = oof.groupBy(*keys, "truth", "pred").agg(F.count("*").alias("n"))
    if not levels:
        return c
    lv = F.array(*[F.lit(v) for v in levels])
    base = c.select(*keys).distinct() if keys else oof.sparkSession.range(1).drop("id")
    grid = base.withColumn("truth", F.explode(lv)).withColumn("pred", F.explode(lv))
    return grid.join(c, [*keys, "truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def class_metrics(conf: DataFrame, keys=(), weight: str = "n") -> DataFrame:
    """Per class precision, recall, specificity, F1 with the overall figures on each row.

    Every cell gives its count to its truth and to its prediction; the rest are windows over one
    row per class.
    """
    keys = list(keys)
    k = keys or ["_k"]
    c = conf if keys else conf.withColumn("_k", F.lit(1))
    w, hit, zero = F.col(weight).cast("double"), F.col("truth") == F.col("pred"), F.lit(0.0)
    two = F.array(F.struct(F.col("truth").alias("cls"), w.alias("actual"), zero.alias("predicted"), F.when(hit, w).otherwise(zero).alias("tp")),
                  F.struct(F.col("pred").alias("cls"), zero.alias("actual"), w.alias("predicted"), zero.alias("tp")))
    m = c.select(*k, F.explode(two).alias("s")).groupBy(*k, "s.cls").agg(*[F.sum(f"s.{x}").alias(x) for x in ("actual", "predicted", "tp")])
    key = Window.partitionBy(*k)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), zero)
    tp, act, pre, n = (F.col(x) for x in ("tp", "actual", "predicted", "_n"))
    m = m.withColumns({"_n": F.sum("actual").over(key), "_hit": F.sum("tp").over(key), "_ap": F.sum(act * pre).over(key),
                       "_aa": F.sum(act * act).over(key), "_pp": F.sum(pre * pre).over(key)})
    m = (m.withColumn("precision", ratio(tp, pre)).withColumn("recall", ratio(tp, act)).withColumn("f1", ratio(2 * tp, act + pre))
         .withColumn("specificity", ratio(n - act - pre + tp, n - act)))
    h, ap = F.col("_hit"), F.col("_ap")
    m = m.withColumns({"accuracy": ratio(h, n), "balanced_accuracy": F.avg(F.when(act > 0, F.col("recall"))).over(key), "macro_f1": F.avg("f1").over(key),
                       "mcc": ratio(h * n - ap, F.sqrt(n * n - F.col("_pp")) * F.sqrt(n * n - F.col("_aa"))), "kappa": ratio(h * n - ap, n * n - ap)})
    return m.select(*keys, "cls", act.cast("long").alias("support"), "precision", "recall", "specificity", "f1",
                    "accuracy", "balanced_accuracy", "macro_f1", "mcc", "kappa")


def overall(conf: DataFrame, keys=(), weight="n") -> DataFrame:
    cols = ["accuracy", "balanced_accuracy", "macro_f1", "mcc", "kappa"]
    m = class_metrics(conf, keys, weight)
    return m.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols]) if keys else m.agg(*[F.max(c).alias(c) for c in cols])


def calibration(oof: DataFrame, probs: dict, bins: int = 10) -> DataFrame:
    """Reliability bins (last one closed) with log-loss, multiclass Brier and ECE on each row.

    ``probs``: class -> probability column; ``pred`` and ``truth`` are columns of ``oof``.
    """
    p_true = F.coalesce(*[F.when(F.col("truth") == c, F.col(p)) for c, p in probs.items()])
    conf = F.greatest(*[F.col(p) for p in probs.values()])
    brier = sum((F.pow(F.col(p) - (F.col("truth") == c).cast("double"), F.lit(2.0)) for c, p in probs.items()), F.lit(0.0))
    x = oof.select(conf.alias("conf"), (F.col("truth") == F.col("pred")).cast("double").alias("hit"),
                   (-F.log(F.greatest(p_true, F.lit(1e-15)))).alias("ll"), brier.alias("br"))
    b = x.withColumn("bin", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1))).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.avg("hit").alias("accuracy"), F.sum("ll").alias("ll"), F.sum("br").alias("br"))
    allb = Window.partitionBy(F.lit(1))  # at most ``bins`` rows
    n = F.sum("n").over(allb)
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("mean_conf"))
    return b.select("bin", "n", "mean_conf", "accuracy", (F.sum("ll").over(allb) / n).alias("log_loss"), (F.sum("br").over(allb) / n).alias("brier"),
                    (F.sum(gap).over(allb) / n).alias("ece"))


def one_vs_rest(oof: DataFrame, probs: dict) -> DataFrame:
    """(cls, score, y) rows; micro-average rows share the class name 'micro'."""
    s = F.array(*[F.struct(F.lit(c).alias("cls"), F.col(p).alias("score"), (F.col("truth") == c).cast("long").alias("y")) for c, p in probs.items()])
    rows = oof.select(F.explode(s).alias("s")).select("s.*")
    return rows.withColumn("cls", F.explode(F.array("cls", F.lit("micro"))))


def roc_pr(scores: DataFrame) -> DataFrame:
    """One row per distinct threshold and class: cumulative counts, rates, precision."""
    v = scores.select("cls", (-F.col("score")).alias("neg"), "y").groupBy("cls", "neg").agg(F.count("*").alias("c"), F.sum("y").alias("y"))
    c = order.cumulative_counts(v, ["cls"], "neg", weight=["c", "y"])
    tp, n_at, n_pos = F.col("cum_y"), F.col("cum"), F.col("n_y")
    n_neg = F.col("n") - n_pos
    return c.select("cls", (-F.col("neg")).alias("threshold"), tp.alias("tp"), (n_at - tp).alias("fp"), F.try_divide(tp, n_pos).alias("tpr"),
                    F.try_divide(n_at - tp, n_neg).alias("fpr"), (tp / n_at).alias("precision"), F.col("y").alias("d_tp"),
                    (F.col("c") - F.col("y")).alias("d_fp"), n_pos.alias("n_pos"), n_neg.alias("n_neg"))


def auc_ap(curve: DataFrame) -> DataFrame:
    """AUC (ties count half) and average precision from the curve; macro row is the class mean."""
    won = F.col("d_fp").cast("double") * (F.col("tp") - F.col("d_tp") / 2)
    per = curve.groupBy("cls").agg(F.try_divide(F.sum(won), F.max("n_pos").cast("double") * F.max("n_neg")).alias("auc"),
                                   (F.sum(F.col("d_tp") * F.col("precision")) / F.max("n_pos")).alias("ap"))
    own = F.when(F.col("cls") != "micro", F.lit("macro"))
    both = per.withColumn("out", F.explode(F.array_compact(F.array(F.col("cls"), own))))
    return both.groupBy(F.col("out").alias("cls")).agg(F.avg("auc").alias("auc"), F.avg("ap").alias("ap"))


# ---- discriminant models from moments -----------------------------------------------------------

@dataclass
class LDA:
    """Linear discriminant with covariance shrunk towards a scaled identity."""
    classes: list
    coef: np.ndarray
    bias: np.ndarray

    def log_scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef.T + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.log_scores(x)
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit_lda(parts: list, shrink: float, columns=None) -> LDA:
    """``parts``: (class, n, mean, centred cross-products); parts of one class are merged first.

    Equal class priors, which is what balanced class weights mean here.
    """
    by = {}
    for c, n, mu, m2 in parts:
        by.setdefault(c, []).append((n, mu, m2))
    classes = sorted(by)
    merged = [linalg._merge(by[c]) for c in classes]
    idx = np.arange(len(merged[0][1])) if columns is None else np.asarray(columns)
    means = np.stack([m[1][idx] for m in merged])
    pooled = sum(m[2][np.ix_(idx, idx)] for m in merged) / max(sum(m[0] for m in merged) - len(classes), 1)
    pooled = (1 - shrink) * pooled + shrink * np.trace(pooled) / len(idx) * np.eye(len(idx))
    inv = np.linalg.pinv(pooled)
    coef = means @ inv
    full = np.zeros((len(classes), len(merged[0][1])))
    full[:, idx] = coef
    return LDA(classes, full, -0.5 * (coef * means).sum(1))


def project_parts(parts: list, pca: linalg.PCA, k: int) -> list:
    """The same class moments on the first k components."""
    w = pca.loadings[:, :k] / pca.scale[:, None]
    return [(c, n, (np.asarray(mu) - pca.mean) @ w, w.T @ m2 @ w) for c, n, mu, m2 in parts]


def parts_pca(parts: list) -> linalg.PCA:
    """Scaling and components of the training rows that the class moments cover."""
    return linalg.decompose(*linalg._merge([p[1:] for p in parts]))


def fit_pca_lda(parts: list, shrink: float, k: int, columns=None) -> LDA:
    """Scaling, components and discriminant from the same training moments, as one linear map of the unscaled vector."""
    pca = parts_pca(parts)
    m = fit_lda(project_parts(parts, pca, k), shrink, columns)
    coef = m.coef @ (pca.loadings[:, :k] / pca.scale[:, None]).T
    return LDA(m.classes, coef, m.bias - coef @ pca.mean)


def parts_from_means(total: np.ndarray, means: list) -> list:
    """Class moments from (class, n, mean) and the centred cross-products of all rows, which no relabelling changes."""
    n, mu = sum(c[1] for c in means), sum(c[1] * c[2] for c in means) / sum(c[1] for c in means)
    within = total - sum(c * np.outer(m - mu, m - mu) for _, c, m in means)
    # a discriminant only uses the sum over the classes, so each takes its share of the rows
    return [(c, k, m, within * (k / n)) for c, k, m in means]


def fold_class_moments(df: DataFrame, vec: str, label: str, fold: str) -> list:
    """[(fold, class, n, mean, m2)] from one job; folds x classes matrices of p x p."""
    rows = linalg.moments(df.withColumn("_k", F.concat_ws("\t", fold, label)), vec, "_k").collect()
    out = []
    for r in rows:
        f, c = r["k"].split("\t", 1)
        p = len(r["mean"])
        out.append((f, c, r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(p, p)))
    return out


def require_classes(moments: list, folds) -> None:
    """Error unless every fold has every class among its held-out rows and among the others."""
    every = {m[1] for m in moments}
    for f in map(str, folds):
        for side, have in (("held-out", {m[1] for m in moments if m[0] == f}), ("training", {m[1] for m in moments if m[0] != f})):
            if have != every:
                raise ValueError(f"fold {f}: no {side} row of class {', '.join(sorted(every - have))}")


def training_parts(moments: list, held_out) -> list:
    held = set(map(str, held_out))
    return [(c, n, mu, m2) for f, c, n, mu, m2 in moments if f not in held]


def held_out_components(df: DataFrame, vec: str, pcas: dict, where: dict, k: int, out: str = "pc") -> DataFrame:
    """One row per row and split that holds it out, with the components fitted without the held-out folds.

    ``pcas``: split -> PCA; ``where``: split -> set of held-out folds; adds ``split`` and ``out``."""
    maps = {s: (p.loadings[:, :k] / p.scale[:, None], p.mean) for s, p in pcas.items()}
    by_fold = {}
    for s in sorted(where):
        for f in where[s]:
            by_fold.setdefault(f, []).append(s)

    @F.pandas_udf("array<struct<split:string,x:array<double>>>")
    def run(v: pd.Series, fold: pd.Series) -> pd.Series:
        res = [[] for _ in range(len(v))]
        for f in fold.unique():
            at = np.flatnonzero((fold == f).to_numpy())
            x = np.stack(v.iloc[at].to_numpy())
            for s in by_fold.get(f, []):
                w, c = maps[s]
                for i, row in zip(at, ((x - c) @ w).tolist()):
                    res[i].append({"split": s, "x": row})
        return pd.Series(res, dtype=object)

    keep = [c for c in df.columns if c != vec]
    return (df.select(*keep, F.explode(run(F.col(vec), F.col("fold").cast("string"))).alias("_s"))
            .select(*keep, F.col("_s.split").alias("split"), F.col("_s.x").alias(out)))


def permutation_drops(held: DataFrame, id_col: str, vec: str, label: str, models: dict, p: int, reps, seed: int) -> DataFrame:
    """(split, feature, baseline, drop): fall of the balanced accuracy when a feature's values are re-dealt inside the held-out rows.

    ``held`` has one row per (split, id) with ``vec`` of length p; ``models``: split -> model on ``vec``.
    Every (feature, repeat) variant is a key, so one job scores them all: rows x p x repeats."""
    base = held.select("split", F.col(id_col).alias("id"), F.col(label).alias("class"), F.col(vec).alias("x"))
    where = {s: {s} for s in models}

    def score(df, keys):
        s = score_models(df.withColumn("fold", F.col("split")), "x", models, "class", where)
        return overall(confusion(s, ["split", *keys]), ["split", *keys]).select("split", *keys, "balanced_accuracy")

    place = order.cumulative_counts(base.withColumn("c", F.lit(1).cast("long")), ["split"], "id")
    place = stage(place.select("split", "id", "class", F.col("cum").alias("pos"), "x"))
    # only places are dealt; a variant takes its one value from the row at its place, and the rest of the row at the end
    at = place.select("split", F.col("pos").alias("own"), "id")
    many = repeats(at, reps).withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    h = F.unhex(draw(seed, F.col("split"), F.col("rep"), F.col("feature"), F.col("id")))  # bytes sort as their hex digits do
    pos = order.hash_rank(many, ["split", "rep", "feature"], h, "id").select("split", "rep", "feature", "own", "pos")
    dealt = pos.join(place.select("split", "pos", F.col("x").alias("other")), ["split", "pos"])
    dealt = dealt.select("split", "rep", "feature", "own", F.element_at("other", F.col("feature") + 1).alias("other"))
    whole = dealt.join(place.select("split", F.col("pos").alias("own"), "class", "x"), ["split", "own"])
    swapped = whole.withColumn("x", F.transform("x", lambda v, i: F.when(i == F.col("feature"), F.col("other")).otherwise(v)))
    shuffled = score(swapped.select("split", "rep", "feature", "class", "x"), ["rep", "feature"])
    g = shuffled.groupBy("split", "feature").agg(F.avg("balanced_accuracy").alias("_shuffled"))
    b = score(base.select("split", "class", "x"), []).withColumnRenamed("balanced_accuracy", "baseline")
    return g.join(b, "split").select("split", "feature", "baseline", (F.col("baseline") - F.col("_shuffled")).alias("drop"))


def score_models(df: DataFrame, vec: str, models: dict, label: str, where=None) -> DataFrame:
    """Adds rows (model, pred, confidence, probabilities) for every model in one Arrow pass.

    ``where``: model -> set of folds it may score (its held-out folds); all folds when absent.
    """
    names = sorted(models)
    by_fold = {}
    for name in names if where else []:
        for f in where[name]:
            by_fold.setdefault(f, []).append(name)
    fields = "array<struct<model:string,pred:string,confidence:double,p:array<double>>>"

    @F.pandas_udf(fields)
    def run(v: pd.Series, fold: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(v))]
        for f in fold.unique():
            at = np.flatnonzero((fold == f).to_numpy())
            x = np.stack(v.iloc[at].to_numpy())
            for name in names if where is None else by_fold.get(f, []):
                m = models[name]
                p = m.probabilities(x)
                top = p.argmax(1)
                for i, t, row in zip(at, top, p.tolist()):
                    out[i].append({"model": name, "pred": m.classes[t], "confidence": row[t], "p": row})
        return pd.Series(out, dtype=object)

    keep = [c for c in df.columns if c != vec]
    return (df.select(*keep, F.explode(run(F.col(vec), F.coalesce(F.col("fold").cast("string"), F.lit("")))).alias("s"))
            .select(*keep, F.col(label).cast("string").alias("truth"), "s.model", "s.pred", "s.confidence", "s.p"))


def nested_cv(df: DataFrame, vec: str, label: str, outer: int, grid, k: int | None = None) -> tuple[DataFrame, list]:
    """Nested selection with three jobs: fold moments, inner scores, outer scores.

    With ``k`` every model scales and projects on k components of its own training rows.

    ``df`` has a ``fold`` column 0..outer-1. For outer fold o every other fold takes a turn as the
    inner hold-out. Returns the out-of-fold table and the chosen setting per outer fold.
    """
    folds = [str(i) for i in range(outer)]
    mom = fold_class_moments(df, vec, label, "fold")
    require_classes(mom, folds)
    fit = (lambda parts, g: fit_pca_lda(parts, g, k)) if k else fit_lda
    models, where = {}, {}
    for o in folds:
        for i in folds:
            if i != o:
                for g in grid:
                    models[f"{o}|{i}|{g}"] = fit(training_parts(mom, [o, i]), g)
                    where[f"{o}|{i}|{g}"] = {i}
    inner = score_models(df, vec, models, label, where)
    parts = F.split("model", r"\|")
    ba = overall(confusion(inner.withColumn("outer", parts[0]).withColumn("config", parts[2]), ["outer", "config"]), ["outer", "config"])
    best = {r["outer"]: r["config"] for r in ba.groupBy("outer").agg(F.min_by("config", F.struct(-F.round("balanced_accuracy", 9), F.col("config"))).alias("config")).collect()}
    final = {o: fit(training_parts(mom, [o]), float(best[o])) for o in folds}
    return score_models(df, vec, final, label, {o: {o} for o in folds}), sorted(best.items())

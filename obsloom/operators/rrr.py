"""Reduced-rank regression from joint moments of (x, y); rows are read once for the moments and once for scores."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import linalg


@dataclass
class RRR:
    x_mean: np.ndarray
    y_mean: np.ndarray
    full: np.ndarray
    axes: np.ndarray

    @property
    def coef(self):
        return self.full @ self.axes @ self.axes.T


def fit(mean: np.ndarray, m2: np.ndarray, px: int, rank: int) -> RRR:
    sxx, sxy = m2[:px, :px], m2[:px, px:]
    b = np.linalg.pinv(sxx) @ sxy
    val, vec = np.linalg.eigh(b.T @ sxx @ b)
    v = linalg.sign_rule(vec[:, np.argsort(val)[::-1][:rank]])
    return RRR(mean[:px], mean[px:], b, v)


def r2(model: RRR, n: float, mean: np.ndarray, m2: np.ndarray) -> float:
    """1 - SSE / SST of the rows behind (n, mean, m2), about the model's own training means."""
    px = len(model.x_mean)
    d = mean - np.concatenate([model.x_mean, model.y_mean])
    m = m2 + n * np.outer(d, d)
    c = model.coef
    sse = np.trace(m[px:, px:]) - 2 * np.trace(c.T @ m[:px, px:]) + np.trace(c.T @ m[:px, :px] @ c)
    return float(1 - sse / np.trace(m[px:, px:]))


def joint_moments(df: DataFrame, x: str, y: str, key: str | None = None):
    j = df.select(F.concat(F.col(x), F.col(y)).alias("xy"), *([key] if key else []))
    if key is None:
        return linalg.moments_one(j, "xy")
    out = {}
    for r in linalg.moments(j, "xy", key).collect():
        p = len(r["mean"])
        out[r["k"]] = (r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(p, p))
    return out


def scores(df: DataFrame, model: RRR, x: str, y: str) -> DataFrame:
    """Projections of both blocks on the shared axes."""
    d = linalg.project(df, x, model.full @ model.axes, model.x_mean, "x_score")
    return linalg.project(d, y, model.axes, model.y_mean, "y_score")


def cv_ranks(parts: dict, px: int, ranks) -> list:
    """Held-out R2 per (repeat, rank). ``parts``: 'rep/fold' -> moments; train = merge of the other folds."""
    rows = []
    for rep in sorted({k.split("/")[0] for k in parts}):
        folds = {k: v for k, v in parts.items() if k.split("/")[0] == rep}
        for rank in ranks:
            r = []
            for k, test in folds.items():
                n, mean, m2 = linalg._merge([v for q, v in folds.items() if q != k])
                r.append((test[0], r2(fit(mean, m2, px, rank), *test)))
            rows.append((int(rep), rank, float(sum(n * v for n, v in r) / sum(n for n, _ in r))))
    return rows


def center_by(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Subtract the class mean vector."""
    p = len(df.select(vec).first()[0])
    m = df.groupBy(group).agg(F.array(*[F.avg(F.col(vec)[j]) for j in range(p)]).alias("_m"))
    return df.join(m, group).withColumn(vec, F.zip_with(vec, "_m", lambda a, b: a - b)).drop("_m")

"""Tail probabilities as pandas UDFs, meant for result rows (one per feature or pair)."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)


def norm_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_sf(x: float, df: int) -> float:
    """Finite sums: Poisson terms for even df, half-integer terms plus erfc for odd df."""
    if not x > 0:
        return 1.0
    h = x / 2.0
    if df % 2 == 0:
        powers = np.arange(df // 2)
        total = 0.0
    else:
        powers = np.arange(1, (df - 1) // 2 + 1) - 0.5
        total = math.erfc(math.sqrt(h))
    logs = powers * math.log(h) - h - np.array([math.lgamma(k + 1) for k in powers])
    return min(1.0, total + float(np.exp(logs).sum()))


def _angle_integral(lo, hi, a, b):
    """Integral of the Beta(a, b) density between two angles, t = sin(angle)^2."""
    log_norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + math.log(2.0)
    edges = np.linspace(lo, hi, 25)
    half = np.diff(edges)[:, None] / 2
    th = edges[:-1, None] + half + half * _NODES[None, :]
    with np.errstate(divide="ignore"):
        lg = (2 * a - 1) * np.log(np.sin(th)) + (2 * b - 1) * np.log(np.cos(th))
    return float((np.exp(lg + log_norm) * _WEIGHTS[None, :] * half).sum())


def beta_upper(x: float, a: float, b: float) -> float:
    """1 - I_x(a, b), integrated over the window around the mode only."""
    if x <= 0:
        return 1.0
    if x >= 1:
        return 0.0
    at = math.asin(math.sqrt(x))
    mode = math.atan2(math.sqrt(max(2 * a - 1, 0.0)), math.sqrt(max(2 * b - 1, 0.0)))
    span = 14.0 / math.sqrt(2 * (a + b))
    if at >= mode:
        return min(1.0, _angle_integral(at, min(math.pi / 2, at + span), a, b))
    return max(0.0, 1.0 - _angle_integral(max(0.0, at - span), at, a, b))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_upper(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2) if f > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    return f_sf(t * t, 1.0, df)


def _solve(tail, p, hi=1.0):
    lo = 0.0
    while tail(hi) > p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > p else (lo, mid)
    return (lo + hi) / 2


def t_quantile(p: float, df: float) -> float:
    q = _solve(lambda t: t_two_sided(t, df) / 2, min(p, 1 - p))
    return q if p >= 0.5 else -q


def chi2_quantile(p: float, df: int) -> float:
    return _solve(lambda x: chi2_sf(x, df), 1 - p)


def _vec(fn, n):
    def run(*cols):
        out = [fn(*map(float, v)) if not any(pd.isna(x) for x in v) else None for v in zip(*cols)]
        return pd.Series(out, dtype="float64")

    if n == 1:
        def f1(a: pd.Series) -> pd.Series:
            return run(a)
        return F.pandas_udf(f1, "double")
    if n == 2:
        def f2(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)
        return F.pandas_udf(f2, "double")

    def f3(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)
    return F.pandas_udf(f3, "double")


def norm_two_sided_col(z):
    return _vec(norm_two_sided, 1)(z)


def chi2_sf_col(x, df):
    return _vec(lambda a, b: chi2_sf(a, int(b)), 2)(x, df)


def f_sf_col(f, d1, d2):
    return _vec(f_sf, 3)(f, d1, d2)


def t_two_sided_col(t, df):
    return _vec(t_two_sided, 2)(t, df)


def t_quantile_col(p, df):
    return _vec(t_quantile, 2)(p, df)

"""Column expressions; everything here stays inside whole-stage codegen."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Tokens that mean "missing" in raw text tables.
MISSING_TOKENS = ("", "none", "na", "nan", "null")
# Spellings that mean true.
TRUE_TOKENS = ("true", "t", "1", "yes")
# Star label limits, strictest first.
SIGNIFICANCE_STEPS = ((0.0001, "****"), (0.001, "***"), (0.01, "**"), (0.05, "*"))
# Fixed value: normal-consistent scale of the median absolute deviation.
MAD_Z = 0.67448975


def to_number(c) -> Column:
    """Text to DOUBLE; unparseable text, missing tokens, NaN give NULL."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(c.cast("string"))
    num = F.when(~F.lower(text).isin(*MISSING_TOKENS), text.try_cast("double"))
    return F.when(~F.isnan(num), num)


def nan_to_null(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def is_finite(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))


def truthy(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_TOKENS), F.lit(False))


def cascade(rules, default=None) -> Column:
    """First matching (condition, value) wins; a NULL condition does not match."""
    out = F.lit(default)
    for cond, value in reversed(list(rules)):
        out = F.when(cond, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def all_of(conds) -> Column:
    """Conjunction in which an unknown test counts as failed."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conds])


def within(c, lo=None, hi=None, lo_open=False, hi_open=False) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    tests = []
    if lo is not None:
        tests.append(c > lo if lo_open else c >= lo)
    if hi is not None:
        tests.append(c < hi if hi_open else c <= hi)
    return all_of(tests)


def stars(p) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return cascade([(p <= lim, lab) for lim, lab in SIGNIFICANCE_STEPS], "ns")


def clip(c, lo, hi) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def yeo_johnson(x: Column, lam: Column) -> Column:
    near0 = F.abs(lam) < 1e-8
    near2 = F.abs(lam - 2) < 1e-8
    pos = F.when(near0, F.log1p(x)).otherwise(F.expm1(lam * F.log1p(x)) / lam)
    neg = F.when(near2, -F.log1p(-x)).otherwise(-F.expm1((2 - lam) * F.log1p(-x)) / (2 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def draw(*parts) -> Column:
    """Repeatable pseudo-random hex key for a (seed, repeat, id) combination."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def draw_unit(key: Column) -> Column:
    """Uniform [0,1) number from the first 8 hex digits of a draw."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def chi2_sf_even(x: Column, df: int) -> Column:
    """Chi-square upper tail for an even number of degrees of freedom."""
    h, term, total = x / 2, F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * h / i
        total = total + term
    return F.exp(-h) * total


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def double_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])

"""Exact ranks, quantiles and draws without sorting a whole key in one task.

Rows are first reduced to distinct (key, value) counts. The distinct values are cut into
buckets whose number follows the counted rows, at approximate quantiles taken over all keys,
so even a key that owns most rows is spread over many tasks; bucket totals give the offset
of each bucket. The same plan serves every size; a table below one bucket has one bucket.
"""
from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import draw
from ..runtime import stage

ROWS_PER_BUCKET = 1_000_000
# Cut points the driver holds; beyond ROWS_PER_BUCKET times as many rows buckets grow and their sort spills.
MAX_CUTS = 65_536
SAMPLE_PER_CUT = 32


def same_keys(a: DataFrame, b: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on ``keys`` in which NULL equals NULL; ``b`` loses its key columns."""
    b = b.withColumnsRenamed({k: "_r_" + k for k in keys})
    on = [F.col(k).eqNullSafe(F.col("_r_" + k)) for k in keys]
    return a.join(b, on, how).drop(*["_r_" + k for k in keys])


def _proxy(df: DataFrame, value: str) -> Column:
    """A double that never decreases along the order of the value: NULL first, NaN last."""
    x = F.unix_date(value) if dict(df.dtypes)[value] == "date" else F.col(value)
    # +0.0 folds -0.0, which the search of Bucketizer would put beside 0.0
    x = x.cast("double") + F.lit(0.0)
    return F.when(x.isNull(), -math.inf).when(F.isnan(x), math.inf).otherwise(x)


def _spaced(values: list, want: int) -> list:
    """At most ``want - 1`` cut points, evenly spaced in the sorted list."""
    step = len(values) / want
    return sorted({values[int(i * step)] for i in range(1, want)} if step >= 1 else set(values))


def _text_bucket(df: DataFrame, value: str, n: int, want: int) -> Column:
    """Position of the text among cut points drawn by hash; found through a coarse, then a fine list."""
    share = min(1.0, want * SAMPLE_PER_CUT / n)
    drawn = df.where(F.col(value).isNotNull() & (F.pmod(F.xxhash64(value), F.lit(1 << 31)) < F.lit(int(share * (1 << 31)))))
    # encoded text sorts as Spark sorts it
    cuts = [c.decode() for c in _spaced(sorted(r[0].encode() for r in drawn.select(value).distinct().collect()), want)]
    if not cuts:
        return F.lit(0)
    wide = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i:i + wide] for i in range(0, len(cuts), wide)]
    upto = lambda cs: F.size(F.filter(cs, lambda c: c <= F.col(value)))
    first = upto(F.array(*[F.lit(g[0]) for g in groups]))
    fine = F.element_at(F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups]), F.greatest(first, F.lit(1)))
    return F.when(F.col(value).isNull() | (first == 0), 0).otherwise((first - 1) * wide + upto(fine))


def _bucketed(df: DataFrame, value: str, rows_per_bucket: int) -> DataFrame:
    """Adds ``_bucket``, which never decreases along the order of ``value``."""
    n = df.count()
    want = min(MAX_CUTS, math.ceil(n / rows_per_bucket))
    if want <= 1:
        return df.withColumn("_bucket", F.lit(0.0))
    if dict(df.dtypes)[value] == "string":
        return df.withColumn("_bucket", _text_bucket(df, value, n, want).cast("double"))
    df = df.withColumn("_bv", _proxy(df, value))
    cuts = df.agg(F.percentile_approx("_bv", [i / want for i in range(1, want)], max(1000, 8 * want))).first()[0] or []
    splits = sorted({c for c in cuts if math.isfinite(c)})
    if not splits:
        return df.withColumn("_bucket", F.lit(0.0)).drop("_bv")
    return Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="_bv", outputCol="_bucket").transform(df).drop("_bv")


def _running(df: DataFrame, keys, order, weights, peers: bool = False) -> DataFrame:
    """``df`` has a ``_bucket``. Adds ``cum`` (running weight in order) and ``n`` (total weight) per key; further
    weights get ``cum_<w>`` and ``n_<w>``. With ``peers`` rows that tie in the order share the running weight."""
    weights = [weights] if isinstance(weights, str) else list(weights)
    names = {w: ("cum", "n") if i == 0 else (f"cum_{w}", f"n_{w}") for i, w in enumerate(weights)}
    run = (Window.unboundedPreceding, 0)
    upto = lambda w: w.rangeBetween(Window.unboundedPreceding, Window.currentRow) if peers else w.rowsBetween(*run)
    by_key = Window.partitionBy(*keys)
    offsets = df.groupBy(*keys, "_bucket").agg(*[F.sum(w).alias("_w_" + w) for w in weights])
    offsets = offsets.withColumns({"_b_" + w: F.sum("_w_" + w).over(by_key.orderBy("_bucket").rowsBetween(*run)) - F.col("_w_" + w) for w in weights})
    offsets = offsets.withColumns({names[w][1]: F.sum("_w_" + w).over(by_key) for w in weights}).drop(*["_w_" + w for w in weights])
    inside = upto(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    out = same_keys(df.withColumns({names[w][0]: F.sum(w).over(inside) for w in weights}), offsets, [*keys, "_bucket"])
    return (out.withColumns({names[w][0]: F.col(names[w][0]) + F.col("_b_" + w) for w in weights})
            .drop("_bucket", *["_b_" + w for w in weights]))


def cumulative_counts(counts: DataFrame, keys, value: str, weight="c", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``counts`` holds one row per (key, value); value ascending."""
    return _running(_bucketed(counts, value, rows_per_bucket), list(keys), [value], weight)


def positions(df: DataFrame, value: Column, ties, out: str = "position", total: str | None = None, run: str | None = None,
              rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds the 1-based place of every row of the whole table in the order (``value``, ties); no window holds the table.

    ``value`` is a number (NULL first). ``total``: also the number of rows; ``run``: also ``run_<c>`` and ``all_<c>``,
    the sum of that column up to the row and over all rows."""
    columns = df.columns
    # own names, as running sums add columns of theirs; staged, as the buckets need a count of their own
    d = df.withColumns({"_value": value, "_one": F.lit(1).cast("long")}).withColumnsRenamed({c: "_in_" + c for c in columns})
    weights = ["_one"] + (["_in_" + run] if run else [])
    d = _running(_bucketed(stage(d), "_value", rows_per_bucket), [], ["_value", *["_in_" + t for t in ties]], weights)
    more = [F.col("cum").alias(out)] + ([F.col("n").alias(total)] if total else [])
    more += [F.col(f"cum__in_{run}").alias(f"run_{run}"), F.col(f"n__in_{run}").alias(f"all_{run}")] if run else []
    return d.select(*[F.col("_in_" + c).alias(c) for c in columns], *more)


def value_counts(df: DataFrame, keys, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))


def avg_ranks(df: DataFrame, keys, value: str, **kw) -> DataFrame:
    """One row per distinct (key, value): count ``c``, tie-averaged rank ``rank``, total ``n``."""
    return (cumulative_counts(value_counts(df, keys, value), keys, value, **kw)
            .withColumn("rank", F.col("cum") - (F.col("c") - 1) / 2))


def rank_cells(df: DataFrame, keys, value: str, by, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per (key, value, by): ``c_by``, with the tie-averaged rank of the value inside the key."""
    by = [by] if isinstance(by, str) else list(by)
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, value, *by).agg(F.count("*").alias("c_by"))
    # tied cells share the running count, so no separate count per value has to be joined back
    ranked = _running(_bucketed(cells, value, rows_per_bucket), list(keys), [value], "c_by", peers=True)
    return (ranked.withColumn("c", F.sum("c_by").over(Window.partitionBy(*keys, value)))
            .withColumn("rank", F.col("cum") - (F.col("c") - 1) / 2))


def rank_rows(df: DataFrame, keys, value: str, out: str = "rank", **kw) -> DataFrame:
    """Adds the tie-averaged rank to every row (NULL value keeps a NULL rank)."""
    ranks = avg_ranks(df, keys, value, **kw).select(*keys, value, F.col("rank").alias(out))
    return df.join(ranks, [*keys, value], "left")


def quantile_columns(cum: DataFrame, keys, value: str, probs: dict) -> DataFrame:
    """Linear-interpolated quantiles from a cumulative count table, as plain sums."""
    def pick(pos):
        hit = (pos >= F.col("cum") - F.col("c")) & (pos < F.col("cum"))
        return hit

    exprs = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo = F.floor(at)
        frac = at - lo
        hi = F.least(lo + 1, F.col("n") - 1)
        low_v = F.max(F.when(pick(lo), F.col(value)))
        high_v = F.max(F.when(pick(hi), F.col(value)))
        exprs.append((low_v + F.max(frac) * (high_v - low_v)).alias(name))
    return cum.groupBy(*keys).agg(*exprs) if keys else cum.agg(*exprs)


def quantiles(df: DataFrame, keys, value: str, probs: dict, **kw) -> DataFrame:
    """Exact quantiles ``{column: probability}`` per key."""
    return quantile_columns(cumulative_counts(value_counts(df, keys, value), keys, value, **kw), keys, value, probs)


def hash_rank(df: DataFrame, keys, key_col: Column, ids, out: str = "pos", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """1-based position of each row in hash order inside its key; buckets are leading hex digits, as many as the rows ask for."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    digits, n = 0, df.count()
    while n > rows_per_bucket * 16 ** digits:
        digits += 1
    df = df.withColumn("_h", key_col).withColumn("_one", F.lit(1).cast("long")).withColumn("_bucket", F.substring("_h", 1, digits))
    return _running(df, list(keys), ["_h", *ids], "_one").withColumnRenamed("cum", out).drop("_h", "_one")


def shuffled_position(df: DataFrame, keys, id_col: str, seed, out: str = "pos", **kw) -> DataFrame:
    return hash_rank(df, keys, draw(seed, F.col(id_col)), id_col, out, **kw)

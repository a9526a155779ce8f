"""Exact order statistics, in one bucket and in many, on ties, NULLs and one hot key."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsloom.functions.scalar import draw
from obsloom.operators import order


def avg_rank(v):
    return pd.Series(v).rank(method="average").to_numpy()


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 3000
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b"], n))
    val = np.where(rng.random(n) < 0.4, 0.0, np.round(rng.lognormal(0, 3, n), 2)) * np.where(rng.random(n) < .5, -1, 1)
    pdf = pd.DataFrame({"id": np.arange(n), "feature": key, "value": val, "class": rng.choice(["x", "y", "z"], n)})
    pdf.loc[::97, "value"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return pdf, df


@pytest.mark.parametrize("kw", [{}, {"rows_per_bucket": 50}, {"rows_per_bucket": 1}])
def test_avg_ranks(data, kw):
    pdf, df = data
    got = order.rank_rows(df, ["feature"], "value", **kw).toPandas().set_index("id")["rank"].sort_index()
    want = pdf.groupby("feature")["value"].rank(method="average")
    assert np.allclose(got.to_numpy(float), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("kw", [{}, {"rows_per_bucket": 50}])
def test_quantiles_match_linear_interpolation(data, kw):
    pdf, df = data
    probs = {"p0": 0.0, "p1": .025, "p2": .5, "p3": .975, "p4": 1.0}
    got = order.quantiles(df, ["feature"], "value", probs, **kw).toPandas().set_index("feature")
    for k, g in pdf.groupby("feature"):
        assert np.allclose(got.loc[k, list(probs)].to_numpy(float), np.nanquantile(g["value"], list(probs.values())))


@pytest.mark.parametrize("kw", [{}, {"rows_per_bucket": 50}])
def test_rank_cells_sum_to_rank_sums(data, kw):
    pdf, df = data
    c = order.rank_cells(df, ["feature"], "value", "class", **kw)
    got = c.groupBy("feature", "class").agg(F.sum(F.col("c_by") * F.col("rank")).alias("s")).toPandas().set_index(["feature", "class"])["s"]
    p = pdf.dropna().copy()
    p["r"] = p.groupby("feature")["value"].rank()
    want = p.groupby(["feature", "class"])["r"].sum()
    assert np.allclose(got.sort_index(), want.sort_index())


def test_hash_rank_is_a_permutation(data):
    _, df = data
    got = order.hash_rank(df, ["feature"], draw(3, F.col("id")), "id", rows_per_bucket=10).toPandas()
    for _, g in got.groupby("feature"):
        assert sorted(g["pos"]) == list(range(1, len(g) + 1))
    other = order.hash_rank(df, ["feature"], draw(3, F.col("id")), "id").toPandas()
    assert got.set_index("id")["pos"].sort_index().equals(other.set_index("id")["pos"].sort_index())


def test_single_value_and_single_row(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("b", 1.0)], "feature string, value double")
    q = {r["feature"]: (r["lo"], r["m"]) for r in order.quantiles(df, ["feature"], "value", {"lo": .1, "m": .5}).collect()}
    assert q == {"a": (5.0, 5.0), "b": (1.0, 1.0)}


def test_text_order_in_buckets(spark):
    words = sorted({f"{a}{b}" for a in ("", "a", "é", "zz", "Stratum ") for b in range(40)}, key=lambda w: w.encode())
    df = spark.createDataFrame([("k", w, 1) for w in reversed(words)], "k string, w string, c long")
    got = order.cumulative_counts(df, ["k"], "w", rows_per_bucket=10).collect()
    assert {r["w"]: r["cum"] for r in got} == {w: i + 1 for i, w in enumerate(words)}


def test_text_with_a_common_prefix_spreads(spark):
    df = spark.range(3000).select(F.format_string("Customer#%09d", "id").alias("w"))
    sizes = order._bucketed(df, "w", 100).groupBy("_bucket").agg(F.count("*").alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi")).orderBy("_bucket").collect()
    assert len(sizes) == 30 and max(r["n"] for r in sizes) < 300
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))


def test_null_keys_nan_and_dates(spark):
    nan = float("nan")
    df = spark.createDataFrame([(None, 1.0), (None, nan), (None, 2.0), ("a", float("inf")), ("a", -0.0), ("a", nan)], "k string, x double")
    got = {(r["k"], str(r["x"])): r["rank"] for r in order.avg_ranks(df, ["k"], "x", rows_per_bucket=1).collect()}
    assert got == {(None, "1.0"): 1, (None, "2.0"): 2, (None, "nan"): 3, ("a", "0.0"): 1, ("a", "inf"): 2, ("a", "nan"): 3}
    days = spark.sql("SELECT 'k' AS k, date_add(DATE'2024-01-01', CAST(id AS INT)) AS d, 1L AS c FROM range(50)")
    got = order.cumulative_counts(days, ["k"], "d", rows_per_bucket=5).orderBy("d").collect()
    assert [r["cum"] for r in got] == list(range(1, 51))


@pytest.mark.parametrize("rows", [1_000_000, 9])
def test_positions_of_a_whole_table(spark, rows):
    data = [(i, None if i % 13 == 0 else float(i * 7 % 5), 1.0 + i, 4) for i in range(80)]
    df = spark.createDataFrame(data, "id long, x double, w double, n long")
    got = {r["id"]: r for r in order.positions(df, F.col("x"), ["id"], "at", "total", "w", rows_per_bucket=rows).collect()}
    want = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    run = 0.0
    for place, (i, _, w, _) in enumerate(want, 1):
        run += w
        assert (got[i]["at"], got[i]["total"], got[i]["n"]) == (place, 80, 4)
        assert abs(got[i]["run_w"] - run) < 1e-9 and abs(got[i]["all_w"] - sum(r[2] for r in data)) < 1e-9

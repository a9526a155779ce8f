"""Work per task follows the counted rows; every result is held against a direct computation."""
import numpy as np
import pandas as pd
import pytest

from obsloom import runtime
from obsloom.operators import assoc, order, transforms as T, validate as V
from obsloom.plans import bindings, catalog, registry, s15_mapping  # noqa: F401  catalog registers the queries


@pytest.fixture
def few_rows(monkeypatch):
    monkeypatch.setattr(runtime, "ROWS_PER_TASK", 100)


def test_ranks_of_frequent_and_rare_values_are_spread(spark, few_rows):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"id": range(3000), "a": rng.choice([0.0, -0.0, 1.0, 2.5], 3000), "b": rng.normal(size=3000).round(2), "c": rng.normal(size=3000)})
    p.loc[::7, "b"] = None
    p.loc[5, ["a", "b", "c"]] = None
    wide = assoc.ranked_wide(spark.createDataFrame(p).replace(float("nan"), None), "id", ["a", "b", "c"])
    assert wide.rdd.getNumPartitions() >= 90
    got = wide.toPandas().sort_values("id").reset_index(drop=True)
    for f in "abc":
        assert got[f].astype(float).equals(p[f].rank()), f


@pytest.fixture
def sparse_tables(spark, tmp_path):
    rng = np.random.default_rng(4)
    part = pd.DataFrame({"p_partkey": range(40), "p_brand": [f"B{i % 4}" for i in range(40)], "p_type": [f"T{i % 3}" for i in range(40)]})
    line = pd.DataFrame({"l_orderkey": rng.integers(0, 500, 2000), "l_partkey": rng.integers(0, 40, 2000), "l_quantity": rng.integers(1, 9, 2000).astype(float)})
    orders = pd.DataFrame({"o_orderkey": range(520), "o_orderstatus": rng.choice(list("FOP"), 520), "o_orderpriority": rng.choice(bindings.PRIORITIES, 520)})
    for name, t in (("part", part), ("lineitem", line), ("orders", orders)):
        spark.createDataFrame(t).write.parquet(str(tmp_path / f"{name}.parquet"))
    line = line.merge(part, left_on="l_partkey", right_on="p_partkey")
    c = line.assign(gene=line.p_brand + "_" + line.p_type).groupby(["l_orderkey", "gene"], as_index=False).l_quantity.sum()
    return str(tmp_path), c, orders


def test_sparse_counts_follow_the_rows_and_broadcast_no_ids(spark, few_rows, sparse_tables):
    path, c, orders = sparse_tables
    counts = bindings.counts(spark, path)
    assert counts.rdd.getNumPartitions() >= 20
    got = counts.toPandas().sort_values(["obs_id", "gene"])
    assert got.to_numpy().tolist() == c.sort_values(["l_orderkey", "gene"]).to_numpy().tolist()
    scan = registry.QUERIES["scan_sparse_counts"](spark, path)
    plan = scan._jdf.queryExecution().sparkPlan().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and ("LeftSemi" in x or "LeftAnti" in x)]
    got, want = scan.toPandas(), set(orders[orders.o_orderstatus == "F"].o_orderkey)
    assert len(got[got.part == "found"]) == c.l_orderkey.isin(want).sum()
    assert set(got[got.part == "missing"].obs_id) == want - set(c.l_orderkey)


def test_centroid_correlation_stays_where_the_observations_are(spark, few_rows, sparse_tables):
    path, c, orders = sparse_tables
    mapped = s15_mapping.mapped(spark, path)
    assert mapped.rdd.getNumPartitions() >= 15
    c = c.assign(logn=np.log1p(c.l_quantity / c.groupby("l_orderkey").l_quantity.transform("sum") * 10000))
    x = c.pivot(index="l_orderkey", columns="gene", values="logn").fillna(0).join(orders.set_index("o_orderkey"))
    genes = [g for g in x.columns if not g.startswith("o_")]
    cen = x[x.o_orderstatus != "P"].groupby("o_orderpriority")[genes].mean()
    best = {i: max(np.corrcoef(v, m)[0, 1] for m in cen.to_numpy()) for i, v in zip(x[x.o_orderstatus == "P"].index, x.loc[x.o_orderstatus == "P", genes].to_numpy())}
    got = mapped.toPandas().set_index("obs_id").r_best
    assert set(got.index) == set(best)
    assert max(abs(got[i] - r) for i, r in best.items()) < 1e-9


def test_power_fit_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)
    rng = np.random.default_rng(8)
    x = {"up": rng.gamma(2, 3, 400), "both": np.exp(rng.normal(size=400)) - 1.5, "flat": np.ones(50)}
    long = spark.createDataFrame([(f, float(v)) for f, vs in x.items() for v in vs] + [("up", None), (None, 3.0)], "feature string, value double").repartition(5)
    got = T.fit_yeo_johnson(long).toPandas().set_index("feature")
    assert set(got.index) == {"up", "both"}
    for f in got.index:
        def likelihood(lam, v=x[f]):
            a, b = np.where(v >= 0, v, 0), np.where(v < 0, -v, 0)
            y = np.where(v >= 0, np.log1p(a) if abs(lam) < 1e-8 else ((1 + a) ** lam - 1) / lam, -np.log1p(b) if abs(lam - 2) < 1e-8 else -((1 + b) ** (2 - lam) - 1) / (2 - lam))
            return -len(v) / 2 * np.log(y.var()) + (lam - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()
        assert abs(got.log_lik[f] - likelihood(got.lam[f])) < 1e-8
        assert got.log_lik[f] >= max(likelihood(v) for v in np.arange(-5, 5, .01)) - 1e-3


def test_dealt_places_carry_no_vectors(spark, monkeypatch):
    seen, plain = [], order.hash_rank
    monkeypatch.setattr(order, "hash_rank", lambda df, *a, **k: seen.append(df.columns) or plain(df, *a, **k))
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200)
    x = rng.normal(size=(200, 3)) + np.outer(y * 4, [1, 0, 0])
    held = spark.createDataFrame([("s", i, str(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "split string, id long, class string, pc array<double>")
    model = V.LDA(["0", "1"], np.array([[-4.0, 0, 0], [4.0, 0, 0]]), np.array([8.0, -8.0]))
    d = V.permutation_drops(held, "id", "pc", "class", {"s": model}, 3, range(4), 1).toPandas().set_index("feature")["drop"]
    assert seen and all(not {"x", "class"} & set(c) for c in seen)
    assert d[0] > 0.3 and d[1] == d[2] == 0

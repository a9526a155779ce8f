"""Tests, adjustments, moments and models against small direct computations."""
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsloom.functions import special
from obsloom.operators import agreement, contingency, linalg, multiplicity, rank_tests, resample, rrr, transforms, validate
from obsloom.plans import s13_validation


def test_tails():
    assert special.norm_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert special.chi2_sf(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-12)
    assert special.chi2_sf(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-12)
    assert special.t_two_sided(2.228138851964939, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.f_sf(3.0, 2, 10) == pytest.approx((1 + 2 * 3 / 10) ** -5, abs=1e-12)  # closed form for d1 = 2
    assert special.f_sf(0.5, 2, 1e6) == pytest.approx(math.exp(-0.5), rel=1e-5)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228138851964939, abs=1e-8)
    assert special.chi2_quantile(0.99, 3) == pytest.approx(11.344866730144373, abs=1e-8)


def test_adjustments(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.01]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    out = multiplicity.bh(multiplicity.holm(df, "p", ["i"]), "p", ["i"]).toPandas().sort_values("i")
    o = np.argsort(p, kind="stable")
    holm, bh = np.empty(5), np.empty(5)
    holm[o] = np.minimum(1, np.maximum.accumulate([(5 - i) * p[j] for i, j in enumerate(o)]))
    bh[o] = np.minimum.accumulate([p[j] * 5 / (i + 1) for i, j in reversed(list(enumerate(o)))])[::-1]
    assert np.allclose(out["p_holm"], holm) and np.allclose(out["p_bh"], bh)


def long_frame(spark, n=200, seed=5):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"obs_id": np.arange(n), "feature": "f", "class": rng.choice(["a", "b", "c"], n), "batch": rng.choice(["p", "q"], n),
                        "value": np.round(rng.normal(size=n), 1)})
    return pdf, spark.createDataFrame(pdf)


def test_cliffs_delta_and_u_by_counting(spark):
    pdf, df = long_frame(spark)
    s = rank_tests.rank_sums(df, ["feature"], "batch")
    r = rank_tests.mann_whitney(s, ["feature"], "batch", "p", "q", False).first()
    x, y = pdf[pdf.batch == "p"]["value"].to_numpy(), pdf[pdf.batch == "q"]["value"].to_numpy()
    d = np.sign(np.round(x[:, None] - y[None, :], 9))
    assert r["delta"] == pytest.approx(d.mean()) and r["u"] == pytest.approx(((d > 0) + 0.5 * (d == 0)).sum())


def test_all_tied_feature_gives_no_signal(spark):
    df = spark.createDataFrame([(i, "f", "ab"[i % 2], 1.0) for i in range(10)], "obs_id int, feature string, class string, value double")
    r = rank_tests.kruskal_wallis(rank_tests.rank_sums(df)).first()
    assert r["h"] == 0.0 and r["p"] == 1.0
    z = rank_tests.dunn(rank_tests.rank_sums(df)).first()
    assert z["z"] == 0.0 and z["p"] == 1.0


def test_rank_anova_against_least_squares(spark):
    pdf, df = long_frame(spark)
    pdf["r"] = pdf["value"].rank()
    g = pdf.assign(q=pdf["r"] ** 2).groupby(["feature", "batch", "class"]).agg(n=("r", "size"), s=("r", "sum"), q=("q", "sum")).reset_index()
    cells = spark.createDataFrame(g.rename(columns={"batch": "a", "class": "b"})).withColumn("n", F.col("n").cast("double"))
    got = contingency.rank_anova(cells).toPandas().set_index("term")

    def rss(cols):
        x = np.hstack([np.ones((len(pdf), 1))] + [pd.get_dummies(pdf[c], drop_first=True).to_numpy(float) for c in cols])
        b = np.linalg.lstsq(x, pdf["r"], rcond=None)[0]
        return ((pdf["r"] - x @ b) ** 2).sum()

    full = rss(["batch", "class"])
    assert got.loc["a", "ss"] == pytest.approx(rss(["class"]) - full) and got.loc["b", "ss"] == pytest.approx(rss(["batch"]) - full)
    assert got.loc["a", "df_res"] == len(pdf) - 4


def test_count_space_permutation_keeps_margins_and_null(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": np.arange(400), "a": rng.choice(["u", "v"], 400), "b": rng.choice(["x", "y", "z"], 400), "s": rng.choice(["1", "2"], 400)})
    df = spark.createDataFrame(pdf)
    cells = contingency.cell_counts(df, "a", "b", ["s"])
    null = contingency.permuted_cells(cells, "s", 200, 1)
    m = null.groupBy("rep", "a").agg(F.sum("n_ab").alias("n")).toPandas()
    assert (m.groupby("a")["n"].nunique() == 1).all() and m[m.a == "u"]["n"].iloc[0] == (pdf.a == "u").sum()
    by_count = contingency.chi_square(null, ["rep"]).toPandas()["v"].mean()
    rows = contingency.permuted_labels(df, "id", "b", "s", range(60), 2).join(df.select("id", "a"), "id")
    by_row = contingency.chi_square(contingency.cell_counts(rows, "a", "permuted", ["rep"]), ["rep"]).toPandas()["v"].mean()
    assert by_count == pytest.approx(by_row, rel=0.25)
    strata = rows.join(df.select("id", "s"), "id").groupBy("rep", "s", "permuted").count().toPandas()
    assert (strata.groupby(["s", "permuted"])["count"].nunique() == 1).all()


def test_matching_is_optimal(spark):
    rng = np.random.default_rng(7)
    for shape in ((3, 3), (4, 3), (3, 5)):
        t = rng.integers(1, 50, shape)
        cells = spark.createDataFrame([(f"r{i}", f"c{j}", float(t[i, j])) for i in range(shape[0]) for j in range(shape[1])], "a string, b string, n_ab double")
        got = agreement.optimal_matching(cells).agg(F.sum("n_match")).first()[0]
        small, big = (t, t.T)[shape[0] > shape[1]], None
        small = t if shape[0] <= shape[1] else t.T
        want = max(sum(small[i, p[i]] for i in range(small.shape[0])) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert got == want
    wide = rng.integers(0, 1000, (40, 40)).astype(float)
    picks = agreement.best_matching(wide)
    assert sorted(picks) == list(range(40))
    # no exchange of two or three columns improves it
    for i, j, k in itertools.permutations(range(40), 3):
        kept = wide[i, picks[i]] + wide[j, picks[j]] + wide[k, picks[k]]
        assert kept >= wide[i, picks[j]] + wide[j, picks[k]] + wide[k, picks[i]]


def test_matching_by_jaccard(spark):
    cells = spark.createDataFrame([("p", "x", 100.0), ("p", "y", 60.0), ("q", "x", 30.0)], "a string, b string, n_ab double")
    got = {(r["a"], r["b"]): round(r["jaccard"], 3) for r in agreement.optimal_matching(cells, by="jaccard").collect()}
    assert got == {("p", "y"): 0.375, ("q", "x"): 0.231}


def test_moments_and_pca(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 1e4
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>").repartition(5)
    n, mean, m2 = linalg.moments_one(df, "v")
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(m2 / 299, np.cov(x.T))
    m = linalg.fit_pca(df, "v")
    val = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert np.allclose(m.variance, val)
    assert (m.loadings[np.abs(m.loadings).argmax(0), range(4)] > 0).all()


def test_robust_distance_finds_planted_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3))
    x[:20] += 12
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    out = linalg.robust_distance(df, "v")[0].toPandas()
    assert out[out.id < 20]["outlier"].all() and out[out.id >= 20]["outlier"].mean() < 0.02


def test_rrr_full_rank_is_least_squares(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(200, 5))
    y = x @ rng.normal(size=(5, 3)) + rng.normal(size=(200, 3))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>")
    n, mean, m2 = rrr.joint_moments(df, "x", "y")
    full = rrr.fit(mean, m2, 5, 3)
    b = np.linalg.lstsq(x - x.mean(0), y - y.mean(0), rcond=None)[0]
    assert np.allclose(full.coef, b)
    r = [rrr.r2(rrr.fit(mean, m2, 5, k), n, mean, m2) for k in (1, 2, 3)]
    res = y - y.mean(0) - (x - x.mean(0)) @ b
    assert r[0] < r[1] < r[2] == pytest.approx(1 - (res ** 2).sum() / ((y - y.mean(0)) ** 2).sum())
    # held-out fold: coefficients from the rest, error about the training means
    parts = {f"0/{f}": linalg.moments_one(df.where("true").withColumn("xy", F.concat("x", "y")).limit(200).where(F.lit(True)), "xy") for f in range(1)}
    assert parts["0/0"][0] == 200


def test_split_params_never_see_the_held_out_fold(spark):
    rows = [(i, "f", float(v), i % 3) for i, v in enumerate([5, 6, -100, 7, 8, 9, 10, 11, 12, 500, 3, 4])]
    df = spark.createDataFrame(rows, "obs_id int, feature string, value double, fold int")
    p = {r["split"]: r for r in transforms.shift_sum_split_params(df).collect()}
    for s in range(3):
        train = np.array([v for _, _, v, f in rows if f != s])
        assert p[s]["lo"] == train.min() and p[s]["total"] == pytest.approx((train - train.min()).sum())
        t = np.log1p((train - train.min()) / (train - train.min()).sum() * 1e4)
        assert p[s]["mean"] == pytest.approx(t.mean()) and p[s]["sd"] == pytest.approx(t.std(ddof=1))
    z = {r["obs_id"]: r["z"] for r in transforms.apply_split_params(df, transforms.shift_sum_split_params(df)).collect()}
    assert z[2] == pytest.approx((0 - p[2]["mean"]) / p[2]["sd"])  # below the training minimum: clipped


def test_constant_column_and_null(spark):
    df = spark.createDataFrame([("c", 3.0), ("c", 3.0), ("c", None)], "feature string, value double")
    assert sorted(r["z"] is None or r["z"] for r in transforms.zscore(df, 1).collect()) == [0.0, 0.0, True]
    assert all(r["rz"] is None for r in transforms.robust_z(df).collect())
    with pytest.raises(Exception, match="not positive"):
        transforms.shift_sum(df).collect()


def test_yeo_johnson_fit(spark):
    rng = np.random.default_rng(11)
    v = rng.lognormal(0, 1, 500)
    df = spark.createDataFrame([("f", float(t)) for t in v], "feature string, value double")

    def ll(lam):
        y = np.log1p(v) if abs(lam) < 1e-8 else ((1 + v) ** lam - 1) / lam
        return -len(v) / 2 * np.log(y.var()) + (lam - 1) * np.log1p(v).sum()

    grid = np.linspace(-5, 5, 20001)
    r = transforms.fit_yeo_johnson(df).first()
    assert r["lam"] == pytest.approx(grid[np.argmax([ll(g) for g in grid])], abs=2e-3) and not r["at_boundary"]


def test_moment_models_equal_models_on_rows(spark):
    rng = np.random.default_rng(12)
    x, c, f = rng.normal(size=(300, 3)), rng.integers(0, 3, 300), rng.integers(0, 4, 300)
    x[np.arange(300), c] += 2
    df = spark.createDataFrame([(i, x[i].tolist(), str(c[i]), int(f[i])) for i in range(300)], "id int, v array<double>, class string, fold int")
    mom = validate.fold_class_moments(df, "v", "class", "fold")
    m = validate.fit_lda(validate.training_parts(mom, [0]), 0.0)
    tr = f != 0
    pooled = sum(((x[tr & (c == k)] - x[tr & (c == k)].mean(0)).T @ (x[tr & (c == k)] - x[tr & (c == k)].mean(0))) for k in range(3)) / (tr.sum() - 3)
    assert np.allclose(m.coef, np.stack([x[tr & (c == k)].mean(0) for k in range(3)]) @ np.linalg.inv(pooled))
    scored, best = validate.nested_cv(df, "v", "class", 4, [0.01, 0.5])
    out = scored.toPandas()
    assert sorted(out["id"]) == list(range(300)) and len(best) == 4 and (out["fold"].astype(str) == out["model"]).all()
    assert np.allclose([sum(p) for p in out["p"]], 1) and (out["truth"] == out["pred"]).mean() > 0.7


def test_splits_keep_strata_whole(spark):
    rng = np.random.default_rng(13)
    df = spark.createDataFrame([(int(i), int(s), "ab"[int(k)]) for i, (s, k) in enumerate(zip(rng.integers(0, 12, 300), rng.integers(0, 2, 300)))], "id int, stratum int, class string")
    s = validate.group_shuffle_splits(df, "stratum", "class", 3, 0.25, 1, 6).toPandas()
    assert (s.groupby(["split", "stratum"]).size() == 1).all() and (s.groupby("split")["is_test"].sum() == 3).all()
    k = validate.stratified_group_kfold(df, "stratum", "class", 4).toPandas()
    assert k["stratum"].is_unique and set(k["fold"]) == {0, 1, 2, 3}
    w = resample.bootstrap_weights(df, "stratum", range(5), 3).toPandas()
    assert (w.groupby("rep")["w"].sum() == 12).all()


def test_missing_class_in_every_split_rejects_all(spark):
    df = spark.createDataFrame([(i, i % 4, "rare" if i == 0 else "common") for i in range(40)], "id int, stratum int, class string")
    with pytest.raises(ValueError, match="0 of 8 seeds"):
        validate.group_shuffle_splits(df, "stratum", "class", 2, 0.25, 1, 8)


def _labelled(n=400, p=6, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 4, n)
    return rng.normal(size=(n, p)), y, np.arange(n) % 40


def _leaky(spark, x, y, stratum, leak):
    """Four folds of whole strata; the last column of fold 0 gets ``leak`` times the label."""
    rows = [(int(i), [float(t) for t in x[i]], str(y[i]), int(stratum[i])) for i in range(len(y))]
    df = spark.createDataFrame(rows, "id long, v array<double>, class string, stratum long")
    deal = {r["stratum"]: r["fold"] for r in validate.stratified_group_kfold(df, "stratum", "class", 4).collect()}
    rows = [(i, v[:-1] + [v[-1] + (leak * float(c) if deal[s] == 0 else 0.0)], c, s, deal[s]) for i, v, c, s in rows]
    return spark.createDataFrame(rows, "id long, v array<double>, class string, stratum long, fold long")


def test_planted_leak_gives_chance_accuracy(spark):
    x, y, s = _labelled()
    df = _leaky(spark, x, y, s, 50.0)
    mom = validate.fold_class_moments(df, "v", "class", "fold")
    validate.require_classes(mom, range(4))
    m = {"0": validate.fit_pca_lda(validate.training_parts(mom, [0]), 0.1, 3)}
    scored = validate.score_models(df, "v", m, "class", {"0": {"0"}}).toPandas()
    assert (scored["pred"] == scored["truth"]).mean() < 0.4 and set(scored["fold"]) == {0}
    assert df.groupBy("stratum").agg({"fold": "min"}).count() == df.select("stratum", "fold").distinct().count()


def test_missing_class_in_a_fold_raises(spark):
    x, y, s = _labelled()
    df = _leaky(spark, x, y, s, 0.0).where("NOT (fold = 2 AND class = '1')")
    with pytest.raises(ValueError, match="fold 2: no held-out row of class 1"):
        validate.require_classes(validate.fold_class_moments(df, "v", "class", "fold"), range(4))


def test_split_pipeline_equals_numpy(spark):
    x, y, s = _labelled()
    x[:, 0] += y
    df = _leaky(spark, x, y, s, 0.0)
    pdf = df.toPandas()
    v, c, f = np.stack(pdf["v"]), pdf["class"].to_numpy(), pdf["fold"].to_numpy()
    mom = validate.fold_class_moments(df, "v", "class", "fold")
    got = validate.fit_pca_lda(validate.training_parts(mom, [1]), 0.0, 3)
    t = v[f != 1]
    z = (t - t.mean(0)) / t.std(0, ddof=1)
    w = np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :3]
    sc, held = z @ w, ((v[f == 1] - t.mean(0)) / t.std(0, ddof=1)) @ w
    mu = np.stack([sc[c[f != 1] == k].mean(0) for k in got.classes])
    within = sum(((sc[c[f != 1] == k] - m).T @ (sc[c[f != 1] == k] - m)) for k, m in zip(got.classes, mu)) / (len(t) - 4)
    inv = np.linalg.inv(within)
    want = held @ inv @ mu.T - 0.5 * ((mu @ inv) * mu).sum(1)
    have = got.log_scores(v[f == 1])
    assert np.allclose(want - want[:, :1], have - have[:, :1])
    # class means and the cross-products of all training rows are enough
    total = linalg._merge([m[2:] for m in mom if m[0] != "1"])[2]
    means = [(k, float((c[f != 1] == k).sum()), t[c[f != 1] == k].mean(0)) for k in got.classes]
    again = validate.fit_pca_lda(validate.parts_from_means(total, means), 0.0, 3).log_scores(v[f == 1])
    assert np.allclose(again - again[:, :1], have - have[:, :1])


def test_permutation_drop_finds_the_informative_component(spark):
    x, y, s = _labelled()
    x[:, 0] += 2 * y
    df = _leaky(spark, x, y, s, 0.0)
    mom = validate.fold_class_moments(df, "v", "class", "fold")
    parts = {str(f): validate.training_parts(mom, [f]) for f in range(4)}
    pcas = {k: validate.parts_pca(p) for k, p in parts.items()}
    held = validate.held_out_components(df, "v", pcas, {k: {k} for k in pcas}, 6)
    assert held.count() == 400
    models = {k: validate.fit_lda(validate.project_parts(parts[k], pcas[k], 6), 0.0) for k in parts}
    d = validate.permutation_drops(held, "id", "pc", "class", models, 6, range(2), 1).toPandas()
    assert len(d) == 24 and d["baseline"].nunique() <= 4
    for k, pca in pcas.items():
        g = d[d["split"] == k].sort_values("feature")
        weight = [np.abs(models[k].coef[:, j] - models[k].coef[:, j].mean()).mean() * np.sqrt(pca.variance[j]) for j in range(6)]
        assert g["drop"].to_numpy()[int(np.argmax(weight))] > 0.05


@pytest.mark.parametrize("rows", [1_000_000, 7])
def test_adjustments_in_buckets(spark, rows):
    rng = np.random.default_rng(8)
    p = np.round(rng.random(60) ** 3, 2)
    data = [(i, i % 2, float(v), 1, 2) for i, v in enumerate(p)] + [(60, 0, None, 1, 2), (61, 1, None, 1, 2)]
    df = spark.createDataFrame(data, "id long, fam long, p double, n long, cum long")
    for family in ((), ("fam",)):
        got = multiplicity.bh(multiplicity.holm(df, "p", ["id"], family, rows_per_bucket=rows), "p", ["id"], family, rows_per_bucket=rows).toPandas()
        assert len(got) == 62 and (got["n"] == 1).all() and (got["cum"] == 2).all()
        assert got.loc[got["p"].isna(), ["p_holm", "p_bh"]].isna().all().all()
        got = got.dropna()
        for _, g in got.groupby("fam") if family else [(0, got)]:
            g = g.sort_values(["p", "id"])
            m, i = len(g), np.arange(1, len(g) + 1)
            assert np.allclose(g["p_holm"], np.maximum.accumulate(np.minimum(1, (m - i + 1) * g["p"])))
            assert np.allclose(g["p_bh"], np.minimum.accumulate(np.minimum(1, g["p"] * m / i)[::-1])[::-1])


def test_few_strata_a_class_leave_no_fold_empty(spark, tmp_path):
    """Majority classes with two strata each: the snake deals them to the first two folds only. Rows without a class or a vector stay out."""
    rng = np.random.default_rng(17)
    rows = [(s + 20 * j, rng.normal(size=6).tolist(), c) for s in range(20) for j, c in enumerate([*range(10), s // 2])]
    odd = [(1000, rng.normal(size=6).tolist(), None), (1001, None, 3)]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    df = spark.createDataFrame([(i % 20, str(c)) for i, _, c in rows], "stratum long, class string")
    assert {r["fold"] for r in validate.stratified_group_kfold(df, "stratum", "class", 4).collect()} == {0, 1}
    x = s13_validation.folded(spark, str(tmp_path))
    s13_validation.fold_moments(x)
    assert x.count() == len(rows) and x.groupBy("stratum").agg({"fold": "max"}).count() == x.select("stratum", "fold").distinct().count()
    assert [r["n"] for r in x.groupBy("fold").agg(F.countDistinct("stratum").alias("n")).orderBy("fold").collect()] == [5] * 4


def test_rare_classes_are_dealt_to_every_fold(spark):
    held = {s: {"a": 50 - s, "b": 50 + s} | ({"rare": 1} if s in (0, 1, 2, 11) else {}) | ({"odd": 1} if s in (0, 3, 4, 5, 6) else {}) for s in range(12)}
    folds = validate.deal_by_class(held, 4)
    assert set(folds) == set(held)
    for c in ("a", "b", "rare", "odd"):
        assert {folds[s] for s in held if c in held[s]} == set(range(4))
    even = spark.createDataFrame([(s, "ab"[s % 2]) for s in range(40) for _ in range(s + 1)] + [(s, c) for s in range(40) for c in "ab"], "stratum long, class string")
    snake = validate.stratified_group_kfold(even, "stratum", "class", 4).select("stratum", "fold")
    assert sorted(validate.covering_group_folds(even, "stratum", "class", 4).collect()) == sorted(snake.collect())

"""Split plans, out-of-fold tables, metrics, nulls and importance."""
import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.scalar import draw
from ..operators import aggs as A, agreement as G, contingency as C, linalg, neighbours as N, order, permute as P, resample as R, transforms as T, trees as E, validate as V
from ..operators.linalg import project
from ..runtime import stage
from .bindings import STATUSES, table, vectors
from .registry import query
from .s04_aggregations import resample_summary
from .s08_transforms import SPLIT_SQL, folded_long
from .s12_clustering import metrics_sql

# out-of-fold probabilities from integer arithmetic, the same on both engines
_S = {"F": "(id * 31 + rep * 17) % 97 / 97", "O": "(id * 7 + rep * 29) % 89 / 89", "P": "(id * 13 + rep * 11) % 83 / 83"}
OOF_SQL = """b0 AS (SELECT o_orderkey AS id, c_nationkey AS stratum, o_orderstatus AS truth, rep FROM orders JOIN customer ON c_custkey = o_custkey, (SELECT unnest(range(0, {reps})) AS rep)),
 s0 AS (SELECT *, """ + ", ".join(
    f"1 + {e}.0::DOUBLE + CASE WHEN truth = '{c}' THEN 0.6::DOUBLE ELSE 0 END AS s{c}" for c, e in _S.items()) + """ FROM b0),
 p0 AS (SELECT *, round(sF / (sF + sO + sP), 6) AS pF, round(sO / (sF + sO + sP), 6) AS pO, round(sP / (sF + sO + sP), 6) AS pP FROM s0),
 oof AS (SELECT id, stratum, truth, rep, pF, pO, pP, greatest(pF, pO, pP) AS conf, CASE WHEN pF >= pO AND pF >= pP THEN 'F' WHEN pO >= pP THEN 'O' ELSE 'P' END AS pred FROM p0)"""
PROBS = {"F": "pF", "O": "pO", "P": "pP"}
OOF1 = OOF_SQL.format(reps=1)
OOF5 = OOF_SQL.format(reps=5)


def oof(spark, sf, reps=1):
    cu = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("stratum"))
    o = table(spark, sf, "orders").join(cu, "o_custkey").select(F.col("o_orderkey").alias("id"), "stratum", F.col("o_orderstatus").alias("truth"))
    o = R.repeats(o, range(reps))
    for c, e in _S.items():
        o = o.withColumn("s" + c, 1 + F.expr(e) + F.when(F.col("truth") == c, 0.6).otherwise(0.0))
    tot = F.col("sF") + F.col("sO") + F.col("sP")
    o = o.withColumns({"p" + c: F.round(F.col("s" + c) / tot, 6) for c in _S})
    pred = F.when((F.col("pF") >= F.col("pO")) & (F.col("pF") >= F.col("pP")), "F").when(F.col("pO") >= F.col("pP"), "O").otherwise("P")
    return o.select("id", "stratum", "truth", "rep", "pF", "pO", "pP", F.greatest("pF", "pO", "pP").alias("conf"), pred.alias("pred"))


# ---- splits ------------------------------------------------------------------------------------

BASE_SQL = "base AS (SELECT o_orderkey AS id, c_nationkey AS stratum, o_orderpriority AS class FROM orders JOIN customer ON c_custkey = o_custkey)"


def base(spark, sf):
    cu = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("stratum"))
    return table(spark, sf, "orders").join(cu, "o_custkey").select(F.col("o_orderkey").alias("id"), "stratum", F.col("o_orderpriority").alias("class"))


@query("group_shuffle_split", f"""WITH {BASE_SQL}, t AS (SELECT stratum, class, count(*) AS n FROM base GROUP BY 1, 2), st AS (SELECT DISTINCT stratum FROM t),
 ps AS (SELECT rep, stratum, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('|', 17, rep, stratum)), stratum) <= ceil(0.25 * count(*) OVER (PARTITION BY rep)) AS is_test FROM st, (SELECT unnest(range(0, 12)) AS rep)),
 cv AS (SELECT rep, class, bool_or(is_test) AS t, bool_and(is_test) AS f FROM ps JOIN t USING (stratum) GROUP BY 1, 2),
 ok AS (SELECT rep, row_number() OVER (ORDER BY rep) - 1 AS split FROM cv GROUP BY rep HAVING count(*) FILTER (t AND NOT f) = (SELECT count(DISTINCT class) FROM t))
SELECT split, rep AS seed, stratum, is_test FROM ps JOIN ok USING (rep) WHERE split < 8""", big="split seed stratum")
def _(spark, sf):
    return V.group_shuffle_splits(base(spark, sf), "stratum", "class", 8, 0.25, 17, 12)


@query("stratified_kfold", f"""WITH {BASE_SQL} SELECT id, class, (row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws('|', 23, id)), id) - 1) % 5 AS fold FROM base""")
def _(spark, sf):
    return V.stratified_kfold(base(spark, sf), "id", "class", 5, 23).select("id", "class", "fold")


@query("stratified_group_kfold", """WITH t AS (SELECT o_custkey AS stratum, o_orderpriority AS class, count(*) AS n FROM orders GROUP BY 1, 2),
 s AS (SELECT stratum, sum(n) AS size, arg_min(class, (-n, class)) AS major FROM t GROUP BY 1),
 p AS (SELECT *, (row_number() OVER (PARTITION BY major ORDER BY size DESC, stratum) - 1) % 10 AS p FROM s)
SELECT stratum, size, major, CASE WHEN p < 5 THEN p ELSE 9 - p END AS fold FROM p""", big="size fold")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("stratum"), F.col("o_orderpriority").alias("class"))
    return V.stratified_group_kfold(o, "stratum", "class", 5)


@query("leave_one_group_out", f"""WITH {BASE_SQL}, g AS (SELECT stratum, count(*) AS n_test FROM base GROUP BY 1), tot AS (SELECT count(*) AS n FROM base)
SELECT CAST(a.stratum AS VARCHAR) || '+' || CAST(b.stratum AS VARCHAR) AS held_out, a.n_test + b.n_test AS n_test, n - a.n_test - b.n_test AS n_train FROM g a JOIN g b ON a.stratum < b.stratum, tot
UNION ALL SELECT CAST(stratum AS VARCHAR), n_test, n - n_test FROM g, tot""")
def _(spark, sf):
    g = base(spark, sf).groupBy("stratum").agg(F.count("*").alias("n_test"))
    tot = g.agg(F.sum("n_test").alias("n")).withColumn("k", F.lit(1))
    p = V.held_out_pairs(g, "stratum")
    na, nb = (g.select(F.col("stratum").alias(c), F.col("n_test").alias("n" + c)) for c in "ab")
    two = p.join(na, "a").join(nb, "b").select(F.concat(F.col("a").cast("string"), F.lit("+"), F.col("b").cast("string")).alias("held_out"), (F.col("na") + F.col("nb")).alias("n_test"))
    one = g.select(F.col("stratum").cast("string").alias("held_out"), "n_test")
    return two.unionByName(one).withColumn("k", F.lit(1)).join(tot, "k").select("held_out", "n_test", (F.col("n") - F.col("n_test")).alias("n_train"))


@query("fold_preprocess", f"""WITH {SPLIT_SQL}, ap AS (SELECT obs_id, fl.feature, fold, (ln(1 + greatest(value - lo, 0) / total * 10000) - mean) / sd AS z FROM fl JOIN m ON m.feature = fl.feature AND split = fold)
SELECT fold, feature, count(*) AS n, avg(z) AS mean_z, stddev_samp(z) AS sd_z FROM ap GROUP BY 1, 2""", dbl="mean_z sd_z", d=5)
def _(spark, sf):
    df = folded_long(spark, sf)
    z = T.apply_split_params(df, T.shift_sum_split_params(df))
    return z.groupBy("fold", "feature").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"), F.stddev_samp("z").alias("sd_z"))


# ---- metrics --------------------------------------------------------------------------------------

CONF_SQL = """cf AS (SELECT truth, pred, CAST(count(*) AS DOUBLE) AS n FROM oof GROUP BY 1, 2), tr AS (SELECT truth AS cls, sum(n) AS actual, coalesce(sum(n) FILTER (truth = pred), 0) AS tp FROM cf GROUP BY 1),
 pr AS (SELECT pred AS cls, sum(n) AS predicted FROM cf GROUP BY 1), mm AS (SELECT *, tp / predicted AS "precision", tp / actual AS recall, 2 * tp / (actual + predicted) AS f1 FROM tr JOIN pr USING (cls)),
 ov AS (SELECT sum(actual) AS n, sum(tp) AS hit, sum(actual * predicted) AS ap, sum(actual * actual) AS aa, sum(predicted * predicted) AS pp, avg(recall) AS balanced_accuracy, avg(f1) AS macro_f1 FROM mm)"""


@query("class_metrics", f"""WITH {OOF1}, {CONF_SQL} SELECT cls, CAST(actual AS BIGINT) AS support, "precision", recall, (n - actual - predicted + tp) / (n - actual) AS specificity, f1, hit / n AS accuracy,
 balanced_accuracy, macro_f1, (hit * n - ap) / (sqrt(n * n - pp) * sqrt(n * n - aa)) AS mcc, (hit * n - ap) / (n * n - ap) AS kappa FROM mm, ov""",
       dbl="precision recall specificity f1 accuracy balanced_accuracy macro_f1 mcc kappa")
def _(spark, sf):
    return V.class_metrics(V.confusion(oof(spark, sf)))


@query("confusion_matrix", f"""WITH {OOF5}, g AS (SELECT * FROM (SELECT unnest(['F','O','P','X']) AS truth), (SELECT unnest(['F','O','P','X']) AS pred)),
 c AS (SELECT truth, pred, count(*) AS n FROM oof GROUP BY 1, 2)
SELECT g.truth, g.pred, coalesce(n, 0) AS n, n * 100.0 / sum(n) OVER (PARTITION BY g.truth) AS row_percent FROM g LEFT JOIN c ON c.truth = g.truth AND c.pred = g.pred""", dbl="row_percent")
def _(spark, sf):
    c = A.shares(V.confusion(oof(spark, sf, 5), levels=STATUSES + ["X"]), "truth", out="row_percent")
    return c.withColumn("row_percent", F.when(F.col("n") > 0, F.col("row_percent")))


@query("log_loss_brier_ece", f"""WITH {OOF1}, x AS (SELECT least(floor(conf * 10), 9) AS bin, conf, CASE WHEN truth = pred THEN 1.0::DOUBLE ELSE 0 END AS hit, -ln(CASE truth WHEN 'F' THEN pF WHEN 'O' THEN pO ELSE pP END) AS ll,
  {" + ".join(f"pow(p{c} - CASE WHEN truth = '{c}' THEN 1 ELSE 0 END, 2)" for c in "FOP")} AS br FROM oof),
 b AS (SELECT bin, count(*) AS n, avg(conf) AS mean_conf, avg(hit) AS accuracy FROM x GROUP BY 1), t AS (SELECT avg(ll) AS log_loss, avg(br) AS brier FROM x)
SELECT bin, n, mean_conf, accuracy, log_loss, brier, (SELECT sum(n * abs(accuracy - mean_conf)) / sum(n) FROM b) AS ece FROM b, t""", dbl="mean_conf accuracy log_loss brier ece", big="bin")
def _(spark, sf):
    return V.calibration(oof(spark, sf), PROBS)


OVR_SQL = f"""{OOF1}, ov0 AS ({" UNION ALL ".join(f"SELECT '{c}' AS cls, p{c} AS score, CASE WHEN truth = '{c}' THEN 1 ELSE 0 END AS y FROM oof" for c in "FOP")}),
 sc AS (SELECT * FROM ov0 UNION ALL SELECT 'micro', score, y FROM ov0), vc AS (SELECT cls, score, count(*) AS c, sum(y) AS c_pos FROM sc GROUP BY 1, 2),
 cu AS (SELECT cls, score AS threshold, c_pos, sum(c_pos) OVER w AS tp, sum(c) OVER w AS n_at, sum(c_pos) OVER (PARTITION BY cls) AS n_pos, sum(c) OVER (PARTITION BY cls) AS n FROM vc WINDOW w AS (PARTITION BY cls ORDER BY score DESC))"""


@query("roc_pr", f"""WITH {OVR_SQL} SELECT cls, threshold, tp, n_at - tp AS fp, tp / n_pos AS tpr, (n_at - tp) / (n - n_pos) AS fpr, tp / n_at AS "precision" FROM cu""",
       dbl="threshold tpr fpr precision", big="tp fp")
def _(spark, sf):
    return V.roc_pr(V.one_vs_rest(oof(spark, sf), PROBS)).select("cls", "threshold", "tp", "fp", "tpr", "fpr", "precision")


@query("roc_pr_summary", f"""WITH {OVR_SQL}, rk AS (SELECT cls, y, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0::DOUBLE AS r FROM sc),
 au AS (SELECT cls, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0)) AS auc FROM rk GROUP BY 1),
 ap AS (SELECT cls, sum(c_pos * (tp / n_at)) / max(n_pos) AS ap FROM cu GROUP BY 1), per AS (SELECT cls, auc, ap FROM au JOIN ap USING (cls))
SELECT * FROM per UNION ALL SELECT 'macro', avg(auc), avg(ap) FROM per WHERE cls <> 'micro'""", dbl="auc ap")
def _(spark, sf):
    return V.auc_ap(V.roc_pr(V.one_vs_rest(oof(spark, sf), PROBS)))


HELD = "(stratum + rep) % 3 = 0"


@query("mean_heldout_prob", f"WITH {OOF5} SELECT id, truth, count(*) AS n_held_out, avg(pF) AS pF, avg(pO) AS pO, avg(pP) AS pP FROM oof WHERE {HELD} GROUP BY 1, 2", dbl="pF pO pP", d=8)
def _(spark, sf):
    return oof(spark, sf, 5).where(HELD).groupBy("id", "truth").agg(F.count("*").alias("n_held_out"), *[F.avg(p).alias(p) for p in PROBS.values()])


BOOT_SQL = """bt AS (SELECT rep, CAST(CAST('0x' || substr(md5(concat_ws('|', 31, rep, i)), 1, 8) AS BIGINT) % g + 1 AS BIGINT) AS pos FROM (SELECT stratum, row_number() OVER (ORDER BY stratum) AS i, count(*) OVER () AS g FROM (SELECT DISTINCT stratum FROM oof)),
   (SELECT unnest(range(0, 40)) AS rep)), sl AS (SELECT stratum, row_number() OVER (ORDER BY stratum) AS pos FROM (SELECT DISTINCT stratum FROM oof)),
 w AS (SELECT rep, stratum, count(*) AS w FROM bt JOIN sl USING (pos) GROUP BY 1, 2), sc AS (SELECT stratum, truth, count(*) AS n, count(*) FILTER (truth = pred) AS hit FROM oof GROUP BY 1, 2),
 r AS (SELECT rep, truth, sum(w * n) AS n, sum(w * hit) AS hit FROM w JOIN sc USING (stratum) GROUP BY 1, 2), m AS (SELECT rep, sum(hit) / sum(n) AS accuracy, avg(hit / n) AS balanced_accuracy FROM r GROUP BY 1)"""


@query("group_bootstrap_ci", f"""WITH {OOF1}, {BOOT_SQL} SELECT metric, count(*) AS n_rep, quantile_cont(v, .5) AS median, quantile_cont(v, .025) AS q025, quantile_cont(v, .975) AS q975
FROM m UNPIVOT (v FOR metric IN (accuracy, balanced_accuracy)) GROUP BY 1""", dbl="median q025 q975")
def _(spark, sf):
    o = oof(spark, sf)
    cells = V.confusion(o, ["stratum"])
    w = R.bootstrap_weights(o, "stratum", range(40), 31)
    conf = cells.join(w, "stratum").groupBy("rep", "truth", "pred").agg(F.sum(F.col("n") * F.col("w")).alias("n"))
    m = V.overall(conf, ["rep"]).unpivot(["rep"], ["accuracy", "balanced_accuracy"], "metric", "value")
    return resample_summary(m, ["metric"])


VOTE_SQL = f"""{OOF5}, vc AS (SELECT id, truth, pred, count(*) AS c FROM oof GROUP BY 1, 2, 3), md AS (SELECT id, truth, pred AS modal, c, row_number() OVER (PARTITION BY id ORDER BY c DESC, pred) AS rn, sum(c) OVER (PARTITION BY id) AS n FROM vc),
 vt AS (SELECT id, truth, modal, c / n AS agreement FROM md WHERE rn = 1)"""


@query("prediction_stability", f"WITH {VOTE_SQL} SELECT id, modal, 5 AS n_votes, agreement, modal = truth AS matches_reference FROM vt", dbl="agreement", big="n_votes")
def _(spark, sf):
    o = oof(spark, sf, 5)
    truth = oof(spark, sf, 1).select("id", "truth")
    return A.mode_vote(o.withColumnRenamed("pred", "label"), "id").join(truth, "id").select(
        "id", "modal", "n_votes", "agreement", (F.col("modal") == F.col("truth")).alias("matches_reference"))


@query("seed_pair_agreement", f"""WITH {OOF5}, rp AS (SELECT a.rep AS ra, b.rep AS rb, a.pred AS la, b.pred AS lb FROM oof a JOIN oof b ON a.id = b.id AND a.rep < b.rep), {metrics_sql('rp', 'la', 'lb', 'ra, rb')}
SELECT ra AS run_a, rb AS run_b, ari, nmi_mean FROM mt""", dbl="ari:9 nmi_mean:9", big="run_a run_b")
def _(spark, sf):
    o = oof(spark, sf, 5).select(F.col("rep").cast("string").alias("run"), "id", F.col("pred").alias("label"))
    names = [str(i) for i in range(5)]
    return G.agreement(G.run_pairs(o, "id", names), ["run_a", "run_b"]).select("run_a", "run_b", "ari", "nmi_mean")


@query("boundary_audit", f"""WITH {VOTE_SQL}, c AS (SELECT id, avg(conf) AS mean_conf, min(conf) AS min_conf FROM oof GROUP BY 1)
SELECT id, agreement >= 0.8 AND mean_conf >= 0.4 AND modal = truth AS high_confidence, 1 - (mean_conf + agreement) / 2 AS boundary_score FROM vt JOIN c USING (id)""", dbl="boundary_score:9")
def _(spark, sf):
    o = oof(spark, sf, 5)
    c = o.groupBy("id", "truth").agg(F.avg("conf").alias("mean_conf"))
    v = A.mode_vote(o.withColumnRenamed("pred", "label"), "id").join(c, "id")
    ok = (F.col("agreement") >= 0.8) & (F.col("mean_conf") >= 0.4) & (F.col("modal") == F.col("truth"))
    return v.select("id", ok.alias("high_confidence"), (1 - (F.col("mean_conf") + F.col("agreement")) / 2).alias("boundary_score"))


# ---- fitted models ----------------------------------------------------------------------------------

K_FOLDS = 4
FOLDS = [str(f) for f in range(K_FOLDS)]
N_PC = 5


def folded(spark, sf):
    """Unscaled vectors; whole strata are dealt to folds, so no stratum is in training and test at once. Rows without a class or a vector
    can be neither learned from nor scored."""
    x = vectors(spark, sf).where(F.col("class").isNotNull() & F.col("v").isNotNull())
    x = x.select("obs_id", F.col("class").cast("string").alias("class"), "v", (F.col("obs_id") % 20).alias("stratum"))
    deal = V.covering_group_folds(x, "stratum", "class", K_FOLDS)
    return stage(x.join(deal, "stratum"))


def fold_moments(x, vec="v"):
    mom = V.fold_class_moments(x, vec, "class", "fold")
    V.require_classes(mom, FOLDS)
    return mom


def ba(scored, keys=("model",)):
    return V.overall(V.confusion(scored, list(keys)), list(keys)).select(*keys, "accuracy", "balanced_accuracy", "macro_f1")


def fold_components(x, mom):
    """Rows with ``z``: the leading components of every fold's training rows side by side; and each fold's block with the fold it holds out."""
    pcas = {f: V.parts_pca(V.training_parts(mom, [f])) for f in FOLDS}
    maps = [pcas[f].loadings[:, :N_PC] / pcas[f].scale[:, None] for f in FOLDS]
    centre = np.concatenate([pcas[f].mean @ w for f, w in zip(FOLDS, maps)])
    z = project(x, "v", np.hstack(maps), np.zeros(len(maps[0])), "z").withColumn("z", F.zip_with("z", F.array(*[F.lit(float(c)) for c in centre]), lambda a, c: a - c))
    return z.select("obs_id", "class", "stratum", "fold", "z"), {f: ({f}, slice(i * N_PC, (i + 1) * N_PC)) for i, f in enumerate(FOLDS)}, maps


def tree_ensembles(z, splits):
    """Held-out scores of both ensembles of trees, all folds in one growth."""
    rows, classes, counts = E.prepare(z, "z", "class", "fold")
    held = {f: h for f, (h, _) in splits.items()}
    extra = E.extra_trees(rows, classes, counts, splits, 150, 8, 53)
    boosted = E.boosting(rows, classes, counts, splits, E.bin_edges(rows, splits, 32), 20, 3, rate=0.2)
    return {name: V.score_models(z, "z", m, "class", held) for name, m in (("extra_trees", extra), ("boosted_trees", boosted))}


@query("tree_ensembles", dbl="accuracy balanced_accuracy macro_f1", d=4)
def _(spark, sf):
    """150 extremely randomised trees and 20 rounds of boosted trees on the components of each fold's training rows; metrics by fold."""
    x = folded(spark, sf)
    z, splits, _ = fold_components(x, fold_moments(x))
    out = [ba(s.withColumnRenamed("model", "fold_out").withColumn("model", F.lit(n)), ["model", "fold_out"]) for n, s in tree_ensembles(stage(z), splits).items()]
    return out[0].unionByName(out[1])


@query("model_families", dbl="accuracy balanced_accuracy macro_f1", d=4)
def _(spark, sf):
    """Every fold held out once; scaling and components from its training rows. Linear, kernel (random Fourier
    features), tree, neighbour and discriminant scorers with balanced class weights; boosted trees without, as is usual."""
    x = folded(spark, sf)
    mom = fold_moments(x)
    grown = tree_ensembles(*(lambda z, splits, _: (stage(z), splits))(*fold_components(x, mom)))
    rng = np.random.default_rng(5)
    w, b = rng.normal(0, 0.5, (N_PC, 40)), rng.uniform(0, 2 * np.pi, 40)
    kw = {"labelCol": "y", "weightCol": "weight", "predictionCol": "yhat"}
    fits = {"logistic": LogisticRegression(maxIter=15, regParam=0.01, featuresCol="f", **kw),
            "rbf_fourier": LogisticRegression(maxIter=15, regParam=0.01, featuresCol="r", **kw),
            "linear_svm": OneVsRest(classifier=LinearSVC(maxIter=5), featuresCol="f", parallelism=4, **kw),
            "random_forest": RandomForestClassifier(numTrees=15, maxDepth=5, seed=3, featuresCol="f", **kw)}
    lda = {f: V.fit_pca_lda(V.training_parts(mom, [f]), 0.1, N_PC) for f in FOLDS}
    out = V.score_models(x, "v", lda, "class", {f: {f} for f in FOLDS}).select(F.lit("lda").alias("model"), "truth", "pred")
    for name, scored in grown.items():
        out = out.unionByName(scored.select(F.lit(name).alias("model"), "truth", "pred"))
    for f in FOLDS:
        parts = V.training_parts(mom, [f])
        weight = {c: 1.0 / sum(p[1] for p in parts if p[0] == c) for c in {p[0] for p in parts}}
        z = V.parts_pca(parts).scores(x, "v", N_PC).drop("v").withColumn("held", F.col("fold") == int(f))
        z = stage(project(z, "pc", w, np.zeros(N_PC), "lift").select(
            "obs_id", "class", "held", "pc", F.col("class").cast("double").alias("y"),
            F.create_map(*[t for c, v in weight.items() for t in (F.lit(c), F.lit(v))])[F.col("class")].alias("weight"),
            F.zip_with("lift", F.array(*[F.lit(float(v)) for v in b]), lambda a, c: F.cos(a + c)).alias("lift")))
        ready = z.withColumn("f", array_to_vector("pc")).withColumn("r", array_to_vector("lift"))
        train, test = ready.where("NOT held").persist(), ready.where("held")
        for name, est in fits.items():
            s = est.fit(train).transform(test)
            out = out.unionByName(s.select(F.lit(name).alias("model"), F.col("class").alias("truth"), F.col("yhat").cast("int").cast("string").alias("pred")))
        train.unpersist()
        near = N.knn(z, "obs_id", "pc", 15, side="held").join(z.select(F.col("obs_id").alias("nbr"), F.col("class").alias("nc")), "nbr")
        vote = near.join(z.where("held").select("obs_id", "class"), "obs_id").groupBy("obs_id", "class", "nc").agg(F.sum(1 / (F.col("dist") + 1e-9)).alias("w"))
        knn = vote.groupBy("obs_id", "class").agg(F.min_by("nc", F.struct(-F.col("w"), F.col("nc"))).alias("pred"))
        out = out.unionByName(knn.select(F.lit("knn").alias("model"), F.col("class").alias("truth"), "pred"))
    return ba(out)


@query("nested_cv", dbl="accuracy balanced_accuracy macro_f1", d=5)
def _(spark, sf):
    scored, _ = V.nested_cv(folded(spark, sf), "v", "class", K_FOLDS, [0.01, 0.1, 0.5], N_PC)
    return ba(scored, ["fold"])


@query("oof_table", dbl="confidence p_sum", d=5)
def _(spark, sf):
    scored, _ = V.nested_cv(folded(spark, sf), "v", "class", K_FOLDS, [0.01, 0.1, 0.5], N_PC)
    return scored.select("obs_id", "fold", "truth", "pred", "confidence", F.aggregate("p", F.lit(0.0), lambda a, v: a + v).alias("p_sum"))


def component_drops(x, mom, splits, k, reps, seed):
    """Permutation drops of components; ``splits``: name -> (scored fold, folds left out of the fit)."""
    parts = {s: V.training_parts(mom, out) for s, (_, out) in splits.items()}
    pcas = {s: V.parts_pca(p) for s, p in parts.items()}
    held = V.held_out_components(x, "v", pcas, {s: {f} for s, (f, _) in splits.items()}, k)
    models = {s: V.fit_lda(V.project_parts(parts[s], pcas[s], k), 0.1) for s in splits}
    return V.permutation_drops(stage(held.select("split", "obs_id", "class", "pc")), "obs_id", "pc", "class", models, k, reps, seed)


@query("permutation_importance", dbl="baseline drop", d=5)
def _(spark, sf):
    """Every fold held out once, ten deals of each component inside it; means over the folds."""
    x = folded(spark, sf)
    d = component_drops(x, fold_moments(x), {f: (f, [f]) for f in FOLDS}, N_PC, range(10), 41)
    return d.groupBy("feature").agg(F.avg("baseline").alias("baseline"), F.avg("drop").alias("drop"))


@query("model_importance_stability", dbl="median q025 q975", d=4)
def _(spark, sf):
    x = folded(spark, sf)
    mom, rows = fold_moments(x), []
    for f in FOLDS:
        z = V.parts_pca(V.training_parts(mom, [f])).scores(x.where(F.col("fold") != int(f)), "v", N_PC)
        train = z.select(F.col("class").cast("double").alias("y"), array_to_vector("pc").alias("f")).persist()
        rf = RandomForestClassifier(numTrees=10, maxDepth=4, seed=int(f), featuresCol="f", labelCol="y").fit(train)
        lr = LogisticRegression(maxIter=10, regParam=0.01, featuresCol="f", labelCol="y").fit(train)
        train.unpersist()
        imp, coef = rf.featureImportances.toArray(), np.abs(lr.coefficientMatrix.toArray()).mean(0)
        rows += [(int(f), "impurity", i, float(v)) for i, v in enumerate(imp)] + [(int(f), "mean_abs_coef", i, float(v)) for i, v in enumerate(coef)]
    return resample_summary(spark.createDataFrame(rows, "split long, kind string, feature long, value double"), ["kind", "feature"])


@query("coef_stability", dbl="mean sd", d=5)
def _(spark, sf):
    """Coefficients on the unscaled features, where the components of different splits can be compared."""
    mom, rows = fold_moments(folded(spark, sf)), []
    for f in FOLDS:
        m = V.fit_pca_lda(V.training_parts(mom, [f]), 0.1, N_PC)
        c = m.coef - m.coef.mean(0)
        rows += [(int(f), k, j, float(c[i, j])) for i, k in enumerate(m.classes) for j in range(c.shape[1])]
    d = spark.createDataFrame(rows, "split long, cls string, feature long, value double")
    return d.groupBy("cls", "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


@query("ablation", dbl="accuracy balanced_accuracy macro_f1", d=5)
def _(spark, sf):
    """Subsets of components by importance, ranked inside the training folds of each split; sub-blocks of the
    fold moments, so no subset needs another scan to fit."""
    p, x = 8, folded(spark, sf)
    mom = fold_moments(x)
    inner = {f"{o}|{i}": (i, [o, i]) for o in FOLDS for i in FOLDS if i != o}
    d = component_drops(x, mom, inner, p, range(10), 53).groupBy(F.split("split", r"\|")[0].alias("o"), "feature").agg(F.avg("drop").alias("drop"))
    # folds x components rows
    drops = {(r["o"], r["feature"]): r["drop"] for r in d.collect()}
    models = {}
    for o in FOLDS:
        rank = sorted(range(p), key=lambda j: (-round(drops[o, j], 9), j))
        sets = {"all": range(p), "drop_top2": sorted(rank[2:]), "drop_top5": sorted(rank[5:]), "bottom3": sorted(rank[-3:])}
        sets |= {f"without_{j}": [i for i in range(p) if i != j] for j in range(p)} | {f"only_{j}": [j] for j in range(p)}
        models |= {f"{n}|{o}": V.fit_pca_lda(V.training_parts(mom, [o]), 0.1, p, list(c)) for n, c in sets.items()}
    s = V.score_models(x, "v", models, "class", {m: {m.split("|")[1]} for m in models})
    return ba(s.withColumn("subset", F.split("model", r"\|")[0]), ["subset"])


@query("learning_curve", dbl="accuracy balanced_accuracy macro_f1", d=5)
def _(spark, sf):
    """Growing hash prefixes of the training strata against a fixed quarter of the strata; moments of five blocks, one job."""
    x = folded(spark, sf).drop("fold")
    at = order.hash_rank(x.select("stratum").distinct().withColumn("g", F.lit(1)), ["g"], draw(43, F.col("stratum")), "stratum")
    n_test = F.ceil(F.col("n") / 4)
    block = F.when(F.col("pos") <= n_test, 0).otherwise(F.ceil(4 * (F.col("pos") - n_test) / (F.col("n") - n_test)))
    x = stage(x.join(at.select("stratum", block.cast("long").alias("fold")), "stratum"))
    mom = V.fold_class_moments(x, "v", "class", "fold")
    models = {str(b / 4): V.fit_pca_lda([m[1:] for m in mom if 1 <= int(m[0]) <= b], 0.1, N_PC) for b in range(1, 5)}
    return ba(V.score_models(x, "v", models, "class", {m: {"0"} for m in models}))


DEALS = 999


@query("label_permutation_null", dbl="observed p null_median null_q025 null_q975", d=5)
def _(spark, sf):
    """999 deals inside the strata; rows are placed once and never shuffled again. Relabelling leaves the cross-products of all rows as
    they are, so a deal only needs class sums on the components of each fold's training rows."""
    x = folded(spark, sf)
    mom, reps = fold_moments(x), range(-1, DEALS)
    z, _, maps = fold_components(x, mom)
    placed = stage(P.with_places(z, "obs_id", "class", "stratum"))
    sums: dict = {}
    for r in P.null_sums(placed, "fold", "z", N_PC * K_FOLDS, reps, 47).collect():  # repeats x folds x classes
        sums.setdefault(r["rep"], []).append((r["by"], r["label"], r["n"], np.array(r["s"])))
    models = {}
    for at, f in enumerate(FOLDS):
        total = maps[at].T @ linalg._merge([m[2:] for m in mom if m[0] != f])[2] @ maps[at]
        own = slice(at * N_PC, (at + 1) * N_PC)
        for rep, cells in sums.items():
            by: dict = {}
            for fold, c, n, s in cells:
                if fold != f:
                    k, t = by.get(c, (0, 0.0))
                    by[c] = (k + n, t + s[own])
            m = V.fit_lda(V.parts_from_means(total, [(c, n, s / n) for c, (n, s) in sorted(by.items())]), 0.1)
            coef = np.zeros((len(m.classes), N_PC * K_FOLDS))
            coef[:, own] = m.coef
            models[rep, f] = V.LDA(m.classes, coef, m.bias)
    s = V.overall(P.null_confusion(placed, "fold", "z", models, reps, 47), ["rep"]).select("rep", F.col("balanced_accuracy").alias("v"))
    return C.summarise_null(s.where("rep >= 0"), s.where("rep = -1"))


@query("nonconsensus_scoring", dbl="agree_a agree_b", d=5)
def _(spark, sf):
    """Scaling, components and model fitted where two labelings agree, applied where they differ."""
    x = folded(spark, sf).withColumn("other", F.when(F.col("obs_id") % 7 == 0, (F.col("class").cast("int") + 1) % 10).otherwise(F.col("class").cast("int")).cast("string"))
    agree = x.where(F.col("class") == F.col("other"))
    m = V.fit_pca_lda(V.training_parts(V.fold_class_moments(agree, "v", "class", "fold"), []), 0.1, N_PC)
    s = V.score_models(x.where(F.col("class") != F.col("other")), "v", {"final": m}, "class")
    return s.groupBy("model").agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("agree_a"),
                                  F.avg((F.col("pred") == F.col("other")).cast("double")).alias("agree_b"))

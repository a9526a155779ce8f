"""Reference mapping: orders with status F or O are the reference, status P the queries."""
import numpy as np
from pyspark.sql import functions as F

from ..operators import joins as J, linalg as L, mapping as P, neighbours as N, order
from ..operators.aggs import shares
from ..runtime import spread, stage
from .bindings import PRIORITIES, table, vectors
from .registry import query
from .s08_transforms import LOGN_SQL, logn

REF_SQL = f"""{LOGN_SQL}, cls AS (SELECT o_orderkey AS obs_id, o_orderpriority AS class, o_orderstatus AS st FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey),
 cen AS (SELECT class, gene, sum(logn) / (SELECT count(*) FROM cls c2 WHERE c2.class = c.class AND st <> 'P') AS mean FROM logn JOIN cls c USING (obs_id) WHERE st <> 'P' GROUP BY 1, 2),
 genes AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS pos, count(*) OVER () AS g FROM (SELECT DISTINCT gene FROM cen)), ng AS (SELECT count(*) AS g FROM genes),
 q AS (SELECT obs_id, gene, logn FROM logn JOIN cls USING (obs_id) WHERE st = 'P'),
 qs AS (SELECT obs_id, sum(logn) AS sx, sum(logn * logn) AS sxx FROM q GROUP BY 1), cs AS (SELECT class, sum(mean) AS sy, sum(mean * mean) AS syy FROM cen GROUP BY 1),
 xy AS (SELECT obs_id, class, sum(logn * mean) AS sxy FROM q JOIN cen USING (gene) GROUP BY 1, 2),
 cr AS (SELECT obs_id, class, (g * sxy - sx * sy) / sqrt((g * sxx - sx * sx) * (g * syy - sy * sy)) AS r FROM xy JOIN qs USING (obs_id) JOIN cs USING (class), ng),
 rkd AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY round(r, 9) DESC, class) AS rn FROM cr),
 bt AS (SELECT obs_id, max(class) FILTER (rn = 1) AS best, max(r) FILTER (rn = 1) AS r_best, max(class) FILTER (rn = 2) AS second, max(r) FILTER (rn = 2) AS r_second FROM rkd GROUP BY 1),
 cc AS (SELECT *, CASE WHEN round(r_best, 9) >= 0.5 THEN 'good' WHEN round(r_best, 9) > 0.4 THEN 'low_risk' ELSE 'high_risk' END AS quality FROM bt)"""


def split_sets(spark, sf):
    ln = stage(logn(spark, sf))
    n = ln.count()
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("st"))
    lines = spread(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("obs_id")), n, "obs_id")
    # sides that grow with the table are merged; Spark would broadcast them while their files are small
    o = stage(spread(o, n, "obs_id").join(lines.hint("merge"), "obs_id", "left_semi"))
    ref = o.where("st <> 'P'").select("obs_id", "class")
    queries = o.where("st = 'P'").select("obs_id", "class")
    # staged, as Spark takes a repartition after a join on the same key away and sizes the join's shuffle itself
    q = spread(stage(ln.join(queries.select("obs_id").hint("merge"), "obs_id", "left_semi")), n, "obs_id")
    return stage(P.centroids(spread(ln, n, "obs_id"), ref.hint("merge"))), q, queries.hint("merge")


def mapped(spark, sf):
    cen, q, _ = split_sets(spark, sf)
    return P.best_two(P.centroid_correlation(q, cen, cen.select("gene").distinct().count()))


@query("centroid_correlation", f"WITH {REF_SQL} SELECT * FROM cc", dbl="r_best r_second", d=7)
def _(spark, sf):
    return mapped(spark, sf)


@query("two_method_qc", f"""WITH {REF_SQL}, j AS (SELECT obs_id, r_best >= 0.18 AS good_1, c_acctbal > 0 AS good_2 FROM cc JOIN orders ON o_orderkey = obs_id JOIN customer ON c_custkey = o_custkey),
 m AS (SELECT 'correlation' AS method, good_1 AS good FROM j UNION ALL SELECT 'balance', good_2 FROM j UNION ALL SELECT 'consensus', good_1 AND good_2 FROM j)
SELECT method, CASE WHEN good THEN 'Good' ELSE 'Risk' END AS qc_level, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY method) AS percent FROM m GROUP BY 1, 2""", dbl="percent")
def _(spark, sf):
    cu = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("obs_id"), "o_custkey").join(cu, "o_custkey")
    j = mapped(spark, sf).join(o, "obs_id")
    a, b = F.col("r_best") >= 0.18, F.col("c_acctbal") > 0
    m = j.select(F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.when(c, "Good").otherwise("Risk").alias("qc_level"))
                                     for n, c in (("correlation", a), ("balance", b), ("consensus", a & b))])).alias("s")).select("s.*")
    return shares(m.groupBy("method", "qc_level").agg(F.count("*").alias("n")), "method")


B = 20
VOTES_SQL = f"""{REF_SQL}, w AS (SELECT rep, gene, count(*) AS w FROM (SELECT rep, CAST('0x' || substr(md5(concat_ws('|', 61, rep, i)), 1, 8) AS BIGINT) % g AS pos
   FROM (SELECT unnest(range(0, {B})) AS rep), (SELECT pos + 1 AS i, g FROM genes)) JOIN genes USING (pos) GROUP BY 1, 2),
 wy AS (SELECT rep, class, sum(w * mean) AS sy, sum(w * mean * mean) AS syy FROM w JOIN cen USING (gene) GROUP BY 1, 2),
 wx AS (SELECT rep, obs_id, sum(w * logn) AS sx, sum(w * logn * logn) AS sxx FROM w JOIN q USING (gene) GROUP BY 1, 2),
 wxy AS (SELECT rep, obs_id, class, sum(w * logn * mean) AS sxy FROM w JOIN q USING (gene) JOIN cen USING (gene) GROUP BY 1, 2, 3),
 allq AS (SELECT rep, obs_id, class FROM (SELECT DISTINCT obs_id FROM q), (SELECT unnest(range(0, {B})) AS rep), (SELECT DISTINCT class FROM cen)),
 wr AS (SELECT rep, obs_id, class, CASE WHEN greatest(g * sxx - sx * sx, 0) * greatest(g * syy - sy * sy, 0) > 1e-24 THEN (g * coalesce(sxy, 0) - sx * sy) / sqrt(greatest(g * sxx - sx * sx, 0) * (g * syy - sy * sy)) ELSE 0 END AS r
   FROM ng, allq LEFT JOIN wx USING (rep, obs_id) LEFT JOIN wy USING (rep, class) LEFT JOIN wxy USING (rep, obs_id, class)),
 win AS (SELECT rep, obs_id, class, row_number() OVER (PARTITION BY rep, obs_id ORDER BY round(coalesce(r, 0), 9) DESC, class) AS rn FROM wr),
 sh AS (SELECT obs_id, class, count(*) FILTER (rn = 1) / {B}.0 AS share FROM win GROUP BY 1, 2),
 so AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY share DESC, class) AS rn FROM sh),
 vt AS (SELECT obs_id, max(class) FILTER (rn = 1) AS top1, max(share) FILTER (rn = 1) AS support, max(class) FILTER (rn = 2) AS top2, max(share) FILTER (rn = 1) - max(share) FILTER (rn = 2) AS margin,
   -sum(CASE WHEN share > 0 THEN share * ln(share) ELSE 0 END) AS entropy FROM so GROUP BY 1),
 tr AS (SELECT *, CASE WHEN round(support, 9) >= 0.8 AND round(margin, 9) >= 0.5 THEN 'High' WHEN round(support, 9) >= 0.5 AND round(margin, 9) >= 0.2 THEN 'Moderate' ELSE 'Low' END AS tier FROM vt)"""


def votes(spark, sf):
    cen, q, queries = split_sets(spark, sf)
    genes = sorted(r["gene"] for r in cen.select("gene").distinct().collect())
    at = {g: i for i, g in enumerate(genes)}
    center = np.zeros((len(PRIORITIES), len(genes)))
    for r in cen.collect():  # classes x genes
        center[PRIORITIES.index(r["class"]), at[r["gene"]]] = r["mean"]
    dense = P.dense_vectors(q, queries, genes, "logn")
    return P.bootstrap_votes(dense, center, PRIORITIES, P.draw_matrix(spark, genes, B, 61))


@query("gene_bootstrap_votes", f"WITH {VOTES_SQL} SELECT * FROM vt", dbl="support margin entropy")
def _(spark, sf):
    return votes(spark, sf)


@query("confidence_tiers", f"""WITH {VOTES_SQL} SELECT tier, count(*) AS n, count(*) / sum(count(*)) OVER () AS fraction, count(*) FILTER (top1 = best) AS n_concordant, count(*) FILTER (top1 = best) / count(*) AS concordance
FROM tr JOIN cc USING (obs_id) GROUP BY 1""", dbl="fraction concordance")
def _(spark, sf):
    v = votes(spark, sf).withColumn("tier", P.confidence_tier(F.col("support"), F.col("margin"))).join(mapped(spark, sf).select("obs_id", "best"), "obs_id")
    t = v.groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("top1") == F.col("best")).alias("n_concordant")).withColumn("g", F.lit(1))
    return shares(t, "g", out="fraction").select("tier", "n", (F.col("fraction") / 100).alias("fraction"), "n_concordant", (F.col("n_concordant") / F.col("n")).alias("concordance"))


@query("label_agreement", f"""WITH {VOTES_SQL}, j AS (SELECT best, top1, support, best = top1 AS exact, (substr(best, 1, 1) IN ('1', '2')) = (substr(top1, 1, 1) IN ('1', '2')) AS collapsed FROM vt JOIN cc USING (obs_id)),
 a AS (SELECT count(*) FILTER (exact) / count(*) AS exact_rate, count(*) FILTER (collapsed) / count(*) AS collapsed_rate, avg(support) AS mean_support, quantile_cont(support, .5) AS median_support FROM j)
SELECT best, top1, count(*) AS n_links, exact_rate, collapsed_rate, mean_support, median_support FROM j, a GROUP BY ALL""", dbl="exact_rate collapsed_rate mean_support median_support")
def _(spark, sf):
    broad = lambda c: F.substring(c, 1, 1).isin("1", "2")
    j = votes(spark, sf).join(mapped(spark, sf).select("obs_id", "best"), "obs_id").withColumn("g", F.lit(1)).persist()
    a = j.groupBy("g").agg(F.avg((F.col("best") == F.col("top1")).cast("double")).alias("exact_rate"),
                           F.avg((broad("best") == broad("top1")).cast("double")).alias("collapsed_rate"), F.avg("support").alias("mean_support"))
    med = order.quantiles(j, ["g"], "support", {"median_support": .5})
    links = j.groupBy("g", "best", "top1").agg(F.count("*").alias("n_links"))
    return links.join(a.join(med, "g"), "g").drop("g")


@query("cross_run_stability", """WITH r AS (SELECT l_partkey, l_returnflag AS lab, CASE WHEN l_returnflag IN ('A', 'R') THEN 'AR' ELSE 'N' END AS root FROM lineitem),
 s AS (SELECT l_partkey, count(*) AS n_runs, CASE WHEN count(DISTINCT lab) = 1 THEN 'Stable_' || min(lab) ELSE 'fluctuating' END AS status,
  CASE WHEN count(DISTINCT root) = 1 THEN 'Stable_' || min(root) ELSE 'fluctuating' END AS root_status FROM r GROUP BY 1)
SELECT * FROM s""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag")
    root = P.run_stability(li, "l_partkey", "l_returnflag", lambda c: F.when(c.isin("A", "R"), "AR").otherwise("N"))
    return P.run_stability(li, "l_partkey", "l_returnflag").join(root.select("l_partkey", F.col("status").alias("root_status")), "l_partkey")


@query("mnn_transfer", dbl="accuracy mean_support", d=4)
def _(spark, sf):
    v = vectors(spark, sf).withColumn("is_ref", F.col("obs_id") % 3 != 0)
    x = L.fit_pca(v, "v", standardise=False).scores(v, "v", 8).select("obs_id", F.col("class").cast("string").alias("class"), "is_ref", "pc")
    cross = N.knn(x, "obs_id", "pc", 30, side="is_ref")
    t = P.mutual_transfer(cross, x.select("obs_id", "is_ref"), x.select("obs_id", "class"), 10).join(x.select("obs_id", "class"), "obs_id")
    return t.agg(F.count("*").alias("n"), F.count("label").alias("n_labelled"), F.avg((F.col("label") == F.col("class")).cast("double")).alias("accuracy"), F.avg("support").alias("mean_support"))


@query("marker_long", f"""WITH {LOGN_SQL} SELECT obs_id, gene, o_orderpriority AS class, CASE WHEN o_orderstatus = 'P' THEN 'query' ELSE 'reference' END AS source, logn FROM logn JOIN orders ON o_orderkey = obs_id
WHERE gene IN ('Brand#1_ECONOMY', 'Brand#2_PROMO', 'Brand#3_STANDARD')""", dbl="logn")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_orderpriority").alias("class"),
                                          F.when(F.col("o_orderstatus") == "P", "query").otherwise("reference").alias("source"))
    m = logn(spark, sf).where(F.col("gene").isin("Brand#1_ECONOMY", "Brand#2_PROMO", "Brand#3_STANDARD"))
    return m.join(o, "obs_id").select("obs_id", "gene", "class", "source", "logn")


@query("paired_composition", """WITH g AS (SELECT source, class FROM (SELECT unnest(['reference', 'query']) AS source), (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW','9-NONE']) AS class)),
 c AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'query' ELSE 'reference' END AS source, o_orderpriority AS class, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT source, class, coalesce(n, 0) AS n, coalesce(n, 0) * 100.0 / sum(coalesce(n, 0)) OVER (PARTITION BY source) AS percent FROM g LEFT JOIN c USING (source, class)""", dbl="percent")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", "query").otherwise("reference").alias("source"), F.col("o_orderpriority").alias("class"))
    return shares(J.grid_counts(o, source=["reference", "query"], **{"class": PRIORITIES + ["9-NONE"]}), "source")

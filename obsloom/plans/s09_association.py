"""Association and redundancy."""
from itertools import combinations

from pyspark.sql import functions as F

from ..functions import special
from ..operators import assoc as A, graph, multiplicity as M, order
from .bindings import FEATURES, SQL_LONG, SQL_LONG_MISSING, SQL_OBS, SQL_OBS_MISSING, SQL_RANKED, obs, obs_missing, table
from .registry import query
from .sqltails import f_sf

PAIRS = list(combinations(FEATURES, 2))


def pairs_sql(src, name="pairs"):
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM {src}" for a, b in PAIRS) + ")"


RANK_WIDE = f"""{SQL_LONG}, {SQL_RANKED}, rw AS (SELECT obs_id, {', '.join(f"max(rk) FILTER (feature = '{f}') AS {f}" for f in FEATURES)} FROM ranked GROUP BY 1)"""


@query("pearson_matrix", f"""WITH {SQL_OBS_MISSING}, obs_c AS (SELECT * REPLACE (CASE WHEN avg_tax IS NULL THEN NULL ELSE 1.0 END AS avg_tax) FROM obs_m), {pairs_sql('obs_c')},
 up AS (SELECT a, b, coalesce(CASE WHEN isnan(r) THEN NULL ELSE r END, 0) AS r, coalesce(isnan(r), true) AS undefined FROM pairs)
SELECT * FROM up UNION ALL SELECT b, a, r, undefined FROM up UNION ALL SELECT unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) AS f, f, 1, false""", dbl="r")
def _(spark, sf):
    df = obs_missing(spark, sf).withColumn("avg_tax", F.when(F.col("avg_tax").isNotNull(), 1.0))
    return A.full_matrix(A.pair_moments(df, FEATURES), FEATURES)


@query("spearman_matrix", f"""WITH {RANK_WIDE}, {pairs_sql('rw')} SELECT a, b, n, r FROM pairs""", dbl="r")
def _(spark, sf):
    return A.spearman_pairs(obs(spark, sf, staged=True), "obs_id", FEATURES).select("a", "b", "n", "r")


PW = ["avg_price", "avg_discount", "avg_tax", "max_ship_gap"]
_pw = " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, obs_id, {a} AS x, {b} AS y FROM obs_m WHERE {a} IS NOT NULL AND {b} IS NOT NULL""" for a, b in combinations(PW, 2))


@query("spearman_pairwise", f"""WITH {SQL_OBS_MISSING}, xy AS ({_pw}), r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE AS ry FROM xy)
SELECT a, b, count(*) AS n, corr(rx, ry) AS r FROM r GROUP BY 1, 2""", dbl="r")
def _(spark, sf):
    return A.spearman_pairwise(obs_missing(spark, sf, staged=True), PW)


@query("redundant_pairs", f"""WITH {SQL_OBS}, {pairs_sql('obs')} SELECT a, b, n, r FROM pairs WHERE abs(r) >= 0.3""", dbl="r")
def _(spark, sf):
    return A.redundant_pairs(A.pair_moments(obs(spark, sf), FEATURES), 0.3).select("a", "b", "n", "r")


@query("corr_components", f"""WITH RECURSIVE {RANK_WIDE}, {pairs_sql('rw')}, e AS (SELECT a, b FROM pairs WHERE abs(r) >= 0.3 UNION ALL SELECT b, a FROM pairs WHERE abs(r) >= 0.3),
 c(feature, reach) AS (SELECT f, f FROM (SELECT unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) AS f) UNION SELECT c.feature, e.b FROM c JOIN e ON e.a = c.reach)
SELECT feature, min(reach) AS component FROM c GROUP BY 1""")
def _(spark, sf):
    p = A.spearman_pairs(obs(spark, sf, staged=True), "obs_id", FEATURES).where(F.abs("r") >= 0.3)
    nodes = spark.createDataFrame([(f,) for f in FEATURES], "feature string")
    return graph.components(nodes, p.select(F.col("a").alias("src"), F.col("b").alias("dst")), "feature")


PRIO = f"prio AS (SELECT feature, row_number() OVER (ORDER BY count(*) - count(value), feature) AS i FROM long GROUP BY feature)"


@query("greedy_nonredundant", f"""WITH RECURSIVE {SQL_LONG_MISSING}, {PRIO}, {pairs_sql('obs_m')}, e AS (SELECT a, b, abs(r) AS r FROM pairs UNION ALL SELECT b, a, abs(r) FROM pairs),
 g(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) UNION ALL
  SELECT g.i + 1, CASE WHEN len(list_intersect(g.kept, coalesce(x.near, []))) > 0 THEN g.kept ELSE list_append(g.kept, prio.feature) END
  FROM g JOIN prio ON prio.i = g.i + 1 LEFT JOIN (SELECT a, list(b) AS near FROM e WHERE r >= 0.05 GROUP BY a) x ON x.a = prio.feature),
 k AS (SELECT unnest(kept) AS feature FROM g WHERE i = {len(FEATURES)})
SELECT p.feature, k.feature IS NOT NULL AS kept, coalesce(k.feature, (SELECT arg_max(e.b, e.r) FROM e JOIN k k2 ON k2.feature = e.b JOIN prio q ON q.feature = e.b
  WHERE e.a = p.feature AND q.i < p.i)) AS representative FROM prio p LEFT JOIN k ON k.feature = p.feature""")
def _(spark, sf):
    from ..operators.aggs import wide_missingness
    df = obs_missing(spark, sf, staged=True)
    prio = wide_missingness(df, FEATURES).select("feature", F.col("n_missing").cast("double").alias("priority"))
    return A.greedy_nonredundant(A.pair_moments(df, FEATURES).select("a", "b", "r"), prio, 0.05)


@query("redundancy_stability", f"""WITH {RANK_WIDE}, {pairs_sql('rw', 'sp')}, lg AS (SELECT obs_id, {', '.join(f'ln(1 + ({f} - min({f}) OVER ()) / (sum({f}) OVER () - count(*) OVER () * min({f}) OVER ()) * 10000) AS {f}' for f in FEATURES)} FROM obs), {pairs_sql('lg', 'pe')}
SELECT a, b, sp.r AS spearman, pe.r AS pearson, abs(sp.r) >= 0.3 AND abs(pe.r) >= 0.3 AS stable FROM sp JOIN pe USING (a, b)""", dbl="spearman pearson", d=5)
def _(spark, sf):
    from ..operators.transforms import shift_sum
    from .bindings import long_of
    df = obs(spark, sf, staged=True)
    sp = A.spearman_pairs(df, "obs_id", FEATURES).select("a", "b", F.col("r").alias("spearman"))
    t = shift_sum(long_of(df, ["obs_id"], FEATURES)).groupBy("obs_id").pivot("feature", FEATURES).agg(F.first("t"))
    pe = A.pair_moments(t, FEATURES).select("a", "b", F.col("r").alias("pearson"))
    return sp.join(pe, ["a", "b"]).withColumn("stable", (F.abs("spearman") >= 0.3) & (F.abs("pearson") >= 0.3))


@query("max_partner", f"""WITH {SQL_OBS}, {pairs_sql('obs')}, e AS (SELECT a, b, r FROM pairs UNION ALL SELECT b, a, r FROM pairs),
 o AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY abs(r) DESC, b) AS rn FROM e)
SELECT a AS feature, b AS partner, r FROM o WHERE rn = 1""", dbl="r")
def _(spark, sf):
    return A.max_partner(A.pair_moments(obs(spark, sf), FEATURES))


@query("feature_covariate_corr", f"""WITH {RANK_WIDE}, {pairs_sql('rw')}, f AS (SELECT CASE WHEN a = 'o_totalprice' THEN b ELSE a END AS feature, n, r FROM pairs WHERE a = 'o_totalprice' OR b = 'o_totalprice'),
 t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM f), p AS (SELECT feature, n, r, t, {f_sf('t * t', '1', '(n - 2)')} AS p FROM t),
 o AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS i, count(*) OVER () AS m FROM p)
SELECT feature, n, r, t, p, min(least(1, p * m / i)) OVER (ORDER BY i DESC) AS q FROM o""", dbl="r t p q", d=5)
def _(spark, sf):
    c = A.spearman_pairs(obs(spark, sf, staged=True), "obs_id", FEATURES).where("a = 'o_totalprice' OR b = 'o_totalprice'")
    c = c.select(F.when(F.col("a") == "o_totalprice", F.col("b")).otherwise(F.col("a")).alias("feature"), "n", "r")
    c = c.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    c = c.withColumn("p", special.t_two_sided_col(F.col("t"), (F.col("n") - 2).cast("double")))
    return M.bh(c, "p", ["feature"], out="q")


def exact_relation(df, name, left, right, tol):
    """How well two expressions agree: largest error, rows inside the tolerance, ratio range and median."""
    e = df.select(F.lit(name).alias("relation"), F.abs(left - right).alias("err"), F.try_divide(left, right).alias("ratio"))
    m = e.groupBy("relation").agg(F.count("*").alias("n"), F.count_if(F.col("err") <= tol).alias("n_within"), F.max("err").alias("max_err"),
                                  F.min("ratio").alias("ratio_min"), F.max("ratio").alias("ratio_max"))
    return m.join(order.quantiles(e, ["relation"], "ratio", {"ratio_median": .5}), "relation")


@query("exact_relations", """WITH r AS (SELECT 'fractions sum to one' AS relation, abs(l_discount + (1 - l_discount) - 1) AS err, (l_discount + (1 - l_discount)) / 1 AS ratio FROM lineitem
 UNION ALL SELECT 'price = 1000 qty', abs(l_extendedprice - 1000 * l_quantity), l_extendedprice / (1000 * l_quantity) FROM lineitem)
SELECT relation, count(*) AS n, count(*) FILTER (err <= CASE WHEN relation LIKE 'frac%' THEN 1e-9 ELSE 20000 END) AS n_within, max(err) AS max_err,
 min(ratio) AS ratio_min, max(ratio) AS ratio_max, quantile_cont(ratio, .5) AS ratio_median FROM r GROUP BY 1""", dbl="max_err ratio_min ratio_max ratio_median", d=5)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    a = exact_relation(li, "fractions sum to one", F.col("l_discount") + (1 - F.col("l_discount")), F.lit(1.0), 1e-9)
    return a.unionByName(exact_relation(li, "price = 1000 qty", F.col("l_extendedprice"), 1000 * F.col("l_quantity"), 20000))


@query("recompute_compare", """WITH b AS (SELECT o_orderkey, o_totalprice AS old, o_totalprice * (1 + (o_orderkey % 7 - 3) * 0.01::DOUBLE) AS new FROM orders),
 r AS (SELECT *, rank() OVER (ORDER BY old) + (count(*) OVER (PARTITION BY old) - 1) / 2.0::DOUBLE AS ro, rank() OVER (ORDER BY new) + (count(*) OVER (PARTITION BY new) - 1) / 2.0::DOUBLE AS rn FROM b)
SELECT count(*) AS n, corr(ro, rn) AS spearman, median(new / old) AS median_ratio, median(abs(new - old) / abs(old)) AS median_abs_rel_error FROM r""",
       dbl="spearman median_ratio median_abs_rel_error")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("old"))
    o = o.withColumn("new", F.col("old") * (1 + (F.col("o_orderkey") % 7 - 3) * F.lit(0.01)))
    return A.recompute_compare(o, "o_orderkey", "old", "new")

"""Aggregations: group statistics, missingness, composition, library totals."""
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import aggs as A, joins as J, order
from .bindings import (FEATURES, PRIORITIES, SQL_COUNTS, SQL_LONG, SQL_LONG_MISSING, SQL_OBS, SQL_OBS_MISSING,
                       SQL_PARTS_LONG, STATUSES, counts, long, long_of, obs, obs_missing, parts_long, table)
from .registry import query


@query("group_counts", """SELECT 'priority' AS denominator, o_orderpriority AS k1, NULL AS k2, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'priority x status', o_orderpriority, nullif(o_orderstatus, 'P'), count(*) FROM orders GROUP BY 2, 3
UNION ALL SELECT 'high price', o_orderpriority, NULL, count(*) FROM orders WHERE o_totalprice > 300000 GROUP BY 2""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k1"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("k2"), "o_totalprice")

    def stack(df, name, *keys):
        return df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("denominator", F.lit(name))

    return (stack(o, "priority", "k1").unionByName(stack(o, "priority x status", "k1", "k2"), allowMissingColumns=True)
            .unionByName(stack(o.where("o_totalprice > 300000"), "high price", "k1"), allowMissingColumns=True))


@query("cohort_by_group", f"""WITH {SQL_OBS} SELECT class, batch, count(*) AS n, count(DISTINCT stratum) AS n_strata,
 count(*) FILTER (n_lines >= 4) AS n_long, count(*) FILTER (avg_discount < 0.05) AS n_low_discount FROM obs GROUP BY 1, 2""")
def _(spark, sf):
    return obs(spark, sf, stratum=True).groupBy("class", "batch").agg(
        F.count("*").alias("n"), F.countDistinct("stratum").alias("n_strata"), F.count_if(F.col("n_lines") >= 4).alias("n_long"),
        F.count_if(F.col("avg_discount") < 0.05).alias("n_low_discount"))


@query("descriptive_stats", f"""WITH {SQL_LONG_MISSING}, s AS (SELECT feature, class, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd,
  var_samp(value) AS variance, min(value) AS "min", max(value) AS "max", quantile_cont(value, .25) AS q1,
  quantile_cont(value, .5) AS median, quantile_cont(value, .75) AS q3 FROM long GROUP BY 1, 2)
SELECT *, sd / sqrt(n) AS sem, mean - 1.96 * (sd / sqrt(n)) AS ci_low, mean + 1.96 * (sd / sqrt(n)) AS ci_high, q3 - q1 AS iqr FROM s""",
       dbl='mean sd variance:1 min max q1 median q3 sem ci_low ci_high iqr', d=4)
def _(spark, sf):
    return A.descriptive(long_of(obs_missing(spark, sf, staged=True), ["obs_id", "class"], FEATURES))


@query("descriptive_shape", f"""WITH {SQL_LONG_MISSING}, s AS (SELECT feature, class, count(value) AS n, count(*) - count(value) AS n_missing,
  CAST(count(value) AS DOUBLE) AS m, skewness(value) AS g, kurtosis_pop(value) AS k, stddev_samp(value) AS sd, avg(value) AS mu
  FROM long GROUP BY 1, 2)
SELECT feature, class, n, n_missing, g * (m - 2) / sqrt(m * (m - 1)) AS skew, k AS excess_kurtosis, abs(sd * 100 / mu) AS cv_percent FROM s""",
       dbl="skew excess_kurtosis cv_percent")
def _(spark, sf):
    return A.descriptive_shape(long_of(obs_missing(spark, sf), ["obs_id", "class"], FEATURES))


@query("skewness_family", f"""WITH {SQL_LONG}, s AS (SELECT feature, count(value) AS n, CAST(count(value) AS DOUBLE) AS m, skewness(value) AS adjusted
 FROM long GROUP BY 1), t AS (SELECT *, adjusted * (m - 2) / sqrt(m * (m - 1)) AS g1 FROM s)
SELECT feature, n, g1, adjusted, g1 * pow((m - 1) / m, 1.5) AS ddof1 FROM t""", dbl="g1 adjusted ddof1")
def _(spark, sf):
    s = long(spark, sf).groupBy("feature").agg(F.count("value").alias("n"), A.g1().alias("g1"))
    n = F.col("n").cast("double")
    return s.withColumn("adjusted", A.skew_adjusted(F.col("g1"), n)).withColumn("ddof1", A.skew_ddof1(F.col("g1"), n))


@query("quantiles_type7", f"""WITH {SQL_LONG} SELECT feature, batch, quantile_cont(value, .025) AS p025, quantile_cont(value, .25) AS p25,
 quantile_cont(value, .5) AS p50, quantile_cont(value, .9) AS p90, quantile_cont(value, .975) AS p975 FROM long GROUP BY 1, 2""",
       dbl="p025 p25 p50 p90 p975", d=5)
def _(spark, sf):
    return order.quantiles(long(spark, sf), ["feature", "batch"], "value", {"p025": .025, "p25": .25, "p50": .5, "p90": .9, "p975": .975})


@query("feature_missingness", f"""WITH {SQL_LONG_MISSING} SELECT feature, count(value) AS n_observed, count(*) AS n_total,
 count(*) - count(value) AS n_missing, (count(*) - count(value)) / count(*) AS rate, (count(*) - count(value)) / count(*) > 0.20 AS excluded
 FROM long GROUP BY 1""", dbl="rate")
def _(spark, sf):
    return A.wide_missingness(obs_missing(spark, sf), FEATURES)


_NM = " + ".join(f"CAST({f} IS NULL AS BIGINT)" for f in FEATURES)


@query("row_missingness", f"""WITH {SQL_OBS_MISSING}, m AS (SELECT obs_id, {_NM} AS n_missing FROM obs_m)
SELECT obs_id, 7 - n_missing AS n_observed, n_missing, n_missing / 7 AS rate, n_missing / 7 > 0.40 AS excluded, n_missing = 0 AS complete
FROM m""", dbl="rate", big="n_observed")
def _(spark, sf):
    n = F.col("n_missing")
    return (obs_missing(spark, sf).select("obs_id", A.row_missing(FEATURES).alias("n_missing"))
            .select("obs_id", (7 - n).alias("n_observed"), "n_missing", (n / 7).alias("rate"), (n / 7 > 0.40).alias("excluded"), (n == 0).alias("complete")))


_PAT = "concat_ws('; ', " + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in FEATURES) + ")"


@query("missing_patterns", f"""WITH {SQL_OBS_MISSING} SELECT coalesce(nullif({_PAT}, ''), 'Complete') AS pattern, count(*) AS n FROM obs_m GROUP BY 1""")
def _(spark, sf):
    return obs_missing(spark, sf).groupBy(A.pattern(FEATURES).alias("pattern")).agg(F.count("*").alias("n"))


OUT, KEEP = ["avg_discount", "max_ship_gap"], ["avg_price", "avg_tax"]


@query("missing_overlap", f"""WITH {SQL_OBS_MISSING}, c AS (SELECT unnest(['all', 'F_only', batch || '_batch']) AS subset, * FROM obs_m)
SELECT subset, count(*) AS n, count(*) FILTER ((avg_discount IS NULL OR max_ship_gap IS NULL) AND NOT (avg_price IS NULL OR avg_tax IS NULL)) AS only_excluded_panel,
 count(*) FILTER (avg_price IS NULL OR avg_tax IS NULL) AS any_in_retained,
 count(*) FILTER (NOT (avg_discount IS NULL OR max_ship_gap IS NULL OR avg_price IS NULL OR avg_tax IS NULL)) AS complete
FROM c WHERE subset <> 'F_only' OR batch = 'F' GROUP BY 1""")
def _(spark, sf):
    any_null = lambda cs: F.expr(" OR ".join(f"{c} IS NULL" for c in cs))
    c = obs_missing(spark, sf).withColumn("subset", F.explode(F.filter(F.array(
        F.lit("all"), F.when(F.col("batch") == "F", "F_only"), F.concat("batch", F.lit("_batch"))), lambda x: x.isNotNull())))
    return c.groupBy("subset").agg(
        F.count("*").alias("n"), F.count_if(any_null(OUT) & ~any_null(KEEP)).alias("only_excluded_panel"),
        F.count_if(any_null(KEEP)).alias("any_in_retained"), F.count_if(~any_null(OUT + KEEP)).alias("complete"))


@query("feature_role_table", f"""WITH {SQL_LONG_MISSING}, s AS (SELECT feature, count(value) AS n_all, count(value) FILTER (batch <> 'P') AS n_eligible,
  1 - count(value) / count(*) AS missing_rate, count(DISTINCT value) AS n_unique, abs(skewness(value)) AS abs_skew FROM long GROUP BY 1)
SELECT *, CASE WHEN n_unique <= 1 THEN 'drop' WHEN missing_rate > 0.2 THEN 'sensitivity' ELSE 'primary' END AS role,
 CASE WHEN abs_skew > 1 THEN 'strong' WHEN abs_skew >= 0.5 THEN 'moderate' ELSE 'symmetric' END AS skew_status,
 CASE WHEN abs_skew > 1 THEN 'log1p' WHEN abs_skew >= 0.5 THEN 'inspect' ELSE 'none' END AS transform FROM s""", dbl="missing_rate abs_skew")
def _(spark, sf):
    df = long_of(obs_missing(spark, sf, staged=True), ["obs_id", "batch"], FEATURES)
    vc = order.value_counts(df, ["feature"], "value").groupBy("feature").agg(F.count("*").alias("n_unique"))
    s = df.groupBy("feature").agg(F.count("value").alias("n_all"), F.count(F.when(F.col("batch") != "P", F.col("value"))).alias("n_eligible"),
                                  (1 - F.count("value") / F.count("*")).alias("missing_rate"), A.g1().alias("g"))
    s = s.join(vc, "feature").withColumn("abs_skew", F.abs(A.skew_adjusted(F.col("g"), F.col("n_all").cast("double")))).drop("g")
    k = F.col("abs_skew")
    return (s.withColumn("role", X.cascade([(F.col("n_unique") <= 1, "drop"), (F.col("missing_rate") > 0.2, "sensitivity")], "primary"))
            .withColumn("skew_status", X.cascade([(k > 1, "strong"), (k >= 0.5, "moderate")], "symmetric"))
            .withColumn("transform", X.cascade([(k > 1, "log1p"), (k >= 0.5, "inspect")], "none")))


VC_SQL = """vc AS (SELECT feature, value, count(*) AS c FROM long WHERE value IS NOT NULL GROUP BY 1, 2),
 tc AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY c DESC, value) AS rn FROM vc)"""


@query("top_value_fraction", f"""WITH {SQL_LONG_MISSING}, {VC_SQL} SELECT feature, sum(c) AS n, count(*) AS n_unique,
 max(value) FILTER (rn = 1) AS top_value, max(c) / sum(c) AS top_fraction FROM tc GROUP BY 1""", dbl="top_value top_fraction", big="n")
def _(spark, sf):
    df = long_of(obs_missing(spark, sf, staged=True), ["obs_id"], FEATURES)
    return A.near_zero_variance(df).select("feature", "n", "n_unique", "top_value", "top_fraction")


@query("zero_variance", f"""WITH {SQL_PARTS_LONG}, l2 AS (SELECT * FROM long UNION ALL SELECT obs_id, class, 'constant', 1.0 FROM long WHERE feature = 'p_size')
SELECT feature, count(DISTINCT value) <= 1 AS zero_variance FROM l2 GROUP BY 1""")
def _(spark, sf):
    p = parts_long(spark, sf)
    p = p.unionByName(p.where("feature = 'p_size'").withColumn("feature", F.lit("constant")).withColumn("value", F.lit(1.0)))
    return A.near_zero_variance(p).select("feature", "zero_variance")


@query("near_zero_variance", f"""WITH {SQL_OBS}, long AS (SELECT obs_id, feature, value FROM (SELECT obs_id, n_lines, sum_qty, CASE WHEN o_totalprice > 480000 THEN 1.0::DOUBLE
   ELSE 0.0::DOUBLE END AS is_large, o_totalprice FROM obs) UNPIVOT (value FOR feature IN (n_lines, sum_qty, is_large, o_totalprice))), {VC_SQL}
SELECT feature, max(c) FILTER (rn = 1) / max(c) FILTER (rn = 2) AS freq_ratio, 100.0::DOUBLE * count(*) / sum(c) AS unique_percent,
 coalesce(max(c) FILTER (rn = 1) / max(c) FILTER (rn = 2) >= 19 AND 100.0 * count(*) / sum(c) <= 10, count(*) <= 1) AS near_zero FROM tc GROUP BY 1""",
       dbl="freq_ratio unique_percent")
def _(spark, sf):
    df = obs(spark, sf, staged=True).withColumn("is_large", (F.col("o_totalprice") > 480000).cast("double"))
    return A.near_zero_variance(long_of(df, ["obs_id"], ["n_lines", "sum_qty", "is_large", "o_totalprice"])).select(
        "feature", "freq_ratio", "unique_percent", "near_zero")


GRID_SQL = """grid AS (SELECT class, label, count(o_orderkey) AS n FROM (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW']) AS class),
 (SELECT unnest(['F','O','P']) AS label) LEFT JOIN orders ON o_orderpriority = class AND o_orderstatus = label GROUP BY 1, 2)"""


def _grid(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("label"))
    return J.grid_counts(o, **{"class": PRIORITIES, "label": STATUSES})


@query("crosstab", f"""WITH {GRID_SQL} SELECT class, label, n, n * 100.0 / sum(n) OVER (PARTITION BY class) AS row_percent FROM grid""", dbl="row_percent")
def _(spark, sf):
    return A.shares(_grid(spark, sf), "class", out="row_percent")


@query("composition_percent", f"""WITH {GRID_SQL}, p AS (SELECT label, class, n, n * 100.0 / sum(n) OVER (PARTITION BY label) AS percent FROM grid)
SELECT *, sum(percent) OVER (PARTITION BY label) AS check_sum FROM p""", dbl="percent check_sum")
def _(spark, sf):
    p = A.shares(_grid(spark, sf), "label")
    tot = p.groupBy("label").agg(F.sum("percent").alias("check_sum"))
    bad = F.abs(F.col("check_sum") - 100) > 1e-9
    return p.join(tot, "label").withColumn("check_sum", F.when(bad, F.raise_error(F.lit("percents do not sum to 100"))).otherwise(F.col("check_sum")))


@query("pivot_wide", """SELECT o_orderpriority AS class, """ + ", ".join(
    f"coalesce(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 0) AS {s}" for s in STATUSES) + " FROM orders GROUP BY 1", dbl="F O P", d=2)
def _(spark, sf):
    return (table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("class")).pivot("o_orderstatus", STATUSES)
            .agg(F.sum("o_totalprice")).na.fill(0.0, STATUSES))


@query("melt_long", f"WITH {SQL_LONG_MISSING} SELECT obs_id, class, feature, value FROM long", dbl="value")
def _(spark, sf):
    return long_of(obs_missing(spark, sf), ["obs_id", "class"], FEATURES)


ZF = ["sum_qty", "avg_discount", "avg_tax", "o_totalprice"]
_ZS = ", ".join(f"({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER () AS {f}" for f in ZF)


def standardised(df, features):
    """z columns from one aggregate of the table, fitted values applied as literals."""
    m = df.agg(*[F.avg(f).alias("m_" + f) for f in features], *[F.stddev_samp(f).alias("s_" + f) for f in features]).first()
    return {f: (F.col(f) - F.lit(m["m_" + f])) / F.lit(m["s_" + f]) for f in features}


@query("flag_rollup", f"""WITH {SQL_OBS}, z AS (SELECT obs_id, {_ZS} FROM obs),
 h AS (SELECT obs_id, feature, abs(v) AS a FROM z UNPIVOT (v FOR feature IN ({', '.join(ZF)})))
SELECT obs_id, count(*) FILTER (a >= 1.5) AS n_flags, max(a) AS max_abs_z, coalesce(string_agg(feature, ';' ORDER BY feature) FILTER (a >= 1.5), '') AS flagged,
 CASE WHEN count(*) FILTER (a >= 1.5) >= 2 OR max(a) > 3 THEN 'high' WHEN count(*) FILTER (a >= 1.5) = 1 THEN 'medium' ELSE 'none' END AS priority
FROM h GROUP BY 1""", dbl="max_abs_z")
def _(spark, sf):
    df = obs(spark, sf, staged=True)
    return A.flag_rollup(df, standardised(df, ZF), 1.5).select("obs_id", "n_flags", "max_abs_z", "flagged", "priority")


@query("resample_summary", f"""WITH {SQL_OBS}, m AS (SELECT stratum AS rep, class, avg(sum_qty) AS q, avg(o_totalprice) AS p FROM obs GROUP BY 1, 2)
SELECT class, metric, count(*) AS n_rep, quantile_cont(value, .5) AS median, quantile_cont(value, .025) AS q025, quantile_cont(value, .975) AS q975
FROM m UNPIVOT (value FOR metric IN (q, p)) GROUP BY 1, 2""", dbl="median q025 q975", d=4)
def _(spark, sf):
    m = obs(spark, sf, stratum=True, staged=True).groupBy("stratum", "class").agg(F.avg("sum_qty").alias("q"), F.avg("o_totalprice").alias("p"))
    return resample_summary(m.unpivot(["stratum", "class"], ["q", "p"], "metric", "value"), ["class", "metric"])


def resample_summary(df, keys):
    n = df.groupBy(*keys).agg(F.count("value").alias("n_rep"))
    return n.join(order.quantiles(df, keys, "value", {"median": .5, "q025": .025, "q975": .975}), keys)


STAGES = [("1 all", "true"), ("2 two lines", "n_lines >= 2"), ("3 ship gap", "n_lines >= 2 AND max_ship_gap >= 0"),
          ("4 in price range", "n_lines >= 2 AND max_ship_gap >= 0 AND o_totalprice BETWEEN 10000 AND 450000")]


@query("cohort_flow", f"WITH {SQL_OBS} " + " UNION ALL ".join(
    f"SELECT '{n}' AS stage, class, count(*) FILTER ({c}) AS n, count(*) FILTER ({c}) * 100.0 / count(*) AS retention FROM obs GROUP BY class"
    for n, c in STAGES), dbl="retention")
def _(spark, sf):
    s = [F.struct(F.lit(n).alias("stage"), F.count_if(F.expr(c)).alias("n"), F.count("*").alias("n0")) for n, c in STAGES]
    out = obs(spark, sf).groupBy("class").agg(F.array(*s).alias("s")).select("class", F.explode("s").alias("s")).select("class", "s.*")
    return out.select("stage", "class", "n", (F.col("n") * 100.0 / F.col("n0")).alias("retention"))


_ZALL = ", ".join(f"({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER () AS {f}" for f in FEATURES)


@query("class_centroid", f"""WITH {SQL_OBS}, z AS (SELECT class, {_ZALL} FROM obs)
SELECT class, count(*) AS n, {', '.join(f'avg({f}) AS {f}' for f in FEATURES)} FROM z GROUP BY 1""", dbl=" ".join(FEATURES))
def _(spark, sf):
    df = obs(spark, sf, staged=True)
    z = standardised(df, FEATURES)
    return df.select("class", *[c.alias(f) for f, c in z.items()]).groupBy("class").agg(
        F.count("*").alias("n"), *[F.avg(f).alias(f) for f in FEATURES])


@query("class_median_iqr", f"""WITH {SQL_LONG} SELECT feature, class, quantile_cont(value, .25) AS q25, quantile_cont(value, .5) AS median,
 quantile_cont(value, .75) AS q75 FROM long GROUP BY 1, 2""", dbl="q25 median q75", d=5)
def _(spark, sf):
    return order.quantiles(long(spark, sf), ["feature", "class"], "value", {"q25": .25, "median": .5, "q75": .75})


@query("peak_class_features", f"""WITH {SQL_LONG}, m AS (SELECT feature, class, avg(value) AS mu FROM long GROUP BY 1, 2),
 s AS (SELECT feature, avg(value) AS m0, stddev_samp(value) AS s0 FROM long GROUP BY 1),
 z AS (SELECT feature, class, (mu - m0) / s0 AS z, row_number() OVER (PARTITION BY feature ORDER BY (mu - m0) / s0 DESC, class) AS rn FROM m JOIN s USING (feature)),
 p AS (SELECT feature, max(class) FILTER (rn = 1) AS peak_class, max(z) FILTER (rn = 1) AS peak, max(z) FILTER (rn = 1) - max(z) FILTER (rn = 2) AS margin FROM z GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY margin DESC, feature) AS position FROM p""", dbl="peak margin", big="position")
def _(spark, sf):
    df = long(spark, sf, staged=True)
    m = df.groupBy("feature", "class").agg(F.avg("value").alias("mu"))
    s = df.groupBy("feature").agg(F.avg("value").alias("m0"), F.stddev_samp("value").alias("s0"))
    z = m.join(s, "feature").withColumn("z", (F.col("mu") - F.col("m0")) / F.col("s0"))
    top = J.topk(z, ["feature"], [F.desc("z"), "class"], 2)
    p = top.groupBy("feature").agg(F.max(F.when(F.col("rn") == 1, F.col("class"))).alias("peak_class"),
                                   F.max(F.when(F.col("rn") == 1, F.col("z"))).alias("peak"),
                                   (F.max(F.when(F.col("rn") == 1, F.col("z"))) - F.max(F.when(F.col("rn") == 2, F.col("z")))).alias("margin"))
    return A.window_rank(p, [F.desc("margin"), "feature"])


@query("mode_vote", """WITH v AS (SELECT l_partkey, l_returnflag AS label, count(*) AS c FROM lineitem GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY c DESC, label) AS rn FROM v)
SELECT l_partkey, max(label) FILTER (rn = 1) AS modal, sum(c) AS n_votes, max(c) / sum(c) AS agreement FROM r GROUP BY 1""", dbl="agreement", big="n_votes")
def _(spark, sf):
    return A.mode_vote(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "label"), "l_partkey")


def library_totals(li, key):
    """Total counts, the share inside the strict region, and the non-negative remainder."""
    body, exon = F.col("body"), F.col("exon")
    t = li.groupBy(key).agg(F.sum("body").alias("total"), F.sum(F.greatest(body - exon, F.lit(0.0))).alias("intron"), F.sum("exon").alias("exon"))
    lg = t.unpivot([key], ["total", "intron", "exon"], "feature", "value").withColumn("log10_value", F.log10(F.col("value") + 1))
    med = order.quantiles(lg, ["feature"], "value", {"median": .5})
    m = lg.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
                                  F.avg("log10_value").alias("mean_log10"), F.stddev_samp("log10_value").alias("sd_log10"))
    return m.join(med, "feature")


@query("library_totals", """WITH t AS (SELECT l_orderkey, sum(l_quantity) AS total, sum(greatest(l_quantity - 20 * l_discount * 10, 0)) AS intron,
  sum(20 * l_discount * 10) AS exon FROM lineitem GROUP BY 1),
 u AS (SELECT feature, value FROM t UNPIVOT (value FOR feature IN (total, intron, exon)))
SELECT feature, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, avg(log10(value + 1)) AS mean_log10, stddev_samp(log10(value + 1)) AS sd_log10,
 quantile_cont(value, .5) AS median FROM u GROUP BY 1""", dbl="mean sd mean_log10 sd_log10 median", d=5)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("body"), (20 * F.col("l_discount") * 10).alias("exon"))
    return library_totals(li, "l_orderkey")


def detection(c, n_total, min_cells=8):
    """Cells with a positive count and variance per gene; absent triplets are zeros."""
    g = c.where("value > 0").groupBy("gene").agg(F.count("*").alias("n_detected"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    g = g.withColumn("one", F.lit(1)).join(n_total.withColumn("one", F.lit(1)), "one").drop("one")
    n = F.col("n_total")
    return (g.withColumn("mean", F.col("s1") / n).withColumn("variance", (F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1))
            .withColumn("expressed", F.col("n_detected") >= min_cells).drop("s1", "s2"))


@query("detection_counts", f"""WITH {SQL_COUNTS}, t AS (SELECT count(DISTINCT obs_id) AS n_total FROM counts)
SELECT gene, count(*) AS n_detected, n_total, sum(value) / n_total AS mean, (sum(value * value) - sum(value) * sum(value) / n_total) / (n_total - 1) AS variance,
 count(*) >= 200 AS expressed FROM counts, t WHERE value > 0 GROUP BY gene, n_total""", dbl="mean variance")
def _(spark, sf):
    c = counts(spark, sf)
    n = table(spark, sf, "lineitem").agg(F.countDistinct("l_orderkey").alias("n_total"))
    return detection(c, n, min_cells=200)

"""Typing, projection and predicates."""
import math

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import order, qc
from ..runtime import stage
from .bindings import (FEATURES, SQL_COUNTS, SQL_LONG, SQL_LONG_MISSING, SQL_OBS, SQL_OBS_MISSING, counts, long, long_of,
                       obs, obs_missing, table)
from .registry import query

MESSY_SQL = """messy AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'NA' WHEN c_custkey % 11 = 0 THEN 'n/a?'
   WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN 'None' ELSE CAST(c_acctbal AS VARCHAR) END AS raw,
   CAST(c_nationkey AS VARCHAR) AS nat, CASE WHEN c_custkey % 2 = 0 THEN '' END AS blank FROM customer)"""


def messy(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 7 == 0, "NA").when(k % 11 == 0, "n/a?").when(k % 13 == 0, "").when(k % 17 == 0, "None")
        .otherwise(F.col("c_acctbal").cast("string")).alias("raw"),
        F.col("c_nationkey").cast("string").alias("nat"), F.when(k % 2 == 0, "").alias("blank"))


@query("coerce_numeric", f"""WITH {MESSY_SQL} SELECT id, TRY_CAST(raw AS DOUBLE) AS value FROM messy""", dbl="value", d=2)
def _(spark, sf):
    return messy(spark, sf).select("id", X.to_number("raw").alias("value"))


@query("conversion_failures", f"""WITH {MESSY_SQL}, l AS (SELECT "column", v FROM messy
  UNPIVOT INCLUDE NULLS (v FOR "column" IN (raw, nat, blank)))
SELECT "column", count(*) FILTER (trim(v) <> '') AS n_filled,
  count(*) FILTER (trim(v) <> '' AND TRY_CAST(v AS DOUBLE) IS NULL) AS n_failed,
  CASE WHEN count(*) FILTER (trim(v) <> '' AND TRY_CAST(v AS DOUBLE) IS NULL) > 0 THEN 'drop_unparseable'
       WHEN count(*) FILTER (trim(v) <> '') = 0 THEN 'drop_empty' ELSE 'keep' END AS decision FROM l GROUP BY 1""")
def _(spark, sf):
    return qc.conversion_failures(messy(spark, sf), ["raw", "nat", "blank"])


PANEL = ["avg_price", "avg_discount", "avg_tax"]
_txt = ", ".join(f"CAST(CAST(floor({c} * 1000) AS BIGINT) AS VARCHAR) AS {c}" for c in PANEL)
_tok = ", ".join(f"CASE WHEN avg_price IS NULL AND avg_discount IS NULL AND avg_tax IS NULL THEN 'NR' "
                 f"ELSE coalesce({c}, 'NaN') END AS {c}" for c in PANEL)


@query("missing_tokens", f"WITH {SQL_OBS_MISSING}, t AS (SELECT obs_id, class, {_txt} FROM obs_m) "
                         f"SELECT obs_id, class, {_tok} FROM t")
def _(spark, sf):
    t = obs_missing(spark, sf).select("obs_id", "class", *[F.floor(F.col(c) * 1000).cast("string").alias(c) for c in PANEL])
    return qc.missing_tokens(t, PANEL)


@query("parse_truthy", """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 't' WHEN 2 THEN '1'
  WHEN 3 THEN 'Yes' WHEN 4 THEN 'no' WHEN 5 THEN '' END AS s FROM orders)
SELECT o_orderkey, coalesce(lower(trim(s)) IN ('true','t','1','yes'), false) AS flag FROM t""")
def _(spark, sf):
    m = F.col("o_orderkey") % 7
    s = F.when(m == 0, " TRUE ").when(m == 1, "t").when(m == 2, "1").when(m == 3, "Yes").when(m == 4, "no").when(m == 5, "")
    return table(spark, sf, "orders").select("o_orderkey", X.truthy(s).alias("flag"))


@query("threshold_qc", f"""WITH {SQL_OBS_MISSING} SELECT obs_id, avg_price, avg_discount, max_ship_gap FROM obs_m
 WHERE coalesce(avg_price > 20000 AND avg_price <= 80000 AND avg_discount >= 0.03 AND avg_discount < 0.09
   AND max_ship_gap >= 30, false)""", dbl="avg_price avg_discount max_ship_gap")
def _(spark, sf):
    ok = X.all_of([X.within("avg_price", 20000, 80000, lo_open=True),
                   X.within("avg_discount", 0.03, 0.09, hi_open=True), X.within("max_ship_gap", 30)])
    return obs_missing(spark, sf).where(ok).select("obs_id", "avg_price", "avg_discount", "max_ship_gap")


@query("complete_case", f"""WITH {SQL_OBS_MISSING} SELECT class, count(*) AS n, sum(sum_qty) AS qty FROM obs_m
 WHERE avg_price IS NOT NULL AND avg_discount IS NOT NULL AND avg_tax IS NOT NULL AND max_ship_gap IS NOT NULL
 GROUP BY class""", dbl="qty", d=2)
def _(spark, sf):
    return (qc.complete_case(obs_missing(spark, sf), FEATURES).groupBy("class")
            .agg(F.count("*").alias("n"), F.sum("sum_qty").alias("qty")))


EXCL_SQL = "excl AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING')"


def excluded(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal < 0 OR c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))


@query("exclusion_filter", f"""WITH {EXCL_SQL} SELECT o_orderkey, o_custkey AS id, 'kept' AS part FROM orders
  WHERE o_custkey NOT IN (SELECT id FROM excl)
UNION ALL SELECT NULL, o_custkey, 'removed' FROM orders WHERE o_custkey IN (SELECT id FROM excl)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    kept, removed = qc.exclusion_filter(o, excluded(spark, sf), "id")
    return kept.withColumn("part", F.lit("kept")).unionByName(removed.withColumn("part", F.lit("removed")),
                                                              allowMissingColumns=True)


@query("assert_not_excluded", f"""WITH {EXCL_SQL} SELECT DISTINCT o_custkey AS id FROM orders JOIN excl ON id = o_custkey
 WHERE o_orderstatus = 'P'""")
def _(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return qc.assert_not_excluded(o, excluded(spark, sf), "id")


@query("quarantine_transition", """WITH b AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice < 50000 THEN 'excluded' ELSE 'included'
   END AS previous_status FROM orders),
 q AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09)
SELECT b.id, previous_status, CASE WHEN q.id IS NOT NULL THEN 'late return' END AS reason, q.id IS NOT NULL AS quarantined,
 CASE WHEN q.id IS NOT NULL AND previous_status = 'included' THEN 'quarantined' ELSE previous_status END AS current_status,
 q.id IS NOT NULL AND previous_status = 'included' AS reversible FROM b LEFT JOIN q ON b.id = q.id""")
def _(spark, sf):
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") < 50000, "excluded")
                                          .otherwise("included").alias("status"))
    q = (table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_discount >= 0.09")
         .select(F.col("l_orderkey").alias("id"), F.lit("late return").alias("reason")))
    return qc.transition(b, q, "id")


@query("class_map", """SELECT p_type, CASE WHEN regexp_matches(lower(p_type), 'econ|promo') THEN 'low'
  WHEN regexp_matches(lower(p_type), '^st') THEN 'mid' WHEN regexp_matches(lower(p_type), 'large|medium') THEN 'high'
  ELSE 'unresolved' END AS cls, count(*) AS n FROM part GROUP BY 1, 2""")
def _(spark, sf):
    rules = [("econ|promo", "low"), ("^st", "mid"), ("large|medium", "high")]
    return table(spark, sf, "part").groupBy("p_type", qc.class_map(F.col("p_type"), rules).alias("cls")).agg(
        F.count("*").alias("n"))


FAMILY_RULES = [("avg_discount", "fraction"), ("avg_tax", "fraction"), ("n_", "count"), ("qty", "count"), ("price", "size"),
                ("gap", "size")]
FAMILY_SQL = ("CASE WHEN contains(feature,'avg_discount') OR contains(feature,'avg_tax') THEN 'fraction' "
              "WHEN contains(feature,'n_') OR contains(feature,'qty') THEN 'count' "
              "WHEN contains(feature,'price') OR contains(feature,'gap') THEN 'size' ELSE 'other' END")


@query("feature_family", f"WITH {SQL_LONG} SELECT feature, {FAMILY_SQL} AS family, count(*) AS n FROM long GROUP BY 1, 2")
def _(spark, sf):
    return (long(spark, sf).groupBy("feature").agg(F.count("*").alias("n"))
            .withColumn("family", qc.family_of(F.col("feature"), FAMILY_RULES)))


@query("logical_range", f"""WITH {SQL_LONG}, f AS (SELECT *, {FAMILY_SQL} AS family FROM long)
SELECT feature, family, count(*) AS n, count(*) FILTER (CASE family WHEN 'fraction' THEN value < 0 OR value > 1
  WHEN 'count' THEN value < 0 OR value <> floor(value) WHEN 'size' THEN value < 0 ELSE false END) AS n_violations
FROM f GROUP BY 1, 2""")
def _(spark, sf):
    return qc.logical_range(long(spark, sf), qc.family_of(F.col("feature"), FAMILY_RULES))


@query("availability_class", f"""WITH {SQL_LONG_MISSING} SELECT feature, class, count(value) AS n_observed, count(*) AS n_total,
 CASE WHEN count(value) = 0 THEN 'all_missing' WHEN count(value) = count(*) THEN 'complete' ELSE 'partial' END AS availability
FROM long GROUP BY 1, 2""")
def _(spark, sf):
    df = long_of(obs_missing(spark, sf), ["obs_id", "class"], FEATURES)
    return (df.groupBy("feature", "class").agg(F.count("value").alias("n_observed"), F.count("*").alias("n_total"))
            .withColumn("availability", qc.availability(F.col("n_observed"), F.col("n_total"))))


@query("id_regex_keys", r"""SELECT c_custkey, CAST(regexp_extract(c_name, '#0*([0-9]+)$', 1) AS BIGINT) AS num,
 regexp_extract(c_name, '^([A-Za-z]+)#', 1) AS prefix, regexp_extract(c_name, '([0-9]{2})$', 1) AS batch FROM customer""")
def _(spark, sf):
    num = F.regexp_extract("c_name", r"#0*([0-9]+)$", 1)
    checked = F.when(num == "", F.raise_error(F.concat(F.lit("no number in id "), "c_name"))).otherwise(num)
    return table(spark, sf, "customer").select(
        "c_custkey", checked.cast("long").alias("num"), F.regexp_extract("c_name", r"^([A-Za-z]+)#", 1).alias("prefix"),
        F.regexp_extract("c_name", r"([0-9]{2})$", 1).alias("batch"))


def prefix_columns(names, prefixes, expected=None, drop=()):
    """Columns that start with one of the prefixes, without the redundant ones; the count is asserted."""
    kept = [n for n in names if n.startswith(tuple(prefixes)) and n not in drop]
    if expected is not None and len(kept) != expected:
        raise ValueError(f"expected {expected} columns, found {kept}")
    return kept


@query("prefix_columns", f"""WITH {SQL_OBS} SELECT class, sum(avg_price) AS avg_price, sum(avg_discount) AS avg_discount,
 sum(max_ship_gap) AS max_ship_gap FROM obs GROUP BY class""", dbl="avg_price avg_discount max_ship_gap", d=2)
def _(spark, sf):
    df = obs(spark, sf)
    cols = prefix_columns(df.columns, ["avg_", "max_"], expected=3, drop=["avg_tax"])
    return df.groupBy("class").agg(*[F.sum(c).alias(c) for c in cols])


@query("derived_features", f"""WITH {SQL_OBS} SELECT obs_id, avg_discount - avg_tax AS balance,
 avg_discount / nullif(avg_discount + avg_tax, 0) AS fraction, sin(2 * pi() * (max_ship_gap / 365)) AS season_sin,
 cos(2 * pi() * (max_ship_gap / 365)) AS season_cos FROM obs""", dbl="balance fraction season_sin season_cos")
def _(spark, sf):
    a, b = F.col("avg_discount"), F.col("avg_tax")
    th = 2 * math.pi * (F.col("max_ship_gap") / 365)
    return obs(spark, sf).select("obs_id", (a - b).alias("balance"), F.try_divide(a, a + b).alias("fraction"),
                                 F.sin(th).alias("season_sin"), F.cos(th).alias("season_cos"))


@query("reason_cascade", f"""WITH {SQL_OBS_MISSING} SELECT CASE WHEN n_lines < 2 THEN 'too few lines'
 WHEN max_ship_gap IS NULL THEN 'no valid ship gap' WHEN avg_discount IS NULL AND avg_tax IS NULL THEN 'no rates'
 WHEN o_totalprice > 450000 THEN 'price above range' ELSE 'included' END AS reason,
 n_lines >= 2 AND max_ship_gap IS NOT NULL AS e_eligible, avg_discount IS NOT NULL AND avg_tax IS NOT NULL AS t_eligible,
 count(*) AS n FROM obs_m GROUP BY 1, 2, 3""")
def _(spark, sf):
    c = F.col
    reason = X.cascade([(c("n_lines") < 2, "too few lines"), (c("max_ship_gap").isNull(), "no valid ship gap"),
                        (c("avg_discount").isNull() & c("avg_tax").isNull(), "no rates"),
                        (c("o_totalprice") > 450000, "price above range")], "included")
    return obs_missing(spark, sf).groupBy(
        reason.alias("reason"), ((c("n_lines") >= 2) & c("max_ship_gap").isNotNull()).alias("e_eligible"),
        (c("avg_discount").isNotNull() & c("avg_tax").isNotNull()).alias("t_eligible")).agg(F.count("*").alias("n"))


@query("exclusion_manifest", """WITH s AS (
 SELECT l_orderkey AS id, 0 AS prec, 'lines' AS stage, 'discount limit' AS reason FROM lineitem WHERE l_discount >= 0.1
 UNION SELECT o_orderkey, 1, 'orders', 'price limit' FROM orders WHERE o_totalprice > 400000
 UNION SELECT o_orderkey, 2, 'customer', 'debtor' FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0)
SELECT id, arg_min(stage, prec) AS stage, arg_min(reason, prec) AS primary_reason,
 string_agg(reason, '; ' ORDER BY prec) AS all_reasons, count(*) AS n_reasons FROM s GROUP BY id""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").where("l_discount >= 0.1").select(F.col("l_orderkey").alias("id"), F.lit("discount limit").alias("reason"))
    od = table(spark, sf, "orders")
    price = od.where("o_totalprice > 400000").select(F.col("o_orderkey").alias("id"), F.lit("price limit").alias("reason"))
    cu = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    debt = od.join(cu, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("id"), F.lit("debtor").alias("reason"))
    return qc.exclusion_manifest([("lines", li), ("orders", price), ("customer", debt)])


@query("significance_label", """SELECT c_custkey, CASE WHEN p <= 0.0001 THEN '****' WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**'
 WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS label FROM (SELECT c_custkey, exp(-abs(c_acctbal) / 700) AS p FROM customer)""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.stars(F.exp(-F.abs("c_acctbal") / 700)).alias("label"))


@query("winsorize", """SELECT c_custkey, c_acctbal AS raw, least(greatest(c_acctbal, 0), 5000) AS shown FROM customer""",
       dbl="raw shown", d=2)
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("raw"), X.clip("c_acctbal", 0.0, 5000.0).alias("shown"))


def quantile_scale(long_df, lo=0.025, hi=0.975):
    """Per feature (x - q_lo) / (q_hi - q_lo) clipped to the unit interval; no spread gives 0.5."""
    q = stage(order.quantiles(long_df, ["feature"], "value", {"q_lo": lo, "q_hi": hi}))
    x = (F.col("value") - F.col("q_lo")) / (F.col("q_hi") - F.col("q_lo"))
    return long_df.join(q, "feature").withColumn(
        "scaled", F.when(F.col("q_hi") > F.col("q_lo"), X.clip(x, 0.0, 1.0)).otherwise(F.lit(0.5)))


@query("quantile_scale", f"""WITH {SQL_LONG}, q AS (SELECT feature, quantile_cont(value, 0.025) AS a, quantile_cont(value, 0.975) AS b
 FROM long GROUP BY feature)
SELECT obs_id, feature, CASE WHEN b > a THEN least(greatest((value - a) / (b - a), 0), 1) ELSE 0.5 END AS scaled
FROM long JOIN q USING (feature)""", dbl="scaled")
def _(spark, sf):
    return quantile_scale(long(spark, sf, staged=True)).select("obs_id", "feature", "scaled")


# Gene name shapes that carry no biology (mitochondrial, ribosomal, predicted, spike-in).
TECHNICAL_GENES = r"(?i)^(mt-|rp[sl][0-9]|gm[0-9]+$|ercc-)|rik$|^malat1$|^xist$"


def technical_gene(name):
    return name.rlike(TECHNICAL_GENES)


@query("technical_gene_filter", f"""WITH {SQL_COUNTS} SELECT gene, count(*) AS n_obs, sum(value) AS total FROM counts
 WHERE NOT regexp_matches(gene, '^Brand#1_|SMALL$|^Brand#[0-9]+_PROMO$') GROUP BY gene""", dbl="total", d=2)
def _(spark, sf):
    rule = r"^Brand#1_|SMALL$|^Brand#[0-9]+_PROMO$"
    return (counts(spark, sf).where(~F.col("gene").rlike(rule)).groupBy("gene")
            .agg(F.count("*").alias("n_obs"), F.sum("value").alias("total")))


@query("strict_identity", """WITH b AS (SELECT o_orderkey AS id, o_orderpriority AS a, CASE WHEN o_totalprice < 250000
   THEN '1-URGENT' ELSE '5-LOW' END AS b, o_orderstatus <> 'P' AS stable FROM orders)
SELECT id, CASE WHEN stable AND a = b THEN a END AS identity, CASE WHEN NOT stable THEN 'unstable' WHEN a = b THEN 'strict'
 ELSE 'ambiguous' END AS status FROM b""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("a"),
        F.when(F.col("o_totalprice") < 250000, "1-URGENT").otherwise("5-LOW").alias("b"),
        (F.col("o_orderstatus") != "P").alias("stable"))
    ok = F.col("stable") & (F.col("a") == F.col("b"))
    return o.select("id", F.when(ok, F.col("a")).alias("identity"),
                    X.cascade([(~F.col("stable"), "unstable"), (F.col("a") == F.col("b"), "strict")], "ambiguous").alias("status"))

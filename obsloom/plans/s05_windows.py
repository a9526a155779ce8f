"""Ranks, running frames, adjustments, and sort / top-k / set operations."""
from pyspark.sql import functions as F

from ..functions.scalar import draw
from ..operators import aggs as A, joins as J, multiplicity as M, order, rank_tests as R
from ..runtime import stage
from .bindings import SQL_COUNTS, SQL_LONG, SQL_OBS, SQL_POINTS, SQL_RANKED, counts, long, obs, points, table
from .registry import query


@query("avg_rank", f"""WITH {SQL_LONG}, {SQL_RANKED} SELECT DISTINCT feature, value, ties AS c, rk AS rank FROM ranked""", dbl="value rank")
def _(spark, sf):
    return order.avg_ranks(long(spark, sf), ["feature"], "value").select("feature", "value", "c", "rank")


TIER = "CASE WHEN o_totalprice >= 350000 THEN 'High' WHEN o_totalprice >= 150000 THEN 'Moderate' ELSE 'Low' END"


@query("row_number_tiers", f"""WITH t AS (SELECT o_orderkey, {TIER} AS tier, o_totalprice AS p FROM orders)
SELECT o_orderkey, tier, row_number() OVER (ORDER BY p, o_orderkey) AS global_rank, row_number() OVER (PARTITION BY tier ORDER BY p, o_orderkey) AS tier_rank,
 count(*) OVER (PARTITION BY tier) AS tier_size FROM t""")
def _(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", F.expr(TIER).alias("tier"), F.col("o_totalprice").alias("p"))
    return ordered_positions(t, ["tier"], "p", "o_orderkey")


def ordered_positions(df, tier, value, key):
    """Distinct positions overall and per tier; rows that share a value are ordered by numeric key among themselves.

    The position is an offset per distinct value plus the place inside the value, and both come
    from the bucketed running count, so neither a tier nor a value is sorted in one task.
    """
    def place(keys, out, size):
        c = order.value_counts(df, keys, value)
        start = order.cumulative_counts(c, keys, value).select(*keys, value, (F.col("cum") - F.col("c")).alias("start"), F.col("n").alias(size))
        rows = df.select(key, *keys, value).withColumn("c", F.lit(1).cast("long"))
        inside = order.cumulative_counts(rows, [*keys, value], key).select(key, *keys, value, "cum")
        return inside.join(start, [*keys, value]).select(key, *keys, (F.col("start") + F.col("cum")).alias(out), size)

    return place([], "global_rank", "_n").drop("_n").join(place(tier, "tier_rank", "tier_size"), key)


@query("group_total_window", """SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_extendedprice, sum(l_extendedprice) OVER (PARTITION BY l_returnflag) AS group_total,
 l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_returnflag) AS share FROM lineitem""", dbl="l_extendedprice group_total:2 share:12")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag")
    tot = stage(li.groupBy("l_returnflag").agg(F.sum("l_extendedprice").alias("group_total")))
    return li.join(tot, "l_returnflag").withColumn("share", F.col("l_extendedprice") / F.col("group_total")).drop("l_returnflag")


def cumulative_share(df, weight, ties, thresholds=(0.7, 0.8, 0.9), **kw):
    """Cumulative share from the largest weight down, with the first position reaching each threshold."""
    total = F.col(f"all_{weight}")
    out = order.positions(df, -F.col(weight), ties, run=weight, **kw).withColumns(
        {"share": F.col(weight) / total, "cumulative": F.col(f"run_{weight}") / total}).drop(f"run_{weight}", f"all_{weight}")
    for t in thresholds:
        out = out.withColumn(f"first_{int(t * 100)}", (F.col("cumulative") >= t) & (F.col("cumulative") - F.col("share") < t))
    return out


@query("cumulative_share", """WITH v AS (SELECT p_brand, sum(l_extendedprice) AS w FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
 c AS (SELECT p_brand, row_number() OVER (ORDER BY w DESC, p_brand) AS position, w / sum(w) OVER () AS share FROM v),
 d AS (SELECT *, sum(share) OVER (ORDER BY position) AS cumulative FROM c)
SELECT *, cumulative >= 0.7 AND cumulative - share < 0.7 AS first_70, cumulative >= 0.8 AND cumulative - share < 0.8 AS first_80,
 cumulative >= 0.9 AND cumulative - share < 0.9 AS first_90 FROM d""", dbl="share cumulative")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    v = table(spark, sf, "lineitem").join(p, "l_partkey").groupBy("p_brand").agg(F.sum("l_extendedprice").alias("w"))
    return cumulative_share(v, "w", ["p_brand"]).drop("w")


# p-values: Kruskal-Wallis of each feature over the five priorities, inside each nation
P_SQL = f"""{SQL_LONG}, rk AS (SELECT *, rank() OVER (PARTITION BY stratum, feature ORDER BY value) + (count(*) OVER (PARTITION BY stratum, feature, value) - 1) / 2.0::DOUBLE AS r,
   count(*) OVER (PARTITION BY stratum, feature, value) AS c FROM long WHERE value IS NOT NULL),
 g AS (SELECT stratum, feature, class, count(*) AS n_g, sum(r) AS s, sum(CAST(c AS DOUBLE) * c - 1) AS t FROM rk GROUP BY 1, 2, 3),
 h0 AS (SELECT stratum, feature, CAST(sum(n_g) AS DOUBLE) AS n, count(*) AS k, sum(s * s / n_g) AS ss, sum(t) AS t FROM g GROUP BY 1, 2),
 hh AS (SELECT stratum, feature, (12 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM h0),
 pv AS (SELECT stratum, feature, exp(-h / 2) * (1 + h / 2) AS p FROM hh)"""


def nation_p(spark, sf):
    sums = R.rank_sums(long(spark, sf, stratum=True), ["stratum", "feature"])
    return R.kruskal_wallis(sums, ["stratum", "feature"], even_df=4).select("stratum", "feature", "p")


@query("holm_adjust", f"""WITH {P_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY p, feature) AS i, count(*) OVER (PARTITION BY stratum) AS m FROM pv)
SELECT stratum, feature, p, max(least(1, (m - i + 1) * p)) OVER (PARTITION BY stratum ORDER BY i) AS p_holm FROM o""", dbl="p p_holm")
def _(spark, sf):
    return M.holm(nation_p(spark, sf), "p", ["feature"], family=["stratum"])


@query("bh_adjust", f"""WITH {P_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY p, stratum, feature) AS i, count(*) OVER () AS m,
   row_number() OVER (PARTITION BY feature ORDER BY p, stratum) AS j, count(*) OVER (PARTITION BY feature) AS mf FROM pv)
SELECT stratum, feature, p, min(least(1, p * m / i)) OVER (ORDER BY i DESC) AS p_bh,
 min(least(1, p * mf / j)) OVER (PARTITION BY feature ORDER BY j DESC) AS p_bh_feature FROM o""", dbl="p p_bh p_bh_feature")
def _(spark, sf):
    out = M.bh(nation_p(spark, sf), "p", ["stratum", "feature"])
    return M.bh(out, "p", ["stratum"], family=["feature"], out="p_bh_feature")


def group_center(df, group, columns, pull=None):
    """Subtract the group mean; with ``pull`` move every coordinate that share of the way to its mean."""
    means = stage(df.groupBy(group).agg(*[F.avg(c).alias("_m_" + c) for c in columns]))
    j = df.join(means, group)
    for c in columns:
        m = F.col("_m_" + c)
        j = j.withColumn(c, F.col(c) - m if pull is None else m + pull * (F.col(c) - m)).drop("_m_" + c)
    return j


@query("group_center", f"""WITH {SQL_OBS} SELECT obs_id, class, sum_qty - avg(sum_qty) OVER (PARTITION BY class) AS sum_qty,
 avg_tax - avg(avg_tax) OVER (PARTITION BY class) AS avg_tax, avg(max_ship_gap) OVER (PARTITION BY class) + 0.85 * (max_ship_gap - avg(max_ship_gap) OVER (PARTITION BY class)) AS max_ship_gap FROM obs""",
       dbl="sum_qty avg_tax max_ship_gap")
def _(spark, sf):
    df = obs(spark, sf, staged=True).select("obs_id", "class", "sum_qty", "avg_tax", "max_ship_gap")
    return group_center(group_center(df, "class", ["sum_qty", "avg_tax"]), "class", ["max_ship_gap"], pull=0.85)


@query("topk_per_group", f"""WITH {SQL_OBS}, d AS (SELECT obs_id, class, abs(o_totalprice - avg(o_totalprice) OVER (PARTITION BY class)) AS dist FROM obs),
 r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY dist, obs_id) AS rn FROM d) SELECT * FROM r WHERE rn <= 6""", dbl="dist", big="rn")
def _(spark, sf):
    df = group_center(obs(spark, sf, staged=True).select("obs_id", "class", "o_totalprice"), "class", ["o_totalprice"])
    return J.topk(df.select("obs_id", "class", F.abs("o_totalprice").alias("dist")), ["class"], ["dist", "obs_id"], 6)


@query("consensus_rank", """WITH s AS (SELECT p_partkey, p_retailprice AS a, CAST(p_size AS DOUBLE) AS b, coalesce(q, 0) AS c FROM part
  LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
 r AS (SELECT p_partkey, (rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE + rank() OVER (ORDER BY b DESC)
   + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE + rank() OVER (ORDER BY c DESC) + (count(*) OVER (PARTITION BY c) - 1) / 2.0::DOUBLE) / 3 AS mean_rank FROM s)
SELECT p_partkey, mean_rank, row_number() OVER (ORDER BY round(mean_rank, 6), p_partkey) AS position FROM r""", dbl="mean_rank")
def _(spark, sf):
    q = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
    s = table(spark, sf, "part").join(q, "p_partkey", "left").select(
        "p_partkey", F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"), F.coalesce("q", F.lit(0.0)).alias("c"))
    r = A.consensus_rank(s, ["a", "b", "c"], "p_partkey").withColumn("order_by", F.round("mean_rank", 6))
    pos = ordered_positions(r.withColumn("one", F.lit(1)), ["one"], "order_by", "p_partkey").select("p_partkey", F.col("global_rank").alias("position"))
    return r.join(pos, "p_partkey").select("p_partkey", "mean_rank", "position")


@query("segment_lag", f"""WITH {SQL_POINTS} SELECT neuron_id, event_id, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM points
 WINDOW w AS (PARTITION BY neuron_id ORDER BY seq_ts, event_id)""", dbl="dx dy")
def _(spark, sf):
    from ..operators.geometry import previous
    p = previous(points(spark, sf), ["neuron_id"], ["seq_ts", "event_id"], ["x", "y"])
    return p.select("neuron_id", "event_id", (F.col("x") - F.col("prev_x")).alias("dx"), (F.col("y") - F.col("prev_y")).alias("dy"))


@query("rank_sum_select", """WITH m AS (SELECT p_brand, avg(p_retailprice) AS a, avg(p_size) AS b FROM part GROUP BY 1),
 r AS (SELECT *, rank() OVER (ORDER BY a) + rank() OVER (ORDER BY b) AS score FROM m)
SELECT p_brand, a, b, score, row_number() OVER (ORDER BY score DESC, p_brand) = 1 AS chosen FROM r""", dbl="a b", big="score")
def _(spark, sf):
    m = table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b"))
    low = F.col("rank") - (F.col("c") - 1) / 2  # the lowest place among ties
    m = stage(m)
    ra, rb = (order.rank_cells(m, [], x, ["p_brand"]).select("p_brand", x, low.cast("long").alias("r" + x)) for x in "ab")
    r = ra.join(rb, "p_brand").withColumn("score", F.col("ra") + F.col("rb")).drop("ra", "rb")
    best = r.agg(F.min_by("p_brand", F.struct(-F.col("score"), F.col("p_brand"))).alias("_best"))
    return r.join(F.broadcast(best), F.lit(True)).withColumn("chosen", F.col("p_brand") == F.col("_best")).drop("_best")


# ---- sort, top-k, sets ---------------------------------------------------------------------

@query("multi_key_sort", """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey""", dbl="o_totalprice", d=2)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(
        F.desc("o_orderpriority"), "o_totalprice", "o_orderkey")


@query("topn_variance", f"""WITH {SQL_COUNTS}, t AS (SELECT count(DISTINCT obs_id) AS n FROM counts),
 v AS (SELECT gene, split_part(gene, '_', 1) AS symbol, (sum(value * value) - sum(value) * sum(value) / n) / (n - 1) AS variance FROM counts, t GROUP BY gene, n),
 s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY variance DESC, gene) AS rn FROM v)
SELECT symbol, gene, variance FROM s WHERE rn = 1 ORDER BY variance DESC, symbol LIMIT 12""", dbl="variance")
def _(spark, sf):
    from .s04_aggregations import detection
    n = table(spark, sf, "lineitem").agg(F.countDistinct("l_orderkey").alias("n_total"))
    return top_variance(detection(counts(spark, sf), n).withColumn("symbol", F.split("gene", "_")[0]), 12)


def top_variance(genes, n, symbol="symbol"):
    """Most variable gene of each symbol, then the n most variable symbols (top-n, no full sort)."""
    best = genes.groupBy(symbol).agg(F.min_by(F.struct("gene", "variance"), F.struct(-F.col("variance"), F.col("gene"))).alias("b"))
    return best.select(symbol, "b.gene", "b.variance").orderBy(F.desc("variance"), symbol).limit(n)


@query("dedupe_keep_first", """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE rn = 1""", dbl="o_totalprice", d=2)
def _(spark, sf):
    return J.topk(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"],
                  [F.desc("o_totalprice"), "o_orderkey"], 1).drop("rn")


@query("union_cohorts", """SELECT 'customer' AS cohort, c_custkey AS id, c_acctbal AS bal, c_mktsegment AS seg FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""", dbl="bal", d=2)
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("customer").alias("cohort"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    b = table(spark, sf, "supplier").select(F.lit("supplier").alias("cohort"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set_diff_intersect", """WITH a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_discount > 0.09), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_tax > 0.07)
SELECT 'a_not_b' AS part, id FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT 'both', id FROM (SELECT id FROM a INTERSECT SELECT id FROM b)
UNION ALL SELECT 'either', id FROM (SELECT id FROM a UNION SELECT id FROM b)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    a, b = li.where("l_discount > 0.09").select(F.col("l_partkey").alias("id")), li.where("l_tax > 0.07").select(F.col("l_partkey").alias("id"))
    tag = lambda d, t: d.select(F.lit(t).alias("part"), "id")
    return tag(a.subtract(b), "a_not_b").union(tag(a.intersect(b), "both")).union(tag(a.union(b).distinct(), "either"))


@query("deterministic_shuffle", """SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority
 ORDER BY md5(concat_ws('|', 7, o_orderkey)), o_orderkey) AS pos FROM orders""")
def _(spark, sf):
    return order.hash_rank(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"],
                           draw(7, F.col("o_orderkey")), "o_orderkey").drop("n")

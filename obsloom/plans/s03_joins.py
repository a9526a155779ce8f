"""Joins and record matching."""
from pyspark.sql import functions as F

from ..operators import joins as J, neighbours as N
from .bindings import (FEATURES, PRIORITIES, SQL_OBS, SQL_OBS_MISSING, STATUSES, obs, obs_missing, table, vectors)
from .registry import query


@query("join_validated", f"""WITH {SQL_OBS} SELECT obs_id, class, sum_qty, c.c_mktsegment FROM obs
 JOIN orders ON o_orderkey = obs_id JOIN customer c ON c_custkey = o_custkey""", dbl="sum_qty", d=2)
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("obs_id"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    meta = o.join(c, "o_custkey").select("obs_id", "c_mktsegment")
    return J.join_validated(obs(spark, sf).select("obs_id", "class", "sum_qty"), meta, "obs_id")


@query("left_join_annotate", """SELECT c_custkey, coalesce(n, 0) AS n, coalesce(last_status, 'none') AS last_status FROM customer
 LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS last_status FROM orders
   WHERE o_totalprice > 350000 GROUP BY 1) ON o_custkey = c_custkey""")
def _(spark, sf):
    o = (table(spark, sf, "orders").where("o_totalprice > 350000").groupBy(F.col("o_custkey").alias("c_custkey"))
         .agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("last_status")))
    return J.left_annotate(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", {"n": 0, "last_status": "none"})


def _ab(spark, sf):
    li = table(spark, sf, "lineitem")
    return (li.where("l_discount > 0.07").select(F.col("l_partkey").alias("id")),
            li.where("l_tax > 0.06").select(F.col("l_partkey").alias("id")))


AB = """a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_discount > 0.07),
 b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_tax > 0.06)"""


@query("outer_indicator", f"""WITH {AB} SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'left_only'
 WHEN a.id IS NULL THEN 'right_only' ELSE 'both' END AS side FROM a FULL OUTER JOIN b ON a.id = b.id""")
def _(spark, sf):
    return J.outer_indicator(*_ab(spark, sf), "id")


@query("table_crosscheck", f"""WITH {SQL_OBS_MISSING}, a AS (SELECT obs_id, feature, va FROM obs_m
  UNPIVOT INCLUDE NULLS (va FOR feature IN ({', '.join(FEATURES)}))),
 b AS (SELECT obs_id, feature, vb FROM (SELECT * REPLACE (CASE WHEN obs_id % 10 = 0 THEN sum_qty + 1 ELSE sum_qty END AS sum_qty)
   FROM obs) UNPIVOT INCLUDE NULLS (vb FOR feature IN ({', '.join(FEATURES)})))
SELECT feature, count(*) AS n_rows, count(*) FILTER ((va IS NULL) <> (vb IS NULL)) AS n_null_mismatch,
 count(*) FILTER (abs(va - vb) > 1e-12 + 1e-12 * abs(vb)) AS n_value_mismatch, max(abs(va - vb)) AS max_abs_diff
FROM a JOIN b USING (obs_id, feature) GROUP BY feature""", dbl="max_abs_diff")
def _(spark, sf):
    b = obs(spark, sf).withColumn("sum_qty", F.when(F.col("obs_id") % 10 == 0, F.col("sum_qty") + 1).otherwise(F.col("sum_qty")))
    return J.table_crosscheck(obs_missing(spark, sf), b, "obs_id", FEATURES)


@query("semi_anti_sets", f"""WITH {AB}, m AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b,
 (SELECT count(*) FROM a SEMI JOIN b USING (id)) AS n_both)
SELECT *, CASE WHEN n_a = n_b AND n_a = n_both THEN 'equal' WHEN n_both = n_a THEN 'proper_subset' WHEN n_both = n_b
 THEN 'proper_superset' WHEN n_both = 0 THEN 'disjoint' ELSE 'overlap' END AS relation FROM m""")
def _(spark, sf):
    return J.set_relation(*_ab(spark, sf), "id")


@query("source_presence", """WITH s AS (SELECT c_mktsegment, c_custkey, o.f AS fo, p.f AS fp FROM customer
 LEFT JOIN (SELECT o_custkey, max(1 + (CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)) AS f FROM orders
   WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey
 LEFT JOIN (SELECT s_suppkey, max(1) AS f FROM supplier GROUP BY 1) p ON s_suppkey = c_custkey)
SELECT c_mktsegment, source, count(f) AS n_present, CAST(sum(f) AS BIGINT) AS n_filled, count(*) AS n, count(f) / count(*) AS rate
FROM (SELECT c_mktsegment, 'orders' AS source, fo AS f FROM s UNION ALL SELECT c_mktsegment, 'supplier', fp FROM s) GROUP BY 1, 2""",
       dbl="rate")
def _(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderpriority", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("p"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_acctbal")
    return J.source_presence(table(spark, sf, "customer"), "c_custkey", "c_mktsegment", {"orders": o, "supplier": s})


@query("hierarchical_match", """WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders),
 c AS (SELECT c_custkey + (i - 1) * 3 AS o_custkey, chr(CAST(70 + 9 * (c_nationkey % 2) + i - 1 AS INTEGER)) AS o_orderstatus,
   CASE WHEN c_nationkey % 3 = 0 THEN '5-LOW' ELSE '1-URGENT' END AS o_orderpriority, c_mktsegment AS seg
   FROM customer, (SELECT unnest([1, 2]) AS i)),
 j AS (SELECT t.*, CASE WHEN c.o_custkey IS NULL THEN 0 WHEN c.o_orderstatus = t.o_orderstatus AND c.o_orderpriority = t.o_orderpriority
   THEN 4 WHEN c.o_orderstatus = t.o_orderstatus THEN 3 WHEN c.o_orderpriority = t.o_orderpriority THEN 2 ELSE 1 END AS tier, seg
   FROM t LEFT JOIN c ON c.o_custkey = t.o_custkey),
 b AS (SELECT o_orderkey, max(tier) AS tier FROM j GROUP BY 1)
SELECT j.o_orderkey, o_custkey, o_orderstatus, o_orderpriority, b.tier, CASE WHEN b.tier = 0 THEN 'unmatched'
 WHEN count(DISTINCT seg) > 1 THEN 'ambiguous' ELSE 'matched' END AS status,
 CASE WHEN b.tier > 0 AND count(DISTINCT seg) = 1 THEN min(seg) END AS seg
FROM j JOIN b ON j.o_orderkey = b.o_orderkey AND j.tier = b.tier GROUP BY 1, 2, 3, 4, 5""", big="tier")
def _(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = (table(spark, sf, "customer").withColumn("i", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        (F.col("c_custkey") + (F.col("i") - 1) * 3).alias("o_custkey"),
        F.char(70 + 9 * (F.col("c_nationkey") % 2) + F.col("i") - 1).alias("o_orderstatus"),
        F.when(F.col("c_nationkey") % 3 == 0, "5-LOW").otherwise("1-URGENT").alias("o_orderpriority"),
        F.col("c_mktsegment").alias("seg")))
    return J.hierarchical_match(t, c, "o_custkey", "o_orderstatus", "o_orderpriority", ["seg"])


@query("scored_best_match", """WITH t AS (SELECT o_orderkey, o_custkey AS k, o_totalprice FROM orders),
 c AS (SELECT o_custkey AS k, 'cand' || CAST(l_linenumber AS VARCHAR) || '_' || CAST(l_orderkey AS VARCHAR) AS name,
   l_extendedprice * 5 AS price, l_quantity AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'),
 j AS (SELECT o_orderkey, name, 4 * abs(price - o_totalprice) / o_totalprice + abs(q - 25) / 25 AS score FROM t LEFT JOIN c USING (k)),
 r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score NULLS LAST, name) AS rn FROM j)
SELECT o_orderkey, name, score, CASE WHEN score IS NULL THEN 'missing' WHEN score <= 0.05 THEN 'exact' WHEN score <= 0.2
 THEN 'close' ELSE 'review' END AS tier FROM r WHERE rn = 1""", dbl="score")
def _(spark, sf):
    o = table(spark, sf, "orders")
    t = o.select("o_orderkey", F.col("o_custkey").alias("k"), "o_totalprice")
    li = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    c = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("k"), F.concat(F.lit("cand"), F.col("l_linenumber").cast("string"), F.lit("_"),
                                                F.col("l_orderkey").cast("string")).alias("name"),
        (F.col("l_extendedprice") * 5).alias("price"), F.col("l_quantity").alias("q"))
    score = 4 * F.abs(F.col("price") - F.col("o_totalprice")) / F.col("o_totalprice") + F.abs(F.col("q") - 25) / 25
    return J.scored_best_match(t, c, "k", score, "name", "o_orderkey", limits=(0.05, 0.2))


@query("grid_left_join", """SELECT class, label, count(o_orderkey) AS n FROM (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM',
 '4-NOT SPECIFIED','5-LOW','9-NONE']) AS class), (SELECT unnest(['F','O','P']) AS label)
 LEFT JOIN orders ON o_orderpriority = class AND o_orderstatus = label GROUP BY 1, 2""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("label"))
    return J.grid_counts(o, **{"class": PRIORITIES + ["9-NONE"], "label": STATUSES})


@query("feature_pairs_join", f"""WITH {SQL_OBS_MISSING} """ + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n_joint FROM obs_m"
    for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]))
def _(spark, sf):
    from ..operators.assoc import pair_moments
    return pair_moments(obs_missing(spark, sf), FEATURES).select("a", "b", F.col("n").alias("n_joint"))


@query("lookup_map", """WITH m(label, merged) AS (VALUES ('1-URGENT','fast'), ('2-HIGH','fast'), ('3-MEDIUM','slow'), ('5-LOW','slow'))
SELECT o_orderkey, o_orderpriority AS label, merged, merged IS NOT NULL AND (merged = 'fast') <> (o_totalprice < 250000) AS mismatch
FROM orders LEFT JOIN m ON label = o_orderpriority""")
def _(spark, sf):
    m = spark.createDataFrame([("1-URGENT", "fast"), ("2-HIGH", "fast"), ("3-MEDIUM", "slow"), ("5-LOW", "slow")], ["label", "merged"])
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"), "o_totalprice")
    out = J.lookup_map(o, m, "label")
    wrong = F.coalesce((F.col("merged") == "fast") != (F.col("o_totalprice") < 250000), F.lit(False))
    return out.select("o_orderkey", "label", "merged", wrong.alias("mismatch"))


KNN_SQL = """pairs AS (SELECT a.vec_id AS obs_id, b.vec_id AS nbr,
   sqrt(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist
   FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
 knn AS (SELECT obs_id, nbr, dist, row_number() OVER (PARTITION BY obs_id ORDER BY dist, nbr) AS rn FROM pairs
   QUALIFY rn <= {k})"""


@query("knn_join", f"""WITH {KNN_SQL.format(k=10)} SELECT obs_id, nbr, rn, dist FROM knn""", dbl="dist", big="rn")
def _(spark, sf):
    return N.knn(vectors(spark, sf), "obs_id", "v", 10)


@query("knn_leaves", """WITH q AS (SELECT vec_id AS obs_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
 pairs AS (SELECT a.obs_id, b.obs_id AS nbr, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist FROM q a JOIN q b ON a.obs_id <> b.obs_id)
SELECT obs_id, nbr, dist, row_number() OVER (PARTITION BY obs_id ORDER BY dist, nbr) AS rn FROM pairs QUALIFY rn <= 10""", dbl="dist", big="rn")
def _(spark, sf):
    """The search over many leaves at every size: three coordinates, 32 vectors a leaf."""
    return N.knn(vectors(spark, sf).withColumn("v", F.slice("v", 1, 3)), "obs_id", "v", 10, leaf_rows=32)

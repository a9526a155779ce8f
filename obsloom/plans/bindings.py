"""Observation tables derived from the given parquet tables, in Spark and in SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import spread, stage

FEATURES = ["n_lines", "sum_qty", "avg_price", "avg_discount", "avg_tax", "max_ship_gap", "o_totalprice"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
RETURNFLAGS = ["A", "N", "R"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def obs(spark: SparkSession, sf: str, stratum: bool = False, staged: bool = False) -> DataFrame:
    """One row per order with its line features; ``stratum`` adds the customer's nation.

    ``staged``: written once to the shared folder, for queries that pass over it several times."""
    lines = (table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").cast("double").alias("n_lines"),
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.avg("l_extendedprice"), 6).alias("avg_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.round(F.avg("l_tax"), 6).alias("avg_tax"),
        F.max("l_shipdate").alias("last_ship")))
    orders = table(spark, sf, "orders")
    out = orders.join(lines, orders.o_orderkey == lines.l_orderkey)
    extra = []
    if stratum:
        cust = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("stratum"))
        out = out.join(cust, out.o_custkey == cust.c_custkey, "left")
        extra = ["stratum"]
    out = out.select(
        F.col("o_orderkey").alias("obs_id"), F.col("o_orderpriority").alias("class"),
        F.col("o_orderstatus").alias("batch"), *extra,
        "n_lines", "sum_qty", "avg_price", "avg_discount", "avg_tax",
        F.datediff("last_ship", "o_orderdate").cast("double").alias("max_ship_gap"), "o_totalprice")
    return stage(out) if staged else out


def obs_missing(spark: SparkSession, sf: str, **kw) -> DataFrame:
    """The same rows with holes: zero rates and single-line averages count as not measured."""
    return (obs(spark, sf, **kw)
            .withColumn("avg_price", F.when(F.col("n_lines") > 1, F.col("avg_price")))
            .withColumn("avg_discount", F.when(F.col("avg_discount") > 0.02, F.col("avg_discount")))
            .withColumn("avg_tax", F.when(F.col("avg_tax") > 0.03, F.col("avg_tax")))
            .withColumn("max_ship_gap", F.when(F.col("max_ship_gap") >= 0, F.col("max_ship_gap"))))


def long_of(df: DataFrame, ids, features) -> DataFrame:
    return df.unpivot(list(ids), list(features), "feature", "value")


def long(spark, sf, features=FEATURES, **kw) -> DataFrame:
    ids = ["obs_id", "class", "batch"] + (["stratum"] if kw.get("stratum") else [])
    return long_of(obs(spark, sf, **kw), ids, features)


def parts_long(spark, sf) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("obs_id"), F.col("p_brand").alias("class"),
                                        F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return long_of(p, ["obs_id", "class"], ["p_size", "p_retailprice"])


def counts(spark, sf) -> DataFrame:
    """Sparse counts: order = observation, brand x type = gene, summed quantity = count."""
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws("_", "p_brand", "p_type").alias("gene"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("obs_id"), "l_partkey", "l_quantity")
    rows = li.join(p, li.l_partkey == p.p_partkey).select("obs_id", "gene", "l_quantity")
    # few lines of an order share a gene, so a sum before the shuffle would hold nearly every row
    return spread(rows, li.count(), "obs_id").groupBy("obs_id", "gene").agg(F.sum("l_quantity").alias("value"))


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("obs_id"), F.col("label").alias("class"),
        F.col("embedding").cast("array<double>").alias("v"))


def points(spark, sf) -> DataFrame:
    """Event trail of each user as a point sequence (x minutes, y value, z and r from the payload)."""
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.select(
        F.col("user_id").alias("neuron_id"), F.col("event_type").alias("section"), "event_id",
        F.col("ts").alias("seq_ts"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(60000000.0)).alias("x"),
        F.col("value").alias("y"), k.alias("z"), (1 + k / 100).alias("r"))


# ---- the same tables as common table expressions -------------------------------------------

SQL_OBS = """obs AS (
 SELECT o_orderkey AS obs_id, o_orderpriority AS class, o_orderstatus AS batch, c_nationkey AS stratum,
   CAST(n_lines AS DOUBLE) AS n_lines, sum_qty, avg_price, avg_discount, avg_tax,
   CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(last_ship AS DATE)) AS DOUBLE) AS max_ship_gap, o_totalprice
 FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty,
     round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_discount,
     round(avg(l_tax), 6) AS avg_tax, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) li
   ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey)"""
SQL_OBS_MISSING = SQL_OBS + """, obs_m AS (
 SELECT * REPLACE (CASE WHEN n_lines > 1 THEN avg_price END AS avg_price,
   CASE WHEN avg_discount > 0.02 THEN avg_discount END AS avg_discount,
   CASE WHEN avg_tax > 0.03 THEN avg_tax END AS avg_tax,
   CASE WHEN max_ship_gap >= 0 THEN max_ship_gap END AS max_ship_gap) FROM obs)"""
_FLIST = ", ".join(FEATURES)
SQL_LONG = SQL_OBS + f""", long AS (
 SELECT obs_id, class, batch, stratum, feature, value
 FROM obs UNPIVOT INCLUDE NULLS (value FOR feature IN ({_FLIST})))"""
SQL_LONG_MISSING = SQL_OBS_MISSING + f""", long AS (
 SELECT obs_id, class, batch, stratum, feature, value
 FROM obs_m UNPIVOT INCLUDE NULLS (value FOR feature IN ({_FLIST})))"""
SQL_PARTS_LONG = """long AS (
 SELECT obs_id, class, feature, value FROM (SELECT p_partkey AS obs_id, p_brand AS class,
   CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT (value FOR feature IN (p_size, p_retailprice)))"""
SQL_COUNTS = """counts AS (
 SELECT l_orderkey AS obs_id, p_brand || '_' || p_type AS gene, sum(l_quantity) AS value
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
SQL_VECTORS = """vectors AS (
 SELECT vec_id AS obs_id, label AS class, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
SQL_POINTS = """points AS (
 SELECT user_id AS neuron_id, event_type AS section, event_id, ts AS seq_ts,
   CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 60000000.0::DOUBLE AS x, value AS y,
   CAST(json_extract_string(props, '$.k') AS DOUBLE) AS z,
   1 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS r FROM events)"""
SQL_RANKED = """ranked AS (SELECT *, (rank() OVER (PARTITION BY feature ORDER BY value)
   + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE) AS rk,
   count(*) OVER (PARTITION BY feature, value) AS ties FROM long WHERE value IS NOT NULL)"""

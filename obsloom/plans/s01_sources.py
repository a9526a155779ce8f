"""Sources and sinks. Files are written from the given tables, then scanned back."""
import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..runtime import fresh_path, spread
from ..sources import files as S
from .bindings import SQL_COUNTS, counts, table
from .registry import query

CUST = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("scan_csv", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer", dbl="c_acctbal", d=2)
def _(spark, sf):
    path = fresh_path(spark, "csv")
    S.sink_csv(table(spark, sf, "customer"), path, bom=True)
    return S.scan_csv(spark, path, CUST, ["c_custkey", "c_acctbal", "c_mktsegment"])


RAW_SQL = """SELECT c_name, CASE c_custkey % 5 WHEN 0 THEN 'NR' WHEN 1 THEN 'nan' WHEN 2 THEN '' ELSE c_mktsegment END AS tok
 FROM customer"""


@query("scan_tsv_verbatim", RAW_SQL)
def _(spark, sf):
    path = fresh_path(spark, "tsv")
    m = F.col("c_custkey") % 5
    df = table(spark, sf, "customer").select("c_name", F.when(m == 0, "NR").when(m == 1, "nan").when(m == 2, "")
                                             .otherwise(F.col("c_mktsegment")).alias("tok"))
    df.write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
    return S.scan_tsv_verbatim(spark, path, ["c_name", "tok"])


@query("scan_json_envelope", """SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS c_acctbal FROM customer""",
       dbl="c_acctbal", d=2)
def _(spark, sf):
    path = fresh_path(spark, "envelope")
    bal = F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal").cast("string"))
    env = (table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 200).alias("chunk"))
           .agg(F.collect_list(F.array(F.col("c_custkey").cast("string"), "c_name", bal)).alias("analysis_rows")))
    head = F.array(F.lit("c_custkey"), F.lit("c_name"), F.lit("c_acctbal")).alias("analysis_headers")
    env.select(F.to_json(F.struct(head, "analysis_rows"))).write.text(path)
    return S.scan_json_envelope(spark, path, {"c_custkey": "bigint", "c_acctbal": "double"}, multiline=False)


@query("scan_json_records", "SELECT p_partkey, p_brand, p_retailprice FROM part", dbl="p_retailprice", d=2)
def _(spark, sf):
    path = fresh_path(spark, "records")
    rec = F.struct("p_partkey", "p_brand", "p_retailprice")
    chunks = (table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 200).alias("chunk"))
              .agg(F.to_json(F.collect_list(rec)).alias("value")))
    chunks.select("value").write.text(path)
    return S.scan_json_records(spark, path, "p_partkey bigint, p_brand string, p_retailprice double",
                               required=["p_partkey"], multiline=False)


@query("scan_sparse_counts", f"""WITH {SQL_COUNTS}, ids AS (
  SELECT o_orderkey AS obs_id FROM orders WHERE o_orderstatus = 'F')
SELECT 'found' AS part, obs_id, gene, value FROM counts SEMI JOIN ids USING (obs_id)
UNION ALL SELECT 'missing', obs_id, NULL, NULL FROM ids ANTI JOIN counts USING (obs_id)""", dbl="value", d=2)
def _(spark, sf):
    c = counts(spark, sf)
    orders = table(spark, sf, "orders")
    # merged with the triplets where they are: Spark would broadcast the ids, whose table in memory grows with the orders
    ids = spread(orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("obs_id")), orders.count(), "obs_id").hint("merge")
    found = S.select_counts(c, ids).select(F.lit("found").alias("part"), "obs_id", "gene", "value")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("obs_id"))
    lost = S.missing_ids(spread(lines, lines.count(), "obs_id").hint("merge"), ids)
    return found.unionByName(lost.withColumn("part", F.lit("missing")), allowMissingColumns=True)


@query("scan_zip_members", "SELECT s_suppkey, s_acctbal FROM supplier", dbl="s_acctbal", d=2)
def _(spark, sf):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("readme.txt", "not a table")
            z.writestr("inner/supplier.csv", "\ufeff" + pdf[["s_suppkey", "s_name", "s_acctbal"]].to_csv(index=False))
        return pd.DataFrame({"path": [f"part-{pdf['chunk'].iloc[0]}.zip"], "content": [buf.getvalue()]})

    archives = (table(spark, sf, "supplier").withColumn("chunk", F.floor(F.col("s_suppkey") / 50))
                .groupBy("chunk").applyInPandas(pack, "path string, content binary"))
    return S.zip_members(archives, "s_suppkey bigint, s_acctbal double").select("s_suppkey", "s_acctbal")


def _segment_files(spark, sf):
    path = fresh_path(spark, "inventory")
    table(spark, sf, "customer").select("c_mktsegment", "c_custkey").repartition(8, "c_mktsegment") \
        .write.partitionBy("c_mktsegment").option("header", True).csv(path)
    return path


@query("file_inventory")
def _(spark, sf):
    inv = S.file_inventory(spark, _segment_files(spark, sf), r"c_mktsegment=([A-Z]+)/", "*.csv")
    return inv.groupBy("key").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"),
                                  F.max(F.length("sha256")).alias("digest_len"))


@query("sink_tables", """SELECT p_partkey, p_type, p_retailprice, p_retailprice AS from_json FROM part""",
       dbl="p_retailprice from_json", d=2)
def _(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_type", "p_retailprice")
    csv, js = fresh_path(spark, "sink-csv"), fresh_path(spark, "sink-json")
    S.sink_csv(parts, csv, float_format="%.4f", bom=True)
    S.sink_json(parts, js)
    a = S.scan_csv(spark, csv, "p_partkey bigint, p_type string, p_retailprice double")
    b = S.scan_json_records(spark, js, "p_partkey bigint, p_retailprice double", multiline=False)
    return a.join(b.withColumnRenamed("p_retailprice", "from_json"), "p_partkey")


@query("id_list_scan", """SELECT DISTINCT trim(p_name) AS id FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0""")
def _(spark, sf):
    path = fresh_path(spark, "ids")
    k = F.col("p_partkey")
    line = F.when(k % 5 == 0, F.concat(F.lit("# "), "p_name")).when(k % 7 == 0, "").otherwise(F.col("p_name"))
    table(spark, sf, "part").select(line.alias("value")).write.text(path)
    return S.id_list_scan(spark, path)

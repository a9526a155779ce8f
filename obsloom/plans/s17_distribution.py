"""Distribution tables and audits."""
from pyspark.sql import functions as F

from ..operators import audit as U, distribution as D, order, transforms as T
from ..sources import files as S
from .bindings import SQL_LONG, SQL_OBS, SQL_OBS_MISSING, long, obs, obs_missing, table
from .registry import query

PROBS = {"q000": 0.0, "q010": .01, "q025": .025, "q050": .05, "q250": .25, "q500": .5, "q750": .75, "q950": .95, "q975": .975, "q990": .99, "q1000": 1.0}
ZL = "zl AS (SELECT obs_id, class, feature, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM long WINDOW w AS (PARTITION BY feature))"


@query("pooled_quantiles", f"""WITH {SQL_LONG}, {ZL} SELECT {', '.join(f'quantile_cont(z, {p}) AS {n}' for n, p in PROBS.items())}, count(z) AS n, count(*) FILTER (abs(z) > 2) AS beyond_2,
 count(*) FILTER (abs(z) > 2.5) AS beyond_2_5, count(*) FILTER (abs(z) > 3) AS beyond_3 FROM zl""", dbl=" ".join(PROBS))
def _(spark, sf):
    return D.pooled_quantiles(T.zscore(long(spark, sf, staged=True), 1, out="z").select(F.col("z").alias("value")), PROBS)


@query("trimmed_core", f"""WITH {SQL_OBS}, m AS (SELECT class, median(sum_qty) AS m1, mad(sum_qty) AS d1, median(o_totalprice) AS m2, mad(o_totalprice) AS d2 FROM obs GROUP BY 1),
 d AS (SELECT obs_id, class, sqrt(pow((sum_qty - m1) / d1, 2) + pow((o_totalprice - m2) / d2, 2)) AS distance FROM obs JOIN m USING (class)), c AS (SELECT class, quantile_cont(distance, .95) AS cut FROM d GROUP BY 1)
SELECT obs_id, class, distance FROM d JOIN c USING (class) WHERE round(distance, 9) <= round(cut, 9)""", dbl="distance")
def _(spark, sf):
    return D.trimmed_core(obs(spark, sf, staged=True).select("obs_id", "class", "sum_qty", "o_totalprice"), "sum_qty", "o_totalprice", "class").select("obs_id", "class", "distance")


@query("fd_histogram", f"""WITH {SQL_LONG}, m AS (SELECT feature, count(value) AS n, min(value) AS lo, max(value) AS hi, 2 * (quantile_cont(value, .75) - quantile_cont(value, .25)) / cbrt(count(value)) AS w FROM long GROUP BY 1),
 b AS (SELECT *, CASE WHEN w > 0 THEN least(greatest(ceil((hi - lo) / w), 8), 28) ELSE 12 END AS n_bins FROM m)
SELECT feature, least(floor((value - lo) * n_bins / (hi - lo)), n_bins - 1) AS bin, n_bins, lo + least(floor((value - lo) * n_bins / (hi - lo)), n_bins - 1) * ((hi - lo) / n_bins) AS "left", count(*) AS n
FROM long JOIN b USING (feature) GROUP BY ALL""", dbl="left:5", big="bin n_bins")
def _(spark, sf):
    return D.fd_histogram(long(spark, sf, staged=True))


@query("integer_histogram", f"""WITH {SQL_OBS} SELECT 'n_lines' AS feature, floor(n_lines + 0.5) AS bin, count(*) AS n FROM obs GROUP BY 2""", big="bin")
def _(spark, sf):
    return D.integer_histogram(long(spark, sf, features=["n_lines"]))


@query("kde_grid", f"""WITH {SQL_LONG}, m AS (SELECT feature, class, count(value) AS n, min(value) AS lo, max(value) AS hi, 1.06 * stddev_samp(value) * pow(count(value), -0.2) AS bw FROM long GROUP BY 1, 2),
 b AS (SELECT feature, class, lo, hi, bw, n, least(floor((value - lo) / ((hi - lo) / 400)), 399) AS cell, count(*) AS c FROM long JOIN m USING (feature, class) GROUP BY ALL),
 d AS (SELECT feature, class, i, lo + (hi - lo) * i / 49 AS x, sum(c * exp(-pow((lo + (hi - lo) * i / 49 - (lo + (cell + 0.5) * ((hi - lo) / 400))) / bw, 2) / 2)) / max(n * bw) AS density FROM b, (SELECT unnest(range(0, 50)) AS i) GROUP BY ALL)
SELECT feature, class, i, x, density / max(density) OVER (PARTITION BY feature, class) AS scaled FROM d""", dbl="x scaled", big="i", d=5)
def _(spark, sf):
    return D.kde_grid(long(spark, sf, staged=True), ["feature", "class"])


@query("heatmap_matrix", f"""WITH {SQL_LONG}, {ZL}, ps AS (SELECT obs_id, row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws('|', 9, obs_id)), obs_id) AS pos FROM obs)
SELECT obs_id, class, feature, pos, least(greatest(z, -2), 2) AS shown FROM zl JOIN ps USING (obs_id)""", dbl="shown")
def _(spark, sf):
    pos = order.shuffled_position(obs(spark, sf, staged=True).select("obs_id", "class"), ["class"], "obs_id", 9).select("obs_id", "pos")
    return D.heatmap(T.zscore(long(spark, sf, staged=True), 1, out="z"), pos).select("obs_id", "class", "feature", "pos", "shown")


# ---- audits -----------------------------------------------------------------------------------------

NUM, TXT = ["sum_qty", "avg_tax", "o_totalprice"], ["class"]
_cmp = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (la AND lb AND ((a_{c} IS NULL) <> (b_{c} IS NULL))) AS n_null_mismatch, count(*) FILTER ({f'abs(a_{c} - b_{c}) > 1e-10' if c in NUM else f'a_{c} <> b_{c}'}) AS n_different,
 {f'max(abs(a_{c} - b_{c}))' if c in NUM else 'CAST(NULL AS DOUBLE)'} AS max_abs_diff FROM j""" for c in NUM + TXT)


@query("table_diff", f"""WITH {SQL_OBS_MISSING}, a AS (SELECT obs_id, true AS la, {', '.join(f'{c} AS a_{c}' for c in NUM + TXT)} FROM obs WHERE obs_id % 50 <> 1),
 b AS (SELECT obs_id, true AS lb, sum_qty + CASE WHEN obs_id % 40 = 3 THEN 0.5::DOUBLE ELSE 0 END AS b_sum_qty, avg_tax AS b_avg_tax, o_totalprice AS b_o_totalprice, CASE WHEN obs_id % 60 = 5 THEN 'x' ELSE class END AS b_class FROM obs_m WHERE obs_id % 50 <> 2),
 j AS (SELECT coalesce(la, false) AS la, coalesce(lb, false) AS lb, * EXCLUDE (la, lb) FROM a FULL OUTER JOIN b USING (obs_id)), s AS (SELECT count(*) FILTER (NOT lb) AS only_a, count(*) FILTER (NOT la) AS only_b FROM j), c AS ({_cmp})
SELECT only_a, only_b, c.*, only_a = 0 AND only_b = 0 AND n_null_mismatch = 0 AND n_different = 0 AS "equal" FROM s, c""", dbl="max_abs_diff")
def _(spark, sf):
    a = obs(spark, sf).where("obs_id % 50 <> 1")
    b = obs_missing(spark, sf).where("obs_id % 50 <> 2").withColumn("sum_qty", F.col("sum_qty") + F.when(F.col("obs_id") % 40 == 3, 0.5).otherwise(0.0))
    b = b.withColumn("class", F.when(F.col("obs_id") % 60 == 5, "x").otherwise(F.col("class")))
    return U.table_diff(a, b, "obs_id", NUM, TXT)


@query("assertion_ledger", """WITH l AS (SELECT 'regions' AS item, CAST(count(*) AS DOUBLE) AS observed, 5.0::DOUBLE AS expected FROM region UNION ALL SELECT 'nations', count(*), 25 FROM nation
 UNION ALL SELECT 'orders without customer', count(*), 0 FROM orders ANTI JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'order lines without order', count(*), 0 FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey
 UNION ALL SELECT 'negative balances', count(*), 0 FROM customer WHERE c_acctbal < 0)
SELECT *, CASE WHEN observed = expected THEN 'PASS' ELSE 'FAIL' END AS status FROM l""", dbl="observed expected", d=2)
def _(spark, sf):
    t = lambda n: table(spark, sf, n)
    n = F.count("*").alias("observed")
    return U.ledger([
        ("regions", t("region").agg(n), 5), ("nations", t("nation").agg(n), 25),
        ("orders without customer", t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(n), 0),
        ("order lines without order", t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(n), 0),
        ("negative balances", t("customer").where("c_acctbal < 0").agg(n), 0)])


@query("unique_key_check", """WITH k AS (SELECT CASE WHEN l_orderkey % 97 = 0 THEN '  ' ELSE CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END AS key FROM lineitem),
 g AS (SELECT CASE WHEN trim(key) <> '' THEN key END AS k, count(*) AS n FROM k GROUP BY 1)
SELECT sum(n) AS n_rows, count(k) AS n_keys, coalesce(sum(n) FILTER (k IS NULL), 0) AS n_blank, count(*) FILTER (k IS NOT NULL AND n > 1) AS n_repeated, coalesce(sum(n) FILTER (k IS NOT NULL AND n > 1), 0) AS n_in_repeats FROM g""",
       big="n_rows n_blank n_in_repeats")
def _(spark, sf):
    key = F.when(F.col("l_orderkey") % 97 == 0, "  ").otherwise(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return U.unique_key_check(table(spark, sf, "lineitem").select(key.alias("key")), "key")


@query("frozen_counts_check", """WITH e(label, expected) AS (VALUES ('F', 5000), ('O', 4987), ('X', 3)), g AS (SELECT o_orderstatus AS label, count(*) AS observed FROM orders GROUP BY 1)
SELECT coalesce(g.label, e.label) AS label, coalesce(observed, 0) AS observed, coalesce(expected, 0) AS expected, coalesce(observed, 0) = coalesce(expected, 0) AS ok FROM g FULL OUTER JOIN e ON g.label = e.label""", big="observed expected")
def _(spark, sf):
    e = spark.createDataFrame([("F", 5000), ("O", 4987), ("X", 3)], "label string, expected long")
    return U.frozen_counts(table(spark, sf, "orders"), "o_orderstatus", e)


# the fixed patterns plus two of the caller's own
SCAN = U.TEXT_PATTERNS | {"assigned_token": r"token\s*=\s*.[0-9a-f]{20,}", "mail_address": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.com"}
_SQLPAT = {n: p.replace("'", "''") for n, p in SCAN.items()}


@query("text_pattern_scan", "WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS t, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), 1) AS line FROM documents) "
       + " UNION ALL ".join(f"SELECT doc_id, line, '{n}' AS pattern FROM l WHERE regexp_matches(t, '{p}')" for n, p in _SQLPAT.items()), big="line")
def _(spark, sf):
    return U.text_scan(table(spark, sf, "documents"), "doc_id", "text", SCAN)


@query("manifest_verify")
def _(spark, sf):
    from .s01_sources import _segment_files
    inv = S.file_inventory(spark, _segment_files(spark, sf), r"c_mktsegment=([A-Z]+)/", "*.csv")
    listed = inv.where("key <> 'FURNITURE'").select("path", "bytes", F.when(F.col("key") == "BUILDING", F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))
    gone = inv.limit(1).select(F.lit("gone.csv").alias("path"), "bytes", "sha256")
    return U.manifest_verify(inv, listed.unionByName(gone)).groupBy("status").agg(F.count("*").alias("n"))

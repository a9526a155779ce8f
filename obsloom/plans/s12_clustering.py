"""Clustering and label agreement."""
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import sq_dist
from ..operators import agreement as G, batched as B, cluster as K, communities as M, joins as J, linalg as L, neighbours as N, order, resample as R, transforms as T
from ..runtime import stage
from .bindings import SQL_OBS, SQL_VECTORS, table, vectors
from .registry import query
from .s03_joins import KNN_SQL
from .s04_aggregations import resample_summary


def pcs(spark, sf, k=5):
    df = vectors(spark, sf)
    return L.fit_pca(df, "v", standardise=False).scores(df, "v", k).select("obs_id", "class", "pc")


def _sizes(df, label="cluster"):
    return df.groupBy(label).agg(F.count("*").alias("n"))


def against_class(df, name):
    cells = G.contingency(df, "cluster", "class")
    return G.agreement(cells).withColumn("method", F.lit(name))


@query("kmeans", dbl="ari nmi_sqrt nmi_mean purity_a purity_b", d=4)
def _(spark, sf):
    return against_class(K.kmeans(pcs(spark, sf), "pc", 10, restarts=3)[0], "kmeans")


@query("gmm", dbl="ari nmi_sqrt nmi_mean purity_a purity_b", d=4)
def _(spark, sf):
    return against_class(K.gmm(pcs(spark, sf, 3), "pc", 5, restarts=2)[0], "gmm")


@query("spectral", dbl="ari nmi_sqrt nmi_mean purity_a purity_b", d=4)
def _(spark, sf):
    x = pcs(spark, sf)
    lab = K.spectral(N.knn(x, "obs_id", "pc", 10), "obs_id", 10)
    return against_class(x.join(lab, "obs_id"), "spectral")


@query("ward_microcluster")
def _(spark, sf):
    return K.ward(pcs(spark, sf), "obs_id", "pc", 10)[0].select("obs_id", "cluster")


@query("tree_topology", dbl="height")
def _(spark, sf):
    _, merges, sizes = K.ward(pcs(spark, sf), "obs_id", "pc", 10)
    t = K.tree_topology(merges, sizes, 10).astype(object)
    rows = [tuple(None if v != v else v for v in r) for r in t.itertuples(index=False, name=None)]
    return spark.createDataFrame([(int(a), None if b is None else int(b), *c) for a, b, *c in rows],
                                 "node long, parent long, depth long, left_classes string, right_classes string, n_left long, n_right long, height double")


@query("leaf_order")
def _(spark, sf):
    x = pcs(spark, sf)
    lab, merges, sizes = K.ward(x, "obs_id", "pc", 10)
    seq = spark.createDataFrame([(int(m), i) for i, m in enumerate(K.leaf_sequence(merges, len(sizes)))], "micro long, leaf long")
    center = x.join(lab, "obs_id").groupBy("micro").agg(F.array(*[F.avg(F.col("pc")[j]) for j in range(5)]).alias("c"))
    rows = x.join(lab, "obs_id").join(seq, "micro").join(center, "micro").withColumn("d", sq_dist(F.col("pc"), F.col("c")))
    # order inside a leaf by distance, then id: (leaf, distance) counts first, so no leaf is sorted as one block
    start = order.cumulative_counts(rows.groupBy("leaf").agg(F.count("*").alias("c")).withColumn("g", F.lit(1)), ["g"], "leaf")
    start = start.select("leaf", (F.col("cum") - F.col("c")).alias("before"))
    at = order.cumulative_counts(order.value_counts(rows, ["leaf"], "d"), ["leaf"], "d").select("leaf", "d", (F.col("cum") - F.col("c")).alias("b2"))
    tie = order.cumulative_counts(rows.select("leaf", "d", "obs_id", "cluster").withColumn("c", F.lit(1).cast("long")), ["leaf", "d"], "obs_id")
    return tie.join(at, ["leaf", "d"]).join(start, "leaf").select("obs_id", "cluster", (F.col("before") + F.col("b2") + F.col("cum")).alias("position"))


SNN_SQL = """sl AS (SELECT obs_id, list_append(list(nbr), obs_id) AS l FROM knn GROUP BY 1),
 sm AS (SELECT DISTINCT obs_id, unnest(l) AS m FROM sl), se AS (SELECT a.obs_id AS src, b.obs_id AS dst, count(*) AS shared FROM sm a JOIN sm b ON a.m = b.m AND a.obs_id < b.obs_id GROUP BY 1, 2),
 snn AS (SELECT src, dst, shared / (len(a.l) + len(b.l) - shared) AS w FROM se JOIN sl a ON a.obs_id = src JOIN sl b ON b.obs_id = dst)"""


@query("snn_graph", f"WITH {KNN_SQL.format(k=20)}, {SNN_SQL} SELECT src, dst, w FROM snn WHERE w >= 1.0 / 15", dbl="w")
def _(spark, sf):
    return N.snn_edges(N.knn(vectors(spark, sf), "obs_id", "v", 20), "obs_id", 20)


@query("modularity_communities", dbl="q", d=4)
def _(spark, sf):
    e = N.snn_edges(N.knn(pcs(spark, sf), "obs_id", "pc", 20), "obs_id", 20)
    e = stage(e)
    lab = M.communities(e, 1.0)
    sym = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    q = K.modularity(sym, lab.withColumnRenamed("community", "c"))
    return lab.groupBy("community").agg(F.count("*").alias("n")).withColumn("q", F.lit(q))


# given labelings: sign pattern of the first dimensions against the label, per configuration
SIGN_SQL = f"""{SQL_VECTORS}, runs AS (SELECT d AS n_dim, obs_id, class, list_sum(list_transform(range(1, d + 1), lambda i: CASE WHEN v[i] > 0 THEN CAST(pow(2, i - 1) AS BIGINT) ELSE 0 END)) AS cl
 FROM vectors, (SELECT unnest([2, 3, 4]) AS d))"""


def sign_runs(spark, sf):
    v = vectors(spark, sf).withColumn("n_dim", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))))
    bits = F.transform(F.slice("v", 1, F.col("n_dim")), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    return v.select("n_dim", "obs_id", "class", F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a + x).alias("cl"))


def metrics_sql(src, a, b, keys=""):
    """Agreement metrics of two label columns per key, as common table expressions ending in ``mt``."""
    k = keys + ", " if keys else ""
    on = f"USING ({keys})" if keys else "ON true"
    g = f"GROUP BY {keys}" if keys else ""
    return f"""nab AS (SELECT {k}{a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS o FROM {src} GROUP BY ALL),
 na AS (SELECT {k}a, sum(o) AS m, max(o) AS top FROM nab GROUP BY ALL), nb AS (SELECT {k}b, sum(o) AS m, max(o) AS top FROM nab GROUP BY ALL),
 nt AS (SELECT {k}sum(o) AS n, sum(o * (o - 1) / 2) AS sab, -sum(o * ln(o)) AS hab FROM nab {g}),
 sa AS (SELECT {k}sum(m * (m - 1) / 2) AS s, -sum(m * ln(m)) AS h, sum(top) AS top FROM na {g}), sb AS (SELECT {k}sum(m * (m - 1) / 2) AS s, -sum(m * ln(m)) AS h, sum(top) AS top FROM nb {g}),
 j AS (SELECT {k}n, sab, sa.s AS s_a, sb.s AS s_b, sa.h / n + ln(n) AS ha, sb.h / n + ln(n) AS hb, hab / n + ln(n) AS hab, sa.top / n AS purity_a, sb.top / n AS purity_b FROM nt JOIN sa {on} JOIN sb {on}),
 mt AS (SELECT {k}CAST(n AS BIGINT) AS n, (sab - s_a * s_b / (n * (n - 1) / 2)) / ((s_a + s_b) / 2 - s_a * s_b / (n * (n - 1) / 2)) AS ari,
   (ha + hb - hab) / sqrt(ha * hb) AS nmi_sqrt, 2 * (ha + hb - hab) / (ha + hb) AS nmi_mean, purity_a, purity_b FROM j)"""


@query("cluster_grid_scan", f"""WITH {SIGN_SQL}, {metrics_sql('runs', 'cl', 'class', 'n_dim')}, sz AS (SELECT n_dim, min(c) AS min_size, max(c) AS max_size, count(*) AS k FROM (SELECT n_dim, cl, count(*) AS c FROM runs GROUP BY 1, 2) GROUP BY 1)
SELECT n_dim, ari, nmi_sqrt, purity_a, min_size, max_size, k, row_number() OVER (ORDER BY round(ari, 9) DESC, n_dim) = 1 AS best FROM mt JOIN sz USING (n_dim)""",
       dbl="ari nmi_sqrt purity_a", big="n_dim")
def _(spark, sf):
    from ..operators.aggs import window_rank
    r = sign_runs(spark, sf)
    m = G.agreement(G.contingency(r, "cl", "class", ["n_dim"]), ["n_dim"]).select("n_dim", "ari", "nmi_sqrt", "purity_a")
    s = r.groupBy("n_dim", "cl").agg(F.count("*").alias("c")).groupBy("n_dim").agg(F.min("c").alias("min_size"), F.max("c").alias("max_size"), F.count("*").alias("k"))
    out = window_rank(m.join(s, "n_dim"), [F.round("ari", 9).desc(), "n_dim"])
    return out.withColumn("best", F.col("position") == 1).drop("position")


@query("relabel_ordered", """WITH m AS (SELECT o_orderpriority, row_number() OVER (ORDER BY quantile_cont(o_totalprice, .5), o_orderpriority) AS ordered FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderpriority, ordered FROM orders JOIN m USING (o_orderpriority)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    med = order.quantiles(o, ["o_orderpriority"], "o_totalprice", {"med": .5})
    return G.relabel_by(o, "o_orderpriority", med, "med").select("o_orderkey", "o_orderpriority", "ordered")


LAB_SQL = """lab AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority AS a, 'P' || CAST(least(floor(o_totalprice / 100000), 4) AS BIGINT) AS b, o_orderstatus AS c FROM orders)"""


def labelings(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderpriority").alias("a"),
        F.concat(F.lit("P"), F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(4)).cast("string")).alias("b"), F.col("o_orderstatus").alias("c"))


MERGE_SQL = f"""{LAB_SQL}, ct AS (SELECT a, b, count(*) AS n FROM lab GROUP BY 1, 2), mg AS (SELECT a, b AS merged FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn FROM ct) WHERE rn = 1)"""


@query("overlap_merge", f"""WITH {MERGE_SQL} SELECT merged, b, count(*) AS n FROM lab JOIN mg USING (a) GROUP BY 1, 2""")
def _(spark, sf):
    lab = labelings(spark, sf)
    m = G.overlap_map(G.contingency(lab, "a", "b"))
    return lab.join(m, "a").groupBy("merged", "b").agg(F.count("*").alias("n"))


@query("consensus_label", f"""WITH {MERGE_SQL}, j AS (SELECT id, merged, b FROM lab JOIN mg USING (a))
SELECT id, CASE WHEN merged = b THEN b END AS consensus, merged <> b AS discordant, (SELECT count(*) FILTER (merged = b) * 100.0 / count(*) FROM j) AS agreement_percent FROM j""", dbl="agreement_percent")
def _(spark, sf):
    lab = labelings(spark, sf)
    j = lab.join(G.overlap_map(G.contingency(lab, "a", "b")), "a").select("id", "merged", "b")
    tot = j.agg((F.count_if(F.col("merged") == F.col("b")) * 100.0 / F.count("*")).alias("agreement_percent")).withColumn("one", F.lit(1))
    out = j.select("id", F.when(F.col("merged") == F.col("b"), F.col("b")).alias("consensus"), (F.col("merged") != F.col("b")).alias("discordant"))
    return out.withColumn("one", F.lit(1)).join(F.broadcast(tot), "one").drop("one")  # one row


T3_SQL = """t3 AS (SELECT o_orderstatus AS a, CASE WHEN o_totalprice < 150000 THEN 'x' WHEN o_totalprice < 330000 THEN 'y' ELSE 'z' END AS b, o_orderkey FROM orders),
 c3 AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS o, sum(count(*)) OVER (PARTITION BY a) AS na, sum(count(*)) OVER (PARTITION BY b) AS nb, sum(count(*)) OVER () AS n FROM t3 GROUP BY 1, 2),
 perm AS (SELECT f.b AS bf, o.b AS bo, p.b AS bp, f.o + o.o + p.o AS total, f.o / (f.na + f.nb - f.o) + o.o / (o.na + o.nb - o.o) + p.o / (p.na + p.nb - p.o) AS total_jaccard FROM c3 f JOIN c3 o ON f.a = 'F' AND o.a = 'O' AND o.b <> f.b JOIN c3 p ON p.a = 'P' AND p.b NOT IN (f.b, o.b)),
 bestp AS (SELECT * FROM perm ORDER BY total DESC LIMIT 1),
 mt3 AS (SELECT c3.* FROM c3, bestp WHERE (a = 'F' AND b = bf) OR (a = 'O' AND b = bo) OR (a = 'P' AND b = bp))"""
J3_SQL = T3_SQL.replace("ORDER BY total DESC", "ORDER BY total_jaccard DESC")


def status_price(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("a"), F.when(F.col("o_totalprice") < 150000, "x").when(F.col("o_totalprice") < 330000, "y").otherwise("z").alias("b"))


@query("optimal_matching", f"WITH {T3_SQL} SELECT a, b, o AS n_match, sum(o) OVER () / n AS mapped_accuracy FROM mt3", dbl="n_match mapped_accuracy")
def _(spark, sf):
    m = G.optimal_matching(G.contingency(status_price(spark, sf), "a", "b")).withColumn("one", F.lit(1))
    acc = m.groupBy("one").agg(F.sum("share").alias("mapped_accuracy"))
    return m.join(acc, "one").select("a", "b", "n_match", "mapped_accuracy")


@query("cluster_jaccard", f"WITH {J3_SQL} SELECT min(o / (na + nb - o)) AS min_jaccard, avg(o / (na + nb - o)) AS mean_jaccard FROM mt3", dbl="min_jaccard mean_jaccard")
def _(spark, sf):
    m = G.optimal_matching(G.contingency(status_price(spark, sf), "a", "b"), by="jaccard")
    return m.agg(F.min("jaccard").alias("min_jaccard"), F.avg("jaccard").alias("mean_jaccard"))


@query("adjusted_rand", f"WITH {LAB_SQL}, {metrics_sql('lab', 'a', 'b')} SELECT n, ari FROM mt", dbl="ari:9")
def _(spark, sf):
    return G.agreement(G.contingency(labelings(spark, sf), "a", "b")).select("n", "ari")


@query("nmi", f"WITH {LAB_SQL}, {metrics_sql('lab', 'a', 'b')} SELECT n, nmi_sqrt, nmi_mean FROM mt", dbl="nmi_sqrt:9 nmi_mean:9")
def _(spark, sf):
    return G.agreement(G.contingency(labelings(spark, sf), "a", "b")).select("n", "nmi_sqrt", "nmi_mean")


@query("purity", f"WITH labs AS (SELECT quality, toxic FROM labels), {metrics_sql('labs', 'quality', 'toxic')} SELECT n, purity_a, purity_b FROM mt", dbl="purity_a purity_b")
def _(spark, sf):
    return G.agreement(G.contingency(table(spark, sf, "labels"), "quality", "toxic")).select("n", "purity_a", "purity_b")


@query("silhouette", f"""WITH {SQL_VECTORS}, d AS (SELECT a.obs_id, a.class, b.class AS other, avg(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM vectors a JOIN vectors b ON a.obs_id <> b.obs_id GROUP BY 1, 2, 3),
 s AS (SELECT obs_id, max(d) FILTER (class = other) AS a, min(d) FILTER (class <> other) AS b FROM d GROUP BY 1)
SELECT count(*) AS n, avg((b - a) / greatest(a, b)) AS mean_silhouette FROM s""", dbl="mean_silhouette")
def _(spark, sf):
    return K.silhouette(vectors(spark, sf), "v", "class").agg(F.count("*").alias("n"), F.avg("silhouette").alias("mean_silhouette"))


@query("min_cluster_size", f"WITH {SIGN_SQL} SELECT n_dim, min(c) AS min_size, min(c) <= 2 AS too_small FROM (SELECT n_dim, cl, count(*) AS c FROM runs GROUP BY 1, 2) GROUP BY 1", big="n_dim")
def _(spark, sf):
    s = sign_runs(spark, sf).groupBy("n_dim", "cl").agg(F.count("*").alias("c")).groupBy("n_dim").agg(F.min("c").alias("min_size"))
    return s.withColumn("too_small", F.col("min_size") <= 2)


@query("neighbor_preservation", f"""WITH {KNN_SQL.format(k=10)}, {SQL_VECTORS}, pr2 AS (SELECT a.obs_id, b.obs_id AS nbr, sqrt(list_sum(list_transform(list_zip(a.v[1:32], b.v[1:32]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist
  FROM vectors a, vectors b WHERE a.obs_id <> b.obs_id), k2 AS (SELECT obs_id, nbr, row_number() OVER (PARTITION BY obs_id ORDER BY dist, nbr) AS rn FROM pr2 QUALIFY rn <= 10)
SELECT (SELECT count(DISTINCT obs_id) FROM knn) AS n, count(*) / ((SELECT count(DISTINCT obs_id) FROM knn) * 10.0) AS preserved FROM knn JOIN k2 USING (obs_id, nbr)""", dbl="preserved")
def _(spark, sf):
    v = vectors(spark, sf)
    return N.preservation(N.knn(v, "obs_id", "v", 10), N.knn(v.withColumn("v", F.slice("v", 1, 32)), "obs_id", "v", 10), "obs_id", 10)


@query("seed_sensitivity", dbl="median q025 q975", d=4)
def _(spark, sf):
    x = pcs(spark, sf).persist()
    ref = K.kmeans(x, "pc", 10, seed=100, restarts=2)[0].select("obs_id", F.col("cluster").alias("ref"))
    out = None
    for seed in range(3):
        run = K.kmeans(x, "pc", 10, seed=seed, restarts=1)[0].join(ref, "obs_id")
        a = G.agreement(G.contingency(run, "cluster", "ref")).select(F.lit(seed).alias("seed"), F.lit("ari").alias("metric"), F.col("ari").alias("value"))
        out = a if out is None else out.unionByName(a)
    return resample_summary(out, ["metric"])


K_SQL = f"""{SIGN_SQL}, {metrics_sql('runs', 'cl', 'class', 'n_dim')},
 cell AS (SELECT n_dim, dense_rank() OVER (PARTITION BY n_dim ORDER BY nab.a) AS i, dense_rank() OVER (PARTITION BY n_dim ORDER BY nab.b) AS j, o / (na.m + nb.m - o) AS jac
  FROM nab JOIN na USING (n_dim, a) JOIN nb USING (n_dim, b)),
 dp AS (SELECT n_dim, 0::BIGINT AS i, 0::BIGINT AS used, 0.0::DOUBLE AS total, 1.0::DOUBLE AS low FROM mt
  UNION ALL SELECT n_dim, i, used, max(total), arg_max(low, total) FROM (
   SELECT dp.n_dim, dp.i + 1 AS i, dp.used + (1::BIGINT << cell.j) AS used, total + jac AS total, least(low, jac) AS low FROM dp JOIN cell ON cell.n_dim = dp.n_dim AND cell.i = dp.i + 1 AND (dp.used & (1::BIGINT << cell.j)) = 0
   UNION ALL SELECT dp.n_dim, dp.i + 1, dp.used, total, low FROM dp WHERE EXISTS (SELECT 1 FROM cell WHERE cell.n_dim = dp.n_dim AND cell.i = dp.i + 1)) GROUP BY 1, 2, 3),
 mj AS (SELECT n_dim, arg_max(low, total) AS min_jaccard FROM dp GROUP BY 1), sz AS (SELECT n_dim, min(m) AS min_size FROM na GROUP BY 1),
 far AS (SELECT a.obs_id AS i, b.obs_id AS j, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM vectors a JOIN vectors b ON a.obs_id <> b.obs_id),
 near AS (SELECT x.n_dim, i, x.cl, y.cl AS other, avg(d) AS d FROM far JOIN runs x ON x.obs_id = i JOIN runs y ON y.obs_id = j AND y.n_dim = x.n_dim GROUP BY ALL),
 sil AS (SELECT n_dim, i, max(d) FILTER (cl = other) AS a, min(d) FILTER (cl <> other) AS b FROM near GROUP BY ALL),
 ms AS (SELECT n_dim, avg(coalesce((b - a) / greatest(a, b), 0)) AS silhouette FROM sil GROUP BY 1)"""


@query("k_selection", f"""WITH RECURSIVE {K_SQL}, q AS (SELECT n_dim AS k, ari, min_jaccard, silhouette, CAST(min_size AS BIGINT) AS min_size,
  CASE WHEN min_size >= 8 THEN 0.55 * ari + 0.35 * min_jaccard + 0.10 * (silhouette + 1) / 2 END AS score FROM mt JOIN mj USING (n_dim) JOIN sz USING (n_dim) JOIN ms USING (n_dim))
SELECT *, coalesce(row_number() OVER (ORDER BY score DESC NULLS LAST, k) = 1 AND score IS NOT NULL, false) AS chosen FROM q""", dbl="ari min_jaccard silhouette score", big="k")
def _(spark, sf):
    runs = sign_runs(spark, sf)
    c = G.contingency(runs, "cl", "class", ["n_dim"])
    jac = G.optimal_matching(c, ["n_dim"], by="jaccard").groupBy("n_dim").agg(F.min("jaccard").alias("min_jaccard"))
    size = runs.groupBy("n_dim", "cl").agg(F.count("*").alias("c")).groupBy("n_dim").agg(F.min("c").alias("min_size"))
    v = vectors(spark, sf).select("obs_id", "v")
    sil = reduce(DataFrame.unionByName, [K.silhouette(runs.where(F.col("n_dim") == d).join(v, "obs_id"), "v", "cl").groupBy("n_dim").agg(F.avg("silhouette").alias("silhouette"))
                                         for d in (2, 3, 4)])
    m = G.agreement(c, ["n_dim"]).join(jac, "n_dim").join(size, "n_dim").join(sil, "n_dim")
    return K.k_score(m.select(F.col("n_dim").alias("k"), "ari", "min_jaccard", "silhouette", "min_size"))


@query("cross_algorithm_agreement", f"""WITH {LAB_SQL}, rp AS (SELECT 'a' AS run_a, 'b' AS run_b, a AS la, b AS lb FROM lab UNION ALL SELECT 'a', 'c', a, c FROM lab UNION ALL SELECT 'b', 'c', b, c FROM lab), {metrics_sql('rp', 'la', 'lb', 'run_a, run_b')}
SELECT run_a, run_b, n, ari, nmi_mean FROM mt""", dbl="ari:9 nmi_mean:9")
def _(spark, sf):
    lab = labelings(spark, sf)
    runs = G.stack_runs({n: lab.select("id", F.col(n).alias("l")) for n in ("a", "b", "c")}, "id", "l")
    return G.agreement(G.run_pairs(runs, "id", ["a", "b", "c"]), ["run_a", "run_b"]).select("run_a", "run_b", "n", "ari", "nmi_mean")


GR_SQL = """gs AS (SELECT rep, n_nationkey AS stratum FROM (SELECT rep, n_nationkey, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('|', 3, rep, n_nationkey)), n_nationkey) AS pos, count(*) OVER (PARTITION BY rep) AS g
  FROM nation, (SELECT unnest(range(0, 10)) AS rep)) WHERE pos <= ceil(0.8 * g))"""


@query("group_resample", f"WITH {GR_SQL} SELECT rep, stratum, count(*) AS n FROM gs JOIN customer ON c_nationkey = stratum GROUP BY 1, 2", big="rep stratum")
def _(spark, sf):
    picked = R.group_resample(table(spark, sf, "nation").select(F.col("n_nationkey").alias("stratum")), "stratum", range(10), 0.8, 3)
    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("stratum")).agg(F.count("*").alias("n"))
    return picked.join(n, "stratum")


@query("resample_stability", dbl="ari nmi_mean mapped_accuracy min_jaccard mean_jaccard", d=5)
def _(spark, sf):
    x = vectors(spark, sf).withColumn("stratum", F.col("obs_id") % 20)
    picked = R.group_resample(x.select("stratum"), "stratum", range(500), 0.8, 3).withColumn("w", F.lit(1))
    return B.stability(x, "obs_id", "v", "stratum", picked, 500, range(2, 9), n_pc=3, starts=2)


@query("ward_resample_stability", dbl="ari mapped_accuracy", d=5)
def _(spark, sf):
    x = pcs(spark, sf).withColumn("stratum", F.col("obs_id") % 20)
    mapped, _, _ = K.micro_clusters(x, "obs_id", "pc", budget=200)
    df = x.join(mapped.select("obs_id", "micro"), "obs_id")
    sums = R.micro_sums(df, "pc", "stratum", "micro", "class")
    picked = R.group_resample(x.select("stratum"), "stratum", range(12), 0.8, 3)
    return R.resample_stability(sums, "stratum", picked, "micro", "class", 3, 10)


# repeats with whole strata left out and sign-pattern clusters that change with the repeat
ASSIGN_SQL = f"""{SQL_VECTORS}, rowsx AS (SELECT obs_id AS id, class, obs_id % 20 AS stratum, v FROM vectors),
 assign AS (SELECT rep, id, class, stratum, CASE WHEN v[rep + 1] > 0 THEN 2 ELSE 0 END + CASE WHEN v[rep + 2] > 0 THEN 1 ELSE 0 END AS cluster FROM rowsx, (SELECT unnest(range(0, 8)) AS rep) WHERE (stratum + rep) % 5 <> 0)"""


def assignments(spark, sf):
    rows = vectors(spark, sf).select(F.col("obs_id").alias("id"), "class", (F.col("obs_id") % 20).alias("stratum"), "v")
    a = R.repeats(rows, range(8)).where((F.col("stratum") + F.col("rep")) % 5 != 0)
    bit = lambda k: F.when(F.element_at("v", F.col("rep") + k) > 0, 1).otherwise(0)
    return rows.select("id", "class", "stratum"), a.select("rep", "id", (2 * bit(1) + bit(2)).alias("cluster"))


@query("coclustering", f"""WITH {KNN_SQL.format(k=10)}, {ASSIGN_SQL}, pr AS (SELECT DISTINCT least(obs_id, nbr) AS i, greatest(obs_id, nbr) AS j FROM knn)
SELECT i, j, count(*) AS n_seen, count(*) FILTER (a.cluster = b.cluster) AS n_together, count(*) FILTER (a.cluster = b.cluster) / count(*) AS share FROM pr JOIN assign a ON a.id = i JOIN assign b ON b.id = j AND b.rep = a.rep GROUP BY 1, 2""", dbl="share")
def _(spark, sf):
    n = N.knn(vectors(spark, sf), "obs_id", "v", 10)
    pairs = n.select(F.least("obs_id", "nbr").alias("i"), F.greatest("obs_id", "nbr").alias("j")).distinct()
    return G.coclustering(pairs, assignments(spark, sf)[1])


@query("cell_stability_margin", f"""WITH {ASSIGN_SQL}, pr AS (SELECT a.id, a.class, b.id AS other, b.class AS partner, count(*) FILTER (a.cluster = b.cluster) / count(*) AS s FROM assign a JOIN assign b ON a.rep = b.rep AND a.id <> b.id GROUP BY 1, 2, 3, 4),
 m AS (SELECT id, class, partner, avg(s) AS m FROM pr GROUP BY 1, 2, 3), o AS (SELECT id, class, max(m) FILTER (class = partner) AS same, max(m) FILTER (class <> partner) AS other FROM m GROUP BY 1, 2)
SELECT *, same - other AS margin, CASE WHEN round(same - other, 9) <= 0 THEN 'high' WHEN round(same - other, 9) < 0.10 THEN 'watch' ELSE 'ok' END AS risk FROM o""", dbl="same other margin", big="class")
def _(spark, sf):
    rows, a = assignments(spark, sf)
    return G.stability_margin(a, rows)


@query("exemplars", f"""WITH {SQL_OBS}, lg AS (SELECT obs_id, class, batch, feature, value FROM obs UNPIVOT (value FOR feature IN (sum_qty, avg_price, o_totalprice))),
 m AS (SELECT class, feature, median(value) AS med, mad(value) AS mad FROM lg GROUP BY 1, 2), d AS (SELECT obs_id, class, batch, sqrt(sum(pow((value - med) / (1.4826 * mad), 2))) + CASE WHEN batch = 'P' THEN 1 ELSE 0 END AS dist
   FROM lg JOIN m USING (class, feature) GROUP BY 1, 2, 3), r AS (SELECT obs_id, class, dist, row_number() OVER (PARTITION BY class ORDER BY round(dist, 9), obs_id) AS rn FROM d WHERE batch <> 'F')
SELECT * FROM r WHERE rn <= 6""", dbl="dist", big="rn")
def _(spark, sf):
    from .bindings import long
    lg = long(spark, sf, features=["sum_qty", "avg_price", "o_totalprice"], staged=True)
    j = lg.join(T.median_mad(lg, ["class", "feature"]), ["class", "feature"])
    z = (F.col("value") - F.col("med")) / (1.4826 * F.col("mad"))
    d = j.groupBy("obs_id", "class", "batch").agg(F.sqrt(F.sum(z * z)).alias("dist"))
    d = d.where("batch <> 'F'").withColumn("dist", F.col("dist") + F.when(F.col("batch") == "P", 1.0).otherwise(0.0))
    return J.topk(d.select("obs_id", "class", "dist"), ["class"], [F.round("dist", 9), "obs_id"], 6)

"""Group-difference statistics."""
from itertools import combinations

from pyspark.sql import functions as F

from ..functions import scalar as X, special
from ..operators import aggs as A, contingency as C, multiplicity as M, order, permute as P, qc, rank_tests as R, transforms as T
from ..runtime import stage
from .bindings import (FEATURES, SQL_LONG, SQL_LONG_MISSING, SQL_OBS, SQL_PARTS_LONG, SQL_RANKED, long, long_of, obs, obs_missing, parts_long, table)
from .registry import query
from .sqltails import f_sf, norm_two_sided

QC_SQL = SQL_OBS + f""", ok AS (SELECT * FROM obs WHERE n_lines >= 2 AND max_ship_gap >= 0 AND o_totalprice <= 480000),
 long AS (SELECT obs_id, class, batch, feature, value FROM ok UNPIVOT (value FOR feature IN ({', '.join(FEATURES)})))"""
SUMS = f"""{SQL_RANKED}, g AS (SELECT feature, class, count(*) AS n_g, sum(rk) AS s, sum(CAST(ties AS DOUBLE) * ties - 1) AS t FROM ranked GROUP BY 1, 2),
 tot AS (SELECT feature, CAST(sum(n_g) AS DOUBLE) AS n, count(*) AS k, sum(s * s / n_g) AS ss, sum(t) AS t FROM g GROUP BY 1)"""


def qc_long(spark, sf):
    ok = X.all_of([X.within("n_lines", 2), X.within("max_ship_gap", 0), X.within("o_totalprice", hi=480000)])
    return long_of(obs(spark, sf, staged=True).where(ok), ["obs_id", "class", "batch"], FEATURES)


@query("kruskal_wallis", f"""WITH {QC_SQL}, {SUMS},
 z AS (SELECT feature, t, avg(t) OVER w AS m, stddev_samp(t) OVER w AS sd FROM (SELECT feature, ln(1 + (value - min(value) OVER w) / (sum(value) OVER w - count(*) OVER w * min(value) OVER w) * 10000) AS t
   FROM long WINDOW w AS (PARTITION BY feature)) WINDOW w AS (PARTITION BY feature)),
 zz AS (SELECT feature, max((t - m) / sd) AS z_max, min((t - m) / sd) AS z_min FROM z GROUP BY 1),
 h AS (SELECT feature, CAST(n AS BIGINT) AS n, k - 1 AS df, (12 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h, n AS nd, k FROM tot),
 p AS (SELECT *, exp(-h / 2) * (1 + h / 2) AS p, greatest(0, (h - k + 1) / (nd - k)) AS epsilon2 FROM h),
 o AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS i, count(*) OVER () AS m FROM p)
SELECT feature, n, df, h, p, epsilon2, min(least(1, p * m / i)) OVER (ORDER BY i DESC) AS p_bh, z_min, z_max FROM o JOIN zz USING (feature)""",
       dbl="h p epsilon2:8 p_bh z_min z_max", big="df", d=5)
def _(spark, sf):
    """Flagship: quality filter, shift-sum z, rank test over priorities, BH.

    Ranks do not change under the monotone transform, so the test runs on the raw values,
    which also keeps distinct values distinct when the column sum is very large.
    """
    df = qc_long(spark, sf)
    z = T.shift_sum_log1p_z(df, 1).groupBy("feature").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    kw = M.bh(R.kruskal_wallis(R.rank_sums(df), even_df=4), "p", ["feature"])
    return kw.join(z, "feature").select("feature", "n", "df", "h", "p", "epsilon2", "p_bh", "z_min", "z_max")


@query("kw_effect", f"""WITH {SQL_PARTS_LONG}, {SUMS}, h AS (SELECT *, (12 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM tot)
SELECT feature, h, k, greatest(0, (h - k + 1) / (n - k)) AS epsilon2 FROM h""", dbl="h epsilon2", d=5)
def _(spark, sf):
    return R.kruskal_wallis(R.rank_sums(parts_long(spark, sf)), even_df=24).select("feature", "h", "k", "epsilon2")


DUNN = f"""d AS (SELECT a.feature, a.class AS g1, b.class AS g2, a.n_g AS n1, b.n_g AS n2, a.s / a.n_g AS m1, b.s / b.n_g AS m2, tot.n AS n, tot.t AS t
   FROM g a JOIN g b ON a.feature = b.feature AND a.class < b.class JOIN tot ON tot.feature = a.feature),
 dz AS (SELECT *, (m1 - m2) / sqrt((n * (n + 1) / 12 - t / (12 * (n - 1))) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS z FROM d),
 dp AS (SELECT *, {norm_two_sided('z')} AS p FROM dz),
 dadj AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY p, g1, g2) AS i, count(*) OVER (PARTITION BY feature) AS m,
   row_number() OVER (ORDER BY p, feature, g1, g2) AS j, count(*) OVER () AS mm FROM dp)"""


@query("dunn_holm", f"""WITH {SQL_LONG}, {SUMS}, {DUNN} SELECT feature, g1, g2, n1, n2, m1, m2, z, abs(z) / sqrt(n) AS r, p,
 max(least(1, (m - i + 1) * p)) OVER (PARTITION BY feature ORDER BY i) AS p_holm, min(least(1, p * mm / j)) OVER (ORDER BY j DESC) AS p_bh FROM dadj""",
       dbl="m1 m2 z r:8 p p_holm p_bh", d=5)
def _(spark, sf):
    return R.dunn(R.rank_sums(long(spark, sf)))


@query("pairwise_details", f"""WITH {SQL_LONG}, {SUMS}, {DUNN}, s AS (SELECT feature, class, avg(value) AS mean, quantile_cont(value, .5) AS median FROM long GROUP BY 1, 2),
 h AS (SELECT feature, g1, g2, z, max(least(1, (m - i + 1) * p)) OVER (PARTITION BY feature ORDER BY i) AS p_holm FROM dadj)
SELECT h.feature, g1, g2, a.mean - b.mean AS mean_diff, a.median - b.median AS median_diff, z, CASE WHEN z > 0 THEN 'first higher' WHEN z < 0 THEN 'second higher' ELSE 'equal' END AS direction,
 p_holm < 0.05 AS reject FROM h JOIN s a ON a.feature = h.feature AND a.class = g1 JOIN s b ON b.feature = h.feature AND b.class = g2""", dbl="mean_diff median_diff z", d=5)
def _(spark, sf):
    df = long(spark, sf, staged=True)
    d = R.dunn(R.rank_sums(df)).select("feature", "g1", "g2", "z", "p_holm")
    s = A.descriptive(df).select("feature", "class", "mean", "median")
    side = lambda g, t: s.select("feature", F.col("class").alias(g), F.col("mean").alias("mean" + t), F.col("median").alias("median" + t))
    j = d.join(side("g1", "_1"), ["feature", "g1"]).join(side("g2", "_2"), ["feature", "g2"])
    return j.select("feature", "g1", "g2", (F.col("mean_1") - F.col("mean_2")).alias("mean_diff"), (F.col("median_1") - F.col("median_2")).alias("median_diff"), "z",
                    X.cascade([(F.col("z") > 0, "first higher"), (F.col("z") < 0, "second higher")], "equal").alias("direction"), (F.col("p_holm") < 0.05).alias("reject"))


@query("brown_forsythe", f"""WITH {SQL_LONG}, md AS (SELECT feature, class, median(value) AS med FROM long GROUP BY 1, 2),
 d AS (SELECT feature, class, value, abs(value - med) AS d FROM long JOIN md USING (feature, class)),
 g AS (SELECT feature, class, count(*) AS n_g, avg(d) AS m, var_pop(d) AS v, var_samp(value) AS va FROM d GROUP BY 1, 2),
 t AS (SELECT feature, sum(n_g) AS n, count(*) AS k, sum(n_g * m) / sum(n_g) AS gm, sum(n_g * v) AS ssw, max(va) / min(va) AS variance_ratio FROM g GROUP BY 1),
 f AS (SELECT t.feature, CAST(n AS BIGINT) AS n, k - 1 AS df1, CAST(n - k AS BIGINT) AS df2, (sum(n_g * pow(m - gm, 2)) / (k - 1)) / (ssw / (n - k)) AS f, variance_ratio
   FROM t JOIN g ON g.feature = t.feature GROUP BY t.feature, n, k, ssw, variance_ratio),
 p AS (SELECT *, {f_sf('f', 'df1', 'df2')} AS p FROM f), o AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS i, count(*) OVER () AS mm FROM p)
SELECT feature, n, df1, df2, f, variance_ratio, p, min(least(1, p * mm / i)) OVER (ORDER BY i DESC) AS p_bh FROM o""", dbl="f variance_ratio p p_bh", d=5)
def _(spark, sf):
    return R.brown_forsythe(long(spark, sf, staged=True))


MW = f"""l2 AS (SELECT * FROM long WHERE batch IN ('F', 'O')), rk AS (SELECT *, rank() OVER (PARTITION BY {{keys}} ORDER BY value) + (count(*) OVER (PARTITION BY {{keys}}, value) - 1) / 2.0::DOUBLE AS r,
   count(*) OVER (PARTITION BY {{keys}}, value) AS c FROM l2),
 u AS (SELECT {{keys}}, count(*) FILTER (batch = 'F') AS n1, count(*) FILTER (batch = 'O') AS n2, sum(r) FILTER (batch = 'F') AS r1, sum(CAST(c AS DOUBLE) * c - 1) AS t FROM rk GROUP BY {{keys}}),
 mw AS (SELECT {{keys}}, n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) AS dev,
   sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * ((n1 + n2 + 1) - t / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) AS sd FROM u)"""


@query("mann_whitney", f"""WITH {SQL_LONG}, {MW.format(keys='feature')}, z AS (SELECT feature, n1, n2, u, dev / sd AS z, sign(dev) * greatest(abs(dev) - 0.5, 0) / sd AS z_corrected FROM mw),
 p AS (SELECT *, {norm_two_sided('z')} AS p FROM z), o AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS i, count(*) OVER () AS m FROM p)
SELECT feature, n1, n2, u, z, z_corrected, p, min(least(1, p * m / i)) OVER (ORDER BY i DESC) AS p_bh FROM o""", dbl="u z z_corrected p p_bh", d=5)
def _(spark, sf):
    s = R.rank_sums(long(spark, sf, staged=True).where("batch IN ('F', 'O')"), ["feature"], "batch")
    a = R.mann_whitney(s, ["feature"], "batch", "F", "O", continuity=False).drop("delta")
    b = R.mann_whitney(s, ["feature"], "batch", "F", "O", continuity=True).select("feature", F.col("z").alias("z_corrected"))
    return M.bh(a.join(b, "feature").withColumn("p", special.norm_two_sided_col(F.col("z"))), "p", ["feature"])


@query("cliffs_delta", f"""WITH {SQL_LONG}, {MW.format(keys='feature')} SELECT feature, 2 * u / (CAST(n1 AS DOUBLE) * n2) - 1 AS delta,
 CASE WHEN 2 * u > CAST(n1 AS DOUBLE) * n2 THEN 'first higher' WHEN 2 * u < CAST(n1 AS DOUBLE) * n2 THEN 'second higher' ELSE 'equal' END AS direction FROM mw""", dbl="delta")
def _(spark, sf):
    s = R.rank_sums(long(spark, sf).where("batch IN ('F', 'O')"), ["feature"], "batch")
    d = R.mann_whitney(s, ["feature"], "batch", "F", "O", continuity=False)
    return d.select("feature", "delta", X.cascade([(F.col("delta") > 0, "first higher"), (F.col("delta") < 0, "second higher")], "equal").alias("direction"))


@query("within_group_contrast", f"""WITH {SQL_LONG}, {MW.format(keys='class, feature')}, z AS (SELECT class, feature, n1, n2, u, dev / sd AS z, 2 * u / (CAST(n1 AS DOUBLE) * n2) - 1 AS delta FROM mw),
 p AS (SELECT *, {norm_two_sided('z')} AS p FROM z), o AS (SELECT *, row_number() OVER (ORDER BY p, class, feature) AS i, count(*) OVER () AS m,
   row_number() OVER (PARTITION BY class ORDER BY p, feature) AS j, count(*) OVER (PARTITION BY class) AS mc FROM p)
SELECT class, feature, n1, n2, u, z, delta, p, min(least(1, p * m / i)) OVER (ORDER BY i DESC) AS q_global, min(least(1, p * mc / j)) OVER (PARTITION BY class ORDER BY j DESC) AS q_class,
 row_number() OVER (PARTITION BY feature ORDER BY round(abs(delta), 9) DESC, class) = 1 AS strongest FROM o""", dbl="u z delta p q_global q_class", d=5)
def _(spark, sf):
    keys = ["class", "feature"]
    s = R.rank_sums(long(spark, sf).where("batch IN ('F', 'O')"), keys, "batch")
    d = R.mann_whitney(s, keys, "batch", "F", "O", continuity=False).withColumn("p", special.norm_two_sided_col(F.col("z")))
    d = M.bh(M.bh(d, "p", keys, out="q_global"), "p", ["feature"], family=["class"], out="q_class")
    top = d.groupBy("feature").agg(F.min_by("class", F.struct(-F.round(F.abs("delta"), 9), F.col("class"))).alias("_c"))
    return d.join(top, "feature").withColumn("strongest", F.col("class") == F.col("_c")).drop("_c")


CHI = """ct AS (SELECT a, b, count(*) AS o FROM src GROUP BY 1, 2), ra AS (SELECT a, sum(o) AS na FROM ct GROUP BY 1), cb AS (SELECT b, sum(o) AS nb FROM ct GROUP BY 1),
 dm AS (SELECT CAST(sum(na) AS DOUBLE) AS n, count(*) AS r, (SELECT count(*) FROM cb) AS c FROM ra),
 x AS (SELECT n, r, c, sum(pow(coalesce(o, 0) - na * nb / n, 2) / (na * nb / n)) AS chi2, count(*) FILTER (na * nb / n < 5) AS n_low_expected
   FROM ra CROSS JOIN cb CROSS JOIN dm LEFT JOIN ct USING (a, b) GROUP BY 1, 2, 3),
 v AS (SELECT *, (r - 1) * (c - 1) AS df, sqrt(chi2 / n / (least(r, c) - 1)) AS v, r - pow(r - 1, 2) / (n - 1) AS rc, c - pow(c - 1, 2) / (n - 1) AS cc,
   greatest(0, chi2 / n - (r - 1) * (c - 1) / (n - 1)) AS phi FROM x)"""


@query("chi_square_cramers_v", f"""WITH src AS (SELECT l_returnflag AS a, CAST(l_linenumber AS VARCHAR) AS b FROM lineitem), {CHI}
SELECT CAST(n AS BIGINT) AS n, r, c, chi2, n_low_expected, df, v, sqrt(phi / (least(rc, cc) - 1)) AS v_corrected FROM v""", dbl="chi2 v v_corrected")
def _(spark, sf):
    return C.chi_square(C.cell_counts(table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber"))


PERM_REPS, KEYED_REPS = 99, 5000


def deal_sql(seed: int, rows: str, strata: str, out: str) -> str:
    """CTEs that give ``out`` (rep, all columns of ``rows``, permuted): ``rows`` has (id, label, stratum), ``strata`` its rows in ``rep`` x stratum."""
    keys = ", ".join(f"CAST('0x' || substr(h, {1 + i * P.KEY_STEP}, {P.KEY_DIGITS}) AS BIGINT) * {P.KEYED} AS k{i}" for i in range(P.ROUNDS))

    def network(source: str) -> str:
        sql = f"SELECT *, x // wide AS l, x % wide AS r FROM {source}"
        for i in range(P.ROUNDS):
            at, by, top = ("l", "r", "high") if i % 2 == 0 else ("r", "l", "wide")
            sql = f"SELECT *, ({by} * {P.SPREAD} + k{i}) & {P.MASK} AS t FROM ({sql})"
            sql = f"SELECT * EXCLUDE (t), (xor(t, t >> 15) * {P.FINISH}) & {P.MASK} AS u FROM ({sql})"
            sql = f"SELECT * EXCLUDE (u) REPLACE (({at} + ((xor(u, u >> 16) * {top}) >> 31)) % {top} AS {at}) FROM ({sql})"
        return f"SELECT rep, sid, place, l * wide + r AS x FROM ({sql})"

    return f"""sized AS (SELECT stratum, dense_rank() OVER (ORDER BY stratum) AS sid, count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS high FROM {rows} GROUP BY stratum),
 keyed AS (SELECT *, {keys} FROM (SELECT rep, sid, n, high, (n + high - 1) // high AS wide, md5(concat_ws('|', {seed}, rep, stratum)) AS h FROM sized, {strata})),
 placed AS (SELECT q.*, sid, row_number() OVER (PARTITION BY stratum ORDER BY id) - 1 AS place, row_number() OVER (PARTITION BY stratum ORDER BY label) - 1 AS slot FROM {rows} q JOIN sized USING (stratum)),
 walk AS (({network("(SELECT rep, sid, place, place AS x, high, wide, " + ", ".join(f"k{i}" for i in range(P.ROUNDS)) + " FROM placed JOIN keyed USING (sid))")})
  UNION ALL ({network("(SELECT w.rep, w.sid, w.place, w.x, high, wide, " + ", ".join(f"k{i}" for i in range(P.ROUNDS)) + " FROM walk w JOIN keyed USING (rep, sid) WHERE w.x >= n)")})),
 {out} AS (SELECT w.rep, p.*, s.label AS permuted FROM walk w JOIN placed p USING (sid, place) JOIN placed s ON s.sid = w.sid AND s.slot = w.x)"""


PERM_BASE_SQL = "base AS (SELECT o_orderkey AS id, o_orderpriority AS label, o_orderstatus AS stratum, CAST(c_nationkey % 3 AS VARCHAR) AS a FROM orders JOIN customer ON c_custkey = o_custkey)"


def permutation_sql(reps: int) -> str:
    deals = deal_sql(5, "base", f"(SELECT unnest(range(0, {reps})) AS rep)", "pm")
    return f"""WITH RECURSIVE {PERM_BASE_SQL}, {deals},
 ct AS (SELECT rep, a, permuted AS b, count(*) AS o FROM pm GROUP BY 1, 2, 3 UNION ALL SELECT -1, a, label, count(*) FROM base GROUP BY 2, 3),
 mg AS (SELECT rep, a, b, o, sum(o) OVER (PARTITION BY rep, a) AS na, sum(o) OVER (PARTITION BY rep, b) AS nb, CAST(sum(o) OVER (PARTITION BY rep) AS DOUBLE) AS n FROM ct),
 vv AS (SELECT rep, sqrt(sum(pow(o - na * nb / n, 2) / (na * nb / n)) / max(n) / 2) AS v FROM mg GROUP BY 1), ob AS (SELECT v AS observed FROM vv WHERE rep = -1)
SELECT observed, count(*) AS n_rep, (1 + count(*) FILTER (v >= observed - 1e-12)) / (count(*) + 1) AS p, quantile_cont(v, .5) AS null_median,
 quantile_cont(v, .025) AS null_q025, quantile_cont(v, .975) AS null_q975 FROM vv, ob WHERE rep >= 0 GROUP BY observed"""


def permutation_test(spark, sf, reps):
    base = permutation_base(spark, sf)
    placed = stage(P.with_places(base, "id", "label", "stratum"))
    null = C.chi_square(P.null_cells(placed, "a", range(reps), 5), ["rep"])
    return C.summarise_null(null, C.chi_square(C.cell_counts(placed, "a", "label")))


@query("strat_permutation_test", permutation_sql(PERM_REPS), dbl="observed p null_median null_q025 null_q975", d=7)
def _(spark, sf):
    return permutation_test(spark, sf, PERM_REPS)


@query("strat_permutation_keyed", permutation_sql(KEYED_REPS), dbl="observed p null_median null_q025 null_q975", d=7)
def _(spark, sf):
    return permutation_test(spark, sf, KEYED_REPS)


def permutation_base(spark, sf):
    cu = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 3).cast("string").alias("a"))
    return table(spark, sf, "orders").join(cu, "o_custkey").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("stratum"), "a")


@query("strat_permutation_counts", dbl="observed p null_median null_q025 null_q975", d=7)
def _(spark, sf):
    base = permutation_base(spark, sf)
    cells = C.cell_counts(base, "a", "label", ["stratum"])
    null = C.chi_square(C.permuted_cells(cells, "stratum", 500, 5), ["rep"])
    return C.summarise_null(null, C.chi_square(C.cell_counts(base, "a", "label")))


@query("rank_anova", dbl="ss:1 df df_res f partial_eta2 p q", d=5)
def _(spark, sf):
    cells = order.rank_cells(long(spark, sf), ["feature"], "value", ["batch", "class"])
    w = F.col("c_by")
    cells = cells.groupBy("feature", F.col("batch").alias("a"), F.col("class").alias("b")).agg(
        F.sum(w).alias("n"), F.sum(w * F.col("rank")).alias("s"), F.sum(w * F.col("rank") * F.col("rank")).alias("q"))
    out = C.rank_anova(cells).withColumn("p", special.f_sf_col(F.col("f"), F.col("df"), F.col("df_res")))
    return M.bh(out, "p", ["feature"], family=["term"], out="q")


@query("availability_bias", f"""WITH {SQL_LONG_MISSING}, src0 AS (SELECT feature, class AS a, value IS NOT NULL AS b FROM long),
 ct AS (SELECT feature, a, b, count(*) AS o FROM src0 GROUP BY 1, 2, 3), na AS (SELECT feature, a, sum(o) AS na FROM ct GROUP BY 1, 2), nb AS (SELECT feature, b, sum(o) AS nb FROM ct GROUP BY 1, 2),
 nn AS (SELECT feature, CAST(sum(na) AS DOUBLE) AS n, count(*) AS r FROM na GROUP BY 1), nc AS (SELECT feature, count(*) AS c FROM nb GROUP BY 1),
 x AS (SELECT na.feature, max(n) AS n, max(r) AS r, max(c) AS c, sum(pow(coalesce(o, 0) - na * nb / n, 2) / (na * nb / n)) AS chi2 FROM na JOIN nb USING (feature) JOIN nn USING (feature) JOIN nc USING (feature)
   LEFT JOIN ct ON ct.feature = na.feature AND ct.a = na.a AND ct.b = nb.b GROUP BY 1),
 rt AS (SELECT feature, a, avg(CASE WHEN b THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM src0 GROUP BY 1, 2)
SELECT feature, min(rate) AS min_rate, max(rate) AS max_rate, chi2, CASE WHEN least(r, c) > 1 THEN sqrt(chi2 / n / (least(r, c) - 1)) END AS v FROM x JOIN rt USING (feature) GROUP BY feature, chi2, r, c, n""",
       dbl="min_rate max_rate chi2 v")
def _(spark, sf):
    df = long_of(obs_missing(spark, sf), ["obs_id", "class"], FEATURES).withColumn("has", F.col("value").isNotNull())
    rate = df.groupBy("feature", "class").agg(F.avg(F.col("has").cast("double")).alias("rate")).groupBy("feature").agg(
        F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"))
    chi = C.chi_square(C.cell_counts(df, "class", "has", ["feature"]), ["feature"]).select("feature", "chi2", "v")
    return rate.join(chi, "feature")


def batch_scale_audit(df, batch, value, levels):
    """Median inside and outside each batch, their ratio, and the one-vs-rest |AUC|.

    Both medians come from distinct-value counts: the complement of a batch is total minus own counts.
    """
    one = df.select(F.lit("x").alias("feature"), F.col(batch).alias("batch"), F.col(value).alias("value")).where(F.col("value").isNotNull())
    per = one.groupBy("value").agg(*[F.count_if(F.col("batch") == b).alias(f"n_{i}") for i, b in enumerate(levels)], F.count("*").alias("n_all"))
    st = F.explode(F.array(*[F.struct(F.lit(b).alias("batch"), F.col(f"n_{i}").alias("own"), (F.col("n_all") - F.col(f"n_{i}")).alias("rest"))
                             for i, b in enumerate(levels)])).alias("s")
    sides = per.select("value", st).select("value", "s.*")
    stack = sides.unpivot(["batch", "value"], ["own", "rest"], "side", "c").where("c > 0")
    med = order.quantile_columns(order.cumulative_counts(stack, ["batch", "side"], "value"), ["batch", "side"], "value", {"median": .5})
    wide = med.groupBy("batch").pivot("side", ["own", "rest"]).agg(F.first("median"))
    auc = R.one_vs_rest_auc(one, ["feature"], "batch").select("batch", F.col("n_g").alias("n"), F.greatest("auc", 1 - F.col("auc")).alias("abs_auc"))
    return auc.join(wide, "batch").withColumn("ratio", F.try_divide(F.col("own"), F.col("rest")))


@query("batch_scale_audit", f"""WITH {SQL_OBS}, r AS (SELECT *, rank() OVER (ORDER BY avg_price) + (count(*) OVER (PARTITION BY avg_price) - 1) / 2.0::DOUBLE AS rk FROM obs),
 b AS (SELECT unnest(['F','O','P']) AS bt), n AS (SELECT CAST(count(*) AS DOUBLE) AS nn FROM obs)
SELECT bt AS batch, count(*) FILTER (batch = bt) AS n, quantile_cont(avg_price, .5) FILTER (batch = bt) AS own, quantile_cont(avg_price, .5) FILTER (batch <> bt) AS rest,
 quantile_cont(avg_price, .5) FILTER (batch = bt) / quantile_cont(avg_price, .5) FILTER (batch <> bt) AS ratio,
 greatest((sum(rk) FILTER (batch = bt) - count(*) FILTER (batch = bt) * (count(*) FILTER (batch = bt) + 1) / 2) / (count(*) FILTER (batch = bt) * CAST(count(*) FILTER (batch <> bt) AS DOUBLE)),
  1 - (sum(rk) FILTER (batch = bt) - count(*) FILTER (batch = bt) * (count(*) FILTER (batch = bt) + 1) / 2) / (count(*) FILTER (batch = bt) * CAST(count(*) FILTER (batch <> bt) AS DOUBLE))) AS abs_auc
FROM r, b GROUP BY 1""", dbl="own rest ratio abs_auc", d=5)
def _(spark, sf):
    return batch_scale_audit(obs(spark, sf), "batch", "avg_price", ["F", "O", "P"])


# t quantile as the large-sample expansion around the normal quantile (degrees of freedom are in the thousands)
_Z = 1.959963984540054
_T = (f"({_Z} + {(_Z**3 + _Z) / 4!r} / df + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / (df * df) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384!r} / (df * df * df))")


@query("mean_t_ci", f"""WITH {SQL_LONG}, s AS (SELECT feature, class, count(value) AS n, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS se, CAST(count(value) - 1 AS DOUBLE) AS df FROM long GROUP BY 1, 2)
SELECT feature, class, n, mean, se, mean - {_T} * se AS ci_low, mean + {_T} * se AS ci_high FROM s""", dbl="mean se ci_low:4 ci_high:4", d=5)
def _(spark, sf):
    g = long(spark, sf).groupBy("feature", "class").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"))
    g = g.withColumn("t", special.t_quantile_col(F.lit(0.975), (F.col("n") - 1).cast("double")))
    return g.withColumn("ci_low", F.col("mean") - F.col("t") * F.col("se")).withColumn("ci_high", F.col("mean") + F.col("t") * F.col("se")).drop("t")

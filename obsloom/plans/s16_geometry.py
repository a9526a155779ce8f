"""Point-sequence geometry: sections of a user's event trail."""
from pyspark.sql import functions as F

from ..operators import geometry as G, order
from .bindings import SQL_POINTS, points, table
from .registry import query

KEYS, ORDER = ["neuron_id", "section"], ["seq_ts", "event_id"]
SEG_SQL = f"""{SQL_POINTS}, pv AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, lag(r) OVER w AS pr FROM points WINDOW w AS (PARTITION BY neuron_id, section ORDER BY seq_ts, event_id)),
 seg AS (SELECT neuron_id, section, r, pr, sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) AS len FROM pv WHERE px IS NOT NULL)"""


def seg(spark, sf):
    return G.segments(points(spark, sf), KEYS, ORDER)


@query("segment_lengths", f"""WITH {SEG_SQL} SELECT neuron_id, count(*) AS n_segments, sum(len) AS total, max(len) AS "max", quantile_cont(len, .5) AS median, quantile_cont(len, .99) AS p99 FROM seg GROUP BY 1""",
       dbl="total max median p99", d=5)
def _(spark, sf):
    return G.segment_lengths(seg(spark, sf), "neuron_id")


@query("radius_stats", f"""WITH {SEG_SQL}, w AS (SELECT neuron_id, sum(len * (r + pr) / 2) FILTER (len > 0 AND r + pr > 0) / sum(len) FILTER (len > 0 AND r + pr > 0) AS weighted_mean FROM seg GROUP BY 1),
 p AS (SELECT neuron_id, count(*) AS n, min(r) AS "min", max(r) AS "max", quantile_cont(r, .25) AS q25, quantile_cont(r, .5) AS median, quantile_cont(r, .75) AS q75, count(DISTINCT round(r, 6)) AS n_distinct FROM points WHERE r > 0 GROUP BY 1)
SELECT * FROM p LEFT JOIN w USING (neuron_id)""", dbl="min max q25 median q75 weighted_mean")
def _(spark, sf):
    return G.radius_stats(points(spark, sf), seg(spark, sf), "neuron_id")


@query("frustum_area_volume", f"""WITH {SEG_SQL}, s AS (SELECT neuron_id, sum(len) AS length, sum(pi() * (pr + r) * sqrt(len * len + (pr - r) * (pr - r))) AS area, sum(pi() * len / 3 * (pr * pr + pr * r + r * r)) AS volume FROM seg GROUP BY 1)
SELECT *, 2 * volume / area AS effective_radius, area / length AS area_per_length FROM s""", dbl="length:4 area:3 volume:3 effective_radius area_per_length")
def _(spark, sf):
    return G.frustum(seg(spark, sf), "neuron_id")


CENTRE_SQL = "ctr AS (SELECT neuron_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, avg(r) AS soma_radius FROM points GROUP BY 1)"


def centre(p):
    return p.groupBy("neuron_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"), F.avg("r").alias("soma_radius"))


@query("extent_radial", f"""WITH {SQL_POINTS}, {CENTRE_SQL} SELECT neuron_id, max(x) - min(x) AS width, max(y) - min(y) AS height, max(z) - min(z) AS depth,
 max(sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2))) AS max_radial FROM points JOIN ctr USING (neuron_id) GROUP BY 1""", dbl="width height depth max_radial", d=5)
def _(spark, sf):
    p = points(spark, sf)
    return G.extent(p, "neuron_id", centre(p).drop("soma_radius"))


# parent of the i-th event of a user is its (i div 2)-th event
TREE_SQL = """ev AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 nd AS (SELECT a.user_id, a.event_id, b.event_id AS parent FROM ev a LEFT JOIN ev b ON b.user_id = a.user_id AND b.i = a.i // 2)"""


def tree(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id").withColumn("c", F.lit(1).cast("long"))
    i = order.cumulative_counts(e, ["user_id"], "event_id").select("user_id", "event_id", F.col("cum").alias("i"))
    up = i.select("user_id", F.col("event_id").alias("parent"), F.col("i").alias("half"))
    return i.withColumn("half", F.floor(F.col("i") / 2)).join(up, ["user_id", "half"], "left").select("user_id", "event_id", "parent")


@query("branch_order", f"""WITH RECURSIVE {TREE_SQL}, d AS (SELECT event_id, CAST(0 AS BIGINT) AS depth FROM nd WHERE parent IS NULL UNION ALL SELECT nd.event_id, d.depth + 1 FROM nd JOIN d ON nd.parent = d.event_id),
 k AS (SELECT parent AS event_id, count(*) AS kids FROM nd WHERE parent IS NOT NULL GROUP BY 1)
SELECT user_id, max(depth) AS max_order, sum(depth) AS sum_order, count(*) AS n_sections, count(kids) AS n_bifurcations, count(*) - count(kids) AS n_terminals FROM nd JOIN d USING (event_id) LEFT JOIN k USING (event_id) GROUP BY 1""", big="sum_order")
def _(spark, sf):
    t = tree(spark, sf)
    d = G.branch_order(t, "event_id", "parent").join(t.select("event_id", "user_id"), "event_id")
    o = d.groupBy("user_id").agg(F.max("depth").alias("max_order"), F.sum("depth").alias("sum_order"))
    return o.join(G.branch_counts(t, "event_id", "parent", "user_id"), "user_id")


FLAG_SQL = f"""{SEG_SQL}, {CENTRE_SQL}, md AS (SELECT neuron_id, quantile_cont(len, .5) AS med FROM seg WHERE len > 1e-9 GROUP BY 1),
 sf AS (SELECT neuron_id, count(*) FILTER (len <= 1e-9) AS n_zero_length, count(*) FILTER (len > coalesce(greatest(30, 10 * med), 30)) AS n_jumps FROM seg LEFT JOIN md USING (neuron_id) GROUP BY 1),
 rt AS (SELECT neuron_id, max(soma_radius) AS soma_radius, max(greatest(0, sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2)) - soma_radius)) AS root_gap FROM pv JOIN ctr USING (neuron_id) WHERE px IS NULL GROUP BY 1),
 pf AS (SELECT neuron_id, CAST(0 AS BIGINT) AS n_non_finite, count(*) FILTER (r <= 1.01) AS n_bad_radius FROM points GROUP BY 1),
 fl AS (SELECT neuron_id, n_non_finite, n_bad_radius, coalesce(n_zero_length, 0) AS n_zero_length, coalesce(n_jumps, 0) AS n_jumps, soma_radius, root_gap FROM pf LEFT JOIN sf USING (neuron_id) LEFT JOIN rt USING (neuron_id))"""


def flags(spark, sf):
    p = points(spark, sf)
    s = G.segments(p, KEYS, ORDER)
    first = p.groupBy(*KEYS).agg(F.min_by(F.struct("x", "y", "z"), F.struct(*ORDER)).alias("f")).select("neuron_id", "f.*").join(centre(p), "neuron_id")
    d = F.sqrt(F.pow(F.col("x") - F.col("cx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("cy"), F.lit(2.0)) + F.pow(F.col("z") - F.col("cz"), F.lit(2.0)))
    roots = first.groupBy("neuron_id").agg(F.max("soma_radius").alias("soma_radius"), F.max(F.greatest(F.lit(0.0), d - F.col("soma_radius"))).alias("root_gap"))
    # radii start at 1 here, so the smallest step above 1 plays the part of a non-positive radius
    return G.trace_flags(p.withColumn("r", F.col("r") - 1.01), s, "neuron_id", roots)


@query("trace_qc_flags", f"WITH {FLAG_SQL} SELECT * FROM fl", dbl="soma_radius root_gap", d=5)
def _(spark, sf):
    return flags(spark, sf)


@query("trace_qc_status", f"""WITH {FLAG_SQL}, n AS (SELECT *, concat_ws(';', CASE WHEN n_non_finite > 0 THEN 'nonfinite_coordinates' END, CASE WHEN n_bad_radius > 0 THEN 'nonpositive_point_radius' END,
  CASE WHEN n_zero_length > 0 THEN 'zero_length_segment' END, CASE WHEN n_jumps > 0 THEN 'long_coordinate_jump' END, CASE WHEN root_gap > greatest(10, 2 * soma_radius) THEN 'neurite_root_far_from_soma' END) AS flags FROM fl)
SELECT neuron_id, flags, CASE WHEN n_non_finite > 0 THEN 'Unavailable_or_hard_fail' WHEN flags <> '' THEN 'Review' ELSE 'Pass' END AS status FROM n""")
def _(spark, sf):
    return G.trace_status(flags(spark, sf)).select("neuron_id", "flags", "status")

"""Point sequences: (neuron_id, section, order columns, x, y, z, r)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import cascade, is_finite
from ..runtime import cut
from . import order


def previous(points: DataFrame, keys, order_by, columns, span: str | None = None,
             rows_per_piece: int = order.ROWS_PER_BUCKET) -> DataFrame:
    """Adds prev_<column> of the preceding point of the sequence.

    The input is cut along the order before sorting, by day of a time column (or ``span``) or
    into value buckets otherwise; the last point of a piece is handed to the first of the next.
    """
    keys, order_by = list(keys), list(order_by)
    if span or dict(points.dtypes)[order_by[0]].startswith("timestamp"):
        p = points.withColumn("_span", F.expr(span) if span else F.to_date(order_by[0]))
    else:
        p = order._bucketed(points, order_by[0], rows_per_piece).withColumnRenamed("_bucket", "_span")
    last = p.groupBy(*keys, "_span").agg(F.max_by(F.struct(*columns), F.struct(*order_by)).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_span"))).drop("_last")
    w = Window.partitionBy(*keys, "_span").orderBy(*order_by)
    p = p.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns}).withColumn("_first", F.row_number().over(w) == 1)
    p = order.same_keys(p, carry, [*keys, "_span"])
    return p.withColumns({f"prev_{c}": F.when(F.col("_first"), F.col("_carry")[c]).otherwise(F.col(f"prev_{c}")) for c in columns}) \
        .drop("_span", "_first", "_carry")


def segments(points: DataFrame, keys, order_by, **kw) -> DataFrame:
    """One row per pair of consecutive points with its Euclidean length and both radii."""
    p = previous(points, keys, order_by, ["x", "y", "z", "r"], **kw).where(F.col("prev_x").isNotNull())
    sq = lambda c: (F.col(c) - F.col("prev_" + c)) * (F.col(c) - F.col("prev_" + c))
    return p.withColumn("length", F.sqrt(sq("x") + sq("y") + sq("z")))


def segment_lengths(seg: DataFrame, key: str) -> DataFrame:
    q = order.quantiles(seg, [key], "length", {"median": .5, "p99": .99})
    return seg.groupBy(key).agg(F.count("*").alias("n_segments"), F.sum("length").alias("total"), F.max("length").alias("max")).join(q, key)


def radius_stats(points: DataFrame, seg: DataFrame, key: str) -> DataFrame:
    pos = points.where("r > 0")
    q = order.quantiles(pos, [key], "r", {"q25": .25, "median": .5, "q75": .75})
    d = pos.select(key, F.round("r", 6).alias("rr")).distinct().groupBy(key).agg(F.count("*").alias("n_distinct"))
    m = pos.groupBy(key).agg(F.count("*").alias("n"), F.min("r").alias("min"), F.max("r").alias("max"))
    mid = (F.col("r") + F.col("prev_r")) / 2
    ok = (F.col("length") > 0) & (mid > 0)
    w = seg.groupBy(key).agg(F.try_divide(F.sum(F.when(ok, F.col("length") * mid)), F.sum(F.when(ok, F.col("length")))).alias("weighted_mean"))
    return m.join(q, key).join(d, key).join(w, key, "left")


def frustum(seg: DataFrame, key: str) -> DataFrame:
    """Lateral area and volume of the cone frustum of each segment, summed."""
    a, b, h = F.col("prev_r"), F.col("r"), F.col("length")
    area = F.pi() * (a + b) * F.sqrt(h * h + (a - b) * (a - b))
    vol = F.pi() * h / 3 * (a * a + a * b + b * b)
    s = seg.groupBy(key).agg(F.sum("length").alias("length"), F.sum(area).alias("area"), F.sum(vol).alias("volume"))
    return (s.withColumn("effective_radius", F.try_divide(2 * F.col("volume"), F.col("area")))
            .withColumn("area_per_length", F.try_divide(F.col("area"), F.col("length"))))


def extent(points: DataFrame, key: str, centre: DataFrame) -> DataFrame:
    """Bounding sizes and the largest distance from the given centre (columns cx, cy, cz)."""
    j = points.join(centre, key)
    d = F.sqrt(F.pow(F.col("x") - F.col("cx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("cy"), F.lit(2.0)) + F.pow(F.col("z") - F.col("cz"), F.lit(2.0)))
    span = lambda c: F.max(c) - F.min(c)
    return j.groupBy(key).agg(span("x").alias("width"), span("y").alias("height"), span("z").alias("depth"), F.max(d).alias("max_radial"))


def branch_order(nodes: DataFrame, node: str, parent: str, rounds: int = 40) -> DataFrame:
    """Depth of every node from its root by pointer doubling: log2(depth) joins, not depth joins.

    Lineage is cut every other round; a cycle is reported instead of looping.
    """
    jump = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.col(parent).isNotNull().cast("long").alias("depth"))
    for i in range(rounds):
        up = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        # finished nodes leave the join, so the NULL key never gathers rows
        live = jump.where("up IS NOT NULL").join(up, "up", "left").select(
            "node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"))
        jump = live.unionByName(jump.where("up IS NULL"))
        if i % 2:
            jump = cut(jump)
            if jump.where("up IS NOT NULL").isEmpty():
                return jump.select(F.col("node").alias(node), "depth")
    raise ValueError("parent links form a cycle")


def branch_counts(nodes: DataFrame, node: str, parent: str, group: str) -> DataFrame:
    kids = nodes.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(node)).agg(F.count("*").alias("kids"))
    j = nodes.join(kids, node, "left")
    return j.groupBy(group).agg(F.count("*").alias("n_sections"), F.count_if(F.col("kids") > 0).alias("n_bifurcations"),
                                F.count_if(F.col("kids").isNull()).alias("n_terminals"))


def trace_flags(points: DataFrame, seg: DataFrame, key: str, roots: DataFrame, floor=30.0, factor=10.0, zero=1e-9) -> DataFrame:
    """Counts of zero-length segments, jumps beyond max(floor, factor x median positive length),
    non-finite values and non-positive radii; ``roots`` brings the root gap."""
    med = order.quantiles(seg.where(F.col("length") > zero), [key], "length", {"median": .5})
    limit = F.coalesce(F.greatest(F.lit(floor), factor * F.col("median")), F.lit(floor))
    s = seg.join(med, key, "left").groupBy(key).agg(F.count_if(F.col("length") <= zero).alias("n_zero_length"),
                                                    F.count_if(F.col("length") > limit).alias("n_jumps"))
    bad = sum(((~is_finite(c)).cast("long") for c in ("x", "y", "z")), F.lit(0).cast("long"))
    p = points.groupBy(key).agg(F.sum(bad).alias("n_non_finite"), F.count_if(F.col("r") <= 0).alias("n_bad_radius"))
    return p.join(s, key, "left").join(roots, key, "left").na.fill(0, ["n_zero_length", "n_jumps"])


# Flag names and status names of the trace review.
HARD_FLAGS = {"nonfinite_coordinates": "n_non_finite > 0"}
REVIEW_FLAGS = {"nonpositive_point_radius": "n_bad_radius > 0", "zero_length_segment": "n_zero_length > 0",
                "long_coordinate_jump": "n_jumps > 0", "neurite_root_far_from_soma": "root_gap > greatest(10.0D, 2 * soma_radius)"}
STATUS_NAMES = ("Unavailable_or_hard_fail", "Review", "Pass")


def trace_status(flags: DataFrame) -> DataFrame:
    named = lambda rules: F.filter(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    hard, soft = named(HARD_FLAGS), named(REVIEW_FLAGS)
    return flags.withColumn("flags", F.array_join(F.concat(hard, soft), ";")).withColumn(
        "status", cascade([(F.size(hard) > 0, STATUS_NAMES[0]), (F.size(soft) > 0, STATUS_NAMES[1])], STATUS_NAMES[2]))

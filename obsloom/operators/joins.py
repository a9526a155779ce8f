"""Validated joins, source comparison and candidate matching."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _unique(df: DataFrame, key: str) -> DataFrame:
    """Rows as they are; a repeated key raises. The count shares the shuffle and sort of the join that follows."""
    n = F.count("*").over(Window.partitionBy(key))
    dup = F.raise_error(F.concat(F.lit("join key is not unique: "), F.col(key).cast("string"))).cast("boolean")
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, dup).otherwise(F.lit(True))).drop("_n")


def join_validated(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """One-to-one equi-join; a key that repeats on either side is an error."""
    return _unique(left, key).join(_unique(right, key), key, how)


def left_annotate(left: DataFrame, right: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join with a key that may occur once on the right; unmatched rows get defaults."""
    out = left.join(join_side(right, key), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def join_side(df: DataFrame, key: str) -> DataFrame:
    cols = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in cols])
    ok = F.when(F.col("_n") > 1, F.raise_error(F.lit("annotation key is not unique")).cast("boolean")).otherwise(F.lit(True))
    return g.where(ok).drop("_n")


def outer_indicator(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def table_crosscheck(a: DataFrame, b: DataFrame, key: str, features, rtol=1e-12, atol=1e-12) -> DataFrame:
    """Per feature: joint rows, differing NULL patterns, numeric mismatches, largest difference.

    Rows meet once by key; features are compared inside the joined row.
    """
    j = a.select(key, *[F.col(f).alias("a_" + f) for f in features]).join(b.select(key, *[F.col(f).alias("b_" + f) for f in features]), key)
    stats = []
    for f in features:
        va, vb = F.col("a_" + f), F.col("b_" + f)
        diff = F.abs(va - vb)
        stats.append(F.struct(F.lit(f).alias("feature"), F.count("*").alias("n_rows"), F.count_if(va.isNull() != vb.isNull()).alias("n_null_mismatch"),
                              F.count_if(diff > atol + rtol * F.abs(vb)).alias("n_value_mismatch"), F.max(diff).alias("max_abs_diff")))
    return j.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def set_relation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes of both id sets, their overlap, and the relation."""
    m = outer_indicator(a, b, key).agg(
        F.count_if(F.col("side") != "right_only").alias("n_a"), F.count_if(F.col("side") != "left_only").alias("n_b"),
        F.count_if(F.col("side") == "both").alias("n_both"))
    return m.withColumn("relation", F.when((F.col("n_a") == F.col("n_b")) & (F.col("n_a") == F.col("n_both")), "equal")
                        .when(F.col("n_both") == F.col("n_a"), "proper_subset")
                        .when(F.col("n_both") == F.col("n_b"), "proper_superset")
                        .when(F.col("n_both") == 0, "disjoint").otherwise("overlap"))


def source_presence(base: DataFrame, key: str, group: str, sources: dict) -> DataFrame:
    """Per group and source: rows present, mean number of filled columns, availability rate."""
    out = base.select(key, group)
    stacked = []
    for name, df in sources.items():
        cols = [c for c in df.columns if c != key]
        filled = sum((F.col(c).isNotNull().cast("long") for c in cols), F.lit(0).cast("long"))
        out = out.join(df.groupBy(key).agg(F.max(filled).alias(f"f_{name}")), key, "left")
        stacked.append(F.struct(F.lit(name).alias("source"), F.count(f"f_{name}").alias("n_present"),
                                F.sum(f"f_{name}").alias("n_filled"), F.count("*").alias("n")))
    g = out.groupBy(group).agg(F.array(*stacked).alias("s")).select(group, F.explode("s").alias("s")).select(group, "s.*")
    return g.withColumn("rate", F.col("n_present") / F.col("n"))


def hierarchical_match(targets: DataFrame, candidates: DataFrame, key: str, batch: str, secondary: str,
                       payload) -> DataFrame:
    """Narrow candidates by batch, then by secondary id, whenever that leaves any; report ambiguity.

    Candidates are reduced to one row per (target, tier) before anything is compared, so a
    key with very many candidates costs one partial aggregation.
    """
    payload = list(payload)
    c = candidates.select(F.col(key).alias("_ck"), F.col(batch).alias("_cb"), F.col(secondary).alias("_cs"),
                          F.struct(*payload).alias("p"))
    c = c.groupBy("_ck", "_cb", "_cs").agg(F.min("p").alias("p_min"), F.max("p").alias("p_max"))
    j = targets.join(c, targets[key] == c["_ck"], "left")
    same_batch = F.coalesce(F.col("_cb") == F.col(batch), F.lit(False))
    same_sec = F.coalesce(F.col("_cs") == F.col(secondary), F.lit(False))
    tier = F.when(F.col("_ck").isNull(), 0).when(same_batch & same_sec, 4).when(same_batch, 3).when(same_sec, 2).otherwise(1)
    ids = targets.columns
    best = (j.withColumn("tier", tier).groupBy(*ids, "tier")
            .agg(F.min("p_min").alias("p_min"), F.max("p_max").alias("p_max")))
    top = best.groupBy(*ids).agg(F.max_by(F.struct("tier", "p_min", "p_max"), "tier").alias("b")).select(*ids, "b.*")
    ambiguous = F.col("p_min") != F.col("p_max")
    status = F.when(F.col("tier") == 0, "unmatched").when(ambiguous, "ambiguous").otherwise("matched")
    return top.select(*ids, "tier", status.alias("status"),
                      *[F.when(status == "matched", F.col("p_min")[p]).alias(p) for p in payload])


def scored_best_match(targets: DataFrame, candidates: DataFrame, key: str, score: Column, name: str,
                      target_id: str, limits=(0.005, 0.02)) -> DataFrame:
    """Smallest score among candidates that share the key, name as tiebreak; tiered by score."""
    j = targets.join(candidates, key, "left").withColumn("score", score)
    best = j.groupBy(target_id).agg(F.min_by(F.struct(name, "score"), F.struct(
        F.coalesce(F.col("score"), F.lit(float("inf"))), F.col(name))).alias("b"))
    tier = (F.when(F.col("score").isNull(), "missing").when(F.col("score") <= limits[0], "exact")
            .when(F.col("score") <= limits[1], "close").otherwise("review"))
    return best.select(target_id, f"b.{name}", "b.score").withColumn("tier", tier)


def level_grid(spark, **levels) -> DataFrame:
    """Every combination of the given level lists (fixed sets, so a constant number of rows)."""
    df = spark.range(1)
    for name, values in levels.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df.drop("id")


def grid_counts(df: DataFrame, **levels) -> DataFrame:
    """Counts over the complete level grid; absent combinations give 0."""
    keys = list(levels)
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return level_grid(df.sparkSession, **levels).join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def lookup_map(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Adds the mapped label; the mapping may hold each label once."""
    return df.join(join_side(mapping, column), column, "left")


def topk(df: DataFrame, keys, order, k: int, out: str = "rn") -> DataFrame:
    """First k rows per key. Spark limits each task to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)

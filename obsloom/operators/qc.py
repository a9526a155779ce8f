"""Typing, predicates, exclusions and per-row reasons."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import all_of, cascade, is_finite, to_number


def conversion_failures(df: DataFrame, columns) -> DataFrame:
    """Per column: non-blank values, values that do not parse, and what to do with the column."""
    aggs = []
    for c in columns:
        filled = F.coalesce(F.trim(c) != "", F.lit(False))
        aggs.append(F.struct(F.lit(c).alias("column"), F.count_if(filled).alias("n_filled"),
                             F.count_if(filled & F.trim(c).try_cast("double").isNull()).alias("n_failed")))
    one = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return one.withColumn("decision", cascade([(F.col("n_failed") > 0, "drop_unparseable"),
                                               (F.col("n_filled") == 0, "drop_empty")], "keep"))


def coerce(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in columns})


def missing_tokens(df: DataFrame, columns, none_token="NR", gap_token="NaN") -> DataFrame:
    """Records without any value get ``none_token`` everywhere, others get ``gap_token`` in the gaps."""
    empty = reduce(lambda a, b: a & b, [F.coalesce(F.trim(c), F.lit("")) == "" for c in columns])
    return df.withColumns({c: F.when(empty, none_token)
                           .when(F.coalesce(F.trim(c), F.lit("")) == "", gap_token).otherwise(F.col(c))
                           for c in columns})


def complete_case(df: DataFrame, columns) -> DataFrame:
    return df.where(all_of([is_finite(c) for c in columns]))


def guarded_keys(df: DataFrame, key: str, what: str) -> DataFrame:
    """One row per key; a duplicated key raises while the plan runs, no extra job."""
    g = df.groupBy(key).agg(F.count("*").alias("_n"))
    return g.where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"duplicate key in {what}: "),
                                                                  F.col(key).cast("string"))).cast("boolean"))
                   .otherwise(F.lit(True))).drop("_n")


def exclusion_filter(df: DataFrame, excluded: DataFrame, key: str):
    """(kept rows, removed ids). The exclusion list may not repeat an id."""
    ids = guarded_keys(excluded, key, "exclusion list")
    return df.join(ids, key, "left_anti"), df.select(key).join(ids, key, "left_semi")


def assert_not_excluded(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Ids that should not be there; callers raise when this is not empty."""
    return df.select(key).join(excluded.select(key).distinct(), key, "left_semi").distinct()


def require_empty(df: DataFrame, message: str) -> None:
    bad = df.limit(3).collect()
    if bad:
        raise ValueError(f"{message}: {[tuple(r) for r in bad]}")


def transition(before: DataFrame, quarantine: DataFrame, key: str) -> DataFrame:
    """Status before and after a reversible quarantine list; of several reasons for a key the first by name holds."""
    q = quarantine.groupBy(key).agg(F.min("reason").alias("reason"))
    hit = F.col("reason").isNotNull()
    return (before.select(key, F.col("status").alias("previous_status")).join(q, key, "left")
            .withColumn("quarantined", hit)
            .withColumn("current_status", F.when(hit & (F.col("previous_status") == "included"), "quarantined")
                        .otherwise(F.col("previous_status")))
            .withColumn("reversible", hit & (F.col("previous_status") == "included")))


def class_map(text: Column, rules, unresolved: str | None = "unresolved") -> Column:
    """Ordered regex rules on lower-cased text."""
    return cascade([(F.lower(text).rlike(p), v) for p, v in rules], unresolved)


def family_of(name: Column, rules, default="other") -> Column:
    return cascade([(F.contains(F.lower(name), F.lit(s)), fam) for s, fam in rules], default)


def logical_range(long: DataFrame, family: Column) -> DataFrame:
    """Counts values outside the domain of their family (unit interval, >=0, whole number)."""
    v = F.col("value")
    bad = cascade([(family == "fraction", (v < 0) | (v > 1)), (family == "count", (v < 0) | (v != F.floor(v))),
                   (family == "size", v < 0)], False)
    return (long.where(v.isNotNull()).groupBy("feature").agg(
        F.first(family).alias("family"), F.count("*").alias("n"), F.count_if(bad).alias("n_violations")))


def availability(n_observed: Column, n_total: Column) -> Column:
    return cascade([(n_observed == 0, "all_missing"), (n_observed == n_total, "complete")], "partial")


def exclusion_manifest(sources) -> DataFrame:
    """``sources``: ordered (stage, DataFrame(id, reason)). One row per id with primary and all reasons."""
    parts = [df.select("id", F.lit(i).alias("precedence"), F.lit(stage).alias("stage"), "reason")
             for i, (stage, df) in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, parts).groupBy("id", "precedence", "stage").agg(F.min("reason").alias("reason"))
    return rows.groupBy("id").agg(
        F.min_by("stage", "precedence").alias("stage"), F.min_by("reason", "precedence").alias("primary_reason"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("precedence", "reason"))),
                                 lambda s: s["reason"]), "; ").alias("all_reasons"),
        F.count("*").alias("n_reasons"))

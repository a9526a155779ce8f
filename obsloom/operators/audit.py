"""Reproducibility audits: table differences, ledgers, key checks, text scans."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

# Patterns of the text scan.
TEXT_PATTERNS = {
    "absolute_path": r"(?i)(?:[A-Z]:[\\/](?:Users|Documents and Settings)[\\/]|OneDrive[\\/])",
    "github_token": r"(?:ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})",
    "openai_key": r"sk-[A-Za-z0-9_-]{20,}",
    "declared_secret": r"(?i)(?:api[_-]?key|password|access[_-]?token)\s*[:=]\s*['\"][^'\"]{8,}",
}
# Sizes in MiB above which a file is listed.
SIZE_LIMITS = (25, 50)


def table_diff(a: DataFrame, b: DataFrame, key: str, numeric, text=(), tol: float = 1e-10) -> DataFrame:
    """Per column: rows on one side only, NULL pattern differences, largest numeric or count of text differences.

    One key join; columns are compared inside the joined row.
    """
    l = a.select(key, *[F.col(c).alias("a_" + c) for c in [*numeric, *text]], F.lit(True).alias("_l"))
    r = b.select(key, *[F.col(c).alias("b_" + c) for c in [*numeric, *text]], F.lit(True).alias("_r"))
    j = l.join(r, key, "full_outer")
    both = F.col("_l") & F.col("_r")
    stats = []
    for c in [*numeric, *text]:
        x, y = F.col("a_" + c), F.col("b_" + c)
        nulls = F.count_if(F.coalesce(both, F.lit(False)) & (x.isNull() != y.isNull()))
        if c in numeric:
            worst, n_bad = F.max(F.abs(x - y)), F.count_if(F.abs(x - y) > tol)
        else:
            worst, n_bad = F.lit(None).cast("double"), F.count_if(x != y)
        stats.append(F.struct(F.lit(c).alias("column"), nulls.alias("n_null_mismatch"), n_bad.alias("n_different"), worst.alias("max_abs_diff")))
    one = j.agg(F.count_if(F.col("_r").isNull()).alias("only_a"), F.count_if(F.col("_l").isNull()).alias("only_b"), F.array(*stats).alias("s"))
    out = one.select("only_a", "only_b", F.explode("s").alias("s")).select("only_a", "only_b", "s.*")
    ok = (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("n_null_mismatch") == 0) & (F.col("n_different") == 0)
    return out.withColumn("equal", ok)


def ledger(items) -> DataFrame:
    """Rows (item, observed, expected, status) from one-row frames with an ``observed`` column."""
    rows = [df.select(F.lit(name).alias("item"), F.col("observed").cast("double").alias("observed"), F.lit(float(want)).alias("expected"))
            for name, df, want in items]
    out = reduce(DataFrame.unionByName, rows)
    return out.withColumn("status", F.when(F.col("observed") == F.col("expected"), "PASS").otherwise("FAIL"))


def unique_key_check(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, blank keys, keys that repeat and rows they hold."""
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    g = df.groupBy(F.when(~blank, F.col(key)).alias("k")).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("n_rows"), F.count("k").alias("n_keys"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("n_blank"),
                 F.count_if(F.col("k").isNotNull() & (F.col("n") > 1)).alias("n_repeated"),
                 F.coalesce(F.sum(F.when(F.col("k").isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("n_in_repeats"))


def frozen_counts(df: DataFrame, label: str, expected: DataFrame) -> DataFrame:
    """Observed class counts against the configured ones, both directions."""
    got = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("observed"))
    j = got.join(expected, "label", "full_outer").na.fill(0, ["observed", "expected"])
    return j.withColumn("ok", F.col("observed") == F.col("expected"))


def text_scan(texts: DataFrame, id_col: str, text: str, patterns: dict = TEXT_PATTERNS) -> DataFrame:
    """(id, line, pattern) for every line that matches; whole texts, one pass for all patterns."""
    lines = texts.select(id_col, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("_p", "_line"))
    hits = F.filter(F.array(*[F.when(F.col("_line").rlike(p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())
    return lines.select(id_col, (F.col("_p") + 1).cast("long").alias("line"), F.explode(hits).alias("pattern"))


def large_files(inventory: DataFrame, limits=SIZE_LIMITS) -> DataFrame:
    return inventory.select("path", "bytes", *[(F.col("bytes") > m * 1024 * 1024).alias(f"over_{m}") for m in limits]).where(F.col(f"over_{limits[0]}"))


def manifest_verify(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Recomputed size and digest against the manifest: ok, changed, missing or unlisted."""
    i = inventory.select("path", F.col("bytes").alias("b"), F.lower("sha256").alias("s"))
    m = manifest.select("path", F.col("bytes").alias("b0"), F.lower("sha256").alias("s0"))
    return i.join(m, "path", "full_outer").select("path", F.when(F.col("s").isNull(), "missing").when(F.col("s0").isNull(), "unlisted")
                                                  .when((F.col("b") == F.col("b0")) & (F.col("s") == F.col("s0")), "ok").otherwise("changed").alias("status"))

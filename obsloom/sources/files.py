"""Scans and sinks. Schemas are given, never inferred; NaN becomes NULL at the boundary."""
from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.scalar import nan_to_null

BOM = "\ufeff"
# No text field holds this character, so the reader never turns a token into NULL.
_UNUSED = "\u0001"


def scan_csv(spark: SparkSession, path: str, schema: str, columns=None) -> DataFrame:
    """Header CSV, UTF-8 with or without byte order mark; only ``columns`` are parsed."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    df = df.select(*columns) if columns else df
    return df.select(*[nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else F.col(f.name) for f in df.schema])


def scan_tsv_verbatim(spark: SparkSession, path: str, columns) -> DataFrame:
    """Tab-separated text; every field is kept as written, the empty string included."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = (spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "")
          .option("nullValue", _UNUSED).option("emptyValue", "").csv(path))
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


ENVELOPE = "analysis_headers array<string>, analysis_rows array<array<string>>"


def open_envelope(envelopes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Header array plus row arrays to typed columns; the header decides the position."""
    rows = envelopes.select("analysis_headers", F.explode("analysis_rows").alias("row"))
    named = rows.select(F.map_from_arrays("analysis_headers", "row").alias("m"))
    return named.select(*[F.col("m")[c].try_cast(t).alias(c) for c, t in columns.items()])


def scan_json_envelope(spark: SparkSession, path: str, columns: dict[str, str], multiline=True) -> DataFrame:
    return open_envelope(spark.read.schema(ENVELOPE).option("multiLine", multiline).json(path), columns)


def scan_json_records(spark: SparkSession, path: str, schema: str, required=(), multiline=True) -> DataFrame:
    """Records array; a record without a required field raises when it is read."""
    df = spark.read.schema(schema).option("multiLine", multiline).json(path)
    out = []
    for c in df.columns:
        guard = F.raise_error(F.lit(f"required field missing: {c}"))
        out.append((F.when(F.col(c).isNull(), guard).otherwise(F.col(c)) if c in required else F.col(c)).alias(c))
    return df.select(*out)


def select_counts(counts: DataFrame, ids: DataFrame, key: str = "obs_id") -> DataFrame:
    """Triplets of the requested observations only."""
    return counts.join(ids.select(key).distinct(), key, "left_semi")


def missing_ids(counts: DataFrame, ids: DataFrame, key: str = "obs_id") -> DataFrame:
    return ids.select(key).distinct().join(counts.select(key), key, "left_anti")


def zip_members(archives: DataFrame, schema: str, pattern: str = ".csv") -> DataFrame:
    """``archives`` has ``path`` and ``content``; one archive is opened at a time inside a task."""
    spark_schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in spark_schema]
    text = ", ".join(["archive string", "member string"] + [f"`{n}` string" for n in names])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if pattern in name:
                            with z.open(name) as fh:
                                for part in pd.read_csv(fh, dtype=str, keep_default_na=False, usecols=names,
                                                        encoding="utf-8-sig", chunksize=50_000):
                                    yield part[names].assign(archive=path, member=name)[["archive", "member", *names]]

    rows = archives.select("path", "content").mapInPandas(read, text)
    return rows.select("archive", "member", *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in spark_schema])


def scan_zip_members(spark, path, schema, pattern=".csv", sha256=None) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    if sha256:
        files = files.withColumn("content", F.when(F.sha2("content", 256).isin(*sha256), F.col("content"))
                                 .otherwise(F.raise_error(F.lit("archive hash mismatch"))))
    return zip_members(files, schema, pattern)


def file_inventory(spark: SparkSession, path: str, key_pattern: str = "", glob: str = "*") -> DataFrame:
    """Name, size, time, derived key and digest of every file below ``path``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).load(path))
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"), F.year("modificationTime").alias("year"),
        F.regexp_extract("path", key_pattern, 1).alias("key") if key_pattern else F.lit("").alias("key"),
        F.sha2("content", 256).alias("sha256"))


def id_list_scan(spark: SparkSession, path: str, column: str = "id") -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias(column))
    ids = lines.where((F.col(column) != "") & ~F.col(column).startswith("#")).distinct()
    if ids.isEmpty():
        raise ValueError(f"id list is empty: {path}")
    return ids


def sink_csv(df: DataFrame, path: str, float_format: str | None = None, bom: bool = False) -> None:
    """One file per partition; text is formatted before writing, header in every file."""
    cols = []
    for i, f in enumerate(df.schema):
        c = F.col(f.name)
        if float_format and isinstance(f.dataType, T.DoubleType):
            c = F.format_string(float_format, c)
        cols.append(c.alias((BOM if bom and i == 0 else "") + f.name))
    df.select(*cols).write.option("header", True).csv(path)


def sink_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def sink_parquet(df: DataFrame, path: str, partition_by=()) -> None:
    df.write.partitionBy(*partition_by).parquet(path)

"""Parquet tables: required reads, sorted writes, keyed replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweft.errors import DataError, MissingTableError
from cellweft.operators.keys import upsert
from cellweft.session import scratch_path


def require_table(spark: SparkSession, path: str, label: str, columns: Sequence[str] = ()) -> DataFrame:
    """Read a Parquet table that must exist, be readable, hold rows and have ``columns``."""
    try:
        df = spark.read.parquet(path)
        empty = df.isEmpty()
    except (AnalysisException, PySparkException) as error:
        raise MissingTableError(f"{label} cannot be read") from error
    if empty:
        raise MissingTableError(f"{label} is empty")
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise DataError(f"{label} is missing columns: {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null once, at the scan, so that max, sum and median skip it."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating}) if floating else df


def write_table(df: DataFrame, path: str, order: Sequence[str] = (), partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> str:
    """Write Parquet. With ``order`` the files hold ranges of it and are sorted inside.

    Range-partitioned files give narrow row-group statistics, so later range filters skip files.
    """
    if order:
        df = df.repartitionByRange(*partition_by, *order).sortWithinPartitions(*partition_by, *order)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def upsert_table(spark: SparkSession, base_path: str, new: DataFrame, keys: Sequence[str],
                 order: Sequence[str] = (), out_path: str | None = None) -> str:
    """Write the upsert of ``new`` over a stored table to a new path and return that path.

    Plain Parquet has no in-place merge, so readers keep the old version until they switch.
    """
    merged = upsert(spark.read.parquet(base_path), new, keys, order)
    return write_table(merged, out_path or scratch_path(spark, "upsert"))


PART = "key_part"


def write_keyed(df: DataFrame, path: str, part: str) -> str:
    """Write a table in folders by ``part``, a SQL expression over key columns, so that later merges touch few of them."""
    return write_table(df.withColumn(PART, F.expr(part)).repartition(PART), path, partition_by=[PART])


def merge_keyed(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], part: str, order: Sequence[str] = ()) -> int:
    """Upsert ``new`` into a table of ``write_keyed``; only folders that hold a key of ``new`` are read and rewritten.

    ``part`` must be the expression the table was written with, over key columns alone: a key then always lies in one
    folder. The merged folders are written aside first, then swapped in by one dynamic partition overwrite, so a
    lost executor or a failed job leaves the table as it was. A null part is an error. Returns the number of folders.
    """
    unknown = [c for c in new.columns if c == PART]
    if unknown:
        raise DataError(f"new rows must not have a column {PART}")
    placed = new.withColumn(PART, F.expr(part))
    # One row per folder of the table; the scan skips all other folders.
    touched = placed.select(PART).distinct()
    held = spark.read.parquet(path)
    base = held.join(touched, PART, "left_semi").select(*held.columns)
    stop = F.raise_error(F.lit("a key has no part")).cast(placed.schema[PART].dataType)
    placed = placed.withColumn(PART, F.coalesce(PART, stop))
    merged = write_table(upsert(base, placed, keys, order), scratch_path(spark, "merge"))
    rows = spark.read.parquet(merged)
    rows.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    return rows.select(PART).distinct().count()

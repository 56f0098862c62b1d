"""Landed hourly station CSV files and the months they should cover."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.constants import HOURLY_COLUMNS, HOURLY_NUMERIC, HOURLY_REQUIRED, OBSERVATION_COLUMNS
from cellweft.errors import DataError
from cellweft.functions.text import parse_local_time, to_number
from cellweft.operators.keys import first_per_key

_ARRIVAL = ("_file", "_block", "_row")


def check_station_id(station_id: str) -> str:
    """The station id without blanks; only ASCII digits are accepted."""
    trimmed = station_id.strip()
    if not re.fullmatch(r"[0-9]+", trimmed):
        raise DataError("station_id must contain ASCII digits only")
    return trimmed


def header_files(spark: SparkSession, path: str | Sequence[str]) -> list[list[str]]:
    """Files grouped by their header line, when there are several headers; [] when all share one."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value",
    ).filter("block = 0")
    first = lines.groupBy("file").agg(F.min_by("value", "row").alias("header"))
    header = F.regexp_replace("header", r"^\x{FEFF}|\s+$", "")
    kinds = first.withColumn("header", header)
    if kinds.select("header").distinct().limit(2).count() < 2:
        return []
    groups = kinds.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [[unquote(file) for file in row["files"]] for row in groups]


def read_hourly(spark: SparkSession, path: str | Sequence[str], station_id: str | None = None) -> DataFrame:
    """Read CSV files, columns matched by name; the station is ``station_id`` or a ``station_id=`` folder.

    Files are read in one scan per distinct header line, so the order of columns and the
    optional columns may differ between files. Every field is read as text. Arrival order is
    kept in the ``_file``, ``_block`` and ``_row`` columns for the keep-first step.
    """
    whole: str | list[str] = path if isinstance(path, str) else list(path)
    parts = [_read_one_header(spark, files, station_id) for files in header_files(spark, whole) or [whole]]
    return reduce(DataFrame.unionByName, parts)


def _read_one_header(spark: SparkSession, files: str | list[str], station_id: str | None) -> DataFrame:
    raw = spark.read.option("header", True).option("enforceSchema", False).option("encoding", "UTF-8").csv(files)
    raw = raw.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    if station_id is None and "station_id" not in raw.columns:
        folder = F.regexp_extract("_file", r"/station_id=([^/]+)/", 1)
        raw = raw.withColumn("station_id", F.nullif(folder, F.lit("")))
    return normalize_hourly(raw, station_id)


def normalize_hourly(raw: DataFrame, station_id: str | None = None) -> DataFrame:
    """Fixed columns and types; absent optional columns are null, rows without a time drop out."""
    missing = sorted(set(HOURLY_REQUIRED) - set(raw.columns))
    if missing:
        raise DataError(f"hourly file is missing required columns: {', '.join(missing)}")
    if station_id is None and "station_id" not in raw.columns:
        raise DataError("a station_id or a station_id partition folder is needed")
    station = F.lit(check_station_id(station_id)) if station_id is not None else F.col("station_id").cast("string")
    found = {ours: F.col(f"`{theirs}`") for theirs, ours in HOURLY_COLUMNS.items() if theirs in raw.columns}
    columns = []
    for name in OBSERVATION_COLUMNS:
        if name == "station_id":
            column = station
        elif name not in found:
            column = F.lit(None).cast("double" if name in HOURLY_NUMERIC else "string")
        elif name == "timestamp":
            column = parse_local_time(found[name])
        else:
            column = to_number(found[name]) if name in HOURLY_NUMERIC else found[name]
        columns.append(column.alias(name))
    kept = [c for c in _ARRIVAL if c in raw.columns]
    return raw.select(*columns, *kept).filter(F.col("timestamp").isNotNull())


def combine_hourly(*parts: DataFrame) -> DataFrame:
    """Bag union of the parts; the first row to arrive per station and time stays.

    Parts arrive in argument order, then by file, place in the file and row.
    """
    numbered = []
    for i, part in enumerate(parts):
        for name, kind in zip(_ARRIVAL, ("string", "bigint", "bigint"), strict=True):
            if name not in part.columns:
                part = part.withColumn(name, F.lit(None).cast(kind))
        numbered.append(part.withColumn("_part", F.lit(i)))
    union = numbered[0]
    for part in numbered[1:]:
        union = union.unionByName(part)
    # Rows that arrive nowhere in particular are told apart by their own values.
    rest = [c for c in OBSERVATION_COLUMNS if c in union.columns and c not in {"station_id", "timestamp"}]
    kept = first_per_key(union, ["station_id", "timestamp"], ["_part", *_ARRIVAL, *rest])
    return kept.drop("_part", *_ARRIVAL)


def month_periods(ranges: DataFrame, start: str = "start_date", end: str = "end_date", check: bool = True) -> DataFrame:
    """One row per range and calendar month from the start month to the end month."""
    if check and not ranges.filter(F.col(end) < F.col(start)).isEmpty():
        raise DataError("end date must be on or after start date")
    first, last = F.trunc(start, "MM"), F.trunc(end, "MM")
    month = F.explode(F.sequence(first, last, F.expr("interval 1 month")))
    return ranges.select(*ranges.columns, month.alias("month"))


def missing_months(expected: DataFrame, observed: DataFrame, station: str = "station_id",
                   ts: str = "timestamp") -> DataFrame:
    """Expected (station, month) rows without any observation; months reduce before the join."""
    present = observed.select(station, F.trunc(F.col(ts), "MM").alias("month")).distinct()
    return expected.select(station, "month").join(present, [station, "month"], "left_anti")


def require_complete(expected: DataFrame, observed: DataFrame, allow_partial: bool = False, **names) -> DataFrame:
    """The observations, once no expected month is missing or partial data are allowed."""
    if not allow_partial:
        lost = missing_months(expected, observed, **names).count()
        if lost:
            raise DataError(f"weather data are incomplete: {lost} requested month(s) are missing")
    return observed

"""From landed feature rows to privacy-safe events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.constants import DEFAULT_RESOLUTION, EVENT_COLUMNS, EXTENT
from cellweft.errors import DataError
from cellweft.functions.text import is_target_request, normalize_text, parse_variant_time
from cellweft.operators.keys import first_per_key
from cellweft.operators.lattice import with_cell
from cellweft.operators.ranked import first_n

ARRIVAL = ("arrival_page", "arrival_file", "arrival_position")


def in_extent(lon: Column, lat: Column, extent: tuple[float, float, float, float] = EXTENT) -> Column:
    west, south, east, north = extent
    return F.coalesce(lon.between(west, east) & lat.between(south, north), F.lit(False))


def date_range(column: str, start: str | None = None, end: str | None = None) -> Column:
    """Days ``start`` to ``end`` inclusive, as a half-open typed range the scan can use."""
    try:
        first = date.fromisoformat(start) if start else None
        last = date.fromisoformat(end) if end else None
    except ValueError as error:
        raise DataError("dates must use YYYY-MM-DD format") from error
    if first and last and last < first:
        raise DataError("end date must be on or after start date")
    test = F.lit(True)
    if first:
        test = test & (F.col(column) >= F.lit(first))
    if last:
        test = test & (F.col(column) < F.date_add(F.lit(last), 1))
    return test


def judge_features(features: DataFrame) -> DataFrame:
    """Matching features with typed values and the first reason to refuse them, if any.

    ``features`` has objectid and createddate as variants, reqtype, req_type, request_type,
    category as text, x and y as text, has_geometry, and the arrival columns. Features of
    another type are left out without a reason.
    """
    matched = features.filter(is_target_request(F.col("reqtype"), F.col("req_type"), F.col("request_type")))
    typed = matched.select(
        F.try_variant_get("objectid", "$", "bigint").alias("objectid"),
        normalize_text(F.col("reqtype")).alias("reqtype"),
        normalize_text(F.col("category")).alias("category"),
        parse_variant_time(F.col("createddate")).alias("createddate"),
        F.col("x").try_cast("double").alias("lon"),
        F.col("y").try_cast("double").alias("lat"),
        (F.col("objectid").isNull() | F.is_variant_null("objectid")).alias("_no_id"),
        "has_geometry",
        *ARRIVAL,
    )
    reason = (
        F.when(F.col("_no_id"), "missing objectid")
        .when(~F.col("has_geometry"), "no point geometry")
        .when(F.col("lon").isNull() | F.col("lat").isNull(), "invalid coordinates")
        .when(~in_extent(F.col("lon"), F.col("lat")), "outside the extent")
        .when(F.col("objectid").isNull(), "invalid objectid")
        .when(F.col("createddate").isNull(), "invalid createddate")
    )
    return typed.withColumn("reject_reason", reason).drop("_no_id", "has_geometry")


def accepted_events(judged: DataFrame, resolution: int = DEFAULT_RESOLUTION) -> DataFrame:
    """First accepted row per objectid, reduced to the stored columns."""
    if not 1 <= resolution <= 15:
        raise ValueError("resolution must be between 1 and 15")
    accepted = judged.filter(F.col("reject_reason").isNull())
    placed = with_cell(accepted, "lon", "lat", resolution).select(*EVENT_COLUMNS, *ARRIVAL)
    return first_per_key(placed, ["objectid"], ARRIVAL).select(*EVENT_COLUMNS)


def reject_report(judged: DataFrame) -> DataFrame:
    """Rows per reason; accepted rows have the reason 'accepted'."""
    reason = F.coalesce(F.col("reject_reason"), F.lit("accepted")).alias("reason")
    return judged.groupBy(reason).agg(F.count("*").alias("rows"))


def minimize_events(features: DataFrame, resolution: int = DEFAULT_RESOLUTION) -> DataFrame:
    """Features to stored events; refused and non-matching rows are gone."""
    return accepted_events(judge_features(features), resolution)


def cap_records(df: DataFrame, limit: int, order: tuple[str, ...] = ("createddate", "objectid")) -> DataFrame:
    """The first ``limit`` source records in source order."""
    if limit < 1:
        raise ValueError("the record limit is at least 1")
    return first_n(df, limit, order)

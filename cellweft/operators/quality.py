"""Checks that count: one row out, and an error only when asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.constants import WEATHER_REQUIRED
from cellweft.errors import DataError
from cellweft.functions.display import is_probability



def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: total rows and, per rule, the rows that break it."""
    return df.agg(
        F.count("*").alias("row_count"),
        *[F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in rules.items()],
    )


def extra_copies(df: DataFrame, keys: Sequence[str], name: str = "duplicate_keys") -> DataFrame:
    """One row: rows beyond the first of their key, counted after a map-side reduce."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(name))


def require_columns(df: DataFrame, columns: Sequence[str], label: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise DataError(f"{label} is missing required columns: {', '.join(missing)}")


def weather_rules(ts: str = "timestamp", station: str = "station_id") -> dict[str, Column]:
    """Row rules of hourly observations; each column is true where a row breaks the rule."""
    return {
        "missing_timestamp": F.col(ts).isNull(),
        "bad_station_id": ~F.coalesce(F.trim(station).rlike("^[0-9]+$"), F.lit(False)),
        "humidity_out_of_range": ~F.col("relative_humidity").between(0, 100),
        "negative_precip": F.col("precip_mm") < 0,
    }


def weather_report(df: DataFrame, rules: dict[str, Column] | None = None,
                   keys: Sequence[str] = ("station_id", "timestamp")) -> DataFrame:
    """Violation counts of hourly observations in one row, duplicate times included."""
    require_columns(df, WEATHER_REQUIRED, "weather data")
    counted = violation_counts(df, weather_rules() if rules is None else rules)
    copies = extra_copies(df, keys, "duplicate_timestamps")
    return counted.withColumn("duplicate_timestamps", copies.scalar())


def require_clean(report: DataFrame, label: str) -> None:
    """Raise when any count of a one-row report, other than the row count, is not 0."""
    row = report.first().asDict()
    broken = {name: n for name, n in row.items() if name != "row_count" and n}
    if broken:
        raise DataError(f"{label} breaks rules: " + ", ".join(f"{k}={v}" for k, v in sorted(broken.items())))
    if row.get("row_count") == 0:
        raise DataError(f"{label} is empty")


def check_observations(df: DataFrame) -> DataFrame:
    """The observations themselves, once they are known to be clean.

    Station ids are checked where files are read, so other station names may pass here.
    """
    rules = {k: v for k, v in weather_rules().items() if k != "bad_station_id"}
    require_clean(weather_report(df, rules), "weather data")
    return df


def check_scores(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """The scored rows, once every score is a finite number in 0..1."""
    require_clean(violation_counts(df, {"invalid_score": ~is_probability(F.col(score))}).drop("row_count"), "scores")
    return df


def contract_audit(df: DataFrame, not_null: Sequence[str], checks: dict[str, Column],
                   key: Sequence[str]) -> DataFrame:
    """One row of counts for NOT NULL, CHECK and key rules; a null passes a CHECK, as in SQL."""
    rules = {f"null_{c}": F.col(c).isNull() for c in not_null}
    rules.update({f"check_{name}": ~ok for name, ok in checks.items()})
    return violation_counts(df, rules).withColumn("duplicate_keys", extra_copies(df, key).scalar())


EVENT_CONTRACT = {
    "not_null": ("objectid", "reqtype", "category", "createddate", "cell_id"),
    "key": ("objectid",),
}
GRID_CONTRACT = {
    "not_null": ("cell_id", "resolution", "centroid_lat", "centroid_lon", "geometry"),
    "key": ("cell_id",),
}
CELL_CONTRACT = {
    "not_null": (
        "cell_id", "centroid_lat", "centroid_lon", "line_length_km_water", "line_count_water",
        "line_length_km_road", "line_count_road", "building_count", "median_year_built", "pct_pre_1980",
    ),
    "key": ("cell_id",),
}
PREDICTION_CONTRACT = {
    "not_null": ("cell_id", "risk_score", "generated_at", "model_version", "target_mode"),
    "key": ("cell_id",),
}


def audit_events(df: DataFrame) -> DataFrame:
    checks = {f"{c}_length": F.length(c) <= n for c, n in (("reqtype", 100), ("category", 100), ("cell_id", 20))}
    return contract_audit(df, checks=checks, **EVENT_CONTRACT)


def audit_grid(df: DataFrame) -> DataFrame:
    checks = {
        "resolution": F.col("resolution").between(0, 15),
        "centroid_lat": F.col("centroid_lat").between(-90, 90),
        "centroid_lon": F.col("centroid_lon").between(-180, 180),
    }
    return contract_audit(df, checks=checks, **GRID_CONTRACT)


def audit_cells(df: DataFrame) -> DataFrame:
    counted = ("line_length_km_water", "line_count_water", "line_length_km_road", "line_count_road", "building_count")
    checks = {c: F.col(c) >= 0 for c in counted}
    checks["pct_pre_1980"] = F.col("pct_pre_1980").between(0, 1)
    return contract_audit(df, checks=checks, **CELL_CONTRACT)


def audit_predictions(df: DataFrame) -> DataFrame:
    checks = {
        "risk_score": is_probability(F.col("risk_score")),
        "target_mode": F.col("target_mode").isin("synthetic", "observed"),
    }
    return contract_audit(df, checks=checks, **PREDICTION_CONTRACT)


def orphan_keys(df: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Keys without a parent row, with their row counts; keys are reduced before the join."""
    parent_key = parent_key or key
    used = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    known = parent.select(F.col(parent_key).alias(key))
    return used.join(known, key, "left_anti")


def delete_orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose parent still exists (what a cascading delete leaves)."""
    lost = orphan_keys(df, parent, key, parent_key)
    return df.join(lost, key, "left_anti")

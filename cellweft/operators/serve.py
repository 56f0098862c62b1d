"""Answers for whole tables of map, cell and what-if requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweft.constants import (
    AGGREGATE_FEATURE_COLUMNS,
    HIGH_RISK,
    MAX_BBOX_SPAN,
    MAX_MAP_FEATURES,
    PREDICTION_HORIZON_HOURS,
    SOURCE_MODES,
)
from cellweft.functions.display import bbox_problem, risk_band, round_binary, round_half_even
from cellweft.functions.weather import heat_index_c
from cellweft.operators.joins import MIN_HOT_ROWS, box_join
from cellweft.operators.lattice import CELL_BIN_DEGREES
from cellweft.operators.rings import meets_box, ring_edges, spans_ring, usable_rings

BOX = ("west", "south", "east", "north")


def request_problem(limit: str | None = "max_features") -> Column:
    """Reason a map request is refused; null when it is fine."""
    problem = bbox_problem(*[F.col(c) for c in BOX])
    if limit is None:
        return problem
    bad_limit = ~F.coalesce(F.col(limit).between(1, MAX_MAP_FEATURES), F.lit(False))
    return F.coalesce(problem, F.when(bad_limit, "max_features is outside its range"))


def scenario_problem(temperature: str = "sim_temperature_c", humidity: str = "sim_relative_humidity",
                     dry_days: str = "sim_dry_days") -> Column:
    """Reason a what-if value is refused; null when all given values are in range."""
    limits = ((temperature, -50, 60), (humidity, 0, 100), (dry_days, 0, 365))
    return F.coalesce(*[
        F.when(~F.coalesce(F.col(c).between(low, high), F.lit(True)), f"{c} is outside its range") for c, low, high in limits
    ])


def bbox_cells(requests: DataFrame, grid: DataFrame, bin_size: float = CELL_BIN_DEGREES,
               min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Accepted requests with every grid cell whose ring, of any shape, meets their box.

    Refused requests go first: that bounds the span of a box, and with it the number of
    bins a request is spread over and the number of cells it can get.
    """
    accepted = requests.filter(bbox_problem(*[F.col(c) for c in BOX]).isNull())
    cells = usable_rings(grid).select("cell_id", "geometry", ring_edges("geometry").alias("_edges"),
                                      "lon_min", "lat_min", "lon_max", "lat_max")
    sides = {f"_ring_{end}": fn(F.col(f"geometry.{c}")) for c, ends in (("lon", ("west", "east")), ("lat", ("south", "north")))
             for end, fn in zip(ends, (F.array_min, F.array_max))}
    near = box_join(accepted, cells.withColumns(sides), BOX, ("lon_min", "lat_min", "lon_max", "lat_max"), bin_size, min_rows,
                    left_span=MAX_BBOX_SPAN)
    met = spans_ring(BOX, tuple(sides)) | meets_box("_edges", BOX)
    return near.filter(met).select(*requests.columns, "cell_id", "geometry")


def first_cells(selected: DataFrame, limit: str = "max_features", request: str = "request_id",
                maximum: int = MAX_MAP_FEATURES) -> DataFrame:
    """The first ``limit`` cells of each request by id, with a truncated flag; a limit above ``maximum`` is an error.

    Rank ``maximum + 1`` is enough to know whether a request is cut, so no more rows of a request are shuffled or held.
    """
    group = Window.partitionBy(request)
    told = f"a limit is above the maximum of {maximum}"
    checked = selected.withColumn(limit, F.when(F.col(limit) > maximum, F.raise_error(F.lit(told)).cast("int")).otherwise(F.col(limit)))
    ranked = checked.withColumn("_rank", F.row_number().over(group.orderBy("cell_id"))).filter(F.col("_rank") <= maximum + 1)
    cut = ranked.withColumn("truncated", F.max("_rank").over(group) > F.col(limit))
    return cut.filter(F.col("_rank") <= F.col(limit)).drop("_rank")


def with_weather(cells: DataFrame, latest: DataFrame, station: str = "station_id") -> DataFrame:
    """The latest weather row of its station on every cell; weather wins a name clash.

    Cells of a station without weather stay, with nulls. There is one weather row per station, so Spark broadcasts it while it is small; above
    that its adaptive skew join splits a station with very many cells.
    """
    kept = [c for c in cells.columns if c == station or c not in latest.columns]
    return cells.select(*kept).join(latest, station, "left")


def apply_scenario(df: DataFrame, temperature: str = "sim_temperature_c",
                   humidity: str = "sim_relative_humidity", dry_days: str = "sim_dry_days") -> DataFrame:
    """What-if values over the weather columns; a null scenario value changes nothing.

    Lows, deltas, dry hours and rain stay as they were. Where the weather has no temperature
    or humidity column at all, 20 C and 50 % stand in for the new heat index only.
    """
    t, h, d = F.col(temperature), F.col(humidity), F.col(dry_days)

    def given(name: str, fallback: float | None = None) -> Column:
        return F.col(name) if name in df.columns else F.lit(fallback).cast("double")

    felt = heat_index_c(F.coalesce(t, given("temperature_c", 20.0)), F.coalesce(h, given("relative_humidity", 50.0)))
    columns = {
        "temperature_c": F.coalesce(t, given("temperature_c")),
        "relative_humidity": F.coalesce(h, given("relative_humidity")),
        "temp_max_24h": F.coalesce(t, given("temp_max_24h")),
        "temp_max_48h": F.coalesce(t, given("temp_max_48h")),
        "consecutive_dry_days": F.coalesce(d, given("consecutive_dry_days")),
    }
    for name in ("heat_index_c", "heat_index_max_24h", "heat_index_max_48h"):
        columns[name] = F.when(t.isNotNull() | h.isNotNull(), felt).otherwise(given(name))
    return df.withColumns(columns)


def aligned(df: DataFrame, columns: list[str]) -> list[Column]:
    """Model columns in order: absent ones null, the rest as numbers."""
    return [
        (F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c) for c in columns
    ]


def allowed_features(df: DataFrame) -> list[str]:
    """Allow-listed aggregate columns that are numeric in this table."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    return [c for c in AGGREGATE_FEATURE_COLUMNS if c in numeric]


def geojson_features(scored: DataFrame, score: str = "risk_score") -> DataFrame:
    """One GeoJSON Feature text per request and cell."""
    corner = F.transform("geometry", lambda p: F.array(p["lon"], p["lat"]))
    km = F.coalesce(F.col("line_length_km_water"), F.lit(0.0))
    share = F.coalesce(F.col("pct_pre_1980"), F.lit(0.0))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(corner).alias("coordinates")).alias("geometry"),
        F.struct(
            F.col("cell_id"),
            round_half_even(F.col(score), 4).alias("risk_score"),
            risk_band(F.col(score)).alias("risk_level"),
            round_half_even(km, 2).alias("water_km"),
            round_half_even(share * 100, 1).alias("vintage_pre1980_pct"),
            F.col("target_mode"),
            F.col("model_version"),
        ).alias("properties"),
    )
    return scored.select("request_id", "cell_id", F.to_json(feature).alias("feature"))


SCENARIO = ("sim_temperature_c", "sim_relative_humidity", "sim_dry_days")


def collection_metadata(requests: DataFrame, answered: DataFrame, target_mode: str = "unknown",
                        model_version: str = "unknown") -> DataFrame:
    """Per accepted request: features returned, truncated flag, scenario flag and provenance."""
    counts = answered.groupBy("request_id").agg(
        F.count("*").alias("feature_count"), F.max("truncated").alias("truncated")
    )
    applied = F.coalesce(*[F.col(c) for c in SCENARIO]).isNotNull()
    return requests.filter(request_problem(None).isNull()).select(
        "request_id", applied.alias("scenario_applied")
    ).join(counts, "request_id", "left").select(
        "request_id",
        F.coalesce("feature_count", F.lit(0)).alias("feature_count"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"),
        "scenario_applied",
        F.lit(target_mode).alias("target_mode"),
        F.lit(model_version).alias("model_version"),
    )


def request_answers(requests: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per request: the metadata of an answered one, the reason of a refused one."""
    reason = F.coalesce(request_problem(), scenario_problem())
    told = requests.select("request_id", reason.alias("reason")).join(metadata, "request_id", "left")
    return told.withColumns({
        "status": F.when(F.col("reason").isNull(), "answered").otherwise("refused"),
        "feature_count": F.coalesce("feature_count", F.lit(0)),
        "truncated": F.coalesce("truncated", F.lit(False)),
    })


def risk_summary(scored: DataFrame, score: str = "risk_score", request: str = "request_id") -> DataFrame:
    """Per request: cells, cells in the high band by the score as shown (four places), mean and greatest score."""
    return scored.groupBy(request).agg(
        F.count("*").alias("cells"),
        F.count_if(round_half_even(F.col(score), 4) >= HIGH_RISK).alias("high_cells"),
        F.avg(score).alias("mean_risk"),
        F.max(score).alias("max_risk"),
    )


def at_least(scored: DataFrame, minimum: float, score: str = "risk_score") -> DataFrame:
    """Scored cells whose score as shown (four places) is at or above a minimum; 0 or less keeps all."""
    return scored.filter(round_half_even(F.col(score), 4) >= minimum) if minimum > 0 else scored


def weather_summary(latest: DataFrame, source_mode: str = "live") -> DataFrame:
    """Rounded latest indicators per station, with where the data come from ('mock' data are synthetic) and how far a score looks ahead."""
    if source_mode not in SOURCE_MODES:
        raise ValueError(f"source_mode must be one of: {', '.join(SOURCE_MODES)}")
    places = {"temperature_c": 1, "relative_humidity": 1, "heat_index_c": 1,
              "consecutive_dry_days": 2, "rainfall_48h": 2}
    name = F.coalesce(F.col("station_name"), F.lit("Unknown station")) if "station_name" in latest.columns else F.lit("Unknown station")
    return latest.select(
        "station_id",
        *[round_binary(F.col(c), p).alias(c) for c, p in places.items()],
        name.alias("station_name"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("observed_at"),
        F.lit(source_mode).alias("data_source_mode"),
        F.lit(source_mode == "mock").alias("is_synthetic"),
        F.lit(PREDICTION_HORIZON_HOURS).alias("forecast_horizon_hours"),
    )

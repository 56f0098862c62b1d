"""The stages from landed files to answers. Each reads tables, writes one table and returns its path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.constants import DEFAULT_RESOLUTION, EXTENT, MAX_PAGES, MAX_TRAINING_DAYS, PREDICTION_HORIZON_HOURS
from cellweft.errors import DataError
from cellweft.functions import geo
from cellweft.functions.display import risk_band, round_half_even
from cellweft.functions.text import parse_variant_time
from cellweft.operators import daily, events, features, keys, lattice, layers, learn, quality, serve, windows
from cellweft.session import scratch_path
from cellweft.sources import hourly, pages, tables


def _kept(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """The rows from a written copy, for results that several passes read."""
    return spark.read.parquet(tables.write_table(df, scratch_path(spark, label)))


def _require_contract(audit: DataFrame, label: str) -> None:
    """Stop on a broken rule; whether a table may be empty is left to the stage that reads it."""
    quality.require_clean(audit.drop("row_count"), label)


def build_events(spark: SparkSession, pages_path: str, out: str, start: str | None = None, end: str | None = None,
                 max_records: int | None = None, multi_line: bool = True,
                 resolution: int = DEFAULT_RESOLUTION, base: str | None = None, max_pages: int = MAX_PAGES) -> str:
    """Landed pages to stored events; a page with a problem, or a stuck page set, stops the stage before it stores any.

    Dates and the record cap apply to all source records, before any of them is matched. With
    ``base`` the events replace or join those stored there, by objectid; ``base`` itself stays.
    """
    if base == out:
        raise DataError("events are merged into a new folder: base and out must differ")
    landed = pages.require_sound_pages(pages.read_pages(spark, pages_path, multi_line), max_pages)
    found, seen = pages.watch_pages(landed)
    rows = pages.page_features(found).withColumns({
        "_created": parse_variant_time(F.col("createddate")),
        "_id": F.try_variant_get("objectid", "$", "bigint"),
    })
    if start or end:
        rows = rows.filter(events.date_range("_created", start, end))
    if max_records is not None:
        rows = events.cap_records(rows, max_records, ("_created", "_id"))
    stored = _kept(spark, events.accepted_events(events.judge_features(rows), resolution), "events")
    pages.require_watched(seen)
    _require_contract(quality.audit_events(stored), "events")
    if base:
        stored = keys.upsert(spark.read.parquet(base), stored, ["objectid"])
    return tables.write_table(stored, out, order=["createddate", "objectid"])


def build_weather(spark: SparkSession, files: str | dict[str, Sequence[str]], out: str, start: str | None = None,
                  end: str | None = None, allow_partial: bool = False) -> str:
    """Hourly files to weather features, after the month and value checks.

    ``files`` is a folder of ``station_id=`` folders, read as a whole, or paths per station id,
    which arrive in their order. The parsed rows are written once for the checks and windows.
    """
    if isinstance(files, str):
        parts = [hourly.read_hourly(spark, files)]
    else:
        parts = [hourly.read_hourly(spark, path, station) for station, paths in files.items() for path in paths]
    observed = _kept(spark, hourly.combine_hourly(*parts), "observed")
    if start and end:
        if isinstance(files, str):
            stations = observed.select("station_id").distinct()
        else:
            stations = spark.createDataFrame([(s,) for s in files], "station_id string")
        dated = stations.withColumns({"start_date": F.to_date(F.lit(start)), "end_date": F.to_date(F.lit(end))})
        observed = hourly.require_complete(hourly.month_periods(dated), observed, allow_partial)
    clean = quality.check_observations(observed)
    return tables.write_table(windows.weather_features(clean), out, order=["station_id", "timestamp"])


def build_grid(spark: SparkSession, out: str, bbox: tuple[float, float, float, float] = EXTENT,
               resolution: int = DEFAULT_RESOLUTION) -> str:
    """Every cell that meets a box."""
    box = spark.createDataFrame([bbox], "west double, south double, east double, north double")
    tables.write_table(lattice.grid_fill(box, resolution=resolution), out, order=["cell_id"])
    _require_contract(quality.audit_grid(spark.read.parquet(out)), "grid")
    return out


def build_cells(spark: SparkSession, grid_path: str, water: DataFrame, roads: DataFrame, buildings: DataFrame,
                out: str, resolution: int | None = DEFAULT_RESOLUTION) -> str:
    """Layers on the grid. With ``resolution`` None the grid is any table of polygons.

    Lines need ``objectid`` and ``geometry``; buildings ``objectid``, ``year_built`` and a point or a ring. What lacks
    them stops the stage before anything is read; an empty layer leaves the defaults, an empty grid is an error.
    """
    water, roads = layers.require_layer(water, "water lines"), layers.require_layer(roads, "road lines")
    usable = layers.building_rows(layers.building_points(tables.nan_to_null(buildings)))
    grid = tables.require_table(spark, grid_path, "grid", ["cell_id", "centroid_lat", "centroid_lon", "geometry"])
    if resolution is None:
        lines = [layers.line_density_on_polygons(df, grid, kind) for df, kind in ((water, "water"), (roads, "road"))]
        # Two aggregates read the placed points, and the join that places them is costly.
        placed = _kept(spark, layers.points_in_polygons(usable, grid).select("cell_id", "objectid", "year_built"), "placed")
    else:
        lines = [layers.line_density(df, kind, resolution) for df, kind in ((water, "water"), (roads, "road"))]
        placed = layers.points_in_cells(usable, resolution=resolution)
    cells = features.cell_features(grid, *lines, layers.building_features(placed))
    tables.write_table(cells, out, order=["cell_id"])
    _require_contract(quality.audit_cells(spark.read.parquet(out)), "cell features")
    return out


def build_matrix(spark: SparkSession, cells_path: str, weather_path: str, out: str, station: str,
                 mode: str = "synthetic", max_days: int | None = MAX_TRAINING_DAYS) -> str:
    """Cells crossed with the newest ``max_days`` days of their station (None: all), labelled."""
    cells = tables.nan_to_null(tables.require_table(spark, cells_path, "cell features"))
    cells = cells if "station_id" in cells.columns else cells.withColumn("station_id", F.lit(station))
    weather = tables.nan_to_null(tables.require_table(spark, weather_path, "weather features", ["station_id", "timestamp"]))
    days = _kept(spark, daily.newest_days(daily.daily_last(weather), max_days), "days")
    features.check_matrix_inputs(cells, days)
    matrix = features.feature_matrix(cells, days)
    return tables.write_table(features.with_label(matrix, mode, cells, days), out, order=["timestamp", "cell_id"])


def build_model(spark: SparkSession, matrix_path: str, out: str, mode: str = "synthetic", trees: int = learn.TREES,
                purge_hours: int = PREDICTION_HORIZON_HOURS) -> str:
    """Train, measure and save a classifier."""
    matrix = tables.require_table(spark, matrix_path, "feature matrix")
    model, columns, metrics = learn.train_and_evaluate(matrix, trees=trees, purge_hours=purge_hours)
    learn.save_model(spark, out, model, columns, metrics, matrix.count(), mode)
    return out


def score_requests(spark: SparkSession, requests: DataFrame, grid_path: str, cells_path: str, weather_path: str,
                   model_path: str, station: str) -> tuple[DataFrame, DataFrame]:
    """Map requests to (scored cells, one answer per request: its metadata, or why it is refused)."""
    model, metadata = learn.load_model(spark, model_path)
    keys.require_unique(requests, ["request_id"], "requests")
    refused = F.coalesce(serve.request_problem(), serve.scenario_problem()).isNotNull()
    accepted = requests.filter(~refused)
    # Both the scores and the metadata start from the cells shown.
    found = serve.bbox_cells(accepted, tables.require_table(spark, grid_path, "grid"))
    shown = _kept(spark, serve.first_cells(found), "shown")
    cells = tables.nan_to_null(tables.require_table(spark, cells_path, "cell features"))
    cells = cells if "station_id" in cells.columns else cells.withColumn("station_id", F.lit(station))
    keys.require_unique(cells, ["cell_id"], "cell features")
    weather = tables.nan_to_null(tables.require_table(spark, weather_path, "weather features"))
    latest = keys.latest_per_key(weather, ["station_id"], "timestamp")
    rows = serve.with_weather(shown.join(cells, "cell_id", "left").fillna({"station_id": station}), latest)
    changed = serve.apply_scenario(rows)
    scored = learn.score_rows(model, metadata["feature_columns"], changed).withColumns({
        "target_mode": F.lit(metadata["target_mode"]), "model_version": F.lit(metadata["model_version"]),
    })
    told = serve.collection_metadata(accepted, shown, metadata["target_mode"], metadata["model_version"])
    return scored, serve.request_answers(requests, told)


def score_cells(spark: SparkSession, asked: DataFrame, grid_path: str, cells_path: str, weather_path: str,
                model_path: str, station: str, resolution: int | None = DEFAULT_RESOLUTION) -> DataFrame:
    """Single-cell requests: status, score and band per distinct cell id.

    The status is 'invalid', 'unknown', 'empty' or 'found'; the first two have no score. With
    ``resolution`` None the grid has ids of its own, and none of them is invalid but a null one.
    """
    model, metadata = learn.load_model(spark, model_path)
    grid = tables.require_table(spark, grid_path, "grid")
    cells = tables.nan_to_null(tables.require_table(spark, cells_path, "cell features"))
    answers = keys.cell_lookup(asked, grid, cells)
    answers = answers if "station_id" in answers.columns else answers.withColumn("station_id", F.lit(station))
    valid = F.col("cell_id").isNotNull() if resolution is None else geo.is_cell(F.col("cell_id"), resolution)
    answers = answers.withColumn("status", F.when(~valid, "invalid").otherwise(F.col("status")))
    latest = keys.latest_per_key(tables.nan_to_null(tables.require_table(spark, weather_path, "weather features")), ["station_id"], "timestamp")
    rows = serve.with_weather(answers.fillna({"station_id": station}), latest)
    scored = learn.score_rows(model, metadata["feature_columns"], rows)
    known = F.col("status").isin("empty", "found")
    return scored.select(
        "cell_id", "status", F.when(known, round_half_even(F.col("risk_score"), 4)).alias("risk_score"),
        F.when(known, risk_band(F.col("risk_score"))).alias("risk_level"), *serve.allowed_features(cells),
    )


def build_predictions(spark: SparkSession, cells_path: str, weather_path: str, model_path: str, out: str,
                      station: str) -> str:
    """Score every cell under the latest weather of its station and store the predictions."""
    model, metadata = learn.load_model(spark, model_path)
    cells = tables.nan_to_null(tables.require_table(spark, cells_path, "cell features"))
    cells = cells if "station_id" in cells.columns else cells.withColumn("station_id", F.lit(station))
    weather = tables.nan_to_null(tables.require_table(spark, weather_path, "weather features"))
    latest = keys.latest_per_key(weather, ["station_id"], "timestamp")
    scored = learn.score_rows(model, metadata["feature_columns"], serve.with_weather(cells, latest))
    tables.write_table(learn.predictions(scored, metadata), out, order=["cell_id"])
    _require_contract(quality.audit_predictions(spark.read.parquet(out)), "predictions")
    return out


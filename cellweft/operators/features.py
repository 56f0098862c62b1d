"""Cell table, cell x day matrix, labels and model input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweft.constants import (
    CELL_DEFAULTS,
    CELL_FEATURE_COLUMNS,
    LABEL,
    MIN_TRAINING_DAYS,
    RULE_DEFAULTS,
    TARGET_MODES,
)
from cellweft.errors import DataError
from cellweft.operators.joins import salted_join
from cellweft.operators.keys import require_unique
from cellweft.operators.ranked import exact_median


def cell_features(grid: DataFrame, water: DataFrame, roads: DataFrame, buildings: DataFrame) -> DataFrame:
    """One complete row per grid cell; a cell without a layer gets that layer's default."""
    joined = grid.select("cell_id", "centroid_lat", "centroid_lon")
    for layer in (water, roads, buildings):
        joined = joined.join(layer, "cell_id", "left")
    columns = [F.col(c) for c in CELL_FEATURE_COLUMNS[:3]]
    for name, default in CELL_DEFAULTS.items():
        kind = "int" if isinstance(default, int) else "double"
        columns.append(F.coalesce(F.col(name), F.lit(default)).cast(kind).alias(name))
    return joined.select(*columns)


def check_matrix_inputs(cells: DataFrame, days: DataFrame, station: str = "station_id") -> None:
    """Refuse duplicate cells and stations with too few days."""
    missing = {"cell_id", "centroid_lat", "centroid_lon"} - set(cells.columns)
    if missing:
        raise DataError(f"cell features are missing: {', '.join(sorted(missing))}")
    require_unique(cells, ["cell_id"], "cell features")
    used = cells.select(station).distinct()
    counts = days.groupBy(station).agg(F.count("*").alias("n"))
    short = used.join(counts, station, "left").filter(F.coalesce("n", F.lit(0)) < MIN_TRAINING_DAYS)
    if not short.isEmpty():
        raise DataError(f"at least {MIN_TRAINING_DAYS} daily snapshots are required per station")


def feature_matrix(cells: DataFrame, days: DataFrame, station: str = "station_id") -> DataFrame:
    """Every cell with every day of its station; clashing weather names get ``_weather``.

    An equi-join on the station. A station has one row a day, so only cells can crowd one: they are counted,
    which reads them twice (pass a written table), and a station with very many is split over tasks. The
    day table is broadcast only if Spark finds it small.
    """
    clashes = (set(cells.columns) & set(days.columns)) - {station}
    weather = days.select(*[F.col(c).alias(f"{c}_weather") if c in clashes else F.col(c) for c in days.columns])
    return salted_join(cells, weather, [station], count=("left",))


def rule_score(df: DataFrame, water_median: float) -> Column:
    """Points of the label rule; a column that is absent counts as its default."""
    c = {name: F.col(name) if name in df.columns else F.lit(value) for name, value in RULE_DEFAULTS.items()}

    def points(test: Column, weight: int) -> Column:
        return F.coalesce(test, F.lit(False)).cast("int") * weight

    return (
        points(c["line_length_km_water"] > F.lit(water_median), 2)
        + points(c["pct_pre_1980"] >= 0.4, 2)
        + points(c["heat_index_c"] >= 28.0, 1)
        + points(c["consecutive_dry_days"] >= 2.0, 1)
        + points(c["rainfall_48h"] < 1.0, 1)
    )


def rule_label(matrix: DataFrame, cells: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """Add the rule label, by the water median over the matrix.

    With ``cells`` and ``days`` (what the matrix was crossed from) each cell counts as often as its
    station has days, which is the same median at a fraction of the cost. ``cells`` alone
    will do only where every station has equally many days.
    """
    name = "line_length_km_water"
    if name not in matrix.columns:
        median = 0.0
    elif cells is None:
        median = exact_median(matrix, name)
    elif days is None:
        median = exact_median(cells, name)
    else:
        counts = days.groupBy("station_id").agg(F.count("*").alias("_days"))
        median = exact_median(cells.select("station_id", name).join(counts, "station_id"), name, "_days")
    return matrix.withColumn(LABEL, (rule_score(matrix, median) >= 4).cast("int"))


def observed_label(matrix: DataFrame) -> DataFrame:
    """Use the outcome column that is already there."""
    if LABEL not in matrix.columns:
        raise DataError("observed mode needs a pre-joined outcome column")
    return matrix.withColumn(LABEL, F.col(LABEL).cast("int"))


def with_label(matrix: DataFrame, mode: str = "synthetic", cells: DataFrame | None = None,
               days: DataFrame | None = None) -> DataFrame:
    if mode not in TARGET_MODES:
        raise ValueError(f"mode must be one of: {', '.join(TARGET_MODES)}")
    return observed_label(matrix) if mode == "observed" else rule_label(matrix, cells, days)


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric model inputs, sorted by name; ids, label, place and time are left out."""
    left_out = {"cell_id", "station_id", LABEL, "geometry", "centroid_lat", "centroid_lon", "timestamp"}
    return sorted(
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in left_out
    )

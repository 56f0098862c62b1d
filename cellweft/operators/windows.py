"""Time windows per station, cut into chunks so that no station is one task.

A row goes to the chunk that holds its time and, when it is within the look-back of the
chunk's end, to the next chunk too. Every frame of a row then lies inside its own chunk,
and the groups are (station, chunk) instead of whole stations. The one feature without a
bounded look-back, the dry streak, is carried between chunks by one small row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cellweft.functions.weather import heat_index_c, is_dry

HOUR_US = 3_600_000_000
LOOK_BACK_HOURS = 168
DEFAULT_CHUNK_HOURS = 26 * 168


class ChunkedTime:
    """Rows keyed by (station, chunk) with the window builders that belong to them."""

    def __init__(self, df: DataFrame, station: str, ts: str, chunk_hours: int = DEFAULT_CHUNK_HOURS):
        if chunk_hours < LOOK_BACK_HOURS:
            raise ValueError(f"chunk_hours must be at least {LOOK_BACK_HOURS}")
        self.columns = df.columns
        self.station = station
        self.ts = ts
        width = chunk_hours * HOUR_US
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        home = F.floor(F.col("_us") / F.lit(width))
        to_end = (F.col("_home") + 1) * width - F.col("_us")
        needed = F.when(
            to_end <= LOOK_BACK_HOURS * HOUR_US, F.array(F.col("_home"), F.col("_home") + 1)
        ).otherwise(F.array(F.col("_home")))
        self.rows = (
            df.withColumn("_us", micros)
            .withColumn("_home", home)
            .withColumn("_chunk", F.explode(needed))
        )

    def order(self) -> WindowSpec:
        return Window.partitionBy(self.station, "_chunk").orderBy("_us")

    def last_hours(self, hours: int) -> WindowSpec:
        """Elapsed-time frame (t - hours, t], open on the left."""
        return self.order().rangeBetween(-hours * HOUR_US + 1, 0)

    def at_hours_before(self, hours: int) -> WindowSpec:
        return self.order().rangeBetween(-hours * HOUR_US, -hours * HOUR_US)

    def delta(self, value: str, hours: int) -> Column:
        """Difference with the row exactly ``hours`` before; null when there is none."""
        return F.col(value) - F.max(value).over(self.at_hours_before(hours))

    def reset(self, precip: str) -> Column:
        """True where a dry streak cannot go on: wet, unknown, or not one hour after the row before."""
        step = F.col("_us") - F.lag("_us").over(self.order())
        return ~is_dry(F.col(precip)) | F.coalesce(step != HOUR_US, F.lit(True))

    def own(self, df: DataFrame) -> DataFrame:
        """Drop the look-back copies."""
        return df.filter(F.col("_chunk") == F.col("_home"))


def _stations(df: DataFrame, station: str | None) -> tuple[DataFrame, str]:
    """Give a one-station series a station column."""
    return (df, station) if station else (df.withColumn("_station", F.lit(0)), "_station")


def rolling(df: DataFrame, features: dict[str, tuple[str, str, int]], station: str | None = "station_id",
            ts: str = "timestamp", chunk_hours: int = DEFAULT_CHUNK_HOURS) -> DataFrame:
    """Add rolling columns ``{name: (max|min|sum, column, hours)}``; a null adds 0 to a sum."""
    for how, _, hours in features.values():
        if how not in {"max", "min", "sum"} or not 0 < hours <= LOOK_BACK_HOURS:
            raise ValueError("rolling takes max, min or sum over at most 168 hours")
    keyed, key = _stations(df, station)
    chunks = ChunkedTime(keyed, key, ts, chunk_hours)
    added = {}
    for name, (how, column, hours) in features.items():
        value = F.coalesce(F.col(column), F.lit(0.0)) if how == "sum" else F.col(column)
        added[name] = getattr(F, how)(value).over(chunks.last_hours(hours))
    return chunks.own(chunks.rows.withColumns(added)).select(*df.columns, *features)


def elapsed_delta(df: DataFrame, features: dict[str, tuple[str, int]], station: str | None = "station_id",
                  ts: str = "timestamp", chunk_hours: int = DEFAULT_CHUNK_HOURS) -> DataFrame:
    """Add ``{name: (column, hours)}``: the change since the row exactly that many hours before."""
    if any(not 0 < hours <= LOOK_BACK_HOURS for _, hours in features.values()):
        raise ValueError("elapsed_delta looks back at most 168 hours")
    keyed, key = _stations(df, station)
    chunks = ChunkedTime(keyed, key, ts, chunk_hours)
    added = {name: chunks.delta(column, hours) for name, (column, hours) in features.items()}
    return chunks.own(chunks.rows.withColumns(added)).select(*df.columns, *features)


def _streak_columns(chunks: ChunkedTime, precip: str) -> dict[str, Column]:
    """Last reset so far inside the chunk, as (time, was the resetting hour itself dry)."""
    marked = F.when(
        (F.col("_chunk") == F.col("_home")) & F.col("_reset"),
        F.struct(F.col("_us").alias("at"), is_dry(F.col(precip)).cast("int").alias("dry")),
    )
    so_far = chunks.order().rowsBetween(Window.unboundedPreceding, 0)
    return {"_last_reset": F.max(marked).over(so_far)}


def _carried_resets(df: DataFrame, station: str, ts: str, precip: str, chunk_hours: int) -> DataFrame:
    """(station, chunk, last reset before the chunk): one row per chunk that has rows."""
    narrow = ChunkedTime(df.select(station, ts, precip), station, ts, chunk_hours)
    rows = narrow.own(narrow.rows.withColumn("_reset", narrow.reset(precip)))
    marked = F.when(
        F.col("_reset"),
        F.struct(F.col("_us").alias("at"), is_dry(F.col(precip)).cast("int").alias("dry")),
    )
    ends = rows.groupBy(station, "_chunk").agg(F.max(marked).alias("_end"))
    before = Window.partitionBy(station).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(station, "_chunk", F.max("_end").over(before).alias("_carried"))


def _finish_streak(df: DataFrame, precip: str) -> Column:
    """Hours since the last reset, plus one when the resetting hour was dry itself."""
    last = F.coalesce(F.col("_last_reset"), F.col("_carried"))
    hours = ((F.col("_us") - last["at"]) / F.lit(HOUR_US)).cast("int") + last["dry"]
    return F.when(is_dry(F.col(precip)), hours).otherwise(F.lit(0)).cast("int")


def dry_streak(df: DataFrame, station: str | None = "station_id", ts: str = "timestamp",
               precip: str = "precip_mm", chunk_hours: int = DEFAULT_CHUNK_HOURS) -> DataFrame:
    """Add is_dry_hour, consecutive_dry_hours and consecutive_dry_days."""
    keyed, key = _stations(df, station)
    chunks = ChunkedTime(keyed, key, ts, chunk_hours)
    rows = chunks.rows.withColumn("_reset", chunks.reset(precip))
    rows = chunks.own(rows.withColumns(_streak_columns(chunks, precip)))
    carried = _carried_resets(keyed, key, ts, precip, chunk_hours)
    rows = rows.join(carried, [key, "_chunk"], "left")
    rows = rows.withColumn("is_dry_hour", is_dry(F.col(precip)).cast("int"))
    rows = rows.withColumn("consecutive_dry_hours", _finish_streak(rows, precip))
    rows = rows.withColumn("consecutive_dry_days", F.col("consecutive_dry_hours") / 24)
    return rows.select(*df.columns, "is_dry_hour", "consecutive_dry_hours", "consecutive_dry_days")


def weather_features(df: DataFrame, station: str | None = "station_id", ts: str = "timestamp",
                     chunk_hours: int = DEFAULT_CHUNK_HOURS) -> DataFrame:
    """All sixteen derived columns in one window pass; input columns are kept."""
    keyed, key = _stations(df, station)
    keyed = keyed.withColumn("heat_index_c", heat_index_c(F.col("temperature_c"), F.col("relative_humidity")))
    chunks = ChunkedTime(keyed, key, ts, chunk_hours)
    rain = F.coalesce(F.col("precip_mm"), F.lit(0.0))
    windowed = {
        "temp_delta_24h": chunks.delta("temperature_c", 24),
        "temp_delta_48h": chunks.delta("temperature_c", 48),
        "temp_max_24h": F.max("temperature_c").over(chunks.last_hours(24)),
        "temp_max_48h": F.max("temperature_c").over(chunks.last_hours(48)),
        "temp_min_24h": F.min("temperature_c").over(chunks.last_hours(24)),
        "heat_index_max_24h": F.max("heat_index_c").over(chunks.last_hours(24)),
        "heat_index_max_48h": F.max("heat_index_c").over(chunks.last_hours(48)),
        "rainfall_24h": F.sum(rain).over(chunks.last_hours(24)),
        "rainfall_48h": F.sum(rain).over(chunks.last_hours(48)),
        "rainfall_7d": F.sum(rain).over(chunks.last_hours(168)),
        "humidity_delta_24h": chunks.delta("relative_humidity", 24),
        "humidity_min_24h": F.min("relative_humidity").over(chunks.last_hours(24)),
        "_reset": chunks.reset("precip_mm"),
    }
    rows = chunks.rows.withColumns(windowed)
    rows = chunks.own(rows.withColumns(_streak_columns(chunks, "precip_mm")))
    rows = rows.join(_carried_resets(keyed, key, ts, "precip_mm", chunk_hours), [key, "_chunk"], "left")
    rows = rows.withColumn("is_dry_hour", is_dry(F.col("precip_mm")).cast("int"))
    rows = rows.withColumn("consecutive_dry_hours", _finish_streak(rows, "precip_mm"))
    rows = rows.withColumn("consecutive_dry_days", F.col("consecutive_dry_hours") / 24)
    return rows.select(*df.columns, *FEATURE_COLUMNS)


FEATURE_COLUMNS = (
    "temp_delta_24h",
    "temp_delta_48h",
    "temp_max_24h",
    "temp_max_48h",
    "temp_min_24h",
    "heat_index_c",
    "heat_index_max_24h",
    "heat_index_max_48h",
    "is_dry_hour",
    "consecutive_dry_hours",
    "consecutive_dry_days",
    "rainfall_24h",
    "rainfall_48h",
    "rainfall_7d",
    "humidity_delta_24h",
    "humidity_min_24h",
)

"""Queries on hourly weather: windows, days, months, hourly files, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.constants import HOURLY_NUMERIC
from cellweft.functions.display import round_binary, round_half_even
from cellweft.functions.text import to_number
from cellweft.functions.weather import heat_index_c
from cellweft.operators import daily, keys, quality, serve, windows
from cellweft.plans import inputs
from cellweft.plans.inputs import DAY_COLUMNS, back_sql, heat_sql, with_views
from cellweft.plans.registry import query
from cellweft.session import scratch_path
from cellweft.sources import hourly, tables


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


_ROUND = ("heat_index_c", "heat_index_max_24h", "heat_index_max_48h", "consecutive_dry_days")
_ROUND_SQL = "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUND) + ") FROM "


@query("weather_features", with_views("weather") + _ROUND_SQL + "weather")
def weather_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(windows.weather_features(inputs.obs(spark, folder)), *_ROUND)


@query("rolling_max", with_views("obs") + f"""
SELECT station_id, timestamp, max(temperature_c) {back_sql(24)} AS temp_max_24h, max(temperature_c) {back_sql(48)} AS temp_max_48h FROM obs""")
def rolling_max(spark, folder):
    features = {"temp_max_24h": ("max", "temperature_c", 24), "temp_max_48h": ("max", "temperature_c", 48)}
    return windows.rolling(inputs.obs(spark, folder), features).select("station_id", "timestamp", *features)


@query("rolling_min", with_views("obs") + f"""
SELECT station_id, timestamp, min(temperature_c) {back_sql(24)} AS temp_min_24h, min(relative_humidity) {back_sql(24)} AS humidity_min_24h FROM obs""")
def rolling_min(spark, folder):
    features = {"temp_min_24h": ("min", "temperature_c", 24), "humidity_min_24h": ("min", "relative_humidity", 24)}
    return windows.rolling(inputs.obs(spark, folder), features).select("station_id", "timestamp", *features)


@query("rolling_rain", with_views("obs") + "SELECT station_id, timestamp, " + ", ".join(
    f"sum(coalesce(precip_mm, 0)) {back_sql(h)} AS {n}" for n, h in
    (("rainfall_24h", 24), ("rainfall_48h", 48), ("rainfall_7d", 168))) + " FROM obs")
def rolling_rain(spark, folder):
    hours = {"rainfall_24h": 24, "rainfall_48h": 48, "rainfall_7d": 168}
    features = {name: ("sum", "precip_mm", h) for name, h in hours.items()}
    return windows.rolling(inputs.obs(spark, folder), features).select("station_id", "timestamp", *features)


@query("elapsed_delta", with_views("obs") + """
SELECT o.station_id, o.timestamp, o.temperature_c - b24.temperature_c AS temp_delta_24h,
  o.temperature_c - b48.temperature_c AS temp_delta_48h, o.relative_humidity - b24.relative_humidity AS humidity_delta_24h
FROM obs o LEFT JOIN obs b24 ON b24.station_id = o.station_id AND b24.timestamp = o.timestamp - INTERVAL '24 hours'
LEFT JOIN obs b48 ON b48.station_id = o.station_id AND b48.timestamp = o.timestamp - INTERVAL '48 hours'""")
def elapsed_delta(spark, folder):
    features = {"temp_delta_24h": ("temperature_c", 24), "temp_delta_48h": ("temperature_c", 48),
                "humidity_delta_24h": ("relative_humidity", 24)}
    return windows.elapsed_delta(inputs.obs(spark, folder), features).select("station_id", "timestamp", *features)


@query("dry_streak", with_views("streak") + """
SELECT station_id, timestamp, precip_mm, dry::INT AS is_dry_hour, consecutive_dry_hours,
  round(consecutive_dry_hours / 24::DOUBLE, 6) AS consecutive_dry_days FROM streak""")
def dry_streak(spark, folder):
    rows = windows.dry_streak(inputs.obs(spark, folder).select("station_id", "timestamp", "precip_mm"))
    return rounded(rows, "consecutive_dry_days")


@query("heat_index", with_views("obs") + f"""
SELECT station_id, timestamp, round({heat_sql('temperature_c', 'relative_humidity')}, 6) AS heat_index_c FROM obs""")
def heat_index(spark, folder):
    felt = heat_index_c(F.col("temperature_c"), F.col("relative_humidity"))
    return inputs.obs(spark, folder).select("station_id", "timestamp", F.round(felt, 6).alias("heat_index_c"))


_DAY_ROUND = "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUND) + ") FROM "


@query("daily_last", with_views("days") + _DAY_ROUND + "days")
def daily_last(spark, folder):
    weather = windows.weather_features(inputs.obs(spark, folder))
    return rounded(daily.daily_last(weather, DAY_COLUMNS), *_ROUND)


@query("newest_days", with_views("days") + _DAY_ROUND + """days
  QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) <= 7""")
def newest_days(spark, folder):
    weather = windows.weather_features(inputs.obs(spark, folder))
    return rounded(daily.newest_days(daily.daily_last(weather, DAY_COLUMNS), limit=7), *_ROUND)


@query("latest_row", with_views("obs") + """
SELECT o.* FROM obs o JOIN (SELECT station_id, max(timestamp) AS timestamp FROM obs GROUP BY 1) USING (station_id, timestamp)""")
def latest_row(spark, folder):
    return keys.latest_per_key(inputs.obs(spark, folder), ["station_id"], "timestamp")


@query("weather_summary", with_views("weather") + """
SELECT station_id, round_even(temperature_c, 1) AS temperature_c, round_even(relative_humidity, 1) AS relative_humidity,
  round_even(heat_index_c, 1) AS heat_index_c, round_even(consecutive_dry_days, 2) AS consecutive_dry_days,
  round_even(rainfall_48h, 2) AS rainfall_48h, 'Unknown station' AS station_name,
  strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS observed_at, 'mock' AS data_source_mode, true AS is_synthetic, 48 AS forecast_horizon_hours
FROM weather QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) = 1""")
def weather_summary(spark, folder):
    weather = windows.weather_features(inputs.obs(spark, folder))
    return serve.weather_summary(keys.latest_per_key(weather, ["station_id"], "timestamp"), "mock")


@query("first_per_key", """
SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, event_id, user_id, value
FROM events QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) = 1""")
def first_per_key(spark, folder):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    rows = inputs.table(spark, folder, "events").select("event_type", hour, "event_id", "user_id", "value")
    return keys.first_per_key(rows, ["event_type", "hour"], ["event_id"])


@query("obs_dedup", with_views("obs") + """
SELECT * EXCLUDE (part) FROM (SELECT *, 0 AS part FROM obs UNION ALL
  SELECT station_id, timestamp + INTERVAL '1 hour', temperature_c + 100, relative_humidity, precip_mm, 1 FROM obs)
QUALIFY row_number() OVER (PARTITION BY station_id, timestamp ORDER BY part) = 1""")
def obs_dedup(spark, folder):
    first = inputs.obs(spark, folder)
    later = first.withColumns({
        "timestamp": F.col("timestamp") + F.expr("interval 1 hour"), "temperature_c": F.col("temperature_c") + 100,
    })
    return hourly.combine_hourly(first, later)


@query("month_periods", """
SELECT c AS station_id, m::DATE AS month FROM (SELECT o_custkey AS c, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1),
  LATERAL (SELECT unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL '1 month')) AS m)""")
def month_periods(spark, folder):
    return hourly.month_periods(_order_ranges(spark, folder)).select("station_id", "month")


def _order_ranges(spark, folder):
    orders = inputs.table(spark, folder, "orders").withColumn("day", F.to_date("o_orderdate"))
    return orders.groupBy(F.col("o_custkey").alias("station_id")).agg(
        F.min("day").alias("start_date"), F.max("day").alias("end_date")
    )


@query("missing_months", """
SELECT c AS station_id, m::DATE AS month FROM (SELECT o_custkey AS c, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1),
  LATERAL (SELECT unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL '1 month')) AS m)
EXCEPT SELECT o_custkey, date_trunc('month', o_orderdate)::DATE FROM orders""")
def missing_months(spark, folder):
    expected = hourly.month_periods(_order_ranges(spark, folder))
    observed = inputs.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("station_id"), F.col("o_orderdate").alias("timestamp")
    )
    return hourly.missing_months(expected, observed)


_STATION_NUMBERS = {name: str(49568 + i) for i, name in enumerate(inputs.STATIONS)}


_HOURLY_SQL = with_views("obs") + "SELECT timestamp, CASE station_id " + " ".join(
    f"WHEN '{name}' THEN '{number}'" for name, number in _STATION_NUMBERS.items()) + """ END AS station_id,
  'C-' || station_id AS climate_id, station_id AS station_name, temperature_c, NULL::DOUBLE AS dew_point_c,
  relative_humidity, precip_mm, {wind} AS wind_speed_kmh, NULL::DOUBLE AS pressure_kpa FROM obs"""


def _landed_hours(spark, folder):
    """Rows of hourly files from the observations, with marks for unknown rain and a bad time per hour."""
    number = F.element_at(F.create_map(*[F.lit(v) for kv in _STATION_NUMBERS.items() for v in kv]), F.col("station_id"))
    time = F.date_format("timestamp", "yyyy-MM-dd HH:mm")
    return inputs.obs(spark, folder).select(
        number.alias("station_id"), F.hour("timestamp").alias("hour"), F.explode(F.array(time, F.lit("no time"))).alias("Date/Time (LST)"),
        F.concat(F.lit("C-"), "station_id").alias("Climate ID"), F.col("station_id").alias("Station Name"),
        F.col("temperature_c").cast("string").alias("Temp (°C)"),
        F.col("relative_humidity").cast("string").alias("Rel Hum (%)"),
        F.coalesce(F.col("precip_mm").cast("string"), F.lit("M")).alias("Precip. Amount (mm)"),
        (F.col("temperature_c") * 2).cast("string").alias("Wind Spd (km/h)"),
    )


@query("csv_hourly", _HOURLY_SQL.replace("{wind}", "(temperature_c * 2)::DOUBLE"))
def csv_hourly(spark, folder):
    path = scratch_path(spark, "hourly")
    _landed_hours(spark, folder).drop("hour").write.option("header", True).partitionBy("station_id").csv(path)
    return hourly.read_hourly(spark, path).drop("_file", "_block", "_row")


@query("csv_mixed_headers", _HOURLY_SQL.replace("{wind}", "CASE WHEN hour(timestamp) % 2 = 0 THEN (temperature_c * 2)::DOUBLE END"))
def csv_mixed_headers(spark, folder):
    """Odd hours land in files whose columns stand in reverse order, without the wind column."""
    path = scratch_path(spark, "hourly")
    landed = _landed_hours(spark, folder)
    columns = [f"`{c}`" for c in landed.columns if c != "hour"]
    even, odd = (landed.filter(F.col("hour") % 2 == k) for k in (0, 1))
    for rows in (even.select(*columns), odd.select(*reversed(columns)).drop("Wind Spd (km/h)")):
        rows.write.mode("append").option("header", True).partitionBy("station_id").csv(path)
    return hourly.read_hourly(spark, path).drop("_file", "_block", "_row")


@query("coerce_numeric", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id / 8::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN NULL
  ELSE event_id::DOUBLE END AS number FROM events""")
def coerce_numeric(spark, folder):
    k = F.col("event_id")
    text = F.when(k % 4 == 0, (k / 8).cast("string")).when(k % 4 == 1, "M").when(k % 4 == 2, "NaN").otherwise(
        F.concat(F.lit(" "), k.cast("string")))
    return inputs.table(spark, folder, "events").select("event_id", to_number(text).alias("number"))


@query("display_round", with_views("obs") + """
SELECT station_id, timestamp, round_even(temperature_c / 7, 1) AS one, round_even(relative_humidity / 7, 2) AS two,
  round_even(temperature_c / relative_humidity, 4) AS four,
  printf('%.2f', (temperature_c * 100 + relative_humidity * 10 + 5) / 1000)::DOUBLE AS tied FROM obs""")
def display_round(spark, folder):
    """Plain values, and values that read as ties (x.xx5) but mostly are none in binary."""
    t, h = F.col("temperature_c"), F.col("relative_humidity")
    return inputs.obs(spark, folder).select(
        "station_id", "timestamp", round_half_even(t / 7, 1).alias("one"), round_half_even(h / 7, 2).alias("two"),
        round_half_even(t / h, 4).alias("four"), round_binary((t * 100 + h * 10 + 5) / 1000, 2).alias("tied"),
    )


_DIRTY = """
SELECT event_type AS station_id, date_trunc('hour', ts)::TIMESTAMP AS timestamp, value AS temperature_c,
  (user_id % 120)::DOUBLE AS relative_humidity, (event_id % 13 - 1)::DOUBLE AS precip_mm FROM events"""


@query("dq_report", f"""
WITH raw AS ({_DIRTY}) SELECT count(*) AS row_count, count(*) FILTER (WHERE timestamp IS NULL) AS missing_timestamp,
  count(*) AS bad_station_id, count(*) FILTER (WHERE relative_humidity NOT BETWEEN 0 AND 100) AS humidity_out_of_range,
  count(*) FILTER (WHERE precip_mm < 0) AS negative_precip,
  (SELECT count(*) - count(DISTINCT (station_id, timestamp)) FROM raw) AS duplicate_timestamps FROM raw""")
def dq_report(spark, folder):
    raw = inputs.table(spark, folder, "events").select(
        F.col("event_type").alias("station_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"),
        F.col("value").alias("temperature_c"), (F.col("user_id") % 120).cast("double").alias("relative_humidity"),
        (F.col("event_id") % 13 - 1).cast("double").alias("precip_mm"),
    )
    return quality.weather_report(raw)


@query("dup_keys", """
SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS copies FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def dup_keys(spark, folder):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return keys.duplicate_keys(inputs.table(spark, folder, "events").select("event_type", hour), ["event_type", "hour"])


@query("require_table", """
SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def require_table(spark, folder):
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    orders = tables.nan_to_null(tables.require_table(spark, f"{folder}/orders.parquet", "orders", columns))
    return orders.groupBy("o_orderstatus").agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("write_readback", with_views("obs") + "SELECT *, date_trunc('month', timestamp)::DATE AS month FROM obs")
def write_readback(spark, folder):
    rows = inputs.obs(spark, folder).withColumn("month", F.trunc(F.col("timestamp"), "MM"))
    path = scratch_path(spark, "observations")
    tables.write_table(rows, path, order=["station_id", "timestamp"], partition_by=["month"])
    return tables.require_table(spark, path, "observations").select(
        "station_id", "timestamp", *HOURLY_NUMERIC[:1], "relative_humidity", "precip_mm", "month"
    )

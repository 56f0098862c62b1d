"""Views over the given tables, once for Spark and once as SQL text.

The tables hold no weather or places, so both are derived from their keys by exact integer
arithmetic. Each Spark view has a SQL twin of the same name in ``SQL``; the queries in
this folder run on the Spark views and the check SQL on the twins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.constants import EXTENT
from cellweft.functions import geo

STATIONS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lon(key: Column) -> Column:
    return F.lit(-76.35) + (key * 7919 % 8500) / 10000.0


def lat(key: Column) -> Column:
    return F.lit(45.25) + (key * 104729 % 3500) / 10000.0


def sql_lon(key: str) -> str:
    return f"(-76.35::DOUBLE + (({key}) * 7919 % 8500)::DOUBLE / 10000::DOUBLE)"


def sql_lat(key: str) -> str:
    return f"(45.25::DOUBLE + (({key}) * 104729 % 3500)::DOUBLE / 10000::DOUBLE)"


def obs(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly observations per station, with gaps and unknown rain."""
    hours = table(spark, folder, "events").groupBy(
        F.col("event_type").alias("station_id"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"),
    ).agg(F.min("event_id").alias("a"), F.max("user_id").alias("b"), F.max("event_id").alias("c"))
    rain = F.when(F.col("c") % 11 == 0, None).when(F.col("c") % 7 == 0, 2.5).otherwise(0.0)
    return hours.select(
        "station_id", "timestamp",
        (10 + F.col("a") % 30).cast("double").alias("temperature_c"),
        (30 + F.col("b") % 70).cast("double").alias("relative_humidity"),
        rain.cast("double").alias("precip_mm"),
    )


def points(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """Every row of a table as a point."""
    k = F.col(key)
    return table(spark, folder, name).select(k.cast("bigint").alias("objectid"), lon(k).alias("lon"), lat(k).alias("lat"))


def buildings(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(
        k.alias("objectid"), (1500 + k * 37 % 700).alias("year_built"), lon(k).alias("lon"), lat(k).alias("lat")
    )


def lines(spark: SparkSession, folder: str, name: str = "customer", key: str = "c_custkey", shift: int = 0) -> DataFrame:
    """Every row of a table as a two-leg line."""
    k = F.col(key).cast("bigint") + shift
    x, y = lon(k), lat(k)
    dx, dy = (k * 31 % 200 - 100) / 10000.0, (k * 17 % 200 - 100) / 10000.0

    def vertex(a: Column, b: Column) -> Column:
        return F.struct(a.alias("lon"), b.alias("lat"))

    path = F.array(vertex(x, y), vertex(x + dx, y + dy), vertex(x + dx, y))
    return table(spark, folder, name).select(k.alias("objectid"), path.alias("geometry"))


#: Corners of a U in sixths of its width and thirds of its height; the right arm is twice the left one.
U_CORNERS = ((0, 0), (6, 0), (6, 3), (4, 3), (4, 1), (1, 1), (1, 3), (0, 3))


def u_shapes(spark: SparkSession, folder: str, turned: bool = False) -> DataFrame:
    """A concave cell per supplier with its ring and box; with ``turned`` every odd one is mirrored to a C.

    Their corners lie off the steps of the other views' places, so no line runs along an edge.
    """
    k = F.col("s_suppkey").cast("bigint")
    x, y = lon(k) + 0.013737, lat(k) + 0.007131
    w, h = (k % 5 + 2) / 100.0, (k % 4 + 2) / 100.0
    flip = (k % 2 == 1) & F.lit(turned)
    corners = [F.when(flip, F.struct((x + h * b / 3.0).alias("lon"), (y + w * a / 6.0).alias("lat"))).otherwise(
        F.struct((x + w * a / 6.0).alias("lon"), (y + h * b / 3.0).alias("lat"))) for a, b in (*U_CORNERS, U_CORNERS[0])]
    rows = table(spark, folder, "supplier").select(F.concat(F.lit("u"), k.cast("string")).alias("cell_id"), F.array(*corners).alias("geometry"))
    return rows.withColumns({f"{c}_{end}": fn(F.col(f"geometry.{c}")) for c in ("lon", "lat")
                             for end, fn in (("min", F.array_min), ("max", F.array_max))})


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Map requests: a box per supplier, some reversed, too large or outside; some with a scenario."""
    k = F.col("s_suppkey").cast("bigint")
    west, south = lon(k), lat(k)
    return table(spark, folder, "supplier").select(
        k.alias("request_id"),
        west.alias("west"), south.alias("south"),
        (west + (k % 70 - 5) / 100.0).alias("east"),
        (south + (k % 9 - 1) / 100.0).alias("north"),
        (k % 50 + 1).cast("int").alias("max_features"),
        F.when(k % 3 == 0, (20 + k % 25).cast("double")).alias("sim_temperature_c"),
        F.when(k % 4 == 0, (k % 101).cast("double")).alias("sim_relative_humidity"),
        F.when(k % 5 == 0, (k % 40).cast("double")).alias("sim_dry_days"),
    )


def scored(spark: SparkSession, folder: str, fine: bool = False) -> DataFrame:
    """Labels and scores per line item: few distinct scores, or nearly one per row."""
    score = F.col("l_extendedprice") / 1000000.0 if fine else F.round(F.col("l_discount") * 10, 1) / 10
    return table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"), score.alias("score")
    )


def station_of(q: Column, r: Column) -> Column:
    names = F.array(*[F.lit(s) for s in STATIONS])
    return F.element_at(names, F.pmod(q * 3 + r, F.lit(5)).cast("int") + 1)


# SQL twins ------------------------------------------------------------------------------


# The plane of the check SQL, written out: a wrong constant in the library then shows as a difference.
SQL_ECCENTRICITY = "0.08181919104281579::DOUBLE"
SQL_CONE_N = "0.9007900864044114::DOUBLE"
SQL_CONE_AF = "11239251.286975788::DOUBLE"
SQL_CONE_RHO0 = "3083163.291892266::DOUBLE"


def project_sql(source: str, lon_name: str = "lon", lat_name: str = "lat", x: str = "x", y: str = "y") -> str:
    """Rows of ``source`` with metric x and y."""
    e = SQL_ECCENTRICITY
    phi = f"radians({lat_name})"
    t = f"(tan(pi()/4 - {phi}/2) / pow((1 - {e}*sin({phi}))/(1 + {e}*sin({phi})), {e}/2))"
    rho = f"({SQL_CONE_AF} * pow({t}, {SQL_CONE_N}))"
    theta = f"({SQL_CONE_N} * radians({lon_name} + 91.86666666666666::DOUBLE))"
    return (
        f"SELECT *, 6200000 + {rho}*sin({theta}) AS {x}, "
        f"3000000 + {SQL_CONE_RHO0} - {rho}*cos({theta}) AS {y} FROM {source}"
    )


def unproject_sql(source: str, x: str = "x", y: str = "y", lon_name: str = "lon", lat_name: str = "lat") -> str:
    """Rows of ``source`` with longitude and latitude, by fixed-point iteration."""
    e = SQL_ECCENTRICITY
    first = (
        f"SELECT *, atan2({x} - 6200000, {SQL_CONE_RHO0} + 3000000 - {y}) / {SQL_CONE_N} AS _th, "
        f"pow(sqrt(pow({x} - 6200000, 2) + pow({SQL_CONE_RHO0} + 3000000 - {y}, 2)) / {SQL_CONE_AF}, "
        f"1 / {SQL_CONE_N}) AS _t FROM {source}"
    )
    inner = f"SELECT *, pi()/2 - 2*atan(_t) AS _f0 FROM ({first})"
    for i in range(6):
        step = f"pi()/2 - 2*atan(_t * pow((1 - {e}*sin(_f{i}))/(1 + {e}*sin(_f{i})), {e}/2))"
        inner = f"SELECT *, {step} AS _f{i + 1} FROM ({inner})"
    return (
        f"SELECT * EXCLUDE (_th, _t, _f0, _f1, _f2, _f3, _f4, _f5, _f6), "
        f"degrees(_th) - 91.86666666666666::DOUBLE AS {lon_name}, degrees(_f6) AS {lat_name} FROM ({inner})"
    )


#: Edge of a cell at resolution 8 in metres, written out as well.
EDGE = 531.41401


def axial_sql(source: str, x: str = "x", y: str = "y") -> str:
    """Rows of ``source`` with lattice q and r of (x, y)."""
    first = (
        f"SELECT *, ({math.sqrt(3)!r}::DOUBLE/3*{x} - {y}/3)/{EDGE!r}::DOUBLE AS _q, (2*{y}/3)/{EDGE!r}::DOUBLE AS _r FROM {source}"
    )
    second = f"SELECT *, floor(_q + 0.5) AS _a, floor(_r + 0.5) AS _b, floor(0.5 - _q - _r) AS _c FROM ({first})"
    third = f"SELECT *, abs(_a - _q) AS _da, abs(_b - _r) AS _db, abs(_c + _q + _r) AS _dc FROM ({second})"
    return (
        "SELECT * EXCLUDE (_q, _r, _a, _b, _c, _da, _db, _dc), "
        "(CASE WHEN _da > _db AND _da > _dc THEN -_b - _c ELSE _a END)::BIGINT AS q, "
        "(CASE WHEN NOT (_da > _db AND _da > _dc) AND _db > _dc THEN -_a - _c ELSE _b END)::BIGINT AS r "
        f"FROM ({third})"
    )


CELL_SQL = "'r8_' || q || '_' || r"


def cells_sql(source: str) -> str:
    """Rows of ``source`` (with lon and lat) with q, r and cell_id."""
    return f"SELECT *, {CELL_SQL} AS cell_id FROM ({axial_sql('(' + project_sql(source) + ')')})"


def _extent_range() -> tuple[int, int, int, int, float, float]:
    """Lattice range (q low, q high, r low, r high) and x range that surely cover the extent."""
    w, s, e, n = EXTENT
    marks = []
    for lo in (w - 0.1, e + 0.8):
        for la in (s - 0.1, n + 0.2):
            phi = math.radians(la)
            sine = geo.ECCENTRICITY * math.sin(phi)
            t = math.tan(math.pi / 4 - phi / 2) / ((1 - sine) / (1 + sine)) ** (geo.ECCENTRICITY / 2)
            rho, theta = geo.CONE_AF * t**geo.CONE_N, geo.CONE_N * math.radians(lo - geo.ORIGIN_LON)
            x, y = 6200000 + rho * math.sin(theta), 3000000 + geo.CONE_RHO0 - rho * math.cos(theta)
            marks.append(((math.sqrt(3) / 3 * x - y / 3) / EDGE, 2 / 3 * y / EDGE, x))
    qs, rs, xs = zip(*marks)
    return (math.floor(min(qs)) - 3, math.ceil(max(qs)) + 3, math.floor(min(rs)) - 3, math.ceil(max(rs)) + 3,
            min(xs) - 3 * EDGE, max(xs) + 3 * EDGE)


_Q0, _Q1, _R0, _R1, _X0, _X1 = _extent_range()
_SQ3 = f"{math.sqrt(3)!r}::DOUBLE"

SQL: dict[str, str] = {}

SQL["obs"] = """
SELECT event_type AS station_id, date_trunc('hour', ts)::TIMESTAMP AS timestamp,
  (10 + min(event_id) % 30)::DOUBLE AS temperature_c,
  (30 + max(user_id) % 70)::DOUBLE AS relative_humidity,
  (CASE WHEN max(event_id) % 11 = 0 THEN NULL WHEN max(event_id) % 7 = 0 THEN 2.5 ELSE 0 END)::DOUBLE AS precip_mm
FROM events GROUP BY 1, 2"""

SQL["buildings"] = f"""
SELECT p_partkey AS objectid, 1500 + p_partkey * 37 % 700 AS year_built,
  {sql_lon('p_partkey')} AS lon, {sql_lat('p_partkey')} AS lat FROM part"""

SQL["u_places"] = f"""
SELECT 'u' || k AS cell_id, k, x + 0.013737::DOUBLE AS x, y + 0.007131::DOUBLE AS y, (k % 5 + 2)::DOUBLE / 100::DOUBLE AS w, (k % 4 + 2)::DOUBLE / 100::DOUBLE AS h
FROM (SELECT s_suppkey::BIGINT AS k, {sql_lon('s_suppkey')} AS x, {sql_lat('s_suppkey')} AS y FROM supplier)"""

SQL["requests"] = f"""
SELECT k AS request_id, west, south, west + (k % 70 - 5)::DOUBLE / 100::DOUBLE AS east,
  south + (k % 9 - 1)::DOUBLE / 100::DOUBLE AS north, (k % 50 + 1)::INT AS max_features,
  CASE WHEN k % 3 = 0 THEN (20 + k % 25)::DOUBLE END AS sim_temperature_c,
  CASE WHEN k % 4 = 0 THEN (k % 101)::DOUBLE END AS sim_relative_humidity,
  CASE WHEN k % 5 = 0 THEN (k % 40)::DOUBLE END AS sim_dry_days
FROM (SELECT s_suppkey::BIGINT AS k, {sql_lon('s_suppkey')} AS west, {sql_lat('s_suppkey')} AS south FROM supplier)"""

_OUTSIDE = "NOT (west BETWEEN -76.35 AND -75.50 AND east BETWEEN -76.35 AND -75.50 AND south BETWEEN 45.25 AND 45.60 AND north BETWEEN 45.25 AND 45.60)"
SQL["accepted"] = f"""
SELECT * FROM requests WHERE west < east AND south < north
  AND east - west <= 0.5 AND north - south <= 0.5 AND NOT ({_OUTSIDE})"""

SQL["scored"] = "SELECT (l_returnflag = 'R')::INT AS label, round(l_discount * 10, 1) / 10 AS score FROM lineitem"
SQL["scored_fine"] = "SELECT (l_returnflag = 'R')::INT AS label, l_extendedprice / 1000000::DOUBLE AS score FROM lineitem"


def points_sql(name: str, key: str) -> str:
    return f"SELECT {key}::BIGINT AS objectid, {sql_lon(key)} AS lon, {sql_lat(key)} AS lat FROM {name}"


def legs_sql(name: str = "customer", key: str = "c_custkey", shift: int = 0) -> str:
    """Both straight legs of each line in metres, as start p and vector v."""
    vertices = f"""
SELECT objectid, i, CASE WHEN i = 0 THEN x0 ELSE x0 + dx END AS lon,
  CASE WHEN i = 1 THEN y0 + dy ELSE y0 END AS lat
FROM (SELECT k AS objectid, {sql_lon('k')} AS x0, {sql_lat('k')} AS y0,
        (k * 31 % 200 - 100)::DOUBLE / 10000::DOUBLE AS dx, (k * 17 % 200 - 100)::DOUBLE / 10000::DOUBLE AS dy
      FROM (SELECT {key}::BIGINT + {shift} AS k FROM {name})), range(3) AS s(i)"""
    return f"""
SELECT a.objectid, a.i, a.x AS px, a.y AS py, b.x - a.x AS vx, b.y - a.y AS vy
FROM ({project_sql('(' + vertices + ')')}) a JOIN ({project_sql('(' + vertices + ')')}) b
  ON a.objectid = b.objectid AND b.i = a.i + 1"""


# Every lattice cell around the extent, with its centre.
SQL["universe"] = f"""
SELECT *, {CELL_SQL} AS cell_id,
  {EDGE!r}::DOUBLE * {_SQ3} * (q + r / 2.0::DOUBLE) AS cx, {EDGE!r}::DOUBLE * 1.5 * r AS cy
FROM (SELECT q::BIGINT AS q, r::BIGINT AS r FROM range({_Q0}, {_Q1}) AS a(q), range({_R0}, {_R1}) AS b(r))
WHERE {EDGE!r}::DOUBLE * {_SQ3} * (q + r / 2.0::DOUBLE) BETWEEN {_X0!r}::DOUBLE AND {_X1!r}::DOUBLE"""

# The six corners of each cell in degrees.
SQL["corners"] = unproject_sql(
    f"(SELECT cell_id, k, cx + {EDGE!r}::DOUBLE * cos(radians(30 + 60*k)) AS x, "
    f"cy + {EDGE!r}::DOUBLE * sin(radians(30 + 60*k)) AS y FROM universe, range(6) AS s(k))"
)

SQL["boxes"] = """
SELECT cell_id, min(lon) AS lon_min, min(lat) AS lat_min, max(lon) AS lon_max, max(lat) AS lat_max
FROM corners GROUP BY cell_id"""

# Edge k of each cell as outward normal and offset: outside is nx*lon + ny*lat > d.
SQL["edges"] = """
SELECT a.cell_id, a.k, b.lat - a.lat AS nx, a.lon - b.lon AS ny,
  (b.lat - a.lat) * a.lon + (a.lon - b.lon) * a.lat AS d
FROM corners a JOIN corners b ON a.cell_id = b.cell_id AND b.k = (a.k + 1) % 6"""

SQL["centroids"] = unproject_sql("(SELECT cell_id, cx AS x, cy AS y FROM universe)", lon_name="centroid_lon", lat_name="centroid_lat")

SQL["grid"] = f"SELECT DISTINCT cell_id FROM ({cells_sql('(' + points_sql('customer', 'c_custkey') + ')')})"

# Accepted request boxes with the cells whose polygon they meet: no edge has the whole box outside.
SQL["met"] = """
SELECT a.*, m.cell_id FROM accepted a JOIN (
  SELECT a.request_id, b.cell_id FROM accepted a JOIN boxes b
    ON b.lon_min <= a.east AND b.lon_max >= a.west AND b.lat_min <= a.north AND b.lat_max >= a.south
  JOIN edges e ON e.cell_id = b.cell_id GROUP BY 1, 2
  HAVING bool_and(least(e.nx*a.west, e.nx*a.east) + least(e.ny*a.south, e.ny*a.north) <= e.d)) m USING (request_id)"""


def clip_sql(legs: str, kind: str) -> str:
    """Kilometres and line counts per universe cell, clipping whole legs by six half-planes."""
    h = f"{EDGE * math.sqrt(3) / 2!r}::DOUBLE"
    far = f"{EDGE!r}::DOUBLE"
    return f"""
SELECT cell_id, sum(km) AS line_length_km_{kind}, count(DISTINCT objectid) AS line_count_{kind}
FROM (SELECT cell_id, objectid, i,
        greatest(0, min(CASE WHEN den > 0 THEN least(1, num/den) ELSE 1 END)
          - max(CASE WHEN den < 0 THEN greatest(0, num/den) ELSE 0 END)) * any_value(len) / 1000 AS km,
        bool_or(den = 0 AND num < 0) AS missed
      FROM (SELECT u.cell_id, g.objectid, g.i, sqrt(g.vx*g.vx + g.vy*g.vy) AS len,
              {h} - (cos(radians(60*k))*(g.px - u.cx) + sin(radians(60*k))*(g.py - u.cy)) AS num,
              cos(radians(60*k))*g.vx + sin(radians(60*k))*g.vy AS den
            FROM ({legs}) g JOIN universe u
              ON u.cx BETWEEN least(g.px, g.px + g.vx) - {far} AND greatest(g.px, g.px + g.vx) + {far}
             AND u.cy BETWEEN least(g.py, g.py + g.vy) - {far} AND greatest(g.py, g.py + g.vy) + {far},
            range(6) AS s(k))
      GROUP BY cell_id, objectid, i)
WHERE km > 0 AND NOT missed GROUP BY cell_id"""


SQL["water"] = clip_sql(legs_sql(), "water")
SQL["road"] = clip_sql(legs_sql("supplier", "s_suppkey", 50000), "road")

SQL["vintage"] = f"""
SELECT cell_id, count(DISTINCT objectid) AS building_count, median(year_built::DOUBLE) AS median_year_built,
  avg((year_built < 1980)::INT) AS pct_pre_1980
FROM ({cells_sql('buildings')}) WHERE year_built BETWEEN 1600 AND 2100 GROUP BY cell_id"""

SQL["cell_table"] = """
SELECT g.cell_id, c.centroid_lat, c.centroid_lon,
  coalesce(w.line_length_km_water, 0) AS line_length_km_water, coalesce(w.line_count_water, 0)::INT AS line_count_water,
  coalesce(r.line_length_km_road, 0) AS line_length_km_road, coalesce(r.line_count_road, 0)::INT AS line_count_road,
  coalesce(v.building_count, 0)::INT AS building_count, coalesce(v.median_year_built, 1980) AS median_year_built,
  coalesce(v.pct_pre_1980, 0) AS pct_pre_1980
FROM grid g JOIN centroids c USING (cell_id) LEFT JOIN water w USING (cell_id)
LEFT JOIN road r USING (cell_id) LEFT JOIN vintage v USING (cell_id)"""



def heat_sql(t: str, h: str) -> str:
    f = f"({t} * 9 / 5 + 32)"
    return f"""(CASE WHEN {t} IS NULL OR {h} IS NULL THEN NULL WHEN {f} < 80 THEN {t} ELSE
  ((-42.379::DOUBLE + 2.04901523::DOUBLE*{f} + 10.14333127::DOUBLE*{h} - 0.22475541::DOUBLE*{f}*{h}
   - 0.00683783::DOUBLE*{f}*{f} - 0.05481717::DOUBLE*{h}*{h} + 0.00122874::DOUBLE*{f}*{f}*{h}
   + 0.00085282::DOUBLE*{f}*{h}*{h} - 0.00000199::DOUBLE*{f}*{f}*{h}*{h}) - 32) * 5 / 9 END)"""


def back_sql(hours: int) -> str:
    return (
        "OVER (PARTITION BY station_id ORDER BY timestamp RANGE BETWEEN "
        f"(INTERVAL '{hours} hours' - INTERVAL '1 microsecond') PRECEDING AND CURRENT ROW)"
    )


_DRY = "(precip_mm IS NOT NULL AND precip_mm < 0.2)"
SQL["streak"] = f"""
SELECT *, CASE WHEN dry THEN sum(dry::INT) OVER (PARTITION BY station_id, island ORDER BY timestamp) ELSE 0 END::INT AS consecutive_dry_hours
FROM (SELECT *, sum(reset::INT) OVER (PARTITION BY station_id ORDER BY timestamp) AS island
      FROM (SELECT *, {_DRY} AS dry, NOT {_DRY} OR coalesce(timestamp - lag(timestamp) OVER
              (PARTITION BY station_id ORDER BY timestamp) <> INTERVAL '1 hour', true) AS reset FROM obs))"""

SQL["weather"] = f"""
SELECT o.station_id, o.timestamp, o.temperature_c, o.relative_humidity, o.precip_mm,
  o.temperature_c - b24.temperature_c AS temp_delta_24h, o.temperature_c - b48.temperature_c AS temp_delta_48h,
  o.temp_max_24h, o.temp_max_48h, o.temp_min_24h, o.heat_index_c, o.heat_index_max_24h, o.heat_index_max_48h,
  o.dry::INT AS is_dry_hour, o.consecutive_dry_hours, o.consecutive_dry_hours / 24::DOUBLE AS consecutive_dry_days,
  o.rainfall_24h, o.rainfall_48h, o.rainfall_7d,
  o.relative_humidity - b24.relative_humidity AS humidity_delta_24h, o.humidity_min_24h
FROM (SELECT *, max(heat_index_c) {back_sql(24)} AS heat_index_max_24h, max(heat_index_c) {back_sql(48)} AS heat_index_max_48h,
        max(temperature_c) {back_sql(24)} AS temp_max_24h, max(temperature_c) {back_sql(48)} AS temp_max_48h,
        min(temperature_c) {back_sql(24)} AS temp_min_24h, min(relative_humidity) {back_sql(24)} AS humidity_min_24h,
        sum(coalesce(precip_mm, 0)) {back_sql(24)} AS rainfall_24h, sum(coalesce(precip_mm, 0)) {back_sql(48)} AS rainfall_48h,
        sum(coalesce(precip_mm, 0)) {back_sql(168)} AS rainfall_7d
      FROM (SELECT *, {heat_sql('temperature_c', 'relative_humidity')} AS heat_index_c FROM streak)) o
LEFT JOIN obs b24 ON b24.station_id = o.station_id AND b24.timestamp = o.timestamp - INTERVAL '24 hours'
LEFT JOIN obs b48 ON b48.station_id = o.station_id AND b48.timestamp = o.timestamp - INTERVAL '48 hours'"""

DAY_COLUMNS = (
    "temperature_c", "relative_humidity", "precip_mm", "heat_index_c", "temp_max_24h", "temp_max_48h", "temp_min_24h",
    "heat_index_max_24h", "heat_index_max_48h", "temp_delta_24h", "temp_delta_48h", "is_dry_hour",
    "consecutive_dry_hours", "consecutive_dry_days", "rainfall_24h", "rainfall_48h", "rainfall_7d",
    "humidity_delta_24h", "humidity_min_24h",
)
_LAST = ", ".join(f"arg_max({c}, timestamp) FILTER ({c} IS NOT NULL) AS {c}" for c in DAY_COLUMNS)
SQL["days"] = f"""
SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) AS rk
  FROM (SELECT station_id, date_trunc('day', timestamp)::TIMESTAMP AS timestamp, {_LAST}
        FROM (SELECT station_id, timestamp AS timestamp, * EXCLUDE (station_id, timestamp) FROM weather)
        GROUP BY station_id, date_trunc('day', timestamp))) WHERE rk <= 92"""

_NAMES = ", ".join(f"'{s}'" for s in STATIONS)
SQL["stationed"] = f"""
SELECT t.*, list_extract([{_NAMES}], (((u.q*3 + u.r) % 5 + 5) % 5 + 1)::INT) AS station_id
FROM cell_table t JOIN universe u USING (cell_id)"""
SQL["matrix"] = "SELECT s.*, d.* EXCLUDE (station_id) FROM stationed s JOIN days d USING (station_id)"

NEEDS = {
    "accepted": ["requests"], "corners": ["universe"], "boxes": ["corners"], "edges": ["corners"],
    "centroids": ["universe"], "met": ["accepted", "boxes", "edges"], "water": ["universe"], "road": ["universe"],
    "vintage": ["buildings"], "cell_table": ["grid", "centroids", "water", "road", "vintage"],
    "streak": ["obs"], "weather": ["obs", "streak"], "days": ["weather"],
    "stationed": ["cell_table", "universe"], "matrix": ["stationed", "days"],
}


def with_views(*names: str) -> str:
    """WITH clause that defines the named views and what they need, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{name} AS ({SQL[name].strip()})" for name in ordered) + "\n"

"""Queries that answer tables of map, cell and what-if requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.constants import AGGREGATE_FEATURE_COLUMNS
from cellweft.functions.display import asset_class, bbox_problem, density_class, risk_band, vintage_split
from cellweft.functions.geo import cell_parts
from cellweft.operators import keys, serve, windows
from cellweft.operators.layers import points_in_cells
from cellweft.plans import inputs
from cellweft.plans.inputs import cells_sql, heat_sql, points_sql, with_views
from cellweft.plans.registry import query
from cellweft.plans.space_queries import cell_table, grid, vintage
from cellweft.plans.weather_queries import rounded

# A stand-in score from the cell's place, so that answers do not hang on a trained model.
_SCORE_SQL = "((((q * 31 + r * 17) % 1000 + 1000) % 1000)::DOUBLE / 1000::DOUBLE)"


def _score():
    _, q, r = cell_parts(F.col("cell_id"))
    return F.pmod(q * 31 + r * 17, F.lit(1000)) / 1000.0


def scored_cells(spark, folder) -> DataFrame:
    """Requests with their first cells, the cell features and a score."""
    requests = inputs.requests(spark, folder)
    shown = serve.first_cells(serve.bbox_cells(requests, grid(spark, folder)))
    joined = shown.join(cell_table(spark, folder), "cell_id", "left")
    return joined.withColumn("risk_score", _score())


_GRID_MET = "met JOIN grid USING (cell_id)"
_SHOWN = f"""shown AS (SELECT * EXCLUDE (rk) FROM (SELECT met.*, row_number() OVER (PARTITION BY request_id ORDER BY cell_id) AS rk,
  count(*) OVER (PARTITION BY request_id) > max_features AS truncated FROM {_GRID_MET}) WHERE rk <= max_features),
scored_cells AS (SELECT s.*, {_SCORE_SQL} AS risk_score, t.* EXCLUDE (cell_id)
  FROM shown s JOIN universe u USING (cell_id) JOIN cell_table t USING (cell_id))
"""


def _scored_sql() -> str:
    return with_views("met", "grid", "universe", "cell_table").rstrip() + ",\n" + _SHOWN


@query("validate_bbox", with_views("requests") + """
SELECT request_id, CASE WHEN west >= east THEN 'west is not below east' WHEN south >= north THEN 'south is not below north'
  WHEN east - west > 0.5 OR north - south > 0.5 THEN 'box spans too many degrees'
  WHEN west < -76.35 OR east > -75.50 OR south < 45.25 OR north > 45.60 THEN 'box leaves the service area' END AS problem
FROM requests""")
def validate_bbox(spark, folder):
    problem = bbox_problem(*[F.col(c) for c in serve.BOX])
    return inputs.requests(spark, folder).select("request_id", problem.alias("problem"))


@query("bbox_cells", with_views("met", "grid") + f"SELECT request_id, cell_id FROM {_GRID_MET}")
def bbox_cells(spark, folder):
    return serve.bbox_cells(inputs.requests(spark, folder), grid(spark, folder)).select("request_id", "cell_id")


@query("bbox_cells_concave", with_views("accepted", "u_places") + """
SELECT request_id, cell_id FROM accepted JOIN u_places ON west <= x + w AND east >= x AND south <= y + h AND north >= y
  AND (south <= y + h / 3 OR west <= x + w / 6 OR east >= x + w * 4 / 6)""")
def bbox_cells_concave(spark, folder):
    """A box within the gap of a U does not meet it."""
    found = serve.bbox_cells(inputs.requests(spark, folder), inputs.u_shapes(spark, folder))
    return found.select("request_id", "cell_id")


@query("bbox_topn", with_views("met", "grid").rstrip() + ",\n" + _SHOWN.split(",\nscored_cells")[0] + """
SELECT request_id, cell_id, truncated FROM shown""")
def bbox_topn(spark, folder):
    found = serve.bbox_cells(inputs.requests(spark, folder), grid(spark, folder))
    return serve.first_cells(found).select("request_id", "cell_id", "truncated")


@query("cell_lookup", with_views("grid", "vintage").rstrip() + f""",
asked AS (SELECT DISTINCT cell_id FROM ({cells_sql('(' + points_sql('orders', 'o_orderkey') + ')')}))
SELECT cell_id, CASE WHEN g.cell_id IS NULL THEN 'unknown' WHEN v.cell_id IS NULL THEN 'empty' ELSE 'found' END AS status,
  CASE WHEN g.cell_id IS NOT NULL THEN building_count END AS building_count,
  CASE WHEN g.cell_id IS NOT NULL THEN median_year_built END AS median_year_built
FROM asked LEFT JOIN grid g USING (cell_id) LEFT JOIN vintage v USING (cell_id)""")
def cell_lookup(spark, folder):
    asked = points_in_cells(inputs.points(spark, folder, "orders", "o_orderkey"))
    known = vintage(spark, folder).select("cell_id", "building_count", "median_year_built")
    return keys.cell_lookup(asked, grid(spark, folder), known)


_CHANGED = "(sim_temperature_c IS NOT NULL OR sim_relative_humidity IS NOT NULL)"
_NOW_T, _NOW_H = "coalesce(sim_temperature_c, temperature_c)", "coalesce(sim_relative_humidity, relative_humidity)"


@query("what_if", with_views("met", "grid", "universe", "weather").rstrip() + f""",
latest AS (SELECT * FROM weather QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) = 1),
asked AS (SELECT met.request_id, met.cell_id, sim_temperature_c, sim_relative_humidity, sim_dry_days,
  list_extract(['click', 'error', 'purchase', 'signup', 'view'], (((q*3 + r) % 5 + 5) % 5 + 1)::INT) AS station_id
  FROM {_GRID_MET} JOIN universe USING (cell_id))
SELECT request_id, cell_id, {_NOW_T} AS temperature_c, {_NOW_H} AS relative_humidity,
  coalesce(sim_temperature_c, temp_max_24h) AS temp_max_24h, coalesce(sim_temperature_c, temp_max_48h) AS temp_max_48h,
  temp_min_24h, round(coalesce(sim_dry_days, consecutive_dry_days), 6) AS consecutive_dry_days, consecutive_dry_hours,
  round(CASE WHEN {_CHANGED} THEN {heat_sql(_NOW_T, _NOW_H)} ELSE heat_index_c END, 6) AS heat_index_c,
  round(CASE WHEN {_CHANGED} THEN {heat_sql(_NOW_T, _NOW_H)} ELSE heat_index_max_48h END, 6) AS heat_index_max_48h
FROM asked JOIN latest USING (station_id)""")
def what_if(spark, folder):
    found = serve.bbox_cells(inputs.requests(spark, folder), grid(spark, folder))
    _, q, r = cell_parts(F.col("cell_id"))
    asked = found.withColumn("station_id", inputs.station_of(q, r))
    latest = keys.latest_per_key(windows.weather_features(inputs.obs(spark, folder)), ["station_id"], "timestamp")
    changed = serve.apply_scenario(serve.with_weather(asked, latest))
    columns = ("temperature_c", "relative_humidity", "temp_max_24h", "temp_max_48h", "temp_min_24h", "consecutive_dry_days",
               "consecutive_dry_hours", "heat_index_c", "heat_index_max_48h")
    return rounded(changed.select("request_id", "cell_id", *columns), "consecutive_dry_days", "heat_index_c", "heat_index_max_48h")


@query("risk_band", with_views("universe", "grid") + f"""
SELECT cell_id, {_SCORE_SQL} AS risk_score, CASE WHEN {_SCORE_SQL} >= 0.7 THEN 'high' ELSE 'medium' END AS risk_level
FROM grid JOIN universe USING (cell_id) WHERE {_SCORE_SQL} >= 0.3""")
def bands(spark, folder):
    scored = grid(spark, folder).select("cell_id", _score().alias("risk_score"))
    return serve.at_least(scored, 0.3).withColumn("risk_level", risk_band(F.col("risk_score")))


@query("risk_summary", _scored_sql() + """
SELECT request_id, count(*) AS cells, count(*) FILTER (WHERE risk_score >= 0.7) AS high_cells, round(avg(risk_score), 9) AS mean_risk,
  max(risk_score) AS max_risk FROM scored_cells GROUP BY 1""")
def risk_summary(spark, folder):
    # Nine places: means of up to 50 three-place scores then never fall between two results.
    summary = serve.risk_summary(scored_cells(spark, folder))
    return summary.withColumn("mean_risk", F.round("mean_risk", 9))


@query("geojson_rows", _scored_sql() + """
SELECT request_id, cell_id, 'Polygon' AS shape, 7 AS corners, risk_score, CASE WHEN risk_score >= 0.7 THEN 'high' WHEN risk_score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level,
  round_even(line_length_km_water, 2) AS water_km, round_even(pct_pre_1980 * 100, 1) AS vintage_pre1980_pct, 'synthetic' AS target_mode
FROM scored_cells""")
def geojson_rows(spark, folder):
    """Features are made as text and read back field by field, which is what a client sees."""
    scored = scored_cells(spark, folder).withColumns({"target_mode": F.lit("synthetic"), "model_version": F.lit("stand-in")})
    schema = """type string, geometry struct<type: string, coordinates: array<array<array<double>>>>,
      properties struct<cell_id: string, risk_score: double, risk_level: string, water_km: double,
        vintage_pre1980_pct: double, target_mode: string>"""
    parsed = serve.geojson_features(scored).select("request_id", F.from_json("feature", schema).alias("f"))
    return parsed.select(
        "request_id", "f.properties.cell_id", F.col("f.geometry.type").alias("shape"),
        F.size(F.col("f.geometry.coordinates")[0]).alias("corners"), "f.properties.risk_score", "f.properties.risk_level",
        "f.properties.water_km", "f.properties.vintage_pre1980_pct", "f.properties.target_mode",
    )


@query("collection_metadata", with_views("met", "grid").rstrip() + ",\n" + _SHOWN.split(",\nscored_cells")[0] + """
SELECT request_id, count(s.cell_id) AS feature_count, coalesce(bool_or(s.truncated), false) AS truncated,
  any_value(coalesce(a.sim_temperature_c, a.sim_relative_humidity, a.sim_dry_days) IS NOT NULL) AS scenario_applied,
  'synthetic' AS target_mode, 'stand-in' AS model_version
FROM accepted a LEFT JOIN shown s USING (request_id) GROUP BY request_id""")
def collection_metadata(spark, folder):
    requests = inputs.requests(spark, folder)
    shown = serve.first_cells(serve.bbox_cells(requests, grid(spark, folder)))
    return serve.collection_metadata(requests, shown, "synthetic", "stand-in")


_REASON = """CASE WHEN west >= east THEN 'west is not below east' WHEN south >= north THEN 'south is not below north'
  WHEN east - west > 0.5 OR north - south > 0.5 THEN 'box spans too many degrees'
  WHEN west < -76.35 OR east > -75.50 OR south < 45.25 OR north > 45.60 THEN 'box leaves the service area' {more}END"""


@query("request_answers", with_views("met", "grid").rstrip() + ",\n" + _SHOWN.split(",\nscored_cells")[0] + f"""
SELECT request_id, CASE WHEN reason IS NULL THEN 'answered' ELSE 'refused' END AS status, reason,
  CASE WHEN reason IS NULL THEN coalesce(n, 0) ELSE 0 END AS feature_count
FROM (SELECT request_id, {_REASON.format(more="WHEN request_id % 7 = 0 THEN 'max_features is outside its range' ")} AS reason FROM requests)
  LEFT JOIN (SELECT request_id, count(*) AS n FROM shown GROUP BY 1) USING (request_id)""")
def request_answers(spark, folder):
    """Every request gets a row; one in seven asks for no features and is refused for it."""
    limit = F.when(F.col("request_id") % 7 == 0, 0).otherwise(F.col("max_features"))
    requests = inputs.requests(spark, folder).withColumn("max_features", limit)
    accepted = requests.filter(serve.request_problem().isNull())
    shown = serve.first_cells(serve.bbox_cells(accepted, grid(spark, folder)))
    answers = serve.request_answers(requests, serve.collection_metadata(accepted, shown))
    return answers.select("request_id", "status", "reason", "feature_count")


@query("cell_profile", with_views("cell_table") + """
SELECT cell_id, CASE WHEN b >= 130 THEN 'dense urban core' WHEN b >= 40 THEN 'suburban medium density' ELSE 'low density fringe' END AS density,
  CASE WHEN b > 90 AND line_length_km_water > 3 THEN 'high asset concentration' ELSE 'moderate asset density' END AS assets,
  round(pct_pre_1980 * 100, 6) AS pre_pct, round(greatest(0, 100 - pct_pre_1980 * 100), 6) AS post_pct
FROM (SELECT *, building_count * 30 AS b FROM cell_table)""")
def cell_profile(spark, folder):
    b, share = F.col("building_count") * 30, F.col("pct_pre_1980")
    before, after = vintage_split(share)
    rows = cell_table(spark, folder).select(
        "cell_id", density_class(b).alias("density"), asset_class(b, F.col("line_length_km_water")).alias("assets"),
        before.alias("pre_pct"), after.alias("post_pct"),
    )
    return rounded(rows, "pre_pct", "post_pct")


@query("allowed_features", with_views("cell_table") + "SELECT cell_id, " + ", ".join(
    f"round({c}, 6) AS {c}" if c in {"centroid_lat", "centroid_lon", "line_length_km_water", "line_length_km_road", "pct_pre_1980"}
    else c for c in AGGREGATE_FEATURE_COLUMNS if c != "line_count_road") + " FROM cell_table")
def allowed_features(spark, folder):
    """A table with a private column and one text column where a number belongs."""
    cells = cell_table(spark, folder).withColumns({
        "private_note": F.lit("not shown"), "line_count_road": F.col("line_count_road").cast("string")})
    kept = serve.allowed_features(cells)
    doubles = [c for c in kept if dict(cells.dtypes)[c] == "double" and c != "median_year_built"]
    return rounded(cells.select("cell_id", *kept), *doubles)

"""Queries on the plane, the lattice and the layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.functions import geo
from cellweft.functions.display import clamp_bbox
from cellweft.operators import features, lattice, layers, rings
from cellweft.operators.serve import request_problem
from cellweft.plans import inputs
from cellweft.plans.inputs import EDGE, cells_sql, points_sql, project_sql, sql_lat, sql_lon, with_views
from cellweft.plans.registry import query
from cellweft.plans.weather_queries import rounded

_ORDER_POINTS = "(" + points_sql("orders", "o_orderkey") + ")"


def grid(spark, folder) -> DataFrame:
    """Cells that hold a customer point, as a grid table."""
    cells = layers.points_in_cells(inputs.points(spark, folder, "customer", "c_custkey"))
    return lattice.cell_boundary(cells.select("cell_id").distinct())


def water(spark, folder) -> DataFrame:
    return layers.line_density(inputs.lines(spark, folder), "water")


def roads(spark, folder) -> DataFrame:
    return layers.line_density(inputs.lines(spark, folder, "supplier", "s_suppkey", 50000), "road")


def vintage(spark, folder) -> DataFrame:
    return layers.building_features(layers.points_in_cells(layers.building_rows(inputs.buildings(spark, folder))))


def cell_table(spark, folder) -> DataFrame:
    return features.cell_features(
        grid(spark, folder), water(spark, folder), roads(spark, folder), vintage(spark, folder)
    )


@query("project_lcc", f"""
SELECT objectid, round(x, 4) AS x, round(y, 4) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({project_sql(_ORDER_POINTS)})""")
def project_lcc(spark, folder):
    points = inputs.points(spark, folder, "orders", "o_orderkey")
    x, y = geo.to_metric("lon", "lat")
    placed = points.select("objectid", x.alias("x"), y.alias("y"))
    angle, half = geo.to_polar("x", "y")
    placed = placed.withColumns({"angle": angle, "half": half})
    back_lon, back_lat = geo.polar_degrees("angle", "half")
    return placed.select(
        "objectid", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"),
        F.round(back_lon, 6).alias("lon"), F.round(back_lat, 6).alias("lat"),
    )


@query("point_to_cell", f"SELECT objectid, cell_id FROM ({cells_sql(_ORDER_POINTS)})")
def point_to_cell(spark, folder):
    placed = lattice.with_cell(inputs.points(spark, folder, "orders", "o_orderkey"))
    return placed.select("objectid", "cell_id")


@query("points_in_cells", f"SELECT cell_id, count(*) AS points, min(objectid) AS first_id FROM ({cells_sql(_ORDER_POINTS)}) GROUP BY 1")
def points_in_cells(spark, folder):
    placed = layers.points_in_cells(inputs.points(spark, folder, "orders", "o_orderkey"))
    return placed.groupBy("cell_id").agg(F.count("*").alias("points"), F.min("objectid").alias("first_id"))


_IN_POLYGONS = with_views("grid", "boxes", "edges") + f"""
SELECT p.objectid, b.cell_id FROM {_ORDER_POINTS} p JOIN boxes b
  ON p.lon BETWEEN b.lon_min AND b.lon_max AND p.lat BETWEEN b.lat_min AND b.lat_max
JOIN grid g ON g.cell_id = b.cell_id JOIN edges e ON e.cell_id = b.cell_id
GROUP BY 1, 2 HAVING bool_and(e.nx*p.lon + e.ny*p.lat < e.d)"""


@query("points_in_polygons", _IN_POLYGONS)
def points_in_polygons(spark, folder):
    points = inputs.points(spark, folder, "orders", "o_orderkey")
    return layers.points_in_polygons(points, grid(spark, folder)).select("objectid", "cell_id")


@query("points_in_polygons_hot", _IN_POLYGONS)
def points_in_polygons_hot(spark, folder):
    """The same with bins of a tenth of a degree, crowded on both sides, and a small limit, so that bins are split."""
    points = inputs.points(spark, folder, "orders", "o_orderkey")
    placed = layers.points_in_polygons(points, grid(spark, folder), bin_size=0.1, min_rows=16)
    return placed.select("objectid", "cell_id")


@query("cell_boundary", with_views("grid", "corners", "centroids") + """
SELECT cell_id, k, round(lon, 6) AS lon, round(lat, 6) AS lat, round(centroid_lon, 6) AS centroid_lon, round(centroid_lat, 6) AS centroid_lat
FROM corners JOIN grid USING (cell_id) JOIN centroids USING (cell_id)
UNION ALL SELECT cell_id, 6, round(lon, 6), round(lat, 6), round(centroid_lon, 6), round(centroid_lat, 6)
FROM corners JOIN grid USING (cell_id) JOIN centroids USING (cell_id) WHERE k = 0""")
def cell_boundary(spark, folder):
    corners = grid(spark, folder).select("cell_id", "centroid_lon", "centroid_lat", F.posexplode("geometry").alias("k", "c"))
    rows = corners.select("cell_id", F.col("k").cast("bigint").alias("k"), F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"),
                          "centroid_lon", "centroid_lat")
    return rounded(rows, "lon", "lat", "centroid_lon", "centroid_lat")


@query("cell_neighbors", with_views("grid", "universe") + f"""
SELECT a.cell_id, b.cell_id AS neighbor_id FROM (SELECT *, unnest([-1, 0, 1]) AS dr FROM (
  SELECT *, unnest([-1, 0, 1]) AS dq FROM grid JOIN universe USING (cell_id))) a
JOIN universe b ON b.q = a.q + dq AND b.r = a.r + dr
WHERE sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) < 2 * {EDGE!r}::DOUBLE""")
def cell_neighbors(spark, folder):
    return lattice.cell_neighbors(grid(spark, folder))


@query("grid_fill", with_views("met", "centroids") + """
SELECT cell_id, 8 AS resolution, round(centroid_lat, 6) AS centroid_lat, round(centroid_lon, 6) AS centroid_lon
FROM (SELECT DISTINCT cell_id FROM met) JOIN centroids USING (cell_id)""")
def grid_fill(spark, folder):
    boxes = inputs.requests(spark, folder).filter(request_problem(None).isNull())
    cells = lattice.grid_fill(boxes).select("cell_id", "resolution", "centroid_lat", "centroid_lon")
    return rounded(cells, "centroid_lat", "centroid_lon")


@query("edge_length", with_views("grid") + """
SELECT cell_id, resolution, CASE WHEN resolution <= 15 THEN round(0.531414010::DOUBLE * pow(7::DOUBLE, (8 - resolution) / 2::DOUBLE), 9) END AS edge_length_km
FROM grid, (SELECT unnest(range(17))::INT AS resolution)""")
def edge_length(spark, folder):
    resolutions = F.explode(F.sequence(F.lit(0), F.lit(16))).alias("resolution")
    rows = lattice.with_edge_length(grid(spark, folder).select("cell_id", resolutions))
    return rows.withColumn("edge_length_km", F.round("edge_length_km", 9))


@query("valid_cell", f"""
SELECT objectid, text, objectid % 4 = 0 AS valid FROM (SELECT objectid, CASE objectid % 4 WHEN 0 THEN cell_id
  WHEN 1 THEN replace(cell_id, 'r8', 'r9') WHEN 2 THEN upper(cell_id) ELSE NULL END AS text FROM ({cells_sql(_ORDER_POINTS)}))""")
def valid_cell(spark, folder):
    placed = lattice.with_cell(inputs.points(spark, folder, "orders", "o_orderkey"))
    kind, cell = F.col("objectid") % 4, F.col("cell_id")
    text = F.when(kind == 0, cell).when(kind == 1, F.replace(cell, F.lit("r8"), F.lit("r9"))).when(kind == 2, F.upper(cell))
    rows = placed.select("objectid", text.alias("text"))
    return rows.withColumn("valid", geo.is_cell(F.col("text"), 8))


_KITES = f"""
SELECT k AS objectid, x, y, (k % 5 + 1)::DOUBLE / 100::DOUBLE AS w, (k % 3 + 1)::DOUBLE / 100::DOUBLE AS h
FROM (SELECT p_partkey AS k, {sql_lon('p_partkey')} AS x, {sql_lat('p_partkey')} AS y FROM part)"""


@query("polygon_point", f"""
SELECT objectid, round((a1*(x + x + w + x)/3 + a2*(x + x + w + x)/3) / (a1 + a2), 6) AS lon,
  round((a1*(y + y + y + h)/3 + a2*(y + y - 2*h + y)/3) / (a1 + a2), 6) AS lat
FROM (SELECT *, w*h/2 AS a1, w*h AS a2 FROM ({_KITES}))""")
def polygon_point(spark, folder):
    """Each part as a kite over its point: corners right, top, left and bottom of the same base."""
    k = F.col("p_partkey")
    x, y = inputs.lon(k), inputs.lat(k)
    w, h = (k % 5 + 1) / 100.0, (k % 3 + 1) / 100.0
    corner = [(x, y - 2 * h), (x + w, y), (x, y + h), (x, y - 2 * h)]
    ring = F.array(*[F.struct(a.alias("lon"), b.alias("lat")) for a, b in corner])
    rows = inputs.table(spark, folder, "part").select(k.alias("objectid"), ring.alias("geometry"))
    return rounded(layers.polygon_point(rows), "lon", "lat").select("objectid", "lon", "lat")


@query("line_density", with_views("water") + "SELECT cell_id, round(line_length_km_water, 6) AS line_length_km_water, line_count_water FROM water")
def line_density(spark, folder):
    return rounded(water(spark, folder), "line_length_km_water")


@query("line_density_polygons", with_views("grid", "water") + """
SELECT cell_id, round(line_length_km_water, 6) AS line_length_km_water, line_count_water FROM water JOIN grid USING (cell_id)""")
def line_density_polygons(spark, folder):
    cells = layers.line_density_on_polygons(inputs.lines(spark, folder), grid(spark, folder), "water")
    return rounded(cells, "line_length_km_water")


_U_VALUES = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(inputs.U_CORNERS))
_U_METRIC = project_sql(f"""(SELECT cell_id, i, x + w * fx / 6 AS lon, y + h * fy / 3 AS lat FROM u_places, (VALUES {_U_VALUES}) AS c(i, fx, fy))""")


# Corners run counter-clockwise, so an edge that the line crosses from its right to its left is where the line enters.
@query("line_density_concave", with_views("u_places").rstrip() + f""",
u_corners AS ({_U_METRIC}),
u_edges AS (SELECT a.cell_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM u_corners a JOIN u_corners b
  ON a.cell_id = b.cell_id AND b.i = (a.i + 1) % 8),
sides AS (SELECT e.*, l.*, vx*(y0 - py) - vy*(x0 - px) AS sa, vx*(y1 - py) - vy*(x1 - px) AS sb,
  ((x0 - px)*(y1 - y0) - (y0 - py)*(x1 - x0)) AS num, vx*(y1 - y0) - vy*(x1 - x0) AS den FROM u_edges e, ({inputs.legs_sql()}) l),
shares AS (SELECT cell_id, objectid, i, any_value(sqrt(vx*vx + vy*vy)) / 1000 * sum(CASE WHEN (x1 - x0)*vy - (y1 - y0)*vx < 0 THEN 1 ELSE -1 END
  * least(1, greatest(0, num / den))) AS km FROM sides WHERE (sa > 0) <> (sb > 0) GROUP BY 1, 2, 3)
SELECT cell_id, round(sum(km), 6) AS line_length_km_water, count(DISTINCT objectid) AS line_count_water FROM shares WHERE km > 0 GROUP BY 1""")
def line_density_concave(spark, folder):
    cells = layers.line_density_on_polygons(inputs.lines(spark, folder), inputs.u_shapes(spark, folder), "water")
    return rounded(cells, "line_length_km_water")


@query("inner_point", with_views("u_places") + """
SELECT cell_id, round(CASE WHEN k % 2 = 1 THEN x + h / 6 ELSE x + w * 5 / 6 END, 6) AS lon,
  round(CASE WHEN k % 2 = 1 THEN y + w * 5 / 12 ELSE y + h * 2 / 3 END, 6) AS lat FROM u_places""")
def inner_point(spark, folder):
    """A U is widest in its right arm; a C, cut at half its height, in its spine."""
    found = rings.inner_point(inputs.u_shapes(spark, folder, turned=True))
    return rounded(found.select("cell_id", "lon", "lat"), "lon", "lat")


@query("building_features", with_views("vintage") + """
SELECT cell_id, building_count, median_year_built, round(pct_pre_1980, 6) AS pct_pre_1980 FROM vintage""")
def building_features(spark, folder):
    return rounded(vintage(spark, folder), "pct_pre_1980")


_CELL_ROUND = ("centroid_lat", "centroid_lon", "line_length_km_water", "line_length_km_road", "pct_pre_1980")


@query("cell_features", with_views("cell_table") + "SELECT * REPLACE (" + ", ".join(
    f"round({c}, 6) AS {c}" for c in _CELL_ROUND) + ") FROM cell_table")
def cell_features(spark, folder):
    return rounded(cell_table(spark, folder), *_CELL_ROUND)


@query("clamp_bbox", """
SELECT request_id, round(greatest(-76.35, least(-75.52, greatest(west, mx - 0.25))), 6) AS west,
  round(greatest(45.25, least(45.58, greatest(south, my - 0.25))), 6) AS south,
  round(least(-75.50, greatest(-76.33, least(east, mx + 0.25))), 6) AS east,
  round(least(45.60, greatest(45.27, least(north, my + 0.25))), 6) AS north
FROM (SELECT *, (west + east) / 2 AS mx, (south + north) / 2 AS my FROM
  (SELECT p_partkey AS request_id, """ + sql_lon("p_partkey") + """ - 0.2 AS west, """ + sql_lat("p_partkey") + """ - 0.2 AS south,
   """ + sql_lon("p_partkey") + """ + (p_partkey % 12)::DOUBLE / 10 AS east, """ + sql_lat("p_partkey") + """ + (p_partkey % 7)::DOUBLE / 10 AS north FROM part))""")
def clamp(spark, folder):
    k = F.col("p_partkey")
    views = inputs.table(spark, folder, "part").select(
        k.alias("request_id"), (inputs.lon(k) - 0.2).alias("west"), (inputs.lat(k) - 0.2).alias("south"),
        (inputs.lon(k) + (k % 12) / 10.0).alias("east"), (inputs.lat(k) + (k % 7) / 10.0).alias("north"),
    )
    clipped = clamp_bbox(*[F.col(c) for c in ("west", "south", "east", "north")])
    return rounded(views.withColumns(clipped), *clipped)

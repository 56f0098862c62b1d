import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.constants import EXTENT
from cellweft.errors import DataError
from cellweft.functions import geo
from cellweft.operators import joins, lattice, layers
from cellweft.operators import rings as rings_of
from cellweft.plans import inputs

BOX_RING = [(-75.71, 45.41), (-75.69, 45.41), (-75.69, 45.43), (-75.71, 45.43), (-75.71, 45.41)]


def points(spark, n=4000, seed=1, box=EXTENT):
    rng = np.random.default_rng(seed)
    w, s, e, north = box
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(w, e, n), rng.uniform(s, north, n), strict=True))]
    return spark.createDataFrame(rows, "objectid bigint, lon double, lat double")


def lines(spark, *paths):
    rows = [(i, [{"lon": x, "lat": y} for x, y in path]) for i, path in enumerate(paths)]
    return spark.createDataFrame(rows, "objectid bigint, geometry array<struct<lon:double,lat:double>>")


def polygons(spark, *rings):
    rows = [(f"p{i}", [{"lon": x, "lat": y} for x, y in ring], min(x for x, _ in ring), min(y for _, y in ring),
             max(x for x, _ in ring), max(y for _, y in ring)) for i, ring in enumerate(rings)]
    return spark.createDataFrame(rows, "cell_id string, geometry array<struct<lon:double,lat:double>>, "
                                       "lon_min double, lat_min double, lon_max double, lat_max double")


def test_projection_round_trip(spark):
    x, y = geo.to_metric("lon", "lat")
    df = points(spark, box=(-140.0, 42.0, -52.0, 83.0)).select("lon", "lat", x.alias("x"), y.alias("y"))
    angle, half = geo.to_polar("x", "y")
    df = df.withColumns({"angle": angle, "half": half})
    lon, lat = geo.polar_degrees("angle", "half")
    worst = df.select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
    assert max(worst) < 1e-12


def test_projection_scale_near_the_extent(spark):
    """About 1.5 percent over ground length at this latitude, as this projection has."""
    df = spark.createDataFrame([(-75.7, 45.42), (-75.7, 45.43)], "lon double, lat double")
    x, y = geo.to_metric("lon", "lat")
    (x0, y0), (x1, y1) = df.select(x, y).collect()
    ground = 6378137 * (1 - geo.ECCENTRICITY**2) / (1 - (geo.ECCENTRICITY * math.sin(math.radians(45.425))) ** 2) ** 1.5 * math.radians(0.01)
    assert math.hypot(x1 - x0, y1 - y0) / ground == pytest.approx(1.0154, abs=2e-4)


def test_cell_is_the_one_with_the_nearest_centre(spark):
    """Brute force over the centres of a whole small area."""
    box = (-75.8, 45.35, -75.7, 45.42)
    placed = lattice.with_cell(points(spark, 1500, 2, box))
    x, y = geo.to_metric("lon", "lat")
    got = placed.select("cell_id", x.alias("x"), y.alias("y")).collect()
    boxes = spark.createDataFrame([box], "west double, south double, east double, north double")
    cx, cy = geo.centre("q", "r", 8)
    _, q, r = geo.cell_parts(F.col("cell_id"))
    cells = lattice.grid_fill(boxes).select("cell_id", q.alias("q"), r.alias("r")).select("cell_id", cx.alias("x"), cy.alias("y")).collect()
    centres = np.array([(c["x"], c["y"]) for c in cells])
    for row in got:
        near = np.hypot(centres[:, 0] - row["x"], centres[:, 1] - row["y"]).argmin()
        assert cells[near]["cell_id"] == row["cell_id"]


def test_grid_covers_the_box_and_nothing_else(spark):
    box = (-75.72, 45.40, -75.68, 45.44)
    boxes = spark.createDataFrame([box], "west double, south double, east double, north double")
    grid = lattice.grid_fill(boxes)
    cells = {r["cell_id"] for r in grid.collect()}
    held = {r["cell_id"] for r in lattice.with_cell(points(spark, 6000, 3, box)).select("cell_id").distinct().collect()}
    assert held <= cells
    assert len(cells) == grid.count()
    far = grid.filter((F.col("lon_min") > box[2]) | (F.col("lon_max") < box[0]) | (F.col("lat_min") > box[3]) | (F.col("lat_max") < box[1]))
    assert far.isEmpty()
    bad = spark.createDataFrame([(-75.0, 45.0, -76.0, 46.0)], "west double, south double, east double, north double")
    with pytest.raises(DataError, match="corners"):
        lattice.grid_fill(bad)


def test_neighbours_are_mutual_and_six(spark):
    cells = spark.createDataFrame([("r8_10_-3",)], "cell_id string")
    near = [r["neighbor_id"] for r in lattice.cell_neighbors(cells, with_self=False).collect()]
    assert len(set(near)) == 6
    back = lattice.cell_neighbors(spark.createDataFrame([(c,) for c in near], "cell_id string"))
    assert back.filter("neighbor_id = 'r8_10_-3'").count() == 6


def test_cell_ids(spark):
    df = spark.createDataFrame([("r8_1_-2",), ("r9_1_2",), ("r8_1",), ("R8_1_2",), (None,)], "c string")
    assert [r[0] for r in df.select(geo.is_cell(F.col("c"), 8)).collect()] == [True, False, False, False, False]
    for bad in (-1, 16):
        with pytest.raises(ValueError, match="resolution"):
            geo.edge_km(bad)
    assert geo.edge_km(9) == pytest.approx(geo.edge_km(8) / math.sqrt(7))


def test_points_outside_the_world_have_no_cell(spark):
    df = spark.createDataFrame([(1, 181.0, 45.0), (2, -75.0, 91.0), (3, -75.0, 45.0)], "objectid bigint, lon double, lat double")
    assert [r["objectid"] for r in layers.points_in_cells(df).collect()] == [3]


@pytest.mark.parametrize("min_rows", [1, 1_000_000])
def test_points_in_polygons_match_brute_force(spark, min_rows):
    kite = [(-75.9, 45.3), (-75.7, 45.35), (-75.65, 45.5), (-75.95, 45.45), (-75.9, 45.3)]
    df = points(spark, 1500, 4)
    pairs = layers.points_in_polygons(df, polygons(spark, BOX_RING, kite), min_rows=min_rows)
    got = {(r["objectid"], r["cell_id"]) for r in pairs.collect()}
    want = set()
    for row in df.collect():
        for name, ring in (("p0", BOX_RING), ("p1", kite)):
            turns = [(bx - ax) * (row["lat"] - ay) - (by - ay) * (row["lon"] - ax)
                     for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False)]
            if all(t > 0 for t in turns):
                want.add((row["objectid"], name))
    assert got == want and pairs.count() == len(want) > 50


def test_boundary_points_are_outside(spark):
    df = spark.createDataFrame([(1, -75.71, 45.42), (2, -75.70, 45.43), (3, -75.69, 45.41), (4, -75.70, 45.42)],
                               "objectid bigint, lon double, lat double")
    assert [r["objectid"] for r in layers.points_in_polygons(df, polygons(spark, BOX_RING)).collect()] == [4]


def test_long_line_is_clipped_to_the_cell(spark):
    line = lines(spark, [(-76.2, 45.42), (-75.2, 45.42)])
    row = layers.line_density_on_polygons(line, polygons(spark, BOX_RING)).first()
    whole = sum(r["line_length_km_water"] for r in layers.line_density(line).collect())
    assert 0 < row["line_length_km_water"] < whole / 10
    assert row["line_length_km_water"] == pytest.approx(whole / 50, rel=1e-3)
    assert row["line_count_water"] == 1


def test_clipped_lengths_add_up_and_polygons_agree(spark):
    rng = np.random.default_rng(6)
    paths = [[(float(x), float(y)) for x, y in zip(rng.uniform(-76.0, -75.8, 4), rng.uniform(45.3, 45.4, 4), strict=True)] for _ in range(20)]
    df = lines(spark, *paths, [(-75.9, 45.35), (-75.9, 45.35)])
    cells = layers.line_density(df, "road")
    total = cells.agg(F.sum("line_length_km_road")).first()[0]
    whole = layers.line_pieces(df, 1e9).select(F.sum(F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)) / 1000).first()[0]
    assert total == pytest.approx(whole, rel=1e-9)
    assert cells.agg(F.max("line_count_road")).first()[0] <= 20
    grid = lattice.cell_boundary(cells)
    other = {r[0]: (r[1], r[2]) for r in layers.line_density_on_polygons(df, grid, "road", bin_m=1500.0).collect()}
    for row in cells.collect():
        if row["line_length_km_road"] > 1e-6:
            assert other[row["cell_id"]][0] == pytest.approx(row["line_length_km_road"], abs=1e-6)
    with pytest.raises(ValueError, match="kind"):
        layers.line_density(df, "rail")


def test_median_year_of_crowded_cells(spark):
    """Fractional years, even and odd counts, repeated years, and buildings without a year, against the plain median."""
    from statistics import median

    years = {"crowd": [1900 + k * 0.013 for k in range(5_001)] + [1950.5] * 7, "even": [1920.25, 1990.5, 1990.5, 2001.0],
             "one": [1979.75], "part": [None, 1960.0, 1970.0, None], "none": [None]}
    rows = [(cell, k, y) for cell, known in years.items() for k, y in enumerate(known)]
    placed = spark.createDataFrame(rows, "cell_id string, objectid int, year_built double")
    got = {r["cell_id"]: r for r in layers.building_features(placed).collect()}
    assert set(got) == set(years)
    for cell, listed in years.items():
        known = [y for y in listed if y is not None]
        assert got[cell]["building_count"] == len(listed)
        assert got[cell]["median_year_built"] == (pytest.approx(median(known), abs=1e-9) if known else None)
        assert got[cell]["pct_pre_1980"] == pytest.approx(sum(y < 1980 for y in known) / len(listed))


def test_building_features(spark):
    rows = [(1, "1965", -75.70, 45.42), (2, "1995", -75.70, 45.42), (3, "1500", -75.70, 45.42), (4, "old", -75.70, 45.42)]
    df = spark.createDataFrame(rows, "objectid bigint, year_built string, lon double, lat double")
    out = layers.building_features(layers.points_in_cells(layers.building_rows(df))).collect()
    assert [tuple(r)[1:] for r in out] == [(2, 1980.0, 0.5)]
    twice = layers.building_rows(df.filter("objectid <= 2").union(df.filter("objectid = 1")))
    out = layers.building_features(layers.points_in_cells(twice)).first()
    assert (out["building_count"], out["median_year_built"]) == (2, 1965.0)
    assert out["pct_pre_1980"] == pytest.approx(2 / 3)


def test_polygon_point(spark):
    row = layers.polygon_point(polygons(spark, BOX_RING).select("cell_id", "geometry")).first()
    assert (row["lon"], row["lat"]) == (pytest.approx(-75.70), pytest.approx(45.42))


def test_salted_join_equals_plain_join(spark):
    """One key owns most rows; a small limit splits it into many salts."""
    left = spark.range(5000).select("id", F.when(F.col("id") % 5 < 4, 0).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    twice = right.union(right.filter("k = 0"))
    hot = joins.hot_keys(left, twice, ["k"], min_rows=100)
    assert hot.filter("k = 0").first()["_left_salts"] == 40
    got = joins.salted_join(left, twice, ["k"], min_rows=100)
    want = left.join(twice, "k")
    assert got.count() == want.count()
    assert got.select(*want.columns).exceptAll(want).isEmpty()
    # However small the floor, fewer than 10,000 keys can hold over a 10,000th of the rows.
    many = spark.range(30000).select((F.col("id") % 15000).alias("k"))
    assert joins.hot_keys(many, many, ["k"], min_rows=0).count() < joins.MAX_HOT_KEYS


def test_box_join_gives_each_pair_once(spark):
    def boxes(n, seed):
        g = np.random.default_rng(seed)
        x, y, w, h = g.uniform(-3, 3, n), g.uniform(-3, 3, n), g.uniform(0, 1, n), g.uniform(0, 1, n)
        return [(i, float(a), float(b), float(a + c), float(b + d)) for i, (a, b, c, d) in enumerate(zip(x, y, w, h, strict=True))]

    a, b = boxes(150, 9), boxes(120, 10)
    left = spark.createDataFrame(a, "a bigint, x0 double, y0 double, x1 double, y1 double")
    right = spark.createDataFrame(b, "b bigint, u0 double, v0 double, u1 double, v1 double")
    got = [(r["a"], r["b"]) for r in joins.box_join(left, right, ("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1"), 0.3).collect()]
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want


def test_box_join_of_very_different_sizes(spark):
    """Boxes from a point to a thousand bins: each pair once, and at most four rows a box on its own level."""
    def boxes(n, seed):
        g = np.random.default_rng(seed)
        size = 10 ** g.uniform(-3, 2, n) * g.integers(0, 2, n)
        x, y = g.uniform(-30, 30, n), g.uniform(-30, 30, n)
        return [(i, float(a), float(b), float(a + s), float(b + s / 3)) for i, (a, b, s) in enumerate(zip(x, y, size, strict=True))]

    a, b = boxes(200, 3), boxes(200, 4)
    left = spark.createDataFrame(a, "a bigint, x0 double, y0 double, x1 double, y1 double")
    right = spark.createDataFrame(b, "b bigint, u0 double, v0 double, u1 double, v1 double")
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    for span, rows in ((None, 1_000_000), (100.0, 5)):
        joined = joins.box_join(left, right, ("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1"), 0.1, rows, left_span=span)
        got = [(r["a"], r["b"]) for r in joined.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert sorted(joined.columns) == sorted(left.columns + right.columns)
    spread = joins._spread(right, ("u0", "v0", "u1", "v1"), 0.1, joins._level(("u0", "v0", "u1", "v1"), 0.1), [])
    assert spread.groupBy("b").count().agg(F.max("count")).first()[0] <= 4
    wide = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0)], "u0 double, v0 double, u1 double, v1 double")
    box = ("u0", "v0", "u1", "v1")
    assert joins._spread(wide, box, 0.0125, joins._level(box, 0.0125), []).count() <= 4


def test_salted_join_splits_keys_crowded_on_the_right(spark):
    left = spark.range(60).select((F.col("id") % 6).alias("k"), F.col("id").alias("a"))
    right = spark.range(3000).select(F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 9).alias("k"), F.col("id").alias("b"))
    hot = {r["k"]: (r["_left_salts"], r["_right_salts"]) for r in joins.hot_keys(left, right, ["k"], min_rows=500).collect()}
    assert hot == {1: (1, 4)}
    got = joins.salted_join(left, right, ["k"], min_rows=500)
    want = left.join(right, "k")
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).isEmpty()
    assert sorted(got.columns) == ["a", "b", "k"]


def test_lines_are_dealt_before_they_are_cut(spark):
    """Lines of one file are not cut in one task: a shuffle of whole lines stands below the list of their legs."""
    plan = layers.line_pieces(lines(spark, [(-75.7, 45.4), (-75.6, 45.4)]), 500.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("RepartitionByExpression") > plan.rindex("explode")


def u_rings(seed, n):
    """Closed U shapes of random size near one place, every second one clockwise."""
    rng = np.random.default_rng(seed)
    rings = []
    for i in range(n):
        x, y, w, h = rng.uniform(-75.72, -75.70), rng.uniform(45.40, 45.42), rng.uniform(0.02, 0.06), rng.uniform(0.02, 0.05)
        ring = [(float(x + w * a / 6), float(y + h * b / 3)) for a, b in (*inputs.U_CORNERS, inputs.U_CORNERS[0])]
        rings.append(ring[::-1] if i % 2 else ring)
    return rings


def near_paths(seed, n, corners=3, step=0.004):
    rng = np.random.default_rng(seed)
    starts = zip(rng.uniform(-75.71, -75.68, n), rng.uniform(45.41, 45.43, n), strict=True)
    return [[(float(x + a), float(y + b)) for a, b in np.cumsum(rng.uniform(-step, step, (corners, 2)), axis=0)] for x, y in starts]


def shuffled_rows(plan):
    """Rows that each exchange of an executed plan wrote."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled_rows(plan.plan())
    own = [plan.metrics().apply("shuffleRecordsWritten").value()] if name == "ShuffleExchangeExec" else []
    below = plan.children()
    return own + [n for i in range(below.length()) for n in shuffled_rows(below.apply(i))]


def test_pairs_of_lines_and_concave_cells_are_counted_where_they_are_made(spark):
    """Cells that overlap meet the same lines many times over: no exchange writes a row per pair."""
    found = layers.line_density_on_polygons(lines(spark, *near_paths(1, 250)), polygons(spark, *u_rings(2, 60)))
    pairs = sum(r["line_count_water"] for r in found.collect())
    rows = shuffled_rows(found._jdf.queryExecution().executedPlan())
    assert pairs > 5_000 and len(rows) > 2 and max(rows) < pairs / 2


def test_step_of_pairs_is_compiled(spark):
    """The JVM compiles no method of more than 8,000 bytes; an interpreted pair costs some 25 times as much."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = layers.line_density_on_polygons(lines(spark, *near_paths(1, 250)), polygons(spark, *u_rings(2, 60))).select("*")
        code = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8_000


def test_repeated_and_missing_ids_beside_rings_of_every_kind(spark):
    """Lines and cells that share an id or have none, long legs, points and gaps, against a join of every piece with every ring."""
    rng = np.random.default_rng(3)
    turns = np.sort(rng.uniform(0, 2 * np.pi, 12))
    star = [(float(-75.69 + r * np.cos(a)), float(45.42 + r * np.sin(a) / 2)) for a, r in zip(turns, rng.uniform(0.005, 0.03, 12), strict=True)]
    rings = [*u_rings(4, 12), BOX_RING, [*star, star[0]]]
    names = [f"p{i}" for i in range(9)] + ["p0", None, None, "box", "p1"]
    shapes = spark.createDataFrame(list(zip(names, rings, strict=True)), "cell_id string, geometry array<struct<lon:double,lat:double>>")
    paths = [*near_paths(5, 40), *near_paths(6, 10, corners=6, step=0.02), *near_paths(7, 3, corners=1), [], [(-75.8, 45.41), (-75.6, 45.43)],
             [(-75.70, 45.42), None, (-75.69, 45.43), (-75.69, 45.43), (-75.68, 45.40), (-75.60, 45.41)]]
    ids = [None if i % 9 == 4 else i % 30 for i in range(len(paths))]
    df = spark.createDataFrame([(k, path) for k, path in zip(ids, paths, strict=True)], "objectid bigint, geometry array<struct<lon:double,lat:double>>")
    edges = layers.metric_polygons(shapes).select("cell_id", "_edges")
    met = layers.line_pieces(df, 500.0).crossJoin(edges).select("cell_id", "objectid", (rings_of.share_inside("_edges") * F.sqrt(
        F.col("vx") ** 2 + F.col("vy") ** 2) / 1000).alias("km")).filter("km > 1e-12")
    want = {r[0]: (r[1], r[2]) for r in met.groupBy("cell_id").agg(F.sum("km"), F.count_distinct("objectid")).collect()}
    got = {r[0]: (r[1], r[2]) for r in layers.line_density_on_polygons(df, shapes).collect()}
    assert got.keys() == want.keys() and None in got
    for name, (km, count) in want.items():
        assert got[name][0] == pytest.approx(km, abs=1e-9) and got[name][1] == count, name
    assert layers.line_density_on_polygons(df.limit(0), shapes).isEmpty() and layers.line_density_on_polygons(df, shapes.limit(0)).isEmpty()

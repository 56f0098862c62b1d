"""Rings that can't be used: counted by reason, left out, or refused."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellweft.operators import layers, rings as ring_tests

RING = "cell_id string, geometry array<struct<lon:double,lat:double>>"
SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
NOTCHED = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]


def polygons(spark, rings):
    rows = spark.createDataFrame(list(rings.items()), RING)
    box = {f"{c}_{end}": fn(F.col(f"geometry.{c}")) for c in ("lon", "lat")
           for end, fn in (("min", F.array_min), ("max", F.array_max))}
    return rows.withColumns(box)


def test_reasons(spark):
    rings = {"square": SQUARE, "wise": SQUARE[::-1], "straight": [(0.0, 0.0), (1.0, 0.0), *SQUARE[1:]], "one": [(1.0, 1.0)],
             "empty": [], "null": None, "open": SQUARE[:-1], "flat": [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)],
             "notched": NOTCHED}
    rows = polygons(spark, rings)
    found = {r[0]: r[1] for r in rows.select("cell_id", ring_tests.ring_problem()).collect()}
    assert found == {"square": None, "wise": None, "straight": None, "one": "points", "empty": "points", "null": "points",
                     "open": "open", "flat": "area", "notched": "concave"}
    assert {r.reason: r.polygons for r in ring_tests.ring_report(rows).collect()} == {
        "points": 3, "open": 1, "area": 1, "concave": 1}


def test_points_skip_rings_without_area_and_take_concave_ones(spark):
    rows = polygons(spark, {"square": SQUARE, "one": [(1.0, 1.0)], "notched": NOTCHED})
    points = spark.createDataFrame([(1, 1.0, 1.5), (2, 2.0, 3.0)], "id int, lon double, lat double")
    found = layers.points_in_polygons(points, rows, bin_size=1.0).select("id", "cell_id").collect()
    assert sorted(map(tuple, found)) == [(1, "notched"), (1, "square")]


U_SHAPE = [(-75.75, 45.40), (-75.69, 45.40), (-75.69, 45.44), (-75.71, 45.44), (-75.71, 45.42), (-75.73, 45.42), (-75.73, 45.44),
           (-75.75, 45.44), (-75.75, 45.40)]


def test_lines_are_cut_by_concave_rings(spark):
    """A line through both arms of a U counts in the arms, not in the gap; two arms of 0.02 degrees of 1.56 km."""
    lines = spark.createDataFrame([(1, [(-75.80, 45.43), (-75.60, 45.43)]), (2, [(-75.72, 45.43), (-75.72, 45.50)])],
                                  "objectid int, geometry array<struct<lon:double,lat:double>>")
    for ring in (U_SHAPE, U_SHAPE[::-1]):
        found = layers.line_density_on_polygons(lines, polygons(spark, {"u": ring})).collect()
        assert [(r["cell_id"], r["line_count_water"]) for r in found] == [("u", 1)]
        assert found[0]["line_length_km_water"] == pytest.approx(3.12, abs=0.06)


def plain_holds(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def star(rng, corners):
    """A simple ring around the origin: random reach at increasing angles, mostly concave."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    ring = [(r * math.cos(a), r * math.sin(a)) for a in angles for r in [rng.uniform(0.2, 3)]]
    return [*ring, ring[0]]


def test_point_inside_and_share_of_random_concave_rings(spark):
    rng = random.Random(4)
    shapes = {f"s{i}": star(rng, rng.randint(7, 20)) for i in range(60)}
    shapes |= {"flat": [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)], "open": SQUARE[:-1], "null": None, "u": U_SHAPE, "notched": NOTCHED}
    rows = polygons(spark, shapes)
    found = {r.cell_id: (r.lon, r.lat) for r in ring_tests.inner_point(rows).collect()}
    for name, ring in shapes.items():
        if name in ("flat", "open", "null"):
            assert found[name] == (None, None)
        else:
            assert plain_holds(ring, *found[name]), name
    shares = rows.filter("cell_id LIKE 's%'").withColumn("_edges", ring_tests.ring_edges("geometry")).withColumns(
        {"px": F.lit(-2.0), "py": F.lit(0.3), "vx": F.lit(4.0), "vy": F.lit(-0.7)})
    for r in shares.select("cell_id", ring_tests.share_inside("_edges").alias("share")).collect():
        steps = 4000
        held = sum(plain_holds(shapes[r.cell_id], -2 + 4 * (i + 0.5) / steps, 0.3 - 0.7 * (i + 0.5) / steps) for i in range(steps))
        assert r.share == pytest.approx(held / steps, abs=0.003)


def test_box_meets_concave_ring(spark):
    """Boxes in the gap of a U meet nothing; those that touch an arm, lie in one or hold the ring do."""
    boxes = {"gap": (1.5, 2.5, 2.5, 3.0), "arm": (0.2, 2.0, 0.5, 2.5), "around": (-9.0, -9.0, 9.0, 9.0), "touch": (-1.0, -1.0, 0.0, 0.0),
             "apart": (5.0, 5.0, 6.0, 6.0), "across": (-1.0, 2.0, 5.0, 2.1)}
    rows = spark.createDataFrame([(k, *v) for k, v in boxes.items()], "name string, west double, south double, east double, north double")
    ring = polygons(spark, {"u": [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (3.0, 4.0), (3.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0), (0.0, 0.0)]})
    both = rows.crossJoin(ring.select(ring_tests.ring_edges("geometry").alias("_edges")))
    met = {r["name"] for r in both.filter(ring_tests.meets_box("_edges", ("west", "south", "east", "north"))).collect()}
    assert met == {"arm", "around", "touch", "across"}


def test_centre_of_a_ring_without_area_is_null(spark):
    rows = polygons(spark, {"square": SQUARE, "flat": [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)], "one": [(1.0, 1.0)]})
    found = {r.cell_id: (r.lon, r.lat) for r in layers.polygon_point(rows).collect()}
    assert found == {"square": (1.0, 1.0), "flat": (None, None), "one": (None, None)}


def test_parts_of_small_concave_rings_hold_what_the_ring_holds(spark):
    """The parts of a ring sum to the alternating sum over its edges; rings that cross themselves or are long stay whole."""
    rng = random.Random(11)
    shapes = {f"s{i}": star(rng, rng.randint(7, 20)) for i in range(40)}
    shapes |= {"bow": [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)], "long": star(rng, ring_tests.MAX_PART_EDGES + 1)}
    rows = polygons(spark, shapes).withColumn("_edges", ring_tests.ring_edges("geometry"))
    cut = ring_tests.level_parts(rows).cache()
    assert {r.cell_id for r in cut.filter("_parts IS NULL").select("cell_id").collect()} == {"bow", "long"}
    legs = spark.createDataFrame([(-2.0, 0.3, 4.0, -0.7), (0.1, -3.0, 0.0, 6.0), (-3.0, 0.2, 6.0, 0.0), (0.2, 0.1, -0.3, 0.2)],
                                 "px double, py double, vx double, vy double")
    pairs = cut.filter("_parts IS NOT NULL").crossJoin(legs)
    whole = {(r.cell_id, r.px): r.share for r in pairs.select("cell_id", "px", ring_tests.share_inside("_edges").alias("share")).collect()}
    parts = pairs.select("cell_id", "px", "py", "vx", "vy", F.inline("_parts")).select("cell_id", "px", ring_tests.share_inside_part().alias("share"))
    found = {(r.cell_id, r.px): r.share for r in parts.groupBy("cell_id", "px").agg(F.sum("share").alias("share")).collect()}
    assert found.keys() == whole.keys()
    for key, share in whole.items():
        assert found[key] == pytest.approx(share, abs=1e-9), key


def test_ring_check_reads_a_made_ring_once(spark):
    """The filter on a ring's problem stands above a generator, so a ring that is computed is not made anew for every corner."""
    corner = [F.struct((F.col("id") + a).alias("lon"), (F.col("id") + b).alias("lat")) for a, b in SQUARE]
    made = spark.range(1).select(F.col("id").cast("string").alias("cell_id"), F.array(*corner).alias("geometry"))
    plan = ring_tests.usable_rings(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("struct(lon") == len(SQUARE)


def test_box_over_all_of_a_ring_one_way_meets_it(spark):
    """Boxes that reach over a U from side to side or from bottom to top are told without its edges; others are left open."""
    boxes = {"across": (-1.0, 2.0, 5.0, 2.1), "upright": (1.9, -1.0, 2.1, 5.0), "gap": (1.5, 2.5, 2.5, 3.0), "above": (-1.0, 5.0, 5.0, 6.0)}
    rows = spark.createDataFrame([(k, *v, 0.0, 4.0, 0.0, 4.0) for k, v in boxes.items()],
                                 "name string, west double, south double, east double, north double, rw double, re double, rs double, rn double")
    told = rows.filter(ring_tests.spans_ring(("west", "south", "east", "north"), ("rw", "re", "rs", "rn")))
    assert {r["name"] for r in told.collect()} == {"across", "upright"}


def test_corners_of_small_rings_give_the_share_of_their_edges(spark):
    """Corners in columns, either way round and with the last one repeated, against the sum over edges; rings that are longer or
    cross themselves have none."""
    rng = random.Random(12)
    shapes = {f"s{i}": star(rng, rng.randint(4, ring_tests.MAX_CORNERS)) for i in range(40)}
    shapes |= {f"{name}r": ring[::-1] for name, ring in shapes.items()} | {"u": U_SHAPE, "long": star(rng, ring_tests.MAX_CORNERS + 1)}
    edges = polygons(spark, shapes).withColumn("_edges", ring_tests.ring_edges("geometry"))
    rows = ring_tests.with_corners(ring_tests.level_parts(edges), "_parts IS NOT NULL").cache()
    without = {r.cell_id for r in rows.filter("_corners IS NULL").collect()}
    assert "long" in without and "u" not in without and len(without) < len(shapes) / 2
    legs = spark.createDataFrame([(-2.0, 0.3, 4.0, -0.7), (0.1, -3.0, 0.0, 6.0), (-3.0, 0.2, 6.0, 0.0), (0.2, 0.1, -0.3, 0.2), (0.05, 0.0, 0.0, 0.0)],
                                 "px double, py double, vx double, vy double")
    sided = ring_tests.with_corner_sides(rows.filter("_corners IS NOT NULL").select("*", *ring_tests.corner_columns()).crossJoin(legs), "leg")
    for r in sided.select("cell_id", "vx", ring_tests.share_inside_corners("leg").alias("got"), ring_tests.share_inside("_edges").alias("want")).collect():
        assert r.got == pytest.approx(r.want, abs=1e-9), (r.cell_id, r.vx)

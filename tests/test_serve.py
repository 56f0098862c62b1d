import json

import pytest
from pyspark.sql import functions as F

from cellweft.errors import DataError
from cellweft.functions.display import bbox_problem, clamp_bbox, risk_band, round_half_even
from cellweft.functions.text import normalize_text
from cellweft.operators import keys, lattice, quality, serve
from cellweft.operators.lattice import grid_fill

BOX_SCHEMA = "request_id bigint, west double, south double, east double, north double, max_features int"


def test_bands(spark):
    df = spark.createDataFrame([(0.70,), (0.69,), (0.30,), (0.29,), (1.2,), (float("nan"),), (None,)], "s double")
    assert [r[0] for r in df.select(risk_band(F.col("s"))).collect()] == ["high", "medium", "medium", "low", None, None, None]


def test_bad_boxes_have_their_own_reason(spark):
    boxes = [(1, -75.6, 45.4, -75.7, 45.5), (2, -75.7, 45.5, -75.6, 45.4), (3, -76.3, 45.3, -75.5, 45.5),
             (4, -75.52, 45.4, -75.4, 45.5), (5, -75.7, 45.4, -75.6, 45.5), (6, None, 45.4, -75.6, 45.5)]
    df = spark.createDataFrame(boxes, "id int, west double, south double, east double, north double")
    reasons = [r[0] for r in df.orderBy("id").select(bbox_problem(*[F.col(c) for c in serve.BOX])).collect()]
    assert reasons == ["west is not below east", "south is not below north", "box spans too many degrees",
                       "box leaves the service area", None, "missing corner"]


def test_clamped_boxes_are_accepted(spark):
    views = [(-80.0, 40.0, -70.0, 50.0), (-75.7, 45.4, -75.6, 45.5), (-75.4, 45.4, -75.2, 45.7), (-76.9, 45.0, -76.5, 45.1)]
    df = spark.createDataFrame(views, "west double, south double, east double, north double")
    clipped = df.withColumns(clamp_bbox(*[F.col(c) for c in serve.BOX]))
    assert clipped.filter(bbox_problem(*[F.col(c) for c in serve.BOX]).isNotNull()).isEmpty()
    assert tuple(clipped.collect()[1]) == pytest.approx(views[1])


def test_first_cells_and_truncation(spark):
    grid = grid_fill(spark.createDataFrame([(-75.75, 45.38, -75.65, 45.46)], "west double, south double, east double, north double"))
    asked = spark.createDataFrame([(1, -75.72, 45.40, -75.68, 45.44, 5), (2, -75.72, 45.40, -75.68, 45.44, 2000),
                                   (3, -75.6, 45.4, -75.7, 45.5, 5)], BOX_SCHEMA)
    found = serve.bbox_cells(asked, grid)
    exact = {r["cell_id"] for r in lattice.grid_fill(asked.filter("request_id = 2")).collect()}
    assert {r["cell_id"] for r in found.filter("request_id = 2").collect()} == exact
    shown = serve.first_cells(found)
    first = [r["cell_id"] for r in shown.filter("request_id = 1").collect()]
    assert sorted(first) == sorted(exact)[:5]
    flags = {r["request_id"]: r["truncated"] for r in shown.select("request_id", "truncated").distinct().collect()}
    assert flags == {1: True, 2: False}
    assert found.count() == found.select("request_id", "cell_id").distinct().count()


def test_what_if_changes_only_its_columns(spark):
    base = dict.fromkeys(("temp_max_24h", "temp_max_48h", "temp_min_24h", "heat_index_c", "heat_index_max_24h",
                          "heat_index_max_48h", "consecutive_dry_days", "consecutive_dry_hours"), 1.0)
    base |= {"temperature_c": 10.0, "relative_humidity": 50.0}
    asks = [(1, None, None, None), (2, 35.0, None, None), (3, None, 80.0, None), (4, None, None, 9.0)]
    df = spark.createDataFrame(asks, "id int, sim_temperature_c double, sim_relative_humidity double, sim_dry_days double")
    df = df.withColumns({c: F.lit(v) for c, v in base.items()})
    rows = {r["id"]: r for r in serve.apply_scenario(df).collect()}
    assert all(rows[1][c] == v for c, v in base.items())
    assert rows[2]["temp_max_48h"] == 35.0 and rows[2]["temp_min_24h"] == 1.0 and rows[2]["heat_index_max_24h"] > 35
    assert rows[3]["heat_index_c"] == 10.0 and rows[3]["relative_humidity"] == 80.0 and rows[3]["temp_max_24h"] == 1.0
    assert rows[4]["consecutive_dry_days"] == 9.0 and rows[4]["heat_index_c"] == 1.0 and rows[4]["consecutive_dry_hours"] == 1.0
    bare = serve.apply_scenario(df.drop("temperature_c", "relative_humidity", "heat_index_c"))
    rows = {r["id"]: r for r in bare.collect()}
    assert rows[1]["temperature_c"] is None and rows[1]["heat_index_c"] is None
    assert rows[3]["heat_index_c"] == 20.0 and rows[2]["relative_humidity"] is None and rows[2]["heat_index_c"] > 35
    bad = spark.createDataFrame([(61.0, None, None), (None, 101.0, None), (None, None, -1.0), (None, 100.0, None)],
                                "sim_temperature_c double, sim_relative_humidity double, sim_dry_days double")
    assert [r[0] is None for r in bad.select(serve.scenario_problem()).collect()] == [False, False, False, True]


def test_cells_without_weather_stay(spark):
    cells = spark.createDataFrame([("a", "1", 5.0), ("b", "2", 6.0)], "cell_id string, station_id string, shared double")
    latest = spark.createDataFrame([("1", 9.0, 20.0)], "station_id string, shared double, temperature_c double")
    rows = {r["cell_id"]: (r["shared"], r["temperature_c"]) for r in serve.with_weather(cells, latest).collect()}
    assert rows == {"a": (9.0, 20.0), "b": (None, None)}


def test_geojson_and_allow_list(spark):
    grid = lattice.cell_boundary(spark.createDataFrame([("r8_5_5",)], "cell_id string"))
    row = grid.select(F.lit(1).alias("request_id"), "cell_id", "geometry", F.lit(0.71239).alias("risk_score"), F.lit(None).cast("double").alias("line_length_km_water"),
                      F.lit(0.4567).alias("pct_pre_1980"), F.lit("synthetic").alias("target_mode"), F.lit("v").alias("model_version"))
    feature = json.loads(serve.geojson_features(row).first()["feature"])
    ring = feature["geometry"]["coordinates"][0]
    assert len(ring) == 7 and ring[0] == ring[-1] and feature["type"] == "Feature"
    assert feature["properties"] == {"cell_id": "r8_5_5", "risk_score": 0.7124, "risk_level": "high", "water_km": 0.0,
                                     "vintage_pre1980_pct": 45.7, "target_mode": "synthetic", "model_version": "v"}
    df = spark.createDataFrame([(1, "x", True, 2.0)], "building_count int, private_note string, line_count_road boolean, pct_pre_1980 double")
    assert serve.allowed_features(df) == ["building_count", "pct_pre_1980"]


def test_lookup_has_three_answers(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "cell_id string")
    grid = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    known = spark.createDataFrame([("a", 3), ("c", 4)], "cell_id string, building_count int")
    rows = {r["cell_id"]: (r["status"], r["building_count"]) for r in keys.cell_lookup(asked, grid, known).collect()}
    assert rows == {"a": ("found", 3), "b": ("empty", None), "c": ("unknown", None)}


def test_one_to_one_refuses_copies(spark):
    one, two = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    assert keys.one_to_one_left(one, one.withColumn("v", F.lit(1)), ["k"]).count() == 1
    for left, right in ((two, one), (one, two)):
        with pytest.raises(DataError, match="duplicate"):
            keys.one_to_one_left(left, right, ["k"])


def test_text_and_rounding(spark):
    df = spark.createDataFrame([(" water   main\t break ",), (None,), ("a  b",)], "t string")
    assert [r[0] for r in df.select(normalize_text(F.col("t"))).collect()] == ["WATER MAIN BREAK", "", "A B"]
    numbers = spark.createDataFrame([(2.5,), (3.5,), (0.125,)], "x double")
    assert [r[0] for r in numbers.select(round_half_even(F.col("x"), 0)).collect()] == [2.0, 4.0, 0.0]


def test_contract_audits(spark):
    good = lattice.cell_boundary(spark.createDataFrame([("r8_5_5",), ("r8_5_6",)], "cell_id string"))
    row = quality.audit_grid(good).first().asDict()
    assert row.pop("row_count") == 2 and set(row.values()) == {0}
    assert quality.audit_grid(good.union(good)).first()["duplicate_keys"] == 2
    scores = spark.createDataFrame([("a", 1.5, "v", "synthetic"), ("b", 0.5, None, "guess")],
                                   "cell_id string, risk_score double, model_version string, target_mode string").withColumn("generated_at", F.current_timestamp())
    row = quality.audit_predictions(scores).first()
    assert (row["check_risk_score"], row["check_target_mode"], row["null_model_version"]) == (1, 1, 1)
    events = spark.createDataFrame([(1, "x" * 101, "", None, "r8_1_1")], "objectid bigint, reqtype string, category string, createddate timestamp, cell_id string")
    row = quality.audit_events(events).first()
    assert (row["check_reqtype_length"], row["null_createddate"], row["check_category_length"]) == (1, 1, 0)
    child = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "cell_id string")
    parent = spark.createDataFrame([("a",)], "cell_id string")
    assert [tuple(r) for r in quality.orphan_keys(child, parent, "cell_id").collect()] == [("z", 1)]
    assert sorted(str(r[0]) for r in quality.delete_orphans(child, parent, "cell_id").collect()) == ["None", "a", "a"]

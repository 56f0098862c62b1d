"""All stages in a row on a small landed data set."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cellweft.errors import DataError
from cellweft.functions.display import is_probability
from cellweft.operators import learn, quality, serve
from cellweft.plans import stages

BOX = (-75.72, 45.40, -75.66, 45.44)
HEADER = "Date/Time (LST),Temp (°C),Rel Hum (%),Precip. Amount (mm)\n"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    start = datetime(2024, 3, 1)
    with open(root / "w.csv", "w", encoding="utf-8") as out:
        out.write(HEADER)
        for i in range(24 * 31):
            rain = 4 if i % 97 == 0 else 0
            out.write(f"{start + timedelta(hours=i):%Y-%m-%d %H:%M},{15 + i % 20},{40 + i % 50},{rain}\n")
    weather = stages.build_weather(spark, {"7": [str(root / "w.csv")]}, str(root / "weather"), "2024-03-01", "2024-03-31")
    grid = stages.build_grid(spark, str(root / "grid"), BOX)

    def line(i, lat):
        return (i, [{"lon": BOX[0], "lat": lat}, {"lon": BOX[2], "lat": lat}])

    schema = "objectid bigint, geometry array<struct<lon:double,lat:double>>"
    water = spark.createDataFrame([line(1, 45.405), line(2, 45.42)], schema)
    roads = spark.createDataFrame([line(3, 45.43)], schema)
    houses = spark.createDataFrame([(i, 1950 + i, -75.71 + i * 0.0005, 45.41 + (i % 5) * 0.005) for i in range(80)],
                                   "objectid bigint, year_built int, lon double, lat double")
    cells = stages.build_cells(spark, grid, water, roads, houses, str(root / "cells"))
    rings = stages.build_cells(spark, grid, water, roads, houses, str(root / "rings"), resolution=None)
    matrix = stages.build_matrix(spark, cells, weather, str(root / "matrix"), "7")
    model = stages.build_model(spark, matrix, str(root / "model"), trees=4)
    return {"root": root, "weather": weather, "grid": grid, "cells": cells, "rings": rings, "matrix": matrix, "model": model}


def test_every_cell_has_a_row_on_lattice_and_rings(spark, built):
    grid, cells, rings = (spark.read.parquet(built[k]) for k in ("grid", "cells", "rings"))
    assert grid.count() == cells.count() == rings.count()
    assert quality.audit_cells(cells).first()["duplicate_keys"] == 0
    both = cells.alias("a").join(rings.alias("b"), "cell_id")
    worst = both.agg(*[F.max(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))) for c in
                       ("line_length_km_water", "line_length_km_road", "building_count", "pct_pre_1980")]).first()
    assert max(worst) < 1e-6
    assert cells.filter("line_length_km_water > 0").count() > 5


def test_metrics_answer_with_and_without_a_model(spark, built):
    told = learn.metrics_answer(spark, built["model"]).collect()
    assert len(told) == 1 and told[0]["metrics"]["training_rows"] == spark.read.parquet(built["matrix"]).count()
    shares = [f["importance"] for f in told[0]["features"]]
    assert 0 < len(shares) <= 10 and shares == sorted(shares, reverse=True)
    assert (told[0]["spatial_resolution"], told[0]["prediction_horizon_hours"]) == ("hexagon resolution 8", 48)
    assert told[0]["target_warning"]
    gone = learn.metrics_answer(spark, str(built["root"] / "no-model"))
    assert gone.schema.simpleString() == learn.metrics_answer(spark, built["model"]).schema.simpleString()
    row = gone.first()
    assert (row["metrics"], row["features"], row["target_warning"]) == (None, [], None)


def test_layers_without_their_columns_are_refused(spark, built):
    out = str(built["root"] / "refused")
    lines = spark.createDataFrame([(1, [{"lon": BOX[0], "lat": 45.41}, {"lon": BOX[2], "lat": 45.41}])],
                                  "objectid bigint, geometry array<struct<lon:double,lat:double>>")
    houses = spark.createDataFrame([(1, 1950, -75.70, 45.42)], "objectid bigint, year_built int, lon double, lat double")
    bad = [((lines.drop("objectid"), lines, houses), "water lines.*objectid"), ((lines, lines.drop("geometry"), houses), "road lines.*geometry"),
           ((lines, lines, houses.drop("year_built")), "buildings.*year_built"), ((lines, lines, houses.drop("lon")), "buildings.*geometry")]
    for layer, match in bad:
        with pytest.raises(DataError, match=match):
            stages.build_cells(spark, built["grid"], *layer, out)
    empty = str(built["root"] / "no-cells")
    spark.read.parquet(built["grid"]).limit(0).write.parquet(empty)
    with pytest.raises(DataError, match="grid"):
        stages.build_cells(spark, empty, lines, lines, houses, out)


def test_empty_layers_leave_defaults_and_rings_count_once(spark, built):
    """Empty layers are fine; a concave building counts in the cell that holds a point inside it."""
    schema = "objectid bigint, geometry array<struct<lon:double,lat:double>>"
    none = spark.createDataFrame([], schema)
    x, y, d = -75.69, 45.42, 0.0004
    ring = [(x, y), (x + 3 * d, y), (x + 3 * d, y + 3 * d), (x + 2 * d, y + 3 * d), (x + 2 * d, y + d), (x + d, y + d), (x + d, y + 3 * d),
            (x, y + 3 * d), (x, y)]
    houses = spark.createDataFrame([(1, 1950.0, ring), (2, float("nan"), ring), (3, 1990.0, ring[:2])],
                                   "objectid bigint, year_built double, geometry array<struct<lon:double,lat:double>>")
    cells = spark.read.parquet(stages.build_cells(spark, built["grid"], none, none, houses, str(built["root"] / "rings-only")))
    assert cells.count() == spark.read.parquet(built["grid"]).count()
    assert [tuple(r) for r in cells.filter("building_count > 0").select("building_count", "median_year_built").collect()] == [(1, 1950.0)]
    assert cells.filter("line_count_water + line_count_road > 0 OR line_length_km_water > 0").isEmpty()


def test_matrix_and_model(spark, built):
    matrix = spark.read.parquet(built["matrix"])
    assert matrix.count() == spark.read.parquet(built["cells"]).count() * 31


def test_requests_are_answered(spark, built):
    schema = "request_id bigint, west double, south double, east double, north double, max_features int, " \
             "sim_temperature_c double, sim_relative_humidity double, sim_dry_days double"
    asked = spark.createDataFrame([(1, *BOX, 10, None, None, None), (2, *BOX, 2000, 35.0, None, 9.0),
                                   (3, BOX[2], BOX[1], BOX[0], BOX[3], 10, None, None, None), (4, *BOX, 10, 99.0, None, None)], schema)
    scored, meta = stages.score_requests(spark, asked, built["grid"], built["cells"], built["weather"], built["model"], "7")
    facts = {r["request_id"]: r for r in meta.collect()}
    assert {k: r["status"] for k, r in facts.items()} == {1: "answered", 2: "answered", 3: "refused", 4: "refused"}
    assert facts[3]["reason"] and facts[4]["reason"] and facts[4]["feature_count"] == 0
    assert facts[1]["feature_count"] == 10 and facts[1]["truncated"] and not facts[1]["scenario_applied"]
    assert facts[2]["scenario_applied"] and not facts[2]["truncated"]
    assert scored.count() == 10 + facts[2]["feature_count"]
    assert scored.filter(~is_probability(F.col("risk_score"))).isEmpty()
    assert serve.geojson_features(scored).count() == scored.count()
    with pytest.raises(DataError, match="duplicate"):
        stages.score_requests(spark, asked.union(asked), built["grid"], built["cells"], built["weather"], built["model"], "7")


def test_single_cells_are_answered(spark, built):
    known = spark.read.parquet(built["cells"]).orderBy("cell_id").first()["cell_id"]
    asked = spark.createDataFrame([(known,), (known,), ("r8_1_1",), ("r9_1_1",), ("cell",)], "cell_id string")
    answers = stages.score_cells(spark, asked, built["grid"], built["cells"], built["weather"], built["model"], "7")
    rows = {r["cell_id"]: r for r in answers.collect()}
    assert {c: r["status"] for c, r in rows.items()} == {known: "found", "r8_1_1": "unknown", "r9_1_1": "invalid", "cell": "invalid"}
    assert 0 <= rows[known]["risk_score"] <= 1 and rows["r8_1_1"]["risk_score"] is None
    assert rows[known]["building_count"] is not None


def test_predictions_are_stored(spark, built):
    path = stages.build_predictions(spark, built["cells"], built["weather"], built["model"], str(built["root"] / "p"), "7")
    stored = spark.read.parquet(path)
    assert stored.count() == spark.read.parquet(built["cells"]).count()
    assert quality.audit_predictions(stored).first()["check_target_mode"] == 0


def test_incomplete_months_stop_the_weather_stage(spark, built):
    files = {"7": [str(built["root"] / "w.csv")]}
    with pytest.raises(DataError, match="1 requested"):
        stages.build_weather(spark, files, str(built["root"] / "w2"), "2024-03-01", "2024-04-10")
    path = stages.build_weather(spark, files, str(built["root"] / "w3"), "2024-03-01", "2024-04-10", allow_partial=True)
    assert spark.read.parquet(path).count() == 24 * 31


def test_a_folder_of_stations_is_read_as_a_whole(spark, built, tmp_path):
    text = (built["root"] / "w.csv").read_text(encoding="utf-8")
    for station in ("7", "8"):
        (tmp_path / "in" / f"station_id={station}").mkdir(parents=True)
        (tmp_path / "in" / f"station_id={station}" / "w.csv").write_text(text, encoding="utf-8")
    path = stages.build_weather(spark, str(tmp_path / "in"), str(tmp_path / "out"), "2024-03-01", "2024-03-31")
    assert {r["station_id"]: r["count"] for r in spark.read.parquet(path).groupBy("station_id").count().collect()} == {"7": 744, "8": 744}


def test_event_stage_caps_before_matching(spark, tmp_path):
    def feature(i, kind):
        return {"attributes": {"objectid": i, "reqtype": kind, "createddate": 1688169600000 + i * 86_400_000}, "geometry": {"x": -75.7, "y": 45.42}}

    (tmp_path / "in").mkdir()
    body = {"features": [feature(1, "OTHER"), feature(2, "MAIN BREAK"), feature(3, "MAIN BREAK")]}
    (tmp_path / "in" / "page_1.json").write_text(json.dumps(body), encoding="utf-8")

    def ids(name, **kw):
        out = stages.build_events(spark, str(tmp_path / "in"), str(tmp_path / name), **kw)
        return sorted(r["objectid"] for r in spark.read.parquet(out).collect())

    assert ids("a") == [2, 3]
    assert ids("b", max_records=2) == [2]
    assert ids("c", start="2023-07-04", end="2023-07-04") == [3]
    (tmp_path / "more").mkdir()
    later = {"features": [feature(3, "WATER BREAK"), feature(4, "MAIN BREAK")]}
    (tmp_path / "more" / "page_1.json").write_text(json.dumps(later), encoding="utf-8")
    out = stages.build_events(spark, str(tmp_path / "more"), str(tmp_path / "merged"), base=str(tmp_path / "a"))
    assert {r["objectid"]: r["reqtype"] for r in spark.read.parquet(out).collect()} == {2: "MAIN BREAK", 3: "WATER BREAK", 4: "MAIN BREAK"}
    with pytest.raises(DataError, match="must differ"):
        stages.build_events(spark, str(tmp_path / "more"), out, base=out)
    with pytest.raises(DataError, match="more than 0 pages"):
        ids("f", max_pages=0)
    (tmp_path / "in" / "page_2.json").write_text(json.dumps(body), encoding="utf-8")
    with pytest.raises(DataError, match="stuck"):
        ids("g")
    (tmp_path / "in" / "page_2.json").write_text('{"error": {"code": 500}}', encoding="utf-8")
    for name, more in (("d", {}), ("e", {"max_records": 2})):
        with pytest.raises(DataError, match="bad pages"):
            ids(name, **more)
        assert not (tmp_path / name).exists()

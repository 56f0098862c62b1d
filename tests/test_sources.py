import json

import pytest
from pyspark.sql import functions as F

from cellweft.errors import DataError, MissingTableError
from cellweft.operators import events, keys
from cellweft.sources import hourly, pages, tables


def feature(objectid, reqtype, created=1651363200000, x=-75.9011, y=45.3302, **more):
    return {"attributes": {"objectid": objectid, "reqtype": reqtype, "category": "WATER", "createddate": created,
                           "description": "free text", **more}, "geometry": {"x": x, "y": y}}


def land(tmp_path, *bodies):
    for i, body in enumerate(bodies):
        text = body if isinstance(body, str) else json.dumps(body, indent=2)
        (tmp_path / f"page_{i + 1}.json").write_text(text, encoding="utf-8")
    return str(tmp_path)


SAMPLE = {"exceededTransferLimit": False, "features": [
    feature(881, "WATER MAIN BREAK"), feature(882, "WATER SERVICE"), feature(883, "GRAFFITI REMOVAL"),
    feature(884, "MAIN BREAK", created="2022-05-19T00:00:00Z")]}


def test_pretty_printed_page_keeps_the_two_breaks(spark, tmp_path):
    rows = pages.page_features(pages.read_pages(spark, land(tmp_path, SAMPLE)))
    kept = events.minimize_events(rows)
    assert kept.columns == list(events.EVENT_COLUMNS)
    found = {r["objectid"]: r for r in kept.collect()}
    assert set(found) == {881, 884}
    assert found[881]["createddate"].isoformat().startswith("2022-05-01")
    assert found[884]["createddate"].isoformat().startswith("2022-05-19")
    assert found[881]["cell_id"].startswith("r8_")


def test_first_arrival_wins_and_reasons_are_counted(spark, tmp_path):
    first = {"features": [feature(1, " water   main break "), feature(None, "MAIN BREAK"), feature(3, "MAIN BREAK", x=0, y=0),
                          {**feature(4, "MAIN BREAK"), "geometry": None}, feature(5, "MAIN BREAK", created="soon"),
                          feature(6, "MAIN BREAK", created=True), feature(7, "", req_type="Water Break"),
                          feature("eight", "MAIN BREAK"), feature(9, "MAIN BREAK", x="east"),
                          feature(10, "MAIN BREAK", x="-75.7", created="2022-05-01")]}
    second = {"features": [feature(1, "MAIN BREAK", created=1)]}
    judged = events.judge_features(pages.page_features(pages.read_pages(spark, land(tmp_path, first, second))))
    report = {r["reason"]: r["rows"] for r in events.reject_report(judged).collect()}
    assert report == {"accepted": 4, "missing objectid": 1, "outside the extent": 1, "no point geometry": 1,
                      "invalid createddate": 2, "invalid objectid": 1, "invalid coordinates": 1}
    kept = {r["objectid"]: r for r in events.accepted_events(judged).collect()}
    assert set(kept) == {1, 7, 10}
    assert kept[1]["reqtype"] == "WATER MAIN BREAK" and kept[1]["createddate"].year == 2022
    assert kept[7]["reqtype"] == ""


def test_envelopes(spark, tmp_path):
    path = land(tmp_path, SAMPLE, {"error": {"code": 499}}, {"features": "none"}, {"features": [7]}, "{not json",
                {"features": [], "error": "text is not an envelope"})
    found = pages.read_pages(spark, path)
    report = {r["problem"]: r["pages"] for r in pages.envelope_report(found).collect()}
    assert report == {"none": 2, "error envelope": 1, "no features list": 1, "feature is not an object": 1,
                      "not a JSON object": 1}
    with pytest.raises(DataError, match="bad pages"):
        pages.require_good_pages(found)


def test_page_audit_sees_a_stuck_source(spark, tmp_path):
    body = {"exceededTransferLimit": True, "features": [feature(1, "A"), feature(2, "B")]}
    last = {"exceededTransferLimit": False, "features": [feature(3, "C")]}
    row = pages.page_audit(pages.read_pages(spark, land(tmp_path, body, body, last)), page_size=2, max_pages=2).first()
    assert (row["pages"], row["features"], row["repeated_pages"], row["pages_after_last"]) == (3, 5, 1, 0)
    assert row["exceeded_transfer_limit"] and row["over_page_cap"]


def test_page_audit_parses_pages_once(spark, tmp_path):
    body = {"exceededTransferLimit": False, "features": [feature(1, "A")]}
    audit = pages.page_audit(pages.read_pages(spark, land(tmp_path, body)), page_size=2)
    assert "json" not in audit._jdf.queryExecution().executedPlan().toString().lower()


HEADER = '"Station Name","Climate ID","Date/Time (LST)","Temp (°C)","Dew Point Temp (°C)","Rel Hum (%)","Precip. Amount (mm)","Wind Spd (km/h)","Stn Press (kPa)"'


def test_hourly_file_with_byte_order_mark(spark, tmp_path):
    text = "﻿" + HEADER + '\r\n"A","61","2022-05-01 00:00","19.7","17.8","89","","13","100.04"\r\n' \
        '"A","61","2022-05-01 01:00","","17.9","91","0.4","13","100.01"\r\n"A","61","never","1","1","1","1","1","1"\r\n'
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    df = hourly.combine_hourly(hourly.read_hourly(spark, str(tmp_path), " 49568 "))
    rows = df.orderBy("timestamp").collect()
    assert df.columns == list(hourly.OBSERVATION_COLUMNS)
    assert len(rows) == 2 and rows[0]["station_id"] == "49568"
    assert rows[0]["temperature_c"] == 19.7 and rows[1]["temperature_c"] is None
    assert rows[0]["precip_mm"] is None and rows[0]["timestamp"].isoformat() == "2022-05-01T00:00:00"


def test_hourly_file_rules(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"Date/Time (LST)","Temp (°C)"\n"2022-05-01 00:00","1"\n', encoding="utf-8")
    with pytest.raises(DataError, match="Rel Hum"):
        hourly.read_hourly(spark, str(tmp_path), "1")
    for bad in ("12a", "١٢", ""):
        with pytest.raises(DataError, match="ASCII digits"):
            hourly.check_station_id(bad)


def test_files_with_other_headers_are_matched_by_name(spark, tmp_path):
    for name, head, row in (("a b", "Temp (°C),Rel Hum (%),Precip. Amount (mm)", "11,51,0"), ("c", "Rel Hum (%),Temp (°C),Precip. Amount (mm),Wind Spd (km/h)", "52,12,1,9")):
        folder = tmp_path / "station_id=049" / name
        folder.mkdir(parents=True)
        (folder / "x.csv").write_text(f"Date/Time (LST),{head}\r\n2022-05-01 0{len(name)}:00,{row}\r\n", encoding="utf-8")
    rows = hourly.read_hourly(spark, [str(tmp_path / "station_id=049" / n / "x.csv") for n in ("a b", "c")]).orderBy("timestamp").collect()
    assert [(r["station_id"], r["temperature_c"], r["relative_humidity"], r["wind_speed_kmh"]) for r in rows] == [
        ("049", 12.0, 52.0, 9.0), ("049", 11.0, 51.0, None)]
    (tmp_path / "bad.csv").write_text("Date/Time (LST),Temp (°C)\n2022-05-01 00:00,1\n", encoding="utf-8")
    with pytest.raises(DataError, match="Rel Hum"):
        hourly.read_hourly(spark, [str(tmp_path / "bad.csv"), str(tmp_path / "station_id=049" / "c")], "1")


def test_first_file_wins_on_a_shared_hour(spark, tmp_path):
    parts = []
    for name, t in (("a", "1.0"), ("b", "2.0")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text(HEADER + f'\n"A","61","2022-05-01 00:00","{t}","","50","0","",""\n', encoding="utf-8")
        parts.append(hourly.read_hourly(spark, str(tmp_path / name), "1"))
    assert [r["temperature_c"] for r in hourly.combine_hourly(*parts).collect()] == [1.0]
    assert [r["temperature_c"] for r in hourly.combine_hourly(*reversed(parts)).collect()] == [2.0]


def test_months(spark):
    ranges = spark.sql("SELECT '7' AS station_id, DATE'2023-12-01' AS start_date, DATE'2024-02-15' AS end_date")
    months = hourly.month_periods(ranges)
    assert [str(r["month"]) for r in months.orderBy("month").collect()] == ["2023-12-01", "2024-01-01", "2024-02-01"]
    with pytest.raises(DataError, match="on or after"):
        hourly.month_periods(ranges.withColumn("end_date", F.lit("2023-11-30").cast("date")))
    seen = spark.sql("SELECT '7' AS station_id, TIMESTAMP_NTZ'2024-01-05 00:00:00' AS timestamp")
    assert hourly.missing_months(months, seen).count() == 2
    with pytest.raises(DataError, match="2 requested"):
        hourly.require_complete(months, seen)
    assert hourly.require_complete(months, seen, allow_partial=True) is seen


def test_required_tables(spark, tmp_path):
    with pytest.raises(MissingTableError, match="cannot be read"):
        tables.require_table(spark, str(tmp_path / "none"), "grid")
    path = tables.write_table(spark.range(3), str(tmp_path / "t"), order=["id"])
    assert tables.require_table(spark, path, "t", ["id"]).count() == 3
    with pytest.raises(DataError, match="missing columns"):
        tables.require_table(spark, path, "t", ["other"])
    empty = tables.write_table(spark.range(0), str(tmp_path / "e"))
    with pytest.raises(MissingTableError, match="empty"):
        tables.require_table(spark, empty, "e")


def test_upsert_replaces_and_inserts(spark, tmp_path):
    base = tables.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), str(tmp_path / "b"))
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, at int")
    out = tables.upsert_table(spark, base, new, ["k"], order=["at"], out_path=str(tmp_path / "o"))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_date_range_rules():
    for start, end, word in (("2024-01-01' OR 1=1 --", None, "YYYY-MM-DD"), ("2024-02-01", "2024-01-01", "on or after")):
        with pytest.raises(DataError, match=word):
            events.date_range("createddate", start, end)


def test_merge_rewrites_only_touched_folders(spark, tmp_path):
    from pathlib import Path
    base = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    path = tables.write_keyed(base, str(tmp_path / "keyed"), "k div 100")
    files = lambda: {str(f.relative_to(path)) for f in Path(path).rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(5, "new"), (7, "new"), (950, "new"), (2001, "new")], "k bigint, v string")
    assert tables.merge_keyed(spark, path, new, ["k"], "k div 100") == 3
    after = files()
    touched = {f"{tables.PART}={n}" for n in (0, 9, 20)}
    assert {f for f in before if f.split("/")[0] not in touched} == {f for f in after if f.split("/")[0] not in touched}
    assert not {f for f in before if f.split("/")[0] in touched} & after
    rows = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert len(rows) == 1001 and {k for k, v in rows.items() if v == "new"} == {5, 7, 950, 2001}
    with pytest.raises(DataError, match="duplicate"):
        tables.merge_keyed(spark, path, new.union(new), ["k"], "k div 100")
    with pytest.raises(DataError, match="null"):
        tables.merge_keyed(spark, path, spark.createDataFrame([(None, "x")], "k bigint, v string"), ["k"], "k div 100")
    assert tables.merge_keyed(spark, path, new.limit(0), ["k"], "k div 100") == 0
    assert spark.read.parquet(path).count() == 1001


def test_cascading_update(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    child = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None), (14, 3)], "n int, parent int")
    changes = spark.createDataFrame([(1, 2), (2, 1), (9, 5)], "old_key int, new_key int")
    moved, children = keys.cascade_update(parent, "id", {"child": (child, "parent")}, changes)
    assert sorted(map(tuple, moved.collect())) == [(1, "b"), (2, "a"), (3, "c")]
    assert sorted(map(tuple, children["child"].collect())) == [(10, 2), (11, 2), (12, 1), (13, None), (14, 3)]
    for rows, match in (([(1, 3)], "duplicate"), ([(1, 4), (1, 5)], "duplicate"), ([(1, None)], "null"), ([(1, 7), (2, 7)], "duplicate")):
        with pytest.raises(DataError, match=match):
            keys.cascade_update(parent, "id", {}, spark.createDataFrame(rows, "old_key int, new_key int"))

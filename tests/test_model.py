import hashlib
import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.constants import LABEL
from cellweft.errors import DataError, MissingTableError
from cellweft.operators import evaluate, features, learn, quality


def matrix(spark, n_days=30, n_cells=4):
    rows = []
    for d in range(n_days):
        for c in range(n_cells):
            rows.append((datetime(2024, 1, 1) + timedelta(days=d), f"r8_{c}_0", "7", float(c), 0.2 * c, float(20 + (d * 7 + c) % 15),
                         float(d % 5), float(d % 3), None if d % 4 == 0 else float(d)))
    return spark.createDataFrame(rows, "timestamp timestamp, cell_id string, station_id string, line_length_km_water double, "
                                       "pct_pre_1980 double, heat_index_c double, consecutive_dry_days double, rainfall_48h double, extra double")


def test_cells_times_days(spark):
    cells = spark.createDataFrame([("a", 45.0, -75.0, "7", 1.0), ("b", 45.1, -75.1, "7", 2.0)],
                                  "cell_id string, centroid_lat double, centroid_lon double, station_id string, shared double")
    days = spark.range(10).select(F.lit("7").alias("station_id"), (F.lit(datetime(2024, 1, 1)) + F.make_interval(days=F.col("id").cast("int"))).alias("timestamp"),
                                  F.col("id").cast("double").alias("shared"))
    features.check_matrix_inputs(cells, days)
    out = features.feature_matrix(cells, days)
    assert out.count() == 20 and "shared_weather" in out.columns
    with pytest.raises(DataError, match="duplicate"):
        features.check_matrix_inputs(cells.union(cells), days)
    with pytest.raises(DataError, match="at least 10"):
        features.check_matrix_inputs(cells, days.limit(9))
    with pytest.raises(DataError, match="missing"):
        features.check_matrix_inputs(cells.drop("centroid_lat"), days)


def test_rule_label(spark):
    df = matrix(spark)
    median = np.median([r[0] for r in df.select("line_length_km_water").collect()])
    for row in features.with_label(df).collect():
        points = 2 * (row["line_length_km_water"] > median) + 2 * (row["pct_pre_1980"] >= 0.4) + (row["heat_index_c"] >= 28)
        points += (row["consecutive_dry_days"] >= 2) + (row["rainfall_48h"] < 1)
        assert row[LABEL] == int(points >= 4)
    cells = df.select("cell_id", "line_length_km_water").distinct()
    assert features.with_label(df, cells=cells).exceptAll(features.with_label(df)).isEmpty()
    bare = df.select("cell_id", "timestamp")
    assert {r[LABEL] for r in features.with_label(bare).collect()} == {0}


def test_label_modes(spark):
    df = matrix(spark)
    with pytest.raises(DataError, match="outcome column"):
        features.with_label(df, "observed")
    assert features.with_label(df.withColumn(LABEL, F.lit(1.0)), "observed").schema[LABEL].dataType.typeName() == "integer"
    with pytest.raises(ValueError, match="mode"):
        features.with_label(df, "other")


def test_feature_columns_are_sorted_numbers(spark):
    assert features.feature_columns(features.with_label(matrix(spark))) == [
        "consecutive_dry_days", "extra", "heat_index_c", "line_length_km_water", "pct_pre_1980", "rainfall_48h"]


def test_split_leaves_purge_gaps(spark):
    parts = evaluate.temporal_split(matrix(spark))
    ends = {r["split"]: (r["a"], r["b"]) for r in parts.groupBy("split").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).collect()}
    gap = timedelta(hours=48)
    assert ends["validation"][0] - ends["train"][1] >= gap
    assert ends["test"][0] - ends["validation"][1] >= gap
    assert ends["train"][1] == datetime(2024, 1, 18) and ends["validation"][1] == datetime(2024, 1, 24)
    evaluate.require_splits(parts)


def test_split_without_purge_shares_boundaries(spark):
    parts = evaluate.temporal_split(matrix(spark), purge_hours=0)
    shared = parts.groupBy("cell_id", "timestamp").count().filter("count = 2").select("timestamp").distinct()
    assert {r[0] for r in shared.collect()} == {datetime(2024, 1, 18), datetime(2024, 1, 24)}


def test_split_rules(spark):
    with pytest.raises(ValueError, match="below zero"):
        evaluate.temporal_split(matrix(spark), purge_hours=-1)
    with pytest.raises(DataError, match="at least 10"):
        evaluate.temporal_split(matrix(spark, 9))
    with pytest.raises(DataError, match="empty"):
        evaluate.require_splits(evaluate.temporal_split(matrix(spark, 10), purge_hours=96))


def curve_by_hand(y, s):
    out = []
    for t in sorted(set(s)):
        said = s >= t
        tp = (said & (y == 1)).sum()
        p, r = tp / said.sum(), tp / (y == 1).sum()
        out.append((t, p, r, 2 * p * r / (p + r + 1e-12)))
    return out


@pytest.mark.parametrize("places", [1, 9])
def test_metrics_by_hand(spark, places):
    rng = np.random.default_rng(3)
    y = (rng.random(900) < 0.3).astype(int)
    s = np.clip(np.round(0.3 * y + rng.random(900) * 0.7, places), 0, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "label int, score double")
    curve = curve_by_hand(y, s)
    best = max(f for *_, f in curve)
    assert evaluate.best_threshold(df).first()[0] == next(t for t, _, _, f in curve if f == best)
    area, before = 0.0, 0.0
    for _, p, r, _ in reversed(curve):
        area, before = area + (r - before) * p, r
    assert evaluate.average_precision(df).first()[0] == pytest.approx(area)
    said = s >= 0.5
    tp, fp, fn = (said & (y == 1)).sum(), (said & (y == 0)).sum(), (~said & (y == 1)).sum()
    row = evaluate.f1_at_threshold(df, 0.5).first()
    assert row["f1_at_threshold"] == pytest.approx(2 * tp / (2 * tp + fp + fn)) and row["test_rows"] == 900


def test_one_class(spark):
    for label in (0, 1):
        df = spark.createDataFrame([(label, 0.1), (label, 0.9)], "label int, score double")
        assert evaluate.best_threshold(df).first()[0] == 0.5
        assert evaluate.average_precision(df).first()[0] == 0.0
    assert evaluate.f1_at_threshold(df.withColumn("label", F.lit(0)), 1.5).first()[0] == 0.0


def test_train_save_load_score(spark, tmp_path):
    df = features.with_label(matrix(spark, 40, 6))
    model, columns, metrics = learn.train_and_evaluate(df, trees=5)
    assert 0 <= metrics["pr_auc"] <= 1 and 0 <= metrics["f1_at_threshold"] <= 1 and 0 <= metrics["decision_threshold"] <= 1
    path = str(tmp_path / "model")
    row = learn.save_model(spark, path, model, columns, metrics, df.count()).first()
    text = json.dumps({"features": columns, "rows": 240, "target_mode": "synthetic"}, sort_keys=True)
    assert row["model_version"] == hashlib.sha256(text.encode()).hexdigest()[:12]
    loaded, metadata = learn.load_model(spark, path)
    assert metadata["feature_columns"] == columns
    fewer = df.drop("extra").withColumn("heat_index_c", F.lit("not a number"))
    for rows in (df, fewer):
        scored = learn.score_rows(loaded, columns, rows)
        assert scored.count() == 240
        quality.check_scores(scored)
    same = learn.score_rows(model, columns, df).agg(F.sum("risk_score")).first()[0]
    assert learn.score_rows(loaded, columns, df).agg(F.sum("risk_score")).first()[0] == pytest.approx(same)
    top = learn.top_features(spark.read.parquet(f"{path}/importance"), 3).collect()
    assert len(top) == 3 and top[0]["importance"] >= top[1]["importance"] >= top[2]["importance"]


def test_training_and_loading_rules(spark, tmp_path):
    df = features.with_label(matrix(spark))
    with pytest.raises(DataError, match="both classes"):
        learn.train_classifier(df.withColumn(LABEL, F.lit(0)), ["extra"])
    with pytest.raises(DataError, match="no numeric"):
        learn.train_classifier(df, [])
    with pytest.raises(MissingTableError):
        learn.load_model(spark, str(tmp_path / "none"))
    with pytest.raises(DataError, match="invalid_score"):
        quality.check_scores(spark.createDataFrame([(0.5,), (float("nan"),)], "risk_score double"))


def test_split_tests_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    matrix(spark).write.parquet(path)
    df = spark.read.parquet(path)
    rows = df.filter(evaluate.split_tests(df, evaluate.split_bounds(df))["validation"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp," in plan

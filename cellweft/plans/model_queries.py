"""Queries on the matrix, labels, splits, metrics and the classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.constants import ARTIFACT_SCHEMA_VERSION, LABEL
from cellweft.functions import geo
from cellweft.functions.display import is_probability
from cellweft.operators import daily, evaluate, features, keys, leafwise, learn, ranked, serve, windows
from cellweft.operators.quality import audit_predictions, check_scores, require_clean
from cellweft.plans import inputs
from cellweft.plans.inputs import DAY_COLUMNS, with_views
from cellweft.plans.registry import query
from cellweft.plans.space_queries import cell_table
from cellweft.plans.weather_queries import rounded
from cellweft.session import scratch_path
from cellweft.sources import tables


def stationed(spark, folder) -> DataFrame:
    """Cells with the station whose weather they get, written once and read back."""
    _, q, r = geo.cell_parts(F.col("cell_id"))
    cells = cell_table(spark, folder).withColumn("station_id", inputs.station_of(q, r))
    return spark.read.parquet(tables.write_table(cells, scratch_path(spark, "cells")))


def days(spark, folder) -> DataFrame:
    weather = windows.weather_features(inputs.obs(spark, folder))
    return daily.newest_days(daily.daily_last(weather, DAY_COLUMNS))


def matrix(spark, folder) -> DataFrame:
    return features.feature_matrix(stationed(spark, folder), days(spark, folder))


_MATRIX_COLUMNS = (
    "cell_id", "station_id", "timestamp", "line_length_km_water", "line_count_road", "building_count", "median_year_built",
    "pct_pre_1980", "temperature_c", "temp_max_48h", "heat_index_c", "consecutive_dry_days", "rainfall_48h", "rainfall_7d",
    "humidity_delta_24h",
)
_ROUND = ("line_length_km_water", "pct_pre_1980", "heat_index_c", "consecutive_dry_days")


@query("feature_matrix", with_views("matrix") + "SELECT " + ", ".join(
    f"round({c}, 6) AS {c}" if c in _ROUND else c for c in _MATRIX_COLUMNS) + " FROM matrix")
def feature_matrix(spark, folder):
    return rounded(matrix(spark, folder).select(*_MATRIX_COLUMNS), *_ROUND)


@query("rule_label", with_views("matrix") + f"""
SELECT cell_id, timestamp, (2 * (line_length_km_water > (SELECT median(line_length_km_water) FROM matrix))::INT
  + 2 * (pct_pre_1980 >= 0.4)::INT + (heat_index_c >= 28)::INT + (consecutive_dry_days >= 2)::INT + (rainfall_48h < 1)::INT >= 4)::INT AS {LABEL}
FROM matrix""")
def rule_label(spark, folder):
    cells = stationed(spark, folder)
    labelled = features.with_label(features.feature_matrix(cells, days(spark, folder)), "synthetic", cells)
    return labelled.select("cell_id", "timestamp", LABEL)


@query("rule_label_uneven", with_views("matrix").rstrip() + f""",
uneven AS (SELECT * FROM matrix WHERE station_id <> 'click' OR day(timestamp) % 4 = 0)
SELECT cell_id, timestamp, (2 * (line_length_km_water > (SELECT median(line_length_km_water) FROM uneven))::INT
  + 2 * (pct_pre_1980 >= 0.4)::INT + (heat_index_c >= 28)::INT + (consecutive_dry_days >= 2)::INT + (rainfall_48h < 1)::INT >= 4)::INT AS {LABEL}
FROM uneven""")
def rule_label_uneven(spark, folder):
    """One station has a quarter of the days, so its cells count less in the median."""
    cells = stationed(spark, folder)
    some = days(spark, folder).filter((F.col("station_id") != "click") | (F.dayofmonth("timestamp") % 4 == 0))
    labelled = features.with_label(features.feature_matrix(cells, some), "synthetic", cells, some)
    return labelled.select("cell_id", "timestamp", LABEL)


@query("observed_label", f"""
SELECT l_orderkey, l_linenumber, (l_returnflag = 'R')::INT AS {LABEL} FROM lineitem""")
def observed_label(spark, folder):
    rows = inputs.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias(LABEL))
    return features.with_label(rows, "observed")


@query("feature_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS filled, round(avg({c}::DOUBLE), 6) AS mean FROM lineitem"
    for c in ("l_discount", "l_extendedprice", "l_linenumber", "l_orderkey", "l_partkey", "l_quantity", "l_suppkey", "l_tax")))
def feature_columns(spark, folder):
    rows = inputs.table(spark, folder, "lineitem")
    names = features.feature_columns(rows)
    facts = rows.agg(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.count(c).alias("filled"), F.round(F.avg(c), 6).alias("mean")) for c in names
    ]).alias("facts"))
    return facts.select(F.explode("facts").alias("f")).select("f.*")


@query("exact_median", "SELECT median(l_extendedprice) AS median FROM lineitem")
def exact_median(spark, folder):
    rows = inputs.table(spark, folder, "lineitem")
    median = ranked.exact_median(rows, "l_extendedprice")
    return rows.agg(F.lit(median).alias("median"), F.count("*").alias("_n")).select("median")


@query("class_weight", """
SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS positives, count(*) FILTER (WHERE l_returnflag <> 'R') AS negatives,
  round(count(*) FILTER (WHERE l_returnflag <> 'R') / count(*) FILTER (WHERE l_returnflag = 'R'), 6) AS positive_weight FROM lineitem GROUP BY 1""")
def class_weight(spark, folder):
    rows = inputs.table(spark, folder, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return rounded(evaluate.class_counts(rows, "label", ["l_linestatus"]), "positive_weight")


_BOUNDS = """bounds AS (SELECT list_sort(list(DISTINCT timestamp)) AS t FROM obs),
ends AS (SELECT t[greatest(1, (len(t) * 0.6::DOUBLE)::BIGINT - CASE WHEN (len(t) * 0.6::DOUBLE)::BIGINT > len(t) * 0.6::DOUBLE THEN 1 ELSE 0 END)] AS a,
  t[greatest(2, floor(len(t) * (0.6::DOUBLE + 0.2::DOUBLE))::BIGINT)] AS b FROM bounds)"""


@query("temporal_split", with_views("obs").rstrip() + ", " + _BOUNDS + """
SELECT station_id, timestamp, 'train' AS split FROM obs, ends WHERE timestamp <= a
UNION ALL SELECT station_id, timestamp, 'validation' FROM obs, ends WHERE timestamp >= a + INTERVAL '48 hours' AND timestamp <= b
UNION ALL SELECT station_id, timestamp, 'test' FROM obs, ends WHERE timestamp >= b + INTERVAL '48 hours'""")
def temporal_split(spark, folder):
    return evaluate.temporal_split(inputs.obs(spark, folder).select("station_id", "timestamp"))


def _curve_sql(view: str) -> str:
    return f"""{with_views(view).rstrip()},
totals AS (SELECT score, count(*) AS n, sum(label) AS pos FROM {view} GROUP BY score),
cum AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cn, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(pos) OVER () AS p FROM totals),
curve AS (SELECT *, cp / cn AS pr, cp / p AS re FROM cum)
"""


@query("best_threshold", _curve_sql("scored") + """
SELECT score AS best_threshold FROM curve ORDER BY 2 * pr * re / (pr + re + 1e-12) DESC, score LIMIT 1""")
def best_threshold(spark, folder):
    return evaluate.best_threshold(inputs.scored(spark, folder))


@query("average_precision", _curve_sql("scored") + "SELECT round(sum(pos * pr) / any_value(p), 6) AS average_precision FROM curve")
def average_precision(spark, folder):
    return rounded(evaluate.average_precision(inputs.scored(spark, folder)), "average_precision")


@query("average_precision_fine", _curve_sql("scored_fine") + "SELECT round(sum(pos * pr) / any_value(p), 6) AS average_precision FROM curve")
def average_precision_fine(spark, folder):
    """The same on nearly one distinct score per row."""
    return rounded(evaluate.average_precision(inputs.scored(spark, folder, fine=True)), "average_precision")


@query("f1_at_threshold", with_views("scored") + """
SELECT round(2 * count(*) FILTER (WHERE score >= 0.5 AND label = 1) / (count(*) FILTER (WHERE score >= 0.5) + count(*) FILTER (WHERE label = 1)), 6) AS f1_at_threshold,
  count(*) AS test_rows FROM scored""")
def f1_at_threshold(spark, folder):
    return rounded(evaluate.f1_at_threshold(inputs.scored(spark, folder), 0.5), "f1_at_threshold")


_VERSION_COLUMNS = ["consecutive_dry_days", "heat_index_c", "rainfall_48h"]


@query("model_version", """
SELECT l_returnflag, count(*) AS rows, substring(sha256('{"features": ["consecutive_dry_days", "heat_index_c", "rainfall_48h"], "rows": '
  || count(*) || ', "target_mode": "synthetic"}'), 1, 12) AS model_version FROM lineitem GROUP BY 1""")
def model_version(spark, folder):
    groups = inputs.table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("rows"))
    return groups.withColumn("model_version", learn.model_version(_VERSION_COLUMNS, F.col("rows"), "synthetic"))


# The classifier: learned numbers have no SQL twin, so these queries report what must hold for any fit ---

_TRAINED: dict[tuple[str, str], str] = {}


def written_matrix(spark, folder) -> DataFrame:
    """The labelled matrix, written once so that training and scoring read it back."""
    cells = stationed(spark, folder)
    labelled = features.with_label(features.feature_matrix(cells, days(spark, folder)), "synthetic", cells)
    return spark.read.parquet(tables.write_table(labelled, scratch_path(spark, "matrix")))


def trained(spark, folder) -> str:
    """Folder of the model trained on these tables; trained once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _TRAINED:
        rows = written_matrix(spark, folder)
        model, columns, metrics = learn.train_and_evaluate(rows)
        path = scratch_path(spark, "model")
        learn.save_model(spark, path, model, columns, metrics, rows.count())
        _TRAINED[key] = path
    return _TRAINED[key]


_INPUTS = (
    "building_count", "consecutive_dry_days", "consecutive_dry_hours", "heat_index_c", "heat_index_max_24h", "heat_index_max_48h",
    "humidity_delta_24h", "humidity_min_24h", "is_dry_hour", "line_count_road", "line_count_water", "line_length_km_road",
    "line_length_km_water", "median_year_built", "pct_pre_1980", "precip_mm", "rainfall_24h", "rainfall_48h", "rainfall_7d",
    "relative_humidity", "temp_delta_24h", "temp_delta_48h", "temp_max_24h", "temp_max_48h", "temp_min_24h", "temperature_c",
)
_VERSION_SQL = "substring(sha256('{\"features\": [" + ", ".join(f'"{c}"' for c in _INPUTS) + """], "rows": '
  || (SELECT count(*) FROM matrix) || ', "target_mode": "synthetic"}'), 1, 12)"""


@query("train_classifier", """
SELECT i::INT AS tree, CASE WHEN i = 0 THEN 1 ELSE 0.05 END::DOUBLE AS weight, true AS depth_within_4, true AS at_most_31_nodes
FROM range(100) t(i)""")
def train_classifier(spark, folder):
    """The trees of the trained classifier: weight of each, and whether depth and nodes are within bounds."""
    model, _ = learn.load_model(spark, trained(spark, folder))
    parts = learn.classifier(model)
    trees = [(i, float(w), t.depth <= 4, t.numNodes <= 31) for i, (t, w) in enumerate(zip(parts.trees, parts.treeWeights, strict=True))]
    return spark.createDataFrame(trees, "tree int, weight double, depth_within_4 boolean, at_most_31_nodes boolean")


@query("train_evaluate", with_views("matrix").rstrip() + ", " + _BOUNDS.replace("FROM obs", "FROM matrix") + """
SELECT count(*) AS training_rows, count(*) FILTER (WHERE timestamp >= b + INTERVAL '48 hours') AS test_rows,
  48 AS prediction_horizon_hours, true AS pr_auc_in_range, true AS f1_in_range, true AS threshold_in_range FROM matrix, ends""")
def train_evaluate(spark, folder):
    metadata = spark.read.parquet(f"{trained(spark, folder)}/metadata")
    told = {"pr_auc_in_range": "pr_auc", "f1_in_range": "f1_at_threshold", "threshold_in_range": "decision_threshold"}
    return metadata.select("training_rows", "test_rows", "prediction_horizon_hours",
                           *[is_probability(F.col(c)).alias(name) for name, c in told.items()])


@query("top_features", """
SELECT 10 AS features, 10 AS distinct_features, 10 AS model_inputs, true AS none_greater_left, true AS shares_sum_to_one""")
def top_features(spark, folder):
    """The ten features named as most important, held against the importance of all."""
    importance = spark.read.parquet(f"{trained(spark, folder)}/importance")
    top = learn.top_features(importance).withColumn("shown", F.lit(True))
    both = importance.join(top.select("feature", "shown"), "feature", "left")
    shown, value = F.col("shown").isNotNull(), F.col("importance")
    return both.agg(
        F.count_if(shown).alias("features"),
        F.count_distinct(F.when(shown, F.col("feature"))).alias("distinct_features"),
        F.count_if(shown & F.col("feature").isin(*_INPUTS)).alias("model_inputs"),
        (F.min(F.when(shown, value)) >= F.max(F.when(~shown, value))).alias("none_greater_left"),
        (F.abs(F.sum(value) - 1) < 1e-6).alias("shares_sum_to_one"),
    )


@query("model_registry", with_views("matrix") + f"""
SELECT {ARTIFACT_SCHEMA_VERSION} AS artifact_schema_version, 'synthetic' AS target_mode, 48 AS prediction_horizon_hours,
  (SELECT count(*) FROM matrix) AS training_rows, '{",".join(_INPUTS)}' AS feature_columns, {_VERSION_SQL} AS model_version,
  true AS threshold_in_range""")
def model_registry(spark, folder):
    path = trained(spark, folder)
    learn.load_model(spark, path)
    return spark.read.parquet(f"{path}/metadata").select(
        "artifact_schema_version", "target_mode", "prediction_horizon_hours", "training_rows",
        F.array_join("feature_columns", ",").alias("feature_columns"), "model_version",
        is_probability(F.col("decision_threshold")).alias("threshold_in_range"))


@query("metrics_answer", with_views("matrix") + f"""
SELECT (SELECT count(*) FROM matrix) AS training_rows, {_VERSION_SQL} AS model_version, 'synthetic' AS target_mode, 10 AS features,
  true AS in_falling_order, 'hexagon resolution 8' AS spatial_resolution, 48 AS prediction_horizon_hours, true AS has_warning""")
def metrics_answer(spark, folder):
    told = learn.metrics_answer(spark, trained(spark, folder))
    values = F.col("features.importance")
    return told.select("metrics.training_rows", "metrics.model_version", "metrics.target_mode", F.size("features").alias("features"),
                       (F.sort_array(values, asc=False) == values).alias("in_falling_order"), "spatial_resolution",
                       "prediction_horizon_hours", F.col("target_warning").isNotNull().alias("has_warning"))


@query("batch_score", with_views("matrix") + f"""
SELECT cell_id, true AS score_in_range, {_VERSION_SQL} AS model_version, 'synthetic' AS target_mode FROM stationed""")
def batch_score(spark, folder):
    """Predictions of every cell under its station's latest weather, written and read back."""
    model, metadata = learn.load_model(spark, trained(spark, folder))
    latest = keys.latest_per_key(windows.weather_features(inputs.obs(spark, folder)), ["station_id"], "timestamp")
    rows = serve.with_weather(stationed(spark, folder), latest)
    scored = learn.score_rows(model, metadata["feature_columns"], rows)
    path = tables.write_table(learn.predictions(scored, metadata), scratch_path(spark, "predictions"), order=["cell_id"])
    stored = check_scores(spark.read.parquet(path))
    require_clean(audit_predictions(stored), "predictions")
    return stored.select("cell_id", is_probability(F.col("risk_score")).alias("score_in_range"), "model_version", "target_mode")


@query("leafwise_tree", """
WITH rows AS (
  SELECT (l_extendedprice > 40000)::INT AS y, l_quantity::DOUBLE AS quantity, l_linenumber::DOUBLE AS line,
    CASE WHEN l_tax > 0 THEN l_discount::DOUBLE END AS discount FROM lineitem),
weights AS (SELECT count(*) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 1) AS w FROM rows),
sums AS (SELECT quantity, line, discount, CASE WHEN y = 1 THEN -w / 2 ELSE 0.5 END AS g, CASE WHEN y = 1 THEN w ELSE 1 END / 4 AS h
  FROM rows, weights),
inputs AS (
  SELECT 'quantity' AS feature, quantity AS v, g, h FROM sums UNION ALL SELECT 'line', line, g, h FROM sums
  UNION ALL SELECT 'discount', discount, g, h FROM sums),
bins AS (SELECT feature, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM inputs GROUP BY feature, v),
upto AS (
  SELECT feature, v, lead(v) OVER f AS next, sum(g) OVER f AS lg, sum(h) OVER f AS lh, sum(n) OVER f AS ln
  FROM bins WHERE v IS NOT NULL WINDOW f AS (PARTITION BY feature ORDER BY v)),
lost AS (SELECT feature, coalesce(sum(g) FILTER (WHERE v IS NULL), 0) AS mg, coalesce(sum(h) FILTER (WHERE v IS NULL), 0) AS mh,
  coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS mn, sum(g) AS tg, sum(h) AS th, sum(n) AS tn FROM bins GROUP BY feature),
cuts AS (
  SELECT feature, v, next, lg + s * mg AS g, lh + s * mh AS h, ln + s * mn AS n, tg, th, tn
  FROM upto JOIN lost USING (feature), (VALUES (0), (1)) sides(s)),
best AS (
  SELECT feature, coalesce(v + (next - v) / 2, 'Infinity'::DOUBLE) AS threshold, n, tn - n AS rest,
    g * g / h + (tg - g) * (tg - g) / (th - h) - tg * tg / th AS gain
  FROM cuts WHERE n >= 5 AND tn - n >= 5)
SELECT feature AS root_input, round(threshold, 6) AS root_threshold, n::BIGINT AS left_rows, rest::BIGINT AS right_rows, round(gain, 3) AS root_gain,
  true AS leaves_within_15, true AS depth_within_5, true AS leaves_hold_all_rows
FROM best ORDER BY gain DESC LIMIT 1""")
def leafwise_tree(spark, folder):
    """One tree grown best leaf first over all line items: its first split, exactly, and whether its limits hold."""
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        (F.col("l_extendedprice") > 40000).cast("int").alias(LABEL), F.col("l_quantity").cast("double").alias("quantity"),
        F.col("l_linenumber").cast("double").alias("line"), F.when(F.col("l_tax") > 0, F.col("l_discount").cast("double")).alias("discount"))
    names = ["quantity", "line", "discount"]
    nodes = leafwise.train_leafwise(rows, names, trees=1, share=1.0).table(spark)
    root, leaf = F.col("node") == 0, F.col("left").isNull()

    def at(node, column):
        return F.max(F.when(F.col("node") == node, F.col(column)))

    told = nodes.agg(
        F.get(F.array(*[F.lit(c) for c in names]), F.max(F.when(root, F.col("feature")))).alias("root_input"),
        F.round(at(0, "threshold"), 6).alias("root_threshold"), at(1, "rows").alias("left_rows"), at(2, "rows").alias("right_rows"),
        F.round(at(0, "gain"), 3).alias("root_gain"), (F.count_if(leaf) <= 15).alias("leaves_within_15"),
        (F.max("depth") <= 5).alias("depth_within_5"), (F.sum(F.when(leaf, F.col("rows"))) == at(0, "rows")).alias("leaves_hold_all_rows"))
    return told

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.operators import features, ranked
from cellweft.operators.events import cap_records


def values(spark, data, name="v"):
    return spark.createDataFrame([(float(x),) for x in data], f"{name} double")


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_running_totals(spark, ascending, ranges):
    rng = np.random.default_rng(1)
    data = sorted(set(np.round(rng.lognormal(0, 3, 2000), 6)), reverse=not ascending)
    df = spark.createDataFrame([(float(v), int(i % 9)) for i, v in enumerate(data)], "v double, n bigint")
    rows = ranked.running_totals(df, "v", ["n"], ascending, ranges).collect()
    got = {r["v"]: r["cum_n"] for r in rows}
    want = dict(zip(data, np.cumsum([i % 9 for i in range(len(data))]), strict=True))
    assert got == want


@pytest.mark.parametrize("data", [[3.0], [1.0, 2.0], [5.0] * 1000 + [1.0, 9.0], list(range(1001)), [0.1, 0.1, 0.2, 0.7] * 25])
def test_exact_median(spark, data):
    assert ranked.exact_median(values(spark, data), "v") == pytest.approx(float(np.median(data)))


def test_median_skips_nulls_and_may_be_missing(spark):
    df = spark.createDataFrame([(None,), (4.0,), (None,), (8.0,)], "v double")
    assert ranked.exact_median(df, "v") == 6.0
    assert ranked.exact_median(df.filter("v IS NULL"), "v") is None


def test_nth_values(spark):
    counts = ranked.value_counts(values(spark, [5, 5, 5, 1, 9, 9]), "v")
    assert ranked.nth_values(counts, "v", [1, 2, 4, 5, 6]) == [1.0, 5.0, 5.0, 9.0, 9.0]


@pytest.mark.parametrize("ranges", [None, 1, 3, 16])
def test_places_are_the_same_on_any_number_of_ranges(spark, ranges):
    data = np.random.default_rng(2).integers(0, 300, 5000)
    counts = ranked.value_counts(spark.createDataFrame([(int(v),) for v in data], "v int"), "v")
    want = np.sort(data)
    found = ranked.places(counts, "v", [1, 17, 2500, 5000], ranges)
    assert {k: v for k, (v, _) in found.items()} == {k: want[k - 1] for k in (1, 17, 2500, 5000)}
    assert all(before == (data < v).sum() for v, before in found.values())


def test_ranges_grow_with_the_data(spark, monkeypatch):
    monkeypatch.setattr(ranked, "RANGE_ROWS", 100)
    counts = ranked.value_counts(spark.range(1000).withColumn("v", F.col("id") * 1.0), "v")
    ranged = ranked._ranged(counts, "v", False, None)
    assert ranged.select("_range").distinct().count() == 10
    tops = [r[0] for r in ranged.groupBy("_range").agg(F.max("v")).orderBy("_range").select("max(v)").collect()]
    assert tops == sorted(tops, reverse=True)
    assert ranked.exact_median(spark.range(1000), "id") == 499.5


def test_rule_label_runs_few_jobs(spark):
    """Finding the median of the water column and labelling a matrix take fewer than twenty jobs."""
    cells = spark.range(500).select(F.col("id").cast("string").alias("cell_id"), F.lit("s").alias("station_id"),
                                    (F.col("id") * 7 % 311 / 10.0).alias("line_length_km_water"))
    days = spark.range(40).select(F.lit("s").alias("station_id"), F.col("id").alias("timestamp"), F.lit(30.0).alias("heat_index_c"))
    spark.sparkContext.setJobGroup("rule-label", "jobs of one query")
    labelled = features.with_label(features.feature_matrix(cells, days), "synthetic", cells, days)
    assert labelled.count() == 20_000
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("rule-label")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 20


def test_first_n_with_a_crowded_time(spark):
    """Most rows share one time; the cut then falls on the second order column."""
    df = spark.range(3000).select(
        F.col("id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, IF(id % 10 < 8, 5, id % 7))").alias("at"))
    for n in (1, 100, 1500, 3000):
        got = sorted(r["id"] for r in cap_records(df, n, ("at", "id")).collect())
        want = sorted(r["id"] for r in df.orderBy("at", "id").limit(n).collect())
        assert got == want


def test_first_n_takes_nulls_last_and_copies_whole(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (2, 2), (2, 2), (1, 3), (None, 0)], "a int, b int")
    assert sorted(map(tuple, ranked.first_n(df, 3, ["a"]).collect())) == [(1, 3), (2, 2), (2, 2)]
    assert ranked.first_n(df, 5, ["a", "b"]).filter("a IS NULL").collect()[0]["b"] == 0
    assert ranked.first_n(df, 50, ["a", "b"]).count() == 6


def test_cap_limits(spark):
    for bad in (0, -1):
        with pytest.raises(ValueError, match="limit"):
            cap_records(spark.range(1), bad, ("id",))

from types import SimpleNamespace

import pytest

from cellweft import session
from cellweft.operators import windows
from pyspark.sql import functions as F


def fake(master, named=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named or default), sparkContext=context)


def test_cluster_folder_comes_from_the_setting():
    assert session.shared_folder(fake("spark://host:7077", "s3://bucket/shared")) == "s3://bucket/shared"
    assert session.scratch_path(fake("yarn", "/shared/"), "cells").startswith("/shared/cells-")


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="shared folder"):
        session.shared_folder(fake("yarn"))
    with pytest.raises(RuntimeError, match="shared folder"):
        session.shared_folder(fake("local-cluster[2,1,1024]"))


def test_cut_lineage_keeps_rows_and_drops_the_plan(spark):
    df = spark.range(100).filter("id % 3 = 0")
    kept = session.cut_lineage(df)
    assert kept.count() == 34
    assert "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_one_station_is_many_groups(spark):
    """A single station of three years never meets in one window group."""
    hours = spark.range(24 * 365 * 3).select(
        F.lit("7").alias("station_id"), F.timestamp_micros(F.col("id") * windows.HOUR_US).alias("timestamp"))
    chunks = windows.ChunkedTime(hours, "station_id", "timestamp")
    sizes = [r["count"] for r in chunks.rows.groupBy("station_id", "_chunk").count().collect()]
    assert len(sizes) == 7 and max(sizes) <= windows.DEFAULT_CHUNK_HOURS + windows.LOOK_BACK_HOURS
    assert chunks.own(chunks.rows).count() == hours.count()

"""Day buckets per station."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.constants import MAX_TRAINING_DAYS


def daily_last(df: DataFrame, columns: Sequence[str] | None = None, station: str = "station_id",
               ts: str = "timestamp") -> DataFrame:
    """Last non-null value of each column per station and day; days with no value at all drop out.

    Hours reduce to days on the map side, so a busy station shuffles one row per day and task.
    """
    columns = list(columns or [c for c in df.columns if c not in {station, ts}])
    day = F.date_trunc("day", F.col(ts)).cast(df.schema[ts].dataType).alias("_day")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in columns]
    days = df.groupBy(station, day).agg(*last)
    return days.dropna(how="all", subset=columns).select(station, F.col("_day").alias(ts), *columns)


def newest_days(days: DataFrame, limit: int | None = MAX_TRAINING_DAYS, station: str = "station_id",
                ts: str = "timestamp") -> DataFrame:
    """The newest ``limit`` days of each station, all for None (one row per station and day comes in)."""
    if limit is None:
        return days
    newest = Window.partitionBy(station).orderBy(F.col(ts).desc())
    ranked = days.withColumn("_rank", F.row_number().over(newest))
    return ranked.filter(F.col("_rank") <= limit).drop("_rank")

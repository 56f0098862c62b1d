"""Time split with purge gaps, class weights, and ranking metrics from score totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.constants import LABEL, MIN_TRAINING_DAYS, PREDICTION_HORIZON_HOURS, TRAIN_FRACTION, VALIDATION_FRACTION
from cellweft.errors import DataError
from cellweft.operators.ranked import nth_values, running_totals, value_counts
from cellweft.session import cut_lineage

HOUR_US = 3_600_000_000


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def split_bounds(df: DataFrame, ts: str = "timestamp") -> tuple[int, int]:
    """Last training and last validation time, in microseconds, by rank of distinct time."""
    times = value_counts(df.select(_micros(ts).alias("_us")), "_us").withColumn("n", F.lit(1))
    size = times.count()
    if size < MIN_TRAINING_DAYS:
        raise DataError(f"at least {MIN_TRAINING_DAYS} distinct timestamps are required")
    first = max(1, int(size * TRAIN_FRACTION))
    second = max(first + 1, int(size * (TRAIN_FRACTION + VALIDATION_FRACTION)))
    train_end, validation_end = nth_values(times, "_us", [first, second])
    return train_end, validation_end


def split_tests(df: DataFrame, bounds: tuple[int, int], ts: str = "timestamp",
                purge_hours: int = PREDICTION_HORIZON_HOURS) -> dict[str, Column]:
    """Row test of each split: plain comparisons with typed constants, so scans can skip row groups."""
    if purge_hours < 0:
        raise ValueError("purge_hours is below zero")
    train_end, validation_end = bounds
    gap = purge_hours * HOUR_US

    def at(us: int) -> Column:
        return F.timestamp_micros(F.lit(us)).cast(df.schema[ts].dataType)

    time = F.col(ts)
    return {
        "train": time <= at(train_end),
        "validation": (time >= at(train_end + gap)) & (time <= at(validation_end)),
        "test": time >= at(validation_end + gap),
    }


def temporal_split(df: DataFrame, ts: str = "timestamp", purge_hours: int = PREDICTION_HORIZON_HOURS,
                   bounds: tuple[int, int] | None = None) -> DataFrame:
    """Add ``split``: one row per membership; rows inside a purge gap drop out.

    With no purge a row on a boundary belongs to two splits, so this is not one label per row.
    """
    if purge_hours < 0:
        raise ValueError("purge_hours is below zero")
    tests = split_tests(df, bounds or split_bounds(df, ts), ts, purge_hours)
    member = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return df.withColumn("split", F.explode(member))


def require_splits(parts: DataFrame) -> None:
    """Refuse an empty split."""
    found = {row["split"] for row in parts.select("split").distinct().collect()}
    if len(found) < 3:
        raise DataError("a time split is empty after the purge gaps")


def class_counts(df: DataFrame, label: str = LABEL, by: Sequence[str] = ()) -> DataFrame:
    """Per group: positives, negatives and the weight that balances them (null with one class)."""
    positive = F.count_if(F.col(label) == 1)
    negative = F.count_if(F.col(label) == 0)
    weight = F.when((positive > 0) & (negative > 0), negative / positive)
    return df.groupBy(*by).agg(
        positive.alias("positives"), negative.alias("negatives"), weight.alias("positive_weight")
    )


def score_totals(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rows and positives per distinct score, written once for the passes that follow."""
    totals = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )
    return cut_lineage(totals)


def precision_recall_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Precision, recall and F1 at every distinct score taken as threshold."""
    totals = score_totals(df, score, label)
    positives = totals.agg(F.sum("pos")).first()[0] or 0
    curve = running_totals(totals, "threshold", ["n", "pos"], ascending=False)
    precision = F.col("cum_pos") / F.col("cum_n")
    recall = F.col("cum_pos") / F.lit(positives) if positives else F.lit(1.0)
    curve = curve.withColumns({"precision": precision, "recall": recall})
    p, r = F.col("precision"), F.col("recall")
    return curve.withColumn("f1", 2 * p * r / (p + r + 1e-12))


def best_threshold(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: the F1-best threshold, the lowest on a tie; 0.5 when only one class is there."""
    curve = precision_recall_curve(df, score, label)
    best = F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold")))
    two_classes = (F.sum("pos") > 0) & (F.sum("pos") < F.sum("n"))
    return curve.agg(F.when(two_classes, best).otherwise(F.lit(0.5)).alias("best_threshold"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: sum of recall steps times precision; 0 when only one class is there."""
    curve = precision_recall_curve(df, score, label)
    area = F.sum(F.col("pos") * F.col("precision")) / F.sum("pos")
    two_classes = (F.sum("pos") > 0) & (F.sum("pos") < F.sum("n"))
    return curve.agg(F.when(two_classes, area).otherwise(F.lit(0.0)).alias("average_precision"))


def f1_at_threshold(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """One row: F1 of ``score >= threshold`` (0 when undefined) and the row count."""
    said = F.coalesce(F.col(score) >= threshold, F.lit(False))
    true = F.col(label) == 1
    hits, false_alarms, misses = F.count_if(said & true), F.count_if(said & ~true), F.count_if(~said & true)
    below = 2 * hits + false_alarms + misses
    return df.agg(
        F.when(below > 0, 2 * hits / below).otherwise(F.lit(0.0)).alias("f1_at_threshold"),
        F.count("*").alias("test_rows"),
    )

"""Global order without one big sort task: running totals, medians, n-th values, first-n.

Rows are first reduced to distinct values, which are dealt to ranges of about ``RANGE_ROWS`` values, as many as
the data needs. Each range adds up on its own; only one total per range is added up in one place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.session import cut_lineage

RANGE_ROWS = 1_000_000


def _ranged(df: DataFrame, column: str, ascending: bool, ranges: int | None) -> DataFrame:
    """Rows with ``_range``: 0, 1, ... in the given order of ``column``; written once when there are several."""
    many = ranges or max(math.ceil(df.count() / RANGE_ROWS), 1)
    if many == 1:
        return df.withColumn("_range", F.lit(0))
    order = F.col(column).asc() if ascending else F.col(column).desc()
    return cut_lineage(df.repartitionByRange(many, order).withColumn("_range", F.spark_partition_id()))


def _offsets(ranged: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Per range: what all earlier ranges hold (``_before_<c>``) and the range itself (``_part_<c>``)."""
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_part_{c}") for c in sums])
    # One row per ``RANGE_ROWS`` values, so this unpartitioned window stays small.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({f"_before_{c}": F.coalesce(F.sum(f"_part_{c}").over(earlier), F.lit(0)) for c in sums})


def _cumulated(ranged: DataFrame, offsets: DataFrame, column: str, sums: Sequence[str], ascending: bool) -> DataFrame:
    order = F.col(column).asc() if ascending else F.col(column).desc()
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(offsets), "_range")
    return joined.withColumns({f"cum_{c}": F.sum(c).over(inside) + F.col(f"_before_{c}") for c in sums})


def running_totals(df: DataFrame, column: str, sums: Sequence[str], ascending: bool = True,
                   ranges: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` for each ``c`` in ``sums``: its total over rows up to and including this one.

    ``column`` must be distinct, non-null and sortable. The rows are read up to three times, so pass a written
    table. ``ranges`` is counted from the rows unless it is given.
    """
    ranged = _ranged(df, column, ascending, ranges)
    return _cumulated(ranged, _offsets(ranged, sums), column, sums, ascending).select(*df.columns, *[f"cum_{c}" for c in sums])


def value_counts(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """Distinct non-null values with their counts (or sums of a whole-number weight), written once."""
    many = F.count("*") if weight is None else F.sum(weight)
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(many.alias("n"))
    return cut_lineage(counts)


def places(counts: DataFrame, column: str, ranks: Sequence[int], ranges: int | None = None) -> dict[int, tuple]:
    """(value, rows before it) at the given 1-based ranks of a (value, n) table; only ranges that hold a rank are sorted."""
    ranged = _ranged(counts, column, True, ranges)
    wanted = sorted(set(ranks))

    def held(low: Column, high: Column) -> Column:
        return F.array_compact(F.array(*[F.when((low < k) & (high >= k), F.lit(k)) for k in wanted]))

    before, part = F.col("_before_n"), F.col("_part_n")
    offsets = _offsets(ranged, ["n"]).filter(F.size(held(before, before + part)) > 0)
    totals = _cumulated(ranged, offsets, column, ["n"], True)
    first = F.col("cum_n") - F.col("n")
    rows = totals.select(F.explode(held(first, F.col("cum_n"))).alias("rank"), F.col(column).alias("value"), first.alias("before")).collect()
    return {row["rank"]: (row["value"], row["before"]) for row in rows}


def nth_values(counts: DataFrame, column: str, ranks: Sequence[int], ranges: int | None = None) -> list:
    """Values at the given 1-based ranks of a (value, n) table."""
    found = places(counts, column, ranks, ranges)
    return [found[k][0] for k in ranks]


def exact_median(df: DataFrame, column: str, weight: str | None = None) -> float | None:
    """Exact median of a numeric column, each row ``weight`` times; null when it holds no values."""
    counts = value_counts(df, column, weight)
    size, values = counts.agg(F.sum("n"), F.count("*")).first()
    if not size:
        return None
    low, high = nth_values(counts, column, [(size + 1) // 2, size // 2 + 1], max(math.ceil(values / RANGE_ROWS), 1))
    return (low + high) / 2


def _order_key(df: DataFrame, column: str) -> Column:
    """The column itself when numeric, microseconds when it is a time."""
    if df.schema[column].dataType.typeName() in {"timestamp", "timestamp_ntz", "date"}:
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column)


def first_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by ``order`` (numeric or time columns, nulls last); all when there are fewer.

    A cut value is found per order column, so no task ever holds the ``n`` rows. Only rows
    that tie on the whole order are sorted, by all their columns, for the places left.
    """
    if not order:
        sortable = [f.name for f in df.schema.fields if f.dataType.typeName() not in {"variant", "map"}]
        return df.orderBy(*sortable).limit(n)
    column, later = order[0], order[1:]
    keyed = df.withColumn("_key", _order_key(df, column))
    counts = value_counts(keyed, "_key")
    size = counts.agg(F.sum("n")).first()[0] or 0
    if size <= n:
        without = first_n(df.filter(F.col(column).isNull()), n - size, later)
        return df.filter(F.col(column).isNotNull()).unionByName(without)
    cut, before = places(counts, "_key", [n])[n]
    earlier = keyed.filter(F.col("_key") < cut).drop("_key")
    ties = keyed.filter(F.col("_key") == cut).drop("_key")
    return earlier.unionByName(first_n(ties, n - before, later))

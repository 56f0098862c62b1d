"""Box and hot-key joins, both plain equi-joins underneath."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cellweft.session import scratch_path

MAX_HOT_KEYS = 10_000
MIN_HOT_ROWS = 1_000_000
MAX_LEVEL = 24
#: A box may be this many bins long: finer bins meet fewer pairs of boxes that lie apart.
BINS_ALONG = 4
#: Where a bin holds more boxes than this, rows are dealt by bins instead of staying where they were read.
FULL_BIN = 64


def hot_keys(left: DataFrame | None, right: DataFrame | None, keys: Sequence[str], min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Keys crowded on either side, and the number of salts for the rows of each side; written once.

    A key is hot above ``greatest(min_rows, rows counted / 10000)`` rows on one side, so there are at most
    10,000 hot keys whatever the size of the sides: the table is safe to broadcast. A side that is None is not counted.
    """
    spark = (left if left is not None else right).sparkSession
    sides = {"_left": left, "_right": right}
    parts = [df.groupBy(*keys).agg(*[(F.count("*") if name == side else F.lit(0).cast("bigint")).alias(name) for name in sides])
             for side, df in sides.items() if df is not None]
    counts = parts[0]
    if len(parts) > 1:
        counts = counts.unionByName(parts[1]).groupBy(*keys).agg(*[F.sum(name).alias(name) for name in sides])
    seen = Observation()
    path = scratch_path(spark, "hot-keys")
    counts.observe(seen, F.sum(F.col("_left") + F.col("_right")).alias("rows")).filter(
        F.greatest("_left", "_right") > min_rows).write.parquet(path)
    limit = max(float(min_rows), (seen.get["rows"] or 0) / MAX_HOT_KEYS)
    crowded = spark.read.parquet(path).filter(F.greatest("_left", "_right") > limit)
    salts = [F.greatest(F.ceil(F.col(name) / F.lit(limit)), F.lit(1)).cast("int").alias(f"{name}_salts") for name in sides]
    return crowded.select(*keys, *salts)


def _salted(df: DataFrame, hot: DataFrame, keys: Sequence[str], own: str, other: str) -> DataFrame:
    """Rows of one side with a salt of their own, repeated once per salt of the other side."""
    hashable = [f.name for f in df.schema.fields if f.dataType.typeName() not in {"variant", "map"}]
    told = df.join(F.broadcast(hot), list(keys), "left")
    own_salts, other_salts = (F.coalesce(F.col(f"_{side}_salts"), F.lit(1)) for side in (own, other))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashable]), own_salts).cast("int")
    repeated = told.withColumn(f"_{own}", salt).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), other_salts - 1)))
    return repeated.drop("_left_salts", "_right_salts")


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], min_rows: int = MIN_HOT_ROWS,
                count: Sequence[str] = ("left", "right")) -> DataFrame:
    """Inner equi-join that splits the rows of hot keys, on either side, over several tasks.

    A hot key becomes a small table of tasks: one per pair of a left and a right salt. Other keys are untouched. The sides
    named in ``count`` are counted first, in a job of its own: name those whose keys can crowd, and pass them
    as written tables, since they are read twice. A side that is not named is left to Spark's adaptive skew join, which also
    splits rows that share a salt.
    """
    keys = list(keys)
    hot = hot_keys(left if "left" in count else None, right if "right" in count else None, keys, min_rows)
    if hot.isEmpty():
        return left.join(right, keys)
    sides = _salted(left, hot, keys, "left", "right"), _salted(right, hot, keys, "right", "left")
    return sides[0].join(sides[1], [*keys, "_left", "_right"]).drop("_left", "_right")


def _level(box: Sequence[str], bin_size: float) -> Column:
    """Size class of a box: the least k >= 0 with its sides no longer than ``bin_size`` * 2**k."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    longest = F.greatest(x1 - x0, y1 - y0) / bin_size
    return F.when(longest > 1, F.least(F.ceil(F.log2(longest)), F.lit(MAX_LEVEL))).otherwise(0).cast("int")


def _spread(df: DataFrame, box: Sequence[str], bin_size: float, own: Column | str, others: Sequence[int]) -> DataFrame:
    """Rows once per bin they touch, on their own level and on the coarser ones of ``others``."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    rows = df.withColumn("_own", F.col(own) if isinstance(own, str) else own)
    coarser = F.filter(F.lit(sorted(others)).cast("array<int>"), lambda k: k > F.col("_own"))
    rows = rows.withColumn("_level", F.explode(F.concat(F.array("_own"), coarser)))
    width = F.lit(bin_size) * F.pow(F.lit(2.0), F.col("_level"))
    # First bins along both axes, so that a join compares whole numbers.
    rows = rows.withColumns({"_fx": F.floor(x0 / width), "_fy": F.floor(y0 / width), "_gx": F.floor(x1 / width), "_gy": F.floor(y1 / width)})
    rows = rows.withColumn("_bx", F.explode(F.sequence("_fx", "_gx"))).withColumn("_by", F.explode(F.sequence("_fy", "_gy")))
    return rows.drop("_gx", "_gy")


def box_join(left: DataFrame, right: DataFrame, left_box: Sequence[str], right_box: Sequence[str],
             bin_size: float, min_rows: int = MIN_HOT_ROWS, left_span: float | None = None) -> DataFrame:
    """Pairs whose boxes (x_min, y_min, x_max, y_max) meet, each pair exactly once.

    Every box has a level: level k has square bins of ``bin_size`` * 2**k, the least with which the box is no longer than
    ``BINS_ALONG`` bins. A pair meets on the coarser one of its two levels: each side is also spread over the levels
    above its own that the other side has. A pair that shares several bins is kept only in the bin of the lower-left
    corner of the overlap, so no distinct step is needed.

    The right side is written once; its levels and crowded bins are read from that copy. ``left_span`` bounds the sides
    of the left boxes (0 for points); without it one pass over the left boxes finds their levels. Bins crowded on
    the left alone are left to Spark's adaptive skew join.
    """
    spark = right.sparkSession
    path = scratch_path(spark, "box-join")
    longest = bin_size * BINS_ALONG
    right.withColumn("_right_level", _level(right_box, longest)).write.parquet(path)
    kept = spark.read.parquet(path)
    if left_span is None:
        left_levels = [r[0] for r in left.select(_level(left_box, longest)).distinct().collect()]
    else:
        left_levels = range(max(math.ceil(math.log2(max(left_span / longest, 1))) + 1, 1))
    bins = ["_level", "_bx", "_by"]
    binned = _spread(kept, right_box, bin_size, "_right_level", left_levels).withColumnsRenamed(
        {"_own": "_right_own", "_fx": "_right_fx", "_fy": "_right_fy"})
    # One look at the copy tells the levels of the right boxes and how crowded its fullest bin is.
    per_bin = binned.groupBy(*bins).agg(F.count("*").alias("n"), F.collect_set("_right_own").alias("own"))
    right_levels, fullest = per_bin.agg(F.array_distinct(F.flatten(F.collect_set("own"))), F.max("n")).first()
    # A side that rounding makes longer than ``left_span`` stays on the last level.
    left_own = F.least(_level(left_box, longest), F.lit(max(left_levels, default=0)))
    spread = _spread(left, left_box, bin_size, left_own, right_levels or []).withColumnsRenamed(
        {"_own": "_left_own", "_fx": "_left_fx", "_fy": "_left_fy"})
    lx0, ly0, lx1, ly1 = (F.col(c) for c in left_box)
    rx0, ry0, rx1, ry1 = (F.col(c) for c in right_box)
    meets = (lx0 <= rx1) & (rx0 <= lx1) & (ly0 <= ry1) & (ry0 <= ly1) & (F.col("_level") == F.greatest("_left_own", "_right_own"))
    once = (F.greatest("_left_fx", "_right_fx") == F.col("_bx")) & (F.greatest("_left_fy", "_right_fy") == F.col("_by"))
    crowded = (fullest or 0) > min_rows
    # A side that is read in few tasks would else make all pairs there, beside a broadcast of the other.
    dealt = binned.hint("merge") if (fullest or 0) > FULL_BIN else binned
    joined = salted_join(spread, binned, bins, min_rows, count=("right",)) if crowded else spread.join(dealt, bins)
    return joined.filter(once & meets).drop("_level", "_bx", "_by", "_right_level", *[
        f"_{side}_{name}" for side in ("left", "right") for name in ("own", "fx", "fy")])

"""Keyed operators: keep-first, duplicates, upsert, one-to-one join, lookups.

Every group is reduced on the map side before it is shuffled, so a key that owns a
large share of the rows costs its reducer one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.errors import DataError


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the whole row that comes first in ``order`` for each key."""
    kept = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(kept).select("_row.*")


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Keep the whole row with the greatest ``ts`` for each key; ties go to the greatest row."""
    rest = [c for c in df.columns if c != ts]
    newest = F.max(F.struct(ts, *rest)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def require_unique(df: DataFrame, keys: Sequence[str], label: str) -> None:
    if not duplicate_keys(df, keys).isEmpty():
        raise DataError(f"{label} has duplicate keys: {', '.join(keys)}")


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` replace rows of ``base`` with the same key; the rest stay.

    ``order`` says which of several new rows per key wins (the last one); without it, a key
    that repeats is an error, as is a null key.
    """
    if not new.filter(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).isEmpty():
        raise DataError(f"new rows have null keys: {', '.join(keys)}")
    if not order:
        require_unique(new, keys, "new rows")
    else:
        winner = F.max_by(F.struct(*new.columns), F.struct(*order)).alias("_row")
        new = new.groupBy(*keys).agg(winner).select("_row.*")
    kept = base.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new.select(*base.columns))


def key_changes(changes: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """(old_key, new_key) of keys the parent holds, once the change leaves every parent key filled and single.

    ``changes`` has ``old_key`` and ``new_key``; an old key that repeats, a null, or two rows that end on one key is an error.
    Keys may be swapped or passed on in a chain: all change at once.
    """
    if not changes.filter("old_key IS NULL OR new_key IS NULL").isEmpty():
        raise DataError("key changes have null keys")
    require_unique(changes, ["old_key"], "key changes")
    moved = parent.select(F.col(key).alias("old_key")).join(changes, "old_key", "left")
    require_unique(moved.select(F.coalesce("new_key", "old_key").alias(key)), [key], "keys after the change")
    return moved.filter("new_key IS NOT NULL")


def change_keys(df: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """Rows under their new keys, in a parent or in a table that refers to it; other rows, nulls too, stay.

    One left join with a table that has each old key once, so a key that owns many rows can be split by Spark.
    """
    told = applied.select(F.col("old_key").alias(key), F.col("new_key").alias("_new_key"))
    return df.join(told, key, "left").withColumn(key, F.coalesce("_new_key", key)).select(*df.columns)


def cascade_update(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]],
                   changes: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Change keys of a parent and of all tables that refer to it (name: (table, column)), which stay free of orphans."""
    applied = key_changes(changes, parent, key)
    return change_keys(parent, applied, key), {name: change_keys(df, applied, column) for name, (df, column) in children.items()}


def one_to_one_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that refuses duplicate keys on either side."""
    require_unique(left, keys, "left side")
    require_unique(right, keys, "right side")
    return left.join(right, list(keys), "left")


def cell_lookup(requested: DataFrame, grid: DataFrame, features: DataFrame, key: str = "cell_id") -> DataFrame:
    """Each requested key with its features and 'unknown', 'empty' or 'found'.

    Gives one answer per distinct key, so a popular key does not pile up in one task.
    """
    keys = requested.select(key).distinct()
    known = grid.select(key).distinct().withColumn("_in_grid", F.lit(True))
    filled = features.withColumn("_has_features", F.lit(True))
    status = (
        F.when(F.col("_in_grid").isNull(), "unknown")
        .when(F.col("_has_features").isNull(), "empty")
        .otherwise("found")
    )
    joined = keys.join(known, key, "left").join(filled, key, "left")
    columns = [c for c in features.columns if c != key]
    blank: list[Column] = [F.when(status != "unknown", F.col(c)).alias(c) for c in columns]
    return joined.select(key, status.alias("status"), *blank)

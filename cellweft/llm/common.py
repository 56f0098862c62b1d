"""Helpers shared by the corpus operators: batch size, written copies, shared values."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cellweft.session import configure, scratch_path


#: Workers give batches back to the system when they are done with them, instead of pooling them.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576",
                 "MALLOC_TRIM_THRESHOLD_": "1048576"}


def tune(spark: SparkSession) -> SparkSession:
    """Bound the rows and bytes of one Arrow batch, so long texts don't fill a task's memory.

    Workers import this package: on a cluster ship it with ``--py-files``; where the
    driver's folder is visible, as in a local session, its path is passed on.
    """
    configure(spark)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark


def written(df: DataFrame, label: str) -> DataFrame:
    """Write rows to the folder all executors share and go on from that copy."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, label: str, rows: int = 10_000) -> DataFrame:
    """A written copy, hinted for broadcast only if it has at most ``rows`` rows; beyond, joins shuffle."""
    kept = written(df, label)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fields(**kinds: str) -> T.StructType:
    """A schema from names and type texts."""
    return T.StructType([T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in kinds.items()])


def number_copies(rows: DataFrame, step: int) -> DataFrame:
    """The same rows with ``copy``, which numbers equal rows from 0; a task makes ``step`` copies of a row at a time."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    single = counted.filter("n = 1").select(*rows.columns, F.lit(0).cast("long").alias("copy"))
    starts = counted.filter("n > 1").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
    dealt = starts.repartition(*rows.columns, "copy")
    ends = F.least(F.col("copy") + step, F.col("n")) - 1
    return single.unionByName(dealt.select(*rows.columns, F.explode(F.sequence("copy", ends)).alias("copy")))


def by_groups(df: DataFrame, keys: list[str], fn: Callable[[tuple, dict], list], schema: T.StructType,
              order: list[str] | None = None) -> DataFrame:
    """Rows that ``fn(key, columns)`` returns for every group; many small groups share one task and batch.

    Groups are dealt by a hash of their keys and sorted within the partition; ``columns`` maps
    names to arrays. A group is held whole, so callers bound its rows.
    """
    names = [f.name for f in schema]

    def run(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None or held.empty else pd.concat([held, pdf], ignore_index=True)
            columns = {c: held[c].to_numpy() for c in held.columns}
            change = np.zeros(len(held), bool)
            change[:1] = True
            for c in keys:
                change[1:] |= columns[c][1:] != columns[c][:-1]
            starts = np.flatnonzero(change).tolist()
            yield from emit(columns, starts, starts[1:])
            held = held.iloc[starts[-1]:] if starts else held
        if held is not None and not held.empty:
            yield from emit({c: held[c].to_numpy() for c in held.columns}, [0], [len(held)])

    def emit(columns, starts, ends):
        rows = []
        for a, b in zip(starts, ends):
            rows += fn(tuple(columns[k][a] for k in keys), {c: v[a:b] for c, v in columns.items()})
        if rows:
            yield pd.DataFrame(rows, columns=names)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *(order or []))
    return dealt.mapInPandas(run, schema)

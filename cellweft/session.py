"""Session settings, shared scratch folders and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app_name: str = "cellweft", master: str | None = None, **settings) -> SparkSession:
    """Start (or get) a session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Set the run-time SQL options that results and plans rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # A first-n per key up to a few thousand is cut before its shuffle.
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Return the folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may do
    without; it then uses a folder in the warehouse.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError(f"{CHECKPOINT_SETTING} must name a shared folder on a cluster")
    context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch")
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """Return a fresh path under the shared folder; nothing is written yet."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from the written copy.

    A lost executor then costs a re-read, not a recomputation of everything before.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)

"""Session defaults and the shared folder that cuts long lineages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Only settings the operators depend on. Partition counts, memory and broadcast
# thresholds stay with the cluster; AQE sizes the shuffles.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Fixed value: Spark's switch for removing a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "stormline", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_time_zone(spark: SparkSession) -> None:
    """Every stamp in the data model is UTC; a session in another zone would shift hours."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor see: the cluster's checkpoint folder, else one in the warehouse.

    A warehouse on the driver's own disk is no such folder, so on a cluster that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (":" not in warehouse or warehouse.startswith("file:")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse + "/_stormline_shared"


def pinned(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder so that several consumers read it back.

    A columnar table, so each consumer reads only its columns and filters reach the
    scan; a lost executor costs a re-read and not a recompute. Shuffle files of the write go
    when it ends, as nothing reads them again. ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pinned-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)

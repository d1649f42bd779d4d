"""Session settings and reliable intermediate storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "shirelens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (AQE with skew splitting, UTC)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; where that is unset, one inside the warehouse.

    Both are storage that driver and executors share; a machine-local temporary folder is never used.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if configured is None and current is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        # the default warehouse is a folder beside the driver's process: shared only when everything runs in that process
        chosen = sc.getConf().contains("spark.sql.warehouse.dir")
        if not warehouse or not (chosen or sc.master.startswith("local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = f"{warehouse.rstrip('/')}/_shared"
    if current is None:
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    return (configured or current).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, balance: bool = False) -> DataFrame:
    """Cut lineage with a table written to the shared folder.

    Unlike a cached or locally checkpointed frame it survives the loss of any executor, and reading it
    back gives the planner true sizes and column pruning.  With ``balance``, the table is dealt out evenly before it is
    written, for steps that compute far more than they read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df.repartition(spark.sparkContext.defaultParallelism) if balance else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; used where the partition layout must be kept."""
    shared_dir(df.sparkSession)
    return df.checkpoint()

"""SparkSession helpers.

Settings are only applied when this module creates the session; a session
handed in by a caller (cluster job, test) is used as is.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "tandem",
              shuffle_partitions: int | None = None) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus) * 2))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``, the same at every call.

    On a cluster this setting points at shared storage and is only read; it
    must be set there, since other machines do not see a local folder. Where it
    is unset in local mode (tests) a private folder is created and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tandem-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def set_checkpoints(spark: SparkSession) -> None:
    """Make the shared checkpoint folder that of RDDs too, where none is set."""
    path = checkpoint_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:  # each call would name a new folder
        spark.sparkContext.setCheckpointDir(path)


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    set_checkpoints(df.sparkSession)
    return df.checkpoint(eager=eager)

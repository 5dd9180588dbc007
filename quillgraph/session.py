"""Session helpers shared by every plan: reading tables and cutting lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "quillgraph") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local session, as in tests, may do without and gets a private one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"quillgraph-{uuid.uuid4().hex[:8]}")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet below the shared checkpoint folder and read it back; ``release`` deletes it.

    Cuts lineage like ``checkpoint()``, survives the loss of any executor, and keeps columns prunable by
    the readers that follow.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    stage = spark.read.schema(df.schema).parquet(path)
    stage._stage = path
    return stage


def release(*stages: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``stages``, once nothing that is still to run reads it."""
    for stage in stages:
        spark = stage.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(stage._stage)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by the cluster in spark.checkpoint.dir.

    Only a local session may fall back to a folder of its own; a cluster without the
    setting is an error, since a machine-local folder would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"trawl-checkpoints-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch(spark: SparkSession, kind: str) -> str:
    """The name of a new folder in the shared checkpoint folder, removed when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def spill(df: DataFrame) -> DataFrame:
    """Write a frame as a compressed table in the shared checkpoint folder and read that: its lineage ends there."""
    path = scratch(df.sparkSession, "spill")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


cut = spill


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already; the cluster clears its checkpoint folder
        pass

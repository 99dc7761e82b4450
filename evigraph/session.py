"""Session helpers: tests and local runs only; on a cluster the session is given."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evigraph")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("EVIGRAPH_DRIVER_MEMORY", "8g"))
        .config("spark.driver.extraJavaOptions", "-Xss4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Share rows out over all cores when the input has fewer splits than there are cores.

    Large inputs have more splits than cores and pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would lose data, so the setting is required there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="evigraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def persist_table(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Cut lineage by writing to the shared folder; survives the loss of executors.

    ``compression`` (the session's by default) may be "none" for hashes, which do not shrink.
    """
    path = work_path(df.sparkSession, label)
    (df.write if compression is None else df.write.option("compression", compression)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

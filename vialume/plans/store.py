"""Intermediate tables in the folder that the cluster shares, and results kept by their configuration."""

from __future__ import annotations

import gc
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vialume-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these frames; nothing may read them any more."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            df.stored_at = None


def release(spark: SparkSession) -> None:
    """Let the cleaner delete shuffle files of frames that nothing refers to: it goes by the driver's garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def cached(spark: SparkSession, folder: str, config: dict, compute: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``compute`` for a configuration, computed once: kept under a hash of all of ``config``."""
    key = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:32]
    path = f"{folder.rstrip('/')}/{key}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # not there yet
        compute().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

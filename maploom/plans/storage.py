"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="maploom-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = f"file://{_own[0]}"
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: iterations neither grow their plan nor repeat their work, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/maploom/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

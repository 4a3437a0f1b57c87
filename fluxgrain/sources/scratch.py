"""Intermediate tables in the folder that all executors share: they cut lineage durably."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary one if the session is local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="fluxgrain-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already; its scratch folder goes with it
        pass


def keep(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df, written once as Parquet and read back: it outlives lost executors and is computed once
    however often it is used.  Removed when the driver ends.  options are the writer's."""
    spark = df.sparkSession
    path = f"{folder(spark)}/fluxgrain-{label}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    atexit.register(remove, spark, path)
    kept = spark.read.schema(df.schema).parquet(path)
    _PATHS[kept] = path
    return kept


def release(*tables: DataFrame) -> None:
    """Remove kept tables, each by the very frame that keep returned; others are left alone."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            remove(t.sparkSession, path)

"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder of our own in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that does not exist yet; what is written there goes when the interpreter ends."""
    path = f"{shared_dir(spark)}/verdigris-{uuid.uuid4().hex}/{name}"
    _made.append((spark, path))
    return path


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a written table: cuts the lineage of loops and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def remove_all() -> None:
    """Removes what new_folder has named; frames that read it can't be used any more."""
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            removed(spark, path)
    _made.clear()

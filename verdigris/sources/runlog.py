"""A log of runs that grows batch by batch: one list of values for each instance, model and task.

    {path}/batches/token=b.../  the rows of a batch, written as a whole
    {path}/commits/             one row for each batch that counts

A batch counts from the moment its row stands in `commits`, so readers see whole
batches, and a batch that broke off is never seen. Its token names it: trying a
token again before it is committed replaces its rows, trying it again afterwards
changes nothing. One writer appends at a time; readers need not wait.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.sources.scratch import removed

KEYS = ["instance", "model", "task"]
#: Up to so many batches are sent to all tasks, so that only their folders are read.
BROADCAST_BATCHES = 100_000
_FOLDER = "b."  # so that no token looks like a number or a date
_COMMIT = "token string, batch long, rows long, replaces array<string>"


def commits(spark: SparkSession, path: str) -> DataFrame | None:
    """token, batch, rows of the batches that count and were not compacted into others; None before the first."""
    try:
        rows = spark.read.schema(_COMMIT).json(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    one = rows.groupBy("token").agg(F.min("batch").alias("batch"), F.max("rows").alias("rows"))
    return one.join(rows.select(F.explode("replaces").alias("token")).distinct(), "token", "left_anti")


def _next_batch(spark: SparkSession, path: str) -> int:
    last = spark.read.schema(_COMMIT).json(f"{path}/commits").agg(F.max("batch")).first()[0]
    return 0 if last is None else last + 1


def read_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """instance, model, task, run long, value and other columns given, of all batches that count; None before the first one."""
    live = commits(spark, path)
    if live is None:
        return None
    few = live.limit(BROADCAST_BATCHES + 1).count() <= BROADCAST_BATCHES
    names = live.select(F.concat(F.lit(_FOLDER), "token").alias("token"))
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/batches").join(F.broadcast(names) if few else names, "token", "left_semi").drop("token")


def _committed(spark: SparkSession, path: str, token: str) -> bool:
    try:
        return not spark.read.schema(_COMMIT).json(f"{path}/commits").where(F.col("token") == token).isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _commit(spark: SparkSession, path: str, token: str, replaces: list[str] = ()) -> None:
    rows = spark.read.parquet(f"{path}/batches/token={_FOLDER}{token}").count()
    batch = 0 if commits(spark, path) is None else _next_batch(spark, path)
    spark.createDataFrame([(token, batch, rows, list(replaces))], _COMMIT).coalesce(1).write.mode("append").json(f"{path}/commits")


def append_runs(values: DataFrame, path: str, token: str, order: str | None = None) -> bool:
    """Appends values (instance, model, task, value, ...) as one batch. False if this token is committed already.

    A value's run is the number of values that its key has before it: those of
    earlier batches, then those of this one in `order` (a column; without it, of
    several values of a key in one batch any may come first). Null parts of a
    key are values like any other. No earlier file is rewritten, and of the
    history only keys and runs of the keys at hand are looked at.
    """
    spark = values.sparkSession
    if not token or any(c in token for c in "/=\\ %"):
        raise ValueError("a token names a folder")
    if _committed(spark, path, token):
        return False
    before = read_runs(spark, path)
    nth = F.row_number().over(Window.partitionBy(*KEYS).orderBy(order if order else F.lit(0))).cast("long") - 1
    numbered = values.withColumn("_nth", nth)
    if before is None:
        runs = numbered.withColumn("run", F.col("_nth"))
    else:
        seen = before.groupBy(*KEYS).agg((F.max("run") + 1).alias("_next")).select(F.struct(*KEYS).alias("_key"), "_next")
        runs = numbered.withColumn("_key", F.struct(*KEYS)).join(seen, "_key", "left").withColumn("run", F.coalesce("_next", F.lit(0).cast("long")) + F.col("_nth")).drop("_key", "_next")
    rest = [c for c in values.columns if c not in (*KEYS, "run")]
    runs.select(*KEYS, "run", *rest).write.mode("overwrite").parquet(f"{path}/batches/token={_FOLDER}{token}")
    _commit(spark, path, token)
    return True


def lists(runs: DataFrame, value: str = "value") -> DataFrame:
    """instance, model, task, items: each key's values in the order of their runs."""
    return runs.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("run", value))), lambda x: x[value]).alias("items"))


def compact(spark: SparkSession, path: str, token: str) -> bool:
    """Writes the rows of all batches that count as one batch, which takes their place in the moment it is committed. Their folders stay until vacuum. False if the token is committed already."""
    if _committed(spark, path, token):
        return False
    live = [r.token for r in commits(spark, path).select("token").collect()]  # names of batches, which this call makes one again
    read_runs(spark, path).write.mode("overwrite").parquet(f"{path}/batches/token={_FOLDER}{token}")
    _commit(spark, path, token, live)
    return True


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes the folders of batches that were compacted into others, once no reader needs them any more; their names."""
    gone = [r.token for r in spark.read.schema(_COMMIT).json(f"{path}/commits").select(F.explode("replaces").alias("token")).distinct().collect()]
    for token in gone:
        removed(spark, f"{path}/batches/token={_FOLDER}{token}")
    return sorted(gone)

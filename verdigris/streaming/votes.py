"""Votes over labels that arrive run by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def running_counts(labels: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """keys, label, n, first_pos over a stream: the state is one row for each key and label, whatever the number of runs."""
    return labels.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(order).alias("first_pos"))


def votes_of(counts: DataFrame, keys: list[str], label: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("n"), F.col("first_pos"))).alias("vote"), F.max("n").alias("n_votes"))


def write_counts(labels: DataFrame, keys: list[str], label: str, order: str, path: str, checkpoint: str, available_now: bool = False) -> None:
    """Writes the counts that each batch of the stream `labels` changes, under the batch's number. available_now: stop when what is there is read.

    A batch's folder is replaced when the batch is tried again, and no other is
    touched, so readers always find a whole table; its counts are totals, not
    increments, so the newest row of a cell and label holds.
    """

    def add(counts: DataFrame, batch: int) -> None:
        counts.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    writer = running_counts(labels, keys, label, order).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(add)
    stream = (writer.trigger(availableNow=True) if available_now else writer).start()
    if available_now:
        stream.awaitTermination()


def current_counts(written: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, label, n, first_pos: the newest row of each cell and label of what write_counts has written."""
    newest = F.max_by(F.struct("n", "first_pos"), "batch").alias("x")
    return written.groupBy(*keys, label).agg(newest).select(*keys, label, "x.*")


def current_votes(spark: SparkSession, path: str, keys: list[str], label: str) -> DataFrame:
    """keys, vote, n_votes as of the last whole batch."""
    return votes_of(current_counts(spark.read.parquet(path), keys, label), keys, label)


def compact(spark: SparkSession, path: str, target: str, keys: list[str], label: str) -> None:
    """The newest counts alone, under batch -1 of another folder that write_counts can go on with."""
    current_counts(spark.read.parquet(path), keys, label).withColumn("batch", F.lit(-1).cast("long")).write.mode("overwrite").partitionBy("batch").parquet(target)

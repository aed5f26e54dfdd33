"""Votes over repeated labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority_vote(labels: DataFrame, keys: list[str], label: str, order: str, all_keys: DataFrame | None = None, last_wins: bool = False) -> DataFrame:
    """keys, vote, n_votes: the most frequent label of each key, ties to the one seen first (or last) in `order`.

    Two partial aggregations and no window, so a key with very many labels is
    summed up before it moves. order may be of any type that has an order; a
    label that has no place in it loses ties. Null labels don't vote. Keys of all_keys without votes get an empty vote.
    """
    seen = F.max(order) if last_wins else F.min(order)
    counted = labels.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"), seen.alias("_at"))
    # The largest count, then the earliest (latest) place: both as one comparable struct.
    best = F.max_by(label, F.struct("_n", "_at")) if last_wins else F.min_by(label, F.struct(-F.col("_n"), F.col("_at").isNull(), F.col("_at")))
    voted = counted.groupBy(*keys).agg(best.alias("vote"), F.max("_n").alias("n_votes"))
    if all_keys is None:
        return voted
    return all_keys.select(*keys).distinct().join(voted, keys, "left").withColumn("vote", F.coalesce("vote", F.lit(""))).withColumn("n_votes", F.coalesce("n_votes", F.lit(0).cast("long")))


def vote_over_rounds(votes: DataFrame, keys: list[str], label: str, round_: str, base: DataFrame | None = None) -> DataFrame:
    """The majority of each cell's stripped labels over rounds; cells without any keep the base table's value."""
    clean = votes.withColumn(label, F.regexp_replace(label, "^\\s+|\\s+$", ""))
    voted = majority_vote(clean, keys, label, round_)
    if base is None:
        return voted
    return base.select(*keys, F.col(label).alias("_base")).join(voted, keys, "left").select(*keys, F.coalesce("vote", "_base").alias("vote"), F.coalesce("n_votes", F.lit(0).cast("long")).alias("n_votes"))


def disagreement(labels: DataFrame, keys: list[str], label: str, by: list[str]) -> DataFrame:
    """by, n_cells, n_disagree: cells with a label, and those with several different ones."""
    cells = labels.groupBy(*keys).agg(F.min(label).alias("_low"), F.max(label).alias("_high")).where("_low IS NOT NULL")
    return cells.groupBy(*by).agg(F.count("*").alias("n_cells"), F.count_if(F.col("_low") != F.col("_high")).alias("n_disagree"))


def is_unanimous(labels: Column) -> Column:
    """Whether an array of labels holds at most one value."""
    return F.size(F.array_distinct(labels)) <= 1


def unanimity(labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, n_distinct, unanimous."""
    return labels.groupBy(*keys).agg(F.count_distinct(label).alias("n_distinct")).withColumn("unanimous", F.col("n_distinct") <= 1)

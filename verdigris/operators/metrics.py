"""Accuracy, agreement, kappa and rates over long pairs (group, human, predicted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.labels import matches


def accuracy(pairs: DataFrame, by: list[str], human: str, predicted: str) -> DataFrame:
    """by, n, mismatches, accuracy over pairs that are known on both sides; a group without any has accuracy 0."""
    known = F.col(human).isNotNull() & F.col(predicted).isNotNull()
    wrong = F.count_if(known & (F.col(human) != F.col(predicted)))
    out = pairs.groupBy(*by).agg(F.count_if(known).alias("n"), wrong.alias("mismatches"))
    return out.withColumn("accuracy", F.coalesce(F.try_divide(F.col("n") - F.col("mismatches"), F.col("n")), F.lit(0.0)))


def agreement(pairs: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """by, n, matches, rate, pooled: pairs whose first side is known; a missing second side disagrees."""
    same = matches(F.col(first), F.col(second))
    out = pairs.where(F.col(first).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(same).alias("matches"))
    return out.withColumn("rate", F.try_divide(F.col("matches"), F.col("n")))


def overall_agreement(pairs: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """cells, matches, overall (of values alone) and overall_with_keys, which counts the key as one more column that always matches."""
    same = matches(F.col(first), F.col(second))
    out = pairs.agg(F.count("*").alias("cells"), F.count_if(same).alias("matches"), F.count_distinct(key).alias("keys"))
    return out.select("cells", "matches", F.try_divide("matches", "cells").alias("overall"), F.try_divide(F.col("matches") + F.col("keys"), F.col("cells") + F.col("keys")).alias("overall_with_keys"))


def kappa(pairs: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """by, n, agreed, kappa (Cohen, unweighted) over pairs known on both sides; null where only one label occurs at all.

    One aggregation to a row for each (by, first, second), everything after it
    works on that contingency table.
    """
    table = pairs.na.drop(subset=[first, second]).groupBy(*by, first, second).agg(F.count("*").alias("_n"))
    both = table.select(*by, F.col("_n"), F.explode(F.array(F.struct(F.col(first).alias("label"), F.lit(1).alias("side")), F.struct(F.col(second).alias("label"), F.lit(2).alias("side")))).alias("x"))
    one = lambda side: F.sum(F.when(F.col("x.side") == side, F.col("_n")).otherwise(0))
    chance = both.groupBy(*by, F.col("x.label").alias("label")).agg((one(1).cast("decimal(38,0)") * one(2).cast("decimal(19,0)")).cast("double").alias("_p")).groupBy(*by).agg(F.sum("_p").alias("_p"))
    totals = table.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col(first) == F.col(second), F.col("_n")).otherwise(0)).alias("agreed"))
    joined = totals.join(chance, by) if by else totals.crossJoin(chance)  # one row each
    n = F.col("n").cast("double")
    expected = F.col("_p") / (n * n)
    return joined.select(*by, "n", "agreed", F.try_divide(F.col("agreed") / n - expected, 1 - expected).alias("kappa"))


def rates_by_cause(rows: DataFrame, by: list[str], with_runtime: str, without_runtime: str, hit: str = "correct", support: int = 5) -> DataFrame:
    """by, n, with_rate, without_rate, improvement for groups of at least `support` rows; a missing prediction counts in n and is no hit."""
    share = lambda c: F.count_if(F.col(c) == hit) / F.count("*")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), share(with_runtime).alias("with_rate"), share(without_runtime).alias("without_rate")).where(F.col("n") >= support)
    return out.withColumn("improvement", F.col("with_rate") - F.col("without_rate"))


def value_counts(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count("*").alias("n"))


def long_pairs(wide: DataFrame, key: str, registry: list[tuple[str, str, str, str]]) -> DataFrame:
    """key, system, variant, human, predicted of a wide table by a registry (system, variant, human column, predicted column). Pairs whose column is missing give no rows."""
    have = [r for r in registry if r[2] in wide.columns and r[3] in wide.columns]
    cell = lambda r: F.struct(F.lit(r[0]).alias("system"), F.lit(r[1]).alias("variant"), F.col(f"`{r[2]}`").alias("human"), F.col(f"`{r[3]}`").alias("predicted"))
    return wide.select(key, F.explode(F.array(*map(cell, have))).alias("x")).select(key, "x.*") if have else wide.select(key, *[F.lit(None).cast("string").alias(c) for c in ("system", "variant", "human", "predicted")]).limit(0)


def improvement(with_rate: Column, without_rate: Column) -> Column:
    return with_rate - without_rate

"""Long and wide summaries, their joins and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.labels import matches
from verdigris.sources.scratch import kept


def pivoted(facts: DataFrame, keys: list[str], column: str, values: list[str], value: str, order: str) -> DataFrame:
    """One row for each key with a column for each of `values`; of several facts in a cell the last by `order` counts."""
    return facts.groupBy(*keys).pivot(column, values).agg(F.max_by(value, order))


def unpivoted(wide: DataFrame, keys: list[str], columns: list[str], name: str = "column", value: str = "value") -> DataFrame:
    return wide.unpivot(keys, columns, name, value)


def union_last_wins(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all tables, by key those of the last table that has the key."""
    out = tables[0].withColumn("_t", F.lit(0))
    for k, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.withColumn("_t", F.lit(k)))
    rest = [c for c in tables[0].columns if c not in keys]
    best = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_t").alias("_r"))
    return best.select(*keys, "_r.*")


def suffixed_outer(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Full outer join on key; only names that both sides have get a suffix. The key column holds whichever side's key there is."""
    both = (set(left.columns) & set(right.columns)) - {key}
    rename = lambda df, s: df.select(*[F.col(f"`{c}`").alias(c + s if c in both else c) for c in df.columns])
    return rename(left, suffixes[0]).join(rename(right, suffixes[1]), key, "full")


def suffixed_inner(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str], known: list[str] = ()) -> DataFrame:
    """Inner join on key with suffixes as above; rows of the left side without a value in `known` are left out first."""
    both = (set(left.columns) & set(right.columns)) - {key}
    rename = lambda df, s: df.select(*[F.col(f"`{c}`").alias(c + s if c in both else c) for c in df.columns])
    return rename(left.na.drop(subset=list(known)) if known else left, suffixes[0]).join(rename(right, suffixes[1]), key)


def match_flags(pairs: DataFrame, human: str, predicted: str, name: str = "match") -> DataFrame:
    return pairs.withColumn(name, matches(F.col(human), F.col(predicted)))


def known_pairs(pairs: DataFrame, columns: list[str]) -> DataFrame:
    return pairs.na.drop(subset=columns)


def unique_lookup(table: DataFrame, key: str, value: str) -> DataFrame:
    """key, value of keys that stand in the table exactly once."""
    return table.groupBy(key).agg(F.count("*").alias("_n"), F.first(value).alias(value)).where("_n = 1").drop("_n")


def ground_truth_text(detection: Column, diagnosis: Column) -> Column:
    """`Ground truth: detection. diagnosis` after a line break, the detection spelt True or False; without a diagnosis nothing follows the blank. A missing detection gives an empty text."""
    said = F.when(detection, "True").otherwise("False")
    return F.when(detection.isNull(), "").otherwise(F.concat(F.lit("\nGround truth: "), said, F.lit(". "), F.coalesce(diagnosis, F.lit(""))))


def with_ground_truth(rows: DataFrame, truth: DataFrame, key: str, detection: str, diagnosis: str, name: str = "ground_truth") -> DataFrame:
    """rows with the text of their key's ground truth, empty where the key is absent or stands there more than once."""
    text = truth.select(key, ground_truth_text(F.col(detection), F.col(diagnosis)).alias(name))
    return looked_up(rows, text, key, name)


def looked_up(rows: DataFrame, table: DataFrame, key: str, value: str, missing: str = "") -> DataFrame:
    """rows with the value of their key, or `missing` where the key is absent or stands there more than once."""
    return rows.join(unique_lookup(table, key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def scattered(table: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
    """table with new values where updates have the key; unknown keys and null values change nothing. An error where several updates have one key of the table."""
    one = updates.groupBy(key).agg(F.count("*").alias("_n"), F.first(value).alias("_new"))
    new = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several updates of "), F.col(key).cast("string")))).otherwise(F.coalesce("_new", value))
    return table.join(one, key, "left").withColumn(value, new).drop("_new", "_n")


def positioned(table: DataFrame, order: list[Column], name: str = "position", partitions: list[str] = ()) -> DataFrame:
    """table with a 1-based position in an order, within `partitions` or among all rows; of rows that tie any may come first.

    All rows are numbered without meeting in one task: they are dealt by ranges
    of the order (of ties, by a hash of the row) and sorted within them, and a
    row's position is its place in its range behind the sizes of the ranges
    before. The dealt rows are written once, so that places and sizes agree.
    """
    if partitions:
        return table.withColumn(name, F.row_number().over(Window.partitionBy(*partitions).orderBy(*order)).cast("long"))
    spark = table.sparkSession
    hashable = [F.col(f"`{f.name}`") for f in table.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keys = [*order, F.xxhash64(*hashable)] if hashable else order
    dealt = table.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("row"), F.monotonically_increasing_id().alias("at"))
    dealt = kept(dealt.select("row", F.shiftright("at", 33).cast("int").alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ranges")
    starts, n = [], 0
    for r in dealt.groupBy("range").count().orderBy("range").collect():  # a row for each range
        starts.append((r["range"], n))
        n += r["count"]
    before = F.broadcast(spark.createDataFrame(starts, "range int, before long"))
    return dealt.join(before, "range").select("row.*", (F.col("before") + F.col("at") + 1).alias(name))


def head_by_position(table: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The first n rows by a stored 1-based ordinal; a plain limit knows no positions."""
    return table.where(F.col(ordinal) <= n)


def first_seen(table: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values with the place of their first appearance."""
    return table.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("first_seen"))

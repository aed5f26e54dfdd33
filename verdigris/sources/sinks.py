"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(table: DataFrame, path: str, form: str = "parquet", by: list[str] = ()) -> None:
    """The whole table, in place of what was there."""
    writer = table.write.mode("overwrite").partitionBy(*by) if by else table.write.mode("overwrite")
    (writer.option("header", "true") if form == "csv" else writer).format(form).save(path)


def write_json_lists(items: DataFrame, keys: list[str], item: str, order: str, path: str) -> None:
    """One row of JSON for each key: the keys and `items`, an array in order."""
    lists = items.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, item))), lambda x: x[item]).alias("items"))
    lists.write.mode("overwrite").json(path)


def write_texts(texts: DataFrame, key: str, text: str, path: str) -> None:
    """One file for each text, in a folder for its key; each ends with one line break, the text's own or an added one. Keys must be unique."""
    texts.select(F.col(key), F.regexp_replace(text, "\\n\\z", "").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_missing(texts: DataFrame, done: DataFrame, key: str, path: str) -> None:
    """Only keys that aren't done yet."""
    texts.join(done.select(key).distinct(), key, "left_anti").write.mode("append").parquet(path)


def show(table: DataFrame, n: int = 50) -> None:
    table.show(n, truncate=False)

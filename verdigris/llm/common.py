"""Shared plumbing: table reads, written intermediate tables, connected components."""

from __future__ import annotations

import atexit
import contextlib
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_written: list[tuple[SparkSession, str]] = []

#: Records handed to a Python worker at once; texts can be long, so far fewer than Spark's 10,000.
BATCH_ROWS = 1000
FEW, LEAST_TASKS = 50_000, 12
#: A key with over this part of all rows is joined by broadcast: there are fewer than so many.
HEAVY = 1000
#: With this setting Spark removes an action's shuffle files when the action ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS, so that a batch of long texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def kept_in_worker(key: tuple, make: Callable[[], T]) -> T:
    """make()'s value, made once in a Python worker process and kept for its later tasks."""
    kept = sys.modules.setdefault("_verdigris_kept", types.ModuleType("_verdigris_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


@atexit.register
def remove_all_written() -> None:
    """Removes every table of written() that is left. Frames that read them can't be used any more."""
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
    _written.clear()


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions inside leave no shuffle files behind; the session's own setting comes back."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, folder: str | None = None, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    rows: how many there are at most, given for tables of a few numbers a row
    alone. They are then written by a task for each FEW of them, of which a
    task takes a moment, and not by every shuffle partition there may be.

    It is removed by drop_written, or else when the interpreter ends: a lazy
    result still reads its last tables.
    """
    spark = df.sparkSession
    path = f"{folder or f'{shared_dir(spark)}/verdigris-{uuid.uuid4().hex}'}/{name}"
    with shuffles_removed(spark):
        (df if rows is None else df.coalesce(max(LEAST_TASKS, rows // FEW))).write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._verdigris_path = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Removes tables made by written() that nothing lazy refers to any more."""
    for df in frames:
        if path := getattr(df, "_verdigris_path", None):
            _remove(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores behind it a name that no column of df has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def by_key(df: DataFrame) -> DataFrame:
    """df, to be joined by sorting on the key at every size: a side that grows with the data must not be sent to all tasks where it happens to be small, and the plan stays the same."""
    return df.hint("merge")


def by_hash(df: DataFrame) -> DataFrame:
    """df, to be joined by a hash table of its shuffled part: for a side of one short row a key, which is far smaller than the other, so that the other need not be sorted. A hot key of the other side is split as in by_key."""
    return df.hint("shuffle_hash")


def joined_apart(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows left-joined with groups (one row for each key, never null, with its number of rows, `size`, of `total`): null columns where there is none.

    Groups of over a HEAVY-th of all rows, so fewer than HEAVY, are sent to all
    tasks and their rows stay where they are; the rest is joined by key, of
    which none has more than that part. rows is read twice.
    """
    heavy = F.col(size) * HEAVY > total
    marked = rows.join(F.broadcast(groups.where(heavy).withColumn("_heavy", F.lit(True))), keys, "left")
    light = marked.where("_heavy IS NULL").select(*rows.columns).join(by_hash(groups.where(~heavy)), keys, "left")
    return marked.where("_heavy").drop("_heavy").unionByName(light)


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from a seeded hash of the columns."""
    return (F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


def linked_components(links: DataFrame) -> DataFrame | None:
    """id, component (the smallest id that links reach) of all ids in links (a, b long); None without links.

    Alternating stars: every id first links its larger neighbours to the
    smallest one it knows, then its smaller neighbours and itself. The ids known
    to be smallest spread in a number of rounds that grows with the logarithm of
    the ids, on long paths too, and the links end as stars around the smallest
    ids. Each step is written to the shared folder.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    sign = lambda df: tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).collect()[0])
    before = sign(edges)
    if not before[0]:
        drop_written(edges)
        return None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = 2 * before[0]
        low = written(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "low", rows=n)
        large = written(both.where("v > u").join(by_key(low), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "large", rows=n)
        low_of = written(large.groupBy("u").agg(F.min("v").alias("low")), "low", rows=n)
        ends = F.explode(F.array("u", "v")).alias("u")
        new = written(large.join(by_key(low_of), "u").select(ends, F.col("low").alias("v")).where("u <> v").distinct(), "edges", rows=n)
        drop_written(edges, low, large, low_of)
        edges, now = new, sign(new)
        if now == before:
            break
        before = now
    centres = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres)

"""Sharding by balanced label propagation.

Documents of equal text are one unit (a group larger than an eighth of a shard
is dealt into several). Units are linked where they share a line of at least
MIN_LINE characters; a line in m units links each to the m - 1 others, with a
weight of UNIT / (m - 1), so a line that all documents have pulls nowhere. The
links are never listed: a line counts the labels of its units, and a unit votes
over its lines' counts without its own part, so a frequent line is one row of as
many counts as there are shards; those of the most frequent lines are sent to
all tasks, so no line gathers its units. Labels start from a hash of the text.
In each round a unit wishes to go where most of its links' weight lies; the
wishes are counted by (from, to, power of the gain), and a shard takes them by
falling gain until it is SLACK above its quota. Odd rounds move up, even rounds
down, so linked units don't swap places. The rounds end when two of them raise
the part of all shared lines that stands in its line's largest shard by less
than ENOUGH; there is no other limit.

At last all rows are put in order of label, group and id, and the order is cut
into shards whose counts differ by at most one: law `rows`. A cut parts at most
one group, and only what exceeds a quota moves on to the next label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import by_key, drop_written, joined_apart, unit_hash, written

SHARDS, ENOUGH, SLACK, MIN_LINE, UNIT = 24, 0.01, 0.02, 40, 1000


def _shared(lines: DataFrame, units: DataFrame) -> DataFrame:
    """line, unit of the lines that several units have. lines: line, unit (distinct); units: unit, th, part. The parts of a group share one more line, that of the group."""
    often = written(lines.groupBy("line").agg(F.min("unit").alias("low"), F.max("unit").alias("high")).where("low <> high").select("line"), "often")
    split = units.where("part > 0").select("th").distinct()
    parts = units.join(by_key(split), "th", "left_semi").select(F.xxhash64("th", F.lit(-1)).alias("line"), "unit")
    return written(lines.join(by_key(often), "line", "left_semi").select("line", "unit").unionByName(parts), "shared")


def _accepted(spark: SparkSession, wishes: list, load: np.ndarray, most: float) -> DataFrame:
    """The part of each (shard, to, gain) that moves. wishes: rows (shard, to, gain, rows), at most shards x shards for each power of a gain."""
    room = most - load
    out = []
    for w in sorted(wishes, key=lambda w: (-w["gain"], w["to"], w["shard"])):
        part = float(min(1.0, max(0.0, room[w["to"]]) / w["rows"]))
        room[w["to"]] -= part * w["rows"]
        out.append((w["shard"], w["to"], w["gain"], part))
    return spark.createDataFrame(out, "shard int, to int, gain int, part double")


def _counts(rows: DataFrame, shards: int) -> DataFrame:
    """line, m, most, by: how many units have the line, in the largest shard, and in each shard, as an array. rows: line, unit, shard."""
    by = [F.sum(F.when(F.col("shard") == k, 1).otherwise(0)).cast("int") for k in range(shards)]
    out = rows.groupBy("line").agg(F.count("*").alias("m"), F.array(*by).alias("by"))
    return out.select("line", "m", F.array_max("by").alias("most"), "by")


def _votes(rows: DataFrame, counts: DataFrame, shards: int, n: int) -> DataFrame:
    """unit, rows, shard, lines, to, most, here: where most of a unit's weight lies, and how much lies there and where it is. rows: unit, rows, shard, line."""
    met = joined_apart(rows, counts, ["line"], "m", n)
    others = [F.element_at("by", k + 1) - F.when(F.col("shard") == k, 1).otherwise(0) for k in range(shards)]
    sums = [F.sum(F.floor(o * UNIT / (F.col("m") - 1))) for o in others]
    out = met.groupBy("unit", "rows", "shard").agg(F.collect_list("line").alias("lines"), F.array(*sums).alias("w"))
    best = F.array_max(F.array(*[F.struct(F.element_at("w", k + 1).alias("weight"), F.lit(-k).alias("to")) for k in range(shards)]))
    return out.select("unit", "rows", "shard", "lines", best.alias("best"), F.element_at("w", F.col("shard") + 1).alias("here")).select("unit", "rows", "shard", "lines", (-F.col("best.to")).alias("to"), F.col("best.weight").alias("most"), "here")


def propagate(units: DataFrame, shared: DataFrame, shards: int, rows: int, rounds: int | None = None, slack: float = SLACK) -> DataFrame:
    """unit, shard after the rounds. units: unit, rows, shard; shared: as from _shared. rounds: at most so many; without it they end by themselves."""
    spark = units.sparkSession
    n = shared.count()
    if not n or rounds == 0:
        return units.select("unit", "shard")
    # A unit and its lines are one row, so a round deals (unit, line) once by line and once by unit.
    lined = shared.groupBy("unit").agg(F.collect_list("line").alias("lines"))
    state = before = written(units.select("unit", "rows", "shard").join(by_key(lined), "unit"), "state", rows=n)
    fixed = _loads(units, shards) - _loads(state, shards)  # of units without shared lines, which never move
    kept: list[float] = []
    while rounds is None or len(kept) < rounds:
        at = len(kept)
        dealt = state.select("unit", "rows", "shard", F.explode("lines").alias("line"))
        counts = written(_counts(dealt, shards), "counts", rows=n)
        all_of = counts.agg(F.sum("most").alias("most"), F.sum("m").alias("m")).collect()[0]
        kept.append(all_of["most"] / all_of["m"])
        if at >= 2 and at % 2 == 0 and kept[-1] - kept[-3] < ENOUGH:
            drop_written(counts)
            break
        gain = F.col("most") - F.col("here")
        moves = (gain > 0) & ((F.col("to") > F.col("shard")) if at % 2 == 0 else (F.col("to") < F.col("shard")))
        voted = written(_votes(dealt, counts, shards, n).select("unit", "rows", "shard", "lines", "to", F.when(moves, F.floor(F.log2(gain) * 4)).cast("int").alias("gain")), "voted", rows=n)
        drop_written(counts, before)
        state = before = voted
        counted = voted.groupBy("shard", F.when(F.col("gain").isNotNull(), F.col("to")).alias("to"), "gain").agg(F.sum("rows").alias("rows")).collect()
        load = fixed.copy()
        for r in counted:
            load[r["shard"]] += r["rows"]
        if wishes := [r for r in counted if r["gain"] is not None]:
            part = _accepted(spark, wishes, load, rows / shards * (1 + slack))
            goes = F.coalesce(unit_hash("unit", seed=at + 1) < F.col("part"), F.lit(False))
            state = voted.join(F.broadcast(part), ["shard", "to", "gain"], "left").select("unit", "rows", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"), "lines")
    moved = state.select("unit", F.col("shard").alias("_to"))
    return units.select("unit", "shard").join(by_key(moved), "unit", "left").select("unit", F.coalesce("_to", "shard").alias("shard"))


def _loads(units: DataFrame, shards: int) -> np.ndarray:
    load = np.zeros(shards)
    for r in units.groupBy("shard").agg(F.sum("rows").alias("rows")).collect():  # a row for each shard
        load[r["shard"]] = r["rows"]
    return load


def lines_of(rows: DataFrame) -> DataFrame:
    """line, unit (distinct) of rows (th, text): hashes of the lines of at least MIN_LINE characters."""
    return rows.select(F.xxhash64("th", F.lit(0)).alias("unit"), F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.length(x) >= MIN_LINE), lambda x: F.xxhash64(x)))).alias("line")).distinct()


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, label for each row of docs.

    size: UTF-8 bytes of the text plus 8, 8 for null; text_crc32: that of no
    bytes, 0, for null. Null texts are a group like any other. slot is gapless
    from 0 in each shard. label is the shard that propagation chose. Rows with
    one id and text are interchangeable. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = written(rows.select("doc_id", "th", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32")), "base")
    n = base.count()
    if not n:
        return base.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(0).alias("label"))
    groups = base.groupBy("th").agg(F.count("*").alias("rows")).withColumn("parts", F.ceil(F.col("rows") / max(1.0, n / shards / 8)).cast("int"))
    groups = written(groups, "groups")
    whole = groups.where("parts > 1").select("th", "parts")  # at most 8 x shards groups
    part = F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int")
    placed = written(base.join(F.broadcast(whole), "th", "left").withColumn("part", part).drop("parts").withColumn("unit", F.xxhash64("th", "part")), "placed")
    units = written(placed.groupBy("unit").agg(F.count("*").alias("rows"), F.first("th").alias("th"), F.first("part").alias("part")).withColumn("shard", F.pmod(F.xxhash64("th", F.lit(9)), F.lit(shards)).cast("int")), "units")
    # One unit of a group speaks for its lines.
    labels = written(propagate(units, _shared(written(lines_of(rows), "lines"), units), shards, n, rounds), "labels")

    # The order by label, group and id, over range partitions.
    ordered = placed.join(by_key(labels.withColumnRenamed("shard", "label")), "unit").select("doc_id", "size", "text_crc32", "label", "th")
    ordered = ordered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "th", "doc_id").sortWithinPartitions("label", "th", "doc_id")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))], ["doc_id", "size", "text_crc32", "label", "part", "idx"])
            at += b.num_rows

    ordered = written(ordered.mapInArrow(number, "doc_id long, size long, text_crc32 long, label int, part int, idx long"), "ordered")
    counts = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    starts, at = [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    placed_at = ordered.join(F.broadcast(spark.createDataFrame(starts, "part int, first long")), "part").withColumn("g", F.col("first") + F.col("idx"))
    each, more = divmod(n, shards)
    edge = more * (each + 1)
    early = F.col("g") < edge
    shard = F.when(early, F.floor(F.col("g") / (each + 1))).otherwise(more + F.floor((F.col("g") - edge) / max(1, each))).cast("int")
    slot = F.when(early, F.col("g") % (each + 1)).otherwise((F.col("g") - edge) % max(1, each)).cast("long")
    drop_written(base, groups, placed, units)
    return placed_at.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "label")

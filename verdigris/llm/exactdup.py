"""Exact copies by progressive refinement: length, then prefix, then whole text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import joined_apart, written

#: Code points of a text that tell texts of one length apart before they are read whole.
PREFIX = 64


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every row of docs with keep_id, group_size long and kept: of rows with equal texts the one with the largest id stays.

    columns: those of docs to return, all by default; one named like a result
    column gives way to it. normalise: texts are equal if their normalised forms
    are, null ones counting as empty. Rows with a null id stay only where their
    whole group has none, keep_id is null then. Of rows that share the largest
    id, or of a group without ids, one stays. An empty table gives no rows.

    First rows are counted by length in bytes and hash of the first PREFIX code
    points, which one scan tells: the groups are those of the lengths, refined.
    Texts that stand alone there are done and are hashed no further. Only rows
    of the other groups are read whole, by SHA-256, and grouped by it. A group
    of any size is counted where its rows are before anything moves; the rows
    of heavy groups take their group's result by broadcast (joined_apart).
    """
    text = F.col(text_col) if normalise is None else normalise(F.col(text_col))
    own = [c for c in (docs.columns if columns is None else columns) if c.lower() not in ("keep_id", "group_size", "kept")]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    source = source.select("row", "id", "text", F.octet_length("text").alias("length"), F.xxhash64(F.left("text", F.lit(PREFIX))).alias("prefix"))

    stages = written(source.groupBy("length", "prefix").agg(F.count("*").alias("n")).where("n > 1"), "prefixes")
    total = docs.count()
    read = joined_apart(source, stages, ["length", "prefix"], "n", total)
    # The number of a row is written with it, so it stays the same for whoever reads it.
    hashed = written(read.select("row", "id", F.monotonically_increasing_id().alias("at"), "length", F.when(F.col("n").isNotNull(), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))).alias("digest")), "hashed")

    # A struct with a null id comes before all others.
    copies = written(hashed.where("digest IS NOT NULL").groupBy("length", "digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "at")).alias("keep")).where("n > 1"), "copies")
    alone = hashed.where("digest IS NULL").select("row", "id", "at", F.lit(None).cast("long").alias("n"), F.struct("id", "at").alias("keep"))
    grouped = joined_apart(hashed.where("digest IS NOT NULL"), copies, ["length", "digest"], "n", total).select("row", "id", "at", "n", F.coalesce("keep", F.struct("id", "at")).alias("keep"))
    return alone.unionByName(grouped).select("row.*", F.col("keep.id").alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (F.col("keep.at") == F.col("at")).alias("kept"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of docs that exact_copies keeps."""
    return exact_copies(docs, id_col, text_col, None, normalise).where("kept").select(*[f"`{c}`" for c in docs.columns])

"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents. Columns besides those of documents go along until packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import linededup, mixing, ngramjoin, packing, queries, toxicity
from verdigris.llm.common import drop_written, shared_dir, table, written

#: The mix takes this part of all tokens that reach it.
MIX_SHARE = 0.75


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model finds toxic go. Labels say what is toxic; the model reads texts alone. Null and empty texts, null ids and repeated rows are judged like any other row."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("not is_toxic").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines go from later documents; a document that had words and keeps none goes. n_chars follows the text. Rows with a null id or text stay as they are."""
    out = linededup.dedup_lines(docs)
    out = out.where("lines_removed = 0 or text rlike '\\\\S'")
    return out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group stays that links of Jaccard similarity 0.8 over 5-word shingles make. Rows with a null id and texts without words stay, so do all rows of an id that stays."""
    return ngramjoin.drop_near_copies(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of each leaf's prefix stay, whole, the one at its end too. Rows are taken one by one, null ids too; documents without words cost nothing and stay where their leaf is taken whole or has no words."""
    levels = {"domain": queries.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mixed_documents(docs, levels, queries.WEIGHTS, mixing.word_count(F.col("text")), F.floor(F.col("all_tokens") * MIX_SHARE), queries.MIX_SEED).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, null texts as empty ones, packed into sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: SQL can express neither the fitted model, nor patience diff, nor the packing; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents. The table of each stage goes when the next one is written, the last one with the session."""
    docs = table(spark, sf_dir, "documents")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name, base)
        if before is not None:
            drop_written(before)
        before = docs
    return docs

"""Mixing sources to target weights by hierarchical budgets. DataFrame functions only.

The columns in `levels` make a tree (domain, language, source). A token budget
goes down from the root: a node's budget is split over its children in
proportion to their weights, no child above its capacity (its tokens times
`epochs`). What a full child cannot take goes to its siblings; only what all of
them cannot take has stayed at the parent's siblings, because the parent's own
capacity was the bound one level above. All amounts are integers, and the
parts of a budget add up to it.

A leaf with budget b reads its documents in a seeded order, a new one for each
epoch, and takes the first b tokens of that stream. Positions in the stream
come from three steps, tokens of each (leaf, epoch, BUCKETS buckets), of each
bucket, and then those inside one bucket of about BUCKET_ROWS documents, so a
leaf with a third of all rows does not meet in one task.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import by_key, drop_written, fresh, written

BUCKET_ROWS, BUCKETS = 250, 1000
MISSING = "<null>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n\\f\\x0B]+")).cast("long"), F.lit(0).cast("long"))


def _weight(column: str, weights: dict[str, float]) -> Column:
    """The weight as an integer, for the common denominator of its level; 1 for values not named."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError(f"negative weight for {column}")
    all_of = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    out = F.lit(all_of).cast("long")
    if exact:
        table = F.create_map(*[F.lit(x) for k, w in exact.items() for x in (k, int(w * all_of))])
        out = F.coalesce(F.try_element_at(table, F.col(column)), F.lit(all_of)).cast("long")
    return out


def _split(children: DataFrame, parent: list[str], own: str) -> DataFrame:
    """children: parent columns, own, capacity, weight, parent_budget. Adds budget."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    by_ratio = Window.partitionBy(*parent).orderBy((big("capacity") / big("weight")).asc(), own)
    before, upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*parent)
    out = children.select(
        "*",
        F.coalesce(F.sum("capacity").over(before), F.lit(0)).alias("_c"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("_w"),
        F.sum("weight").over(whole).alias("_all"),
        F.row_number().over(by_ratio).alias("_k"),
    )
    # The first child that the level of those after it does not fill; all before it are full.
    fits = (big("parent_budget") - big("_c")) * big("weight") <= big("capacity") * (big("_all") - big("_w"))
    out = out.withColumn("_first", F.min(F.when(fits, F.col("_k"))).over(whole))
    at = F.col("_k") == F.col("_first")
    out = out.withColumn("_rest", F.max(F.when(at, F.col("parent_budget") - F.col("_c"))).over(whole)).withColumn("_rest_w", F.max(F.when(at, F.col("_all") - F.col("_w"))).over(whole)).withColumn("_w0", F.max(F.when(at, F.col("_w"))).over(whole))
    # exact: `div` has no rounding
    out = out.withColumns({"_up": big("_rest") * (F.col("_w") + F.col("weight") - F.col("_w0")).cast("decimal(19,0)"), "_low": big("_rest") * (F.col("_w") - F.col("_w0")).cast("decimal(19,0)")})
    share = F.expr("_up div _rest_w") - F.expr("_low div _rest_w")
    return out.withColumn("budget", F.when(F.col("_first").isNull() | (F.col("_k") < F.col("_first")), F.col("capacity")).otherwise(share).cast("long")).drop("_c", "_w", "_all", "_k", "_first", "_rest", "_rest_w", "_w0", "_up", "_low")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], share: Column, epochs: int) -> DataFrame:
    """leaves: the level columns, tokens, rows. Adds budget; share: of all tokens, as an expression over `all_tokens`. Leaves below a weight of 0 get 0."""
    every = leaves
    wanted = F.lit(True)
    for level in levels:
        wanted = wanted & (_weight(level, weights.get(level, {})) > 0)
    total = every.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"), F.coalesce(F.sum(F.when(wanted, F.col("tokens"))), F.lit(0)).alias("_open"))
    root = total.select(F.floor(F.least(share, F.col("_open") * epochs)).cast("long").alias("parent_budget"))
    leaves = every.where(wanted)
    above: list[str] = []
    nodes = root
    for level in levels:
        keys = [*above, level]
        children = leaves.groupBy(*keys).agg((F.sum("tokens") * epochs).cast("long").alias("capacity")).withColumn("weight", _weight(level, weights.get(level, {})))
        children = children.join(nodes, above) if above else children.crossJoin(F.broadcast(nodes))  # one row: the root
        nodes = written(_split(children, above, level).select(*keys, F.col("budget").alias("parent_budget")), "budgets")
        above = keys
    return every.join(nodes.withColumnRenamed("parent_budget", "budget"), levels, "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))


def _streams(rows: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], share: Column, epochs: int, seed: int, free: bool) -> DataFrame:
    """rows (the levels, _id, n_tokens, _row) that their leaves' streams take, once for each epoch, with epoch, start, budget.

    _row: what orders rows without an id. free: rows of 0 tokens also go along
    where they stand behind the last token of a leaf that is taken whole.
    """
    leaves = written(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    budgets = written(leaf_budgets(leaves, levels, weights, share, epochs), "leaf_budgets")
    whole = (F.col("budget") == F.col("tokens") * epochs) if free else F.lit(False)
    streams = budgets.where((F.col("budget") > 0) | whole).withColumn("_buckets", F.ceil(F.col("rows") / BUCKET_ROWS).cast("long"))
    last = F.when(F.col("tokens") == 0, 0).otherwise(F.floor((F.col("budget") - 1) / F.greatest("tokens", F.lit(1)))).cast("int")
    placed = rows.join(streams, levels).withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    placed = placed.withColumn("_order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("row "), F.col("_row").cast("string"))))))
    placed = placed.withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * F.col("_buckets") / F.lit(1 << 32)).cast("long"))
    stream, place = [*levels, "epoch"], [*levels, "epoch", "_bucket"]
    sums = written(placed.groupBy(*place).agg(F.sum("n_tokens").alias("_tokens")), "buckets").withColumn("_part", F.floor(F.col("_bucket") / BUCKETS))
    before = lambda by, order: F.coalesce(F.sum("_tokens").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.groupBy(*stream, "_part").agg(F.sum("_tokens").alias("_tokens")).withColumn("_first", before(stream, "_part")).drop("_tokens")
    starts = sums.withColumn("_within", before([*stream, "_part"], "_bucket")).join(parts, [*stream, "_part"]).select(*place, (F.col("_first") + F.col("_within")).alias("_bucket_start"))
    inside = Window.partitionBy(*place).orderBy("_order", "_id", "n_tokens", "_row").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("epoch") * F.col("tokens") + F.col("_bucket_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    drop_written(leaves)
    out = placed.join(by_key(starts), place).withColumn("start", at.cast("long"))
    return out.where((F.col("start") < F.col("budget")) | whole)


def _read(docs: DataFrame, levels: list[str], tokens: Column, id_col: str) -> list[Column]:
    row = F.when(F.col(id_col).isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return [F.col(id_col).cast("long").alias("_id"), row.alias("_row"), *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in levels], tokens.alias("n_tokens")]


def mix(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], tokens: Column, share: Column, epochs: int = 1, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The documents taken, once for each epoch: doc_id, levels, epoch int, start long, n_tokens long, take_tokens long.

    tokens: an expression for a document's tokens; share: the whole budget as
    an expression over `all_tokens`. start counts the leaf's stream from its
    first epoch; take_tokens is under n_tokens only for the last document
    before the budget ends. A null level value is the leaf MISSING; documents
    of 0 tokens are taken where the stream passes them. Rows with one id are
    told apart by their tokens, rows without one by a hash of the whole row;
    equal rows are interchangeable. An empty table gives no rows.
    """
    rows = written(docs.select(*_read(docs, levels, tokens, id_col)), "tokens")
    taken = _streams(rows, levels, weights, share, epochs, seed, False)
    return taken.select(F.col("_id").alias("doc_id"), *levels, "epoch", "start", "n_tokens", F.least("n_tokens", F.col("budget") - F.col("start")).alias("take_tokens"))


def mixed_documents(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], tokens: Column, share: Column, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that one epoch takes, whole, the one at each budget's end too, with docs' columns.

    levels: expressions by name. Each row is taken or left by itself, so null
    ids and repeated rows lose nothing that the budget does not take; rows of
    0 tokens cost nothing and stay in leaves that are taken whole or have no
    tokens at all. The rest is as in mix.
    """
    own, names = fresh(docs, "_doc"), [fresh(docs, f"_level_{k}") for k in levels]
    named = docs.select("*", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(own), *[c.alias(n) for c, n in zip(levels.values(), names)])
    read = [c.alias(n) for c, n in zip(_read(docs, names, tokens, id_col), ["_id", "_row", *levels, "n_tokens"])]
    taken = _streams(named.select(F.col(own).alias("_doc"), *read), list(levels), weights, share, 1, seed, True)
    return taken.select("_doc.*")

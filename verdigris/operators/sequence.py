"""Operators over the ordered cells of a notebook, as long rows (notebook, code_cell_id, execution_count, code, has_error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.code import definitions, dependencies, without_comments
from verdigris.functions.text import EXECUTED, NOTHING, RUNTIME, TARGET, crash_line, numbered_cells

REEXECUTE = "[reexecute]"


def first_failing(cells: DataFrame, notebook: str = "notebook", index: str = "code_cell_id", failed: str = "has_error") -> DataFrame:
    """notebook, target: the smallest 0-based index of a cell with an error; null where none failed."""
    return cells.groupBy(notebook).agg(F.min(F.when(F.col(failed), F.col(index))).alias("target"))


def with_crash_lines(cells: DataFrame, traceback: str, source: str) -> DataFrame:
    return cells.withColumn("crash_line", crash_line(F.col(traceback), F.col(source)))


def split_cells(cells: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """cells with is_target and is_executed.

    targets: notebook, target; by default a notebook's own first failing cell.
    For a fixed notebook give its crashing twin's targets, counts stay its own.
    Executed cells ran before the target by their counts, or say so in their
    first line (a target that says so is both). Without a target no cell is
    one, and only marked cells are executed.
    """
    targets = first_failing(cells) if targets is None else targets
    known = cells.join(targets, "notebook", "left")
    is_target = F.coalesce(F.col("code_cell_id") == F.col("target"), F.lit(False))
    counts = known.where(is_target).groupBy("notebook").agg(F.first("execution_count").alias("target_count"))
    marked = F.substring_index("code", "\n", 1).contains(REEXECUTE)
    before = ~is_target & F.coalesce(F.col("execution_count") < F.col("target_count"), F.lit(False))
    return known.join(counts, "notebook", "left").withColumn("is_target", is_target).withColumn("is_executed", marked | before).drop("target", "target_count")


def twin_targets(cells: DataFrame, base: Column) -> DataFrame:
    """base, target of the crashing notebooks, for their fixed twins."""
    return first_failing(cells).select(base.alias("base"), "target")


def prompts(split: DataFrame, runtime: DataFrame | None = None, executed: bool = True, comments: bool = False) -> DataFrame:
    """notebook, text: executed cells numbered from 1 by their counts, the runtime block if given, the target last.

    runtime: notebook, info. comments: whether comments stay in the cells. A
    prompt without the executed block has none; without a target it ends after
    the marker.
    """
    cells = split if comments else split.withColumn("code", without_comments(F.col("code")))
    order = F.sort_array(F.collect_list(F.when(F.col("is_executed"), F.struct("execution_count", "code_cell_id", "code"))))
    books = cells.groupBy("notebook").agg(order.alias("ran"), F.max(F.when(F.col("is_target"), F.col("code"))).alias("goal"))
    block = F.when(F.size("ran") > 0, numbered_cells(F.transform("ran", lambda c: c["code"]))).otherwise(NOTHING)
    parts = [F.concat(F.lit(EXECUTED), block)] if executed else []
    if runtime is not None:
        books = books.join(runtime, "notebook", "left")
        parts.append(F.concat(F.lit(RUNTIME), F.coalesce("info", F.lit("{}")), F.lit("\n")))
    return books.select("notebook", F.concat(*parts, F.lit(TARGET), F.coalesce("goal", F.lit(""))).alias("text"))


def grader_message(truth: Column, prediction: Column, reverse: bool = False) -> Column:
    """Both texts for a grader, the truth first or, to measure the bias of order, last."""
    shown = [F.concat(F.lit("Ground truth:\n"), F.coalesce(truth, F.lit(""))), F.concat(F.lit("Prediction:\n"), F.coalesce(prediction, F.lit("")))]
    return F.concat_ws("\n\n", *(shown[::-1] if reverse else shown))


def last_definitions(cells: DataFrame) -> DataFrame:
    """notebook, name, cellno, lineno: where each name was last defined, by order of execution and then line."""
    found = cells.select("notebook", "code_cell_id", "execution_count", F.explode(definitions(F.col("code"))).alias("d"))
    place = F.max_by(F.struct(F.col("execution_count").alias("cellno"), F.col("d.lineno").alias("lineno")), F.struct("execution_count", "code_cell_id", "d.lineno"))
    return found.groupBy("notebook", F.col("d.name").alias("name")).agg(place.alias("p")).select("notebook", "name", "p.*")


def target_dependencies(cells: DataFrame) -> DataFrame:
    """notebook, name, attr of what a target reads; attr is null for plain names and `[]` for what is subscripted."""
    found = cells.select("notebook", dependencies(F.col("code")).alias("d"))
    names = found.select("notebook", F.explode("d.names").alias("name")).withColumn("attr", F.lit(None).cast("string"))
    pairs = found.select("notebook", F.explode("d.attributes").alias("p")).select("notebook", F.col("p.base").alias("name"), F.col("p.attr").alias("attr"))
    bases = found.select("notebook", F.explode("d.subscripts").alias("name")).withColumn("attr", F.lit("[]"))
    return names.unionByName(pairs).unionByName(bases)


def present(needed: DataFrame, namespace: DataFrame) -> DataFrame:
    """The dependencies whose name is in the namespace (notebook, name)."""
    return needed.join(namespace.select("notebook", "name"), ["notebook", "name"], "left_semi")

"""Public names of internal types, and annotated code. Maps are small tables (package, internal, public)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import clean_type, import_aliases
from verdigris.operators.summary import union_last_wins

#: A map up to so many rows is sent to all tasks; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Public names that the map has wrong, and types that are never annotated.
CORRECTIONS = {"pandas.io.stata.DataFrame": "pandas.DataFrame", "pandas.io.stata.Series": "pandas.Series", "torch.fft.Tensor": "torch.Tensor"}
SKIPPED = ["module", "ModuleType", "type", "function", "method", "builtin_function_or_method", "abc.ABCMeta"]
PLAIN = ["str", "int", "float", "bool", "list", "dict", "tuple", "set", "type", "function", "module", "NoneType", "object"]


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """table, marked for broadcast if a count that stops at `most` finds it small."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def cleaned_map(aliases: DataFrame) -> DataFrame:
    """Rows whose internal path lies in their package."""
    return aliases.where(F.startswith("internal", F.concat("package", F.lit("."))))


def totals(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("package").agg(F.count("*").alias("n"))


def last_public(walk: DataFrame, order: str) -> DataFrame:
    """One public name for each internal path: the last found."""
    return walk.groupBy("package", "internal").agg(F.max_by("public", order).alias("public"))


def merged_maps(maps: list[DataFrame]) -> DataFrame:
    """One map of several extractors' maps, given in the order of their precedence: the last that has an internal path holds."""
    return union_last_wins([m.select("package", "internal", "public") for m in maps], ["package", "internal"])


def public_names(rows: DataFrame, aliases: DataFrame, column: str, name: str = "public", strict: bool = False, keep_public: bool = True) -> DataFrame:
    """rows with the public name of a type: itself if it is public already (keep_public), its alias, or itself if unknown; strict raises on unknown ones."""
    package = F.substring_index(column, ".", 1)
    out = rows.withColumn("_package", package).join(small(aliases.select(F.col("package").alias("_package"), F.col("internal").alias(column), F.col("public").alias("_alias"))), ["_package", column], "left")
    public = small(aliases.select(F.col("package").alias("_package"), F.col("public").alias(column)).distinct().withColumn("_is_public", F.lit(True)))
    out = out.join(public, ["_package", column], "left")
    own = F.when(F.col("_is_public"), F.col(column)) if keep_public else F.lit(None).cast("string")
    rest = F.when(F.col(column).isNotNull(), F.raise_error(F.concat(F.lit("no public name: "), column)).cast("string")) if strict else F.col(column)
    return out.withColumn(name, F.coalesce(own, F.col("_alias"), rest)).drop("_package", "_alias", "_is_public")


def longest_prefix(rows: DataFrame, keys: list[str], column: str, prefixes: DataFrame, module: str = "module", alias: str = "alias") -> DataFrame:
    """keys, column, matched: the alias of an equal module, else the value with its longest `module.` prefix replaced once, else the value.

    A value's prefixes are its leading parts, so each row looks up a few keys
    by equality instead of meeting every prefix.
    """
    parts = F.split(F.col(column), "\\.")
    lead = F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")))
    candidates = rows.withColumn("_lead", lead).join(small(prefixes.select(F.col(module).alias("_lead"), F.col(alias).alias("_alias"))), "_lead", "left")
    best = F.max_by(F.when(F.col("_alias").isNotNull(), F.struct("_lead", "_alias")), F.when(F.col("_alias").isNotNull(), F.length("_lead")))
    out = candidates.groupBy(*keys, column).agg(best.alias("_b"))
    return out.withColumn("matched", F.when(F.col("_b").isNull(), F.col(column)).otherwise(F.concat(F.col("_b._alias"), F.substring(F.col(column), F.length("_b._lead") + 1, F.length(column))))).drop("_b")


def _aliased(kind: Column, imports: Column) -> Column:
    """A type by the longest import that leads to it."""
    leads = F.filter(imports, lambda m: (kind == m["module"]) | F.startswith(kind, F.concat(m["module"], F.lit("."))))
    best = F.element_at(F.array_sort(leads, lambda a, b: F.length(b["module"]) - F.length(a["module"])), 1)
    return F.when(F.size(leads) == 0, kind).otherwise(F.concat(best["alias"], F.substring(kind, F.length(best["module"]) + 1, F.length(kind))))


def annotated(cells: DataFrame, variables: DataFrame, aliases: DataFrame) -> DataFrame:
    """instance, text: imports that are missing, `name: type` lines in order, and the code.

    cells: instance, code, executed (code whose imports count; the code itself
    if empty); variables: instance, name, type, ord. Method entries, unusable
    types, modules and functions, and types of the main module are left out.
    """
    named = variables.where(~F.startswith("name", F.lit("__method__"))).withColumn("cleaned", clean_type(F.col("type"))).where("cleaned IS NOT NULL")
    fixed = public_names(named, aliases, "cleaned", "shown")
    corrected = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CORRECTIONS.items() for x in p]), F.col("shown")), F.col("shown"))
    kind = F.when(F.col("cleaned") == "torch.Tensor", "torch.Tensor").when(F.startswith("cleaned", F.lit("transformers.")), F.when(F.col("cleaned").contains("BatchEncoding"), "transformers.BatchEncoding").otherwise(F.col("cleaned"))).otherwise(corrected)
    kept = fixed.withColumn("kind", kind).where(~F.col("kind").isin(SKIPPED) & ~F.col("cleaned").isin(SKIPPED) & ~F.startswith("kind", F.lit("__main__.")))
    source = cells.withColumn("imports", import_aliases(F.when(F.coalesce("executed", F.lit("")) != "", F.col("executed")).otherwise(F.col("code"))))
    rows = kept.join(source.select("instance", "imports"), "instance")
    builtin, plain = F.startswith("kind", F.lit("builtins.")), F.col("kind").isin(PLAIN)
    shown = F.when(builtin, F.substring_index("kind", ".", -1)).when(plain, F.col("kind")).otherwise(_aliased(F.col("kind"), F.col("imports")))
    root = F.substring_index("kind", ".", 1)
    have = F.exists("imports", lambda m: (m["module"] == root) | F.startswith(m["module"], F.concat(root, F.lit("."))))
    wanted = F.when(~builtin & ~plain & (F.instr("kind", ".") > 0) & ~have & root.rlike("^[^\\W\\d]\\w*$") & ~root.isin("typing", "builtins", *PLAIN), root)
    lines = rows.groupBy("instance").agg(F.sort_array(F.collect_list(F.struct("ord", F.concat("name", F.lit(": "), shown).alias("line")))).alias("lines"), F.sort_array(F.collect_set(wanted)).alias("wanted"))
    out = cells.join(lines, "instance", "left")
    head = F.when(F.size("wanted") > 0, F.concat(F.array_join(F.transform("wanted", lambda m: F.concat(F.lit("import "), m)), "\n"), F.lit("\n\n"))).otherwise("")
    body = F.when(F.size("lines") > 0, F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))).otherwise("")
    return out.select("instance", F.concat(F.coalesce(head, F.lit("")), F.coalesce(body, F.lit("")), F.lit("\n"), "code").alias("text"))

"""Readers: label trees, sheets, texts, notebooks, alias maps, rule files. Every path goes through Spark's own readers."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.labels import library_of


def _texts(files: DataFrame) -> DataFrame:
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("_metadata.file_name", "^(.*?)(?:\\.[^.]*)?$", 1).alias("name"), "value")


def whole_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, name (without its ending), value: one row for each file below a folder."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return _texts((reader.option("pathGlobFilter", glob) if glob else reader).text(path, wholetext=True))


def _below(spark: SparkSession, root: str, folders: int) -> DataFrame:
    """whole_texts of the JSON files that lie exactly so many folders below root, with `parts`: the names of these folders and the file's. Whatever root is called, only names below it are looked at."""
    literal = re.sub(r"([\\\[\]{}*?])", r"\\\1", root.rstrip("/"))
    try:
        files = _texts(spark.read.text(f"{literal}{'/*' * folders}/*.json", wholetext=True))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string, name string, value string")
    parts = F.slice(F.split("path", "/"), -folders - 1, folders + 1)  # of an encoded path; a plus stands for itself
    return files.withColumn("parts", F.transform(parts, lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))))


def _arrays(files: DataFrame, element: str) -> DataFrame:
    """files with items: the array that a text is; other texts are left out."""
    arrays = files.where("value rlike '^\\\\s*\\\\['").withColumn("items", F.from_json("value", f"array<{element}>"))
    return arrays.where("items IS NOT NULL").drop("value")


def json_arrays(spark: SparkSession, path: str, element: str = "string") -> DataFrame:
    """path, name, items: one JSON array in each file, an empty one too. Objects in an array of strings come as JSON text; a file that is no array gives no row."""
    return _arrays(whole_texts(spark, path, "*.json"), element)


def json_lists(spark: SparkSession, path: str, element: str = "string") -> DataFrame:
    """path, name, pos, item: the elements of json_arrays; a file with an empty array has one row with neither pos nor item."""
    return json_arrays(spark, path, element).select("path", "name", F.posexplode_outer("items").alias("pos", "item"))


def label_tree(spark: SparkSession, root: str, libraries: list[str] | None = None) -> DataFrame:
    """model, task, instance, run, label of {root}/{model}/{task}/[{library}/]{instance}.json.

    With `libraries`, files of these libraries and folders of these names;
    without, all files at the top and the folder `other`. A file without labels
    has one row with neither run nor label.
    """
    flat, inside = _below(spark, root, 2), _below(spark, root, 3)
    folder = F.element_at("parts", 3)
    if libraries is not None:
        flat, inside = flat.where(library_of(F.col("name")).isin(libraries)), inside.where(folder.isin(libraries))
    else:
        inside = inside.where(folder == "other")
    files = _arrays(flat.unionByName(inside), "string")
    return files.select(F.element_at("parts", 1).alias("model"), F.element_at("parts", 2).alias("task"), F.col("name").alias("instance"), F.posexplode_outer("items").alias("run", "label"))


def analyzer_tree(spark: SparkSession, root: str, libraries: list[str], element: str = "string") -> DataFrame:
    """model, task, library, instance, run, label of {root}/{model}/{task}/{library}/{instance}.json for the given libraries; a file without labels has one row with neither run nor label."""
    files = analyzer_findings(spark, root, libraries, element)
    return files.select("model", "task", "library", "instance", F.posexplode_outer("findings").alias("run", "label"))


def analyzer_findings(spark: SparkSession, root: str, libraries: list[str], element: str = "string") -> DataFrame:
    """model, task, library, instance, findings: one row for each file of the tree, with an empty array where nothing was found."""
    if libraries is None:
        raise ValueError("libraries are required")
    files = _arrays(_below(spark, root, 3).where(F.element_at("parts", 3).isin(libraries)), element)
    return files.select(F.element_at("parts", 1).alias("model"), F.element_at("parts", 2).alias("task"), F.element_at("parts", 3).alias("library"), F.col("name").alias("instance"), F.col("items").alias("findings"))


def sheet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A sheet stored as CSV with a header, or as Parquet."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
        return (reader.schema(schema) if schema else reader).csv(path)
    return spark.read.parquet(path)


def notebook_cells(spark: SparkSession, path: str) -> DataFrame:
    """notebook, code_cell_id (among code cells), execution_count, code, has_error, traceback of notebook files."""
    output = "struct<output_type:string,traceback:array<string>>"
    cells = f"struct<cells:array<struct<cell_type:string,execution_count:int,source:variant,outputs:array<{output}>>>>"
    books = whole_texts(spark, path, "*.ipynb").select(F.col("name").alias("notebook"), F.from_json("value", cells).alias("b"))
    code = books.select("notebook", F.posexplode(F.filter("b.cells", lambda c: c["cell_type"] == "code")).alias("code_cell_id", "c"))
    # A source is a list of lines or a text, which may look like a list.
    lines = F.try_variant_get("c.source", "$", "array<string>")
    source = F.when(F.startswith(F.schema_of_variant("c.source"), F.lit("ARRAY")), F.array_join(lines, "")).otherwise(F.try_variant_get("c.source", "$", "string"))
    failed = F.filter("c.outputs", lambda o: o["output_type"] == "error")
    return code.select("notebook", "code_cell_id", "c.execution_count", source.alias("code"), (F.coalesce(F.size(failed), F.lit(0)) > 0).alias("has_error"), F.array_join(F.element_at(F.when(F.size(failed) > 0, failed), 1)["traceback"], "\n").alias("traceback"))


def cases(names: DataFrame, column: str = "name") -> DataFrame:
    """Names of the form library_number."""
    return names.where(F.col(column).rlike("^[A-Za-z]+_\\d+$"))


def alias_map(spark: SparkSession, path: str) -> DataFrame:
    """package, internal, public of a nested JSON object."""
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    return files.select(F.explode("m").alias("package", "names")).select("package", F.explode("names").alias("internal", "public"))


def enabled_rules(spark: SparkSession, path: str) -> list[str]:
    """Names of the enabled rules of a rule file, in alphabetical order."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "struct<enabled_rules:array<string>>")["enabled_rules"])).collect()  # a configuration file
    return sorted(r[0] for r in rows)

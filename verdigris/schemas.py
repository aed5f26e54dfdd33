"""Explicit schemas of the entities that move between stages."""

from pyspark.sql import types as T

NOTEBOOK_CELLS = "notebook string, code_cell_id int, execution_count int, code string, has_error boolean"
PROCESSED_NOTEBOOK = "executed array<struct<execution_count:int,code_cell_id:int,code:string>>, target struct<code_cell_id:int,code:string>"
VARIABLE_ORIGIN = "instance string, name string, cellno int, lineno int"
RUNTIME_INFO = "instance string, name string, type string, summary string"
PROMPT = "instance string, text string"
PREDICTION = "reasoning string, detection boolean"
DIAGNOSTIC_A = "code_line string, message string, symbol string, type string, source string"
DIAGNOSTIC_B = "code_line string, message string, rule string, severity string, source string"
LABELS_LONG = "instance string, model string, task string, round int, run int, label string"
GROUND_TRUTH = "instance string, detection boolean, diagnosis string"
CAUSES = "instance string, `Libs-cause` string, label_root_cause string"
ALIASES = "package string, internal string, public string"
RATES = "model string, cause string, n bigint, with_rate double, without_rate double"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)

"""Filters over analyzer diagnostics: exact and substring exclude lists, safe against nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import line_at

#: Messages and codes of findings that do not tell of a crash.
MESSAGES_A = [
    "Module 'tensorflow' has no 'keras' member",
    "Module 'tensorflow._api.v2.distribute.cluster_resolver' has no 'TCPClusterResolver' member",
    "Module 'cv2' has no 'resize' member",
    "Module 'cv2' has no 'COLOR_BGR2GRAY' member",
    "Module 'cv2' has no 'COLOR_BGR2RGB' member",
    "Module 'cv2' has no 'IMREAD_COLOR' member",
    "Module 'cv2' has no 'cvtColor' member",
    "Module 'cv2' has no 'imread' member",
    "Module 'urllib' has no 'URLopener' member",
]
SYMBOLS_A = ["no-name-in-module", "import-error", "syntax-error"]
MESSAGES_B = [
    '"keras" is not a known attribute of module "tensorflow"',
    '"keras" is unknown import symbol',
    "Expected expression",
    '"TCPClusterResolver" is not a known attribute of module "tensorflow._api.v2.distribute.cluster_resolver"',
    '"URLopener" is not a known attribute of module "urllib"',
    '"request" is not a known attribute of module "urllib"',
    '"utils" is not a known attribute of module "torch"',
    "could not be determined because it refers to itself",
    'Argument missing for parameter "self"',
]
RULES_B = ["reportMissingImports", "reportPrivateImportUsage", "reportAssignmentType", "reportPossiblyUnboundVariable"]
PLACEHOLDER = "No cell has been executed"


def _outside(value: Column, excluded: list[str]) -> Column:
    """NOT IN in which a missing value is outside."""
    return ~F.coalesce(value.isin(*excluded), F.lit(False)) if excluded else F.lit(True)


def keeps_a(kind: Column, symbol: Column, message: Column, symbols: list[str] = SYMBOLS_A, messages: list[str] = MESSAGES_A) -> Column:
    """Errors whose symbol and whole message are in no exclude list."""
    return F.coalesce(kind == "error", F.lit(False)) & _outside(symbol, symbols) & _outside(message, messages)


def keeps_b(severity: Column, rule: Column, message: Column, rules: list[str] = RULES_B, parts: list[str] = MESSAGES_B) -> Column:
    """Errors whose rule is not excluded and whose message holds none of the parts."""
    said = F.coalesce(message, F.lit(""))
    held = F.lit(False)
    for p in parts:
        held = held | said.contains(p)
    return F.coalesce(severity == "error", F.lit(False)) & _outside(rule, rules) & ~held


def filtered_array_a(found: Column) -> Column:
    return F.filter(found, lambda d: keeps_a(d["type"], d["symbol"], d["message"]))


def filtered_array_b(found: Column) -> Column:
    return F.filter(found, lambda d: keeps_b(d["severity"], d["rule"], d["message"]))


def code_line_a(code: Column, number: Column) -> Column:
    """`n: text` by a 1-based number; outside the code the text is empty."""
    return F.concat(number.cast("string"), F.lit(": "), F.coalesce(line_at(code, number), F.lit("")))


def code_line_b(code: Column, number: Column) -> Column:
    """As code_line_a by a 0-based number."""
    return code_line_a(code, number + 1)


def without_placeholder(found: DataFrame, code: str, number: str) -> DataFrame:
    """Findings whose 0-based line is not the placeholder for no executed cells; a line outside the code stays."""
    return found.where(~F.coalesce(line_at(F.col(code), F.col(number) + 1).contains(PLACEHOLDER), F.lit(False)))

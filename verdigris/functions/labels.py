"""Normalisation of grades, keys and categories. Built-in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grades a grader may give, as found in brackets in lower case, and their canonical form.
GRADES = {
    "correct": "[Correct]",
    "partially correct": "[Partially correct]",
    "reasoning wrong": "[Reasoning Wrong]",
    "wrong": "[Wrong]",
}
#: Libraries that are counted together.
GROUPED_LIBRARIES = ["lightgbm", "matplotlib", "seaborn", "statsmodels", "torchvision"]
#: The orders in which causes are shown.
LIBRARY_ORDER = ["tensorflow/keras", "torch", "sklearn", "numpy", "pandas", "other", "NBspecific"]
ROOT_CAUSE_ORDER = ["API misuse", "data confusion", "NB specific", "implementation error", "ML model confusion", "deprecated API"]


def normalize_grade(raw: Column) -> Column:
    """The canonical grade of a grader's answer, from its first bracket on one line.

    A missing answer reads as the text None. Without a bracket, or with an
    unknown word in it, the answer comes back behind an explanation, so it
    stays apart as a label of its own.
    """
    text = F.coalesce(raw, F.lit("None"))
    inside = F.lower(F.regexp_replace(F.regexp_extract(text, "\\[([^\\n]*?)\\]", 1), "^\\s+|\\s+$", ""))
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in GRADES.items() for x in pair]), inside)
    return F.when(~text.rlike("\\[[^\\n]*?\\]"), F.concat(F.lit("Cannot extract detection labels: "), text)).otherwise(F.coalesce(known, F.concat(F.lit("Cannot verify: "), text)))


def bare_grade(grade: Column) -> Column:
    """Lower case without brackets and without quotes around."""
    return F.lower(F.trim(F.translate(grade, "[]", ""), F.lit("'")))


def bare_grade_unquoted(grade: Column) -> Column:
    """As bare_grade, but without any quote."""
    return F.lower(F.translate(grade, "[]'", ""))


def base_instance(instance: Column) -> Column:
    """The key without its status, wherever that stands."""
    return F.replace(F.replace(instance, F.lit("_reproduced"), F.lit("")), F.lit("_fixed"), F.lit(""))


def is_crashing_twin(instance: Column) -> Column:
    return ~F.endswith(instance, F.lit("_fixed"))


def case_of(instance: Column) -> Column:
    """The first two parts of a key: library and number."""
    return F.substring_index(instance, "_", 2)


def library_of(instance: Column) -> Column:
    return F.substring_index(instance, "_", 1)


def library_cause(cause: Column, grouped: list[str] = GROUPED_LIBRARIES) -> Column:
    """Missing causes belong to the notebook itself; rare libraries are one."""
    filled = F.when(cause.isNull() | cause.isin("None", ""), "NBspecific").otherwise(cause)
    return F.when(filled.isin(grouped), "other").otherwise(filled)


def shown_cause(cause: Column) -> Column:
    return F.when(cause == "library cause", "deprecated API").otherwise(cause)


def stored_cause(shown: Column) -> Column:
    """The inverse of shown_cause: the value that tables hold."""
    return F.when(shown == "deprecated API", "library cause").otherwise(shown)


def matches(a: Column, b: Column) -> Column:
    """Equality in which a missing value equals nothing, not even another missing one."""
    return F.coalesce(a == b, F.lit(False))


def truncated(text: Column, most: int = 20) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def status_rank(status: Column) -> Column:
    return F.when(status == "fixed", 0).when(status == "reproduced", 1).otherwise(99)


def instance_order(instance: Column) -> list[Column]:
    """Sort columns: library, status, then the number as a number."""
    parts = F.split(instance, "_")
    part = lambda k: F.try_element_at(parts, F.lit(k))
    return [part(1), status_rank(part(3)), F.expr("1") * part(2).try_cast("int")]


def listed_order(value: Column, first_seen: Column, listed: list[str]) -> list[Column]:
    """Sort columns: listed values in their order, then the others as first seen."""
    at = F.array_position(F.array(*map(F.lit, listed)), value)
    return [F.when(at > 0, at).otherwise(F.lit(2147483647)), first_seen]

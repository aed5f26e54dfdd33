"""Grading of detections against which twin crashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.votes import majority_vote


def grade_detection(instance: Column, detection: Column, check_reasoning: bool = False) -> Column:
    """The grade of one run; a run without a detection cannot be verified. `fixed` is looked for before `reproduced`, anywhere in the key."""
    fixed, crashing = instance.contains("fixed"), instance.contains("reproduced")
    return (
        F.when(detection.isNull(), "cannot verify")
        .when(fixed, F.when(detection, "wrong").otherwise("correct"))
        .when(crashing, F.when(detection, "check reasoning" if check_reasoning else "correct").otherwise("wrong"))
        .otherwise("cannot verify")
    )


def detection_of(run: Column) -> Column:
    """The detection of a run's JSON text by its type: true and false, or a number that equals 1 or 0. Null where the text is no object, has none, or has a text or anything else there."""
    said = F.try_variant_get(F.try_parse_json(run), "$.detection", "variant")
    kind = F.schema_of_variant(said)
    number = F.when(~kind.isin("BOOLEAN", "STRING"), F.try_variant_get(said, "$", "double"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(said, "$", "boolean")).when(number == 1, True).when(number == 0, False)


def grade_runs(runs: DataFrame, keys: list[str], run: str, order: str, instance: str = "instance", check_reasoning: bool = False) -> DataFrame:
    """keys, vote, n_votes over the grades of all runs."""
    graded = runs.withColumn("_grade", grade_detection(F.col(instance), detection_of(F.col(run)), check_reasoning))
    return majority_vote(graded, keys, "_grade", order)


def grade_findings(instance: Column, findings: Column, check_reasoning: bool = False) -> Column:
    """An analyzer finds a crash if any diagnostic is left."""
    return grade_detection(instance, F.size(findings) > 0, check_reasoning)


def rubric(truth: Column, said: Column, n_aligned: Column, n_reasons: Column) -> Column:
    """The grader's rules with counted reasons: detections first, then whether all, some or none of the reasons align."""
    reasons = F.when(n_aligned >= n_reasons, "correct").when(n_aligned > 0, "partially correct").otherwise("reasoning wrong")
    return F.when(truth.isNull() | said.isNull(), "cannot verify").when(truth != said, "wrong").when(~truth, "correct").otherwise(reasons)

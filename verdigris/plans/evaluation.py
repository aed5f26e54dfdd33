"""Whole evaluations composed of operators: from labels to summaries, accuracies, agreement, rates and kappa."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.labels import LIBRARY_ORDER, ROOT_CAUSE_ORDER, bare_grade, base_instance, is_crashing_twin, library_cause, listed_order, normalize_grade, shown_cause
from verdigris.operators import metrics, summary, votes
from verdigris.operators.grading import grade_findings


def vote_summary(labels: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each instance with a column for each of `columns` ({model}_{task}): the bare majority grade over runs.

    labels: instance, model, task, run, label as the readers give them; a row
    without a run is a file without labels, whose vote is empty. One plan from
    files to the wide table; the exchanges are those of the vote's two
    groupings, the join with all files and the pivot.
    """
    facts = _facts(labels)
    voted = votes.majority_vote(facts, ["instance", "system"], "label", "run", facts)
    return summary.pivoted(voted.withColumn("vote", bare_grade(F.col("vote"))), ["instance"], "system", columns, "vote", "n_votes")


def _facts(labels: DataFrame) -> DataFrame:
    """Normalised labels under their system; where there is no run, there is no label to normalise."""
    return labels.withColumn("label", F.when(F.col("run").isNotNull(), normalize_grade(F.col("label")))).withColumn("system", F.concat_ws("_", "model", "task"))


def analyzer_summary(findings: DataFrame, columns: list[str], check_reasoning: bool = False) -> DataFrame:
    """One row for each instance with a column for each of `columns` ({model}_{task}): the grade of what an analyzer found, which may be nothing. findings: as readers.analyzer_findings gives them."""
    graded = findings.withColumn("system", F.concat_ws("_", "model", "task")).withColumn("grade", grade_findings(F.col("instance"), F.col("findings"), check_reasoning))
    return summary.pivoted(graded, ["instance"], "system", columns, "grade", "library")


def vote_of_rounds(labels: DataFrame, columns: list[str]) -> DataFrame:
    """As vote_summary over labels with a round: the majority of each round, then over rounds."""
    facts = _facts(labels)
    rounds = votes.majority_vote(facts, ["instance", "system", "round"], "label", "run", facts).withColumn("vote", bare_grade(F.col("vote")))
    voted = votes.vote_over_rounds(rounds.withColumnRenamed("vote", "label"), ["instance", "system"], "label", "round")
    return summary.pivoted(voted, ["instance"], "system", columns, "vote", "n_votes")


def judge_accuracy(human: DataFrame, llm: DataFrame, analyzer: DataFrame | None, registry: list[tuple[str, str, str, str]]) -> DataFrame:
    """system, variant, n, mismatches, accuracy of graders against people. registry: (system, variant, human column, predicted column) after the joins' suffixes."""
    joined = summary.suffixed_outer(human, llm, "instance", ("_human", "_llm"))
    if analyzer is not None:
        joined = summary.suffixed_outer(joined, analyzer, "instance", ("", "_sas"))
    return metrics.accuracy(metrics.long_pairs(joined, "instance", registry), ["system", "variant"], "human", "predicted")


def order_agreement(original: DataFrame, reverse: DataFrame, registry: list[tuple[str, str, str]]) -> DataFrame:
    """system, n, matches, rate between two input orders, pooled over a system's columns. registry: (system, variant, column)."""
    joined = summary.suffixed_inner(original, reverse, "instance", ("_orig", "_reversed"))
    pairs = metrics.long_pairs(joined, "instance", [(s, v, f"{c}_orig", f"{c}_reversed") for s, v, c in registry])
    return metrics.agreement(pairs, ["system"], "human", "predicted")


def judge_kappa(human: DataFrame, judge: DataFrame, columns: list[str]) -> DataFrame:
    """n, agreed, kappa pooled over all columns."""
    joined = summary.suffixed_outer(human, judge, "instance", ("_human", "_llmjudge"))
    pairs = metrics.long_pairs(joined, "instance", [(c, "", f"{c}_human", f"{c}_llmjudge") for c in columns])
    return metrics.kappa(pairs, [], "human", "predicted")


def rates(final: DataFrame, causes: DataFrame, cause: str, registry: list[tuple[str, str, str]], support: int = 5) -> DataFrame:
    """model, cause, n, with_rate, without_rate, improvement of crashing twins by cause. registry: (model, column with runtime information, column without)."""
    if cause not in causes.columns:
        raise ValueError(f"no column {cause}")
    value = F.col(f"`{cause}`")
    kind = library_cause(value) if cause == "Libs-cause" else shown_cause(value)
    twins = final.where(is_crashing_twin(F.col("instance"))).withColumn("instance", base_instance(F.col("instance")))
    joined = twins.join(causes.select("instance", kind.alias("cause")), "instance").where("cause IS NOT NULL")
    cell = lambda r: F.struct(F.lit(r[0]).alias("model"), F.col(r[1]).alias("with_runtime"), F.col(r[2]).alias("without_runtime"))
    long = joined.select("cause", F.explode(F.array(*map(cell, registry))).alias("x")).select("cause", "x.*")
    return metrics.rates_by_cause(long, ["model", "cause"], "with_runtime", "without_runtime", support=support)


def in_shown_order(rates_: DataFrame, cause: str) -> DataFrame:
    """Rates in the listed order of causes, for a report."""
    listed = {"Libs-cause": LIBRARY_ORDER, "label_root_cause": ROOT_CAUSE_ORDER}.get(cause)
    return rates_.orderBy("model", *(listed_order(F.col("cause"), F.col("cause"), listed) if listed else [F.col("cause")]))

"""Votes over a stream of runs in which runs come again, late and out of order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from verdigris.operators.votes import majority_vote

#: The state store that keyed maps need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunVotes(StatefulProcessor):
    """Of a cell: the runs seen, for each label how many runs gave it and the earliest of them, and the label that is ahead."""

    def __init__(self, names: list[str], seen_ms: int | None) -> None:
        self.names, self.seen_ms = names, seen_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "run long", "there boolean", self.seen_ms)
        self.counts = handle.getMapState("counts", "label string", "n long, first long")
        self.ahead = handle.getValueState("ahead", "label string, n long, first long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        ahead, changed = self.ahead.get(), False
        for r in list(rows):
            if r.run is None or r.label is None or self.seen.containsKey((r.run,)):
                continue
            self.seen.updateValue((r.run,), (True,))
            n, first = self.counts.getValue((r.label,)) if self.counts.containsKey((r.label,)) else (0, r.run)
            self.counts.updateValue((r.label,), (n + 1, min(first, r.run)))
            now = (r.label, n + 1, min(first, r.run))
            # one label's count grew, so it or the one that was ahead is
            if ahead is None or ahead[0] == r.label or (-now[1], now[2], now[0]) < (-ahead[1], ahead[2], ahead[0]):
                ahead = now
            changed = True
        if changed:
            self.ahead.update(tuple(ahead))
            yield Row(**dict(zip(self.names, (*key, ahead[0], ahead[1]))))

    def close(self) -> None:
        pass


def votes_of_runs(runs: DataFrame, keys: list[str], label: str, run: str, seen_ms: int | None = None) -> DataFrame:
    """keys, vote, n_votes over a stream: a row for each cell that a batch changes, to be written in update mode.

    A run (a whole number) counts once for its cell, whenever and however often
    it comes: a repeated one changes nothing, and of rows of one run with
    different labels the first that arrives counts. Ties go to the label of the
    earliest run, not of the earliest arrival, so the order in which runs come
    makes no difference. Null runs and labels don't vote. A cell's state is a
    number for each run it has seen and a row for each label; with seen_ms a run
    is forgotten so long after it came, and would count again; Spark then runs
    batch after batch, so a trigger of what is available now does not end. The
    session's state store must be STATE_STORE.
    """
    given = runs.select(*keys, F.col(run).cast("long").alias("run"), F.col(label).cast("string").alias("label"))
    out = T.StructType([*[given.schema[k] for k in keys], T.StructField("vote", T.StringType()), T.StructField("n_votes", T.LongType())])
    mode = "None" if seen_ms is None else "ProcessingTime"
    return given.groupBy(*keys).transformWithState(statefulProcessor=RunVotes(out.names, seen_ms), outputStructType=out, outputMode="Update", timeMode=mode)


def votes_of_batch(runs: DataFrame, keys: list[str], label: str, run: str) -> DataFrame:
    """What votes_of_runs comes to when all runs have come, where the rows of a run agree on its label."""
    once = runs.where(F.col(run).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, run).agg(F.min(label).alias(label))
    return majority_vote(once, keys, label, run)

"""What each step of the worker lets through: counts that Spark takes as rows pass by, without a job of their own."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, StreamingQueryListener

from docloom.functions import vocabulary as V


def counts(step: str) -> dict[str, Column]:
    """The counts of a step by name."""
    if step == "loaded":
        return {"rows_in": F.count("*"), "rows_out": F.count_if(F.col("status").isin(V.PENDING, V.RUNNING))}
    return {
        "rows_in": F.count("*"), "rows_out": F.count_if(F.col("status") != V.REJECTED), "refused": F.count_if(F.col("status") == V.REJECTED), "to_check": F.count_if(F.col("status") == V.TO_CHECK),
        "errors": F.sum(F.coalesce(F.col("n_errors"), F.lit(0)).cast("long")),
    }


class Steps:
    """Observations of the steps of one run, or names of them in a stream."""

    def __init__(self, prefix: str = "step", streaming: bool = False):
        self.prefix, self.streaming, self.seen = prefix, streaming, {}

    def watch(self, step: str, df: DataFrame) -> DataFrame:
        named = [c.alias(n) for n, c in counts(step).items()]
        if self.streaming:
            return df.observe(f"{self.prefix}_{step}", *named)
        self.seen[step] = Observation(f"{self.prefix}_{step}")
        return df.observe(self.seen[step], *named)

    def rows(self, spark: SparkSession) -> DataFrame:
        """(step, metric, value) once an action has run; waits for it."""
        got = [(step, name, int(n or 0)) for step, o in self.seen.items() for name, n in o.get.items()]
        return spark.createDataFrame(got, "step string, metric string, value long")


class StepListener(StreamingQueryListener):
    """Collects the steps' counts of each micro-batch: (batch, step, metric, value)."""

    def __init__(self, prefix: str = "step"):
        self.prefix, self.found = prefix, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        for name, row in event.progress.observedMetrics.items():
            if name.startswith(f"{self.prefix}_"):
                self.found += [(event.progress.batchId, name.removeprefix(f"{self.prefix}_"), k, int(v or 0)) for k, v in row.asDict().items()]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@contextmanager
def listening(spark: SparkSession, listener: StepListener) -> Iterator[StepListener]:
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)

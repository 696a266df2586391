"""Documents as streams: new files, status changes that can't go back, and upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.functions import vocabulary as V


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*").load(folder)


def guarded(changes: DataFrame) -> DataFrame:
    """(name, status, accepted) of a stream of (name, status, at): the state holds one status for each document; a final one doesn't go back to waiting."""
    final, waiting = set(V.FINAL), V.PENDING

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "status"])
        out = []
        for s in rows["status"]:
            good = not (now in final and s == waiting)
            if good:
                now = s
            out.append((key[0], now, good))
        state.update((now,))
        yield pd.DataFrame(out, columns=["name", "status", "accepted"])

    return changes.groupBy("name").applyInPandasWithState(step, "name string, status string, accepted boolean", "status string", "append", GroupStateTimeout.NoTimeout)


def upserts(changes: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to write, once for each batch number; with the checkpoint a restart repeats at most the last one."""
    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""A folder that the driver and all executors see, for what a query writes and reads back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the session's spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder; others get an error, as their executors share none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _made.append(tempfile.mkdtemp(prefix="docloom-"))
        at = f"file://{_made[-1]}"
    return f"{at.rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"


@atexit.register
def _clear() -> None:
    for at in _made:
        shutil.rmtree(at, ignore_errors=True)

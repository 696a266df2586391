"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local master (tests, a laptop) gets a
temporary folder that goes at the end; any other master gets an error, as its executors share no local folder. Tables are written as Parquet, so that a lost
executor costs a re-read and never a recomputation, and so that Spark knows their sizes.

What an operator returns may read its tables, so they stay until its caller has written the result and calls
``release``; what is left at the end of the driver's process goes then, if the session still stands.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
#: What keeps buffers of whole texts small: batches to Python by rows and by bytes, batches of a scan, row groups of what is written.
SMALL = {BATCH: str(ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512", "parquet.block.size": str(16 << 20)}


def small_buffers(spark: SparkSession) -> dict[str, str | None]:
    """Sets SMALL for the session; what was set before, for restore."""
    # null: not set by anyone
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        if k != BATCH or not 0 < int(spark.conf.get(k)) < ROWS:
            spark.conf.set(k, v)
    return before


def restore(spark: SparkSession, before: dict[str, str | None]) -> None:
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, without a trailing slash."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        at = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
        _own.append(at)
    return at.rstrip("/")


_own: list[str] = []
_roots: list[str] = []


def made() -> int:
    """How many folders of tables there have been so far, for release."""
    return len(_roots)


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Deletes the tables of all operator calls since then, but for one folder; nothing may read them any more."""
    for k in range(since, len(_roots)):
        if _roots[k] and _roots[k] != keep:
            _delete(spark, _roots[k])
            _roots[k] = ""


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _drop_own() -> None:
    import shutil

    for at in _own:
        shutil.rmtree(at.removeprefix("file://"), ignore_errors=True)
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        release(spark)


class Scratch:
    """Tables of one operator call, each under its own name in a fresh folder of the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
        _roots.append(self.root)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        """Writes df and reads it back: lineage ends here. Buffers are SMALL meanwhile, so that long texts fill little memory on either side."""
        before = small_buffers(self.spark)
        try:
            df.write.mode("overwrite").parquet(self.path(table))
        finally:
            restore(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Deletes tables that nothing reads any more; without names, all of them."""
        for at in [self.path(t) for t in tables] or [self.root]:
            _delete(self.spark, at)

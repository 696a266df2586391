"""Tables as they are read."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition at most, where work on rows is long or each gives many.
ROWS = 50_000


def portions(rows: DataFrame) -> int:
    """Into how many partitions the rows of a scan go: one for each core at least, none of more than ROWS. The count reads the files' footers."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS))


def spread(rows: DataFrame) -> DataFrame:
    """rows of a scan in partitions that are no long work. Reading texts costs far more than moving them: a small file is one partition whatever cores stand idle, and one of narrow rows holds millions; a scan that has as many partitions is not shuffled."""
    n = portions(rows)
    return rows.repartition(n) if rows._jdf.queryExecution().toRdd().getNumPartitions() < n else rows


def together(rows: DataFrame, *keys: str) -> DataFrame:
    """rows of a scan by keys, in partitions of a bounded number of rows (but for the rows of one key), which keep their number although their rows are narrow: what is made of them is wider."""
    return rows.repartition(portions(rows), *keys)


def parted(union: DataFrame, *keys: str) -> DataFrame:
    """A union by keys. Spark 4.1 takes a union whose parts lie by a key as lying by it too and shuffles no more, but a part may have got other partitions by the time it runs: joins then fail (Can't zip RDDs with unequal numbers of partitions)."""
    return union.repartition(*keys)

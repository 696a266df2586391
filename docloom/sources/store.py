"""Stored documents as a table in partitions, into which batches are merged by rewriting only the partitions that they touch.

A document's partition is a hash of its name without what uploads add to it (hash suffixes, extensions), so that all spellings of a
name that an incoming one may mean lie in one partition. A merge reads and replaces the partitions of the incoming names; the
others are neither read nor written. A batch is merged once: its number is noted after it, and one that was cut off
before is merged again with the same result, as what it has added is found and updated then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import bare_name
from docloom.operators.documents import upserted

PART = "part"


@dataclass(frozen=True)
class DocumentStore:
    spark: SparkSession
    path: str
    parts: int = 64
    key: str = "document_name"

    def part(self) -> Column:
        return F.pmod(F.xxhash64(bare_name(F.col(self.key))), F.lit(self.parts)).cast("int")

    def create(self, docs: DataFrame) -> None:
        docs.withColumn(PART, self.part()).hint("rebalance", PART).write.partitionBy(PART).mode("errorifexists").parquet(self._data())

    def _data(self) -> str:
        return f"{self.path}/documents"

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(self._data()).drop(PART)

    def merged(self, batch: int) -> bool:
        """Whether a batch was merged before."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches/batch={batch}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def merge(self, incoming: DataFrame, columns: list[str], batch: int) -> list[int]:
        """Stored documents that an incoming name means get the given columns, others are added; the partitions that were rewritten. Fits foreachBatch. incoming: one row for each name."""
        if self.merged(batch):
            return []
        new = incoming.withColumn(PART, self.part())
        # no more numbers than there are partitions
        touched = sorted(r[0] for r in new.select(PART).distinct().collect())
        if touched:
            stored = self.spark.read.parquet(self._data())
            old = stored.where(F.col(PART).isin(touched))
            # a new document is called by its first name's digest, so that later batches find it
            rows = upserted(old.drop(PART), new.drop(PART), columns, self.key).withColumn("name", F.coalesce("name", F.md5(self.key))).withColumn(PART, self.part())
            rows.select(*stored.columns).hint("rebalance", PART).write.partitionBy(PART).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self._data())
        self.spark.createDataFrame([(len(touched),)], "parts int").write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch}")
        return touched

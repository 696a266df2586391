"""Which texts hold which of many phrases: a join by containment without comparing all with all.

A phrase can only stand in a text that holds each of its stretches of three characters, so a phrase is filed under the
one of them that the fewest texts have. Texts are joined over the stretches that some phrase is filed under, and what
meets is compared in full. Shorter phrases are filed under themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3


def stretches(text: Column, n: int) -> Column:
    """All distinct stretches of n characters; none of a shorter text."""
    size = F.length(text)
    return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def held(texts: DataFrame, phrases: DataFrame, text: str = "text", phrase: str = "phrase") -> DataFrame:
    """(text, phrase): the distinct pairs of a text and a phrase, not empty, that stands in it as it is."""
    said = texts.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    want = phrases.select(F.col(phrase).alias("_phrase")).where("_phrase <> ''").distinct()
    filings = F.when(F.length("_phrase") < SIZE, F.array("_phrase")).otherwise(stretches(F.col("_phrase"), SIZE))
    keys = want.withColumn("_keys", filings).select("_phrase", F.size("_keys").alias("_size"), F.explode("_keys").alias("_key"))
    every = said.select("_text", F.explode(F.concat(*[stretches(F.col("_text"), n) for n in range(1, SIZE + 1)])).alias("_key"))
    # stretches of one and two characters count only where a phrase is that short
    wanted = every.join(keys.select("_key").distinct(), "_key", "left_semi")
    often = wanted.groupBy("_key").agg(F.count("*").alias("_n"))
    # a phrase one of whose stretches no text has stands nowhere
    filed = keys.join(often, "_key").groupBy("_phrase", "_size").agg(F.min_by("_key", F.struct("_n", "_key")).alias("_key"), F.count("*").alias("_found")).where("_found = _size").select("_phrase", "_key")
    met = wanted.join(filed, "_key")
    return met.where(F.contains("_text", "_phrase")).select(F.col("_text").alias("text"), F.col("_phrase").alias("phrase"))


def either_holds(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): the distinct pairs, neither empty, of which one holds the other."""
    one = held(left, right, a, b).select(F.col("text").alias(a), F.col("phrase").alias(b))
    two = held(right, left, b, a).select(F.col("phrase").alias(a), F.col("text").alias(b))
    return one.unionByName(two).where((F.col(a) != "") & (F.col(b) != "")).distinct()

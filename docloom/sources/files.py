"""Files as rows: intake checks, the cascade over recognised texts, and spreadsheets as cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources import workbooks

#: Extensions that are taken, and the first bytes of formats.
TAKEN = ["pdf", "png", "jpg", "jpeg", "tiff", "bmp", "xlsx", "svg"]
MAGIC = {"25504446": "pdf", "89504E47": "png", "FFD8FF": "jpg", "49492A00": "tiff", "4D4D002A": "tiff", "424D": "bmp", "504B0304": "xlsx"}
LEAST_BYTES = 2048
#: Confidence of a text by where it comes from.
SCORES = {"pdf_text": 95, "paddle": 85, "pdf": 80, "fast": 75, "svg": 75, "xlsx": 70, "slow": 65}


def extension(path: Column) -> Column:
    """S1."""
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, modificationTime, length, content."""
    return spark.read.format("binaryFile").load(path)


def intake(files: DataFrame) -> DataFrame:
    """Files with kind (the extension, or what the first bytes say where it isn't one that is taken) and why they are refused, null if they aren't."""
    head = F.hex(F.substring("content", 1, 4))
    said = F.coalesce(*[F.when(head.startswith(m), k) for m, k in MAGIC.items()])
    kind = F.when(extension(F.col("path")).isin(TAKEN), extension(F.col("path"))).otherwise(said)
    return files.withColumn("kind", kind).withColumn("refused", F.when(F.col("length") < LEAST_BYTES, "too small").when(F.col("kind").isNull(), "unknown type"))


def unseen(files: DataFrame, seen: DataFrame) -> DataFrame:
    """One file for each content that wasn't seen before."""
    return files.withColumn("file_hash", F.md5("content")).dropDuplicates(["file_hash"]).join(seen.select("file_hash"), "file_hash", "left_anti")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "(?U)\\s+"), lambda w: w != ""))


def chosen_text(df: DataFrame) -> DataFrame:
    """Of the recognised texts the one that counts: a PDF's own text of more than 50 characters; the fast engine's of more than 20 words; the other's if it has more words; else the slow one's. df: pdf_text, fast_text, sharp_text, other_text (any null)."""
    fast = F.when(word_count(F.col("sharp_text")) > word_count(F.col("fast_text")), F.col("sharp_text")).otherwise(F.col("fast_text"))
    pick = lambda t, e: F.struct(t.alias("text"), F.lit(e).alias("engine"), F.lit(SCORES[e]).alias("ocr_score"))
    best = F.when(F.length("pdf_text") > 50, pick(F.col("pdf_text"), "pdf_text")).when(word_count(F.col("fast_text")) > 20, pick(F.col("fast_text"), "fast")).when(word_count(F.col("other_text")) > word_count(fast), pick(F.col("other_text"), "paddle")).otherwise(pick(fast, "slow"))
    return df.withColumn("_best", best).select("*", "_best.*").drop("_best")


def cells(files: DataFrame) -> DataFrame:
    """(file, sheet, r, c, v) of all filled cells of workbooks that were read as binary files; damaged files give none. See docloom.sources.workbooks for reading them as a data source."""
    return workbooks.cells_of_content(files).drop("place")

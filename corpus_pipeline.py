"""From raw documents to token ids: five stages, each over all that its predecessor kept.

Defined results: rows are judged each on their own by the first two stages, so that rows without doc_id, without
text or with another row's doc_id stay or go by their text; the third keeps one row of each group of near
duplicates and one of each repeated doc_id; the fourth repeats rows, a repeated row as often as its copies
together are taken; documents without words are never taken, so that none reaches the last. An empty table
gives an empty result, without labels every document passes the first stage, and columns other than those of
documents stay through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import byte_cnn, fertility_rules, minhash_forest, sentencepiece_codec, source_mix, storage
from docloom.llm.storage import Scratch

PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"
#: Columns that stages add for a while; a column of documents may have any other name.
KEY, COPIES, ROWS, COPY = (f"__pipeline_{x}" for x in ("key", "copies", "rows", "copy"))
#: No SQL: a trained classifier decides what the later stages get. The stages are tested against brute force.
ORACLE_SQL = None


#: Keys of a table up to which every task gets it; beyond that texts and keys are shuffled.
KNOWN = 200_000


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key that only equal rows share: their id and a hash of all columns."""
    return docs.withColumn(KEY, F.struct(F.col("doc_id").alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash")))


def by_key(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """rows joined to a written table of keys: id (null safe) and hash. The table goes to every task only where its counted rows are few."""
    side = table.withColumnRenamed(KEY, "__pipeline_of")
    if side.count() <= KNOWN:
        side = F.broadcast(side)
    same = (F.col(f"{KEY}.hash") == F.col("__pipeline_of.hash")) & F.col(f"{KEY}.id").eqNullSafe(F.col("__pipeline_of.id"))
    return rows.join(side, same, how)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.small_buffers(spark)
    net = byte_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return byte_cnn.keep_good(docs, net)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.small_buffers(spark)
    rows = keyed(docs)
    verdicts = fertility_rules.verdicts(rows, public_tokenizers.path(PIECES), public_tokenizers.path(BYTES), key=KEY)
    rejected = Scratch(spark, "rejected").save(verdicts.where("not kept").select(F.col("doc_id").alias(KEY)).distinct(), "rows")
    return by_key(rows, rejected, "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.small_buffers(spark)
    return minhash_forest.keep_one(docs, 80).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    storage.small_buffers(spark)
    rows = keyed(docs)
    mixed = source_mix.mix(rows, key=KEY).groupBy(F.col("doc_id").alias(KEY)).agg(F.sum("copies").cast("int").alias(COPIES), F.count("*").alias(ROWS))
    taken = Scratch(spark, "taken").save(mixed.where(F.col(COPIES) > 0), "rows")
    names = [F.col(f"`{c}`") for c in docs.columns]
    met = by_key(rows, taken, "inner")
    once = met.where(F.col(ROWS) == 1)
    if not taken.where(F.col(ROWS) > 1).isEmpty():
        # equal rows are one row before they are repeated
        of = F.struct(*names, COPIES)
        once = once.select(*names, COPIES).unionByName(met.where(F.col(ROWS) > 1).groupBy(KEY).agg(F.first(of).alias("r")).select("r.*"))
    return once.withColumn(COPY, F.explode(F.sequence(F.lit(1), COPIES))).select(names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.small_buffers(spark)
    return sentencepiece_codec.digests(docs, public_tokenizers.path(PIECES))


# A stage runs after its function has returned, so each sets small buffers for the session; run sets back what was before.
STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("source mix", source_mixing),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    settings = storage.small_buffers(spark)
    try:
        for k, (_, stage) in enumerate(STAGES):
            before = storage.made()
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
            # a stage's tables go with the stage before it
            storage.release(spark, before)
            if k:
                scratch.drop(f"stage{k - 1}")
    finally:
        storage.restore(spark, settings)
    return docs

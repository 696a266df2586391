"""The queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import ball_kmeans, byte_cnn, chat_hmm, embedding_passes, exact_dedup, fertility_rules, html_mincut, importance, minhash_forest, oracles, sentencepiece_codec, source_mix, token_counts, token_files
from docloom.llm.columns import documents


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(documents(spark, sf_dir))


def op3_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op6_chat_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_hmm.turns_of_pieces(chat_hmm.pieces(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.groups(documents(spark, sf_dir), 85)


def op8_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_rules.verdicts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return byte_cnn.score(docs, byte_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_embedding_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_passes.groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_perfect_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, seed=2)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=25, least=20, seed=7)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_source_mix, op3_html_mincut, op4_token_counts, op5_token_files, op6_chat_hmm, op7_minhash_forest, op8_fertility_rules, op9_byte_cnn, op10_embedding_passes, op11_perfect_hash, op12_ball_kmeans, op13_importance)}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_hmm": oracles.CHAT, "op7_minhash_forest": oracles.NEAR, "op10_embedding_passes": oracles.VECTORS, "op11_perfect_hash": oracles.COPIES, "op12_ball_kmeans": oracles.balls(40, 5, 64), "op13_importance": oracles.IMPORTANCE}

"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import ann, byte_bpe, exact_dedup, gru_lm, license_scan, mixing, ngram_join, pii, token_counts, toxicity
from spanveil.llm.common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents")).drop("found")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their first copy's training position, those not taken last."""
    rows = mixing.assign(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("_first", F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0)))
    return rows.repartitionByRange("_first", "doc_id").sortWithinPartitions("_first", "doc_id").select("doc_id", "size", "source_size", "target", "taken")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"op1_ngram_join": op1_ngram_join, "op2_pii": op2_pii, "op3_toxicity": op3_toxicity, "op4_mixing": op4_mixing, "op5_ann": op5_ann, "op6_gru_lm": op6_gru_lm, "op7_exact_dedup": op7_exact_dedup, "op8_byte_bpe": op8_byte_bpe, "op9_token_counts": op9_token_counts, "op10_license_scan": op10_license_scan, "pipeline": pipeline}
ORACLES: dict[str, str] = {"op1_ngram_join": ngram_join.ORACLE, "op4_mixing": mixing.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE}

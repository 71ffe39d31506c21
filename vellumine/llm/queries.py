"""The queries of this subpackage: thin, over whole tables, with the parameters meant for production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import decontaminate, dedup_lines, language, merkle, pieces, quality, secrets, simhash, substrings, toxicity
from vellumine.llm.common import crc_mod, read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    scored = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "quality", ~held_out).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    found = language.identify(read(spark, sf_dir, "documents"), ~held_out).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    scored = toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "toxic", ~held_out).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents")).select(F.col("key").cast("long").alias("doc_id"), "samples", "exact")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(read(spark, sf_dir, "documents")))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edits(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.dedup(read(spark, sf_dir, "documents")))


QUERIES = {"op1_quality": op1_quality, "op2_language": op2_language, "op3_line_dedup": op3_line_dedup, "op4_toxicity": op4_toxicity, "op5_pieces": op5_pieces, "op6_decontaminate": op6_decontaminate, "op7_secrets": op7_secrets, "op8_merkle": op8_merkle, "op9_simhash": op9_simhash, "op10_substrings": op10_substrings}
ORACLE = {"op3_line_dedup": dedup_lines.SQL, "op6_decontaminate": decontaminate.SQL, "op8_merkle": merkle.SQL}

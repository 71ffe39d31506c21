"""Five stages that turn `documents` into a corpus for training: each writes a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import decontaminate, dedup_lines, pieces, simhash, toxicity
from vellumine.llm.common import crc_mod, read, table

#: A document goes at this chance of being toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; learnt as op4 does, from labels whose ids aren't held out."""
    score = toxicity.scorer(docs, read(spark, sf_dir, "labels"), "toxic", crc_mod(F.col("doc_id"), 3) != 1)
    return docs.withColumn("__score", score(F.col("text"))).where(F.col("__score") < TOXIC).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated windows of three lines go; n_chars follows the text."""
    out = dedup_lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingle sets of a Jaccard similarity of 0.8, found by SimHash tries) one document stays, of least id; rows without an id stay."""
    return simhash.distinct_texts(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item leaks go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's id with its sampled segmentations; an error if one doesn't decode to the document's text."""
    wrong = F.raise_error(F.concat(F.lit("pieces don't decode to the text of document "), F.coalesce("key", F.lit("null"))))
    samples = F.when(F.coalesce("exact", F.lit(True)), F.col("samples")).otherwise(wrong)
    return pieces.encode(docs).select(F.col("key").cast("long").alias("doc_id"), samples.alias("samples"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near copies", drop_copies), ("decontamination", drop_leaks), ("pieces", encode)]

#: SQL cannot express the learnt scores, the fingerprints and the sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

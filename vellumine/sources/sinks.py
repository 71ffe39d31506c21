"""Tables that are written so that doing it twice changes nothing: points, change points, diffs, answers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.functions.sizes import small
from vellumine.functions.text import collapse_ws, uuid5
from vellumine.functions.vectors import unit
from vellumine.sources.files import point_id


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of greatest `order` of each key: the last write wins."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def points(chunks: DataFrame, scope: str = "content") -> DataFrame:
    """chunks with point_id, one row each: of equal content the last of ingest_seq; scope 'path' keeps places apart; vectors of unit length."""
    ident = point_id(F.col("content_hash"), F.col("chunk_id"))
    if scope == "path":
        ident = uuid5(F.concat_ws("|", "source_path", "hierarchy_path", "content_hash"))
    p = last_of(chunks.withColumn("point_id", ident), "point_id", "ingest_seq")
    return p.withColumn("vector", unit(F.col("vector"))) if "vector" in chunks.columns else p


def upsert(rows: DataFrame, path: str, key: str, order: str, partitions: list[str]) -> None:
    """Merge rows into a Parquet table, rewriting only the partitions they touch; equal keys keep the greatest `order`.

    Touched are the partitions of the rows and those that hold an older row of their keys, so that a key that moves leaves
    nothing behind. The new state of those partitions goes to a folder of its own beside the table first, so that a failed job
    leaves the old one; folders of partitions that end up without rows are removed.
    """
    spark = rows.sparkSession
    if not _exists(spark, path):
        last_of(rows, key, order).sortWithinPartitions(key).write.partitionBy(*partitions).parquet(path)
        return
    old = spark.read.parquet(path)
    held = old.join(small(rows.select(key).distinct()), key, "left_semi").select(*partitions)
    touched = rows.select(*partitions).unionByName(held).distinct()
    mine = old.withColumn("__folder", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")).join(small(touched), partitions, "left_semi")
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    last_of(mine.select(*rows.columns).unionByName(rows), key, order).write.parquet(staged)
    new = spark.read.schema(rows.schema).parquet(staged)
    # a row for each partition folder that has no rows any more
    empty = [r[0] for r in mine.join(new.select(*partitions).distinct(), partitions, "left_anti").select("__folder").distinct().collect()]
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        new.sortWithinPartitions(key).write.mode("overwrite").partitionBy(*partitions).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    for folder in [*empty, staged]:
        _delete(spark, folder)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def change_points(changes: DataFrame) -> DataFrame:
    """Changes as points of a table of their own: id from a readable key, type `change`."""
    key = F.concat_ws("|", "source_id", "version_from", "version_to", "key")
    return changes.withColumns({"point_id": uuid5(key, "url"), "node_type": F.lit("change"), "node_key": F.col("key")})


def write_diffs(changes: DataFrame, path: str) -> None:
    changes.write.mode("overwrite").partitionBy("source_id", "version_from", "version_to").parquet(path)


def load_diff(spark: SparkSession, path: str, source_id: str, version_from: str, version_to: str) -> DataFrame:
    """One pair's changes: a read of one partition; no rows if it was never compared."""
    return spark.read.parquet(path).where((F.col("source_id") == source_id) & (F.col("version_from") == version_from) & (F.col("version_to") == version_to))


def question_key(question: Column, top_k: Column) -> Column:
    return F.sha2(F.concat_ws("|", collapse_ws(F.lower(question)), top_k.cast("string")), 256)


def unanswered(questions: DataFrame, responses: DataFrame, seconds: int | None = None) -> DataFrame:
    """Questions (question, top_k) without a kept response, or with one older than `seconds`."""
    fresh = responses if seconds is None else responses.where(F.col("answered_at") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(seconds))))
    return questions.withColumn("question_key", question_key(F.col("question"), F.col("top_k"))).join(fresh.select("question_key").distinct(), "question_key", "left_anti")


def write_results(results: DataFrame, path: str) -> None:
    """Evaluation rows as JSON lines, failures among them as rows with an error."""
    results.write.mode("append").json(path)

"""Incremental work: files and points as streams, event windows with late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators.chunk import chunk
from vellumine.sources import files as src
from vellumine.sources.sinks import upsert


def file_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files under a folder as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(root)


def ingest_stream(spark: SparkSession, root: str, table: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None):
    """Files -> chunks -> an idempotent table. Ids are hashes of place and content, so a replayed batch writes the same rows."""

    def batch(new: DataFrame, number: int) -> None:
        kind = F.lit(None).cast("string")
        for ext, name in src.FORMATS.items():
            kind = F.when(src.extension(F.col("path")) == ext, name).otherwise(kind)
        f = new.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), kind.alias("format"), "content", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("source_id"))
        nodes, _ = src.parse(f.withColumns({"version_tag": F.lit(None).cast("string"), "version_order": F.lit(None).cast("int")}))
        rows = chunk(nodes).withColumn("ingest_seq", F.lit(number).cast("long"))
        upsert(embed(rows) if embed else rows, table, "chunk_id", "ingest_seq", ["source_id"])

    return file_stream(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """events (ts, event_type, value) -> counts and sums by tumbling or sliding window, events later than `late` left out of a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n): runs of a user's events with no gap of that length."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def running_totals(events: DataFrame) -> DataFrame:
    """A stream of (user_id, n, total) that grow with each batch, kept in a state store by user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")

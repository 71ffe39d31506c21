"""Files to points: one plan, errors apart, a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators.chunk import chunk
from vellumine.sources import files as src


def ingest(spark: SparkSession, root: str, overrides: DataFrame | None = None, source_id: str | None = None, file_contains: str | None = None, prefix: Callable[[DataFrame], Column] | None = None) -> dict[str, DataFrame]:
    """All files under root -> nodes, chunks, errors, skipped files and a report, each a DataFrame.

    source_id and file_contains narrow the files; a source_id that isn't there raises.
    """
    f = src.scan(spark, root)
    sources = src.discover(f)
    declared = overrides if overrides is not None else spark.createDataFrame([], "source_id string, version_pattern string, version_order array<string>")
    sources = sources.join(declared, "source_id", "left")
    if source_id is not None:
        sources = sources.where(F.col("source_id") == source_id)
        if not sources.limit(1).count():
            raise ValueError(f"no source {source_id}")
    own = src.with_versions(f, sources).where("source_id is not null").drop("version_pattern")
    if file_contains:
        own = own.where(F.contains("file", F.lit(file_contains)))
    nodes, errors = src.parse(own)
    chunks = chunk(nodes, prefix)
    return {"sources": sources, "nodes": nodes, "chunks": chunks, "errors": errors, "skipped": src.skipped(f), "report": report(own.where("format is not null"), chunks, errors)}


def report(files: DataFrame, chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """(source_id, documents, chunks, errors), a row for each source and one, of a null source_id, for all."""
    one = lambda df, d, c, e: df.select("source_id", F.lit(d).alias("documents"), F.lit(c).alias("chunks"), F.lit(e).alias("errors"))
    every = one(files, 1, 0, 0).unionByName(one(chunks, 0, 1, 0)).unionByName(one(errors, 0, 0, 1))
    return every.rollup("source_id").agg((F.sum("documents") - F.sum("errors")).alias("documents"), F.sum("chunks").alias("chunks"), F.sum("errors").alias("errors"))

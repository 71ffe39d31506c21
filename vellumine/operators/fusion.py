"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.operators.search import top_k


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = 60, top: int | None = None) -> DataFrame:
    """lists of (query_id, chunk_id, rank from 1) -> (query_id, chunk_id, score, lists, rank).

    The score sums weight / (k + rank); weights are made to add up to 1 (equal if not given); rows without a chunk_id are
    left out; ties go to the list and rank in which a chunk is first seen.
    """
    w = weights or [1.0 / len(lists)] * len(lists)
    total = sum(w)
    w = [x / total for x in w] if abs(total - 1) > 1e-6 else w
    every = None
    for i, (df, x) in enumerate(zip(lists, w)):
        own = df.where("chunk_id is not null").select("query_id", "chunk_id", F.lit(i).alias("list"), "rank", (F.lit(x) / (k + F.col("rank"))).alias("part"))
        every = own if every is None else every.unionByName(own)
    fused = every.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("list")).alias("lists"), F.min(F.struct("list", "rank")).alias("seen"))
    return top_k(fused, top or 2**31 - 1, tie="seen").drop("seen")


def hybrid(dense: DataFrame, sparse: DataFrame, weights: tuple[float, float] = (0.6, 0.4), k: int = 60) -> DataFrame:
    """rrf() of both; a question without sparse hits keeps its dense list and scores."""
    fused = rrf([dense, sparse], list(weights), k)
    lone = dense.join(sparse.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "chunk_id", "score", F.array(F.lit(0)).alias("lists"), "rank")
    return fused.join(lone.select("query_id").distinct(), "query_id", "left_anti").unionByName(lone)


def rrf_ids(lists: list[DataFrame], top: int = 10) -> DataFrame:
    """The plain form: unweighted, the first `top` ids."""
    return rrf(lists, [1.0 / len(lists)] * len(lists), 60, top).select("query_id", "chunk_id", "rank")

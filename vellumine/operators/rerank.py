"""Reranking: the gate, the heuristic over shared words, and a slot for a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import tokens_ws


def keyword_hits(question: Column, text: Column) -> Column:
    """Distinct words of over three characters of the question that are words of the text."""
    q = F.filter(F.array_distinct(tokens_ws(F.lower(question))), lambda t: F.length(t) > 3)
    return F.size(F.array_intersect(q, tokens_ws(F.lower(F.coalesce(text, F.lit(""))))))


def heuristic_score(question: Column, text: Column, path: Column, score: Column) -> Column:
    return score + 0.01 * keyword_hits(question, text) + F.when(F.coalesce(path, F.lit("")) != "", 0.05).otherwise(0.0)


def rerank(candidates: DataFrame, k: int = 10, enabled: bool = True, score: Column | None = None) -> DataFrame:
    """candidates (query_id, question, chunk_id, rank, score, text, hierarchy_path) -> the k best with rerank_score and new rank.

    Questions of more than k candidates are reordered by `score` (a model's column; the heuristic if not given), their old rank
    among equals; others, and all if not enabled, keep their order and have no rerank_score.
    """
    given = heuristic_score(F.col("question"), F.col("text"), F.col("hierarchy_path"), F.col("score")) if score is None else score
    n = F.count("*").over(Window.partitionBy("query_id"))
    d = candidates.withColumn("rerank_score", F.when(F.lit(enabled) & (n > k), given))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return d.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("rank").withColumnRenamed("__n", "rank")


def model_score(load: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = 64):
    """A column function (question, text) -> score of a model that is loaded once a worker and called on batches."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in parts:
            out: list[float] = []
            for s in range(0, len(q), batch):
                out += list(model(q[s : s + batch].tolist(), t[s : s + batch].tolist()))
            yield pd.Series(out, dtype="float64")

    return scored

"""Sparse top-k over whole texts: 1 + ln(tf) times ln(1 + n / df), each text scored in the task that reads it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.functions.sizes import BROADCAST_ROWS
from vellumine.operators.nearest import best, id_ranks, round_half_up
from vellumine.operators.search import idf, postings, top_k

#: Scores that a task makes at once, and rows that it gathers before it goes back to the k best.
SCORES, GATHERED = 1_000_000, 200_000


def one_row_each(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, terms) with the terms of rows that repeat an id in one row."""
    again = chunks.groupBy("chunk_id").count().where("count > 1").select(F.col("chunk_id").alias("again"))
    if not again.limit(1).count():
        return chunks
    same = F.col("chunk_id").eqNullSafe(F.col("again"))
    merged = chunks.join(again, same, "left_semi").groupBy("chunk_id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    return chunks.join(again, same, "left_anti").unionByName(merged)


def _places(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in terms) of each occurrence of an asked term."""
    lists = batch.column("terms")
    found = pc.index_in(lists.flatten(), value_set=terms)
    row = pc.list_parent_indices(lists).to_numpy()
    there = found.is_valid().to_numpy(zero_copy_only=False)
    return row[there], found.drop_null().to_numpy().astype(np.int64)


def _frequencies(terms: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for b in batches:
            row, at = _places(b, terms)
            df += np.bincount(np.unique(row * len(terms) + at) % len(terms), minlength=len(terms))
        yield pa.record_batch([pa.array(np.arange(len(terms))), pa.array(df)], names=["at", "df"])

    return run


def _scores(terms: pa.Array, weight: np.ndarray, asks: list[np.ndarray], queries: int, k: int, decimals: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    n_asks, start = np.array([len(a) for a in asks]), np.cumsum([0, *[len(a) for a in asks]])[:-1]
    who = np.concatenate(asks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.zeros(queries)
        ids, q, s, gathered = [], [], [], 0

        def settle() -> None:
            nonlocal ids, q, s, gathered
            every, qs, ss = pa.concat_arrays(ids), np.concatenate(q), np.concatenate(s)
            kept = best(qs, ss, id_ranks(every), k)
            ids, q, s, gathered = [every.take(pa.array(kept))], [qs[kept]], [ss[kept]], 0
            full = np.bincount(q[0], minlength=queries) >= k
            low = np.full(queries, np.inf)
            np.minimum.at(low, q[0], s[0])
            least[full] = low[full]

        for b in batches:
            row, at = _places(b, terms)
            pair, tf = np.unique(row * len(terms) + at, return_counts=True)
            row, at = pair // len(terms), pair % len(terms)
            w = (1.0 + np.log(tf)) * weight[at]
            step = max(1, SCORES // queries)
            edges = np.searchsorted(row, np.arange(0, b.num_rows + step, step))
            for first, i, j in zip(range(0, b.num_rows, step), edges, edges[1:]):
                n = n_asks[at[i:j]]
                of = np.repeat(np.arange(i, j), n)
                query = who[np.repeat(start[at[i:j]], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]
                score = np.bincount((row[of] - first) * queries + query, weights=w[of], minlength=step * queries).reshape(step, queries)
                if decimals is not None:
                    score = round_half_up(score, decimals)
                r, c = np.nonzero((score > 0) & (score >= least))
                ids.append(b.column("chunk_id").take(pa.array(first + r)))
                q.append(c)
                s.append(score[r, c])
                gathered += len(r)
                if gathered > GATHERED:
                    settle()
        if ids:
            settle()
            yield pa.record_batch([pa.array(q[0]), ids[0], pa.array(s[0])], names=["at", "chunk_id", "score"])

    return run


def search(query_terms: DataFrame, chunks: DataFrame, n: int, k: int = 10, decimals: int | None = None) -> DataFrame:
    """query_terms (query_id, term), each once, chunks (chunk_id, terms: array), n texts in all -> (query_id, chunk_id, score, rank).

    Texts are read twice, for df of the asked terms and for scores, and don't move; a task gives its k best of a question. The
    questions' terms go to every task while they are at most BROADCAST_ROWS; beyond, postings of the asked terms are joined.
    """
    spark, chunks = chunks.sparkSession, one_row_each(chunks)
    asked = query_terms.where("term is not null")
    rows = asked.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        index = postings(chunks.select("chunk_id", "terms").withColumn("terms", F.array_compact("terms")), F.col("terms")).join(asked.select("term").distinct(), "term", "left_semi")
        score = F.sum(F.col("weight") * F.col("idf"))
        hit = asked.join(idf(index, n), "term").join(index, "term").groupBy("query_id", "chunk_id").agg((score if decimals is None else F.round(score, decimals)).alias("score"))
        return top_k(hit, k)
    query_id, chunk_id = query_terms.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType
    names, place = list(dict.fromkeys(r.query_id for r in rows)), {}
    if not rows:
        return top_k(spark.createDataFrame([], f"query_id {query_id.simpleString()}, chunk_id {chunk_id.simpleString()}, score double"), k)
    for r in rows:
        place.setdefault(r.term, []).append(r.query_id)
    at = {x: i for i, x in enumerate(names)}
    terms, asks = pa.array(list(place), pa.string()), [np.array([at[x] for x in v]) for v in place.values()]
    df = np.zeros(len(terms))
    for r in chunks.select("terms").mapInArrow(_frequencies(terms), "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():
        df[r["at"]] = r.df
    weight = np.log(1.0 + n / np.maximum(df, 1))
    found = chunks.select("chunk_id", "terms").mapInArrow(_scores(terms, weight, asks, len(names), k, decimals), f"at long, chunk_id {chunk_id.simpleString()}, score double")
    ids = spark.createDataFrame(list(enumerate(names)), f"at long, query_id {query_id.simpleString()}")
    return top_k(found.join(F.broadcast(ids), "at").select("query_id", "chunk_id", "score"), k)

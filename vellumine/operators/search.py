"""Dense and sparse top-k, and lookups by key, over points kept as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.vectors import cosine, dot
from vellumine.operators.nearest import nearest, regular

#: Question rows that may be sent to every task.
QUERY_ROWS = 10_000


def _blocks(queries: DataFrame, rows: int | None = None) -> list[DataFrame]:
    """queries, or where there are more than `rows`, about equal blocks by a hash of query_id, so that rows of one id stay together."""
    rows = QUERY_ROWS if rows is None else rows
    n = queries.count()
    if n <= rows:
        return [queries]
    blocks = -(-2 * n // rows)  # half full, as their sizes vary
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return [queries.where(number == i) for i in range(blocks)]


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """Of each group the k greatest scores, least `tie` first among equals, with their rank from 1."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def dense(queries: DataFrame, points: DataFrame, k: int = 10, condition: Column | None = None, normalised: bool = False, allowed: Column | None = None, decimals: int | None = None, whole: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): the nearest points by cosine that meet the condition.

    Questions are held against all points by products of matrices, see nearest(). `decimals` rounds scores before they are ranked;
    `whole` vouches that all vectors are regular(), which is otherwise looked at. `allowed` is a condition on pairs, over the
    questions' columns as q.* and the points' as p.*; it holds before the k best are taken. With it, and for vectors of several lengths
    or with nulls, pairs are joined: a block of questions of a stated size goes to every task, points don't move, and each task
    keeps its own k best of a question before the shuffle.
    """
    kept = points if condition is None else points.where(condition)
    if allowed is None and (whole or regular(queries, kept)):
        return top_k(nearest(queries, kept, k, normalised, decimals), k)
    pts = kept.alias("p")
    measure = dot if normalised else cosine
    score = measure(F.col("q.vector"), F.col("p.vector"))
    score = (score if decimals is None else F.round(score, decimals)).alias("score")

    def near(block: DataFrame) -> DataFrame:
        pairs = pts.join(F.broadcast(block).alias("q"), F.lit(True) if allowed is None else allowed)
        return top_k(pairs.select("q.query_id", "p.chunk_id", score), k)

    return reduce(DataFrame.unionByName, map(near, _blocks(queries)))


def query_terms(questions: DataFrame, terms: Column, weight: Column | None = None) -> DataFrame:
    """(query_id, term, weight) of an array of terms, repeated ones once."""
    return questions.select("query_id", F.explode(F.array_distinct(terms)).alias("term")).withColumn("weight", F.lit(1.0) if weight is None else weight)


def postings(chunks: DataFrame, terms: Column) -> DataFrame:
    """(chunk_id, term, weight): 1 + ln(tf), an inverted index."""
    return chunks.select("chunk_id", F.explode(terms).alias("term")).groupBy("chunk_id", "term").agg((1.0 + F.log(F.count("*").cast("double"))).alias("weight"))


def idf(index: DataFrame, n: Column | int) -> DataFrame:
    """(term, idf): ln(1 + n / df)."""
    return index.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log(1.0 + F.lit(n) / F.col("df")).alias("idf"))


def sparse(query_postings: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank): the greatest dot products over shared terms, by a join on the term.

    Postings of frequent terms are a hot key on the index side only, which AQE splits; sums combine before the shuffle.
    """
    q = query_postings.select("query_id", "term", F.col("weight").alias("wq"))
    hit = q.join(index, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("wq") * F.col("weight")).alias("score"))
    return top_k(hit, k)


def change_nodes(queries: DataFrame, change_points: DataFrame, pair: tuple[str, str, str], k: int = 10) -> DataFrame:
    """dense() over the change points of one pair (source, from, to), whose partition alone is read."""
    source_id, version_from, version_to = pair
    where = (F.col("source_id") == source_id) & (F.col("version_from") == version_from) & (F.col("version_to") == version_to)
    return dense(queries, change_points, k, where)


def by_chunk_id(keys: DataFrame, points: DataFrame) -> DataFrame:
    """keys (chunk_id) with the point's columns, null where there is none."""
    return keys.join(points, "chunk_id", "left")


def by_path(keys: DataFrame, points: DataFrame, path_col: str, limit: int) -> DataFrame:
    """keys (path, source_id or null, version_tag or null) with up to `limit` points on that path, least chunk_id first.

    path_col parent_path finds siblings (limit 50), hierarchy_path exact counterparts (limit 5). A null source or version asks for any.
    """
    k = keys.select(F.col("path").alias("__path"), F.col("source_id").alias("__source"), F.col("version_tag").alias("__version")).distinct()
    found = k.join(points, (F.col("__path") == F.col(path_col)) & (F.col("__source").isNull() | (F.col("__source") == F.col("source_id"))) & (F.col("__version").isNull() | (F.col("__version") == F.col("version_tag"))))
    w = Window.partitionBy("__path", "__source", "__version").orderBy("chunk_id")
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")

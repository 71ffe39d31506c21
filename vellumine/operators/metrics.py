"""Evaluation: retrieval metrics, judges' rates, latencies, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import path_norm
from vellumine.functions.vectors import cosine
from vellumine.operators.filters import is_relevant


def retrieval(results: DataFrame, expected: DataFrame, ks: list[int]) -> DataFrame:
    """results (query_id, rank, source_path), expected (query_id, expected: array) -> (query_id, k, recall, precision, ndcg, mrr).

    recall: distinct expected paths met in the first k over all of them, 1 if none is expected; precision: relevant over the
    results there are, 0 without any; ndcg: binary gains against the same results, best first; mrr over all results.
    """
    e = expected.select("query_id", F.array_distinct(F.transform("expected", path_norm)).alias("expected"))
    r = results.join(e, "query_id").withColumn("rel", is_relevant(F.col("source_path"), F.col("expected")).cast("int"))
    grown = F.log2(F.col("rank").cast("double") + 1)
    top = r.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k")
    met = top.select("query_id", "k", F.explode("expected").alias("one"), "source_path").where(is_relevant(F.col("source_path"), F.array("one"))).groupBy("query_id", "k").agg(F.count_distinct("one").alias("met"))
    per = top.groupBy("query_id", "k").agg(F.avg("rel").alias("precision"), F.sum(F.col("rel") / grown).alias("dcg"), F.sum("rel").alias("n"))
    ideal = F.aggregate(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n").cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i.cast("double") + 1))
    first = r.groupBy("query_id").agg((1 / F.min(F.when(F.col("rel") == 1, F.col("rank")))).alias("mrr"))
    base = e.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    out = base.join(per, ["query_id", "k"], "left").join(met, ["query_id", "k"], "left").join(first, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "query_id", "k", F.when(F.size("expected") == 0, 1.0).otherwise(zero(F.col("met") / F.size("expected"))).alias("recall"),
        zero(F.col("precision")).alias("precision"), zero(F.when(F.col("n") > 0, F.col("dcg") / ideal)).alias("ndcg"), zero(F.col("mrr")).alias("mrr"),
    )


def aggregate(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Plain means over questions, by k (and strategy)."""
    return per_query.groupBy(*(by or []), "k").agg(*[F.avg(c).alias(c) for c in ("recall", "precision", "ndcg", "mrr")])


def legacy_recall(results: DataFrame, k: int) -> DataFrame:
    """results (query_id, rank, rel, n_expected) -> (query_id, legacy_recall, legacy_ndcg): relevant over the lesser of expected and k; may pass 1."""
    t = results.where(F.col("rank") <= k).groupBy("query_id", "n_expected").agg(F.sum("rel").alias("n"), F.sum(F.col("rel") / F.log2(F.col("rank").cast("double") + 1)).alias("dcg"))
    m = F.least("n_expected", F.lit(k))
    ideal = F.aggregate(F.when(m > 0, F.sequence(F.lit(1), m.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i.cast("double") + 1))
    return t.select("query_id", F.when(m > 0, F.col("n") / m).otherwise(0.0).alias("legacy_recall"), F.when(m > 0, F.col("dcg") / ideal).otherwise(0.0).alias("legacy_ndcg"))


def mean_verdict(verdicts: DataFrame, by: str, verdict: str, name: str) -> DataFrame:
    """Faithfulness, context recall and their like: the mean of 0/1 verdicts, 0 without any."""
    return verdicts.groupBy(by).agg(F.coalesce(F.avg(F.col(verdict).cast("double")), F.lit(0.0)).alias(name))


def answer_relevancy(generated: DataFrame) -> DataFrame:
    """generated (query_id, question_vector, vector, noncommittal) -> mean cosine between 0 and 1; 0 if all are noncommittal."""
    m = generated.groupBy("query_id").agg(F.avg(cosine(F.col("question_vector"), F.col("vector"))).alias("c"), F.min(F.col("noncommittal").cast("int")).alias("all"))
    return m.select("query_id", F.when(F.col("all") == 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "c"))).alias("answer_relevancy"))


def context_precision(verdicts: DataFrame) -> DataFrame:
    """verdicts (query_id, rank, useful 0/1) -> average precision, 1e-10 in the denominator."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    v = verdicts.withColumn("p", F.sum("useful").over(w) / F.count("*").over(w) * F.col("useful"))
    return v.groupBy("query_id").agg((F.sum("p") / (F.sum("useful") + F.lit(1e-10))).alias("context_precision"))


def hallucination(answers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """answers (n_citations, faithfulness) -> share of answers with citations whose faithfulness is under a half, and the counts."""
    cited = F.col("n_citations") > 0
    low = cited & (F.col("faithfulness") < 0.5)
    return answers.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(cited).alias("with_citations"), F.count_if(low).alias("hallucinated"), F.count_if(~cited).alias("without_citations"), F.coalesce(F.try_divide(F.count_if(low).cast("double"), F.count_if(cited)), F.lit(0.0)).alias("rate"))


def share(hit: Column, of: Column) -> Column:
    """An aggregate: the share of hit among of, null where there is none."""
    return F.try_divide(F.count_if(of & hit).cast("double"), F.count_if(of))


def citation_accuracy(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    return judged.groupBy(*(by or [])).agg(share(F.col("accurate"), F.lit(True)).alias("citation_accuracy"))


def sufficiency_precision(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of the answers called insufficient, the share that should have been abstained from."""
    return judged.groupBy(*(by or [])).agg(share(F.col("should_abstain"), F.col("verdict") == "insufficient").alias("sufficiency_precision"))


def judge_summary(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """judged (should_abstain, abstained, has_conflict, said_conflict, faithfulness) -> means that skip nulls and error rates."""
    return judged.groupBy(*(by or [])).agg(
        F.avg("faithfulness").alias("faithfulness"), share(F.col("abstained"), F.col("should_abstain")).alias("correct_abstention"), share(F.col("abstained"), ~F.col("should_abstain")).alias("false_abstention"),
        share(~F.col("said_conflict"), F.col("has_conflict")).alias("missed_conflict"), share(F.col("said_conflict"), ~F.col("has_conflict")).alias("false_conflict"),
    )


def latency(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., n, avg, p50, p95): order statistics at places n / 2 and 0.95 n (from 0, at most the last), without gathering a group.

    Equal values are counted first; running counts over distinct values then find the places.
    """
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    run = n.withColumns({"upto": F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(w)})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    return run.groupBy(*by).agg(F.max("n").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.max("n")).alias("avg"), at(F.floor(F.col("n") / 2)).alias("p50"), at(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))).alias("p95"))


def round_robin(rows: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """n rows, one of each source in turn, sources in order."""
    w = Window.partitionBy(source).orderBy(order)
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", source).limit(n)

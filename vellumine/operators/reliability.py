"""Decisions over evidence: sufficiency, conflicts and their resolution, the abstention gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import STOP_WORDS, clip01, terms
from vellumine.operators.expand import cross_source_pairs

LOW, HIGH = 0.25, 0.70


def question_terms(question: Column) -> Column:
    """Distinct words of three characters and more that aren't stop words."""
    t = F.filter(F.array_distinct(terms(F.lower(question))), lambda x: F.length(x) >= 3)
    return F.array_except(t, F.array(*[F.lit(w) for w in STOP_WORDS]))


def sufficiency(question: Column, evidence: Column) -> Column:
    """struct<verdict, confidence, method>: the share of the question's terms that occur anywhere in the evidence's text."""
    t = question_terms(question)
    # the text is lowered once and the share worked out once, however many terms there are
    ratio = F.get(F.transform(F.array(F.struct(t.alias("t"), F.lower(F.coalesce(evidence, F.lit(""))).alias("low"))), lambda s: term_share(s["t"], s["low"])), F.lit(0))
    return F.get(F.transform(F.array(ratio), _verdict), F.lit(0))


def term_share(t: Column, low: Column) -> Column:
    """Share of terms that occur in a text in lower case; 0 without terms."""
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda x: F.contains(low, x))) / F.size(t)).otherwise(0.0)


def _verdict(ratio: Column) -> Column:
    verdict = F.when(ratio >= 0.6, "sufficient").when(ratio > 0, "partial").otherwise("insufficient")
    return F.struct(verdict.alias("verdict"), F.bround(ratio, 2).alias("confidence"), F.lit("entity_match").alias("method"))


def with_sufficiency(questions: DataFrame, candidates: DataFrame, diff: DataFrame | None = None, judged: Column | None = None) -> DataFrame:
    """questions (query_id, question) with `sufficiency` over all candidates' texts and paths and the diff's explanation; `judged` wins where not null."""
    own = candidates.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text", "hierarchy_path"))), lambda s: F.concat_ws(" ", s["text"], s["hierarchy_path"])), " ").alias("evidence"))
    q = questions.join(own, "query_id", "left")
    if diff is not None:
        q = q.join(diff.select("query_id", "summary"), "query_id", "left").withColumn("evidence", F.concat_ws(" ", "evidence", "summary")).drop("summary")
    rule = sufficiency(F.col("question"), F.col("evidence"))
    return q.withColumn("sufficiency", rule if judged is None else F.coalesce(judged, rule)).drop("evidence")


def gate(scores: Column, confidence: Column, verdict: Column, sufficiency_confidence: Column, planner_low: Column | None = None, low: float = LOW, high: float = HIGH) -> Column:
    """struct<zone, combined_score, action> from rerank scores (array), generation confidence and the sufficiency verdict."""
    if not 0 <= low <= high <= 1:
        raise ValueError("thresholds must be 0 <= low <= high <= 1")
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.greatest(F.lit(0.0), F.least(F.lit(1.0), s.cast("double")))) / F.size(scores))
    worth = F.when(verdict == "sufficient", 1.0).when(verdict == "partial", 0.5).otherwise(0.0)
    raw = 0.3 * F.coalesce(mean, F.lit(0.0)) + 0.3 * F.coalesce(clip01(confidence), F.lit(0.0)) + 0.3 * worth + 0.1 * F.coalesce(clip01(sufficiency_confidence), F.lit(0.0))
    if planner_low is not None:
        raw = F.when(F.coalesce(planner_low, F.lit(False)), raw * 0.85).otherwise(raw)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    zone = F.when(score > high, "confident").when(score >= low, "ambiguous").otherwise("insufficient")
    action = F.when(score > high, "answer").when(score >= low, "answer_with_caveat").otherwise("abstain")
    return F.struct(zone.alias("zone"), F.bround(score, 3).alias("combined_score"), action.alias("action"))


def finalise(action: Column, answer: Column, citations: Column) -> tuple[Column, Column]:
    """Answer and citations after the gate: a fixed text and none on abstaining, a warning before a doubtful answer."""
    text = F.when(action == "abstain", "There is not enough evidence in the documents to answer.").when(action == "answer_with_caveat", F.concat(F.lit("Note: the evidence is partial. "), answer)).otherwise(answer)
    return text, F.when(action == "abstain", F.slice(citations, 1, 0)).otherwise(citations)


def structural_conflicts(questions: DataFrame, changes: DataFrame) -> DataFrame:
    """(query_id, conflict, type, confidence, method) of questions to which a version change applies."""
    n = changes.groupBy("query_id").agg(F.count("*").alias("n"))
    return questions.select("query_id").join(n, "query_id").select("query_id", F.lit(True).alias("conflict"), F.lit("temporal").alias("type"), F.lit(1.0).alias("confidence"), F.lit("version_diff").alias("method"))


def majority_vote(votes: DataFrame, by: str = "pair_id") -> DataFrame:
    """votes (pair_id, sample, conflict, type, explanation) -> (pair_id, conflict, confidence, type, explanation).

    Conflict needs a strict majority of the samples that didn't fail (conflict not null); confidence is the winning side's share;
    type and explanation are the winning side's first that are filled, by sample.
    """
    v = votes.where("conflict is not null")
    t = v.groupBy(by).agg((F.count_if("conflict") * 2 > F.count("*")).alias("conflict"), F.count_if("conflict").alias("yes"), F.count("*").alias("n"))
    won = v.withColumnRenamed("conflict", "__vote").join(t, by).where("__vote = conflict")
    said = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("sample"))).alias(c)
    first = won.groupBy(by).agg(said("type"), said("explanation"))
    share = F.bround(F.greatest("yes", F.col("n") - F.col("yes")) / F.col("n"), 2)
    return t.join(first, by, "left").select(by, "conflict", share.alias("confidence"), F.when(F.col("conflict"), F.col("type")).alias("type"), "explanation")


def textual_pairs(ranked: DataFrame, verdict: DataFrame) -> DataFrame:
    """Pairs worth a vote: of questions whose evidence isn't insufficient and whose rounded confidence is 0.7 or more."""
    ok = verdict.where((F.col("sufficiency.verdict") != "insufficient") & (F.col("sufficiency.confidence") >= 0.7)).select("query_id")
    return cross_source_pairs(ranked.join(ok, "query_id", "left_semi"))


def resolve(conflict: Column, kind: Column, a: Column, b: Column) -> Column:
    """struct<strategy, preferred_chunk_id> for structs a and b of chunk_id, valid_until and version_order."""
    later = F.when(a["valid_until"] > b["valid_until"], a["chunk_id"]).when(b["valid_until"] > a["valid_until"], b["chunk_id"]).when(a["version_order"] > b["version_order"], a["chunk_id"]).when(b["version_order"] > a["version_order"], b["chunk_id"])
    timed = kind.isin("factual", "temporal")
    strategy = F.when(~F.coalesce(conflict, F.lit(False)), "none").when(F.coalesce(timed, F.lit(False)) & later.isNotNull(), "prefer_recent").when(F.coalesce(timed, F.lit(False)), "undetermined").otherwise("multi_perspective")
    return F.struct(strategy.alias("strategy"), F.when(strategy == "prefer_recent", later).alias("preferred_chunk_id"))


def threshold_sweep(signals: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """signals (score, should_abstain) -> (threshold, false_abstentions, correct_abstentions, accuracy), 0.10 to 0.65 by 0.05.

    Each row is repeated for the dozen thresholds inside its task and summed there, before anything moves.
    """
    steps = thresholds or [round(0.10 + 0.05 * i, 2) for i in range(12)]
    t = signals.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in steps]))).withColumn("abstains", F.col("score") < F.col("threshold"))
    return t.groupBy("threshold").agg(
        F.count_if(F.col("abstains") & ~F.col("should_abstain")).alias("false_abstentions"), F.count_if(F.col("abstains") & F.col("should_abstain")).alias("correct_abstentions"),
        F.avg((F.col("abstains") == F.col("should_abstain")).cast("double")).alias("accuracy"),
    )


def keep_first(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

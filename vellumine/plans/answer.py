"""A batch of questions through the whole chain: plan, search, refine, rerank, judge, generate, gate."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine import settings
from vellumine.functions.text import terms
from vellumine.operators import expand, filters, fusion, generate, reliability, rerank, search
from vellumine.operators.diff import summarise
from vellumine.plans import planner


def settle(df: DataFrame) -> DataFrame:
    """df computed once, in the folder of spark.checkpoint.dir that driver and executors share; a folder is made only where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="vellumine-"))
    return df.checkpoint()


_PLACE = ["chunk_id", "text", "source_id", "source_path", "hierarchy_path", "parent_path", "parent_chunk_id", "section_title", "version_tag", "version_order", "status", "valid_until", "valid_from", "line_num", "page_num"]


def retrieve(questions: DataFrame, points: DataFrame, index: DataFrame, version_tags: list[str], top: int | None = None, rerank_on: bool | None = None, strategy: str = "hybrid", change_points: DataFrame | None = None) -> DataFrame:
    """questions (query_id, question, vector or not), points (_PLACE and vector or not), index (chunk_id, term, weight) -> ranked rows.

    strategy: dense, sparse or hybrid. Each filter of a plan is part of the branch's own join, before its top-k. Questions that
    compare two versions also get, for each hit on one side, the chunk of the same path on the other, and the chunks that the nearest of
    change_points (chunk_id, source_id, version_from, version_to, hierarchy_path, vector) speak of.
    """
    s = settings.load()
    q = planner.plan(questions, version_tags)
    col = {c: F.col(f"p.{c}") for c in ("status", "version_tag", "valid_from", "valid_until")}
    allowed = filters.plan_condition(F.struct(F.col("q.filters").alias("filters")), F.col("q.question"), col)
    ok = lambda hits: hits.alias("h").join(q.alias("q"), "query_id").join(points.select("chunk_id", *list(col)).alias("p"), "chunk_id").where(allowed).select("query_id", "chunk_id", F.col("h.score").alias("score"))
    branches = {}
    if strategy in ("sparse", "hybrid"):
        wanted = search.query_terms(q, terms(F.lower("question")))
        hit = wanted.select("query_id", "term").join(index, "term").groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("score"))
        branches["sparse"] = search.top_k(ok(hit), s.branch_k)
    if strategy in ("dense", "hybrid") and "vector" in questions.columns:
        branches["dense"] = search.dense(q, points, s.branch_k, allowed=allowed)
    if len(branches) == 2:
        ranked = fusion.hybrid(branches["dense"], branches["sparse"], (s.dense_weight, s.sparse_weight), s.rrf_k)
    else:
        ranked = next(iter(branches.values()))
    c = ranked.select("query_id", "chunk_id", "score", "rank").join(points.select(*_PLACE), "chunk_id").join(q.select("query_id", "question", "intent", "entity", "filters"), "query_id")
    hits = None
    if change_points is not None and "vector" in questions.columns:
        two = q.where("intent = 'comparative' and size(filters.version_tags) = 2")
        pair = (F.col("p.version_from") == F.col("q.filters.version_tags")[0]) & (F.col("p.version_to") == F.col("q.filters.version_tags")[1])
        near = search.dense(two, change_points, s.change_k, allowed=pair)
        hits = near.join(change_points.select("chunk_id", "source_id", "version_from", "version_to", "hierarchy_path"), "chunk_id").drop("chunk_id")
    c = refine(settle(c), points, hits, s.sibling_limit)
    return rerank.rerank(c, s.top_k if top is None else top, s.rerank if rerank_on is None else rerank_on)


def refine(c: DataFrame, points: DataFrame, change_hits: DataFrame | None = None, limit: int = expand.SIBLINGS) -> DataFrame:
    """Hierarchy filter for factual questions with an entity, version dedupe, completion by siblings, other versions and changes' contents."""
    c = filters.keep_or_all(c, (F.col("intent") != "factual") | F.col("entity").isNull() | F.contains(F.lower("hierarchy_path"), F.lower("entity")))
    gate = expand.dedupe_gate(F.col("intent"), F.col("filters"))
    once = expand.version_dedupe(c.where(gate), F.col("intent") == "comparative").unionByName(c.where(~gate))
    extra = expand.siblings(once, points, limit).select("query_id", "chunk_id", "score")
    last = once.groupBy("query_id").agg(F.max("rank").alias("last"))
    q = once.select("query_id", "question", "intent", "entity", "filters").dropDuplicates(["query_id"])
    sides = once.where("intent = 'comparative' and size(filters.version_tags) = 2")
    tags = F.col("filters.version_tags")
    # after the siblings, which are as many as there are; of a chunk that is found twice the first kind stays
    found = [(extra, 0), (expand.counterparts(sides, points, tags[0], tags[1]).withColumn("score", F.lit(0.0)).select("query_id", "chunk_id", "score"), 1)]
    if change_hits is not None:
        found.append((expand.change_contents(change_hits, once, points).withColumn("score", F.lit(0.0)).select("query_id", "chunk_id", "score"), 2))
    every = reduce(DataFrame.unionByName, [search.top_k(df, limit).withColumn("kind", F.lit(k)) if k == 0 else df.withColumns({"rank": F.lit(0), "kind": F.lit(k)}) for df, k in found])
    every = every.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min(F.struct("kind", "rank")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "chunk_id")
    more = every.withColumn("rank", F.row_number().over(w)).drop("at").join(last, "query_id").withColumn("rank", F.col("rank") + F.col("last")).drop("last")
    return once.unionByName(more.join(points.select(*_PLACE), "chunk_id").join(q, "query_id").select(*once.columns))


def answer(questions: DataFrame, points: DataFrame, index: DataFrame, version_tags: list[str], changes: DataFrame | None = None, sources: DataFrame | None = None, provider: str | None = None, top: int | None = None, votes: DataFrame | None = None, change_points: DataFrame | None = None) -> DataFrame:
    """(query_id, answer, citations, confidence, zone, combined_score, sufficiency, conflicts) of each question."""
    own_settings = settings.load()
    ranked = settle(retrieve(questions, points, index, version_tags, top, change_points=change_points))  # used by all that follows
    diff, own = None, None
    if changes is not None and sources is not None:
        asked = ranked.where("intent = 'comparative'")
        own = expand.diff_lookup(asked, questions.select("query_id", "question"), sources, changes)
        paths = filters.target_paths(asked, own.select("query_id", F.regexp_replace("key", r"\|[^|]*$", "").alias("hierarchy_path"), F.lit(1).alias("rank")))
        own = own.join(paths, "query_id").where(F.array_contains("paths", F.regexp_replace("key", r"\|[^|]*$", ""))).drop("paths")
        own = settle(own)
        diff = summarise(own, ["query_id"])
        used = filters.narrow(ranked, paths)
    else:
        used = ranked
    verdicts = reliability.with_sufficiency(questions.select("query_id", "question"), ranked, diff)
    ctx = questions.select("query_id", "question").join(generate.contexts(used, points), "query_id", "left")
    ctx = ctx.join(diff, "query_id", "left") if diff is not None else ctx.withColumn("summary", F.lit(None).cast("string"))
    made = generate.generate(ctx.select("query_id", generate.user_message(F.col("question"), F.col("context"), F.col("summary")).alias("prompt")), provider or own_settings.provider)
    cited = generate.cite(made.select("query_id", "generation.citations"), used.select(*_PLACE).dropDuplicates(["chunk_id"]))
    cites = cited.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", *[c for c in cited.columns if c not in ("query_id", "pos")]))), lambda c: c.dropFields("pos")).alias("citations"))
    scores = ranked.groupBy("query_id").agg(F.collect_list(F.coalesce("rerank_score", "score")).alias("scores"))
    conflicts = None
    if own is not None:
        conflicts = reliability.structural_conflicts(questions, own).select("query_id", F.array(F.struct("conflict", "type", "confidence", "method")).alias("conflicts"))
    if votes is not None:
        pairs = reliability.textual_pairs(ranked, verdicts)
        said = reliability.majority_vote(votes).where("conflict")
        text = pairs.withColumn("pair_id", F.concat_ws("|", "a", "b")).join(said, "pair_id").groupBy("query_id").agg(F.collect_list(F.struct("conflict", "type", "confidence", F.lit("llm_fallback").alias("method"))).alias("textual"))
        conflicts = text.withColumnRenamed("textual", "conflicts") if conflicts is None else conflicts.join(text, "query_id", "full_outer").select("query_id", F.concat(F.coalesce("conflicts", F.array().cast("array<struct<conflict:boolean,type:string,confidence:double,method:string>>")), F.coalesce("textual", F.array().cast("array<struct<conflict:boolean,type:string,confidence:double,method:string>>"))).alias("conflicts"))
    d = verdicts.join(made, "query_id").join(cites, "query_id", "left").join(scores, "query_id", "left")
    d = d.join(conflicts, "query_id", "left") if conflicts is not None else d.withColumn("conflicts", F.lit(None).cast("array<struct<conflict:boolean,type:string,confidence:double,method:string>>"))
    g = reliability.gate(F.coalesce("scores", F.array().cast("array<double>")), F.col("generation.confidence"), F.col("sufficiency.verdict"), F.col("sufficiency.confidence"), planner.intent(F.col("question")) == "ambiguous", own_settings.gate_low, own_settings.gate_high)
    d = d.withColumn("gate", g)
    text, kept = reliability.finalise(F.col("gate.action"), F.col("generation.answer"), F.col("citations"))
    return d.select("query_id", text.alias("answer"), kept.alias("citations"), F.col("generation.confidence").alias("confidence"), "gate.zone", "gate.combined_score", "gate.action", "sufficiency", "conflicts")


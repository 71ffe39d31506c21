"""What comes after fusion: version de-duplication, sibling and counterpart completion, change contents, diff lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import collapse_ws

#: Siblings of a group; chunks fetched for a path; change nodes of a question.
SIBLINGS, COUNTERPARTS, CHANGES = 50, 1, 5


def version_dedupe(candidates: DataFrame, comparative: Column | None = None) -> DataFrame:
    """candidates (query_id, chunk_id, rank, source_id, hierarchy_path, version_order, text) without older versions of one place.

    Rows that share source and path keep the greatest version_order, the best rank first among equals; rows without a
    version_order always stay. For comparative questions versions of another text (white space collapsed) stay as well, and
    empty texts are never repeats. Order is that in which each place is first seen.
    """
    comparative = F.lit(False) if comparative is None else comparative
    key = F.when(F.col("version_order").isNull(), F.struct(F.lit("chunk").alias("k"), F.col("chunk_id").alias("a"), F.lit("").alias("b"))).otherwise(F.struct(F.lit("place").alias("k"), F.coalesce("source_id", F.lit("")).alias("a"), F.coalesce("hierarchy_path", F.lit("")).alias("b")))
    norm = collapse_ws(F.coalesce("text", F.lit("")))
    place = Window.partitionBy("query_id", "__key").orderBy(F.desc_nulls_last("version_order"), "rank")
    same = Window.partitionBy("query_id", "__key", "__norm").orderBy(F.desc_nulls_last("version_order"), "rank")
    seen = Window.partitionBy("query_id", "__key")
    d = candidates.withColumns({"__key": key, "__norm": norm, "__cmp": comparative})
    d = d.withColumns({"__n": F.row_number().over(place), "__m": F.row_number().over(same), "__first": F.min("rank").over(seen)})
    kept = d.where((F.col("__n") == 1) | (F.col("__cmp") & ((F.col("__m") == 1) | (F.col("__norm") == ""))))
    order = Window.partitionBy("query_id").orderBy("__first", "__n")
    return kept.withColumn("rank", F.row_number().over(order)).drop(*[c for c in kept.columns if c.startswith("__")])


def dedupe_gate(intent: Column, filters: Column) -> Column:
    """Whether to dedupe: always but for comparative questions without a version filter."""
    return ~((intent == "comparative") & filters["version_tag"].isNull() & (F.coalesce(F.size(filters["version_tags"]), F.lit(0)) <= 0))


def _absent(found: DataFrame, candidates: DataFrame) -> DataFrame:
    return found.join(candidates.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")


def siblings(candidates: DataFrame, points: DataFrame, limit: int = SIBLINGS) -> DataFrame:
    """(query_id, chunk_id, score 0, parent_path, source_id, version_tag): points of the candidates' sibling groups that aren't there yet."""
    groups = candidates.where("parent_path is not null").select("query_id", "parent_path", "source_id", "version_tag").distinct()
    keys = groups.select("parent_path", "source_id", "version_tag").distinct()
    w = Window.partitionBy("parent_path", "source_id", "version_tag").orderBy("chunk_id")
    pts = points.where("parent_path is not null").select("chunk_id", "parent_path", "source_id", "version_tag")
    on = (pts["parent_path"] == keys["parent_path"]) & (keys["source_id"].isNull() | (pts["source_id"] == keys["source_id"])) & pts["version_tag"].eqNullSafe(keys["version_tag"])
    capped = pts.join(keys, on, "left_semi").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")
    g, p = groups.alias("g"), capped.alias("p")
    on = (F.col("g.parent_path") == F.col("p.parent_path")) & (F.col("g.source_id").isNull() | (F.col("g.source_id") == F.col("p.source_id"))) & F.col("g.version_tag").eqNullSafe(F.col("p.version_tag"))
    found = g.join(p, on).select("g.query_id", "p.chunk_id", F.lit(0.0).alias("score"), "p.parent_path", "p.source_id", "p.version_tag").distinct()
    return _absent(found, candidates)


def counterparts(candidates: DataFrame, points: DataFrame, version_from: Column, version_to: Column) -> DataFrame:
    """(query_id, chunk_id, hierarchy_path, source_id, version_tag): for candidates of either version the chunk of the same path in the other, if none is there."""
    c = candidates.withColumns({"__from": version_from, "__to": version_to}).where("version_tag = __from or version_tag = __to")
    wanted = c.select("query_id", "source_id", "hierarchy_path", F.when(F.col("version_tag") == F.col("__from"), F.col("__to")).otherwise(F.col("__from")).alias("version_tag")).distinct()
    missing = wanted.join(candidates.select("query_id", "hierarchy_path", "version_tag").distinct(), ["query_id", "hierarchy_path", "version_tag"], "left_anti")
    return _absent(_fetch(missing, points), candidates)


def change_contents(hits: DataFrame, candidates: DataFrame, points: DataFrame) -> DataFrame:
    """hits (query_id, hierarchy_path, source_id, version_from, version_to) -> the chunk of each path in each of both versions, unless it is there."""
    wanted = hits.select("query_id", "source_id", "hierarchy_path", F.explode(F.array("version_from", "version_to")).alias("version_tag")).distinct()
    return _absent(_fetch(wanted, points), candidates)


def _fetch(wanted: DataFrame, points: DataFrame) -> DataFrame:
    p = points.select("chunk_id", "source_id", "hierarchy_path", "version_tag")
    w = Window.partitionBy("query_id", "source_id", "hierarchy_path", "version_tag").orderBy("chunk_id")
    return wanted.join(p, ["source_id", "hierarchy_path", "version_tag"]).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= COUNTERPARTS).select("query_id", "chunk_id", "hierarchy_path", "source_id", "version_tag")


def diff_lookup(candidates: DataFrame, questions: DataFrame, sources: DataFrame, changes: DataFrame) -> DataFrame:
    """(query_id, changes' columns): the first candidate's source, and the first two of its versions that the question names, in declared order.

    questions (query_id, question); sources (source_id, version_order: array). Only the partitions of those pairs are read.
    """
    first = candidates.where("source_id is not null").groupBy("query_id").agg(F.min_by("source_id", "rank").alias("source_id"))
    named = first.join(questions, "query_id").join(sources, "source_id").withColumn("tags", F.filter("version_order", lambda t: F.contains(F.lower("question"), F.lower(t))))
    pair = named.where(F.size("tags") >= 2).select("query_id", "source_id", F.col("tags")[0].alias("version_from"), F.col("tags")[1].alias("version_to"))
    return pair.join(changes, ["source_id", "version_from", "version_to"])


def cross_source_pairs(ranked: DataFrame) -> DataFrame:
    """(query_id, a, b): pairs of a question's ranked chunks (a short list) from different known sources, a before b."""
    a = ranked.where("source_id is not null").select("query_id", F.col("chunk_id").alias("a"), F.col("rank").alias("ra"), F.col("source_id").alias("sa"))
    b = ranked.where("source_id is not null").select("query_id", F.col("chunk_id").alias("b"), F.col("rank").alias("rb"), F.col("source_id").alias("sb"))
    return a.join(b, "query_id").where("ra < rb and sa <> sb").select("query_id", "a", "b")


def evidence_per_source(ranked: DataFrame) -> DataFrame:
    """The best chunk of each source, for questions with two sources and more."""
    w = Window.partitionBy("query_id", "source_id").orderBy("rank")
    one = ranked.where("source_id is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return one.withColumn("__c", F.count("*").over(Window.partitionBy("query_id"))).where("__c >= 2").drop("__c")

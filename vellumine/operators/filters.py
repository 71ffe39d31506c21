"""Predicates: search filters in three dialects, fallbacks that keep all where nothing matches, relevance."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import all_of, path_norm


def match(column: Column, how: Any) -> Column:
    """{'any': [...]} is membership (and wins over a value), {'value': x} or a bare x equality. A missing field never matches."""
    if isinstance(how, dict) and "any" in how:
        return F.coalesce(column.isin(list(how["any"])), F.lit(False))
    if isinstance(how, dict) and "range" in how:
        r = how["range"]
        parts = [op(column) for op in ([lambda c: c >= r["gte"]] if "gte" in r else []) + ([lambda c: c <= r["lte"]] if "lte" in r else [])]
        return F.coalesce(all_of(parts), F.lit(False))
    value = how["value"] if isinstance(how, dict) and "value" in how else how
    return F.coalesce(column == F.lit(value), F.lit(False))


def build_filter(spec: dict | None) -> Column:
    """One condition from {field: value}, {'key': f, 'match': m} or {'must': [...], 'must_not': [...]}; nothing asks for nothing."""
    if not spec:
        return F.lit(True)
    if "must" in spec or "must_not" in spec:
        yes = [match(F.col(c["key"]), c.get("match", {"range": c.get("range")})) for c in spec.get("must", []) if "match" in c or "range" in c]
        no = [~match(F.col(c["key"]), c["match"]) for c in spec.get("must_not", []) if "match" in c]
        return all_of(yes + no)
    if "key" in spec:
        return match(F.col(spec["key"]), spec.get("match", {"range": spec.get("range")}))
    return all_of([match(F.col(k), v) for k, v in spec.items() if v is not None])


def not_change(node_type: Column) -> Column:
    """Content rows, those without a type among them."""
    return ~node_type.eqNullSafe(F.lit("change"))


def plan_condition(plan: Column, question: Column, points: dict[str, Column]) -> Column:
    """Join condition of a plan's filters with points: status only where the question's own words name one, versions, validity."""
    asked = F.rlike(F.lower(question), F.lit("active|deprecated|obsolete|superseded"))
    f = plan["filters"]
    status = ~asked | F.coalesce(points["status"] == f["status"], F.lit(False))
    version = (
        F.when(F.coalesce(F.size(f["version_tags"]), F.lit(0)) > 0, F.coalesce(F.array_contains(f["version_tags"], points["version_tag"]), F.lit(False)))
        .when(f["version_tag"].isNotNull(), F.coalesce(points["version_tag"] == f["version_tag"], F.lit(False))).otherwise(True)
    )
    since = f["valid_from"].isNull() | F.coalesce(points["valid_from"] >= f["valid_from"], F.lit(False))
    until = f["valid_until"].isNull() | F.coalesce(points["valid_until"] <= f["valid_until"], F.lit(False))
    return status & version & since & until


def keep_or_all(rows: DataFrame, condition: Column, by: str = "query_id") -> DataFrame:
    """Of each group the rows that meet the condition, or all of them if none does."""
    flag = F.coalesce(condition, F.lit(False))
    marked = rows.withColumn("__hit", flag).withColumn("__any", F.max("__hit").over(Window.partitionBy(by)))
    return marked.where("__hit or not __any").drop("__hit", "__any")


def hierarchy_filter(candidates: DataFrame, entity: Column) -> DataFrame:
    """Candidates whose path has the entity in it, whatever the case; all of a question's if none has, or it has no entity."""
    return keep_or_all(candidates, F.contains(F.lower("hierarchy_path"), F.lower(entity)))


def target_paths(candidates: DataFrame, change_nodes: DataFrame) -> DataFrame:
    """(query_id, paths): the path of the best change node where there is one, else all paths among the candidates."""
    first = change_nodes.groupBy("query_id").agg(F.min_by("hierarchy_path", "rank").alias("path"))
    all_ = candidates.groupBy("query_id").agg(F.array_sort(F.collect_set("hierarchy_path")).alias("all"))
    return all_.join(first, "query_id", "full_outer").select("query_id", F.coalesce(F.when(F.col("path").isNotNull(), F.array("path")), "all").alias("paths"))


def narrow(candidates: DataFrame, paths: DataFrame) -> DataFrame:
    """Candidates on their question's target paths; all of a question's if none is, or it has no targets."""
    joined = candidates.join(paths, "query_id", "left")
    return keep_or_all(joined, F.array_contains("paths", F.col("hierarchy_path"))).drop("paths")


def changes_on(changes: DataFrame, paths: Column | None = None, key: Column | None = None) -> DataFrame:
    """Changes whose key's path is one of paths, or whose key is given."""
    if key is not None:
        changes = changes.where(F.col("key") == key)
    if paths is not None:
        changes = changes.where(F.array_contains(paths, F.regexp_replace("key", r"\|[^|]*$", "")))
    return changes


def is_relevant(source_path: Column, expected: Column) -> Column:
    """Whether a path ends in one of the expected or one of them in it, slashes either way; an empty path never."""
    p = path_norm(F.coalesce(source_path, F.lit("")))
    return (p != "") & F.exists(expected, lambda e: F.endswith(p, path_norm(e)) | F.endswith(path_norm(e), p))


def is_relevant_lenient(source_id: Column, expected: Column) -> Column:
    return F.coalesce(F.exists(expected, lambda e: F.contains(source_id, e)), F.lit(False))

"""Structural diffs between versions: keys, full outer comparison, scores, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import clip_text, strip_ws
from vellumine.functions.sizes import small
from vellumine.operators.tree import KEYED, with_paths


def canonical(nodes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(tree_id, key, hash, fields, and columns to keep): nodes of keyed types by `path|type#ordinal`, the last of equal keys.

    The ordinal counts a parent's children of the type from 0 in order of insertion; fields is a map of text, Markdown and
    metadata (a map<string,string> column where there is one). What the parser found of whole trees is taken from it.
    """
    parsed = {"tree_path", "ordinal", "key_last"} <= set(nodes.columns)
    place = Window.partitionBy("tree_id", "parent_id", "type").orderBy("node_seq")
    k = with_paths(nodes.withColumn("__ord", F.col("ordinal") if parsed else F.row_number().over(place) - 1))
    k = k.where(F.col("type").isin(KEYED)).withColumn("key", F.concat("hierarchy_path", F.lit("|"), "type", F.lit("#"), F.col("__ord").cast("string")))
    last = Window.partitionBy("tree_id", "key").orderBy(F.desc("node_seq"))
    k = k.where("key_last") if parsed else k.withColumn("__n", F.row_number().over(last)).where("__n = 1")
    own = F.create_map(F.lit("text"), F.col("text"), F.lit("markdown"), F.col("markdown"))
    fields = F.map_concat(own, F.map_filter("metadata", lambda name, _: ~name.isin("text", "markdown"))) if "metadata" in nodes.columns else own
    return k.select("tree_id", "key", F.col("content_hash").alias("hash"), fields.alias("fields"), *(keep or []))


def field_changes(old: Column, new: Column) -> Column:
    """map<field, struct<old, new>> of the fields that differ."""
    zipped = F.map_zip_with(old, new, lambda _, a, b: F.struct(a.alias("old"), b.alias("new")))
    return F.map_filter(zipped, lambda _, v: ~v["old"].eqNullSafe(v["new"]))


def version_diff(old: DataFrame, new: DataFrame, on: list[str] | None = None) -> DataFrame:
    """old, new (on..., key, hash, fields) -> (on..., key, change_type, field_changes, old_hash, new_hash) of keys that differ."""
    by = [*(on or []), "key"]
    o = old.select(*by, F.col("hash").alias("old_hash"), F.col("fields").alias("old_fields"), F.lit(True).alias("in_old"))
    n = new.select(*by, F.col("hash").alias("new_hash"), F.col("fields").alias("new_fields"), F.lit(True).alias("in_new"))
    both = o.join(n, by, "full_outer")
    kind = F.when(F.col("in_new").isNull(), "removed").when(F.col("in_old").isNull(), "added").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
    changed = both.withColumn("change_type", kind).where("change_type is not null")
    return changed.select(*by, "change_type", F.when(F.col("change_type") == "modified", field_changes(F.col("old_fields"), F.col("new_fields"))).alias("field_changes"), "old_hash", "new_hash")


def version_pairs(sources: DataFrame, present: DataFrame) -> DataFrame:
    """sources (source_id, version_order: array), present (source_id, version_tag) -> (source_id, version_from, version_to) in declared order."""
    v = sources.select("source_id", F.posexplode("version_order").alias("pos", "version_tag")).join(present.select("source_id", "version_tag").distinct(), ["source_id", "version_tag"])
    a = v.select("source_id", F.col("pos").alias("pa"), F.col("version_tag").alias("version_from"))
    b = v.select("source_id", F.col("pos").alias("pb"), F.col("version_tag").alias("version_to"))
    return a.join(b, "source_id").where("pa < pb").select("source_id", "version_from", "version_to")


def missing_versions(sources: DataFrame, present: DataFrame) -> DataFrame:
    v = sources.select("source_id", F.explode("version_order").alias("version_tag"))
    return v.join(present.select("source_id", "version_tag").distinct(), ["source_id", "version_tag"], "left_anti")


def diff_all(canonical_nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs in one job: canonical_nodes (source_id, version_tag, key, hash, fields), pairs of version_pairs()."""
    on = ["source_id", "version_from", "version_to"]
    pairs = small(pairs)
    side = lambda tag: pairs.join(canonical_nodes.withColumnRenamed("version_tag", tag), ["source_id", tag]).select(*on, "key", "hash", "fields")
    return version_diff(side("version_from"), side("version_to"), on)


def counts(changes: DataFrame, by: list[str]) -> DataFrame:
    n = lambda kind: F.count_if(F.col("change_type") == kind).alias(kind)
    return changes.groupBy(*by).agg(n("added"), n("removed"), n("modified"))


def _text_changed(v: Column) -> Column:
    return v["old"].isNotNull() & v["new"].isNotNull() & (F.lower(strip_ws(v["old"])) != F.lower(strip_ws(v["new"])))


def index_score(change_type: Column, changes: Column) -> Column:
    """2 for added and removed; for modified, 3 for each main text and 1 for each other field whose words change."""
    worth = lambda e: F.when(_text_changed(e["value"]), F.when(e["key"].isin("markdown", "text", "description"), 3).otherwise(1)).otherwise(0)
    return F.when(change_type.isin("added", "removed"), 2).otherwise(F.aggregate(F.map_entries(F.coalesce(changes, F.create_map().cast("map<string,struct<old:string,new:string>>"))), F.lit(0), lambda a, e: a + worth(e)))


def question_score(field: Column, old: Column, new: Column) -> Column:
    """0 if the words are the same; else 1, 3 more for Markdown, and one for each hundred characters of both, up to 4."""
    size = F.least(F.length(old) + F.length(new), F.lit(400))
    return F.when(F.lower(strip_ws(old)) == F.lower(strip_ws(new)), 0).otherwise(1 + F.when(field == "markdown", 3).otherwise(0) + F.floor(size / 100).cast("int"))


def change_point_id(source: Column, version_from: Column, version_to: Column, key: Column) -> Column:
    return F.concat_ws("-", F.lit("change"), source, version_from, version_to, key)


def describe(change: DataFrame, provider: Column | None = None) -> DataFrame:
    """change with `description`: the provider's, or a line that names source, versions, element, kind and fields."""
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("field_changes")), lambda e: F.concat(e["key"], F.lit(": "), clip_text(e["value"]["old"]), F.lit(" -> "), clip_text(e["value"]["new"]))), "; ")
    own = F.concat_ws("\n", F.concat(F.lit("Source "), "source_id", F.lit(", "), "version_from", F.lit(" -> "), "version_to"), F.concat(F.lit("Element: "), "key"), F.concat(F.lit("Change: "), "change_type"), F.when(fields != "", F.concat(F.lit("Fields: "), fields)))
    return change.withColumn("description", own if provider is None else F.coalesce(provider, own))


def summary_line(key: Column, change_type: Column, changes: Column, version_from: Column, version_to: Column) -> Column:
    fields = F.array_join(F.transform(F.array_sort(F.map_entries(changes)), lambda e: F.concat(e["key"], F.lit(" ('"), clip_text(e["value"]["old"]), F.lit("' -> '"), clip_text(e["value"]["new"]), F.lit("')"))), ", ")
    said = F.when(change_type == "added", F.concat(F.lit(": added in "), version_to)).when(change_type == "removed", F.concat(F.lit(": removed since "), version_from)).when(F.coalesce(fields, F.lit("")) != "", F.concat(F.lit(": modified "), fields)).otherwise(F.lit(": modified"))
    return F.concat(F.lit("- "), key, said)


def summarise(changes: DataFrame, by: list[str]) -> DataFrame:
    """(by..., summary): a heading and a line for each change, ordered by key."""
    line = summary_line(F.col("key"), F.col("change_type"), F.col("field_changes"), F.col("version_from"), F.col("version_to"))
    g = changes.groupBy(*by).agg(F.first("version_from").alias("__f"), F.first("version_to").alias("__t"), F.array_sort(F.collect_list(F.struct("key", line.alias("line")))).alias("l"))
    head = F.concat(F.lit("Changes between "), "__f", F.lit(" and "), "__t", F.lit(":"))
    return g.select(*by, F.concat_ws("\n", head, F.array_join(F.transform("l", lambda s: s["line"]), "\n")).alias("summary"))


def diverse_top(changes: DataFrame, n: int = 15, per_pair: int = 3) -> DataFrame:
    """The n best modified fields: the best field of a change, at most `per_pair` of one version pair."""
    e = changes.where("change_type = 'modified'").select("source_id", "version_from", "version_to", "key", F.explode("field_changes").alias("field", "v"))
    e = e.where("v.old <> '' and v.new <> ''").withColumn("score", question_score(F.col("field"), F.col("v.old"), F.col("v.new"))).where("score > 0")
    one = Window.partitionBy("source_id", "key", "version_from", "version_to").orderBy(F.desc("score"), "field")
    pair = Window.partitionBy("source_id", "version_from", "version_to").orderBy(F.desc("score"), "key")
    best = e.withColumn("__n", F.row_number().over(one)).where("__n = 1").withColumn("__n", F.row_number().over(pair)).where(F.col("__n") <= per_pair)
    return best.orderBy(F.desc("score"), "source_id", "version_from", "version_to", "key").limit(n).select("source_id", "version_from", "version_to", "key", "field", F.col("v.old").alias("old"), F.col("v.new").alias("new"), "score")

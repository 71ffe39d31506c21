"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import item, small, table, words

SHINGLE = 5
CONTAINMENT = 0.8


def _shingles(w: Column, of) -> Column:
    """`of` each run of five of the array w; of the whole of it where it is shorter; none of none."""
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: of(*[item(w, i + k) for k in range(SHINGLE)]))
    whole = of(*[item(w, F.lit(k)) for k in range(SHINGLE)])
    return F.when(n >= SHINGLE, runs).when(n > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>" if of is F.xxhash64 else "array<string>"))


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) of each item of whose distinct 5-word shingles a document holds the share.

    Items are partitioned by size, class c holding those of up to 2^c distinct shingles. An item's signature is its
    m least shingle hashes (bottom-m MinHash); m = u - ceil(t u) + 1 for the class's upper size u is enough that a
    document with the share t of the item must hold one of them, so that no leak is missed at any document length.
    Documents are streamed past the signatures; the pairs found are then verified on the shingles themselves.

    Words are lower-cased runs of letters and digits. A text of fewer than five words has one shingle, all of its words,
    and so an item of that kind is found in documents of the same words only. Texts that are null or without words hold
    nothing and leak nothing. Repeated rows of an id are one document (its shingles' union) or one item. Null ids of
    documents or items never match. Other columns play no part; no rows on either side give no rows.
    """
    it = items.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("w")).where("item_id is not null and size(w) > 0")
    grams = it.select("item_id", F.explode(_shingles(F.col("w"), _joined)).alias("gram")).distinct()
    hashed = it.select("item_id", F.transform("w", lambda x: F.xxhash64(x)).alias("w")).select("item_id", F.explode(_shingles(F.col("w"), F.xxhash64)).alias("h")).distinct()
    sized = hashed.groupBy("item_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.size("hs"))))
    keep = (upper - F.ceil(upper * F.lit(containment) - 1e-9) + 1).cast("int")
    signature = sized.select("item_id", F.explode(F.slice("hs", F.lit(1), F.greatest(keep, F.lit(1)))).alias("h"))

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    seen = d.select("doc_id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w")).where("size(w) > 0")
    # the hashes are one array a row before they are exploded, so that no word is copied with them
    pairs = seen.select("doc_id", F.explode(_shingles(F.col("w"), F.xxhash64)).alias("h")).join(small(signature), "h").select("doc_id", "item_id").distinct()
    pairs = table(pairs, "pairs")  # read three times below

    picked = d.join(small(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    held = picked.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(_shingles(F.col("w"), _joined)).alias("gram")).join(small(grams), "gram").distinct()
    shared = held.join(pairs, ["doc_id", "item_id"], "left_semi").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    sizes = grams.groupBy("item_id").agg(F.count("*").alias("item_shingles"))
    out = shared.join(small(sizes), "item_id").withColumn("containment", F.col("shared") / F.col("item_shingles"))
    return out.where(F.col("containment") >= containment).select("doc_id", "item_id", "item_shingles", "shared", "containment")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents in which no item leaks; rows of a null id stay."""
    bad = leaks(docs, items, id_col, text_col, **how).select("doc_id").distinct().withColumnRenamed("doc_id", "__leak")
    return docs.join(small(bad), F.col(id_col) == F.col("__leak"), "left_anti")


SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), ds AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM dw
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), its AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM iw
), n AS (SELECT item_id, count(*) AS item_shingles FROM its GROUP BY item_id)
SELECT doc_id, item_id, item_shingles, count(*) AS shared, count(*) / item_shingles AS containment
FROM ds JOIN its USING (gram) JOIN n USING (item_id) GROUP BY doc_id, item_id, item_shingles HAVING count(*) / item_shingles >= 0.8
"""

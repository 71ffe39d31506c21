"""Line de-duplication: repeated windows of three consecutive lines go, their first occurrence stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import item, table

WINDOW = 3


def _windows(docs: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """(key, p0.., h1, h2): each run of three lines that aren't blank, with the places of its lines."""
    lines = F.filter(
        F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(i.alias("at"), F.trim(F.regexp_replace(x, r"[\t\r]", " ")).alias("line"))),
        lambda s: s["line"] != "",
    )
    d = docs.select(*key, lines.alias("l")).where(F.size("l") >= WINDOW)
    runs = F.transform(
        F.sequence(F.lit(0), F.size("l") - WINDOW),
        lambda i: F.struct(
            *[item(F.col("l"), i + k)["at"].alias(f"p{k}") for k in range(WINDOW)],
            F.xxhash64(*[item(F.col("l"), i + k)["line"] for k in range(WINDOW)]).alias("h1"),
            F.hash(*[item(F.col("l"), i + k)["line"] for k in range(WINDOW)]).alias("h2"),
        ),
    )
    return d.select(*key, F.explode(runs).alias("w")).select(*key, *[f"w.p{k}" for k in range(WINDOW)], "w.h1", "w.h2")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines taken out of `text_col`, and n_lines and n_removed (long) added.

    A window is three consecutive lines, blank ones skipped, compared with tabs as spaces and outer spaces stripped.
    Windows order by (id, place); every occurrence but the first covers its three lines, and all covered lines go.
    Blank lines stay. Texts of fewer than three such lines have no window and stay as they are, as do null texts (n_lines 0)
    and empty ones (n_lines 1). Rows of a null id take part in counting, order first, and are left as they are.
    Rows that repeat an id are documents of their own, each with its own places; they order by the id, then by the 64-bit hash of
    the text, equal rows in any order, so that of equal rows one keeps its lines. To tell them apart the rows are written once with
    a number each; that is done only where ids repeat. No rows give no rows; columns named n_lines or n_removed are replaced, all others are kept.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[c for c in names if c not in (id_col, text_col)])
    key = ["__id"]
    if own.where("__id is not null").groupBy("__id").count().where("count > 1").limit(1).count():
        own = table(own.withColumns({"__h": F.xxhash64("__text"), "__row": F.monotonically_increasing_id()}), "rows")
        key += ["__h", "__row"]
    w = _windows(own, key, "__text")
    place = F.struct(*key, "p0")
    first = w.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first")
    later = w.join(first, ["h1", "h2"]).where((place > F.col("first")) & F.col("__id").isNotNull())
    covered = later.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list(F.array(*[f"p{k}" for k in range(WINDOW)])))).alias("__gone"))
    lines = F.split("__text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(kept, lambda i: item(lines, i)), "\n"))
    return own.join(covered, key, "left").select(
        *[F.col("__id").alias(c) if c == id_col else text.alias(c) if c == text_col else F.col(c) for c in names],
        F.when(F.col("__text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_removed"),
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, trim(regexp_replace(line, '[\t\r]', ' ', 'g'), ' ') AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), w AS (
  SELECT doc_id, pos AS p0, lead(pos, 1) OVER o AS p1, lead(pos, 2) OVER o AS p2,
         line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS content
  FROM lines WHERE line <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT * FROM w WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, p0) > 1
), gone AS (
  SELECT DISTINCT doc_id, p AS pos FROM (SELECT doc_id, unnest([p0, p1, p2]) AS p FROM later)
), raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), kept AS (
  SELECT r.doc_id, string_agg(line, chr(10) ORDER BY r.pos) FILTER (g.pos IS NULL) AS text, count(*) AS n_lines, count(g.pos) AS n_removed
  FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.pos = g.pos GROUP BY r.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

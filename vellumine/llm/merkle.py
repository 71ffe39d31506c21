"""Document fingerprints: a Merkle tree of sections, paragraphs and blocks.

A paragraph is a line with the line ends after it. Paragraphs go into sections by content: a heading begins one, and so does
what follows a paragraph whose hash says so (one in eight), so that an insertion moves no other section's edge. Below
paragraphs are blocks of up to a sentence. Every node's hash is of its children's whole hashes; a fingerprint shows them cut
short, from the root down: `root|section|section`, a section being `hash:length>paragraph;paragraph`, a paragraph
`hash:length=block,block`, and a block eight digits of its hash and its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.common import table

PARAGRAPH = r"[^\n]*\n+|[^\n]+"
#: A block: up to 200 characters up to the end of a sentence, with the marks that end it. Blocks tile a paragraph.
BLOCK = r"[^\n.!?]{1,200}[\n.!?]{0,8} ?|[\n.!?]{1,8} ?"
#: What a common node counts for, by its level: each branch that had to be opened to find it costs a little.
SECTION_WEIGHT, PARAGRAPH_WEIGHT, BLOCK_WEIGHT = 0.98, 0.94, 0.9


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _paragraph(text: Column) -> Column:
    """`whole hash, hash:length=block,block` of a paragraph; the whole hash has 64 digits."""
    blocks = F.transform(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)), lambda p: F.concat(F.sha2(p, 256), F.length(p)))
    shown = lambda b: F.array_join(F.transform(b, lambda x: F.concat(F.left(x, F.lit(8)), F.substring(x, 65, 9))), ",")
    return _let(blocks, lambda b: _let(F.sha2(F.array_join(b, ","), 256), lambda h: F.concat(h, F.left(h, F.lit(12)), F.lit(":"), F.length(text), F.lit("="), shown(b))))


def _length(node: Column, start: int, stop: str) -> Column:
    """The number in a node from a place on up to a mark."""
    return F.substring_index(F.substring(node, start, 24), stop, 1).cast("long")


def _section(joined: Column) -> Column:
    """`whole hash, hash:length>paragraph;paragraph` of paragraphs joined by semicolons."""
    def made(parts: Column) -> Column:
        total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + _length(x, 78, "="))
        shown = F.array_join(F.transform(parts, lambda x: F.substring(x, 65, 1 << 30)), ";")
        return _let(F.sha2(F.array_join(F.transform(parts, lambda x: F.left(x, F.lit(64))), ","), 256), lambda h: F.concat(h, F.left(h, F.lit(16)), F.lit(":"), total, F.lit(">"), shown))

    return _let(F.split(joined, ";"), made)


def sections(text: Column) -> Column:
    """array<string> of a text's sections, each after its whole hash."""
    paragraphs = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.concat(F.when(F.startswith(p, F.lit("#")), "|").otherwise(""), _paragraph(p)))
    cut = lambda r: F.when(F.substring(F.ltrim(r, F.lit("|")), 1, 1).isin("0", "1"), F.concat(r, F.lit("|"))).otherwise(r)
    joined = F.array_join(F.transform(paragraphs, cut), ";")
    return F.transform(F.filter(F.transform(F.split(joined, r"\|"), lambda s: F.trim(s, F.lit(";"))), lambda s: s != ""), _section)


def _fingerprint(whole: Column) -> Column:
    root = F.left(F.sha2(F.array_join(F.transform(whole, lambda s: F.left(s, F.lit(64))), ","), 256), F.lit(32))
    return F.concat_ws("|", root, F.array_join(_shown(whole), "|"))


def _shown(whole: Column) -> Column:
    return F.transform(whole, lambda s: F.substring(s, 65, 1 << 30))


def _total(nodes: Column, start: int, stop: str) -> Column:
    return F.aggregate(nodes, F.lit(0).cast("long"), lambda a, x: a + _length(x, start, stop))


def _below(nodes: Column, mark: str, sep: str) -> Column:
    """The distinct children of nodes."""
    return F.array_distinct(F.flatten(F.transform(nodes, lambda x: F.split(F.element_at(F.split(x, mark, 2), 2), sep))))


def _near(a: Column, b: Column) -> Column:
    """Of two texts' sections, 0 to 1: the trees are walked down the branches in which they differ.

    What both have counts once and by its length: sections first, of the others their paragraphs, of the others of those their
    blocks, each level a little less than the one above. The sum is divided by the lengths gone through. 1 where the sections are the same in the
    same order, so also for two empty texts; less where they are only in another order.
    """
    def blocks(ps: Column, qs: Column, got: Column, seen: Column) -> Column:
        def ended(x: Column, y: Column) -> Column:
            common, every = _total(F.array_intersect(x, y), 9, ","), _total(x, 9, ",") + _total(y, 9, ",")
            return F.coalesce(2 * (got + BLOCK_WEIGHT * common) / F.nullif(seen + every, F.lit(0)), F.lit(0.0))

        return _let(F.struct(_below(F.array_except(ps, qs), "=", ",").alias("x"), _below(F.array_except(qs, ps), "=", ",").alias("y")), lambda s: ended(s["x"], s["y"]))

    def paragraphs(x: Column, y: Column, got: Column, seen: Column) -> Column:
        def inner(s: Column) -> Column:
            common = _total(F.array_intersect(s["x"], s["y"]), 14, "=")
            return blocks(s["x"], s["y"], got + PARAGRAPH_WEIGHT * common, seen + 2 * common)

        return _let(F.struct(_below(x, ">", ";").alias("x"), _below(y, ">", ";").alias("y")), inner)

    common = _total(F.array_intersect(a, b), 18, ">")
    walked = _let(common, lambda c: paragraphs(F.array_except(a, b), F.array_except(b, a), SECTION_WEIGHT * c, 2 * c))
    return F.when(a == b, 1.0).otherwise(walked)


def _parts(fingerprint: Column) -> Column:
    return F.filter(F.slice(F.split(fingerprint, r"\|"), 2, 1 << 30), lambda s: s != "")


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1, as _near(); 1 for equal roots."""
    return F.when(F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1), 1.0).otherwise(_near(_parts(a), _parts(b)))


def differing_sections(a: Column, b: Column) -> Column:
    """array<int>: places of a's sections that b doesn't have, so where a was edited; empty for equal roots."""
    return F.filter(F.transform(_parts(a), lambda s, i: F.when(~F.array_contains(_parts(b), s), i)), lambda i: i.isNotNull())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint); a null text counts as empty, whose tree has a root and nothing else."""
    d = docs.select(F.col(id_col), sections(F.coalesce(F.col(text_col), F.lit(""))).alias("__whole"))
    return d.select(id_col, _fingerprint(F.col("__whole")).alias("fingerprint"))


def _previous(ids: DataFrame) -> DataFrame:
    """ids (id, n), ids distinct -> (id, prev_id, prev_n) with the id before in order, the last for the first.

    Ids are dealt out by range and ordered inside each part; only the last id of each part crosses over.
    """
    parts = table(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ids")
    tail = parts.groupBy("part").agg(F.max(F.struct("id", "n")).alias("end"))
    # a row for each part, of which there are as many as shuffle partitions
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    ends = tail.select("part", F.coalesce(F.lag("end").over(order), F.max("end").over(Window.partitionBy(F.lit(0)))).alias("before"))
    own = Window.partitionBy("part").orderBy("id")
    inner = parts.withColumn("prev", F.lag(F.struct("id", "n")).over(own))
    return inner.join(F.broadcast(ends), "part").select("id", F.coalesce("prev", "before").alias("p")).select("id", F.col("p.id").alias("prev_id"), F.col("p.n").alias("prev_n"))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text has the last floor(n / 2) code points replaced by as many of the start of the document next in
    ascending id (after the last: the first). Null texts are empty. Rows of a null id have the empty text as next one.
    Where rows repeat an id, each is a row of the result, the document next to an id is the next greater id, and an id
    stands for the least of its texts when it is the next. One row alone is its own next. No rows give no rows.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = d.where("id is not null").groupBy("id").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("rows"))
    ids = table(ids, "lengths")
    repeats = ids.where("rows > 1").limit(1).count() > 0
    before = _previous(ids.select("id", "n"))
    named = d.where("id is not null")  # read on both sides below in one form, so that texts are dealt out by id but once
    known = named.join(before, "id")
    if repeats:  # an id's least text stands for it
        known = known.groupBy("id", "prev_id", "prev_n").agg(F.min("text").alias("text"))
    heads = known.select(F.col("prev_id").alias("id"), F.left("text", F.floor(F.col("prev_n") / 2).cast("int")).alias("head"), _shown(sections(F.col("text"))).alias("next_parts"))
    out = named.join(heads, "id", "left").unionByName(d.where("id is null"), allowMissingColumns=True).withColumn("n", F.length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    out = out.withColumn("edited", F.concat(F.left("text", F.col("n") - half), F.left(F.coalesce("head", F.lit("")), half)))
    out = out.select("id", "n", F.sha2("edited", 256).alias("edited_sha256"), sections(F.col("text")).alias("whole"), sections(F.col("edited")).alias("edited_whole"), F.coalesce("next_parts", F.array().cast("array<string>")).alias("next_parts"))
    out = out.withColumns({"parts": _shown(F.col("whole")), "edited_parts": _shown(F.col("edited_whole"))})
    return out.select(
        "id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", _fingerprint(F.col("whole")).alias("fingerprint"), _fingerprint(F.col("edited_whole")).alias("edited_fingerprint"),
        _near(F.col("parts"), F.col("edited_parts")).alias("near_edited"), _near(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )


_BELOW = "list_distinct(flatten(list_transform({n}, lambda x: string_split(x[strpos(x, '{m}') + 1 :], '{s}'))))"
_EXCEPT = "list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x))"
_SUM = "coalesce(list_sum(list_transform({n}, lambda x: CAST(split_part(x[{at} :], '{stop}', 1) AS BIGINT))), 0)"


def _walk(a: str, b: str, d: str) -> str:
    """SQL of _near() over two columns of d."""
    return f"""(
  SELECT doc_id, CASE WHEN {a} = {b} THEN 1.0 ELSE 2 * (CAST({SECTION_WEIGHT} AS DOUBLE) * c + CAST({PARAGRAPH_WEIGHT} AS DOUBLE) * cp + CAST({BLOCK_WEIGHT} AS DOUBLE) * {_SUM.format(n="list_intersect(bx, bz)", at=9, stop=",")})
    / nullif(2 * c + 2 * cp + {_SUM.format(n="bx", at=9, stop=",")} + {_SUM.format(n="bz", at=9, stop=",")}, 0) END AS near
  FROM (SELECT *, {_SUM.format(n="list_intersect(px, py)", at=14, stop="=")} AS cp, {_BELOW.format(n=_EXCEPT.format(a="px", b="py"), m="=", s=",")} AS bx, {_BELOW.format(n=_EXCEPT.format(a="py", b="px"), m="=", s=",")} AS bz
    FROM (SELECT *, {_SUM.format(n=f"list_intersect({a}, {b})", at=18, stop=">")} AS c, {_BELOW.format(n=_EXCEPT.format(a=a, b=b), m=">", s=";")} AS px, {_BELOW.format(n=_EXCEPT.format(a=b, b=a), m=">", s=";")} AS py FROM {d}))
)"""


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS nxt
  FROM documents WINDOW o AS (ORDER BY doc_id)
), e AS (SELECT *, left(text, n - n // 2) || left(nxt, n // 2) AS edited FROM d),
t AS (SELECT doc_id, 'a' AS k, text AS t FROM e UNION ALL SELECT doc_id, 'e', edited FROM e UNION ALL SELECT doc_id, 'n', nxt FROM e),
para AS (
  SELECT doc_id, k, unnest(regexp_extract_all(t, '[^
]*
+|[^
]+')) AS p, generate_subscripts(regexp_extract_all(t, '[^
]*
+|[^
]+'), 1) AS i FROM t
), blk AS (
  SELECT *, list_transform(regexp_extract_all(p, '[^
.!?]{{1,200}}[
.!?]{{0,8}} ?|[
.!?]{{1,8}} ?'), lambda q: sha256(q) || length(q)) AS b FROM para
), rec AS (
  SELECT doc_id, k, i, p, sha256(array_to_string(b, ',')) AS h, array_to_string(list_transform(b, lambda x: x[1:8] || x[65:]), ',') AS shown FROM blk
), joined AS (
  SELECT doc_id, k, string_agg((CASE WHEN starts_with(p, '#') THEN '|' ELSE '' END) || h || h[1:12] || ':' || length(p) || '=' || shown || (CASE WHEN h[1:1] IN ('0', '1') THEN '|' ELSE '' END), ';' ORDER BY i) AS j
  FROM rec GROUP BY doc_id, k
), cut AS (
  SELECT doc_id, k, trim(unnest(string_split(j, '|')), ';') AS s, generate_subscripts(string_split(j, '|'), 1) AS i FROM joined
), sec AS (
  SELECT doc_id, k, i, s, sha256(array_to_string(list_transform(string_split(s, ';'), lambda x: x[1:64]), ',')) AS h FROM cut WHERE s <> ''
), tree AS (
  SELECT doc_id, k, left(sha256(string_agg(h, ',' ORDER BY i)), 32) AS root,
         list(h[1:16] || ':' || {_SUM.format(n="string_split(s, ';')", at=78, stop="=")} || '>' || array_to_string(list_transform(string_split(s, ';'), lambda x: x[65:]), ';') ORDER BY i) AS parts
  FROM sec GROUP BY doc_id, k
), g AS (
  SELECT e.doc_id, n, edited, coalesce(a.root, left(sha256(''), 32)) AS ar, coalesce(x.root, left(sha256(''), 32)) AS er,
         coalesce(a.parts, []) AS ap, coalesce(x.parts, []) AS ep, coalesce(y.parts, []) AS np
  FROM e LEFT JOIN tree a ON a.doc_id = e.doc_id AND a.k = 'a' LEFT JOIN tree x ON x.doc_id = e.doc_id AND x.k = 'e' LEFT JOIN tree y ON y.doc_id = e.doc_id AND y.k = 'n'
)
SELECT g.doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, ar || '|' || array_to_string(ap, '|') AS fingerprint, er || '|' || array_to_string(ep, '|') AS edited_fingerprint,
       CAST(ne.near AS DOUBLE) AS near_edited, CAST(nn.near AS DOUBLE) AS near_next
FROM g JOIN {_walk("ap", "ep", "g")} ne ON ne.doc_id = g.doc_id JOIN {_walk("ap", "np", "g")} nn ON nn.doc_id = g.doc_id
"""

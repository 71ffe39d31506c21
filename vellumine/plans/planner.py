"""Question planning by rules: intent, entity, filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.text import strip_ws

_PATH_CHARS = r"[-\w@%.:{}/~+]"
ENDPOINT = r"(?iU)\b(?:" + "|".join(["DELETE", "GET", "PATCH", "POST", "PUT"]) + r")\b\s*(/" + _PATH_CHARS + "*)"
PATH = r"(?U)/" + _PATH_CHARS + "+"
#: Word stems and phrases that ask for a comparison.
_STEMS = ["compar", "contrast", "difference", "différ", "distinguish"]
_PHRASES = [r"differs?", r"versus", r"vs\.?", r"better than", r"which (?:one )?is (?:best|better)", r"meilleure? que", r"par rapport [aà]", r"lequel est (?:le )?meilleur"]
COMPARATIVE = r"(?iU)\b(?:(?:" + "|".join(_STEMS) + r")\w*|" + "|".join(_PHRASES) + r")\b"
BETWEEN = [r"(?iU)\bbetween\b.+\band\b", r"(?iU)\bentre\b.+\bet\b"]

#: The same with words as RE2 and DuckDB have them: a boundary looks at ASCII letters only, space is ASCII, a dot stops at \\n alone.
_ASCII_B = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_ASCII_PATH_CHARS = r"[-\p{L}\p{N}_@%.:{}/~+]"
_ASCII = {
    "endpoint": r"(?iu)" + _ASCII_B + r"(?:DELETE|GET|PATCH|POST|PUT)" + _ASCII_B + r"[\t\n\f\r ]*(/" + _ASCII_PATH_CHARS + "*)", "path": "/" + _ASCII_PATH_CHARS + "+",
    "compares": [_ASCII_B + r"(?:(?:" + "|".join(_STEMS) + r")[\p{L}\p{N}_]*|" + "|".join(_PHRASES) + ")" + _ASCII_B, *["(?d)" + _ASCII_B + a + _ASCII_B + ".+" + _ASCII_B + b + _ASCII_B for a, b in (("between", "and"), ("entre", "et"))]],
    "version": r"(?<![/\p{L}\p{N}_])%s" + _ASCII_B,
}
_UNICODE = {"endpoint": ENDPOINT, "path": PATH, "compares": [COMPARATIVE, *BETWEEN], "version": r"(?U)(?<!/)\b%s\b"}
FILTERS = "struct<status:string,version_tag:string,version_tags:array<string>,valid_from:date,valid_until:date>"


def _has(x: Column, pattern: str) -> Column:
    return F.rlike(x, F.lit(pattern))


def intent(question: Column, ascii_words: bool = False) -> Column:
    """comparative, factual (an endpoint or path is named) or ambiguous. Words are bounded by any script's letters, or with
    `ascii_words` by ASCII's alone, as in RE2, where `êentre` holds the word `entre`."""
    p = _ASCII if ascii_words else _UNICODE
    low = F.lower(strip_ws(question))
    compares = reduce(lambda a, b: a | b, [_has(low, x) for x in p["compares"]])
    return F.when(compares, "comparative").when(_has(question, p["endpoint"]) | _has(question, p["path"]), "factual").otherwise("ambiguous")


def entity(question: Column, ascii_words: bool = False) -> Column:
    """The path of the first endpoint named, else the first path; null without either."""
    p = _ASCII if ascii_words else _UNICODE
    got = lambda p, g: F.nullif(F.regexp_extract(question, p, g), F.lit(""))
    return F.coalesce(got(p["endpoint"], 1), got(p["path"], 0))


def status(question: Column) -> Column:
    low = F.lower(question)
    return F.when(_has(low, "active|current"), "active").when(_has(low, "deprecated|obsolete"), "deprecated").when(_has(low, "superseded"), "superseded").otherwise("active")


def generic_versions(question: Column, ascii_words: bool = False) -> Column:
    """Whether v1 and v2 are both named as such, not as parts of a path."""
    p = _ASCII if ascii_words else _UNICODE
    one = lambda v: _has(F.lower(question), p["version"] % v)
    return one("v1") & one("v2")


def known_versions(sources: DataFrame) -> list[str]:
    """Declared tags of all sources, each once, by source and declared order (a list of versions, not of documents)."""
    rows = sources.orderBy("source_id").select("version_order").collect()
    return list(dict.fromkeys(t for r in rows for t in r.version_order or []))


def plan(questions: DataFrame, version_tags: list[str], judged_intent: Column | None = None, ascii_words: bool = False) -> DataFrame:
    """questions (query_id, question) with intent, entity and filters.

    `judged_intent`, a provider's column, replaces `ambiguous` where it is one of the other two. Validity is never
    asked for by rules and stays null. `ascii_words`: see intent().
    """
    q = F.col("question")
    rule = intent(q, ascii_words)
    found = rule if judged_intent is None else F.when((rule == "ambiguous") & judged_intent.isin("comparative", "factual"), judged_intent).otherwise(rule)
    tags = F.array(*[F.lit(t) for t in version_tags]) if version_tags else F.array().cast("array<string>")
    named = F.when(generic_versions(q, ascii_words), F.array().cast("array<string>")).otherwise(F.filter(tags, lambda t: (t != "") & F.contains(F.lower(q), F.lower(t))))
    d = questions.withColumns({"intent": found, "entity": entity(q, ascii_words), "__tags": named})
    both = (F.col("intent") == "comparative") & (F.size("__tags") >= 2)
    filters = F.struct(status(q).alias("status"), F.when(~both, F.get("__tags", F.lit(0))).alias("version_tag"), F.when(both, F.slice("__tags", 1, 2)).alias("version_tags"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_until"))
    return d.withColumn("filters", filters.cast(FILTERS)).drop("__tags")

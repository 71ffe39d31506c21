"""Context, prompts, providers, parsing of a model's output, and citations."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.functions.text import collapse_ws, first_filled, scale01, strip_ws

CITATIONS = 15
RAW = T.StructType([
    T.StructField("answer", T.StringType()), T.StructField("no_answer_found", T.BooleanType()),
    T.StructField("citations", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("chunk_id", "text_span", "support_level", "claim")]))),
    T.StructField("confidence", T.DoubleType()), T.StructField("sufficiency_score", T.DoubleType()),
])
#: name -> function of an iterator of frames (query_id, prompt) to frames (query_id, output); see register().
PROVIDERS: dict[str, Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]] = {}


def register(name: str, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> None:
    PROVIDERS[name] = run


def retrying(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], attempts: int = 2, pause: float = 5.0) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A provider that tries a frame again after a failure; what still fails is a row of empty output, which parses as no answer."""

    def safe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for left in range(attempts, 0, -1):
                try:
                    done = list(run(iter([f])))
                    break
                except Exception:
                    if left == 1:
                        done = [pd.DataFrame({"query_id": f["query_id"], "output": [""] * len(f)})]
                    else:
                        time.sleep(pause)
            yield from done

    return safe


def _best_line(prompt: str) -> tuple[str, str]:
    """Chunk id and line of the context that shares most words with the question, the first among equals."""
    words = lambda x: set(filter(lambda w: len(w) > 2, re.split(r"\W+", x.lower())))
    asked, _, rest = prompt.partition("\n\n")
    want, best = words(asked.removeprefix("Question: ")), ("", "", 0)
    for part in rest.split("### [")[1:]:
        chunk_id, _, body = part.partition("]")
        for line in body.split("\n")[1:]:
            text = line.strip()
            if text and not text.startswith(("**", ">", "---", "#", "```")) and (n := len(want & words(text))) > best[2]:
                best = (chunk_id, text, n)
    return best[:2]


def _extractive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for a model: the line that fits the question best, cited."""
    for f in frames:
        out = []
        for prompt in f["prompt"]:
            chunk_id, span = _best_line(prompt or "")
            cited = [{"chunk_id": chunk_id, "text_span": span, "support_level": "direct", "claim": span}] if span else []
            out.append(json.dumps({"answer": span, "no_answer_found": not span, "citations": cited, "confidence": 0.8 if span else 0.0, "sufficiency_score": 0.8 if span else 0.0}))
        yield pd.DataFrame({"query_id": f["query_id"], "output": out})


register("extractive", _extractive)


def block(chunk_id: Column, section: Column, path: Column, text: Column, status: Column, version: Column, valid_from: Column, valid_until: Column, parent_title: Column, parent_text: Column) -> Column:
    """One chunk as labelled text: heading, path, parent, state, the text itself, a rule."""
    has = lambda x: F.coalesce(x.cast("string"), F.lit("")) != ""
    label = lambda name, x: F.when(has(x), F.concat(F.lit(f"**{name}:** "), x.cast("string")))
    above = F.when(parent_title.isNotNull() | parent_text.isNotNull(), F.concat_ws("\n", F.concat(F.lit("\n**Parent Context:** "), F.coalesce(parent_title, F.lit("Parent Section"))), F.when(has(parent_text), F.concat(F.lit("> "), F.left(parent_text, F.lit(200)), F.lit("...")))))
    return F.concat_ws("\n", F.concat(F.lit("### ["), chunk_id, F.lit("] "), F.when(has(section), section).otherwise("Section")), label("Path", path), above, label("Status", status), label("Version", version), label("Valid from", valid_from), label("Valid until", valid_until), F.concat(F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n")), F.lit("---\n"))


def contexts(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """chunks (query_id, rank, chunk_id, ... parent_chunk_id) -> (query_id, context), parents looked up by one join."""
    p = points.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("section_title").alias("__title"), F.col("text").alias("__text"))
    c = chunks.join(p, "parent_chunk_id", "left")
    own = block(*[F.col(x) for x in ("chunk_id", "section_title", "hierarchy_path", "text", "status", "version_tag", "valid_from", "valid_until", "__title", "__text")])
    return c.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", own.alias("b")))), lambda s: s["b"]), "\n").alias("context"))


def user_message(question: Column, context: Column, diff: Column) -> Column:
    """The question, then the context or a line that there is none, then the version changes."""
    return F.concat_ws("\n\n", F.concat(F.lit("Question: "), question), F.when(F.coalesce(context, F.lit("")) == "", "No context was found.").otherwise(F.concat(F.lit("Context:\n"), context)), F.when(F.coalesce(diff, F.lit("")) != "", F.concat(F.lit("Version changes:\n"), diff)))


def valid(raw: Column) -> Column:
    """All required fields there, scores in range after scaling, at most fifteen citations."""
    inside = lambda x: scale01(x).between(0, 1)
    return F.coalesce(raw["answer"].isNotNull() & raw["confidence"].isNotNull() & raw["sufficiency_score"].isNotNull() & inside(raw["confidence"]) & inside(raw["sufficiency_score"]) & (F.coalesce(F.size(raw["citations"]), F.lit(0)) <= CITATIONS), F.lit(False))


def parse(output: Column) -> Column:
    """A struct of RAW and `parsed`: from JSON, from JSON in a fence, else an empty answer of score 0."""
    raw = F.from_json(output, RAW)
    fenced = F.from_json(F.regexp_extract(output, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), RAW)
    got = F.when(valid(raw), raw).when(valid(fenced), fenced)
    none = F.array().cast(RAW["citations"].dataType)
    return F.struct(
        F.coalesce(got["answer"], F.lit("")).alias("answer"), F.coalesce(got["no_answer_found"], F.lit(False)).alias("no_answer_found"), F.coalesce(got["citations"], none).alias("citations"),
        F.coalesce(scale01(got["confidence"]), F.lit(0.0)).alias("confidence"), F.coalesce(scale01(got["sufficiency_score"]), F.lit(0.0)).alias("sufficiency_score"), got.isNotNull().alias("parsed"),
    )


def violates(g: Column) -> Column:
    """Neither an admitted lack of an answer nor an answer with citations."""
    return ~g["no_answer_found"] & ((strip_ws(g["answer"]) == "") | (F.size(g["citations"]) == 0))


def synthesised(citations: Column) -> Column:
    claims = F.array_distinct(F.filter(F.transform(citations, lambda c: strip_ws(F.coalesce(c["claim"], F.lit("")))), lambda x: x != ""))
    return F.concat(F.lit("From the cited passages: "), F.array_join(claims, " "))


def generate(prompts: DataFrame, provider: str = "extractive") -> DataFrame:
    """prompts (query_id, prompt) -> (query_id, generation): parsed, asked once more where the contract is broken, then degraded.

    A second breach caps the confidence at 0.3, and an empty answer with citations is put together from their claims.
    """
    run = PROVIDERS[provider]
    ask = lambda df: df.select("query_id", "prompt").mapInPandas(run, df.select("query_id").schema.simpleString()[7:-1] + ", output string").select("query_id", parse(F.col("output")).alias("g"))
    first = ask(prompts)
    again = ask(prompts.join(first.where(violates(F.col("g"))).select("query_id"), "query_id", "left_semi")).withColumnRenamed("g", "g2")
    both = first.join(again, "query_id", "left").withColumn("g", F.when(violates(F.col("g")) & F.col("g2").isNotNull(), F.col("g2")).otherwise(F.col("g")))
    bad = violates(F.col("g"))
    g = F.col("g")
    fixed = g.withField("confidence", F.when(bad, F.least(g["confidence"], F.lit(0.3))).otherwise(g["confidence"])).withField("answer", F.when(bad & (strip_ws(g["answer"]) == "") & (F.size(g["citations"]) > 0), synthesised(g["citations"])).otherwise(g["answer"]))
    return both.select("query_id", fixed.alias("generation"))


def cite(raw: DataFrame, points: DataFrame) -> DataFrame:
    """raw (query_id, citations: array) -> a row for each citation of a known chunk, with id, span and place.

    A span that isn't in the chunk (white space aside) becomes the whole chunk; ids cit_001 and on count the rows that are kept.
    """
    each = raw.select("query_id", F.posexplode("citations").alias("pos", "c")).select("query_id", "pos", "c.*")
    p = points.select("chunk_id", "text", "source_path", "section_title", "page_num", "line_num")
    joined = each.join(p, "chunk_id")
    grounded = F.contains(collapse_ws(F.col("text")), collapse_ws(F.coalesce("text_span", F.lit("")))) & (collapse_ws(F.coalesce("text_span", F.lit(""))) != "")
    w = Window.partitionBy("query_id").orderBy("pos")
    return joined.select("query_id", "pos", F.format_string("cit_%03d", F.row_number().over(w)).alias("citation_id"), "chunk_id", F.when(grounded, F.col("text_span")).otherwise(F.col("text")).alias("text_span"), "support_level", "claim", F.col("source_path").alias("document"), F.col("section_title").alias("section"), F.col("page_num").alias("page"), F.col("line_num").alias("line"))


def claim_or_answer(claim: Column, answer: Column) -> Column:
    return first_filled(claim, answer)

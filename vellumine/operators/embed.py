"""Embeddings as columns: a slot for a model, and a deterministic stand-in inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.text import terms
from vellumine.functions.vectors import unit


def hashed(text: Column, dims: int = 64) -> Column:
    """array<double> of length 1: each term adds 1 or -1 at a place, both by its hash. A text without terms is all zeros."""
    codes = F.transform(terms(F.lower(text)), lambda t: F.xxhash64(t))
    zero = F.array_repeat(F.lit(0.0), dims)
    places = F.transform(codes, lambda h: F.struct(F.pmod(h, F.lit(dims)).cast("int").alias("at"), F.when(F.shiftrightunsigned(h, 63) == 0, 1.0).otherwise(-1.0).alias("w")))
    total = F.transform(zero, lambda _, i: F.aggregate(F.filter(places, lambda p: p["at"] == i), F.lit(0.0), lambda a, p: a + p["w"]))
    return unit(total)


def sparse_weights(text: Column) -> Column:
    """map<term, weight> of 1 + ln(count), the stand-in for learnt sparse weights."""
    t = terms(F.lower(text))
    return F.map_from_arrays(F.array_distinct(t), F.transform(F.array_distinct(t), lambda x: 1.0 + F.log(F.size(F.filter(t, lambda y: y == x)).cast("double"))))


def model(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32):
    """A column function text -> array<float> of a model that a worker loads once and calls on batches; null texts give null."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load()
        for texts in parts:
            out: list = []
            for s in range(0, len(texts), batch):
                own = texts[s : s + batch]
                known = own[own.notna()]
                vectors = iter(run(known.tolist()) if len(known) else [])
                out += [None if t is None or t != t else list(next(vectors)) for t in own]
            yield pd.Series(out)

    return embed


def with_vectors(rows: DataFrame, text_col: str = "text", by=None) -> DataFrame:
    """rows with `vector`, by a model's column function or else hashed()."""
    return rows.withColumn("vector", (by or hashed)(F.col(text_col)))

"""Bounded samples of labelled rows, on which classifiers are fitted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates(df: DataFrame, rows: int, by: Column) -> dict:
    """Of each value of `by` the share of its rows that a sample of about `rows` takes: 1 where there are no more."""
    return {r.b: min(1.0, rows / r["count"]) for r in df.groupBy(by.alias("b")).count().collect()}


def prior_shift(shares: dict) -> float:
    """What to add to the log odds of label 1 of a model fitted on such a sample, so that they are those of all labelled rows."""
    return math.log(shares.get(0, 1.0) / shares.get(1, 1.0))


def thin(df: DataFrame, id_col: str, rows: int, by: Column | None = None, shares: dict | None = None) -> DataFrame:
    """About `rows` rows of df (of each value of `by`), picked by a hash of the id; all rows where there are no more.

    Each row is taken or left by itself, so nothing is sorted or gathered; the number taken varies by a few square roots.
    """
    by = F.lit(0) if by is None else by
    share = F.lit(0.0)
    for value, part in (rates(df, rows, by) if shares is None else shares).items():
        share = F.when(by.eqNullSafe(F.lit(value)), F.lit(part)).otherwise(share)
    return df.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 24)) < share * float(1 << 24))


def labels_of(labels: DataFrame, id_col: str, label_col: str, keep: Column) -> DataFrame:
    """(id, label 0/1), a row for each labelled id for which `keep` holds; an id with both labels has the greater."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & keep)
    return known.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__label"))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, rows: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[bytes, int]], float]:
    """[(text, label)] in order of id: about `rows` documents of each label, of at most `most_bytes` bytes each; and their prior_shift."""
    known = labels_of(labels, id_col, label_col, keep)
    shares = rates(known, rows, F.col("__label"))
    picked = F.broadcast(thin(known, "__id", rows, F.col("__label"), shares))  # twice `rows` and a few
    own = docs.select(F.col(id_col).alias("__did"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))
    found = own.join(picked, F.col("__did") == F.col("__id")).where(F.octet_length("__text") <= most_bytes)
    got = found.select("__id", "__text", "__label").collect()
    return [(bytes(r["__text"]), r["__label"]) for r in sorted(got, key=lambda r: (r["__id"], bytes(r["__text"])))], prior_shift(shares)

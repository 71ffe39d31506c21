"""Sparse search in the tasks that read the texts: against the join of postings, with repeated ids, and without a shuffle of postings."""

import re

import numpy as np
from pyspark.sql import functions as F

from vellumine import catalog
from vellumine.operators import lexical


def plan(df):
    return df._jdf.queryExecution().toString()


def test_postings_are_not_shuffled(spark):
    for name in ("sparse_topk", "rrf_fuse", "hybrid_retrieve"):
        assert not re.search(r"hashpartitioning\([^)]*term#", plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")))


def test_tasks_score_as_the_join_does(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i % 350), [f"t{x}" for x in rng.zipf(1.5, 12) % 40]) for i in range(500)] + [(900, None), (901, []), (None, ["t1", "t1"]), (None, ["t2"]), (902, ["t1", None])]
    d = spark.createDataFrame(rows, "chunk_id long, terms array<string>").repartition(5)
    q = spark.createDataFrame([(f"q{i}", f"t{t}") for i in range(20) for t in sorted(set(rng.integers(0, 45, 6)))] + [("q99", "nowhere"), ("q98", None)], "query_id string, term string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id or 0, round(r.score, 9)) for r in df.collect())
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    joined = rows(lexical.search(q, d, 505, 15, 6))
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 1000)
    assert rows(lexical.search(q, d, 505, 15, 6)) == joined and len(joined) > 200
    assert rows(lexical.search(q.where("query_id = 'x'"), d, 505, 15, 6)) == []

"""Dense search: more questions than a block holds, and plans' filters before the top-k."""

import numpy as np
from pyspark.sql import functions as F

from vellumine.operators import search
from vellumine.plans import answer


def points(spark, n=300):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(n)], "chunk_id long, vector array<double>")


def test_more_questions_than_a_block(spark, monkeypatch):
    p = answer.settle(points(spark))
    q = p.where("chunk_id < 50").select(F.col("chunk_id").alias("query_id"), "vector")
    rows = lambda: sorted((r.query_id, r["rank"], r.chunk_id) for r in search.dense(q, p, 3).collect())
    whole = rows()
    monkeypatch.setattr(search, "QUERY_ROWS", 20)
    assert len(search._blocks(q)) > 1 and rows() == whole and len(whole) == 150


def test_filters_hold_before_the_dense_top_k(spark):
    rare = (F.col("chunk_id") >= 298).cast("int")
    p = points(spark).select(F.col("chunk_id").cast("string").alias("chunk_id"), F.when(rare == 1, F.array(*map(F.lit, [-1.0, 0.1, 0.0, 0.0]))).otherwise(F.array(*map(F.lit, [1.0, 0.0, 0.0, 0.0]))).alias("vector"), F.when(rare == 1, "v1").otherwise("v2").alias("version_tag"))
    for c, kind in {"text": "string", "source_id": "string", "source_path": "string", "hierarchy_path": "string", "parent_path": "string", "parent_chunk_id": "string", "section_title": "string", "version_order": "int", "status": "string", "valid_until": "date", "valid_from": "date", "line_num": "int", "page_num": "int", "ingest_seq": "int"}.items():
        p = p.withColumn(c, F.concat(F.lit("x"), "chunk_id") if kind == "string" else F.lit(None).cast(kind))
    q = spark.createDataFrame([(1, "What is new in v1", [1.0, 0.0, 0.0, 0.0])], "query_id long, question string, vector array<double>")
    got = {r.chunk_id for r in answer.retrieve(q, answer.settle(p), None, ["v1", "v2"], strategy="dense").collect()}
    assert {"298", "299"} <= got  # beyond the 150 nearest of all points


def test_comparisons_get_the_other_version_and_what_changes_speak_of(spark):
    kinds = {"source_path": "string", "parent_path": "string", "parent_chunk_id": "string", "section_title": "string", "status": "string", "valid_until": "date", "valid_from": "date", "line_num": "int", "page_num": "int", "ingest_seq": "int"}
    rows = [(f"{name}@v{v}", f"text of {name} {v}", "s", f"doc > {name}", f"{v}.5-x", v, ([1.0, 0.0] if v == 1 else [0.5, 1.0]) if name == "near" else [0.0, 1.0]) for name in ("near", "far", "other") for v in (1, 2)]
    rows += [(f"filler{i}", "x", "s", f"doc > f{i}", "2.5-x", 2, [1.0, 0.001 * i + 0.001]) for i in range(20)]
    p = spark.createDataFrame(rows, "chunk_id string, text string, source_id string, hierarchy_path string, version_tag string, version_order int, vector array<double>")
    for c, kind in kinds.items():
        p = p.withColumn(c, F.lit(None).cast(kind))
    p = answer.settle(p)
    q = spark.createDataFrame([(1, "What is the difference between 1.5-x and 2.5-x", [1.0, 0.0])], "query_id long, question string, vector array<double>")
    changes = spark.createDataFrame([("c1", "s", "1.5-x", "2.5-x", "doc > far", [1.0, 0.0]), ("c2", "s", "1.5-x", "9", "doc > other", [1.0, 0.0])], "chunk_id string, source_id string, version_from string, version_to string, hierarchy_path string, vector array<double>")
    got = [r.chunk_id for r in answer.retrieve(q, p, None, ["1.5-x", "2.5-x"], top=100, strategy="dense", change_points=answer.settle(changes)).collect()]
    assert len(got) == len(set(got)) and {"near@v1", "near@v2", "far@v1", "far@v2"} <= set(got) and not {"other@v1", "other@v2"} & set(got)


def test_a_key_that_moves_leaves_nothing_behind(spark, tmp_path):
    from vellumine.sources import sinks

    path, make = str(tmp_path / "t"), lambda rows: spark.createDataFrame(rows, "k string, v string, n long, part string")
    sinks.upsert(make([("a", "1", 1, "p"), ("b", "1", 1, "p"), ("c", "1", 1, "q"), ("d", "1", 1, "r")]), path, "k", "n", ["part"])
    sinks.upsert(make([("a", "2", 2, "q"), ("d", "2", 2, "s")]), path, "k", "n", ["part"])
    assert sorted((r.k, r.v, r.part) for r in spark.read.parquet(path).collect()) == [("a", "2", "q"), ("b", "1", "p"), ("c", "1", "q"), ("d", "2", "s")]
    assert [x.name for x in tmp_path.iterdir()] == ["t"]

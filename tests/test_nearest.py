"""The search by products of matrices: near ties beyond any margin of rows, several slots, vectors that aren't regular."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from vellumine import catalog
from vellumine.operators import nearest, search


def test_more_ties_by_rounding_than_twice_k(spark, tmp_path):
    # 80 points at the same rounded score from the question, and the lower the id the farther
    n = 80
    v = [[1.0, 0.0]] + [[1.0, 1e-4 - i * 1e-7] for i in range(n)]
    path = f"{tmp_path}/embeddings.parquet"
    pq.write_table(pa.table({"vec_id": list(range(n + 1)), "embedding": pa.array(v, pa.list_(pa.float32())), "label": pa.array([1] * (n + 1), pa.int32())}), path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    rows = lambda got: sorted((r[0], r[3], r[1]) for r in got)
    for name in ("dense_topk_cosine", "dense_topk_filtered"):
        assert rows(catalog.QUERIES[name](spark, str(tmp_path)).select("query_id", "chunk_id", "score", "rank").collect()) == rows(con.sql(catalog.ORACLE[name]).fetchall())


def test_slots_of_points_and_copies(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 7))
    v[100:300] = v[100]
    v[7] = 0
    p = spark.createDataFrame([(f"c{i}", v[i].tolist()) for i in range(400)], "chunk_id string, vector array<double>")
    q = p.select(F.col("chunk_id").alias("query_id"), "vector").where("query_id < 'c2'")
    monkeypatch.setattr(nearest, "POINT_ROWS", 60)
    whole = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in search.dense(q, p, 9).collect()}
    joined = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in search.dense(q, p, 9, allowed=F.lit(True)).collect()}
    assert whole == joined and len(whole) == 9 * q.count()


def test_vectors_that_are_not_regular(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0, 1.0, 1.0]), (5, [0.6, 0.8])], "chunk_id long, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>")
    assert not nearest.regular(p) and not nearest.regular(p.where("chunk_id in (1, 4)")) and nearest.regular(p.where("chunk_id in (1, 5)"), q)
    assert [(r.chunk_id, r.score) for r in search.dense(q, p, 3).orderBy("rank").collect()][:2] == [(1, 1.0), (5, 0.6)]

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_natives import brute_lines, grams
from test_simhash import jaccard_groups
from vellumine.llm import decontaminate, pieces
from vellumine.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in cp.STAGES:
        out.append(table(stage(spark, out[-1], SF), "step"))
    return out


def test_columns_and_ids(steps):
    for df in steps[:-1]:
        assert df.columns == steps[0].columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in steps]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[2] == ids[1] and ids[5] == ids[4] and ids[4]


def test_each_stage_takes_effect(spark, steps):
    assert steps[1].count() < steps[0].count()
    assert steps[2].agg(F.sum(F.length("text"))).first()[0] < steps[1].agg(F.sum(F.length("text"))).first()[0]
    assert steps[3].count() < steps[2].count()
    assert decontaminate.leaks(steps[4], spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    back = pieces.decode(steps[5].select("doc_id", F.explode("samples.pieces").alias("pieces"))).join(steps[4].select("doc_id", "text"), "doc_id")
    assert back.count() == steps[5].agg(F.sum(F.size('samples'))).first()[0] and back.where("decoded <> text").count() == 0
    assert steps[5].where("size(samples) < 1").count() == 0


def test_stages_against_brute_force(spark, steps):
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    assert rows(steps[2]) == brute_lines(sorted(rows(steps[1]).items()))
    group = jaccard_groups(sorted(rows(steps[2]).items()))
    assert set(rows(steps[3])) == set(group.values())
    items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i: grams(t) for i, t in rows(steps[3]).items()}
    assert set(rows(steps[4])) == {i for i, h in held.items() if not any(len(g & h) >= 0.8 * len(g) for g in items)}
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_null_ids_and_repeated_rows_pass_through(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    more = df.limit(3).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.concat(F.lit("quite another text of its own "), F.reverse("text"))}).unionByName(df.limit(1)).unionByName(df.limit(1).withColumns({"doc_id": F.lit(10**9), "text": F.lit(None).cast("string")}))
    docs = df.unionByName(more)
    for _, stage in cp.STAGES:
        docs = table(stage(spark, docs, SF), "odd")
    got = [r.doc_id for r in docs.collect()]
    assert got.count(None) == 3 and len(got) > 100  # the null text goes as a copy where an empty one of lesser id stays


def test_run_is_the_stages(spark, steps):
    same = lambda df: sorted((r.doc_id, [list(s.pieces) for s in r.samples]) for r in df.collect())
    assert same(cp.run(spark, SF)) == same(steps[-1])


def test_workers_give_back_memory_when_a_task_is_done():
    import pathlib
    import re

    import pyarrow as pa

    from vellumine.llm.common import lean

    if not pathlib.Path("/proc/self/smaps_rollup").exists():
        pytest.skip("memory can't be read here")
    held = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", pathlib.Path("/proc/self/smaps_rollup").read_text()))) >> 10

    def run(batches):
        for b in batches:
            own = [bytes(600) for _ in range(200_000)]  # over what Python's own arenas take: from the C library's heap
            yield pa.array(own)
        own = own[::1000]

    before = held()
    assert sum(len(x) for x in lean(run)(iter(range(3)))) == 600_000
    assert held() < before + 60


def test_pieces_keep_no_words_after_a_task(spark):
    from vellumine.llm import pieces

    model = pieces.Pieces(pieces._model(pieces.MODEL))
    first = model.sample(["some words of a text"], 2, [1])
    model.forget()
    again = model.sample(["some words of a text"], 2, [1])
    assert all((a[0] == b[0]).all() and a[1:] == b[1:] for a, b in zip(first[0], again[0]))
    model.forget()
    assert not model.stores and not model.lattices

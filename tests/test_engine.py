import datetime
import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from vellumine import settings
from vellumine.functions import text as T
from vellumine.functions.vectors import cosine, unit
from vellumine.operators import diff, embed, expand, filters, fusion, generate, metrics, reliability, rerank, search, tree
from vellumine.plans import answer, ingest, planner
from vellumine.sources import files, sinks
from vellumine.streaming import ingest as stream

API = {"paths": {f"/v1/{x}": {"get": {"summary": f"List all {x} of an account", "note": "text " * 60}} for x in ("orders", "refunds", "cards")}, "widgets": [{"name": "alpha", "size": 1}, {"name": "beta", "size": 2}]}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "api").mkdir()
    (root / "Guides & more").mkdir()
    (root / "other" / "api").mkdir(parents=True)
    (root / "api" / "spec_v1.json").write_text(json.dumps(API))
    newer = json.loads(json.dumps(API))
    newer["paths"]["/v1/orders"]["get"]["summary"] = "List every order"
    del newer["paths"]["/v1/cards"]
    newer["widgets"].append({"name": "gamma", "size": 3})
    (root / "api" / "spec_v2.json").write_text(json.dumps(newer))
    (root / "api" / "broken.json").write_text("{")
    (root / "Guides & more" / "start.md").write_text("# Start\n\nUse a token to sign requests.\n\n## Limits\n\n- ten a second\n- burst of twenty\n")
    (root / "other" / "api" / "x.yaml").write_text("name: thing\nvalue: 3\n")
    (root / "api" / "notes.xyz").write_text("?")
    return str(root)


@pytest.fixture(scope="module")
def done(spark, corpus):
    o = spark.createDataFrame([("api", r"_(?P<version>v\d+)\.json", ["v1", "v2"])], "source_id string, version_pattern string, version_order array<string>")
    out = ingest.ingest(spark, corpus, o)
    return out | {"nodes": out["nodes"].cache(), "chunks": out["chunks"].cache()}


def test_sources_errors_and_report(done):
    assert sorted(r.source_id for r in done["sources"].collect()) == ["api", "guides___more", "other_api"]
    assert [r.file for r in done["errors"].collect()] == ["broken.json"] and [r.file for r in done["skipped"].collect()] == ["notes.xyz"]
    rep = {r.source_id: r for r in done["report"].collect()}
    assert (rep["api"].documents, rep["api"].errors, rep[None].documents) == (2, 1, 4) and rep[None].chunks == done["chunks"].count()


def test_unknown_source_raises(spark, corpus):
    with pytest.raises(ValueError):
        ingest.ingest(spark, corpus, source_id="nope")
    one = ingest.ingest(spark, corpus, source_id="api", file_contains="v1")
    assert one["nodes"].select("source_path").distinct().count() == 1


def test_trees(spark, done):
    n = done["nodes"]
    assert tree.integrity_errors(n).count() == 0
    md = n.where("source_path like '%start.md'")
    paths = {r.text: r.hierarchy_path for r in tree.hierarchy_paths(md).join(md, ["tree_id", "node_id"]).collect()}
    assert paths["ten a second"] == "document > Start > Limits" and paths["Use a token to sign requests."] == "document > Start"
    again = tree.with_ancestors(md.drop("ancestor_ids", "depth"))
    assert {r.node_id: list(r.ancestor_ids) for r in again.collect()} == {r.node_id: list(r.ancestor_ids) for r in md.collect()}
    leaf = {r.text for r in tree.leaves(md).collect()}
    assert leaf == {"Use a token to sign requests.", "ten a second", "burst of twenty"}
    assert tree.siblings(md.where("type = 'list_item'")).count() == 2
    root = md.where("parent_id is null").first().node_id
    assert tree.descendants(md, root).count() == md.count() - 1
    kids = {r.node_id: len(r.children_ids) for r in tree.children(md).collect()}
    assert kids[root] == 1 and tree.parents(md).where("parent.node_id is null").count() == 1
    assert tree.structural_ancestors(md.where("type='list_item'")).count() == 0 and tree.structural_ancestors(md).count() > 0
    broken = spark.createDataFrame([("t", "a", "zz"), ("t", "b", "b"), ("t", "b", "b")], "tree_id string, node_id string, parent_id string")
    assert sorted(r.error for r in tree.integrity_errors(broken).collect()) == ["id repeated", "its own parent", "its own parent", "no root", "parent missing"]


def test_chunks_follow_the_worked_traces(done):
    c = {(r.source_path.rsplit("/", 1)[-1], r.hierarchy_path, r.level): r for r in done["chunks"].collect() if r.type != "list_item"}
    w = c["spec_v1.json", "document > widgets > widgets > widgets[0]", 0]
    assert w.contextual_prefix == "document > widgets > widgets" and w.parent_path == "document > widgets > widgets > widgets" and w.version_tag == "v1" and w.version_order == 0 and w.status == "active"
    assert w.content_hash == hashlib.sha256((w.text + "\0v1").encode()).hexdigest() and w.text == w.contextual_prefix + "\n\n" + w.raw_text
    p = c["start.md", "document > Start", 0]
    assert p.section_title == "Start" and p.contextual_prefix == "document > Start"
    s = c["spec_v1.json", "document > widgets", 1]
    assert s.text == "## widgets" and s.child_chunk_ids
    up = {r.chunk_id: r for r in c.values()}
    assert w.parent_chunk_id in up and w.chunk_id in up[w.parent_chunk_id].child_chunk_ids


def test_diff_of_two_versions(spark, done):
    can = diff.canonical(done["nodes"].where("source_id = 'api'")).join(done["nodes"].select("tree_id", "source_id", "version_tag").distinct(), "tree_id")
    sources = done["sources"].where("source_id = 'api'")
    pairs = diff.version_pairs(sources, can)
    changes = diff.diff_all(can, pairs).cache()
    got = {(r.key, r.change_type) for r in changes.collect()}
    assert ("document > widgets > widgets > widgets[2]|document#2", "added") in got and any("/v1/cards" in k and t == "removed" for k, t in got) and any("/v1/orders" in k and t == "modified" for k, t in got)
    n = diff.counts(changes, ["source_id"]).first()
    assert n.added == 1 and n.modified >= 1 and n.removed >= 1
    said = diff.summarise(changes, ["source_id"]).first().summary
    assert said.startswith("Changes between v1 and v2:\n- ") and "added in v2" in said
    assert diff.diverse_top(changes, 5).count() >= 1 and diff.describe(changes).where("description like '%Element: %'").count() == changes.count()
    assert diff.missing_versions(sources, can.where("version_tag = 'v1'")).collect()[0].version_tag == "v2"
    score = {r.key: r.s for r in changes.withColumn("s", diff.index_score(F.col("change_type"), F.col("field_changes"))).collect()}
    assert min(score.values()) >= 2


def test_points_upsert_is_idempotent(spark, done, tmp_path):
    path, rows = str(tmp_path / "points"), sinks.points(done["chunks"].withColumn("ingest_seq", F.lit(1).cast("long"))).select("point_id", "text", "source_id", "ingest_seq")
    for _ in range(2):
        sinks.upsert(rows, path, "point_id", "ingest_seq", ["source_id"])
    assert spark.read.parquet(path).count() == rows.count() < done["chunks"].count()
    sinks.upsert(rows.where("source_id = 'api'").withColumns({"text": F.lit("new"), "ingest_seq": F.lit(2).cast("long")}), path, "point_id", "ingest_seq", ["source_id"])
    back = spark.read.parquet(path)
    assert back.count() == rows.count() and back.where("source_id = 'api' and text <> 'new'").count() == 0 and back.where("source_id <> 'api' and text = 'new'").count() == 0


def test_change_points_and_diff_tables(spark, tmp_path):
    ch = spark.createDataFrame([("s", "1", "2", "k", "added"), ("s", "2", "3", "k", "removed")], "source_id string, version_from string, version_to string, key string, change_type string")
    assert sinks.change_points(ch).first().point_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "s|1|2|k"))
    sinks.write_diffs(ch, str(tmp_path / "d"))
    assert [r.change_type for r in sinks.load_diff(spark, str(tmp_path / "d"), "s", "2", "3").collect()] == ["removed"]


def test_answers_are_kept_and_found(spark):
    q = spark.createDataFrame([("What  is X?", 10), ("other", 10)], "question string, top_k int")
    kept = q.limit(1).select(sinks.question_key(F.lit("what is x?"), F.lit(10)).alias("question_key")).withColumn("answered_at", F.current_timestamp())
    assert [r.question for r in sinks.unanswered(q, kept).collect()] == ["other"]
    old = kept.withColumn("answered_at", F.lit(datetime.datetime(2020, 1, 1)))
    assert sinks.unanswered(q, old, 60).count() == 2


def test_question_to_answer(spark, done):
    points = answer.settle(done["chunks"].withColumn("ingest_seq", F.lit(1)))
    index = answer.settle(search.postings(points, T.terms(F.lower("text"))))
    q = spark.createDataFrame([(1, "How do I sign requests with a token?"), (2, "What is the difference between v1 and v2 orders?"), (3, "zebra xylophone quantum"), (4, "GET /v1/refunds of an account")], "query_id long, question string")
    r = answer.retrieve(q, points, index, ["v1", "v2"])
    best = {x.query_id: x for x in r.where("rank = 1").collect()}
    assert best[1].source_path.endswith("start.md") and best[4].intent == "factual" and best[4].entity == "/v1/refunds"
    can = diff.canonical(done["nodes"].where("source_id = 'api'")).join(done["nodes"].select("tree_id", "source_id", "version_tag").distinct(), "tree_id")
    changes = answer.settle(diff.diff_all(can, diff.version_pairs(done["sources"].where("source_id = 'api'"), can)))
    out = {x.query_id: x for x in answer.answer(q, points, index, ["v1", "v2"], changes, answer.settle(done["sources"])).collect()}
    assert out[1].action != "abstain" and "token" in out[1].answer and out[1].citations[0].citation_id == "cit_001"
    assert out[3].action == "abstain" and not out[3].citations
    assert out[2].conflicts is None or out[2].conflicts[0].type == "temporal"


def test_planner(spark):
    rows = {"GET /v1/orders": ("factual", "/v1/orders"), "compare A and B": ("comparative", None), "what is life": ("ambiguous", None), "différence entre a et b": ("comparative", None), "see /x/y": ("factual", "/x/y"), "between x and y": ("comparative", None), "differs?": ("comparative", None), "Lequel est le meilleur": ("comparative", None)}
    q = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "query_id long, question string")
    got = {r.question: r for r in planner.plan(q, ["1.2", "1.3"]).collect()}
    assert {k: (r.intent, r.entity) for k, r in got.items()} == rows
    v = spark.createDataFrame([(1, "compare 1.3 with 1.2"), (2, "is 1.3 deprecated"), (3, "v1 or v2, 1.2?"), (4, "/v1/x and v2 in 1.2")], "query_id long, question string")
    f = {r.query_id: r.filters for r in planner.plan(v, ["1.2", "1.3"]).collect()}
    assert f[1].version_tags == ["1.2", "1.3"] and f[1].version_tag is None and f[2].version_tag == "1.3" and f[2].status == "deprecated" and f[3].version_tag is None and f[4].version_tag == "1.2"
    judged = planner.plan(q, [], F.lit("factual")).where("question = 'what is life'").first()
    assert judged.intent == "factual"


def test_fusion_numbers(spark):
    lists = [spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(x)], "query_id long, chunk_id string, rank int") for x in ("abc", "bda")]
    got = fusion.rrf(lists).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "d", "c"] and abs(got[0].score - 0.5 * (1 / 62 + 1 / 61)) < 1e-12
    lone = fusion.hybrid(lists[0].withColumn("score", F.lit(0.5)), lists[1].limit(0).withColumn("score", F.lit(0.5)))
    assert [r.score for r in lone.collect()] == [0.5] * 3


def test_gate_numbers(spark):
    g = lambda s, c, v, sc, low=None: spark.range(1).select(reliability.gate(F.array(*map(F.lit, s)) if s else F.array().cast("array<double>"), F.lit(c), F.lit(v), F.lit(sc), low).alias("g")).first().g
    assert (g([], 0.9, "sufficient", 0.9).combined_score, g([], 0.9, "sufficient", 0.9).zone) == (0.66, "ambiguous")
    assert g([0.9, 0.85], 0.9, "sufficient", 0.9).combined_score in (0.922, 0.923) and g([0.9, 0.85], 0.9, "sufficient", 0.9, F.lit(True)).action == "answer"
    assert g([], 0.0, "insufficient", 0.0).action == "abstain"
    with pytest.raises(ValueError):
        reliability.gate(F.array(), F.lit(0.0), F.lit("x"), F.lit(0.0), None, 0.8, 0.2)


def test_votes_and_sufficiency(spark):
    v = spark.createDataFrame([(1, 1, True, "", "a"), (1, 2, True, "factual", ""), (1, 3, False, None, "n"), (2, 1, None, None, None), (3, 1, True, "x", "y"), (3, 2, False, None, "z")], "pair_id long, sample int, conflict boolean, type string, explanation string")
    got = {r.pair_id: r for r in reliability.majority_vote(v).collect()}
    assert (got[1].conflict, got[1].confidence, got[1].type, got[1].explanation) == (True, 0.67, "factual", "a") and 2 not in got and not got[3].conflict
    s = lambda q, t: spark.range(1).select(reliability.sufficiency(F.lit(q), F.lit(t)).alias("s")).first().s
    assert s("Which rate limits apply?", "RATE limits: ten apply").verdict == "sufficient" and s("the of", "x").verdict == "insufficient" and s("alpha beta gamma", "alphabet").verdict == "partial"


def test_generation_parses_degrades_and_cites(spark):
    good = {"answer": "A", "no_answer_found": False, "citations": [{"chunk_id": "c", "text_span": "s", "support_level": "direct", "claim": "m"}], "confidence": 80, "sufficiency_score": 0.5}
    rows = [json.dumps(good), "text ```json\n" + json.dumps(good) + "\n```", "junk", json.dumps(good | {"confidence": -1}), json.dumps(good | {"citations": good["citations"] * 16})]
    got = [r.g for r in spark.createDataFrame([(x,) for x in rows], "o string").select(generate.parse(F.col("o")).alias("g")).collect()]
    assert [g.parsed for g in got] == [True, True, False, False, False] and got[0].confidence == 0.8 and got[2].answer == ""
    generate.register("empty_answer", lambda frames: (f.assign(output=json.dumps(good | {"answer": " ", "confidence": 0.9}))[["query_id", "output"]] for f in frames))
    g = generate.generate(spark.createDataFrame([(1, "p")], "query_id long, prompt string"), "empty_answer").first().generation
    assert g.confidence == 0.3 and g.answer.endswith("m")
    raw = spark.createDataFrame([(1, [("c", "not there", "direct", ""), ("zz", "s", "direct", ""), ("c", "b  c", "direct", "")])], "query_id long, citations array<struct<chunk_id:string,text_span:string,support_level:string,claim:string>>")
    pts = spark.createDataFrame([("c", "a b c", "p", "t", 1, 2)], "chunk_id string, text string, source_path string, section_title string, page_num int, line_num int")
    assert [(r.citation_id, r.text_span) for r in generate.cite(raw, pts).orderBy("pos").collect()] == [("cit_001", "a b c"), ("cit_002", "b  c")]


def test_metrics_numbers(spark):
    r = spark.createDataFrame([(1, i + 1, p) for i, p in enumerate(["x/a.md", "b.md", "./c.md"])] + [(2, 1, "q")], "query_id long, rank int, source_path string")
    e = spark.createDataFrame([(1, ["c.md", "zz.md"]), (2, [])], "query_id long, expected array<string>")
    m = {x.query_id: x for x in metrics.retrieval(r, e, [5]).collect()}
    assert (m[1].recall, round(m[1].precision, 6), round(m[1].mrr, 6), m[2].recall) == (0.5, 0.333333, 0.333333, 1.0) and abs(m[1].ndcg - 0.5) < 1e-9
    assert metrics.aggregate(metrics.retrieval(r, e, [5])).first().recall == 0.75
    assert metrics.legacy_recall(r.where("query_id = 1").withColumns({"rel": F.lit(1), "n_expected": F.lit(2)}), 3).first().legacy_recall == 1.5
    g = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0], False), (1, [1.0, 0.0], [0.0, 0.0], True), (2, [1.0], [1.0], True)], "query_id long, question_vector array<double>, vector array<double>, noncommittal boolean")
    assert {x.query_id: x.answer_relevancy for x in metrics.answer_relevancy(g).collect()} == {1: 0.5, 2: 0.0}
    j = spark.createDataFrame([("insufficient", True, True), ("insufficient", False, False), ("partial", True, True)], "verdict string, should_abstain boolean, accurate boolean")
    assert metrics.sufficiency_precision(j).first()[0] == 0.5 and round(metrics.citation_accuracy(j).first()[0], 3) == 0.667 and metrics.citation_accuracy(j.limit(0)).first()[0] is None


def test_text_functions(spark):
    f = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert f(T.uuid5(F.lit("héllo"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "héllo")) and f(T.uuid5(F.lit("k"), "url")) == str(uuid.uuid5(uuid.NAMESPACE_URL, "k"))
    assert f(T.strip_ws(F.lit("  a b\n"))) == "a b" and f(T.first_filled(F.lit(None).cast("string"), F.lit(""), F.lit("z"))) == "z"
    assert f(T.parent_path(F.lit("a > b[3]"))) == "a > b" and f(T.parent_path(F.lit("a[3] b"))) is None
    assert f(T.clip_text(F.lit("<b>x</b>  y"))) == "x y" and f(T.clip_text(F.lit("w" * 200))) == "w" * 160 + "…"
    assert f(T.path_norm(F.lit(".\\a\\b"))) == "a/b" and f(T.terms(F.lit("Définir l'été_2"))) == ["Définir", "l", "été_2"]
    assert f(cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0 and f(unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]


def test_filters_missing_fields(spark):
    d = spark.createDataFrame([(1, "a", None), (2, None, "change"), (3, "b", "x")], "id long, k string, node_type string")
    ids = lambda c: [r.id for r in d.where(c).orderBy("id").collect()]
    assert ids(filters.build_filter({"must_not": [{"key": "k", "match": {"value": "a"}}]})) == [2, 3]
    assert ids(filters.build_filter({"key": "k", "match": {"any": ["a", "b"]}})) == [1, 3] and ids(filters.build_filter(None)) == [1, 2, 3]
    assert ids(filters.not_change(F.col("node_type"))) == [1, 3] and ids(filters.build_filter({"must": [{"key": "id", "range": {"gte": 2, "lte": 2}}]})) == [2]


def test_rerank_gate(spark):
    c = spark.createDataFrame([(1, "alpha token", f"c{i}", i, 0.0, "token" if i == 3 else "-", "") for i in range(1, 5)], "query_id long, question string, chunk_id string, rank int, score double, text string, hierarchy_path string")
    assert [r.chunk_id for r in rerank.rerank(c, 2).orderBy("rank").collect()] == ["c3", "c1"]
    assert [r.chunk_id for r in rerank.rerank(c, 4).orderBy("rank").collect()] == ["c1", "c2", "c3", "c4"] and rerank.rerank(c, 4).where("rerank_score is not null").count() == 0
    model = rerank.model_score(lambda: lambda q, t: [float(len(x)) for x in t])
    assert rerank.rerank(c, 1, score=model(F.col("question"), F.col("text"))).first().chunk_id == "c3"


def test_change_contents_and_lookup(spark):
    pts = spark.createDataFrame([("p1", "s", "path", "1"), ("p2", "s", "path", "2")], "chunk_id string, source_id string, hierarchy_path string, version_tag string")
    cand = spark.createDataFrame([(1, "p1", 1, "s", "path", "1")], "query_id long, chunk_id string, rank int, source_id string, hierarchy_path string, version_tag string")
    hits = spark.createDataFrame([(1, "path", "s", "1", "2")], "query_id long, hierarchy_path string, source_id string, version_from string, version_to string")
    assert [r.chunk_id for r in expand.change_contents(hits, cand, pts).collect()] == ["p2"]
    assert [r.chunk_id for r in expand.counterparts(cand, pts, F.lit("1"), F.lit("2")).collect()] == ["p2"]
    keys = spark.createDataFrame([("path", None, None)], "path string, source_id string, version_tag string")
    assert search.by_path(keys, pts, "hierarchy_path", 1).count() == 1 and search.by_chunk_id(spark.createDataFrame([("zz",)], "chunk_id string"), pts).first().source_id is None


def test_words_and_cache_and_questions(spark, tmp_path):
    w = spark.createDataFrame([(1, 10.1, 1, "a"), (1, 11.9, 2, "b"), (1, 20.0, 3, "c")], "page int, top double, seq int, text string")
    assert sorted((r.line, r.text) for r in files.words_to_lines(w).collect()) == [(10, "a b"), (20, "c")]
    f = spark.createDataFrame([("p", "m")], "path string, modified string")
    key = f.select(files.cache_key(F.col("path"), F.col("modified"), F.lit("x")).alias("cache_key"))
    assert files.uncached(f, key, "x").count() == 0 and files.uncached(f, key, "y").count() == 1
    (tmp_path / "q.jsonl").write_text('{"question": "a", "expected_sources": ["x"]}\n\n{"question": "b", "expected_sources": []}\n')
    assert files.questions(spark, [str(tmp_path / "no.jsonl"), str(tmp_path / "q.jsonl")]).count() == 1
    with pytest.raises(FileNotFoundError):
        files.questions(spark, [str(tmp_path / "no")])


def test_streams(spark, corpus, tmp_path):
    out, state = str(tmp_path / "t"), str(tmp_path / "c")
    stream.ingest_stream(spark, corpus, out, state).awaitTermination(120)
    n = spark.read.parquet(out).count()
    stream.ingest_stream(spark, corpus, out, state).awaitTermination(120)
    assert n > 0 and spark.read.parquet(out).count() == n
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    live = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = stream.windowed_counts(live).writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("wc").agg(F.sum("n")).first()[0] == e.count()
    q = stream.running_totals(live).writeStream.format("memory").queryName("rt").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert spark.table("rt").groupBy("user_id").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == e.count()


def test_embeddings(spark):
    d = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None)], "id long, text string")
    v = {r.id: r.vector for r in embed.with_vectors(d).collect()}
    assert len(v[1]) == 64 and abs(sum(x * x for x in v[1]) - 1) < 1e-9 and set(v[2]) == {0.0}
    assert d.where("id = 1").select(embed.sparse_weights(F.col("text")).alias("m")).first().m == {"alpha": 1 + __import__("math").log(2), "beta": 1.0}
    m = embed.model(lambda: lambda texts: [[float(len(t))] for t in texts], 1)
    assert {r.id: r.vector for r in embed.with_vectors(d, by=m).collect()} == {1: [16.0], 2: [0.0], 3: None}


def test_providers_are_tried_again(spark):
    calls = []

    def flaky(frames):
        calls.append(1)
        if len(calls) < 2:
            raise RuntimeError("not yet")
        for f in frames:
            yield f.assign(output="ok")[["query_id", "output"]]

    import pandas as pd

    f = pd.DataFrame({"query_id": [1], "prompt": ["p"]})
    assert list(generate.retrying(flaky, 2, 0)(iter([f])))[0].output.tolist() == ["ok"]
    calls.clear()
    assert list(generate.retrying(flaky, 1, 0)(iter([f])))[0].output.tolist() == [""]


def test_settings(monkeypatch):
    monkeypatch.setenv("VELLUMINE_TOP_K", "3")
    monkeypatch.setenv("VELLUMINE_RERANK", "false")
    s = settings.load()
    assert (s.top_k, s.rerank, s.gate_low) == (3, False, 0.25)

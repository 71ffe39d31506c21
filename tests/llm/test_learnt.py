"""Quality, language and toxicity: held-out accuracy, odd rows, independence of layout."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.llm import common, labelled, language, quality, queries, toxicity
from vellumine.llm.common import crc_mod

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (1, None), (None, "a text without an id"), (2, ""), (3, " \n\t"), (4, "12345 !!"), (5, "word " * 60_000), (6, "\0é\U0001f511"), (7, "é")]


@pytest.fixture(scope="module")
def data(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_is_learnt(spark, data):
    out = queries.op1_quality(spark, SF).join(data[1], "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95 and all(0 <= r.score <= 1 for r in out)
    assert min(np.mean([r.predicted == r.quality for r in out if r.quality == q]) for q in (0, 1)) > 0.8


def test_language_is_learnt(spark, data):
    out = queries.op2_language(spark, SF).join(data[0].select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.95 and np.mean([r.accepted for r in out]) > 0.9


def test_toxic_words_are_found(spark, data):
    out = queries.op4_toxicity(spark, SF).join(data[1], "doc_id").collect()
    assert np.mean([r.predicted for r in out if not r.toxic]) < 0.02
    english = {r.doc_id for r in data[0].where("lang = 'en'").select("doc_id").collect()}  # of the other languages six toxic documents or fewer are labelled
    assert np.mean([r.predicted for r in out if r.toxic and r.doc_id in english]) >= 0.9
    plain = {"idiot", "moron", "scum", "trash", "clown"}
    texts = {r.doc_id: set(toxicity.tokens(r.text)) for r in data[0].collect()}
    assert all(r.predicted for r in out if len(texts[r.doc_id] & plain) >= 2)


def odd(spark):
    return spark.createDataFrame([(*r, "x", 1.5) for r in ODD], "doc_id long, text string, lang string, score double")


def test_odd_rows(spark, data):
    d, labels = odd(spark), data[1]
    keep = crc_mod(F.col("doc_id"), 3) != 1
    both = d.select("doc_id", "text", "lang").unionByName(data[0].select("doc_id", "text", "lang").where("doc_id > 100"))
    q = quality.classify(both, labels, "quality", keep)
    t = toxicity.classify(both, labels, "toxic", keep)
    lang = language.identify(both, F.coalesce(F.col("doc_id") > 100, F.lit(False)))
    n = both.count()
    for out in (q, t, lang):
        rows = out.collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    got = {(r.id, r.lang_pred, r.score) for r in lang.where("id <= 6 or id is null").collect()}
    assert {(i, p) for i, p, s in got if s == 0} == {(1, "und"), (2, "und"), (3, "und"), (4, "und")} and any(i is None and p == "en" for i, p, _ in got)
    assert lang.where("id = 7").first().lang_pred != "und" and language.has_letter("é".encode()) and not language.has_letter("€ 5".encode())
    assert not any(language.has_letter(t.encode()) for t in ("½ 5", "Ⅷ", "²", "٣", "_")) and all(language.has_letter(t.encode()) for t in ("ʰ", "中", "ǅ", "5 ß"))


def test_no_labels_one_label_no_rows(spark, data):
    d, labels = odd(spark), data[1]
    none, one = labels.limit(0), labels.where("quality = 1").limit(5)
    assert {r.score for r in quality.classify(d, none, "quality", F.lit(True)).collect()} == {0.5} == {r.score for r in quality.classify(d, one, "quality", F.lit(True)).collect()}
    assert {r.score for r in toxicity.classify(d, none, "toxic", F.lit(True)).collect()} == {0.0}
    empty = d.limit(0)
    assert quality.classify(empty, labels, "quality", F.lit(True)).count() == toxicity.classify(empty, labels, "toxic", F.lit(True)).count() == language.identify(empty, F.lit(True)).count() == 0
    assert {r.lang_pred for r in language.identify(d, F.lit(False)).collect()} == {"und"}


def test_scores_do_not_depend_on_company_or_segments(monkeypatch):
    m, _ = quality.fit([(b"shout!! shout!! " * 30, 0), (b"calm words that go on. " * 30, 1)] * 6)
    texts = [b"", None, b"calm words", b"x" * 511, b"y" * 513, b"shout!! " * 900]
    alone = [quality.score(m, [t])[0] for t in texts]
    assert np.allclose(quality.score(m, texts), alone, atol=1e-5)
    long = b"calm words that go on. " * 300
    whole = quality.score(m, [long])[0]
    monkeypatch.setattr(quality, "SEGMENT", 2048)
    assert abs(quality.score(m, [long])[0] - whole) < 0.02


def naive(m, text):
    """The network's forward pass, window by window."""
    n = max(1, -(-len(text) // quality.HALF))
    e = m.bytes_[list(text.ljust(n * quality.HALF, b"\0"))]
    w, per = quality.BLOCK, quality.HALF // quality.BLOCK
    both = np.concatenate([m.first, m.second])
    halves = np.full((n, quality.FILTERS), -np.inf)
    for i in range(n * per - 1):
        halves[i // per] = np.maximum(halves[i // per], e[i * w : (i + 2) * w].ravel() @ both)
    chunks = [np.maximum(halves[0] + m.bias, 0)] if n == 1 else [np.maximum(np.maximum(halves[k], halves[k + 1]) + m.bias, 0) for k in range(n - 1)]
    return 1 / (1 + np.exp(-(np.mean(chunks, axis=0) @ m.mean_w + np.max(chunks, axis=0) @ m.max_w + m.out[0])))


def test_network_against_a_naive_forward_pass():
    rng = np.random.default_rng(3)
    m, _ = quality.fit([(b"shout!! shout!! " * 30, 0), (b"calm words that go on. " * 30, 1)] * 6)
    texts = [b"", b"a", *(bytes(rng.integers(1, 256, n, np.uint8)) for n in (7, 8, 511, 512, 513, 1024, 1025, 5000)), b"calm words " * 400, b"shout!! " * 70]
    assert np.allclose(quality.score(m, texts), [naive(m, t) for t in texts], atol=1e-5)


def test_long_texts_are_counted_whole(monkeypatch):
    text = "The quick brown fox. ".encode() * 200
    whole = language.counts([text])[0]
    monkeypatch.setattr(language, "BATCH", 1000)
    assert (next(language._batched([text]))[0] == whole).all()


def test_graph_and_walk(spark):
    d = spark.createDataFrame([("a b " * 10,), ("c d " * 10,), (None,), ("",)], "t string")
    edges = toxicity._edges(toxicity._pair_counts(d, {w: i for i, w in enumerate("abcd")}))
    got = {(r.i, r.j): round(r.p, 6) for r in edges.collect()}
    assert got == {(0, 1): 1.0, (1, 0): 1.0, (2, 3): 1.0, (3, 2): 1.0}
    s = toxicity.walk(edges, [np.array([1.0, 0, 0, 0]), np.array([0, 0, 1.0, 0])], steps=3, on=0.5)
    assert abs(s[0].sum() - 1) < 1e-9 and s[0][2] == s[0][3] == 0 and s[1][0] == 0 and s[0][0] > s[0][1] > 0


def test_thin_is_bounded_and_keeps_all_when_few(spark):
    df = spark.range(20_000).withColumn("k", F.col("id") % 10 == 0)
    n = {r.k: r["count"] for r in labelled.thin(df, "id", 1000, F.col("k")).groupBy("k").count().collect()}
    assert all(850 < x < 1150 for x in n.values())
    assert labelled.thin(df.limit(50), "id", 1000).count() == 50


def test_rare_words_with_evidence_are_nodes(spark):
    plain = [(f"calm words of a plain text number{i % 7} here", 0 if i % 2 else None) for i in range(20_000)]
    toxic = [(f"calm words of a plain text zorgle number{i % 7}", 1) for i in range(15)] + [("calm words of a plain grumpf text", 1) for _ in range(300)]
    docs = spark.createDataFrame(plain + toxic, "t string, label int")
    polarity, seeds = toxicity.induce(docs)  # zorgle is in 15 of 20,315 documents, all toxic
    assert polarity["zorgle"] > polarity["calm"] + 0.1 and seeds >= 2


def test_pairs_of_all_counts_are_taken(spark):
    pairs = toxicity._pair_counts(spark.createDataFrame([("a b",), ("c d c",)], "t string"), {w: i for i, w in enumerate("abcd")})
    assert {(r.i, r.j): r.n for r in pairs.collect()} == {(0, 1): 1, (1, 0): 1, (2, 3): 2, (3, 2): 2}


def test_scores_mean_the_same_when_labels_are_sampled(spark):
    docs = spark.createDataFrame([(i, "same words for all of them") for i in range(4000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("quality"))  # the text tells nothing: the chance is 0.1
    whole, few = (quality.classify(docs, labels, "quality", F.lit(True), rows=n).first().score for n in (4000, 300))
    assert abs(whole - 0.1) < 0.06 and abs(few - 0.1) < 0.06
    assert labelled.rates(labels, 200, F.col("quality")) == {0: 200 / 3600, 1: 0.5} and abs(labelled.prior_shift({0: 0.25, 1: 1.0}) + np.log(4)) < 1e-9


def test_words_are_those_of_the_pattern_and_come_faster():
    plain = lambda t: toxicity._WORD.findall(t.lower())
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    texts = [every, "", "a1b_c\x1cd\x85e", "İstanbul ½x² Straße’s naïve", "\ud800lone", *(f"{c}a{c}" for c in every[::97])]
    assert all(toxicity.tokens(t) == plain(t) for t in texts)

    def least(f, text):
        took = []
        for _ in range(15):
            at = time.perf_counter()
            f(text)
            took.append(time.perf_counter() - at)
        return min(took)

    for text in ("Some words, of a plain text; " * 5000, "Größere Wörter — und “andere” Zeichen. " * 5000):
        assert least(toxicity.tokens, text) < 0.85 * least(plain, text)


def test_figures_against_brute_force():
    rng = random.Random(4)
    polarity = toxicity._Index({f"w{chr(97 + i)}": p for i, p in enumerate([0.95, 0.9, 0.8, 0.7, 0.5, 0.4, 0.1, -0.3, -0.4, -0.5, -0.99])})
    for n in (0, 1, 3, 40):
        text = " ".join(f"w{rng.choice('abcdefghijklmn')}" for _ in range(n))
        got = [p for w in toxicity.tokens(text) if (p := polarity[w]) is not None]
        b = [sum(p > 0.9 for p in got), sum(0.7 < p <= 0.9 for p in got), sum(0.4 < p <= 0.7 for p in got)]
        assert toxicity.figures(polarity, text) == [float(b[0] > 0), *np.log1p(b).tolist(), sum(p < -0.4 for p in got) / max(1, len(got)), sum(got) / max(1, len(got))]
    assert toxicity.figures(polarity, None) == [0.0] * 6


def test_tables_of_the_graph_go(spark):
    before = common.written()
    toxicity.induce(spark.createDataFrame([("calm words here", 0)] * 300 + [("grumpf words here", 1)] * 300, "t string, label int"))
    assert common.written() == before

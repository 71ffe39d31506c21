"""Line de-duplication, decontamination and Merkle fingerprints on odd rows, against brute force."""

import hashlib
import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from vellumine.llm import decontaminate, dedup_lines, merkle

SCHEMA = "doc_id long, text string, source string, n_lines int"


def brute_lines(rows):
    at, seen = [], {}
    for i, t in rows:
        ls = [(p, x.replace("\t", " ").replace("\r", " ").strip(" ")) for p, x in enumerate((t or "").split("\n"))] if t is not None else []
        ls = [x for x in ls if x[1]]
        for k in range(len(ls) - 2):
            key = tuple(x[1] for x in ls[k : k + 3])
            at.append(((i, ls[k][0]), key, [x[0] for x in ls[k : k + 3]]))
    for place, key, _ in at:
        seen[key] = min(seen.get(key, place), place)
    gone = {i: set() for i, _ in rows}
    for place, key, ps in at:
        if seen[key] != place:
            gone[place[0]].update(ps)
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in rows}


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(["a", "b", " a ", "", "c\t", "d", "longer line"]) for _ in range(rng.randrange(30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x\ny"), (103, "q\nr\ns"), (104, "q\nr\ns"), (105, "\n".join("klm" * 40)), (106, "\n".join(map(str, range(5000))))]
    df = spark.createDataFrame([(*r, "s", 7) for r in rows], SCHEMA).repartition(3)
    out = {r.doc_id: r for r in dedup_lines.dedup_lines(df).collect()}
    assert {i: r.text for i, r in out.items()} == brute_lines(rows)
    assert out[103].n_removed == 0 and out[104].n_removed == 3 and out[104].text == "" and out[100].n_lines == 0 and out[101].n_lines == 1 and out[106].n_lines == 5000
    assert dedup_lines.dedup_lines(df).columns == ["doc_id", "text", "source", "n_lines", "n_removed"]


def test_lines_of_null_and_repeated_ids(spark):
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc"), (2, "u\nv\nw"), (2, "u\nv\nw")]
    out = sorted((str(r.doc_id), r.text) for r in dedup_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [("1", ""), ("2", ""), ("2", "u\nv\nw"), ("None", "a\nb\nc")]
    assert dedup_lines.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    hash_of = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), seed=42) >> 63)
    rng = random.Random(3)
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc"), (2, "x\ny\nz\nunique"), (2, "x\ny\nz\nunique"), (2, None), (2, ""), (None, "x\ny\nz")]
    rows += [(rng.randrange(5, 9), "\n".join(rng.choice("abcdefgh") for _ in range(rng.randrange(12)))) for _ in range(60)]
    real = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None and hash_of(r[1]) or 42))
    want = brute_lines([(-1, "x\ny\nz")] + [((n), t) for n, (_, t) in enumerate(real)])  # numbered in their order
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, extra int").repartition(4)
    out = dedup_lines.dedup_lines(df).collect()
    assert Counter((r.doc_id, r.text) for r in out if r.doc_id is not None) == Counter((i, want[n]) for n, (i, _) in enumerate(real))
    assert len(out) == len(rows) and sorted(r.extra for r in out) == list(range(len(rows)))
    assert [r.text for r in out if r.doc_id is None] == ["x\ny\nz"]
    kept = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc"), (2, "x\ny\nz unique")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in dedup_lines.dedup_lines(kept).collect()) == [(1, "a\nb\nc"), (2, ""), (2, "x\ny\nz unique")]


def grams(t):
    import regex

    w = regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(1, 60))) for i in range(40)] + [(90, None), (91, "..."), (92, "One two"), (None, "w1 w2 w3 w4 w5"), (93, items0 := text(200)), (94, "Ümlaut straße ok nun fünf")]
    docs = []
    for i in range(150):
        t = rng.choice(items)[1] or ""
        w = t.split()
        for _ in range(rng.randrange(3)):
            if w:
                w[rng.randrange(len(w))] = "edited"
        docs.append((i, text(rng.randrange(300)) + "\n" + ", ".join(w).upper() + "! " + text(rng.randrange(200))))
    docs += [(500, None), (501, ""), (502, "one, TWO."), (503, "zero one two"), (None, items0), (504, items0), (504, "other row of one id"), (505, "x ÜMLAUT-STRASSE ok"), (506, "ümlaut Straße: ok, nun fünf")]
    got = {(r.doc_id, r.item_id): (r.item_shingles, r.shared) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    by = {}
    for i, t in docs:
        if i is not None:
            by.setdefault(i, set()).update(grams(t))
    want = {}
    for k, t in items:
        g = grams(t)
        for i, h in by.items():
            if k is not None and g and len(g & h) / len(g) >= 0.8:
                want[i, k] = (len(g), len(g & h))
    assert got == want and len(want) > 50 and (502, 92) in want and (503, 92) not in want
    kept = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in docs if i not in {a for a, _ in want})
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    from vellumine.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    d = spark.createDataFrame([(1, "a b c d e f g"), (2, "z")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(d, spark.createDataFrame([(7, "b c d e f g")], "item_id long, text string")).collect()] == [(1, 7)]


def test_edits_against_brute_force(spark):
    rows = [(5, "One. Two! Three?\nFour"), (-3, None), (9, "ünï" * 301), (7, ""), (12, "same. text. here."), (13, "same. text. here."), (40, ("A long line. " * 200).strip())]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, fingerprint string").repartition(3)
    out = {r.id: r for r in merkle.edits(df).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        assert out[i].n_chars == n and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (out[i].fingerprint == out[i].edited_fingerprint) == (t == edited)
        assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
    assert out[12].fingerprint == out[13].fingerprint and out[12].near_next == 1.0 and out[5].fingerprint != out[12].fingerprint
    assert out[40].near_edited > 0.35


def test_edits_of_repeated_null_and_lone_ids(spark):
    rows = [(1, "aa. bb."), (1, "cc. dd."), (None, "ee. ff."), (2, "gg. hh.")]
    out = sorted((str(r.id), r.edited_sha256) for r in merkle.edits(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert out == sorted([("1", sha("aa. " + "gg.")), ("1", sha("cc. " + "gg.")), ("2", sha("gg. " + "aa.")), ("None", sha("ee. "))])
    one = merkle.edits(spark.createDataFrame([(4, "xyz uvw")], "doc_id long, text string")).first()
    assert one.edited_sha256 == sha("xyz " + "xyz") and one.near_next == 1.0
    assert merkle.edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likeness_and_place_of_edits(spark):
    rng = random.Random(7)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(9)).capitalize() + ". "
    lines = ["".join(sentence() for _ in range(3)) + "\n" for _ in range(100)]
    base, one = "".join(lines), "".join(lines[:50] + [lines[50] + "An inserted sentence.\n"] + lines[51:])
    blocks = [s + ". " for s in base.replace("\n", "").split(". ") if s]
    rng.shuffle(blocks)
    mixed = rng.sample(lines, len(lines))
    texts = {"same": base, "inserted": one, "paragraph": "".join(lines[:30] + ["A new paragraph.\n"] + lines[30:]), "cut": "".join(lines[:90]), "paragraphs": "".join(mixed), "sentences": "".join(blocks), "other": "".join(sentence() + "\n" for _ in range(300)), "none": ""}
    df = spark.createDataFrame([(k, base, t) for k, t in texts.items()], "id string, a string, b string")
    a = merkle.fingerprints(df.select("id", "a"), "id", "a").withColumnRenamed("fingerprint", "fa")
    b = merkle.fingerprints(df.select("id", "b"), "id", "b").withColumnRenamed("fingerprint", "fb")
    got = {r.id: r for r in a.join(b, "id").select("id", "fa", "fb", merkle.likeness(F.col("fa"), F.col("fb")).alias("l"), merkle.differing_sections(F.col("fa"), F.col("fb")).alias("d")).collect()}
    like = {k: r.l for k, r in got.items()}
    n = len(got["same"].fa.split("|")) - 1
    assert 5 <= n <= 40 and like["same"] == 1.0 and got["same"].d == [] and like["none"] == 0.0 and like["other"] < 0.01 and len(got["other"].d) == n
    assert len(got["inserted"].d) <= 2 and len(got["paragraph"].d) <= 2 and got["inserted"].d != got["paragraph"].d
    assert 0.95 < like["inserted"] < 1 and 0.95 < like["paragraph"] < 1 and 0.85 < like["cut"] < 0.98
    assert like["sentences"] < 0.92 and like["sentences"] < like["paragraphs"] < like["inserted"]
    assert len(got["same"].fa) < 0.4 * len(base)


def test_long_texts_have_trees(spark):
    rows = [(1, "word. " * 200_000), (2, "x" * 500_000), (3, "\n" * 100_000), (4, "# Head\nline\n" * 20_000)]
    out = {r.id: r for r in merkle.edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == 4 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out.values()) and len({r.fingerprint for r in out.values()}) == 4

import random

import numpy as np
import pytest
import xxhash

from vellumine.llm import common
from vellumine.llm.components import components
from vellumine.llm import simhash as module
from vellumine.llm.simhash import forest, near_duplicates, near_texts, simhash, trie_pairs


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[ \t-\r]+", low) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(pairs, nodes):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in nodes}


def test_fingerprint_of_odd_texts():
    rng = random.Random(1)
    for text in [None, "", " \t\n", "one", "one Two", "É É a", "a b c", "x " * 9, " ".join(rng.choice("abcdefgh") for _ in range(70_000))]:
        assert simhash(None if text is None else text.encode()) == brute(text)


@pytest.mark.parametrize("seed", range(3))
def test_trie_finds_each_pair_once(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.array([int(x) ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for x in np.repeat(base, 8)], np.uint64)
    a = np.unique(np.concatenate([base, near]))
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if (x := int(a[i] ^ a[j])).bit_count() <= 3 and (x >> 32).bit_count() <= 1}
    got = [(int(i), int(j)) for x, y in trie_pairs(a, None, 0, 0, ((32, 1), (64, 3)), leaf=4, block=64) for i, j in zip(x, y)]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_follow_long_paths(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(900, 905), (905, 900), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {900: 900, 905: 900}
    assert components(edges.limit(0)).count() == 0


def test_near_duplicates_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in d]
    rows += [(1000 + i, " ".join((t := r.text.split())[: max(1, len(t) - 1)])) for i, r in enumerate(d[:60])]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, rows[0][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, fp int")
    out = near_duplicates(df).collect()
    assert len(out) == len(rows)
    fp = {i: brute(t) for i, t in rows}
    ids = sorted(fp)
    want = classes([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 3], ids)
    assert {(r.id, r.fp % 2**64, r.component) for r in out} == {(i, fp[i], want[i]) for i in ids}


def test_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "z")], "doc_id long, text string")
    assert sorted((r.id or -1, r.component or -1) for r in near_duplicates(df).collect()) == [(-1, -1), (-1, 5), (5, 5)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_trie_of_equal_keys_and_two_sides():
    rng = np.random.default_rng(4)
    a = np.sort(np.concatenate([np.full(300, 7, np.uint64), rng.integers(0, 1 << 20, 50, dtype=np.uint64)]))
    b = np.sort(np.concatenate([np.full(80, 5, np.uint64), rng.integers(0, 1 << 20, 50, dtype=np.uint64)]))
    steps = ((50, 0), (64, 2))
    for x, y in ((a, None), (a, b)):
        z = x if y is None else y
        want = sum(((z ^ v).astype(np.uint64) >> np.uint64(14) == 0).astype(int) @ (np.bitwise_count(z ^ v) <= 2).astype(int) for v in x)
        want = (want - len(x)) // 2 if y is None else want
        got = [(i, j) for p, q in trie_pairs(x, y, 0, 0, steps, leaf=4, block=64) for i, j in zip(p.tolist(), q.tolist())]
        assert len(got) == len(set(got)) == want


def test_forest_is_least_and_spans():
    rng = np.random.default_rng(5)
    n = 60
    u, v, d = rng.integers(0, n, 200), rng.integers(0, n, 200), rng.integers(0, 9, 200)
    kept, label = forest(n, u, v, d)
    for most in range(9):  # a least forest connects what the edges up to each length connect
        whole = classes([(a, b) for a, b, x in zip(u.tolist(), v.tolist(), d.tolist()) if x <= most], range(n))
        few = classes([(u[k], v[k]) for k in kept.tolist() if d[k] <= most], range(n))
        assert whole == few
    whole = classes(list(zip(u.tolist(), v.tolist())), range(n))
    assert len(kept) == n - len(set(whole.values())) and len(set(zip(label.tolist(), whole.values()))) == len(set(whole.values())) == len(set(label.tolist()))


def test_large_buckets_go_in_blocks(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = [int(x) ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for x in np.repeat(base, 3)]
    fps = sorted({int(x) for x in base} | set(near))
    nodes = spark.createDataFrame([(i, x - (1 << 64) * (x >> 63)) for i, x in enumerate(fps)], "node long, w0 long")
    want = classes([(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3], range(len(fps)))
    for rows, most in ((1 << 16, 1 << 18), (100, 40)):
        got = [(r.u, r.v) for r in module.links(nodes, module._exact(3), rows, most).collect()]
        assert all((fps[u] ^ fps[v]).bit_count() <= 3 for u, v in got) and classes(got, range(len(fps))) == want


def five(text, size=5):
    w = [x for x in __import__("re").split("[ \t-\r]+", (text or "").lower()) if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard_groups(rows, least=0.8):
    """Groups of (id, text) rows, ids distinct, by the Jaccard similarity of five-word sets; by brute force."""
    sets = {i: five(t) for i, t in rows}
    ids = sorted(sets)
    alike = lambda a, b: (not a and not b) or len(a & b) >= least * len(a | b)
    return classes([(a, b) for k, b in enumerate(ids) for a in ids[:k] if min(len(sets[a]), len(sets[b])) >= least * max(len(sets[a]), len(sets[b])) and alike(sets[a], sets[b])], ids)


def test_near_texts_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(60):  # chains and stars of edited copies, about the line and beyond it
        text = [rng.choice(words) for _ in range(rng.randrange(5, 400))]
        rows.append((1000 * g, " ".join(text)))
        for k in range(1, rng.randrange(2, 25)):
            for _ in range(rng.randrange(0, max(2, len(text) // 25))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((1000 * g + k, " ".join(text)))
    rows += [(90_001, None), (90_002, ""), (90_003, " \n"), (90_004, "one"), (90_005, "One"), (90_006, rows[0][1].upper())]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, component int").repartition(5)
    want = jaccard_groups(rows)
    got = {r.id: r.component for r in near_texts(df).collect()}
    assert len(got) == len(rows) and sum(got[i] != want[i] for i in want) <= 0.005 * len(rows)
    pairs = sum(want[i] != i for i in want)
    assert pairs > 150
    kept = module.distinct_texts(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({got[i] for i in got})


def test_near_texts_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (5, "q r s t u v w"), (7, "q r s t u v w"), (9, "A B C D E F")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in module.distinct_texts(df).collect()) == [("5", "a b c d e f"), ("5", "q r s t u v w"), ("None", "a b c d e f")]
    assert module.distinct_texts(df.limit(0)).count() == 0


def test_stage_drops_copies_with_edited_words(spark):
    words = [f"word{i}" for i in range(400)]
    edited = [w if i % 100 else "other" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(3, " ".join(words)), (5, " ".join(edited)), (7, " ".join(words[::-1])), (None, " ".join(words))], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in module.distinct_texts(docs).collect()) == [0, 3, 7]


def test_no_link_at_the_line_is_left_out(spark):
    """Siblings whose pairs lie on both sides of the threshold: a pair just under it may be the nearer by its differing bits."""
    rng = random.Random(11)
    rows = []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(240)]
        for k in range(30):
            text = list(base)
            for p in rng.sample(range(240), rng.randrange(3, 8)):
                text[p] = f"own{g}x{k}x{p}"
            rows.append((1000 * g + k, " ".join(text)))
    want = jaccard_groups(rows)
    got = {r.id: r.component for r in near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(want.values())) > 100 and got == want


def test_pairs_that_share_a_shingle():
    rng = np.random.default_rng(3)
    size = rng.integers(5, 40, 300)
    s, key = rng.integers(0, 40, 2000), rng.integers(0, 300, 2000)
    comp, n = np.where(key < 60, 7, 0), size[key]
    at = (key * 31 + s) % 5
    want = set()
    for i in range(2000):
        for j in range(2000):
            if s[i] == s[j] and key[i] < key[j] and key[j] >= 60 and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) - 1e-9 and 1.8 * min(n[i] - at[i], n[j] - at[j]) >= 0.8 * (n[i] + n[j]) - 1e-6:
                want.add((int(key[i]), int(key[j])))
    key = key + 1000
    got = {(int(u) - 1000, int(v) - 1000) for a, b in module._sharing(s, key, comp, n, at, 0.8) for u, v in zip(a, b)}
    assert got == want and len(want) > 50


def test_parities_differ_in_no_more_places_than_the_sets():
    rng = np.random.default_rng(5)
    every = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for n in (0, 1, 5, 300, 2500):
        for cut in (0, 1, 40, 400):
            a, b = np.unique(every[:n]), np.unique(every[cut : n + cut // 2])
            differ = len(np.setxor1d(a, b))
            got = int(np.bitwise_count(module.odd(a) ^ module.odd(b)).sum())
            assert got <= differ and (differ > 40 or got >= differ // 2) and (differ - got) % 2 == 0


def test_fine_parities_differ_in_no_more_places_than_the_sets():
    rng = np.random.default_rng(5)
    for n, extra in ((0, 3), (1, 0), (100, 20), (500, 100), (127, 2), (4000, 300), (8190, 5)):  # some on either side of a power of two
        s = np.unique(rng.integers(0, 1 << 63, n + 2 * extra, np.uint64))
        a, b = s[: n + extra], np.concatenate([s[:n], s[n + extra :]])
        far = module.differing(module.fine(a), module.fine(b))
        assert far == module.differing(module.fine(b), module.fine(a)) <= 2 * extra and (far > extra or extra < 10)
        assert module.differing(module.fine(a), module.fine(a)) == 0


def test_sets_are_written_only_of_texts_that_may_be_alike(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(2400)]
    texts = [base + [word() for _ in range(1600)] for _ in range(6)]  # long ones that share a passage, at about 0.43
    texts.append([*texts[0][:-1], "other"])
    inner, rows = module.table, {"sets": 0, "between": 0}

    def told(df, name="part"):
        out = inner(df, name)
        if name in rows:
            rows[name] += out.count()
        return out

    monkeypatch.setattr(module, "table", told)
    before = common.written()
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in module.distinct_texts(df).collect()) == list(range(6))
    assert rows["between"] >= 15 and rows["sets"] == 2  # before, those of all seven were written
    assert common.written() == before + 1  # and so did all tables stay until the end

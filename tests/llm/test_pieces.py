import math
import random
from collections import Counter

import numpy as np
import pytest

from vellumine.llm import pieces as P


@pytest.fixture(scope="module")
def model():
    return P.Pieces(P._model(P.MODEL))


ODD = ["", " ", "   ", "a", "\n", "▁", "▁ ▁a", "naïve café\t\n  x", "\U0001f511 kéy ", "日本語 テキスト", "x" * 300, "0f" * 40 + " end", " lead and trail ", "a  b   c", "\0\x01é\x7f"]


def test_round_trip_of_odd_texts(model):
    for text, got in zip(ODD, model.sample(ODD, 3, list(range(len(ODD))))):
        assert got and all(model.decode(x[0].tolist()) == text for x in got)
        assert len({tuple(x[0].tolist()) for x in got}) == len(got)
        values = [x[2] for x in got]
        assert values == sorted(values, reverse=True) and all(0 <= x[3] <= 1 for x in got)


def test_decoding_by_bytes_is_decoding(model):
    texts = [*ODD, "many words " * 20_000]
    for text, got in zip(texts, model.sample(texts, 2, list(range(len(texts))))):
        for ids, *_ in got:
            assert model.decodes(ids, text) and not model.decodes(ids, text + "x") and not model.decodes(ids[:-1], text) and not model.decodes(ids, text[:-1] if text else "y")


def whole(model, text):
    """All segmentations of a text with their probabilities, by brute force."""
    every = [((), 0.0)]
    for w in P._WORD.findall(" " + text):
        every = [((*a, *s), p + q) for a, p in every for s, q in model.lattice(w).every()]
    return {tuple(model.unfold(list(s))): math.exp(p) for s, p in every}


def test_first_sample_follows_the_probabilities(model):
    text, n = "the wined ab", 6000
    chance = whole(model, text)
    assert abs(sum(chance.values()) - 1) < 1e-6
    got = Counter(tuple(x[0][0].tolist()) for x in model.sample([text] * n, 1, list(range(n))))
    chi = sum((got[s] - n * p) ** 2 / (n * p) for s, p in chance.items() if n * p >= 5)
    cells = sum(n * p >= 5 for p in chance.values())
    assert set(got) <= set(chance) and chi < cells + 5 * math.sqrt(2 * cells)


def test_pairs_follow_sampling_without_replacement(model):
    text, n = "ab in", 8000
    chance = whole(model, text)
    got = Counter(tuple(tuple(s[0].tolist()) for s in x) for x in model.sample([text] * n, 2, list(range(7, n + 7))))
    want = {(a, b): p * q / (1 - p) for a, p in chance.items() for b, q in chance.items() if a != b}
    cells = [(got[k], n * w) for k, w in want.items() if n * w >= 5]
    assert len(cells) >= 3 and sum((g - w) ** 2 / w for g, w in cells) < len(cells) + 5 * math.sqrt(2 * len(cells))


def test_log_probabilities_and_exhaustion(model):
    chance = whole(model, "ab")
    got = model.sample(["ab"], 1000, [5])[0]
    found = {tuple(x[0].tolist()) for x in got}
    assert len(found) == len(got) and found <= set(chance) and sum(chance[s] for s in found) > 1 - 1e-5 and {s for s, p in chance.items() if p > 1e-5} <= found
    assert all(abs(x[1] - math.log(chance[tuple(x[0].tolist())])) < 1e-3 for x in got)


def test_samples_depend_on_the_key_alone(model):
    texts = ["some words to split", "und noch mehr Wörter", "some words to split"]
    one = [model.sample([t], 2, [s])[0] for t, s in zip(texts, (1, 2, 3))]
    both = model.sample(texts, 2, [1, 2, 3])
    assert all(np.array_equal(a[0], b[0]) and abs(a[1] - b[1]) < 1e-4 for x, y in zip(one, both) for a, b in zip(x, y))


def test_full_stores_are_emptied(model, monkeypatch):
    monkeypatch.setattr(P, "_ROWS", {6: 7, 9: 5, 13: 3, 20: 2, 32: 1})
    small = P.Pieces(P._model(P.MODEL))
    for s in range(6):
        texts = [" ".join(f"{w}{i * s}" for i in range(9)) for w in ("alpha", "betagamma", "deltaepsilonzeta")]
        assert all(small.decode(x[0].tolist()) == t for t, got in zip(texts, small.sample(texts, 2, [s, s + 1, s + 2])) for x in got)


def test_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a text", 5), (None, "no id", 5), (2, None, 5), (1, "a text", 5), (3, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, samples int")
    out = P.encode(df, verify=True)
    got = {(r.key, i): r for i, r in enumerate(out.collect())}
    assert len(got) == 5 and [r.exact for (k, _), r in got.items() if k == "2"] == [None]
    again = [r.samples for (k, _), r in got.items() if k == "1"]
    assert again[0] == again[1]
    back = P.decode(out.select("key", F.explode("samples.pieces").alias("pieces"))).collect()
    assert {(r.key, r.decoded) for r in back} == {("1", "a text"), (None, "no id"), ("3", "")}
    assert P.encode(df.limit(0)).count() == 0


def test_texts_that_do_not_round_trip_are_told(spark, monkeypatch):
    import corpus_pipeline as cp
    from vellumine.llm import queries

    out = queries.op5_pieces(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "samples", "exact"] and out.where("exact").count() == out.where("samples is not null").count() > 0
    wrong = P.encode(spark.createDataFrame([(1, "a text")], "doc_id long, text string")).selectExpr("key", "samples", "false as exact")
    monkeypatch.setattr(cp.pieces, "encode", lambda docs: wrong)
    with pytest.raises(Exception, match="don't decode to the text of document 1"):
        cp.encode(spark, None, "").collect()


def test_words_are_split_as_the_pattern_does():
    rng = random.Random(4)
    texts = ["", " ", "  ", " a", "a ", "a  b", "a b", "a\0 b", "\0", "a　b c", "a\nb c\n"] + ["".join(rng.choice("ab \0\n") for _ in range(rng.randrange(12))) for _ in range(500)]
    assert all(P._split(" " + t) == P._WORD.findall(" " + t) for t in texts)


def test_tables_that_were_used_before_give_the_same(model, monkeypatch):
    """A store's rows are written over, by words whose pieces end elsewhere."""
    monkeypatch.setattr(P, "_ROWS", {6: 3, 9: 3, 13: 2, 20: 2, 32: 1})
    texts = ["internationalisation of xqzvk", "一丁 aaaaaaaaaaaa bb", "q\U0001f600z interesting", "a b c", "somewhatlongerword été zzz"]
    small, rng = P.Pieces(P._model(P.MODEL)), random.Random(2)
    for s in range(30):
        t = rng.choice(texts)
        got, want = small.sample([t], 2, [s])[0], P.Pieces.sample(model, [t], 2, [s])[0]
        assert all(np.array_equal(a[0], b[0]) and abs(a[1] - b[1]) < 1e-4 for a, b in zip(got, want)) and len(got) == len(want)


def test_stores_are_made_once(monkeypatch):
    """A store is made for the first words of its width, not again with each call's texts."""
    made, make = [], P._Store._make
    monkeypatch.setattr(P._Store, "_make", lambda self: made.append(self.width) or make(self))
    small = P.Pieces(P._model(P.MODEL))
    for s in range(4):
        small.sample(["a few words", "of several widths, internationalisation", "x" * 25], 2, [s, s + 1, s + 2])
    assert sorted(made) == sorted(small.stores) and len(made) > 2


def test_short_pieces_are_found_without_hashes(monkeypatch):
    """One and two characters come from a table; only those that it doesn't hold are hashed. Both ways find the same."""
    small, asked = P.Pieces(P._model(P.MODEL)), []
    lookup = small._lookup
    monkeypatch.setattr(small, "_lookup", lambda h: asked.append(len(h)) or lookup(h))
    small.sample(["a b c d e f"], 2, [1])
    assert not asked
    chars = [*map(chr, range(0x180)), *"Ж一￿\U0001f511"]
    for pair in ("", *(x for x in chars if x in "ab \0\xfe\xffĀ一")):
        texts = [pair + c for c in chars] + [c + pair for c in chars]
        h = np.array([P.Pieces._hash(t) for t in texts], np.uint64)
        c = [[min(ord(x) + 1, 256) for x in t] for t in texts]
        key = np.array([x[0] if len(x) == 1 else 257 + 257 * x[0] + x[1] for x in c])
        assert np.array_equal(small._short(key, h), lookup(h))


def test_tables_hold_the_lattices_mass(model):
    words = ["a", " the", "\xff\xfe\xfd", " \xfe\xff", "ĀaĀ", "a\0b", " \U0001f511k\xe9y", "日本語", " 一" * 6, " internationalisation", "0f" * 14]
    group = P._Words(model, [words])
    for w, place, width in zip(group.words, group.place, group.width):
        assert group.tables[width][2][place] == pytest.approx(model.lattice(w).mass[-1], abs=1e-4)


def test_long_words_of_few_segmentations(model):
    """Longer than calls can be nested."""
    for text in ("\U0001f511" * 3000 + "tion", "over" + "\U0001f511" * 20_000 + "ings"):
        got = model.sample([text], 2, [3])[0]
        assert len({tuple(x[0].tolist()) for x in got}) == 2 and all(model.decode(x[0].tolist()) == text for x in got)

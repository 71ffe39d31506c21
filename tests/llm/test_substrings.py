import hashlib
import random
from collections import Counter

import pytest

from vellumine.llm import substrings


def brute(texts):
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def make(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(n) for n in (60, 75, 80, 90, 120)]
    rows = [text(rng.randrange(1, 400)) for _ in range(25)] + [None, "", "a" * 399, "b" * 400, "c" * 401, "ab" * 700, "x" * 5000]
    rows += [text(20) + p + text(30) for p in passages for _ in range(5)] + [rows[3], rows[3], rows[5]]
    copy = rows[7]
    rows += [copy[: len(copy) // 2] + "#" + copy[len(copy) // 2 :], copy[1:], text(5) + text(300)[:400] * 3]
    base = text(200)
    return rows + [base[:399] + "!", base[:400] + "?", base[10:409] + "-", base]


@pytest.mark.parametrize(("together", "piece"), [(4096, 1 << 21), (2, 3000)])
def test_against_brute_force(spark, monkeypatch, together, piece):
    if piece < 1 << 20:  # small pieces on the driver's side of the same code
        monkeypatch.setattr(substrings, "PIECE", piece)
        texts = [(i, (t or "").encode()) for i, t in enumerate(make(1))]
        starts = Counter()
        for _, _, key, s, n in substrings.runs(texts):
            starts.update((k, x) for k, a, m in zip(key.tolist(), s.tolist(), n.tolist()) for x in range(a, a + m))
        assert starts == Counter({(k, i): 1 for k, t in texts for i in range(len(t) - 399)})
        monkeypatch.undo()
    rows = make(2)
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(rows)], "doc_id long, text string, k string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.digest(substrings.dedup(df, together=together)).collect()}
    assert [got[i] for i in range(len(rows))] == brute([(t or "").encode() for t in rows])


def test_repeated_rows_null_ids_and_none(spark):
    rows = [(1, "q" * 450), (1, "q" * 450), (None, "r" * 100 + "".join(map(str, range(300)))), (None, None)]
    out = sorted(tuple(r)[1:4] for r in substrings.digest(substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    assert out == [(0, 0, 0), (450, 450, 1), (450, 450, 1), (890, 0, 0)]
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0

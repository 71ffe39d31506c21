"""Language identification: nearest of several centroids per language over TF-IDF byte trigrams."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.labelled import thin

#: Hashed trigrams; centroids of a language; documents of a language that centroids are fitted on, at most; bytes of each.
DIMS, CENTROIDS, TRAIN_ROWS, TRAIN_BYTES = 4096, 4, 800, 1 << 16
#: How sharply the score prefers the nearer language; share of a centroid's own members that its radius takes in, and slack.
SHARP, INSIDE, SLACK = 25.0, 0.995, 1.15
#: Bytes taken at once.
BATCH = 1 << 19

_FOLD = np.array([32 if b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if b <= 90 else b for b in range(256)], np.uint32)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    """Whether a character is a letter by its Unicode category (L*); digits of any script, fractions and number forms aren't."""
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace"))))


def _codes(data: bytes) -> np.ndarray:
    b = _FOLD[np.frombuffer(data, np.uint8)]
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(20)


def counts(texts: list[bytes]) -> np.ndarray:
    """Texts x DIMS counts of trigrams, each text with a space before and after."""
    padded = [b" " + t + b" " for t in texts]
    code = _codes(b"".join(padded) + b"  ")
    n = np.array([len(p) for p in padded])
    row = np.repeat(np.arange(len(texts)), n)
    inside = np.ones(len(code), bool)
    ends = np.cumsum(n)
    inside[ends - 1] = inside[ends - 2] = False  # these reach into the next text
    return np.bincount(row[inside] * DIMS + code[inside], minlength=len(texts) * DIMS).reshape(-1, DIMS)


def _batched(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """counts() of all texts, some at a time; a long text is counted in pieces that overlap by two bytes."""
    group: list[bytes] = []
    held = 0
    for t in texts:
        if len(t) > BATCH:
            if group:
                yield counts(group)
                group, held = [], 0
            whole = np.zeros((1, DIMS), np.int64)
            padded = b" " + t + b" "
            for s in range(0, len(padded) - 2, BATCH):
                whole[0] += np.bincount(_codes(padded[s : s + BATCH + 2]), minlength=DIMS)
            yield whole
            continue
        group.append(t)
        held += len(t)
        if held >= BATCH or len(group) >= 128:
            yield counts(group)
            group, held = [], 0
    if group:
        yield counts(group)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(c).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # all languages' x DIMS, of unit length
    of: np.ndarray  # each centroid's language
    radius: np.ndarray  # cosine distance up to which a text is one of the centroid's


def _cluster(v: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means from spread-out starts."""
    r = np.random.default_rng(seed)
    c = [v[r.integers(len(v))]]
    for _ in range(min(k, len(v)) - 1):
        c.append(v[np.argmax(1 - np.max(v @ np.array(c).T, axis=1))])
    c = np.array(c)
    for _ in range(12):
        near = np.argmax(v @ c.T, axis=1)
        for j in range(len(c)):
            if (near == j).any():
                m = v[near == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-9)
    return c


def fit(rows: list[tuple[str, bytes]], idf: np.ndarray) -> Model:
    langs = sorted({lang for lang, _ in rows})
    cents, of, radius = [], [], []
    for i, lang in enumerate(langs):
        v = vectors(np.concatenate(list(_batched(t for x, t in rows if x == lang))), idf)
        c = _cluster(v, CENTROIDS)
        near, best = np.argmax(v @ c.T, axis=1), np.max(v @ c.T, axis=1)
        for j in range(len(c)):
            own = best[near == j] if (near == j).any() else best
            cents.append(c[j])
            of.append(i)
            radius.append(min(1.0, SLACK * float(np.quantile(1 - own, INSIDE))))
    return Model(langs, idf, np.array(cents, np.float32).reshape(-1, DIMS), np.array(of), np.array(radius))


def predict(m: Model, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether the nearest centroid's radius takes the text in."""
    names, scores, taken = [], [], []
    for c in _batched(texts):
        sim = vectors(c, m.idf) @ m.centroids.T
        best = np.stack([sim[:, m.of == i].max(axis=1) for i in range(len(m.langs))], axis=1)
        at, near = best.argmax(axis=1), sim.argmax(axis=1)
        e = np.exp(SHARP * (best - best.max(axis=1, keepdims=True)))
        names += [m.langs[i] for i in at]
        scores.append(1 / e.sum(axis=1))
        taken.append(1 - sim[np.arange(len(near)), near] <= m.radius[near])
    return names, np.concatenate(scores) if scores else np.zeros(0), np.concatenate(taken) if taken else np.zeros(0, bool)


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of docs (t: binary) each trigram is, and their number; each task sums its own, so 4,097 rows a task move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMS + 1, np.int64)
        for b in batches:
            for c in _batched(x.as_py() for x in b.column(0)):
                df[:DIMS] += (c > 0).sum(axis=0)
                df[DIMS] += len(c)
        yield pa.RecordBatch.from_arrays([pa.array(range(DIMS + 1)), pa.array(df)], ["k", "n"])

    out = np.zeros(DIMS + 1, np.int64)
    for r in docs.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out[:DIMS], int(out[DIMS])


def identify(docs: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang_pred, score, accepted) of each row of docs.

    Learnt from rows with a language and text for which `keep` holds: trigram frequencies from all of them, centroids from
    about 800 of each language, of up to 64 KiB, drawn by a hash of the id. lang_pred is the language of the nearest centroid
    by cosine, score weighs it against the other languages' nearest; accepted is false beyond that centroid's radius, and
    callers that want rejection read such rows as `und`. Texts that are null or have no letter are `und`, score 0, not accepted;
    so is every text if nothing could be learnt. Rows that repeat an id or have a null id are like any other; no rows give no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"), F.col(lang_col).cast("string").alias("lang"), keep.alias("keep"))
    train = own.where("keep and lang is not null and t is not null and octet_length(t) > 0")
    df, n = _frequencies(train.select("t"))
    rows = thin(train.where(F.octet_length("t") <= TRAIN_BYTES).withColumn("key", F.concat_ws(":", "id", F.xxhash64("t"))), "key", TRAIN_ROWS, F.col("lang")).select("lang", "t", "key").collect()
    got = [(r.lang, bytes(r.t)) for r in sorted(rows, key=lambda r: (r.lang, r.key)) if has_letter(bytes(r.t))]
    model = fit(got, (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)) if got else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py() for x in b.column(1)]
            lang, score, taken = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            at = [i for i, t in enumerate(texts) if model and has_letter(t)]
            if at:
                names, s, ok = predict(model, [texts[i] for i in at])
                score[at], taken[at] = s, ok
                for i, name in zip(at, names):
                    lang[i] = name
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score), pa.array(taken)], ["id", "lang_pred", "score", "accepted"])

    return own.select("id", "t").mapInArrow(run, "id long, lang_pred string, score double, accepted boolean")

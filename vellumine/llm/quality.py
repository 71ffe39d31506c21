"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of whole documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.labelled import sample

#: Bytes of a block; two make a filter's width, one its step. Bytes of half a chunk; chunks overlap by half.
BLOCK, HALF = 4, 512
#: Dimensions of a byte's embedding, filters. Bytes taken at once: longer texts go in segments of so many.
DIMS, FILTERS, SEGMENT = 8, 24, 1 << 20
#: Documents of each label and bytes of each that a model is fitted on, at most; rounds over them.
TRAIN_ROWS, TRAIN_BYTES, ROUNDS, STEP = 1500, 1 << 16, 8, 24


@dataclass
class Model:
    bytes_: np.ndarray  # 256 x DIMS; byte 0 pads and is zero
    first: np.ndarray  # BLOCK * DIMS x FILTERS, for the first block of a window
    second: np.ndarray
    bias: np.ndarray
    mean_w: np.ndarray  # of the mean over chunks of each filter's maximum
    max_w: np.ndarray  # of the maximum over chunks
    out: np.ndarray  # intercept

    def arrays(self) -> list[np.ndarray]:
        return [self.bytes_, self.first, self.second, self.bias, self.mean_w, self.max_w, self.out]


def _start(seed: int = 7) -> Model:
    r = np.random.default_rng(seed)
    f = lambda *n, s: (r.standard_normal(n) * s).astype(np.float32)
    e = f(256, DIMS, s=0.5)
    e[0] = 0
    return Model(e, f(BLOCK * DIMS, FILTERS, s=0.25), f(BLOCK * DIMS, FILTERS, s=0.25), np.zeros(FILTERS, np.float32), f(FILTERS, s=0.2), f(FILTERS, s=0.2), np.zeros(1, np.float32))


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each padded to whole half chunks; and the number of half chunks of each."""
    n = np.array([max(1, -(-len(t) // HALF)) for t in texts])
    return np.frombuffer(b"".join(t.ljust(k * HALF, b"\0") for t, k in zip(texts, n.tolist())), np.uint8), n


def _responses(m: Model, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Half chunks x windows x FILTERS; a text's last window, which would reach into the next text, is far below."""
    blocks = m.bytes_[data].reshape(-1, BLOCK * DIMS)
    r = blocks @ m.first
    r[:-1] += (blocks @ m.second)[1:]
    r[np.cumsum(n) * (HALF // BLOCK) - 1] = -1e9
    return r.reshape(-1, HALF // BLOCK, FILTERS)


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of n half chunks: the first and second half of each chunk (one alone is both), its text, where texts' chunks begin."""
    chunks = np.maximum(1, n - 1)
    at = np.cumsum(chunks) - chunks
    text = np.repeat(np.arange(len(n)), chunks)
    a = np.arange(chunks.sum()) - at[text] + (np.cumsum(n) - n)[text]
    return a, a + (n > 1)[text], text, at


def _combine(m: Model, halves: np.ndarray, n: np.ndarray) -> np.ndarray:
    a, b, _, at = _spread(n)
    chunk = np.maximum(np.maximum(halves[a], halves[b]) + m.bias, 0)
    return np.add.reduceat(chunk, at) / np.maximum(1, n - 1)[:, None] @ m.mean_w + np.maximum.reduceat(chunk, at) @ m.max_w + m.out[0]


def fit(rows: list[tuple[bytes, int]], seed: int = 7) -> tuple[Model, bool]:
    """A model of (text, label) rows by Adam on the cross entropy, classes weighted as they are; False if but one label is there."""
    m = _start(seed)
    y = np.array([label for _, label in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return m, False
    r = np.random.default_rng(seed)
    params = m.arrays()
    mom, var, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(ROUNDS):
        order = r.permutation(len(rows))
        for s in range(0, len(order), STEP):
            pick = order[s : s + STEP]
            data, n = _pack([rows[i][0] for i in pick])
            resp = _responses(m, data, n)
            where = resp.argmax(axis=1)  # half chunks x FILTERS
            halves = np.take_along_axis(resp, where[:, None], 1)[:, 0]
            a, b, text, at = _spread(n)
            from_b = halves[b] > halves[a]
            chunk = np.maximum(np.where(from_b, halves[b], halves[a]) + m.bias, 0)
            k = np.maximum(1, n - 1)[:, None]
            mean, top = np.add.reduceat(chunk, at) / k, np.maximum.reduceat(chunk, at)
            z = mean @ m.mean_w + top @ m.max_w + m.out[0]
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)).astype(np.float32)
            g_chunk = (d[:, None] * m.mean_w / k)[text] + np.where(chunk == top[text], (d[:, None] * m.max_w)[text], 0)
            g_chunk *= chunk > 0
            g_half = np.zeros_like(halves)
            np.add.at(g_half, a, np.where(from_b, 0, g_chunk))
            np.add.at(g_half, b, np.where(from_b, g_chunk, 0))
            h, f = np.nonzero(g_half)
            g = g_half[h, f]
            block = h * (HALF // BLOCK) + where[h, f]
            bytes_ = data.reshape(-1, BLOCK)
            pair = np.concatenate([bytes_[block], bytes_[np.minimum(block + 1, len(bytes_) - 1)]], axis=1)  # windows x 8 bytes
            weight = np.concatenate([m.first, m.second]).reshape(2 * BLOCK, DIMS, FILTERS)
            g_weight = np.zeros((FILTERS, 2 * BLOCK * DIMS), np.float32)
            np.add.at(g_weight, f, m.bytes_[pair].reshape(len(g), -1) * g[:, None])
            g_bytes = np.zeros_like(m.bytes_)
            np.add.at(g_bytes, pair, weight[:, :, f].transpose(2, 0, 1) * g[:, None, None])
            g_bytes[0] = 0
            g_weight = g_weight.T
            grads = [g_bytes, g_weight[: BLOCK * DIMS], g_weight[BLOCK * DIMS :], g_chunk.sum(0), d @ mean, d @ top, d.sum(keepdims=True)]
            t += 1
            for p, q, u, v in zip(params, grads, mom, var):
                q = q + 1e-4 * p
                u += 0.1 * (q - u)
                v += 0.01 * (q * q - v)
                p -= 0.01 * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            m.bytes_[0] = 0
    return m, True


def score(m: Model, texts: Iterable[bytes | None]) -> np.ndarray:
    """Probability of label 1 of each text; a null text counts as empty. Segments bound the memory, not the text."""
    out: list[np.ndarray] = []
    group: list[bytes] = []

    def flush() -> None:
        if group:
            data, n = _pack(group)
            out.append(_combine(m, _responses(m, data, n).max(axis=1), n))
            group.clear()

    held = 0
    for t in texts:
        t = t or b""
        if len(t) > SEGMENT:
            flush()
            parts = [_pack([t[s : s + SEGMENT]]) for s in range(0, len(t), SEGMENT)]
            halves = np.concatenate([_responses(m, *p).max(axis=1) for p in parts])
            out.append(_combine(m, halves, np.array([len(halves)])))
            held = 0
            continue
        group.append(t)
        held += len(t) + HALF
        if held >= SEGMENT // 4:
            flush()
            held = 0
    flush()
    z = np.concatenate(out) if out else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, score): the probability that a document has label 1, for each row of docs.

    The network is fitted on the driver on at most about 2 x `rows` labelled documents of up to 64 KiB for which `keep`
    (a condition on the labels' columns) holds, drawn by a hash of the id, its scores then shifted to the labels' shares among all of them; scores cover every byte of every text.
    With no label or but one kind of label each score is 0.5. Null texts are scored as empty ones. Rows that repeat an id
    or have a null id are scored like any other; labels of null ids or other than 0 and 1 are left out. No rows give no rows.
    """
    rows_of, shift = sample(docs, labels, label_col, keep, rows, TRAIN_BYTES, id_col, text_col)
    model, known = fit(rows_of)
    model.out += np.float32(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score(model, (x.as_py() for x in b.column(1))) if known else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "id long, score double")

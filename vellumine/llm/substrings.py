"""Exact substring de-duplication: every byte covered by a string of 400 bytes that starts more than once goes.

The method named for this operator sorts all suffixes, a bucket at a time. On many machines each suffix has to be sent to its
bucket: at eight bytes a suffix that is over ten times the input in shuffle, before a single tie is resolved. So only a sample of
suffixes is kept, chosen by content: of each 400-byte window the 128-byte string of least hash. Equal windows choose
the same string at the same place, as with a cover of positions, so that all windows of a repeated string meet in the bucket of
what they chose. Buckets are then resolved one at a time, first by one hash for a whole run of windows, and, where runs differ,
window by window. The result is the same as by the full suffix array, up to collisions of two 64-bit hashes at once (the chosen
string's and the run's or window's), which takes the place of comparing bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import table

WINDOW, KMER = 400, 128
#: Bytes taken at once; a longer text goes in pieces that overlap by a window. Bits of a place in them.
PIECE, BITS = 1 << 19, 22
#: Runs of a bucket that are resolved together in one task; in greater buckets each window goes by its own hash.
TOGETHER = 256

_RNG = np.random.default_rng(20)
_TABLE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _pow() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers:
        n = PIECE + 2 * WINDOW + (PIECE >> 1)
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Hashes:
    """Hashes of any stretch of a stretch of bytes."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _pow()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, n: int) -> np.ndarray:
        return _mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    b = np.full((-(-len(x) // w) + 1) * w, np.iinfo(np.uint64).max, np.uint64)
    b[: len(x)] = x
    b = b.reshape(-1, w)
    ahead = np.minimum.accumulate(b, axis=1).ravel()
    back = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _pieces(texts: list[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Texts of a window or more, some together: keys, places of the pieces in their texts, the bytes, pieces' ends in them."""
    keys, at, parts, held = [], [], [], 0
    for k, t in texts:
        if len(t) < WINDOW:
            continue
        for s in range(0, len(t) - WINDOW + 1, PIECE):
            part = t[s : s + PIECE + WINDOW - 1]
            if held and held + len(part) > PIECE:
                yield keys, at, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
                keys, at, parts, held = [], [], [], 0
            keys.append(k)
            at.append(s)
            parts.append(part)
            held += len(part)
    if parts:
        yield keys, at, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def runs(texts: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of runs of windows that choose one string: the string's hash, the run's, the text's key, the first window's place, their number."""
    for keys, at, data, ends in _pieces(texts):
        h = _Hashes(data)
        kmer = h.all(KMER)
        place = np.arange(len(kmer), dtype=np.uint64)
        low = np.uint64((1 << BITS) - 1)
        chosen = (_sliding_min((kmer & ~low) | place, WINDOW - KMER + 1) & low).astype(np.int64)
        begin = ends - np.diff(ends, prepend=0)
        size = ends - begin - WINDOW + 1
        piece = np.repeat(np.arange(len(ends)), size)
        start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[piece]
        c = chosen[start]
        first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (piece[1:] != piece[:-1])]))
        n = np.diff(first, append=len(c))
        s, a, p = start[first], c[first], piece[first]
        run = _mix(h.of(s, s + n - 1 + WINDOW) ^ _mix((a - s).astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)))
        yield kmer[a].view(np.int64), run.view(np.int64), np.array(keys, np.int64)[p], s - begin[p] + np.array(at, np.int64)[p], n


def repeated(contexts: list[bytes], numbers: list[int]) -> np.ndarray:
    """For the first numbers[i] windows of each stretch, one after the other: whether another window is the same."""
    h = window_hashes(contexts, numbers)
    _, where, count = np.unique(h, return_inverse=True, return_counts=True)
    return count[where] > 1


def window_hashes(contexts: list[bytes], numbers: list[int]) -> np.ndarray:
    out, s = [], 0
    while s < len(contexts):
        e, held = s, 0
        while e < len(contexts) and (held == 0 or held + len(contexts[e]) <= PIECE):
            held += len(contexts[e])
            e += 1
        h = _Hashes(np.frombuffer(b"".join(contexts[s:e]), np.uint8))
        begin = np.cumsum([0] + [len(c) for c in contexts[s : e - 1]])
        n = np.array(numbers[s:e])
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        out.append(h.of(start, start + WINDOW))
        s = e
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k, t, at = b.column(0).to_pylist(), b.column(1), 0
        while at < len(k):
            group, held = [], 0
            while at < len(k) and held < 4 * PIECE:
                text = t[at].as_py() or b""
                group.append((k[at], text))
                held += len(text)
                at += 1
            for kh, uh, key, s, n in runs(group):
                yield pa.RecordBatch.from_arrays([pa.array(kh), pa.array(uh), pa.array(key), pa.array(s), pa.array(n)], ["kh", "uh", "k", "s", "n"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, t, todo) -> the stretch of each run to do."""
    for b in batches:
        rows = [(r["kh"], r["hot"], r["own"], k, r["s"], r["n"], t[r["s"] : r["s"] + r["n"] - 1 + WINDOW]) for k, t, todo in zip(*(c.to_pylist() for c in b.columns)) for r in todo]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 7, (pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["kh", "hot", "own", "k", "s", "n", "c"])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by bucket -> stretches of repeated windows; whole buckets are taken, several small ones together."""
    held: list[tuple] = []
    size = 0

    def done() -> pa.RecordBatch:
        flags, out, at = repeated([r[5] for r in held], [r[4] for r in held]), [], 0
        for _, own, k, s, n, _ in held:
            if own:
                out += [(k, s + int(i), int(m)) for i, m in zip(*_stretches(flags[at : at + n]))]
            at += n
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], ["k", "s", "n"])

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if size >= PIECE and r[0] != held[-1][0]:
                yield done()
                held, size = [], 0
            held.append(r)
            size += len(r[5])
    if held:
        yield done()


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kh, own, k, s, n, c = (x.to_pylist() for x in b.columns)
        m = np.array(n, np.int64)
        start = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(np.array(s, np.int64), m)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(kh, np.int64), m)), pa.array(window_hashes(c, n).view(np.int64)), pa.array(np.repeat(np.array(own, bool), m)), pa.array(np.repeat(np.array(k, np.int64), m)), pa.array(start)], ["kh", "w", "own", "k", "s"])


def repeated_windows(keyed: DataFrame, together: int = TOGETHER) -> DataFrame:
    """keyed (k: long, t: binary) -> (k, s, n): n windows from place s on that are repeated; stretches may touch or overlap."""
    unit = table(keyed.mapInArrow(_run_rows, "kh long, uh long, k long, s long, n long"), "runs")
    kinds = unit.groupBy("kh", "uh").agg(F.count("*").alias("c"), F.min(F.struct("k", "s", "n")).alias("one"))
    sums = kinds.groupBy("kh").agg(F.sum("c").alias("all"), F.count("*").alias("kinds")).where("all > 1")
    kinds = table(kinds.join(sums, "kh"), "kinds")
    whole = unit.join(kinds.where("c > 1").select("kh", "uh"), ["kh", "uh"], "left_semi").select("k", "s", "n")
    # a run that is there once may share windows with the bucket's other runs, of each of which one stands for all
    part = kinds.where("kinds > 1").select("one.k", F.struct("kh", (F.col("kinds") > together).alias("hot"), (F.col("c") == 1).alias("own"), "one.s", "one.n").alias("r"))
    todo = keyed.join(part.groupBy("k").agg(F.collect_list("r").alias("todo")), "k").select("k", "t", "todo")
    context = table(todo.mapInArrow(_contexts, "kh long, hot boolean, own boolean, k long, s long, n long, c binary"), "contexts")
    near = context.where("not hot").select("kh", "own", "k", "s", "n", "c").repartition("kh").sortWithinPartitions("kh").mapInArrow(_resolve, "k long, s long, n long")
    windows = context.where("hot").select("kh", "own", "k", "s", "n", "c").mapInArrow(_window_rows, "kh long, w long, own boolean, k long, s long")
    twice = windows.groupBy("kh", "w").count().where("count > 1").select("kh", "w")  # equal windows chose the same string, so both hashes are theirs
    single = windows.where("own").join(twice, ["kh", "w"], "left_semi").select("k", "s", F.lit(1).cast("long").alias("n"))
    return whole.unionByName(near).unionByName(single)


def spans(length: int, stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Removed (start, end) of a text, given its stretches of repeated windows."""
    out: list[list[int]] = []
    for s, n in sorted(stretches):
        e = min(length, s + n - 1 + WINDOW)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER) -> DataFrame:
    """(id, n_bytes, spans, kept) of each row: removed spans (start, end) in bytes of UTF-8, and the bytes that are left.

    A byte goes if a string of 400 bytes that covers it also starts at another place of any row, its own included; strings are
    judged on the input. Texts under 400 bytes keep all; null texts count as empty. Rows that repeat an id, or id and text, are
    rows of their own, so that equal texts of 400 bytes and more lose all. Rows of a null id are like any other. No rows
    give no rows; other columns play no part.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    keyed = own.select(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull(), "t").alias("k"), "id", "t")
    found = repeated_windows(keyed.select("k", "t"), together)
    listed = table(found.groupBy("k").agg(F.collect_list(F.struct("s", "n")).alias("r")), "stretches")
    id_type = dict(own.dtypes)["id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                gone, kept = [], []
                for t, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    g = spans(len(t), [(x["s"], x["n"]) for x in r or []])
                    edges = [0, *(x for s in g for x in s), len(t)]
                    gone.append([{"start": s, "end": e} for s, e in g])
                    kept.append(b"".join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in part.column(1).to_pylist()], pa.int64()), pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return keyed.join(listed, "k", "left").select("id", "t", "r").mapInArrow(cut, f"id {id_type}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digest(deduped: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of dedup()'s rows."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return deduped.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

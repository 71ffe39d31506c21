"""The k nearest points of each question by cosine or dot product, as products of matrices in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points that a task holds at once, and questions that are held against them together.
POINT_ROWS, AT_ONCE = 20_000, 256


def regular(*vectors: DataFrame) -> bool:
    """Whether all vectors are there, of one length, and hold finite numbers only; a null vector isn't."""
    fine = F.coalesce(F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))
    seen = [r for v in vectors for r in v.groupBy(fine.alias("fine"), F.size("vector").alias("size")).count().limit(3).collect()]
    return all(r.fine and r.size > 0 for r in seen) and len({r.size for r in seen}) <= 1


def round_half_up(x: np.ndarray, decimals: int) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) * 10.0**decimals + 0.5), x) / 10.0**decimals


def best(rows: np.ndarray, keys: np.ndarray, ties: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest keys of each row, least tie first among equals."""
    order = np.lexsort((ties, -keys, rows))
    r = rows[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    place = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
    return order[place < k]


def id_ranks(ids: pa.Array) -> np.ndarray:
    """The place of each id in their order, nulls first as Spark has them."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _matrix(batches: list[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) for b in batches])


def _lengths(v: np.ndarray) -> np.ndarray:
    s = np.zeros(len(v))
    for j in range(v.shape[1]):
        s += v[:, j] * v[:, j]
    return np.maximum(np.sqrt(s), 1e-10)


class _Points:
    def __init__(self, batches: list[pa.RecordBatch], k: int, normalised: bool, decimals: int | None) -> None:
        self.k, self.normalised, self.decimals = k, normalised, decimals
        self.ids = pa.concat_arrays([b.column("chunk_id") for b in batches])
        self.ties, v = id_ranks(self.ids), _matrix(batches)
        self.length = np.ones(len(v)) if normalised else _lengths(v)
        self.by_place, self.unit = np.ascontiguousarray(v.T), v / self.length[:, None]

    def near(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every = _matrix([batch])
        for at in range(0, len(every), AT_ONCE):
            q = every[at : at + AT_ONCE]
            length = np.ones(len(q)) if self.normalised else _lengths(q)
            rough = (q / length[:, None]) @ self.unit.T
            n = rough.shape[1]
            least = np.partition(rough, n - self.k, axis=1)[:, n - self.k] if n > self.k else np.full(len(q), -np.inf)
            # sums in another order and rounding can change places only inside this margin
            margin = 1e-12 * np.maximum(1.0, np.abs(rough).max(axis=1)) + (0 if self.decimals is None else 10.0**-self.decimals)
            r, p = np.nonzero(rough >= (least - margin)[:, None])
            score = np.zeros(len(r))
            for j in range(q.shape[1]):
                score += q[r, j] * self.by_place[j, p]
            score /= length[r] * self.length[p]
            if self.decimals is not None:
                score = round_half_up(score, self.decimals)
            kept = best(r, score, self.ties[p], self.k)
            yield pa.record_batch([batch.column("query_id").take(pa.array(at + r[kept])), self.ids.take(pa.array(p[kept])), pa.array(score[kept])], names=["query_id", "chunk_id", "score"])


def _search(k: int, normalised: bool, decimals: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held, points = None, [], None
        for b in batches:
            code = b.column("slot").to_numpy() * 2 + b.column("kind").to_numpy()  # in order
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                part, own = b.slice(i, j - i), int(code[i]) // 2
                if own != slot:
                    slot, held, points = own, [], None
                if code[i] % 2 == 0:
                    held.append(part)
                elif held:
                    if points is None:
                        points, held = _Points(held, k, normalised, decimals), held[:1]
                    yield from points.near(part)

    return run


def nearest(queries: DataFrame, points: DataFrame, k: int, normalised: bool = False, decimals: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of at least the k nearest points of each question, for vectors that are regular().

    Points are dealt to slots of about POINT_ROWS, and each slot sees all questions, in blocks: a task holds one slot's points and
    gives k rows a question and slot. Scores are rounded to `decimals` before they are ranked.
    """
    slots = -(-points.count() // POINT_ROWS) or 1
    same = dict(points.dtypes)["vector"] == dict(queries.dtypes)["vector"]
    vector = F.col("vector") if same else F.col("vector").cast("array<double>")
    query_id, chunk_id = queries.schema["query_id"].dataType, points.schema["chunk_id"].dataType
    p = points.select(F.pmod(F.xxhash64("chunk_id"), F.lit(slots)).cast("int").alias("slot"), F.lit(0).alias("kind"), F.lit(None).cast(query_id).alias("query_id"), "chunk_id", vector.alias("vector"))
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(1).alias("kind"), "query_id", F.lit(None).cast(chunk_id).alias("chunk_id"), vector.alias("vector"))
    dealt = p.unionByName(q).repartition(slots, "slot").sortWithinPartitions("slot", "kind")
    return dealt.mapInArrow(_search(k, normalised, decimals), f"query_id {query_id.simpleString()}, chunk_id {chunk_id.simpleString()}, score double")

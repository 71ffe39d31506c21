"""SimHash near-duplicates: fingerprints linked by binary-trie self-joins.

`near_duplicates` links 64-bit fingerprints of three-word shingles within three bits. `near_texts` links texts whose five-word
shingle sets have a Jaccard similarity of 0.8 or more: fingerprints of 256 bits and tries over several choices of their bits join
what is close at once, and an exact join on the sets' rarest shingles gives every other pair; all are verified on the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import drop_tables, free_shuffles, lean, small, table, written
from vellumine.llm.components import components

_hash = partial(xxhash.xxh64_intdigest, seed=42)
#: Words whose bits are counted at once.
_SLICE = 1 << 15
#: Rows that a bucket of a trie is meant to have; with more than MOST it is dealt out in blocks, pair by pair. Bits of a prefix, at most.
BUCKET_ROWS, MOST, PREFIX = 1 << 16, 1 << 18, 8
#: Pairs that a task holds before it thins them to a forest.
_PAIRS = 1 << 21


@dataclass(frozen=True)
class Tries:
    """How fingerprints of some bits are searched.

    orders: for each trie the bits of the fingerprint that its key has, the first bit first, and then those of a second word.
    steps: (bits, differing bits allowed in so many first bits of a key), up to all 64. beyond: allowed in the second word.
    """

    orders: tuple[tuple[int, ...], ...]
    steps: tuple[tuple[int, int], ...]
    beyond: int = 0

    @property
    def allowed(self) -> list[int]:
        return [next(most for bits, most in self.steps if depth <= bits) for depth in range(65)]


def _exact(budget: int) -> Tries:
    """All pairs of 64-bit fingerprints within the budget: one half has at most half of it, so a trie from either half."""
    down = tuple(range(63, -1, -1))
    return Tries((down, down[32:] + down[:32]), ((32, budget // 2), (64, budget)))


#: Of five-word sets at a Jaccard similarity of 0.8 a bit differs with a chance of 0.15: a trie finds such a pair with a chance of
#: 0.37, and more alike ones with more, so that 24 tries miss about 1 in 10,000 (1 in 300 where by chance a fifth of the bits differ).
#: Each trie has 128 of the 256 bits, 64 in its key.
SHINGLE, JACCARD, WORDS = 5, 0.8, 4
_rng = np.random.default_rng(9)
WIDE = Tries(tuple(tuple(int(x) for x in _rng.permutation(64 * WORDS)[:128]) for _ in range(24)), ((8, 1), (16, 2), (24, 3), (32, 5), (64, 14)), 17)
#: Rounds in which the nearest link of each group is verified, before all the rest are.
ROUNDS = 2
#: Texts, about, that show how common a shingle is, and in how many of them it is counted from. They settle an order only, not what is found.
SAMPLE, SEEN = 8_000, 8
#: Words of a set's parities; and places for each shingle of its finer ones, which are made only of sets that those leave in a pair.
ODD, FINE = 8, 4
_PLACE = _rng.integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = _rng.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def simhash(text: bytes | None) -> int:
    """The fingerprint of one text: bit set where over half of the 3-word shingles' hashes have it; no word: 0."""
    w = text.lower().split() if text else []
    if not w:
        return 0
    n, ones = max(1, len(w) - 2), np.zeros(64, np.int64)
    for a in range(0, n, _SLICE):
        b = min(n, a + _SLICE)
        grams = map(b" ".join, zip(w[a:b], w[a + 1 : b + 1], w[a + 2 : b + 2])) if len(w) > 2 else [b" ".join(w)]
        h = np.fromiter(map(_hash, grams), np.uint64, b - a)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words (split as simhash does); fewer words are one shingle, none give none."""
    w = text.lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    h, k = np.fromiter(map(_hash, w), np.uint64, len(w)), min(size, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        out += h[i : i + len(out)] * _PLACE[i]
    out ^= out >> np.uint64(31)
    out *= _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def wide(s: np.ndarray) -> np.ndarray:
    """The 256 bits of a set of shingles as four words; each shingle counts once."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(s), 2048):
        h = s[at : at + 2048, None] * _SPREAD
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(s), bitorder="little").view(np.uint64)


def odd(s: np.ndarray) -> np.ndarray:
    """Of a set of shingles, for each of 64 * ODD places whether an odd number falls there: two sets' differ in no more places than the sets in shingles."""
    place = (s * _MIX) >> np.uint64(64 - (64 * ODD - 1).bit_length())
    return np.packbits(np.bincount(place.astype(np.int64), minlength=64 * ODD) & 1, bitorder="little").view(np.uint64)


def fine(s: np.ndarray) -> bytes:
    """The parities of a set over FINE places for each shingle and more, a power of two: half as many are its halves combined."""
    m = 1 << max(9, (FINE * max(1, len(s)) - 1).bit_length())
    place = ((s * _MIX) >> np.uint64(32)) & np.uint64(m - 1)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=m) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many places the fine() of two sets differ, of those that the smaller has: no more than the sets in shingles."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): one row for each input row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter(map(simhash, b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "id long, fp long")


def _below(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """For nodes a[lo:hi] that agree above `bit`: where the child with that bit set begins."""
    prefix = (a[lo] >> np.uint64(bit)) | np.uint64(1)
    return np.clip(np.searchsorted(a, prefix << np.uint64(bit)), lo, hi)


def trie_pairs(a: np.ndarray, b: np.ndarray | None, depth: int, spent: int, steps: tuple[tuple[int, int], ...], leaf: int = 32, block: int = 1 << 17, skip=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of a[i], b[j] that differ in no more bits than `steps` allows in each number of first bits.

    a, b: sorted uint64 whose first `depth` bits are one node each, `spent` bits apart; b None: a with itself, i < j.
    Pairs of trie nodes go down together one bit at a time; `spent` gathers the bits in which they differ and a pair goes
    as soon as it is over the budget. Small node pairs are compared at once. Work is a stack of blocks, so memory is bounded.
    skip(al, ah, bl, bh) may tell which larger node pairs needn't be looked into.
    """
    own, b = b is None, a if b is None else b
    if not len(a) or not len(b):
        return
    allowed = Tries((), steps).allowed
    one = lambda x: np.array([x], np.int64)
    stack = [(depth, one(0), one(len(a)), one(0), one(len(b)), one(spent))]
    while stack:
        depth, al, ah, bl, bh, e = stack.pop()
        if len(e) > block:
            m = len(e) // 2
            stack += [(depth, *(x[:m] for x in (al, ah, bl, bh, e))), (depth, *(x[m:] for x in (al, ah, bl, bh, e)))]
            continue
        ends = (ah - al) * (bh - bl) <= leaf
        if ends.any():
            la, lb, na, nb = al[ends], bl[ends], (ah - al)[ends], (bh - bl)[ends]
            n = na * nb
            for s in range(0, len(n), block):  # each has at most `leaf` pairs
                c = n[s : s + block]
                k = np.repeat(np.arange(s, s + len(c)), c)
                r = np.arange(len(k)) - np.repeat(np.cumsum(c) - c, c)
                i, j = la[k] + r // nb[k], lb[k] + r % nb[k]
                if own:
                    i, j = i[i < j], j[i < j]
                x = a[i] ^ b[j]
                for bits, most in reversed(steps):
                    ok = np.flatnonzero(np.bitwise_count(x >> np.uint64(64 - bits)) <= most)
                    i, j, x = i[ok], j[ok], x[ok]
                if len(i):
                    yield i, j
        go = ~ends
        if go.any() and skip is not None:
            go[go] = ~skip(*(x[go] for x in (al, ah, bl, bh)))
        if not go.any():
            continue
        al, ah, bl, bh, e = (x[go] for x in (al, ah, bl, bh, e))
        if depth >= 64:  # many equal keys: by halves of the longer side
            am, bm = np.where(ah - al > 1, (al + ah) // 2, ah), np.where(bh - bl > 1, (bl + bh) // 2, bh)
            parts = [(al, am, bl, bm, e), (am, ah, bm, bh, e), (al, am, bm, bh, e), (am, ah, bl, bm, e)]
            most = 64
        else:
            bit = 63 - depth
            am, bm = _below(a, al, ah, bit), _below(b, bl, bh, bit)
            most = allowed[depth + 1]
            parts = [(al, am, bl, bm, e), (am, ah, bm, bh, e), (al, am, bm, bh, e + 1), (am, ah, bl, bm, e + 1)]
        if own:  # the mirror of a node paired with itself is left out
            same = (al == bl) & (ah == bh)
            parts[3] = tuple(x[~same] for x in parts[3])
        parts = [tuple(x[(p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= most)] for x in p) for p in parts]
        whole = tuple(np.concatenate(x) for x in zip(*parts))
        if len(whole[0]):
            stack.append((min(64, depth + 1), *whole))


def _root(up: np.ndarray) -> np.ndarray:
    """Labels whose chains of lesser labels are followed to their end."""
    while (up[up] != up).any():
        up = up[up]
    return up


def forest(n: int, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the edges of a least spanning forest of n nodes, by Boruvka's rounds; and a label for each node's tree."""
    label, kept = np.arange(n), []
    order = np.argsort(d, kind="stable")
    left = order
    while True:
        lu, lv = label[u[left]], label[v[left]]
        left = left[lu != lv]
        if not len(left):
            return np.concatenate(kept) if kept else np.zeros(0, np.int64), label
        lu, lv = label[u[left]], label[v[left]]
        first = np.full(n, len(left), np.int64)  # of each tree, its least edge; edges are in order, so no two are alike
        np.minimum.at(first, lu, np.arange(len(left)))
        np.minimum.at(first, lv, np.arange(len(left)))
        pick = np.unique(first[first < len(left)])
        kept.append(left[pick])
        up = np.arange(n)
        a, b = lu[pick], lv[pick]
        while len(a):  # the trees that the picked edges join take their least label
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(up, high, low)
            up = _root(up)
            more = up[a] != up[b]
            a, b = up[a[more]], up[b[more]]
        label = up[label]


def _bucket_links(pdf: pd.DataFrame, bits: int, tries: Tries) -> pd.DataFrame:
    """A least spanning forest of the links in a bucket: its own rows with themselves and with guests from near prefixes.

    Of a pair of blocks of one bucket, only what goes between the blocks. Node pairs of the trie whose members are connected
    already are not looked into, so that a dense group is searched about once, not pair by pair.
    """
    key, more, node, guest, side = (pdf[c].to_numpy() for c in ("key", "more", "node", "guest", "side"))
    key, more = key.view(np.uint64), more.view(np.uint64)
    order = np.argsort(key, kind="stable")
    budget, n = tries.steps[-1][1], len(key)
    label, edges, held = np.arange(n), [np.zeros((3, 0), np.int64)], 0

    def near(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal held
        d, e = np.bitwise_count(key[i] ^ key[j]).astype(np.int64), np.bitwise_count(more[i] ^ more[j]).astype(np.int64)
        ok = (d <= budget) & (e <= tries.beyond)
        if ok.any():
            edges.append(np.stack([i[ok], j[ok], (d + e)[ok]]))
            held += int(ok.sum())

    def thin() -> None:
        nonlocal label, held
        e = np.concatenate(edges, axis=1)
        kept, label = forest(n, *e)
        edges[:] = [e[:, kept]]
        held = 0

    def members(chosen: np.ndarray) -> np.ndarray:
        return order[chosen[order]]

    runs, cross = [], side.any()
    for own, other in ([(0, 1), (1, 0)] if cross else [(0, 0)]):
        x = members((guest < 0) & (side == own))
        if not cross or own == 0:
            runs.append((x, members((guest < 0) & (side == 1)) if cross else None, 0))
        for g in np.unique(guest[(guest >= 0) & (side == other)]):  # each guest prefix is a trie node of its own
            runs.append((x, members((guest == g) & (side == other)), int(g)))
    # neighbours in order of the key and rows of one key connect most of what is close before the tries are walked
    near(order[:-1], order[1:])
    starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if n else np.zeros(0, np.int64)
    lead = order[np.repeat(starts, np.diff(starts, append=n))]
    near(lead[lead != order], order[lead != order])
    thin()
    home = int(pdf["bucket"].iloc[0]) & ((1 << bits) - 1) if n else 0
    for x, y, g in runs:
        if not len(x) or (y is not None and not len(y)):
            continue
        z = x if y is None else y
        apart = (home ^ g).bit_count() if g else 0  # guests come from greater prefixes, so none from 0
        found: list[np.ndarray] = []

        def counted() -> None:
            found[:] = [np.concatenate([[0], np.cumsum(np.diff(label[w]) != 0)]) for w in (x, z)]

        def skip(al, ah, bl, bh):
            p, q = found
            return (p[ah - 1] == p[al]) & (q[bh - 1] == q[bl]) & (label[x[al]] == label[z[bl]])

        counted()
        since = 0
        for i, j in trie_pairs(key[x], None if y is None else key[y], bits, apart, tries.steps, skip=skip):
            near(x[i], z[j])
            since += len(i)
            if held > _PAIRS or since > n + (1 << 14):
                thin()
                counted()
                since = 0
    thin()
    u, v, d = edges[0]
    return pd.DataFrame({"u": node[u], "v": node[v], "d": d.astype(np.int32)})


def links(nodes: DataFrame, tries: Tries, bucket_rows: int = BUCKET_ROWS, most: int = MOST) -> DataFrame:
    """nodes (node, w0.. : the words of distinct fingerprints) -> (u, v, d): links that connect all pairs that some trie finds.

    The top levels deal each trie out: a node of some bits is a bucket, which also gets the rows of greater prefixes within
    the budget there. A bucket of more than `most` rows is dealt out again, in blocks by a hash, each pair of blocks to a task
    of its own. A bucket gives a forest of its links, so as many as members, not pairs. d: differing bits of the 64 or 128 looked at.
    """
    n = nodes.count()
    bits = min(PREFIX, max(1, -(-max(1, n) // bucket_rows) - 1).bit_length())
    allowed, words = tries.allowed, len(nodes.columns) - 1

    def fits(mask: int) -> bool:
        return all((mask >> (bits - k)).bit_count() <= allowed[k] for k in range(1, bits + 1))

    masks = [m for m in range(1, 1 << bits) if fits(m)]

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                node = b.column(0).to_numpy()
                fp = np.stack([c.to_numpy().view(np.uint64) for c in b.columns[1:]], axis=1)
                one = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
                for t, order in enumerate(tries.orders):
                    chosen = np.ascontiguousarray(np.packbits(np.ascontiguousarray(one[:, list(order)]), axis=1)).view(">u8").astype(np.uint64)
                    key, more = chosen[:, 0], chosen[:, 1] if chosen.shape[1] > 1 else np.zeros(len(chosen), np.uint64)
                    home = (key >> np.uint64(64 - bits)).astype(np.int64)
                    rows = [(np.arange(len(key)), home, np.full(len(key), -1, np.int64))]
                    for m in masks:
                        to = np.flatnonzero((home ^ m) < home)
                        rows.append((to, home[to] ^ m, home[to]))
                    pick, bucket, guest = (np.concatenate(x) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array((t << bits) + bucket, pa.int32()), pa.array(guest, pa.int32()), _long(key[pick]), _long(more[pick]), pa.array(node[pick])], ["bucket", "guest", "key", "more", "node"])

    dealt = nodes.select("node", *[f"w{k}" for k in range(words)]).mapInArrow(deal, "bucket int, guest int, key long, more long, node long")
    # a row for each bucket, of which there are as many as tries times prefixes
    large = {r.bucket: -(-r["count"] // most) for r in dealt.groupBy("bucket").count().where(F.col("count") > most).collect()}
    whole = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    pairs = F.array(whole)
    if large:
        k = F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("bucket")]
        mine = F.pmod(F.xxhash64("node"), k).cast("int")
        others = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j"), (mine > j).cast("int").alias("side")))
        pairs = F.when(k.isNull(), pairs).otherwise(others)
    rows = dealt.select("*", F.explode(pairs).alias("p")).select("bucket", "guest", "key", "more", "node", "p.i", "p.j", "p.side")
    return rows.groupBy("bucket", "i", "j").applyInPandas(lambda pdf: _bucket_links(pdf, bits, tries), "u long, v long, d int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3) -> DataFrame:
    """(id, fp, component): component is the least id reachable over fingerprints within `budget` bits.

    Null and empty texts, and those of white space only, have fingerprint zero and are linked like any other. Rows that
    repeat an id have a row each. Rows of a null id are kept, belong to their fingerprint's component, and are no
    component's name unless all of it have null ids. No rows give no rows; other columns play no part.
    """
    sig = table(fingerprints(docs, id_col, text_col), "simhash")
    groups = table(sig.groupBy("fp").agg(F.min("id").alias("rep")), "groups")
    named = components(links(groups.where("rep is not null").select(F.col("rep").alias("node"), F.col("fp").alias("w0")), _exact(budget)).select("u", "v"))
    label = groups.join(named, groups["rep"] == named["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return sig.join(label, "fp").select("id", "fp", "component")


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """docs (id, h, t binary) -> (id, h, key, n, w0..w3, o0..): a hash of the shingle set, its size, its fingerprint and its parities."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n, fp = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int32), np.zeros((b.num_rows, WORDS + ODD), np.uint64)
            for i, t in enumerate(b.column(2)):
                s = shingles(t.as_py(), size)
                key[i], n[i], fp[i, :WORDS], fp[i, WORDS:] = xxhash.xxh64_intdigest(s.tobytes()), len(s), wide(s), odd(s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _long(key), pa.array(n), *map(_long, fp.T)], ["id", "h", "key", "n", *words])

    words = [*(f"w{k}" for k in range(WORDS)), *(f"o{k}" for k in range(ODD))]
    return docs.mapInArrow(run, "id long, h long, key long, n int, " + ", ".join(f"{w} long" for w in words))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """docs (id, h, t) -> (key, of): the set of each key, once."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                sets = [shingles(t.as_py(), size) for t in b.column(2).slice(at, 512)]
                key = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([_long(key), pa.ListArray.from_arrays(ends, _long(np.concatenate(sets)))], ["key", "of"])

    return docs.mapInArrow(run, "key long, of array<long>")


def _fine(docs: DataFrame, size: int) -> DataFrame:
    """docs (id, h, t) -> (key, n, odd): of each key its set's size and fine()."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (shingles(t.as_py(), size) for t in b.column(2))
            rows = [(xxhash.xxh64_intdigest(s.tobytes()), len(s), fine(s)) for s in sets]
            yield pa.RecordBatch.from_arrays([_long(np.array([r[0] for r in rows], np.uint64)), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["key", "n", "odd"])

    return docs.mapInArrow(run, "key long, n int, odd binary")


def _near(pairs: DataFrame, fines: DataFrame, jaccard: float) -> DataFrame:
    """The pairs (u, v, ..) of keys but for those that fines, _fine() of their keys, prove to be under the similarity."""
    names = pairs.columns
    of = lambda c: fines.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"o{c}"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (1 - jaccard) / (1 + jaccard) * (b.column("nu").to_numpy().astype(float) + b.column("nv").to_numpy()) + 1e-9
            ok = [differing(x.as_py(), y.as_py()) <= m for x, y, m in zip(b.column("ou"), b.column("ov"), most)]
            yield b.select(names).filter(pa.array(ok, pa.bool_()))

    return pairs.join(of("u"), "u").join(of("v"), "v").select(*names, "nu", "nv", "ou", "ov").mapInArrow(run, pairs.schema)


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that SEEN of about SAMPLE texts of docs (id, h, t) hold, sorted, and in how many; at most SAMPLE / SEEN texts' worth of them."""
    share = min(1.0, SAMPLE / max(1, docs.count()))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                sets = [shingles(t.as_py(), size) for t in b.column(0).slice(at, 512)]
                s, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(s), pa.array(n)], ["s", "n"])

    some = docs.where(F.pmod(F.xxhash64("id", "h"), F.lit(1 << 24)) < share * float(1 << 24))
    got = some.select("t").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN).toArrow()
    s, n = got.column("s").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _prefixes(docs: DataFrame, size: int, jaccard: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs (id, h, t) -> (s, key, n, at): the shingles of a set of n, rarest first, of which sets that are alike share one; at: its place."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = common
        for b in batches:
            for at in range(0, b.num_rows, 256):
                parts, keys, sizes = [], [], []
                for t in b.column(0).slice(at, 256):
                    s = shingles(t.as_py(), size)
                    if not len(s):
                        continue
                    keys.append(xxhash.xxh64_intdigest(s.tobytes()))
                    sizes.append(len(s))
                    if len(known):
                        k = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        s = s[np.argsort(np.where(known[k] == s, often[k], 0), kind="stable")]  # of equal counts the lesser hash first
                    parts.append(s[: len(s) - math.ceil(jaccard * len(s) - 1e-9) + 1])
                if parts:
                    m = np.array([len(x) for x in parts])
                    place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    of = [np.repeat(np.array(keys, np.uint64), m), np.repeat(np.array(sizes, np.int32), m)]
                    yield pa.RecordBatch.from_arrays([_long(np.concatenate(parts)), _long(of[0]), pa.array(of[1]), pa.array(place.astype(np.int32))], ["s", "key", "n", "at"])

    return docs.select("t").mapInArrow(run, "s long, key long, n int, at int")


def _sharing(s: np.ndarray, key: np.ndarray, comp: np.ndarray, n: np.ndarray, at: np.ndarray, jaccard: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of keys in different components that share a shingle s and whose sizes n and places of it allow the similarity."""
    order = np.lexsort((key, n, s))
    s, key = s[order], key[order]
    once = np.concatenate([[True], (s[1:] != s[:-1]) | (key[1:] != key[:-1])])  # a copy's row is the same row
    s, key, order = s[once], key[once], order[once]
    comp, n, at = (x[order] for x in (comp, n, at))
    comp = np.where(comp == 0, key, comp)
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    m = np.diff(start, append=len(s))
    several = np.minimum.reduceat(comp, start) < np.maximum.reduceat(comp, start)
    end = np.repeat(start + m, m)
    i, d = np.flatnonzero(np.repeat(several, m)), 0
    left = n - at
    while len(i):  # each row with the d-th after it; sizes ascend, so one that is too great stays so
        d += 1
        i = i[i + d < end[i]]
        i = i[n[i] >= jaccard * n[i + d] - 1e-9]
        j = i + d
        ok = (comp[i] != comp[j]) & (np.minimum(left[i], left[j]) >= jaccard / (1 + jaccard) * (n[i] + n[j]) - 1e-9)
        if ok.any():
            a, b = key[i[ok]], key[j[ok]]
            yield np.minimum(a, b), np.maximum(a, b)


def _between(docs: DataFrame, named: DataFrame, size: int, jaccard: float) -> DataFrame:
    """Pairs (u, v) of keys of docs (id, h, t) that may have the similarity, all of those that go between components (node, component).

    Sets of that similarity share one of their first shingles in any one order. In the order here rare ones come first, so few others do.
    """
    rows = _prefixes(docs, size, jaccard, _common(docs, size)).join(small(named.select(F.col("node").alias("key"), F.col("component").alias("c"))), "key", "left")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(parts: list) -> Iterator[pa.RecordBatch]:
            held, count = [], 0
            for x in _sharing(*(np.concatenate(c) for c in zip(*parts)), jaccard):
                held.append(x)
                count += len(x[0])
                if count > _PAIRS:
                    yield batch(held)
                    held, count = [], 0
            if held:
                yield batch(held)

        def batch(held: list) -> pa.RecordBatch:
            uv = np.unique(np.concatenate([np.stack(x, axis=1) for x in held]), axis=0) if len(held) > 1 else np.stack(held[0], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(uv[:, k])) for k in (0, 1)], ["u", "v"])

        parts, rows = [], 0  # rows of shingles whose last rows may not have come yet
        for b in batches:
            if not b.num_rows:
                continue
            own = [c.to_numpy() for c in b.columns]
            cut = int(np.searchsorted(own[0], own[0][-1]))
            rows += b.num_rows
            if rows < 1 << 18 or (cut == 0 and parts):
                parts.append(own)
                continue
            if cut:
                yield from pairs([*parts, [x[:cut] for x in own]])
                own = [x[cut:] for x in own]
            parts, rows = [own], len(own[0])
        if parts:
            yield from pairs(parts)

    dealt = rows.select("s", "key", F.coalesce("c", F.lit(0)).alias("c"), "n", "at").repartition("s").sortWithinPartitions("s")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def _alike(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """The pairs (u, v) of keys whose sets have the similarity."""
    both = pairs.join(sets.select(F.col("key").alias("u"), F.col("of").alias("a")), "u").join(sets.select(F.col("key").alias("v"), F.col("of").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= jaccard * (F.size("a") + F.size("b") - shared) - 1e-9).select("u", "v")


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: float = JACCARD, size: int = SHINGLE) -> DataFrame:
    """(id, h, group, component) of each row: its group and the least id there, h being the 64-bit hash of the text.

    A group is what links of that Jaccard similarity connect, of the sets of `size`-word shingles; no pair at or over it is left out.
    The tries give candidate links, which are verified on the sets: each text's nearest one first, then each group's, and then those that still
    go between groups. Before sets are written and joined, pairs go that sizes and parities, which are a small part of a set, prove to be under the line. They are some of the links only, a forest of each bucket by its differing bits, so that few links of large groups have to be
    looked at. _between() gives all pairs that may yet join two groups, and they are verified too. Equal sets are one node; texts
    without words are copies of each other. Rows of a null id are kept and link nothing (group and component null); rows that
    repeat an id stand for themselves. No rows give no rows; other columns play no part.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("t"))
    sig = table(_signed(own, size), "simhash")
    words, odds = [f"w{k}" for k in range(WORDS)], [f"o{k}" for k in range(ODD)]
    groups = table(sig.where("id is not null").groupBy("key").agg(F.min(F.struct("id", "h")).alias("rep"), *[F.first(w).alias(w) for w in ("n", *words, *odds)]), "groups")
    since = written()
    found = table(links(groups.select(F.col("key").alias("node"), *words), WIDE).groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("d").alias("d")), "links")

    repeated = sig.where("id is not null").groupBy("id", "h").count().where("count > 1").limit(1).count()
    odds_of = lambda c: groups.select(F.col("key").alias(c), F.struct("n", *odds).alias(f"o{c}"))

    def texts_of(pairs: DataFrame) -> DataFrame:
        """(id, h, t) of the pairs' keys, one text for each."""
        picked = groups.join(small(table(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct(), "linked")), "key", "left_semi").select("rep.id", "rep.h")
        texts = own.join(small(table(picked, "picked")), ["id", "h"], "left_semi").select("id", "h", "t")
        return texts.dropDuplicates(["id", "h"]) if repeated else texts

    def looked_at(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs but for those that sizes and parities prove to be under the similarity, and their keys' sets. Sets are large, so few should be written and joined."""
        both = pairs.join(odds_of("u"), "u").join(odds_of("v"), "v")
        apart = sum((F.bit_count(F.col(f"ou.{w}").bitwiseXOR(F.col(f"ov.{w}"))) for w in odds), F.lit(0))
        like = F.least("ou.n", "ov.n") >= jaccard * F.greatest("ou.n", "ov.n") - 1e-9
        near = table(both.where(like & (apart <= (1 - jaccard) / (1 + jaccard) * (F.col("ou.n") + F.col("ov.n")) + 1e-9)).select(pairs.columns), "near")
        near = table(_near(near, table(_fine(texts_of(near), size), "fine"), jaccard), "near")
        free_shuffles(docs.sparkSession)
        return near, table(_sets(texts_of(near), size), "sets")

    found, sets = looked_at(found)
    left, alike, named = found.select("u", "v", "d", F.col("u").alias("x"), F.col("v").alias("y")), None, None
    for last in [False] * ROUNDS + [True]:
        pick = left.select("u", "v")
        if not last:
            nearest = left.select("u", "v", "d", F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.min(F.struct("d", "u", "v")).alias("e"))
            pick = table(nearest.select("e.u", "e.v").distinct(), "nearest")
        good = table(_alike(pick, sets, jaccard), "alike")
        alike = good if alike is None else alike.unionByName(good)
        named = components(alike)
        if not last:
            of = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))  # noqa: B023, E731
            left = left.join(pick, ["u", "v"], "left_anti").join(of("u"), "u", "left").join(of("v"), "v", "left")
            left = table(left.select("u", "v", "d", F.coalesce("cu", "u").alias("x"), F.coalesce("cv", "v").alias("y")).where("x <> y"), "left")
    named = table(named, "named")
    drop_tables(since, keep=1)
    free_shuffles(docs.sparkSession)
    rest = table(_between(own.where("id is not null"), named, size, jaccard), "between")
    free_shuffles(docs.sparkSession)
    rest, sets = looked_at(rest)
    if rest.limit(1).count():
        joined = named.select(F.col("node").alias("u"), F.col("component").alias("v"))
        named = components(joined.unionByName(table(_alike(rest, sets, jaccard), "alike")))
    label = groups.join(named, groups["key"] == named["node"], "left").select("key", F.coalesce("component", "key").alias("c"), "rep.id")
    label = table(label, "labels")
    least = label.groupBy("c").agg(F.min("id").alias("component"))
    out = label.join(least, "c").select("key", F.col("c").alias("group"), "component")
    live = sig.where("id is not null").join(out, "key").select("id", "h", "group", "component")
    none = F.lit(None).cast("long")
    return live.unionByName(sig.where("id is null").select("id", "h", none.alias("group"), none.alias("component")))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: float = JACCARD, size: int = SHINGLE) -> DataFrame:
    """Of each group of near_texts() one row, of the least id; rows of a null id stay. Of a group's rows of that id the text of least hash stays, of equal rows any one."""
    since = written()
    near = table(near_texts(docs, id_col, text_col, jaccard, size).where("id = component"), "near")
    drop_tables(since, keep=1)
    kept = near.groupBy("group").agg(F.min(F.struct("id", "h")).alias("r")).select(F.col("r.id").alias("__id"), F.col("r.h").alias("__h"))
    own = docs.withColumn("__own", F.xxhash64(text_col))
    out = own.join(kept, (F.col(id_col) == F.col("__id")) & (F.col("__own") == F.col("__h")), "left_semi")
    if near.groupBy("id", "h").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([id_col, "__own"])
    return out.unionByName(own.where(F.col(id_col).isNull())).select(*docs.columns)

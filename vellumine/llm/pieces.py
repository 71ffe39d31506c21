"""SentencePiece encoding and decoding: distinct segmentations sampled by Gumbel top-k search over each text's lattice."""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, ALPHA = 2, 1.0
_SPACE = "▁"
#: A word: the spaces before it and what follows up to the next space. No piece goes beyond a word.
_WORD = re.compile(r" *[^ ]+| +")
#: Lattices that a worker keeps; they can be made again at any time. Characters of text taken at once.
_LATTICES, _CHARS = 12_000, 250_000


def _split(text: str) -> list[str]:
    """_WORD's matches; where spaces stand alone, before and between words, a split gives the same."""
    if "  " in text or "\0" in text or text[:1] != " " or text[-1:] == " ":
        return _WORD.findall(text)
    return text.replace(" ", "\0 ").split("\0")[1:]


class _Lattice:
    """All segmentations of a word: edges into each place, and the log of the mass of all paths to it."""

    __slots__ = ("edges", "mass", "back", "best", "paths")

    def __init__(self, edges: list[list[tuple[int, int, float]]]) -> None:
        self.edges = edges
        n = len(edges)
        mass, best, back, paths = [0.0] * n, [0.0] * n, [(0, 0, 0.0)] * n, [1] * n
        for j in range(1, n):
            top, total = -math.inf, -math.inf
            values = []
            count = 0
            for e in edges[j]:
                i, _, w = e
                values.append(mass[i] + w)
                count += paths[i]
                if best[i] + w > top:
                    top, back[j] = best[i] + w, e
            total = max(values)
            mass[j] = total + math.log(sum([math.exp(v - total) for v in values])) if len(values) > 1 else total
            best[j] = top
            paths[j] = min(count, 1 << 30)
        self.mass, self.best, self.back, self.paths = mass, best, back, paths[-1]

    def viterbi(self) -> tuple[int, ...]:
        out, j = [], len(self.edges) - 1
        while j:
            j, piece, _ = self.back[j]
            out.append(piece)
        return tuple(reversed(out))

    def every(self) -> list[tuple[tuple[int, ...], float]]:
        """All segmentations with their log probabilities."""
        into: list[list[tuple[tuple, float]]] = [[((), 0.0)]]  # of each place: the last piece before it, linked to those before that
        for edges in self.edges[1:]:
            into.append([((before, p), lp + w) for i, p, w in edges for before, lp in into[i]])
        out = []
        for link, lp in into[-1]:
            pieces = []
            while link:
                link, p = link
                pieces.append(p)
            out.append((tuple(reversed(pieces)), lp - self.mass[-1]))
        return sorted(out)

    def sample(self, draw, but_best: bool) -> tuple[tuple[int, ...], float]:
        """A segmentation by its probability, other than the best if so asked, and its log probability."""
        out, j, total, on_best = [], len(self.edges) - 1, 0.0, but_best
        mass, best = self.mass, self.best
        while j:
            edges = self.edges[j]
            if on_best:  # what is left at a place on the best path is all its mass but the best path's own
                b = self.back[j]
                share = [math.exp(mass[i] + w - mass[j]) * (-math.expm1(min(0.0, best[i] - mass[i])) if (i, p, w) == b else 1.0) for i, p, w in edges]
            else:
                share = [math.exp(mass[i] + w - mass[j]) for i, _, w in edges] if len(edges) > 1 else [1.0]
            u, k = draw() * sum(share), 0
            while k < len(share) - 1 and (u >= share[k] or share[k] == 0.0):
                u -= share[k]
                k += 1
            if share[k] == 0.0:
                k = max(range(len(share)), key=share.__getitem__)
            i, piece, w = edges[k]
            on_best = on_best and edges[k] == b
            total += w
            out.append(piece)
            j = i
        return tuple(reversed(out)), total - mass[-1]


#: What is left of a 64-bit hash is a place in a table of 2^18.
_SHIFT = np.uint64(46)
_MULT, _GOLD = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0x9E3779B97F4A7C15)
#: A set of segmentations of a share of its word's mass under this is taken as empty (single precision ends there).
_LEAST = 1e-6
#: Words up to so many characters are segmented all together, in tables of that width; longer ones alone.
_WIDTHS = (6, 9, 13, 20, 32)
#: Words of each width whose tables a worker keeps.
_ROWS = {6: 8_000, 9: 10_000, 13: 5_000, 20: 1_000, 32: 300}


def _uniform(seed: np.ndarray, step: int) -> np.ndarray:
    """Numbers between 0 and 1, by seed and step alone (splitmix64)."""
    x = seed + np.uint64((step + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _uniform_of(seed: int, step: int) -> float:
    """_uniform of one seed."""
    x = seed + (step + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return ((x ^ x >> 31) >> 11) * 2.0**-53


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))


def _prefixes(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many of the first of each row, one row after the other."""
    return np.concatenate([row[:m] for row, m in zip(rows, counts.tolist())])


class _Store:
    """Tables of the words met so far of one width; emptied when full."""

    def __init__(self, width: int, most: int) -> None:
        self.width, self.most, self.rows, self.at = width, most, _ROWS[width], {}
        self._make()

    def _make(self) -> None:
        places, rows, most = self.width + 1, self.rows, self.most
        self.arrays = np.zeros((places, rows, most), np.float32), np.zeros((most, places, rows), np.int32), np.zeros(rows, np.float32), np.zeros(rows, np.int64)

    def places(self, pieces: "Pieces", words: list[str]) -> list[int]:
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > self.rows:
            self.at, new = {}, list(words)
            if len(new) > self.rows:  # for texts of so many words at once
                self.rows = 2 * len(new)
                self._make()
        if new:
            new.sort(key=len, reverse=True)
            first = len(self.at)
            part = slice(first, first + len(new))
            share, ids, mass, _ = self.arrays
            mass[part] = pieces._tables(new, self.width, share, ids, first)
            self.arrays[3][part] = np.fromiter(map(len, new), np.int64, len(new))
            self.at.update(zip(new, range(first, first + len(new))))
        return list(map(self.at.__getitem__, words))


class _Words:
    """The distinct words of some texts, with the tables of their lattices by width."""

    def __init__(self, pieces: "Pieces", parts: list[list[str]]) -> None:
        number: dict[str, int] = defaultdict(itertools.count().__next__)
        self.word = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        self.words = list(number)
        size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.width, self.place = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        self.tables, self.long, low = {}, {}, 0
        for width in _WIDTHS:
            own = np.flatnonzero((size > low) & (size <= width))
            low = width
            if len(own):
                store = pieces.stores.get(width)
                if store is None:
                    store = pieces.stores[width] = _Store(width, min(width, pieces.longest))
                self.width[own], self.place[own] = width, store.places(pieces, [self.words[i] for i in own.tolist()])
                self.tables[width] = store.arrays
        self.steps = int(size[self.width > 0].max(initial=1))


class Pieces:
    """The lattice of a SentencePiece vocabulary with byte fallback, weighted by rank (Zipf), and its decoding.

    The vocabulary's scores are merge ranks, no probabilities; a piece of rank r weighs 1 / (r + 10) to the power alpha.
    """

    def __init__(self, model: bytes, alpha: float = ALPHA) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.byte = {}
        self.ids: dict[str, tuple[int, float]] = {}
        self.text: list[bytes] = [b""] * n
        first = 0
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:-1], 16)] = i
                self.text[i] = bytes([int(sp.id_to_piece(i)[3:-1], 16)])
                first = i + 1
        self.rare = -alpha * math.log(n + 10)
        for i in range(n):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                p = sp.id_to_piece(i).replace(_SPACE, " ")
                self.text[i] = p.encode()
                if not re.search("[^ ] ", p):  # it would go beyond a word
                    self.ids[p] = (i, -alpha * math.log(max(0, i - first) + 10))
        self.bytes = pa.array(self.text, pa.binary())
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        self.longest = max(map(len, self.ids))
        self.ascii = np.array([self.byte[i] for i in range(128)], np.int32)
        self.kept = np.array([i for i, _ in self.ids.values()], np.int32)
        self.kept_weight = np.array([w for _, w in self.ids.values()], np.float32)
        self.by_id = np.full(n + 0x10001, self.rare, np.float64)  # log weights; from the end, of characters outside the vocabulary
        self.by_id[self.kept] = self.kept_weight
        self.by_id[-0x800:], self.by_id[-0x10000:-0x800], self.by_id[-0x10001] = 2 * self.rare, 3 * self.rare, 4 * self.rare
        self.hashes = np.array([self._hash(p) for p in self.ids], np.uint64)
        self.stores: dict[int, _Store] = {}
        self.slots, rest = [], np.arange(len(self.hashes))
        for mult in (_GOLD, np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)):
            if len(rest):
                table, slot = np.full(1 << 18, -1, np.int32), (self.hashes[rest] * mult) >> _SHIFT
                table[slot[::-1]] = rest[::-1]
                self.slots.append((table, mult))
                rest = rest[table[slot] != rest]
        if len(rest) or len(set(self.hashes.tolist())) < len(self.hashes):
            raise ValueError("pieces' hashes collide")
        self.short = np.full(257 + 257 * 257, -1, np.int32)  # number of each piece of one or two characters, all below 255, by these plus one
        self.short[256], self.short[257:].reshape(257, 257)[256], self.short[257:].reshape(257, 257)[:, 256] = -2, -2, -2
        for i, p in enumerate(self.ids):
            if len(p) <= 2 and max(p) < "\xff":
                c = [ord(x) + 1 for x in p]
                self.short[c[0] if len(c) == 1 else 257 + c[0] * 257 + c[1]] = i
        self.lattices: dict[str, _Lattice] = {}

    def lattice(self, word: str) -> _Lattice:
        found = self.lattices.get(word)
        if found is None:
            ids, longest = self.ids, self.longest
            edges: list[list[tuple[int, int, float]]] = [[]]
            more = {}
            for j in range(1, len(word) + 1):
                here = [(i, *p) for i in range(max(0, j - longest), j) if (p := ids.get(word[i:j]))]
                if word[j - 1] not in ids:  # its bytes, one after the other, as one edge; unfolded in unfold()
                    c = ord(word[j - 1])
                    here.append((j - 1, -c - 1 if c > 127 else self.byte[c], self.rare * len(word[j - 1].encode("utf-8", "surrogatepass"))))
                edges.append(here)
            found = _Lattice(edges)
            if len(word) <= 64:
                if len(self.lattices) >= _LATTICES:
                    self.lattices.clear()
                self.lattices[word] = found
        return found

    def forget(self) -> None:
        """Drop what is kept of words met, for an idle worker to be small; it can be made again at any time."""
        self.lattices, self.stores = {}, {}

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_MULT) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def unfold(self, pieces: list[int]) -> list[int]:
        """Piece ids with characters outside the vocabulary as their bytes'."""
        if not pieces or min(pieces) >= 0:
            return pieces
        return [x for p in pieces for x in ([p] if p >= 0 else [self.byte[b] for b in chr(-p - 1).encode("utf-8", "surrogatepass")])]

    def _short(self, key: np.ndarray, h: np.ndarray) -> np.ndarray:
        """_lookup for one or two characters, by their places in self.short; -2 there stands for what has others in it."""
        out = self.short.take(key)
        other = np.flatnonzero(out == -2)
        if len(other):
            out[other] = self._lookup(h.take(other))
        return out

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        """Number in self.kept of each hash, -1 if it is no piece's."""
        table, mult = self.slots[0]
        out = table.take(((h * mult) >> _SHIFT).view(np.int64))
        taken = np.flatnonzero(out >= 0)  # an empty slot has turned nothing away
        other = taken[self.hashes.take(out.take(taken)) != h.take(taken)]
        out[other] = -1
        for table, mult in self.slots[1:]:
            at = table[(h[other] * mult) >> _SHIFT]
            hit = (at >= 0) & (self.hashes[at] == h[other])
            out[other[hit]] = at[hit]
            other = other[(at >= 0) & ~hit]
        return out

    def _tables(self, words: list[str], width: int, share: np.ndarray, ids: np.ndarray, first: int) -> np.ndarray:
        """For words of up to `width` characters, written to share and ids in rows from `first` on: into each place, by length of the piece, the cumulative chance
        (places x rows x lengths) and the piece (lengths x places x rows; of what is no piece it may be anything). Returned: the log of all segmentations' mass of each word."""
        n, rows, most = len(words), share.shape[1], min(width, self.longest)
        size = np.fromiter(map(len, words), np.int64, n)  # longest first, so that the words that reach a place come first
        chars = np.zeros((n, width), np.uint64)
        chars[np.arange(width) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint64(1)  # so that no character is zero
        chars = np.ascontiguousarray(chars.T)
        low = np.minimum(chars, 256).astype(np.int64)
        weight = np.full((most, width + 1, n), -np.inf, np.float32)
        flat_weight, flat_ids = weight.reshape(-1), ids.reshape(-1)
        reach = np.searchsorted(-size, -np.arange(width + 2), side="right")  # words of so many characters or more
        reached, longest, h = reach.tolist(), 1, chars  # h: of the piece so far, by its start
        for length in range(1, most + 1):
            if not reached[length]:
                break
            if length > 1:
                h = h[:-1] * _MULT
                h += chars[length - 1 :]
            counts = reach[length : width + 1]  # words that have a piece of this length, by its start
            own = _prefixes(h, counts)
            if length > 2:
                found = self._lookup(own)
            else:
                found = self._short(_prefixes(low if length == 1 else low[:-1] * 257 + low[1:] + 257, counts), own)
            before = np.cumsum(counts) - counts
            end = np.arange(length, width + 1)
            to_weight, to_ids = ((length - 1) * (width + 1) + end) * n - before, ((length - 1) * (width + 1) + end) * rows + first - before
            start = np.repeat(np.arange(len(counts)), counts)
            at = np.flatnonzero(found >= 0)
            if len(at):
                hit, i, longest = found.take(at), start.take(at), length
                flat_weight[to_weight.take(i) + at] = self.kept_weight.take(hit)
                flat_ids[to_ids.take(i) + at] = self.kept.take(hit)
            if length == 1 and len(at) < len(found):  # characters outside the vocabulary: their bytes as one edge, unfolded later
                at = np.flatnonzero(found < 0)
                i, c = start.take(at), own.take(at).astype(np.int64) - 1
                flat_ids[to_ids.take(i) + at] = np.where(c < 128, self.ascii[c & 127], -c - 1)
                flat_weight[to_weight.take(i) + at] = self.rare * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        mass = np.zeros((width + 1, n), np.float32)
        for j in range(1, width + 1):
            r, m = reached[j], min(j, longest)  # no piece is longer
            if not r:
                break
            v = mass[j - m : j, :r][::-1] + weight[:m, j, :r]
            top = v.max(axis=0)
            v -= top
            np.exp(v, out=v)
            for i in range(1, m):  # running sums, row by row
                v[i] += v[i - 1]
            mass[j, :r] = top + np.log(v[-1])
            v /= v[-1].copy()
            own = share[j, first : first + r]
            own[:, :m], own[:, m:] = v.T, 2.0
        return mass[size, np.arange(n)]

    def _draw(self, group: "_Words", tokens: np.ndarray, seeds: np.ndarray, out: np.ndarray, count: np.ndarray, logp: np.ndarray) -> None:
        """Segment each of the tokens by its word's lattice, last piece first into out, with its number of pieces and log probability."""
        word = group.word.take(tokens)
        wide = group.width.take(word)
        for width, (share, ids, mass, size) in group.tables.items():
            own = np.flatnonzero(wide == width)
            t, w = tokens.take(own), group.place.take(word.take(own))
            rows, most = share.shape[1:]
            share, ids = share.reshape(-1, most), ids.reshape(-1)
            j, step, seed, total, row = size.take(w), 0, seeds.take(t), -mass.take(w).astype(np.float64), w
            while len(t):
                here = row + j * rows
                passed = share.take(here, axis=0) <= np.minimum(_uniform(seed, step), 0.9999999)[:, None].astype(np.float32)
                k = np.minimum(np.einsum("ij->i", passed.view(np.uint8)).astype(np.int64), np.minimum(j, most) - 1)
                piece = ids.take(k * (rows * (width + 1)) + here)
                out[step][t] = piece
                total += self.by_id.take(np.maximum(piece, -0x10001), mode="wrap")
                j -= k
                j -= 1
                step += 1
                ended = j <= 0
                done = np.flatnonzero(ended)
                if len(done):  # what goes on is kept together
                    own, go = t.take(done), np.flatnonzero(~ended)
                    logp[own], count[own] = total.take(done), step
                    t, row, j, seed, total = (x.take(go) for x in (t, row, j, seed, total))
        for i in tokens[wide == 0].tolist():  # words too long for the tables
            rng = np.random.Generator(np.random.SFC64(int(seeds[i])))
            seg, lp = self.lattice(group.words[group.word[i]]).sample(rng.random, False)
            group.long[i], logp[i], count[i] = seg, lp, len(seg)

    def sample(self, texts: list[str], k: int, seeds: list[int]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """Of each text up to k distinct segmentations: (ids, log probability, perturbed value, chance of inclusion), greatest value first.

        Gumbel top-k: each segmentation's log probability plus its own Gumbel noise; the k greatest are a sample without
        replacement. They are found best first, by A*. A node of the search is a set of segmentations that agree up to a word
        and there have none of some; its bound, the greatest perturbed value in it, is drawn from the set's whole mass, under
        the value of the node it was split from, and so is exact: the search never backs up. When a node comes first, its best
        member is drawn, and the rest of it is split by the word at which it first differs. The texts take their steps together.
        The chance of inclusion is 1 - exp(-exp(log probability - threshold)), the threshold being the (k + 1)-th value; 1 where all were emitted.
        """
        parts = [_split(" " + t) for t in texts]
        if not parts:
            return []
        group = _Words(self, parts)
        total, first = len(group.word), np.cumsum([0] + [len(p) for p in parts])
        key, number = np.array(seeds, np.uint64), np.arange(len(texts))
        own = np.repeat(number, np.diff(first))
        place = (np.arange(total) - first[own]).astype(np.uint64)
        roots = _gumbel(_uniform(key, 1 << 20))
        heaps = [[(-float(g), 0, 0, None, {})] for g in roots]
        found: list[list[tuple[int, float, float]]] = [[] for _ in texts]  # of each text: turn, log probability, value
        turns: list[tuple] = []
        for turn in range(k):
            popped = {d: heapq.heappop(h) for d, h in enumerate(heaps) if h}
            at, value, extra = np.zeros(len(texts), np.int64), np.full(len(texts), -np.inf), np.zeros(total)
            for d, node in popped.items():
                value[d], at[d] = -node[0], node[2]
                if node[4]:
                    extra[first[d] + node[2]] = sum(map(math.exp, node[4].values()))
            live = value > -np.inf
            fresh = live[own] & (place >= at.astype(np.uint64)[own])
            out, count, logp = np.empty((group.steps, total), np.int32), np.zeros(total, np.int64), np.zeros(total)
            group.long = {}
            seed = key[own] + (place + np.uint64(turn) * np.uint64(1 << 40) + np.uint64(1 << 60)) * _GOLD
            self._draw(group, np.flatnonzero(fresh), seed, out, count, logp)
            for d, (_, _, w, parent, barred) in popped.items():
                if parent is None:
                    continue
                a, i = first[d], first[d] + w  # it agrees with the node's origin before the word
                p_out, p_count, p_logp, p_long = turns[parent]
                out[:, a:i], count[a:i], logp[a:i] = p_out[:, a:i], p_count[a:i], p_logp[a:i]
                group.long |= {j: s for j, s in p_long.items() if a <= j < i}
                seg, lp = self._other(group.words[group.word[i]], barred, int(seed[i]))
                logp[i], count[i] = lp, len(seg)
                if group.width[group.word[i]]:
                    out[: len(seg), i] = seg[::-1]
                else:
                    group.long[i] = seg
            turns.append((out, count, logp, group.long))
            cum = np.cumsum(logp)
            base = np.concatenate([[0.0], cum])[first]
            for d in popped:
                found[d].append((turn, float(base[d + 1] - base[d]), float(value[d])))
            # the sets that differ from it first at each word
            left = 1 - np.exp(np.minimum(logp, 0.0)) - extra
            some = fresh & (left > _LEAST)
            phi = cum - logp - base[own] + np.log(np.where(some, left, 1.0))
            top = np.where(live, value, 0.0)[own]
            bound = np.where(some, top - np.log1p(np.exp(np.minimum(top - phi - _gumbel(_uniform(seed, 1 << 21)), 700.0))), -np.inf)
            for nth in range(k - turn):
                best = np.maximum.reduceat(bound, first[:-1])
                places = np.flatnonzero((bound == best[own]) & (bound > -np.inf))
                for i in places[np.concatenate([[True], np.diff(own[places]) > 0])].tolist() if len(places) else []:
                    d = int(own[i])
                    w = int(i - first[d])
                    bars = dict(popped[d][4]) if w == at[d] else {}
                    bars[group.long[i] if i in group.long else tuple(out[: count[i], i][::-1].tolist())] = float(logp[i])
                    if (len(bars) == 1 and left[i] > 1e-3) or len(bars) < self.lattice(group.words[group.word[i]]).paths:
                        heapq.heappush(heaps[d], (-float(bound[i]), turn * k + nth + 1, w, turn, bars))
                    bound[i] = -np.inf
        flat = [self._flat(t, first) for t in turns]
        result = []
        for d, got in enumerate(found):
            limit = -heaps[d][0][0] if heaps[d] else -math.inf
            result.append([(flat[turn][d], whole, v, 1.0 if limit == -math.inf else -math.expm1(-math.exp(min(700.0, whole - limit)))) for turn, whole, v in got])
        return result

    def _other(self, word: str, barred: dict, seed: int) -> tuple[tuple[int, ...], float]:
        """A segmentation of a word by its probability among those not barred."""
        lattice = self.lattice(word)
        if lattice.paths <= 64:
            segs = [s for s in lattice.every() if s[0] not in barred]
            p = np.exp([lp for _, lp in segs])
            return segs[min(int((np.cumsum(p) / p.sum() <= _uniform_of(seed, 1 << 22)).sum()), len(segs) - 1)]
        rng = np.random.Generator(np.random.SFC64(seed))
        while True:
            seg, lp = lattice.sample(rng.random, lattice.viterbi() in barred)
            if seg not in barred:
                return seg, lp

    def _flat(self, turn: tuple, first: np.ndarray) -> list[np.ndarray]:
        """Each text's ids in order, characters outside the vocabulary as their bytes'."""
        out, count, _, long = turn
        short = count.copy()
        short[list(long)] = 0
        most = int(short.max(initial=1))
        ends = np.concatenate([[0], np.cumsum(short)])
        ids, left = np.empty(ends[-1], np.int32), np.flatnonzero(short)
        last, more = ends.take(left + 1), short.take(left)
        for step in range(most):  # the last piece was drawn first
            last -= 1
            ids[last] = out[step].take(left)
            go = np.flatnonzero(more > step + 1)
            left, last, more = left.take(go), last.take(go), more.take(go)
        flat = [ids[ends[a] : ends[b]] for a, b in zip(first[:-1], first[1:])]
        for d in sorted({int(np.searchsorted(first, i, side="right")) - 1 for i in long}):
            flat[d] = np.array([x for t in range(first[d], first[d + 1]) for x in (long[t] if t in long else ids[ends[t] : ends[t + 1]].tolist())], np.int32)
        return [np.array(self.unfold(f.tolist()), np.int32) if len(f) and f.min() < 0 else f for f in flat]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: what sample() was given, for each of its segmentations."""
        return b"".join(map(self.text.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")

    def decodes(self, ids: np.ndarray, text: str) -> bool:
        """Whether decode(ids) is the text: all bytes are decoded and compared, some pieces at a time."""
        want, at = (" " + text).encode("utf-8", "surrogatepass"), 0
        for s in range(0, len(ids), 1 << 16):
            got = self.bytes.take(pa.array(ids[s : s + (1 << 16)])).buffers()[2].to_pybytes()
            if want[at : at + len(got)] != got:
                return False
            at += len(got)
        return at == len(want)


_loaded: dict[tuple[int, float], Pieces] = {}


def _pieces(model: bytes, alpha: float) -> Pieces:
    key = (xxhash.xxh64_intdigest(model), alpha)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model, alpha)
    return _loaded[key]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver; its bytes go with the tasks
        return f.read()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, samples: int = SAMPLES, alpha: float = ALPHA, verify: bool = True) -> DataFrame:
    """docs' id (as string key) with `samples`, an array of (pieces, log_prob, perturbed, inclusion), and `exact`, for each row.

    Segmentations are distinct, the greatest perturbed value first, and seeded by the row's id alone: the same id and text
    give the same samples in any layout. `exact` tells that each decodes to the whole text (null with `verify` off). An empty text is one space's
    piece; a null text has no samples and `exact` null. Rows of a null id are seeded as the id of no characters; rows that repeat
    an id are sampled alike. Words of one segmentation give fewer samples than asked for. No rows give no rows.
    """
    proto = _model(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(proto, alpha)
        for b in batches:
            ids, n, at = b.column(0).to_pylist(), b.num_rows, 0
            while at < n:
                texts, held = [], 0
                while at + len(texts) < n and held < _CHARS:
                    texts.append(b.column(1)[at + len(texts)].as_py())
                    held += len(texts[-1] or "")
                own = ids[at : at + len(texts)]
                at += len(texts)
                real = [i for i, t in enumerate(texts) if t is not None]
                got = dict(zip(real, pieces.sample([texts[i] for i in real], samples, [xxhash.xxh64_intdigest((own[i] or "").encode(), 17) for i in real])))
                rows = [x for i in range(len(texts)) for x in got.get(i, [])]
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x[0]) for x in rows]), pa.int32()), pa.array(np.concatenate([x[0] for x in rows]) if rows else [], pa.int32()))
                inner = pa.StructArray.from_arrays([flat, *(pa.array([x[f] for x in rows], pa.float64()) for f in (1, 2, 3))], ["pieces", "log_prob", "perturbed", "inclusion"])
                ends = np.cumsum([0] + [len(got.get(i, [])) for i in range(len(texts))])
                nulls = [None if texts[i] is None else int(ends[i]) for i in range(len(texts))] + [int(ends[-1])]
                exact = [all(pieces.decodes(x[0], t) for x in got[i]) if verify and t is not None else None for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.ListArray.from_arrays(pa.array(nulls, pa.int32()), inner), pa.array(exact, pa.bool_())], ["key", "samples", "exact"])
        pieces.forget()

    schema = "key string, samples array<struct<pieces:array<int>,log_prob:double,perturbed:double,inclusion:double>>, exact boolean"
    return docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def decode(encoded: DataFrame, pieces_col: str = "pieces", model: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """encoded with `decoded`, the text of an array of piece ids; null for null. A column of that name is replaced."""
    proto = _model(model)

    @F.pandas_udf("string")
    def text(ids):  # a pandas series of arrays
        p = _pieces(proto, alpha)
        return ids.map(lambda x: None if x is None else p.decode(list(x)))

    return encoded.withColumn("decoded", text(F.col(pieces_col)))

"""Toxicity by lexicon induction: random walks from labelled seed terms over a word graph of positive pointwise mutual information."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import drop_tables, lean, small, table, written
from vellumine.llm.labelled import labels_of, prior_shift, rates, thin

#: A word or stem is a node if it is in this share of the documents and in LEAST of them, or if the labels speak of it whatever its
#: share: it is in LABELLED labelled documents and the signed root of its log-likelihood ratio is at least EVIDENCE, either way.
SHARE, LEAST, LABELLED, EVIDENCE = 0.001, 10, 3, 2.5
#: Words of LONG letters and more also have a stem, their first STEM letters; it stands in for a word that is no node itself.
LONG, STEM = 8, 6
#: Seeds: signed root of the log-likelihood ratio and odds ratio, at least; steps of the walk and the chance to go on.
SEED_Z, SEED_ODDS, STEPS, ON = 4.0, 5.0, 8, 0.5
#: Labelled documents of each label, at most, on whose lexicon figures the last weights are fitted.
TRAIN_ROWS = 4000
_WORD = re.compile(r"[^\W\d_]+")
#: Of UTF-8: ASCII bytes that are no letters become spaces.
_SPACED = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))
#: Distinct word pairs that a task holds before it hands them on; of words, a quarter.
_HELD = 3 << 20


def tokens(text: str | None) -> list[str]:
    """The runs of _WORD in lower case. Splitting at spaces, which other characters become first, is faster than the pattern."""
    if not text:
        return []
    low = text.lower()
    if not low.isascii():
        other = [c for c in set(low) if not c.isascii() and not _WORD.match(c)]
        if len(other) > 16:
            return _WORD.findall(low)
        for c in other:
            low = low.replace(c, " ")
    return low.encode().translate(_SPACED).decode().split()


def _terms(text: str | None) -> set[str]:
    """The distinct words of a text and the stems of the long ones, marked by a star."""
    own = set(tokens(text))
    own.update([w[:STEM] + "*" for w in own if len(w) >= LONG])
    return own


class _Index(dict):
    """Of nodes' values: a word's own, else its stem's, else None; what was looked up is kept, up to a bound."""

    def __init__(self, values: dict, none=None) -> None:
        super().__init__(values)
        self.values_, self.none = values, none

    def __missing__(self, word: str):
        found = self.values_.get(word[:STEM] + "*", self.none) if len(word) >= LONG else self.none
        if len(self) > len(self.values_) + 200_000:
            self.clear()
            self.update(self.values_)
        self[word] = found
        return found


def _document_counts(docs: DataFrame) -> DataFrame:
    """docs (t, label) -> (word, n, toxic, clean): documents that hold the word or stem; the word '' counts all documents."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(every: Counter, by: dict[int, Counter]) -> pa.RecordBatch:
            w = list(every)
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), *(pa.array([c[x] for x in w], pa.int64()) for c in (every, by[1], by[0]))], ["word", "n", "toxic", "clean"])

        every, by = Counter(), {0: Counter(), 1: Counter()}
        for b in batches:
            for t, label in zip(b.column(0), b.column(1).to_pylist()):
                own = set(tokens(t.as_py()))
                own.add("")
                every.update(own)
                if label is not None:
                    by[label].update(own)
            if len(every) > _HELD // 4:
                yield rows(every, by)
                every, by = Counter(), {0: Counter(), 1: Counter()}
        yield rows(every, by)

    return docs.select("t", "label").mapInArrow(run, "word string, n long, toxic long, clean long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "clean")])


def _pair_counts(docs: DataFrame, index: dict[str, int]) -> DataFrame:
    """docs (t) -> (i, j, n): how often node j is next to node i, either way; each task sums its own pairs first."""
    v = len(index)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at_word = _Index(index, -1).__getitem__

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, counts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(codes)
            codes = codes[order]
            counts = counts[order]
            del order
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
            return codes[first], np.add.reduceat(counts, first) if len(codes) else counts

        for b in batches:
            for at in range(0, b.num_rows, 256):
                seq: list[int] = []
                for t in b.column(0).slice(at, 256):
                    seq += map(at_word, tokens(t.as_py()))
                    seq.append(-1)
                s = np.array(seq, np.int64)
                ok = (s[:-1] >= 0) & (s[1:] >= 0) & (s[:-1] != s[1:])
                x, y = s[:-1][ok], s[1:][ok]
                held.append(np.unique(np.minimum(x, y) * v + np.maximum(x, y), return_counts=True))
                if sum(len(c) for c, _ in held) > _HELD:
                    held.append(merged())
                    if len(held[0][0]) > _HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["code", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["code", "n"])

    sums = docs.select("t").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return _both(table(sums.select(F.expr(f"cast(code div {v} as int)").alias("i"), F.expr(f"cast(code % {v} as int)").alias("j"), "n"), "pairs"), "n")


def _both(pairs: DataFrame, *values: str) -> DataFrame:
    """Each pair either way."""
    return pairs.select("i", "j", *values).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), *values))


def _edges(pairs: DataFrame) -> DataFrame:
    """pairs (i, j, n), each either way -> (i, j, p): chance that the walk goes from i to j, in proportion to positive pointwise mutual information.

    Each pair is weighed and written once; what goes out of a node is joined from a row for each node.
    """
    ends = pairs.groupBy("i").agg(F.sum("n").alias("m"))  # a row for each node
    total = ends.agg(F.sum("m")).first()[0] or 1
    both = pairs.where("i < j").join(small(ends), "i").join(small(ends.select(F.col("i").alias("j"), F.col("m").alias("mj"))), "j")
    w = table(both.select("i", "j", F.log(F.col("n") * F.lit(float(total)) / (F.col("m").cast("double") * F.col("mj"))).alias("w")).where("w > 0"), "graph")
    out = _both(w, "w").groupBy("i").agg(F.sum("w").alias("out"))
    return _both(w, "w").join(small(table(out, "out")), "i").select("i", "j", (F.col("w") / F.col("out")).alias("p"))


def walk(edges: DataFrame, seeds: list[np.ndarray], steps: int = STEPS, on: float = ON) -> list[np.ndarray]:
    """For each start distribution over the nodes, where a walk with restarts stands after so many steps."""
    spark, state = edges.sparkSession, list(seeds)
    for _ in range(steps):
        now = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(zip(*state))], ["i", *(f"s{k}" for k in range(len(state)))])
        moved = edges.join(small(now), "i").groupBy("j").agg(*[F.sum(F.col("p") * F.col(f"s{k}")).alias(f"s{k}") for k in range(len(state))])
        new = [np.zeros(len(s)) for s in seeds]
        for r in moved.collect():  # a row for each node
            for k in range(len(state)):
                new[k][r.j] = r[f"s{k}"]
        state = [on * n + (1 - on) * s for n, s in zip(new, seeds)]
    return state


@dataclass
class Lexicon:
    polarity: _Index  # -1 (as in clean documents) to 1 (toxic)
    weights: np.ndarray  # of figures(), the intercept first
    centre: np.ndarray
    scale: np.ndarray


#: Bands of polarity whose words are counted apart, from the most toxic down.
BANDS = (0.9, 0.7, 0.4)


def figures(polarity: _Index, text: str | None) -> list[float]:
    """Of the text's words in the lexicon: whether and how often one is in each band, those of the last negative band, the mean."""
    got = [p for p in map(polarity.__getitem__, tokens(text)) if p is not None]
    a = np.array(got)
    over = [int(np.count_nonzero(a > b)) for b in BANDS]
    low = [over[0], *(y - x for x, y in zip(over, over[1:]))]
    return [float(low[0] > 0), *(float(np.log1p(x)) for x in low), int(np.count_nonzero(a < -BANDS[-1])) / max(1, len(got)), sum(got) / max(1, len(got))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.diag([0, *[1.0] * (x.shape[1] - 1)])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * np.array([0, *w[1:]]))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _root_g2(a: np.ndarray, b: np.ndarray, na: float, nb: float) -> np.ndarray:
    """Signed root of the log-likelihood ratio of a of na against b of nb: about normal if the shares are equal."""
    term = lambda k, e: k * np.log(np.maximum(k, 1e-12) / np.maximum(e, 1e-12))
    share = (a + b) / (na + nb)
    g = 2 * (term(a, na * share) + term(na - a, na * (1 - share)) + term(b, nb * share) + term(nb - b, nb * (1 - share)))
    return np.sign(a / na - b / nb) * np.sqrt(np.maximum(g, 0))


def _evident(toxic: float, clean: float) -> Column:
    """Whether (toxic, clean) labelled documents of a word, of so many in all, are LABELLED and tell the labels apart: _root_g2 in SQL."""
    a, b, na, nb = F.col("toxic").cast("double"), F.col("clean").cast("double"), float(toxic), float(clean)
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    share = (a + b) / (na + nb)
    g = 2 * (term(a, na * share) + term(na - a, na * (1 - share)) + term(b, nb * share) + term(nb - b, nb * (1 - share)))
    return (a + b >= LABELLED) & (g >= EVIDENCE**2)


def induce(docs: DataFrame) -> tuple[dict[str, float], int]:
    """docs (t, label null or 0/1) -> polarity of each node word, and the number of toxic seeds."""
    top = docs.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean")).first()
    if not top.toxic or not top.clean:
        return {}, 0
    node = (F.col("n") >= max(LEAST, SHARE * top.n)) | _evident(top.toxic, top.clean)
    kept = {r.word: r for r in _document_counts(docs).where(node & (F.col("word") != "")).collect()}
    kept = [kept[w] for w in sorted(kept)]
    words = [r.word for r in kept]
    a, b = np.array([r.toxic for r in kept], float), np.array([r.clean for r in kept], float)
    odds = np.log((a + 0.5) / (top.toxic - a + 0.5)) - np.log((b + 0.5) / (top.clean - b + 0.5))
    z = _root_g2(a, b, top.toxic, top.clean)
    bad = (z >= SEED_Z) & (odds >= np.log(SEED_ODDS))
    if not bad.any():  # few labels: the words that speak most for toxic
        bad = (z >= SEED_Z / 2) & (odds >= np.log(SEED_ODDS))
    good = (z < 0) & ~bad
    if not bad.any() or not good.any():
        return {}, 0
    starts = [np.where(bad, z, 0.0), np.where(good, a + b + 1, 0.0)]
    starts = [s / s.sum() for s in starts]
    since = written()
    edges = _edges(_pair_counts(docs, {w: i for i, w in enumerate(words)}))
    toxic, clean = walk(edges, starts)
    drop_tables(since)  # of the graph nothing is read any more
    # where a walk from everywhere alike would be about: rare words lean less on a chance neighbour, common ones not by being common
    base = np.array([r.n for r in kept], float)
    base /= base.sum()
    lift = np.log((toxic + base) / (clean + base))
    return dict(zip(words, np.tanh(lift / 2).tolist())), int(bad.sum())


def scorer(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS):
    """A function from a text column to the probability that a text is toxic.

    All documents give the word graph; labels for which `keep` (a condition on the labels' columns) holds give seeds and, on
    about `rows` documents of each label drawn by a hash of the id, the weights of the lexicon's figures of a text, the intercept for the labels' shares among all of them. With no
    label, one kind of label or no seed, each score is the share of toxic labels (0 without any) and the graph isn't built.
    Null and empty texts score as texts without a word of the lexicon. Labels of null ids or other than 0 and 1 are left out;
    rows that repeat an id or have a null id count like any other.
    """
    known = labels_of(labels, id_col, label_col, keep)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    marked = own.join(small(known), F.col("id") == F.col("__id"), "left").select("id", "t", F.col("__label").alias("label"))
    polarity, _ = induce(marked)
    polarity = _Index(polarity)
    prior = float(known.agg(F.avg("__label")).first()[0] or 0.0)
    if not polarity:
        return lambda text: F.lit(prior)
    shares = rates(known, rows, F.col("__label"))
    picked = F.broadcast(thin(known, "__id", rows, F.col("__label"), shares))  # twice `rows` and a few

    @lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [figures(polarity, t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f, pa.list_(pa.float64()))], ["id", "y", "f"])

    got = own.join(picked, F.col("id") == F.col("__id")).select("id", "t", F.col("__label").alias("y")).mapInArrow(measure, "id long, y int, f array<double>").collect()
    got.sort(key=lambda r: (r.id, r.f))
    x, y = np.array([r.f for r in got]), np.array([r.y for r in got], float)
    if len(set(y.tolist())) < 2:
        return lambda text: F.lit(prior)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    lexicon = Lexicon(polarity, _logistic((x - centre) / scale, y), centre, scale)
    lexicon.weights[0] += prior_shift(shares)

    @F.pandas_udf("double")
    def probability(text: pd.Series) -> pd.Series:
        f = np.array([figures(lexicon.polarity, t) for t in text]).reshape(-1, len(lexicon.centre))
        z = lexicon.weights[0] + (f - lexicon.centre) / lexicon.scale @ lexicon.weights[1:]
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return lambda text: probability(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, score): scorer()'s probability for each row of docs. No rows give no rows; other columns play no part."""
    score = scorer(docs, labels, label_col, keep, id_col, text_col, rows)
    return docs.select(F.col(id_col).cast("long").alias("id"), score(F.col(text_col)).alias("score"))

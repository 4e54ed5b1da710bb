"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and word beginnings, hashed to a fixed space. The machine scores
w0 + sum w_i + sum over pairs <v_i, v_j>, so a pair such as an insult and a group's name can weigh what
neither weighs alone. It is fitted on a bounded sample of labelled rows of the training folds, in which a
class that was cut down weighs as much as all its rows.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import checkpointed, filter_texts, fold, lean, map_texts, pieces

#: Labelled rows of each class that the fit uses at most, those of the lowest id hash. The only bounded step.
SAMPLE_ROWS = 6000
BITS = 18
FACTORS = 4
#: Hashed terms that the fit keeps, by how far they tell the classes apart in the sample.
KEPT_TERMS = 3000
LEAST_ROWS = 3
EPOCHS = 80
FOLDS, HELD_OUT = 5, 0
#: Longer words are looked up each time instead of being kept.
WORD_BYTES_KEPT = 64
#: Letters of the word beginnings that are terms beside the words.
BEGINNINGS = (5, 7)

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def lower(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode()


def bucket(term: bytes) -> int:
    h = zlib.crc32(term)
    return (h ^ h >> 15) & (1 << BITS) - 1


def word_terms(word: bytes) -> tuple[int, ...]:
    """Buckets of a word: itself, and its beginnings where it is longer."""
    w = word.decode("utf-8", "replace")
    return (bucket(b"w" + word), *(bucket(b"p" + w[:n].encode()) for n in BEGINNINGS if len(w) > n))


class Terms:
    """Texts to distinct buckets; what words that aren't long map to is kept, up to a bound."""

    def __init__(self, wanted: np.ndarray | None = None):
        self.wanted = None if wanted is None else set(wanted.tolist())
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def of(self, text: bytes) -> set[int]:
        seen = self.seen
        if len(seen) > 300_000:
            seen.clear()
        words, long = set(WORDS.findall(lower(text))), []
        for w in words:
            if w not in seen:
                t = word_terms(w)
                t = t if self.wanted is None else tuple(x for x in t if x in self.wanted)
                if len(w) > WORD_BYTES_KEPT:
                    long.append((w, t))
                else:
                    seen[w] = t
        if long:
            words.difference_update(w for w, _ in long)
            return set(chain.from_iterable(map(seen.__getitem__, words))).union(*[t for _, t in long])
        return set(chain.from_iterable(map(seen.__getitem__, words)))


def best_cut(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The margin that parts the classes with the best F1 of weighted rows, halfway between two rows; 0 if there is but one class."""
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(-margin, kind="stable")
    m, hit = margin[order], np.cumsum((weight * y)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * y).sum())
    f1[:-1][m[:-1] == m[1:]] = 0  # equal margins stay together
    k = int(np.argmax(f1))
    return float(m[k] if k + 1 == len(m) else (m[k] + m[k + 1]) / 2)


def telling_terms(terms: np.ndarray, rows: np.ndarray, toxic: np.ndarray, n: int, n_toxic: float) -> np.ndarray:
    """The KEPT_TERMS terms at most, sorted, that tell the classes apart best; rows, toxic: how many rows, and toxic rows, hold each.

    By the log-likelihood ratio statistic of a term's presence, which holds for any mix of the classes.
    """
    p1, p0, p = (toxic + 0.5) / (max(n_toxic, 1) + 1), (rows - toxic + 0.5) / (max(n - n_toxic, 1) + 1), (rows + 1) / (n + 2)
    gain = np.where(rows >= LEAST_ROWS, toxic * np.log(p1 / p) + (rows - toxic) * np.log(p0 / p), -np.inf)
    best = np.argsort(-gain, kind="stable")[:KEPT_TERMS]
    return np.sort(terms[best[gain[best] > 3.0]])


class FactorizationMachine:
    """Binary classifier with pairwise interactions; presence features."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors

    @staticmethod
    def margin(rows: np.ndarray, cols: np.ndarray, n: int, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margins, per-row factor sums) of n rows given as (row, term) pairs sorted by row."""
        sums, squares = np.zeros((n, v.shape[1])), np.zeros(n)
        linear = np.bincount(rows, w[cols], n)
        for f in range(v.shape[1]):
            sums[:, f] = np.bincount(rows, v[cols, f], n)
        squares = np.bincount(rows, (v[cols] ** 2).sum(1), n)
        return bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums

    @classmethod
    def fit(cls, features: list[np.ndarray], y: np.ndarray, weight: np.ndarray | None = None, seed: int = 7, terms: np.ndarray | None = None) -> FactorizationMachine:
        """Adam on the logistic loss with L2; the order of rows and the seed fix the result.

        Loss, first bias and cut weigh the rows (None: alike). terms: the sorted buckets to use (None: telling_terms()).
        """
        n = len(features)
        weight = np.ones(n) if weight is None or not n else weight * (n / weight.sum())
        if n == 0:
            return cls(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
        sizes = np.array([len(x) for x in features], np.int64)
        every = np.concatenate(features) if sizes.sum() else np.zeros(0, np.int64)
        row_of = np.repeat(np.arange(n), sizes)
        if terms is None:
            found = np.unique(every)
            at = np.searchsorted(found, every)
            terms = telling_terms(found, np.bincount(at, minlength=len(found)).astype(float), np.bincount(at, y[row_of], len(found)), n, y.sum())
        at = np.searchsorted(terms, every)
        at[at == len(terms)] = 0
        keep = terms[at] == every if len(terms) else np.zeros(len(every), bool)
        cols, rows = at[keep], row_of[keep]
        bounds = np.searchsorted(rows, np.arange(n + 1))
        rng = np.random.default_rng(seed)
        rate = ((weight * y).sum() + 0.5) / (n + 1)
        p = {"b": np.array([np.log(rate / (1 - rate))]), "w": np.zeros(len(terms)), "v": rng.normal(0, 0.02, (len(terms), FACTORS))}
        m1, m2, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for lo in range(0, n, 256):
                ids = np.sort(order[lo : lo + 256])
                count = bounds[ids + 1] - bounds[ids]
                index = np.repeat(bounds[ids], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                c, r = cols[index], np.repeat(np.arange(len(ids)), count)
                margin, sums = cls.margin(r, c, len(ids), p["b"][0], p["w"], p["v"])
                e = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[ids]) * weight[ids] / len(ids)
                g = {"b": np.array([e.sum()]), "w": np.bincount(c, e[r], len(terms)) + 1e-4 * p["w"], "v": 1e-4 * p["v"]}
                for f in range(FACTORS):
                    g["v"][:, f] += np.bincount(c, e[r] * (sums[r, f] - p["v"][c, f]), len(terms))
                step += 1
                for k in p:
                    m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                    m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                    p[k] -= 0.02 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        machine = cls(terms, float(p["b"][0]), p["w"], p["v"])
        machine.bias -= best_cut(cls.margin(rows, cols, n, machine.bias, machine.weights, machine.factors)[0], y, weight)
        return machine

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        """Probabilities; features hold kept buckets only."""
        n = len(features)
        rows = np.repeat(np.arange(n), [len(x) for x in features])
        cols = np.searchsorted(self.terms, np.concatenate(features)) if len(rows) else np.zeros(0, np.int64)
        margin, _ = self.margin(rows, cols, n, self.bias, self.weights, self.factors)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> FactorizationMachine:
    """A machine fitted on at most 2 * sample_rows labelled texts of the training folds.

    Ids whose labels differ, and rows without an id or a label, teach nothing. A sampled row stands for as
    many as its class has labelled ids for each sampled one. The bias puts a score of 0.5 where it parts the
    so weighted classes with the best F1.
    """
    label = F.col(f"`{label_col}`").cast("int")
    known = labels.select(F.col(f"`{id_col}`").alias("id"), label.alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (fold("id", FOLDS) != HELD_OUT))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
    total = {row["y"]: row["count"] for row in known.groupBy("y").count().collect()}
    weight = {c: max(1.0, total.get(c, 0) / max(sample_rows, 1)) for c in (0, 1)}
    draw = F.xxhash64(F.col("id"))
    parts = [known.where(F.col("y") == c).orderBy(draw, "id").limit(sample_rows) for c in (0, 1)]
    sample = parts[0].union(parts[1]).withColumnRenamed("id", "__id")  # at most 2 * sample_rows ids: a bounded broadcast
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(sample), F.col("id") == F.col("__id")).select("id", "text", "y")
    rows = rows.dropDuplicates(["id", "text"]).withColumn("n", F.lit(1))

    def run(ids, texts, batch):
        terms = Terms()
        found = [np.fromiter(sorted(terms.of(t)), np.int32) for t in texts]
        return pa.record_batch([ids.cast(pa.int64()), batch.column(2).cast(pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "y", "terms"])

    rows = checkpointed(map_texts(rows, run, "id long, y int, terms binary", "id", "text", ["y"]))

    def counted(batches):
        """How many rows, and toxic rows, of the task hold each bucket."""
        n, toxic = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for b in batches:
            for y, data in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                at = np.frombuffer(data.as_py(), np.int32)
                n[at] += 1
                toxic[at] += y
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(toxic[some])], names=["term", "n", "toxic"])

    # one row a bucket that enough rows hold, so 2 ** BITS at most
    counts = rows.mapInArrow(lean(counted), "term int, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= LEAST_ROWS).orderBy("term").toArrow()
    size = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    kept = telling_terms(*[counts.column(c).to_numpy().astype(float if c != "term" else np.int64) for c in ("term", "n", "toxic")], *size)

    def cut(batches):
        for b in batches:
            found = [x[np.isin(x, kept)] for x in (np.frombuffer(data.as_py(), np.int32) for data in b.column(2))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "y", "terms"])

    # only kept terms of the sampled rows come to the driver
    got = rows.mapInArrow(lean(cut), "id long, y int, terms binary").toArrow().to_pydict()
    order = sorted(range(len(got["id"])), key=lambda i: (got["id"][i], got["terms"][i]))
    y = np.array([got["y"][i] for i in order], float)
    return FactorizationMachine.fit([np.frombuffer(got["terms"][i], np.int32).astype(np.int64) for i in order], y, np.where(y == 1, weight[1], weight[0]), terms=kept)


def scorer(docs: DataFrame, machine: FactorizationMachine):
    """texts -> scores, to run in tasks; the machine (at most KEPT_TERMS terms) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    caches: dict[int, Terms] = {}

    def score_of(texts: list[bytes]) -> np.ndarray:
        m = shared.value
        terms = caches.get(0) or caches.setdefault(0, Terms(m.terms))
        score = np.zeros(len(texts))
        for lo, hi in pieces(texts):
            score[lo:hi] = m.score([np.fromiter(sorted(terms.of(t)), np.int64) for t in texts[lo:hi]])
        return score

    return score_of


def drop_toxic(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that toxicity() predicts toxic."""
    score_of = scorer(docs, fitted(docs, labels, label_col, sample_rows, id_col, text_col))
    return filter_texts(docs, lambda texts: (score_of(texts) < 0.5).tolist(), text_col)


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) for every whole text.

    Null texts are empty; an empty text has the bias alone. Without labels of both classes the score is
    that of the class share (0.5 with no labels). Rows that repeat each get their row. Only the text is
    an input of the score; other columns are not read. Scoring is narrow.
    """
    score_of = scorer(docs, fitted(docs, labels, label_col, sample_rows, id_col, text_col))

    def run(ids, texts, batch):
        score = score_of(texts)
        return pa.record_batch([ids, batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), (fold(F.col(f"`{id_col}`"), FOLDS) == HELD_OUT).alias("held_out"))
    return map_texts(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int", "id", "text", ["held_out"])

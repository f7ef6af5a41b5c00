"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, id_columns, ids_of

WORDS = re.compile(r"[^\W_]+")
#: The model is fitted on at most so many labelled rows of either label, taken in order of a hash of doc_id.
SAMPLE_EACH = 1000
#: A word is first labelled toxic if it is in so many toxic texts and, smoothed, so many times likelier there.
LEAST_TEXTS, LEAST_ODDS = 5, 20.0
#: Words share weights by their last letters, in so many classes; rare words have no other.
ENDING, CLASSES = 3, 1024
#: Gradient steps of the first fit and of those after each relabelling.
ROUNDS, AGAIN, STEP, RIDGE = 32, (12,), 0.5, 0.02
TOKENS_AT_ONCE = 1_000_000
#: Fitting holds the arrays of about so many words at a time.
TOKENS_A_STEP = 200_000


def words_in(text: str | None) -> list[str]:
    return list(map(str.lower, WORDS.findall(text or "")))


def _apply(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """2 x 2 matrices (4, n) times vectors (2, n), scaled to sum 1."""
    a, b = m[0] * v[0] + m[1] * v[1], m[2] * v[0] + m[3] * v[1]
    s = a + b
    return np.stack([a / s, b / s])


def chain(m: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The vectors m[i] ... m[1] m[0] start, scaled to sum 1, for every i; m is (4, n).

    Blocks of about sqrt(n) matrices are multiplied side by side, their products chained, and the blocks run again.
    """
    n = m.shape[1]
    if n <= 64:
        out, v = np.empty((2, n)), start
        for i in range(n):
            a, b = m[0, i] * v[0] + m[1, i] * v[1], m[2, i] * v[0] + m[3, i] * v[1]
            v = (a / (a + b), b / (a + b))
            out[:, i] = v
        return out
    size = max(8, math.isqrt(n))
    blocks = -(-n // size)
    padded = np.zeros((4, blocks * size))
    padded[[0, 3]] = 1.0
    padded[:, :n] = m
    steps = np.ascontiguousarray(padded.reshape(4, blocks, size).transpose(2, 0, 1))
    p = steps[0]
    for k in range(1, size):
        s = steps[k]
        p = np.stack([s[0] * p[0] + s[1] * p[2], s[0] * p[1] + s[1] * p[3], s[2] * p[0] + s[3] * p[2], s[2] * p[1] + s[3] * p[3]])
        p = p / p.sum(axis=0)
    ends = chain(p, start)
    v = np.concatenate([np.asarray(start, float).reshape(2, 1), ends[:, :-1]], axis=1)
    out = np.empty((size, 2, blocks))
    for k in range(size):
        v = _apply(steps[k], v)
        out[k] = v
    return out.transpose(1, 2, 0).reshape(2, -1)[:, :n]


def marginals(score: np.ndarray, first: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Probability of the toxic label of every word by forward-backward; with pairs, of each move into a word too.

    ``score`` is the log-odds of toxic by the word alone, ``first`` marks the first word of each text, ``move[a, b]``
    is the weight of going from label a to b. Texts follow each other in one chain that forgets at each first word.
    """
    up = np.exp(np.clip(score, -30, 30))
    n, t = len(score), np.exp(move)
    ones = np.ones(n)
    one = np.where(first, 1.0, t[0, 0]), np.where(first, 1.0, t[1, 0]), np.where(first, 1.0, t[0, 1]), np.where(first, 1.0, t[1, 1])
    forward = chain(np.stack([one[0], one[1], up * one[2], up * one[3]]), np.array([0.5, 0.5]))
    # backward vector of word i: sum over the label of word i + 1; cut where word i + 1 starts a text
    nxt, cut = np.append(up[1:], 1.0), np.append(first[1:], True)
    back = np.stack([np.where(cut, 1.0, t[0, 0]), np.where(cut, 1.0, t[0, 1] * nxt), np.where(cut, 1.0, t[1, 0]), np.where(cut, 1.0, t[1, 1] * nxt)])
    backward = chain(back[:, ::-1], np.array([0.5, 0.5]))[:, ::-1]
    both = forward * backward
    p = both[1] / both.sum(axis=0)
    if not pairs:
        return p
    before = np.concatenate([[[0.5], [0.5]], forward[:, :-1]], axis=1)
    joint = np.stack([before[a] * t[a, b] * (up if b else ones) * backward[b] for a in (0, 1) for b in (0, 1)])
    return p, (joint / joint.sum(axis=0))[:, ~first]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def ending(word: str) -> int:
    return zlib.crc32(word[-ENDING:].encode()) % CLASSES


class Numbers(dict):
    """Numbers of words: those of the vocabulary, then one for each class of endings; remembered up to a bound."""

    def __init__(self, vocabulary: dict[str, int], limit: int = 400_000):
        super().__init__(vocabulary)
        self.size, self.limit = len(vocabulary), limit

    def __missing__(self, word: str) -> int:
        n = self.size + ending(word)
        if len(self) < self.limit:
            self[word] = n
        return n


def beside(ids: np.ndarray, first: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words before and behind each word in its text, ``none`` at its ends."""
    before, behind = np.append(none, ids[:-1]), np.append(ids[1:], none)
    before[first] = none
    behind[:-1][first[1:]] = none
    return before, behind


class Model:
    """The field's weights by word number (of the word itself with its ending, of the word before and the one behind), its
    bias and moves, and the logistic calibration of document scores."""

    def __init__(self, vocabulary: dict[str, int], own: np.ndarray, before: np.ndarray, behind: np.ndarray, bias: float, move: np.ndarray, calibration: np.ndarray):
        self.vocabulary, self.own, self.before, self.behind = vocabulary, own, before, behind
        self.bias, self.move, self.calibration = bias, move, calibration

    @classmethod
    def constant(cls, log_odds: float) -> Model:
        """Says the same of every text."""
        none = np.zeros(CLASSES + 1)
        return cls({}, none, none, none, -8.0, np.zeros((2, 2)), np.array([log_odds, 0.0, 0.0]))

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        before, behind = beside(ids, first, len(self.own) - 1)
        return self.own[ids] + self.before[before] + self.behind[behind] + self.bias

    def tag(self, texts: list[list[str]], numbers: Numbers | None = None) -> list[np.ndarray]:
        """Marginal probability of toxic for each word of each text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        number = (numbers if numbers is not None else Numbers(self.vocabulary)).__getitem__
        at: list[int] = []
        n = 0
        for i, words in enumerate(texts):
            if words:
                at.append(i)
                n += len(words)
            if at and (n >= TOKENS_AT_ONCE or i == len(texts) - 1):
                ids = np.fromiter((number(w) for j in at for w in texts[j]), np.int64, n)
                ends = np.cumsum([len(texts[j]) for j in at])
                first = np.zeros(n, bool)
                first[0] = True
                first[ends[:-1]] = True
                for j, p in zip(at, np.split(marginals(self.scores(ids, first), first, self.move), ends[:-1]), strict=True):
                    out[j] = p
                at, n = [], 0
        return out

    def score(self, p: np.ndarray) -> float:
        return float(sigmoid(self.features(p) @ self.calibration))

    @staticmethod
    def features(p: np.ndarray) -> np.ndarray:
        top = float(p.max()) if len(p) else 0.0
        top = min(max(top, 1e-6), 1 - 1e-6)
        return np.array([1.0, math.log(top / (1 - top)) / 5.0, math.log1p(float(p[p > 0.5].sum()))])


def _blocks(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Numbers of the texts in blocks of about TOKENS_A_STEP words; a text is never cut."""
    ends = np.cumsum([len(t) for t in texts])
    return [part for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends // TOKENS_A_STEP)) + 1) if len(part)]


def first_labels(texts: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """Marks words of the vocabulary that are in LEAST_TEXTS toxic texts and LEAST_ODDS times likelier there."""
    yes, no = (np.bincount(np.concatenate([np.unique(t[t < size]) for t, y in zip(texts, toxic, strict=True) if y == label]), minlength=size) for label in (True, False))
    return (yes >= LEAST_TEXTS) & ((yes + 0.5) * ((~toxic).sum() + 1) >= LEAST_ODDS * (no + 0.5) * (toxic.sum() + 1))


def fit(vocabulary: dict[str, int], texts: list[np.ndarray], toxic: list[int]) -> Model:
    """Labels words from the labelled texts, fits the field to them by gradient steps, relabels and refits, then calibrates.

    A text is the numbers of its words (see Numbers). Words of texts that aren't toxic are never labelled; those of
    toxic ones are after the first fit if their marginal is above one half, and the likeliest word if there is none and
    its marginal isn't negligible. Gradients are sums over blocks of whole texts.
    """
    yes = np.array(toxic, bool)
    if yes.all() or not yes.any():
        return Model.constant(math.log((yes.sum() + 0.5) / ((~yes).sum() + 0.5)))
    size = len(vocabulary)
    n = size + CLASSES + 1  # the last number stands beside a text's ends
    classes = np.append(np.fromiter(map(ending, vocabulary), np.int64, size), np.append(np.arange(CLASSES), 0))
    marked = np.append(first_labels(texts, yes, size), np.zeros(CLASSES + 1, bool))
    blocks = []
    for part in _blocks(texts):
        sizes = np.array([len(texts[i]) for i in part])
        ids = np.concatenate([texts[i] for i in part]).astype(np.int64)
        first = np.zeros(len(ids), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        of_toxic = np.repeat(yes[part], sizes)
        blocks.append([part, sizes, ids, *beside(ids, first, n - 1), first, of_toxic, marked[ids] & of_toxic])
    w = np.zeros(3 * n + CLASSES + 5)
    w[-5] = -4.0
    square = np.full(len(w), 1e-3)

    def scores(ids, before, behind):
        return (w[:n] + w[3 * n : -5][classes])[ids] + w[n : 2 * n][before] + w[2 * n : 3 * n][behind] + w[-5]

    for turn, rounds in enumerate((ROUNDS, *AGAIN)):
        if turn:  # relabel by the marginals
            for block in blocks:
                part, sizes, ids, before, behind, first, of_toxic, y = block
                p = marginals(scores(ids, before, behind), first, w[-4:].reshape(2, 2))
                y[:] = (p > 0.5) & of_toxic
                for start, k, i in zip(np.cumsum(sizes) - sizes, sizes, part, strict=True):
                    if yes[i] and k and not y[start : start + k].any():
                        best = start + int(p[start : start + k].argmax())
                        y[best] = p[best] > 0.05
        told = np.zeros(4)
        for _, _, _, _, _, first, _, y in blocks:
            told += np.bincount((2 * np.append(False, y[:-1]) + y)[~first], minlength=4)
        for _ in range(rounds):
            step = -RIDGE * w
            step[-5] = 0.0
            for _, _, ids, before, behind, first, _, y in blocks:
                p, joint = marginals(scores(ids, before, behind), first, w[-4:].reshape(2, 2), pairs=True)
                off = y - p
                own = np.bincount(ids, off, n)
                step[:n] += own
                step[n : 2 * n] += np.bincount(before, off, n)
                step[2 * n : 3 * n] += np.bincount(behind, off, n)
                step[3 * n : -5] += np.bincount(classes, own, CLASSES)
                step[-5] += off.sum()
                step[-4:] -= joint.sum(axis=1)
            step[-4:] += told
            square += step**2
            w += 4 * STEP * step / np.sqrt(square)
            w[n - 1] = 0.0
    x = np.empty((len(texts), 3))
    for part, sizes, ids, before, behind, first, _, _ in blocks:
        p = marginals(scores(ids, before, behind), first, w[-4:].reshape(2, 2))
        for i, q in zip(part, np.split(p, np.cumsum(sizes)[:-1]), strict=True):
            x[i] = Model.features(q)
    target, prior = yes.astype(float), np.zeros(3)
    for _ in range(25):  # Newton steps of a ridge logistic regression
        q = sigmoid(x @ prior)
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        prior = prior + np.linalg.solve(hessian, x.T @ (target - q) - 0.05 * prior)
    return Model(vocabulary, w[:n] + w[3 * n : -5][classes], w[n : 2 * n].copy(), w[2 * n : 3 * n].copy(), float(w[-5]), w[-4:].reshape(2, 2).copy(), prior)


def remainder(key: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model from labelled rows whose crc32 of doc_id has a remainder other than 0 by 5.

    The sample is bounded by SAMPLE_EACH rows of either label, so its size doesn't grow with the corpus; its texts are
    read whole. Tasks count the words and number them; the driver gets four bytes for each word.
    """
    marked = labels.filter("toxic is not null").groupBy(F.col("doc_id").alias("k")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    marked = marked.filter(F.crc32(F.col("k").cast("string")) % 5 != 0)
    order = F.xxhash64("k", F.lit(7))
    chosen = marked.filter("y = 1").orderBy(order, "k").limit(SAMPLE_EACH).unionByName(marked.filter("y = 0").orderBy(order, "k").limit(SAMPLE_EACH))
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = texts.join(F.broadcast(chosen), "k").groupBy("k").agg(F.max("t").alias("t"), F.max("y").alias("y"))

    def lowered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "words": [" ".join(words_in(t)) for t in batch["t"]]})

    store = Store(docs.sparkSession, "toxic")
    kept = store.keep(found.mapInPandas(lowered, "y int, words string"))
    rows = kept.withColumn("digest", F.sha2("words", 256)).dropDuplicates(["digest", "y"])  # one of each text
    each = rows.select(F.explode(F.array_distinct(F.split("words", " "))).alias("w")).filter("w <> ''").groupBy("w")
    known = each.agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= LEAST_TEXTS)
    vocabulary = {w: i for i, w in enumerate(sorted(r.w for r in known.toLocalIterator()))}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = Numbers(shared.value).__getitem__
        for batch in batches:
            ids = [np.array(list(map(number, t.split())), np.int32).tobytes() for t in batch["words"]]
            yield pd.DataFrame({"digest": batch["digest"], "y": batch["y"], "ids": ids})

    ids, toxic = [], []
    for r in rows.select("digest", "y", "words").mapInPandas(numbered, "digest string, y int, ids binary").orderBy("digest", "y").toLocalIterator():
        ids.append(np.frombuffer(r.ids, np.int32))
        toxic.append(r.y)
    store.drop(kept)
    if not ids:
        return Model.constant(-2.0)
    return fit(vocabulary, ids, toxic)


def toxic_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_toxic_words, spans) of each row of docs, over its whole text; no shuffle.

    ``spans`` lists start:end in code points of the words whose marginal is above one half. Null and empty texts get
    the score of a text without toxic words; repeated rows are treated alike; other columns are not read. The model
    is a table of words from a bounded sample, which bounds what is broadcast.
    """
    model = train(docs, labels, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Numbers(shared.value.vocabulary)
        for batch in batches:
            found = []
            texts = batch["t"].tolist()
            for a in range(0, len(texts), 500):
                part = texts[a : a + 500]
                for text, p in zip(part, shared.value.tag([words_in(t) for t in part], numbers), strict=True):
                    hit = set(np.flatnonzero(p > 0.5).tolist())
                    spans = ",".join(f"{m.start()}:{m.end()}" for i, m in enumerate(WORDS.finditer(text or "")) if i in hit) if hit else ""
                    found.append((shared.value.score(p), len(hit), spans))
            score = np.array([x[0] for x in found], float)
            yield pd.DataFrame({
                "doc_id": ids_of(batch), "held_out": batch["h"], "score": score, "predicted": (score >= 0.5).astype("int32"),
                "n_toxic_words": np.array([x[1] for x in found], "int64"), "spans": [x[2] for x in found],
            })

    rows = docs.select(*id_columns(F.col(key)), F.col(text).alias("t"), (remainder(key) == 0).alias("h"))
    return rows.mapInPandas(scan, "doc_id long, held_out boolean, score double, predicted int, n_toxic_words long, spans string")

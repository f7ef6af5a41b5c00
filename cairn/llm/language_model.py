"""Katz backoff language model: partitioned count tables, and scores of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, WordHashes, mix

#: Order of the model, and level of the tables' compression.
ORDER, LEVEL = 3, 4
TOKENS_A_BATCH = 1_500_000
#: Counts up to DISCOUNTED are discounted. A history that stands before as many tokens as a batch has is hot: its grams
#: are dealt by gram, so no part gets more of one history than of a batch.
DISCOUNTED = 5
#: The hash of the token that ends each text and stands before its first word.
END = 0
HELD_OUT = 1
NO_ID = -(1 << 63)


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes of the least width that holds them."""
    if values.dtype.kind == "f":
        width, kind = values.dtype.itemsize, b"f"
    else:
        top = int(values.max()) if len(values) else 0
        width = 8 if len(values) and (top >= 1 << 32 or int(values.min()) < 0) else 4 if top >= 1 << 16 else 2 if top >= 1 << 8 else 1
        kind = b"i"
        values = values.astype(f"i{width}" if width == 8 else f"u{width}")
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return kind + bytes([width]) + zstandard.compress(planes.tobytes(), LEVEL)


def unpack(data: bytes) -> np.ndarray:
    width = data[1]
    planes = np.frombuffer(zstandard.decompress(data[2:]), np.uint8).reshape(width, -1)
    flat = np.ascontiguousarray(planes.T).reshape(-1)
    return flat.view(f"f{width}") if data[:1] == b"f" else flat.view(f"i{width}" if width == 8 else f"u{width}").astype(np.int64)


def pack_rows(columns: list[np.ndarray]) -> bytes:
    """Rows in ascending order: the first column as steps."""
    return pack(np.concatenate([np.diff(columns[0], prepend=0), *columns[1:]]))


def unpack_rows(data: bytes, n: int) -> list[np.ndarray]:
    first, *rest = unpack(data).reshape(n, -1)
    return [np.cumsum(first), *rest]


def discounts(counts_of_counts: list[int], k: int = DISCOUNTED) -> np.ndarray:
    """Good-Turing discounts of the counts 1 to k; where they aren't between 0 and 1, half a count is taken off."""
    n = [0, *counts_of_counts]
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common != 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array(out)


def _hash_of(numbers: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(numbers.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _encoded(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """One row for each batch of whole texts: its documents, its words as numbers, and the words' hashes and counts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        number = (TaskContext.get().partitionId() << 24) - 1

        def made(docs_, held, lens, tokens):
            nonlocal number
            number += 1
            flat = np.concatenate(tokens)
            vocab, ids = np.unique(flat, return_inverse=True)
            train = np.bincount(ids[np.repeat(~np.array(held), lens)], minlength=len(vocab))
            order = np.argsort(-np.bincount(ids, minlength=len(vocab)), kind="stable")  # common words get small numbers
            place = np.empty(len(vocab), np.int64)
            place[order] = np.arange(len(vocab))
            cells = [np.array(docs_), np.array(held, np.int64), np.array(lens), place[ids], vocab[order].view(np.int64), train[order]]
            end = int(place[np.searchsorted(vocab, END)])
            return pd.DataFrame([[number, int(train.sum()), end, *map(pack, cells)]], columns=["batch", "n_train", "end", "docs", "held", "lens", "ids", "vocab", "train"])

        docs_, held, lens, tokens, total = [], [], [], [], 0
        for batch in batches:
            for k, h, t in zip(batch["k"], batch["h"], batch["t"], strict=True):
                words = (t or "").encode().lower().split()
                docs_.append(k)
                held.append(h)
                lens.append(len(words) + 1)
                tokens.append(np.append(known.of(words), np.uint64(END)))
                total += lens[-1]
                if total >= TOKENS_A_BATCH:
                    yield made(docs_, held, lens, tokens)
                    docs_, held, lens, tokens, total = [], [], [], [], 0
        if docs_:
            yield made(docs_, held, lens, tokens)

    key = F.col(doc).cast("long")
    held = F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == HELD_OUT
    rows = docs.select(F.coalesce(key, F.lit(NO_ID)).alias("k"), held.alias("h"), F.col(text).alias("t"))
    return rows.mapInPandas(scan, "batch long, n_train long, end long, docs binary, held binary, lens binary, ids binary, vocab binary, train binary")


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its rows in order) of the parts that have rows."""
    order = np.argsort(part, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(at):
            yield int(part[at[0]]), at


def _word_requests(batches: DataFrame, parts: int) -> DataFrame:
    def scan(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for r in frame.itertuples():
                vocab, train = unpack(r.vocab), unpack(r.train)
                part = (vocab.view(np.uint64) % np.uint64(parts)).astype(np.int64)
                yield pd.DataFrame([(g, r.batch, pack(vocab[at]), pack(train[at]), pack_rows([at])) for g, at in _by_part(part)], columns=["part", "batch", "a", "b", "c"])

    return batches.select("batch", "vocab", "train").mapInPandas(scan, "part long, batch long, a binary, b binary, c binary")


ROW = "kind string, batch long, part long, n array<long>, a binary, b binary, c binary, d binary"
COLUMNS = ["kind", "batch", "part", "n", "a", "b", "c", "d"]


def _rows(made: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(*r, *[None] * (8 - len(r))) for r in made], columns=COLUMNS)


def _word_counter(parts: int):
    """The function that totals a part's words: the table's partition, and an answer (number, total) for each batch.

    A word's number is its place, from 1, among its part's words that training has, the most frequent first, times the
    parts, plus the part; so numbers of common words are short. Words that training lacks have number 0.
    """

    def count(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        asked = [unpack(x) for x in group["a"]]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack(x) for x in group["b"]]), len(words)).astype(np.int64)
        seen = total > 0
        number = np.zeros(len(words), np.int64)
        number[np.argsort(-total, kind="stable")[: int(seen.sum())]] = (np.arange(int(seen.sum())) + 1) * parts + part
        made = [("words", -1, part, [int(seen.sum())], pack(words[seen]), pack(number[seen]), pack(total[seen]))]
        for batch, local, places in zip(group["batch"], group["c"], np.split(at, np.cumsum([len(x) for x in asked])[:-1]), strict=True):
            made.append(("word_answer", batch, part, None, pack(number[places]), pack(total[places]), local))
        return _rows(made)

    return count


def _sorted_by(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows given by columns of numbers from 0, and marks of the first of equal rows in that order."""
    if sum(int(c.max(initial=0)).bit_length() for c in columns) < 63:  # one number tells a row
        key = columns[0]
        for c in columns[1:]:
            key = (key << int(c.max(initial=0)).bit_length()) | c
        order = np.argsort(key, kind="stable")
        return order, np.append(True, np.diff(key[order]) > 0)[: len(order)]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    new[:1] = True
    return order, new


def _numbered(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The number of each row's group, from 0 in the order; see _sorted_by()."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _endings(history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """_sorted_by() of histories without their first word, what their lower grams' histories are; all are alike if that was all."""
    return _sorted_by(*(history[1:] or [np.zeros_like(history[0])]))


class _Words:
    """A batch's texts by local word numbers, with what the word table says of the words."""

    def __init__(self, row, answers: pd.DataFrame):
        self.docs, self.held, self.lens, self.ids = unpack(row.docs), unpack(row.held).astype(bool), unpack(row.lens), unpack(row.ids)
        self.batch, self.size = row.batch, int(self.ids.max()) + 1
        self.number, self.count = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for r in answers[answers["kind"] == "word_answer"].itertuples():
            (at,) = unpack_rows(r.c, 1)
            self.number[at], self.count[at] = unpack(r.a), unpack(r.b)
        self.starts = np.append(0, np.cumsum(self.lens)[:-1])
        self.place = np.arange(len(self.ids)) - np.repeat(self.starts, self.lens)
        self.before = np.append(0, self.ids[:-1])
        self.before[self.starts] = row.end
        self.held_token = np.repeat(self.held, self.lens)


class _Grams:
    """The distinct m-grams of a batch, each a history and a word, and the requests that ask the parts for their counts.

    A history is a word (m = 2) or a gram of the level below; a token has a gram if so many tokens stand before it,
    counting the one that ends texts, before the first. Histories that training lacks are not asked for.
    """

    def __init__(self, words: _Words, m: int, below: _Grams | None, parts: int, hot: int):
        self.words, self.m, self.below, self.hot = words, m, below, hot
        self.tokens = np.flatnonzero(words.place >= m - 2)
        h = words.before if below is None else np.append(-1, below.gram_of[:-1])
        grams, gram = np.unique(h[self.tokens] * words.size + words.ids[self.tokens], return_inverse=True)
        self.h, self.w = grams // words.size, grams % words.size
        self.gram_of = np.full(len(words.ids), -1)
        self.gram_of[self.tokens] = gram
        under = words.ids if below is None else below.gram_of
        self.lower = np.empty(len(grams), np.int64)  # the same gram without its first word, a level below
        self.lower[gram] = under[self.tokens]
        if below is None:
            self.history, self.count, self.lower_count = [words.number], words.count, words.count[self.lower]
            self.under = np.zeros(words.size, np.int64)
        else:
            self.history = [*(x[below.h] for x in below.history), words.number[below.w]]
            self.count, self.lower_count = below.seen, below.seen[self.lower]
            self.under = np.zeros(len(below.h), np.int64)  # what a history's lower grams are divided by
            self.under[self.h] = below.divisor[below.h[self.lower]]
        self.trained = np.bincount(gram[~words.held_token[self.tokens]], minlength=len(grams))
        self.wanted = np.zeros(len(self.count), bool)  # histories whose backoff weight held-out texts may need
        self.wanted[self.h[gram[words.held_token[self.tokens]]]] = True
        number = words.number[self.w]
        spread = np.zeros(len(self.count), np.uint64)
        for x in self.history:
            spread = _hash_of(spread + x.view(np.uint64))
        spread = spread[self.h] + np.where(self.count[self.h] >= hot, number * 1_000_003 + 1, 0).astype(np.uint64)
        # a history that this batch alone has needs no part: all its grams are here
        self.own = np.zeros(len(self.count), bool) if below is None else below.alone & (below.seen > 0)
        asked = np.flatnonzero((self.count[self.h] > 0) & ~self.own[self.h])
        part = (_hash_of(spread[asked]) % np.uint64(parts)).astype(np.int64)
        order = _sorted_by(part, *(x[self.h[asked]] for x in self.history))[0]
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        self.requests = [(int(part[at[0]]), asked[at]) for at in np.split(order, cuts) if len(at)]

    def heads(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The histories of a request, and where each one's run of grams starts."""
        h = self.h[at]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        return h[first], first

    def asks(self) -> list[tuple]:
        mine = np.flatnonzero(self.own[self.h])
        counts = [int((self.trained[mine] == k).sum()) for k in range(1, DISCOUNTED + 2)]
        made = []
        for g, at in self.requests or [(0, np.zeros(0, np.int64))]:
            heads, first = self.heads(at)
            history = [x[heads] for x in self.history]
            order, new = _endings(history)
            under = np.rint(self.under[heads[order[new]]]).astype(np.int64)  # one for each ending, as it is the same for all that share it
            flags = ((self.count[heads] >= self.hot).astype(np.int64), self.wanted[heads].astype(np.int64))
            cells = (np.diff(np.append(first, len(at))), *flags, under, self.words.number[self.w[at]], self.lower_count[at], self.trained[at])
            made.append((g, self.words.batch, counts, pack_rows(history), *map(pack, cells)))
            counts = None
        return made

    def told(self, answers: pd.DataFrame, x: Level, lower_d: np.ndarray | None) -> None:
        """Takes the parts' answers: counts of the grams, divisors and backoff weights of the histories."""
        self.seen, self.alone = np.zeros(len(self.h), np.int64), np.zeros(len(self.h), bool)
        extra, self.backoff = np.zeros(len(self.count), np.int64), np.ones(len(self.count))
        by_part = {x.part: x for x in answers[answers["kind"] == f"answer{self.m}"].itertuples()}
        for g, at in self.requests:
            row, heads = by_part[g], self.heads(at)[0]
            told, few = unpack(row.a), unpack(row.b)
            self.alone[at] = told == 0
            self.seen[at] = np.where(told == 0, self.trained[at], told - 1)
            cold = self.count[heads] < x.hot
            extra[heads[cold]] = few[: len(heads)][cold]
            wanted = heads[self.wanted[heads] & cold]
            sums = np.vstack([few[len(heads) :].reshape(DISCOUNTED, -1), unpack(row.c)])
            self.backoff[wanted] = left_over(sums, self.count[wanted], x.d)[2]
        hot_sums = {}
        for r in answers[answers["kind"] == f"hot_answer{self.m}"].itertuples():
            hot_sums = dict(zip(map(tuple, unpack(r.a).reshape(-1, self.m - 1).tolist()), unpack(r.b).reshape(-1, DISCOUNTED + 1), strict=True))
        for v in np.flatnonzero((self.count >= x.hot) & ~self.own):
            sums = hot_sums.get(tuple(int(k[v]) for k in self.history))
            if sums is not None:
                more, _, weight = left_over(sums[:, None], self.count[v : v + 1], x.d)
                extra[v], self.backoff[v] = more[0], weight[0]
        mine = np.flatnonzero(self.own[self.h])
        if len(mine):
            self.seen[mine], self.alone[mine] = self.trained[mine], True
            lower = held_back(lower_d, self.lower_count[mine]) * self.lower_count[mine] / np.maximum(self.under[self.h[mine]], 1)
            sums = history_sums(self.h[mine], self.trained[mine], lower, len(self.count))[:, self.own]
            extra[self.own], _, self.backoff[self.own] = left_over(sums, self.count[self.own], x.d)
        self.divisor = self.count + extra


ASKED = "part long, batch long, own array<long>, h binary, n binary, hot binary, want binary, under binary, w binary, wc binary, t binary"


class Level:
    """What is known of a finished level: its order, parts, bound of hot histories and discounts."""

    def __init__(self, m: int, parts: int, hot: int, d: np.ndarray):
        self.m, self.parts, self.hot, self.d = m, parts, hot, d


def _grams(words: _Words, answers: pd.DataFrame, levels: list[Level]) -> _Grams | None:
    """The grams of the highest of some finished levels, with their answers."""
    grams, lower_d = None, None
    for x in levels:
        grams = _Grams(words, x.m, grams, x.parts, x.hot)
        grams.told(answers, x, lower_d)
        lower_d = x.d
    return grams


def _gram_requests(batches: DataFrame, answers: DataFrame, shared, m: int, parts: int, hot: int) -> DataFrame:
    """A batch's distinct m-grams by part, with their training counts."""

    def ask(row: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        words = _Words(next(row.itertuples()), told)
        return pd.DataFrame(_Grams(words, m, _grams(words, told, shared.value), parts, hot).asks(), columns=[c.split()[0] for c in ASKED.split(", ")])

    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(ask, ASKED)


def held_back(d: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The share of each count r that its discount leaves, 0 for 0."""
    return np.append(np.append(0.0, d), 1.0)[np.minimum(r, DISCOUNTED + 1)]


def history_sums(h: np.ndarray, r: np.ndarray, lower: np.ndarray, n: int) -> np.ndarray:
    """(DISCOUNTED + 1, n): of each history, how many grams have each discounted count, and the sum of the lower
    probabilities of those seen."""
    return np.stack([np.bincount(h, x, n) for x in (*(r == k for k in range(1, DISCOUNTED + 1)), np.where(r > 0, lower, 0.0))])


def _counter(m: int, norm: float, lower_d: np.ndarray | None):
    """The function that counts a part's m-grams: its table, its histories' sums, and an answer for each batch.

    An answer tells for each gram one more than its count, or 0 if no other batch has it, so the batch knows its count;
    for each history whether none of its counts is discounted, and its sums if wanted; it names the batch's hot histories,
    whose sums no part has whole.
    """

    def count(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        own = np.sum([np.zeros(DISCOUNTED + 1, np.int64), *(x for x in group["own"] if x is not None)], axis=0)
        col = {c: [unpack(x) for x in group[c]] for c in ("n", "hot", "want", "under", "w", "wc", "t")}
        asked = [len(x) for x in col["n"]]
        histories = [unpack_rows(h, m - 1) for h in group["h"]]
        under = np.concatenate([told[_numbered(*_endings(h))] for h, told in zip(histories, col["under"], strict=True)])
        history = [np.concatenate(x) for x in zip(*histories, strict=True)]
        order, new = _sorted_by(*history)
        heads, head = order[new], _numbered(order, new)
        n, hot = (np.concatenate(col[c]) for c in ("n", "hot"))
        w, wc, t = (np.concatenate(col[c]) for c in ("w", "wc", "t"))
        h, u = np.repeat(head, n), np.repeat(under, n)
        order, new = _sorted_by(h, w)
        first, gram = order[new], _numbered(order, new)
        r = np.bincount(gram, t, len(first)).astype(np.int64)
        alone = np.bincount(gram, minlength=len(first)) == 1
        of, w1, wc1 = h[first], w[first], wc[first]
        lower = (wc1 + 0.5) / norm if lower_d is None else held_back(lower_d, wc1) * wc1 / np.maximum(u[first], 1)
        sums = history_sums(of, r, lower, len(heads))
        is_hot = hot[heads] > 0
        kept = np.flatnonzero(r > 0)  # in order of history and word
        run = np.bincount(of[kept], minlength=len(heads))
        numbers = [x[heads] for x in history]
        some = run > 0
        counts = [int((r == k).sum()) + int(own[k - 1]) for k in range(1, DISCOUNTED + 2)]
        steps = np.diff(w1[kept], prepend=0)  # words ascend within a history
        begins = np.cumsum(run[some]) - run[some]
        steps[begins] = w1[kept][begins]
        made = [(f"grams{m}", -1, part, counts, pack_rows([x[some] for x in numbers]), pack(run[some]), pack(steps), pack(r[kept]))]
        # in the order of the table's histories; a hot one's sum is in pieces and not here
        made.append((f"histories{m}", -1, part, None, pack(np.where(is_hot, 0.0, sums[-1])[some].astype(np.float32))))
        made.append((f"hot{m}", -1, part, None, pack(np.concatenate([x[is_hot] for x in numbers])), pack(sums[:, is_hot].reshape(-1))))
        answers = np.split(np.where(alone, 0, r + 1)[gram], np.cumsum([len(x) for x in col["w"]])[:-1])
        for batch, a, at, want in zip(group["batch"], answers, np.split(head, np.cumsum(asked)[:-1]), col["want"], strict=True):
            bare = sums[:DISCOUNTED, at].sum(axis=0) == 0
            wanted = at[(want > 0) & ~is_hot[at]]
            asked_hot = at[is_hot[at]]
            made.append((f"answer{m}", batch, part, None, pack(a), pack(np.append(bare, sums[:DISCOUNTED, wanted]).astype(np.int64)), pack(sums[DISCOUNTED, wanted]), pack(np.concatenate([x[asked_hot] for x in numbers]))))
        return _rows(made)

    return count


def left_over(sums: np.ndarray, count: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(extra, mass left to unseen words, backoff weight) of histories with these sums and counts.

    A history none of whose counts is discounted gets one count more below the line, so that some mass is left.
    """
    r = np.arange(1, DISCOUNTED + 1)
    extra = (sums[:DISCOUNTED].sum(axis=0) == 0).astype(float)
    mass = (extra + ((1 - d) * r) @ sums[:DISCOUNTED]) / (count + extra)
    return extra, mass, mass / (1.0 - sums[DISCOUNTED])


def _hot_answers(table: DataFrame, m: int) -> DataFrame:
    """The sums of hot histories, which parts hold in pieces, for each batch that has grams of them."""
    kind = lambda name: table.filter(F.col("kind") == f"{name}{m}")

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                heads, sums = unpack(r.a).reshape(m - 1, -1).T, unpack(r.b).reshape(DISCOUNTED + 1, -1).T
                if len(heads):
                    yield pd.DataFrame({"h": [x.tolist() for x in heads], "s": list(sums)})

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                heads = unpack(r.d).reshape(m - 1, -1).T
                if len(heads):
                    yield pd.DataFrame({"batch": np.full(len(heads), r.batch), "h": [x.tolist() for x in heads]})

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        heads, sums = np.array(group["h"].tolist(), np.int64), group[names].to_numpy(np.float64)
        return _rows([(f"hot_answer{m}", int(group["batch"].iloc[0]), -1, None, pack(heads.reshape(-1)), pack(sums.reshape(-1)))])

    names = [f"s{k}" for k in range(DISCOUNTED + 1)]
    total = kind("hot").select("a", "b").mapInPandas(pieces, "h array<long>, s array<double>").groupBy("h").agg(*[F.sum(F.col("s")[k]).alias(n) for k, n in enumerate(names)])
    needs = kind("answer").select("batch", "d").mapInPandas(asked, "batch long, h array<long>").distinct()
    return needs.join(total, "h").groupBy("batch").applyInPandas(packed, ROW)


def katz_scores(docs: DataFrame, order: int = ORDER, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    P(w | h) is d(r) r / c(h) for a gram seen r times in training, else the backoff weight of h times P(w | h without
    its first word), down to the unigram (c(w) + 0.5) / (N + 0.5 (V + 1)), whose half counts also serve the one unknown
    word; a history that training lacks backs off with weight 1. Discounts are those of each length. Training reads
    the rows whose crc32 of doc_id isn't 1 by 5. Texts are cut at white space, A-Z lowered, and end with a token,
    which is also the first word's history; words further back than the text are no history.

    The texts are encoded once into batches of about a million tokens. Each batch asks for the counts of its distinct
    words and then, length by length, of its distinct grams, from parts dealt by hash; a part totals what all batches
    ask, stores its partition of the tables (kinds words, grams2, histories2, grams3 ...) and answers the batches. What
    a history needs to be normalised exactly, the lower probabilities of the words seen with it, follows from counts
    that come along. Grams of hot histories are dealt by gram, so no part gathers them; their sums are joined to the
    batches that have some. Words are told apart by 64-bit hashes. Null texts have the end token
    alone; repeated rows count as often as they occur; an empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    store = Store(spark, "katz")
    batches = store.keep(_encoded(docs, doc, text))
    total, n = batches.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n)
    words = store.keep(_word_requests(batches, parts).groupBy("part").applyInPandas(_word_counter(parts), ROW), "kind")
    vocabulary = words.filter("kind = 'words'").agg(F.coalesce(F.sum(F.col("n")[0]), F.lit(0))).first()[0]
    told = words.filter("kind = 'word_answer'")
    texts = store.keep(batches.select("batch", "end", "docs", "held", "lens", "ids"))
    store.drop(batches)
    hot, norm = TOKENS_A_BATCH, total + 0.5 * (vocabulary + 1)
    levels: list[Level] = []
    for m in range(2, order + 1):
        asked = _gram_requests(texts, told, spark.sparkContext.broadcast(levels), m, parts, hot)
        table = store.keep(asked.groupBy("part").applyInPandas(_counter(m, norm, levels[-1].d if levels else None), ROW), "kind")
        found = table.filter(F.col("kind") == f"grams{m}").agg(*[F.coalesce(F.sum(F.col("n")[k]), F.lit(0)) for k in range(DISCOUNTED + 1)]).first()
        levels = [*levels, Level(m, parts, hot, discounts(list(found)))]
        told = told.unionByName(table.filter(F.col("kind") == f"answer{m}").withColumn("d", F.lit(None).cast("binary"))).unionByName(store.keep(_hot_answers(table, m)))
    shared = spark.sparkContext.broadcast(levels)

    def score(row: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        words = _Words(next(row.itertuples()), told)
        base = np.log10((words.count + 0.5) / norm)
        value, under = base[words.ids], base
        grams, lower_d = None, None
        for x in shared.value:
            grams = _Grams(words, x.m, grams, x.parts, x.hot)
            grams.told(told, x, lower_d)
            lower_d = x.d
            with np.errstate(divide="ignore", invalid="ignore"):
                direct = np.log10(held_back(x.d, grams.seen) * grams.seen / grams.divisor[grams.h])
            under = np.where(grams.seen > 0, direct, np.log10(grams.backoff[grams.h]) + under[grams.lower])
            value[grams.tokens] = under[grams.gram_of[grams.tokens]]
        return pd.DataFrame({
            "k": words.docs, "held_out": words.held, "n_tokens": words.lens, "n_known": np.add.reduceat((words.count[words.ids] > 0).astype(np.int64), words.starts), "train_tokens": total,
            "base_score": np.add.reduceat(base[words.ids], words.starts), "score": np.add.reduceat(value, words.starts),
        })

    schema = "k long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = texts.groupBy("batch").cogroup(told.groupBy("batch")).applyInPandas(score, schema)
    return scored.select(F.nullif("k", F.lit(NO_ID)).alias("doc_id"), *scored.columns[1:])

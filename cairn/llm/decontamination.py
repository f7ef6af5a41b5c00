"""Benchmark passages in documents: SimHash windows, a multi-index over Hamming blocks, exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, id_columns, ids_of, windows

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of 64 bits within RADIUS agree in at least one of BLOCKS blocks of WIDTH bits but for RADIUS // BLOCKS
#: bits, so every print within RADIUS is found by looking up the values that near its own in each block. A passage of
#: similarity 0.8 is expected at a distance of 9.7 with a deviation of 2.9; more alike ones are nearer.
BLOCKS, WIDTH, RADIUS = 4, 16, 15
#: What to flip in a block to get the values near it.
NEAR = np.flatnonzero(np.bitwise_count(np.arange(1 << WIDTH)) <= RADIUS // BLOCKS)
WORDS = re.compile(r"\w+")
#: Bounds of a block of the benchmark, which is broadcast; larger benchmarks are taken in blocks.
ITEMS_A_BLOCK, CHARS_A_BLOCK = 20_000, 20_000_000
#: Prints looked up at once; a print has about a twenty-fifth of the items as candidates, so memory is bounded.
PRINTS_AT_ONCE = 2_000


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    return known.of(WORDS.findall((text or "").lower()))


def fingerprints(shingles: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash of each run of ``length`` shingles; a repeated shingle weighs as often as it occurs."""
    low = int(starts.min())
    part = shingles[low : int(starts.max()) + length]
    bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    sums = np.vstack([np.zeros((1, bits.shape[1]), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    total = sums[starts - low + length] - sums[starts - low]
    return np.packbits(total > 0, axis=1).reshape(-1).view(np.uint64)


def block_of(prints: np.ndarray, block: int) -> np.ndarray:
    return ((prints >> np.uint64(block * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run of length n, one run after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser over sum of the greater multiplicities of shingles."""
    both, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(where[: len(a)], minlength=len(both)), np.bincount(where[len(a) :], minlength=len(both))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Index:
    """The items of one shingle length k: shingles, fingerprints, and for each block the items by its value."""

    def __init__(self, items: list[tuple[int, np.ndarray]], k: int):
        self.k = k
        self.ids = [i for i, _ in items]
        self.shingles = [windows(h, k) for _, h in items]
        self.counts = np.array([len(s) for s in self.shingles])
        flat = np.concatenate(self.shingles)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(items)), self.counts)[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(flat & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.prints = np.concatenate([fingerprints(s, np.array([0]), len(s)) for s in self.shingles])
        self.item, self.from_ = [], []
        for b in range(BLOCKS):
            values = block_of(self.prints, b)
            order = np.argsort(values, kind="stable")
            self.item.append(order)
            self.from_.append(np.searchsorted(values[order], np.arange((1 << WIDTH) + 1)))

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Positions whose shingle some item has."""
        at = np.flatnonzero(self.maybe[(shingles & np.uint64(0xFFFF)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.flat, shingles[at]), len(self.flat) - 1)
        return at[self.flat[found] == shingles[at]]

    def candidates(self, prints: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of print, item) whose values of the block differ in RADIUS // BLOCKS bits at most."""
        values, at = np.unique(block_of(prints, block), return_inverse=True)
        keys = values[:, None] ^ NEAR
        lo = self.from_[block][keys]
        n = self.from_[block][keys + 1] - lo
        value, flip = np.nonzero(n)
        lo, n = lo[value, flip], n[value, flip]
        items = self.item[block][_runs(lo, n)]
        count = np.bincount(value, n, len(values)).astype(np.int64)
        start = np.cumsum(count) - count
        return np.repeat(np.arange(len(prints)), count[at]), items[_runs(start[at], count[at])]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (number of print, item) within RADIUS."""
        found = []
        for block in range(BLOCKS):
            which, item = self.candidates(prints, block)
            close = np.bitwise_count(prints[which] ^ self.prints[item]) <= RADIUS
            found.append(which[close] * len(self.ids) + item[close])
        pair = np.unique(np.concatenate(found))
        return pair // len(self.ids), pair % len(self.ids)

    def passages(self, shingles: np.ndarray, hits: np.ndarray) -> dict[int, tuple[float, int, int, int]]:
        """Item -> (similarity, start, words, Hamming distance) of its best passage in one document.

        A passage alike by SIMILARITY shares a shingle with its item, so windows that hold no hit are left out.
        """
        n = len(shingles)
        lo, hi = np.searchsorted(self.flat, shingles[hits]), np.searchsorted(self.flat, shingles[hits], "right")
        count = hi - lo
        place = _runs(lo, count)
        owner, at = self.owner[place], np.repeat(hits, count)
        best: dict[int, tuple[float, int, int, int]] = {}
        for length in np.unique(self.counts[owner]):
            size = min(int(length), n)
            near_hit = np.unique(at[self.counts[owner] == length])
            cover = np.zeros(n + 2, np.int64)
            np.add.at(cover, np.clip(near_hit - size + 1, 0, n - size), 1)
            np.add.at(cover, np.minimum(near_hit, n - size) + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover)[: n - size + 1] > 0)
            own = {i: np.unique(at[owner == i]) for i in np.unique(owner[self.counts[owner] == length])}
            for cut in range(0, len(starts), PRINTS_AT_ONCE):
                part = starts[cut : cut + PRINTS_AT_ONCE]
                far = np.split(part, np.flatnonzero(np.diff(part) > 4 * size) + 1)
                prints = np.concatenate([fingerprints(shingles, run, size) for run in far])
                which, item = self.near(prints)
                for i in np.unique(item):
                    if i not in own:
                        continue
                    w = which[item == i]
                    shared = np.searchsorted(own[i], part[w] + size) - np.searchsorted(own[i], part[w])
                    # positions shared are at least the shingles shared, each once or more
                    w = w[(1 + SIMILARITY) * shared >= SIMILARITY * (size + self.counts[i]) - 1e-9]
                    for j in w:
                        s = int(part[j])
                        alike = weighted_similarity(shingles[s : s + size], self.shingles[i])
                        if alike >= SIMILARITY and (-alike, s) < (-best.get(i, (0.0, 0, 0, 0))[0], best.get(i, (0.0, 0, 0, 0))[1]):
                            best[i] = (alike, s, size + self.k - 1, int(np.bitwise_count(prints[j] ^ self.prints[i])))
        return best


def _item_blocks(benchmark: DataFrame, item: str, item_text: str) -> list[Broadcast]:
    """The benchmark as broadcast lists of (item, text), each within the bounds; equal rows count once."""
    spark = benchmark.sparkSession
    queries = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).filter("t is not null and i is not null")
    n, chars = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS_A_BLOCK), -(-chars // CHARS_A_BLOCK))
    block = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    return [spark.sparkContext.broadcast([tuple(r) for r in queries.filter(block == b).distinct().collect()]) for b in range(blocks)]


class Finder:
    """Finds the passages of a list of items (id, text) in texts."""

    def __init__(self, items: list[tuple[int, str]]):
        self.known = WordHashes()
        by_length: dict[int, list] = {}
        for i, t in items:
            h = word_hashes(t, self.known)
            if len(h):
                by_length.setdefault(min(SHINGLE, len(h)), []).append((i, h))
        self.indexes = [Index(items, k) for k, items in sorted(by_length.items())]

    def passages(self, text: str | None) -> list[tuple]:
        """(item, similarity, start, words, Hamming distance) of the best passage of each item in a text."""
        found = []
        h = word_hashes(text, self.known)
        for index in self.indexes:
            if len(h) >= index.k:
                shingles = windows(h, index.k)
                hits = index.hits(shingles)
                if len(hits):
                    found += [(index.ids[i], *x) for i, x in index.passages(shingles, hits).items()]
        return found


def benchmark_passages(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, hamming): the best passage of each item in each document.

    Words are lower-cased runs of word characters; windows are as long as the item and slide over the whole text;
    shingles have SHINGLE words (all words of an item with fewer). No document is shuffled or sent to the driver. The
    benchmark is the stated query set; it goes to the tasks in blocks of bounded size, whose number doesn't change the
    result: one row for each row of docs and each distinct row of the benchmark that it holds. Null and empty texts,
    and items without words, match nothing; null doc_ids match like others; other columns are not read.
    """
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long, hamming int"
    columns = [c.split()[0] for c in schema.split(", ")]
    out = None
    for shared in _item_blocks(benchmark, item, item_text):

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            finder = Finder(shared.value)
            for batch in batches:
                rows = [(d, *x) for d, t in zip(ids_of(batch), batch["t"], strict=True) for x in finder.passages(t)]
                yield pd.DataFrame(rows, columns=columns).astype(
                    {"doc_id": "Int64", "item_id": "int64", "similarity": "float64", "start_word": "int64", "n_words": "int64", "hamming": "int32"}
                )

        found = docs.select(*id_columns(F.col(doc)), F.col(text).alias("t")).mapInPandas(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the documents that hold a passage of the benchmark; columns unchanged, whatever their names and ids.

    Rows pass through the tasks as Arrow batches, so nothing is shuffled or joined. Null texts stay.
    """
    place = docs.columns.index(text)
    for shared in _item_blocks(benchmark, "item_id", "text"):

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not finder.passages(t.as_py()) for t in batch.column(place)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs

"""Removal of repeated byte strings by bucket-pointer refinement of suffixes around repeated q-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, id_columns, ids_of, mix, text_or_empty

#: Bytes of a repeat, and of the q-grams whose buckets are refined. Every repeat holds an anchor at the same place.
REPEAT, Q = 100, 32
SIDE = REPEAT - Q
CONTEXT = REPEAT + SIDE
#: Bytes of the first buckets, and the later offsets by whose buckets they are refined: to 16, 32, 64 and 100 bytes.
GRAM, STEPS = 8, (8, 16, 32, 36)
BYTES_A_PART = 16 << 20
CONTEXTS_AT_ONCE = 8_000
#: An anchor with more places than this is dealt in two bands of offsets, each by HALF more bytes than the q-gram.
HOT, HALF, MIDDLE = 10_000, 32, SIDE // 2
#: Contexts of a batch that are compared at a time, before anything is shuffled.
COLLAPSED = 20_000
FIRST = -(1 << 63)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every offset, as a number."""
    return np.ndarray((len(data) - 7,), np.dtype("<u8"), data, strides=(1,)).copy()


def q_grams(data: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes from every offset."""
    w = _words(data)
    n = len(data) - Q + 1
    with np.errstate(over="ignore"):
        h = mix(w[:n] * _K[0] + w[8 : n + 8] * _K[1])
        return mix(h + w[16 : n + 16] * _K[2] + w[24 : n + 24] * _K[3])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offset, q-gram hash) of the anchors of texts laid end to end.

    The anchor of a run of REPEAT bytes is its q-gram of least hash, the first of equals, so it depends on the run's
    content alone: equal runs have equal anchors at equal places.
    """
    if len(data) < REPEAT:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = q_grams(data)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= SIDE + 1:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: len(data) - REPEAT + 1], least[SIDE + 1 - step : SIDE + 1 - step + len(data) - REPEAT + 1])
    inside = np.ones(len(least), bool)  # runs that don't cross a text's end
    for k in range(1, REPEAT):
        at = ends[:-1] - k
        inside[at[(at >= 0) & (at < len(least))]] = False
    at = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.unique(at)
    return at, h[at]


def first_buckets(contexts: np.ndarray) -> np.ndarray:
    """(n, offsets) bucket pointers of the GRAM bytes from every offset: where the bucket starts in sorted order."""
    flat = np.append(_words(np.ascontiguousarray(contexts).reshape(-1)), np.zeros(GRAM - 1, np.uint64))
    grams = flat.reshape(contexts.shape)[:, : contexts.shape[1] - GRAM + 1]
    _, bucket, size = np.unique(grams, return_inverse=True, return_counts=True)
    return (np.cumsum(size) - size).astype(np.int32)[bucket.reshape(grams.shape)]


def refined(bucket: np.ndarray, step: int) -> np.ndarray:
    """Pointers of buckets of depth d + step, from those of depth d, d being step or more.

    The members of each bucket are sorted on the pointer of the offset ``step`` later, and a sub-bucket's pointer is
    where it starts inside its bucket. Suffixes alone in their bucket keep their pointer and aren't sorted again; the
    pointers made here are what the next refinement sorts on.
    """
    size = np.bincount(bucket.reshape(-1))
    out = bucket[:, :-step].copy()
    row, offset = np.nonzero(size[out] > 1)
    own = out[row, offset]
    order = np.argsort(own * np.int64(len(size)) + bucket[row, offset + step], kind="stable")
    row, offset, own = row[order], offset[order], own[order]
    later = bucket[row, offset + step]
    if len(own):
        place = np.arange(len(own), dtype=np.int32)
        other = own[1:] != own[:-1]
        start = np.maximum.accumulate(np.where(np.append(True, other), place, 0))
        inner = np.maximum.accumulate(np.where(np.append(True, other | (later[1:] != later[:-1])), place, 0))
        out[row, offset] = own + inner - start
    return out


def later_runs(contexts: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to): byte ranges whose REPEAT-byte strings occur earlier, of rows in order of (document, start).

    ``start`` is the offset of a context's first byte in its document, [lo, hi) the offsets inside the context at which
    a string starts that lies in the document. Strings are equal if they are in one bucket of depth REPEAT; equal ones
    have their q-gram, hence their offset, at the same place in the context.
    """
    bucket = first_buckets(contexts)
    for step in STEPS:
        bucket = refined(bucket, step)
    at = np.arange(SIDE + 1)
    mask = (lo[:, None] <= at) & (at < hi[:, None]) & (np.bincount(bucket.reshape(-1))[bucket] > 1)
    row, at = np.nonzero(mask)
    _, first, same = np.unique(bucket[row, at].astype(np.int64) * (SIDE + 1) + at, return_index=True, return_inverse=True)
    old = first[same] != np.arange(len(row))
    later = np.zeros((len(contexts), SIDE + 3), bool)
    later[row[old], at[old] + 1] = True
    step = np.diff(later.astype(np.int8), axis=1)
    row, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return row, start[row] + a, start[row] + b - 1 + REPEAT


def _split(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(part, columns of its rows) for each part."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        if len(rows):
            yield int(part[rows[0]]), *(c[rows] for c in columns)


def _collapsed(texts: list[bytes], of: np.ndarray, h: np.ndarray, k: np.ndarray, v: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(kept, ranges): marks of the anchors of a batch that go on, and the ranges (k, v, a, b) of those that don't.

    Of equal contexts of an anchor in the batch only the first by document and offset goes on: the others' strings all
    occur in it, earlier. So a hot passage has a place for each batch, not for each document.
    """
    kept = np.ones(len(h), bool)
    _, number, count = np.unique(h, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(count[number] > 1)
    rows = rows[np.lexsort((pos[rows], v[rows], k[rows], h[rows]))]
    sizes = np.array([len(t) for t in texts])
    told = []
    for x in np.split(rows, np.arange(COLLAPSED, len(rows), COLLAPSED)) if len(rows) else ():
        x = x[np.lexsort((pos[x], v[x], k[x]))]
        docs, doc = np.unique(of[x], return_inverse=True)
        flat = np.frombuffer(b"".join(bytes(SIDE) + texts[d] + bytes(CONTEXT) for d in docs.tolist()), np.uint8)
        start = np.cumsum(sizes[docs] + SIDE + CONTEXT) - (sizes[docs] + SIDE + CONTEXT)
        c = flat[(start[doc] + pos[x])[:, None] + np.arange(CONTEXT)[None, :]]
        p = pos[x].astype(np.int64) - SIDE
        lo, hi = np.maximum(0, -p), np.minimum(SIDE + 1, sizes[of[x]] - REPEAT + 1 - p)
        gone = _copies(c, lo, hi)
        kept[x[gone]] = False
        told.append((k[x[gone]], v[x[gone]], (p + lo)[gone], (p + hi - 1 + REPEAT)[gone]))
    return kept, [np.concatenate(y) if told else np.zeros(0, np.int64) for y in (zip(*told, strict=True) if told else [()] * 4)]


def _anchor_rows(rows: DataFrame, parts: int) -> DataFrame:
    """Anchors by part, and ranges that a batch alone tells; of the copies of a text in a batch the first by k stands for all."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.iloc[np.lexsort((batch["k"], batch["v"]))].drop_duplicates("v")
            texts = [(t or "").encode() for t in batch["t"]]
            k, v = batch["k"].to_numpy(np.int64), batch["v"].to_numpy(np.int64)
            sizes = np.array([len(t) for t in texts])
            found = []
            for a, b in _chunks(sizes, 1 << 18):  # small enough for the processor's cache
                ends = np.cumsum(sizes[a:b])
                at, h = anchors(np.frombuffer(b"".join(texts[a:b]), np.uint8), ends)
                of = np.searchsorted(ends, at, "right")
                found.append((h, a + of, (at - (ends - sizes[a:b])[of]).astype(np.int32)))
            h, of, pos = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
            kept, told = _collapsed(texts, of, h, k[of], v[of], pos)
            h, of, pos = h[kept], of[kept], pos[kept]
            none = np.zeros(0, np.int64)
            made = [(*x, none, none, none, none) for x in _split((h % np.uint64(parts)).astype(np.int64), h.view(np.int64), k[of], v[of], pos)]
            made += [(x[0], none, none, none, none, *x[1:]) for x in _split(told[1] % parts, *told)]
            yield pd.DataFrame(made, columns=["part", "h", "k", "v", "pos", "dk", "dv", "da", "db"])

    return rows.mapInPandas(scan, "part long, h array<long>, k array<long>, v array<long>, pos array<int>, dk array<long>, dv array<long>, da array<int>, db array<int>")


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        total += int(n)
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _by_document(k: np.ndarray, v: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """(k, v, [each column in pieces]) of rows in order of document."""
    cut = np.flatnonzero((k[1:] != k[:-1]) | (v[1:] != v[:-1])) + 1
    first = np.append(0, cut)
    return k[first], v[first], [np.split(c, cut) for c in columns]


def _repeated_anchors(group: pd.DataFrame) -> pd.DataFrame:
    """The anchors of a part that occur at two places or more, and the hot ones, copies of whole texts counted once; and
    the ranges told already."""
    h, k, v, pos, dk, dv, da, db = (np.concatenate(group[c].to_list()) for c in ("h", "k", "v", "pos", "dk", "dv", "da", "db"))
    out = [pd.DataFrame({"k": k[:0], "v": v[:0], **{c: pd.Series([], dtype=object) for c in ("pos", "hot", "da", "db")}})]
    none = np.zeros(0, np.int32)
    if len(dk):
        order = np.lexsort((da, dv, dk))
        k_, v_, (a, b) = _by_document(*(x[order] for x in (dk, dv, da, db)))
        out.append(pd.DataFrame({"k": k_, "v": v_, "pos": [none] * len(k_), "hot": [none] * len(k_), "da": a, "db": b}))
    order = np.lexsort((k, pos, v, h))
    h, k, v, pos = h[order], k[order], v[order], pos[order]
    new = np.append(True, (h[1:] != h[:-1]) | (v[1:] != v[:-1]) | (pos[1:] != pos[:-1]))[: len(h)]
    h, k, v, pos = h[new], k[new], v[new], pos[new]
    same = h[1:] == h[:-1]
    many = (np.append(same, False) | np.append(False, same))[: len(h)]
    number = np.append(0, np.cumsum(~same))[: len(h)]
    hot = (np.bincount(number)[number] > HOT)[many]
    k, v, pos = k[many], v[many], pos[many]
    if len(k):
        order = np.lexsort((pos, v, k))
        k_, v_, (at, marks) = _by_document(*(x[order] for x in (k, v, pos, hot)))
        out.append(pd.DataFrame({"k": k_, "v": v_, "pos": at, "hot": [a[m] for a, m in zip(at, marks, strict=True)], "da": [none] * len(k_), "db": [none] * len(k_)}))
    return pd.concat(out)


def _first_of_each(*columns: np.ndarray) -> np.ndarray:
    """Marks the first of equal rows among ordered ones: rows of one document that the table repeats count once."""
    return np.append(True, np.any([x[1:] != x[:-1] for x in columns], axis=0))


def _copies(c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Marks contexts, in order of document and offset, that equal an earlier one byte for byte, with all its strings."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint64)
        for word in np.ascontiguousarray(c).view("<u8").T:
            h = mix(h + word)
    _, first, same = np.unique(h, return_index=True, return_inverse=True)
    head = first[same]
    copy = (head != np.arange(len(c))) & (lo[head] <= lo) & (hi[head] >= hi)
    copy[copy] = (c[copy] == c[head[copy]]).all(axis=1)
    return copy


def _context_rows(rows: DataFrame, parts: int) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["pos"].map(len).to_numpy()
            for a, b in _chunks(sizes, 50_000):
                cs, ks, vs, ps, los, his, hots = [], [], [], [], [], [], []
                for k, v, t, found, hot in zip(*(batch[c].iloc[a:b] for c in ("k", "v", "t", "pos", "hot")), strict=True):
                    text = np.frombuffer(t.encode(), np.uint8)
                    pos = np.asarray(found).astype(np.int64)
                    padded = np.concatenate([np.zeros(SIDE, np.uint8), text, np.zeros(CONTEXT, np.uint8)])
                    c = padded[pos[:, None] + np.arange(CONTEXT)[None, :]]
                    cs.append(c)
                    hots.append(np.isin(pos, hot))
                    ks.append(np.full(len(pos), k))
                    vs.append(np.full(len(pos), v))
                    ps.append(pos - SIDE)
                    los.append(np.maximum(0, SIDE - pos))
                    his.append(np.minimum(SIDE + 1, len(text) - REPEAT + 1 - (pos - SIDE)))
                c, k, v, p, lo, hi, hot = (np.concatenate(x) for x in (cs, ks, vs, ps, los, his, hots))
                order = np.lexsort((p, v, k))
                order = order[_first_of_each(k[order], v[order], p[order])]
                c, k, v, p, lo, hi, hot = (x[order] for x in (c, k, v, p, lo, hi, hot))
                copy = _copies(c, lo, hi)
                split = hot & ~copy
                picked = [np.flatnonzero(~split), np.flatnonzero(split & (lo < MIDDLE)), np.flatnonzero(split & (hi > MIDDLE))]
                band = np.repeat([0, 1, 2], list(map(len, picked)))
                c, k, v, p, lo, hi, copy = (x[np.concatenate(picked)] for x in (c, k, v, p, lo, hi, copy))
                lo, hi = np.where(band == 2, np.maximum(lo, MIDDLE), lo), np.where(band == 1, np.minimum(hi, MIDDLE), hi)
                key = np.zeros(len(c), np.uint64)
                for words in (np.ascontiguousarray(c[:, SIDE:REPEAT]), _half(c, band)):
                    for word in words.view("<u8").T:
                        key = mix(key + word)
                part = (key % np.uint64(parts)).astype(np.int64)
                made = []
                for g, at in _split(part, np.arange(len(part))):
                    new, old = at[~copy[at]], at[copy[at]]
                    made.append((g, c[new].tobytes(), band[new], k[new], v[new], p[new], lo[new], hi[new], k[old], v[old], (p + lo)[old], (p + hi - 1 + REPEAT)[old]))
                yield pd.DataFrame(made, columns=["part", "c", "band", "k", "v", "p", "lo", "hi", "dk", "dv", "da", "db"])

    return rows.mapInPandas(scan, "part long, c binary, band array<int>, k array<long>, v array<long>, p array<int>, lo array<int>, hi array<int>, dk array<long>, dv array<long>, da array<int>, db array<int>")


def _half(c: np.ndarray, band: np.ndarray) -> np.ndarray:
    """HALF bytes that all strings of a context's band hold besides the q-gram: those before or behind it; zeros in band 0."""
    out = np.zeros((len(c), HALF), np.uint8)
    out[band == 1] = c[band == 1, SIDE - HALF : SIDE]
    out[band == 2] = c[band == 2, REPEAT : REPEAT + HALF]
    return out


def _ranges(group: pd.DataFrame) -> pd.DataFrame:
    """Byte ranges of a part's documents whose strings occur earlier, some q-grams at a time."""
    c = np.frombuffer(b"".join(group["c"]), np.uint8).reshape(-1, CONTEXT)
    told = [np.concatenate(group[x].to_list()) for x in ("dk", "dv", "da", "db")]
    band, k, v, p, lo, hi = (np.concatenate(group[x].to_list()).astype(np.int64) for x in ("band", "k", "v", "p", "lo", "hi"))
    out = [pd.DataFrame(dict(zip(("k", "v", "a", "b"), told, strict=True)))]
    if not len(c):
        return out[0]
    del group
    words = np.concatenate([c[:, SIDE:REPEAT], _half(c, band)], axis=1).view(">u8")
    order = np.lexsort((p, v, k, band, *words.T))  # by q-gram, then by document and offset
    same = (words[order[1:]] == words[order[:-1]]).all(axis=1) & (band[order[1:]] == band[order[:-1]])
    number = np.append(0, np.cumsum(~same))
    for a, b in _chunks(np.bincount(number), CONTEXTS_AT_ONCE):
        rows = order[np.searchsorted(number, a) : np.searchsorted(number, b)]
        rows = rows[np.lexsort((band[rows], p[rows], v[rows], k[rows]))]
        rows = rows[_first_of_each(k[rows], v[rows], p[rows], band[rows])]
        copy = _copies(c[rows], lo[rows], hi[rows])
        gone, rows = rows[copy], rows[~copy]
        out.append(pd.DataFrame({"k": k[gone], "v": v[gone], "a": (p + lo)[gone], "b": (p + hi - 1 + REPEAT)[gone]}))
        row, x, y = later_runs(c[rows], lo[rows], hi[rows], p[rows])
        out.append(pd.DataFrame({"k": k[rows][row], "v": v[rows][row], "a": x, "b": y}))
    return pd.concat(out)


def _merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The union of the ranges [a, b), touching ones joined."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    return list(zip(a[new].tolist(), b[np.append(new[1:] - 1, len(b) - 1)].tolist(), strict=True))


def repeated_ranges(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, found): docs as (k, v, doc_id, t) and the byte ranges (k, v, r) to remove from each.

    k orders the documents (null first), v tells texts of one doc_id apart. Three passes: anchors, which are q-grams at
    sampled offsets, in buckets by hash; the bytes around those that share a bucket, whose suffixes are refined to
    REPEAT bytes by bucket pointers; and the ranges per document. Copies of a whole text are told by two checksums and
    length; all other strings are compared byte by byte. What is shuffled by anchor comes in parts whose number grows
    with the bytes of the corpus. Before that each batch keeps one place of equal contexts, so a passage that many
    documents share has as many places as there are batches; an anchor that is hot all the same, by different contexts,
    is dealt by HALF more bytes, in two bands of offsets.
    """
    store = Store(docs.sparkSession, "bytes")
    body = text_or_empty(F.col(text))
    rows = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(FIRST)).alias("k"), F.xxhash64(body).alias("v"), F.col(doc).cast("long").alias("doc_id"), body.alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BYTES_A_PART)
    candidates = store.keep(
        _anchor_rows(rows.select("k", "v", "t"), parts).groupBy("part").applyInPandas(_repeated_anchors, "k long, v long, pos array<int>, hot array<int>, da array<int>, db array<int>")
    )
    told = candidates.filter(F.size("da") > 0).select("k", "v", F.inline(F.arrays_zip(F.col("da").alias("a"), F.col("db").alias("b"))))
    asked = candidates.filter(F.size("pos") > 0).groupBy("k", "v").agg(F.flatten(F.collect_list("pos")).alias("pos"), F.flatten(F.collect_list("hot")).alias("hot"))
    texts = rows.select("k", "v", "t").join(asked, ["k", "v"])
    ranges = store.keep(_context_rows(texts, parts).groupBy("part").applyInPandas(_ranges, "k long, v long, a int, b int"))
    plain = rows.select("k", "v", F.octet_length("t").alias("n"), F.crc32("t").alias("crc"))
    heads = plain.groupBy("v", "n", "crc").agg(F.min("k").alias("head"), F.max("k").alias("last")).filter("head < last")
    copies = plain.filter(F.col("n") >= REPEAT).join(heads, ["v", "n", "crc"]).filter("k > head").select("k", "v", F.lit(0).alias("a"), F.col("n").alias("b"))
    found = store.keep(ranges.unionByName(told).unionByName(copies).groupBy("k", "v").agg(F.collect_list(F.struct("a", "b")).alias("r")))
    return rows, store.release(found)


def without_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs.

    A byte goes if a string of REPEAT bytes that covers it also starts earlier: in a document of smaller doc_id, or
    before it in the same one. Strings are judged on the input and never cross documents. Null texts are empty; a null
    doc_id comes before all others; equal rows are one document and get one result each; an empty table gives no rows;
    other columns aren't read.
    """
    rows, found = repeated_ranges(docs, doc, text)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for t, a, b in zip(batch["t"], batch["a"], batch["b"], strict=True):
                data = t.encode()
                spans = _merged(np.asarray(a), np.asarray(b)) if a is not None else []
                digest, at = hashlib.sha256(), 0
                for start, end in spans:
                    digest.update(data[at:start])
                    at = end
                digest.update(data[at:])
                made.append((len(data), sum(end - start for start, end in spans), len(spans), digest.hexdigest()))
            out = pd.DataFrame(made, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "doc_id", ids_of(batch).array)
            yield out.astype({"doc_id": "Int64"})

    return rows.join(found, ["k", "v"], "left").select(*id_columns(F.col("doc_id")), "t", F.col("r.a").alias("a"), F.col("r.b").alias("b")).mapInPandas(scan, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

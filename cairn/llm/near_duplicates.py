"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, WordHashes, mix, windows
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: BANDS bands of ROWS components: a pair of probability Jaccard 0.8 shares no band once in 20 million.
BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
SHINGLES_AT_ONCE = 400_000
#: Texts of a bucket that one group of the join has of either side, about.
BLOCK = 2000
#: Components of the sketches by which pairs of a bucket are screened, first some and then all, and how many must
#: agree. A component of a pair of similarity 0.8 agrees with probability 0.8125, so either screen loses such a pair
#: less than once in 100,000, and pairs above 0.8 far more rarely.
SKETCH, FIRST, LEAST_FIRST, LEAST_ALL = 512, 128, 85, 378
_ARRIVAL, _REGISTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def weighted_shingles(text: str | None, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's shingles, ascending, and how often each occurs. Words are cut at white space, A-Z lowered."""
    words = known.of((text or "").encode().lower().split())
    return np.unique(windows(words, SHINGLE), return_counts=True)


def probminhash(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """(n, size) signatures; a component of two texts agrees with the probability Jaccard of their weighted shingles.

    Every shingle is a Poisson process whose rate is its weight; each arrival picks a register, and a register keeps
    the shingle that arrived first. Arrivals come in rounds; a shingle stops once its next arrival is later than
    every register of its text.
    """
    first = np.full(n * size, np.inf)
    kept = np.zeros(n * size, np.uint64)
    time = np.zeros(len(keys))
    weights = weights.astype(float)
    with np.errstate(over="ignore"):
        step = np.uint64(0)
        while len(keys):
            step += np.uint64(1)
            u = (mix(keys + step * _ARRIVAL) >> np.uint64(11)).astype(float)
            time = time - np.log((u + 0.5) * 2.0**-53) / weights
            latest = first.reshape(n, size).max(axis=1)
            on = time < latest[owner]
            keys, weights, owner, time = keys[on], weights[on], owner[on], time[on]
            at = owner * size + (mix(keys ^ (step * _REGISTER)) % np.uint64(size)).astype(np.int64)
            np.minimum.at(first, at, time)
            won = first[at] == time
            kept[at[won]] = keys[won]
    return kept.reshape(n, size)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of the bands."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    with np.errstate(over="ignore"):
        out = np.arange(BANDS, dtype=np.uint64)[None, :] * _ARRIVAL
        for r in range(ROWS):
            out = mix(out + parts[:, :, r])
    return out


def sketches(signatures: np.ndarray) -> np.ndarray:
    """Four bits of each component, sixteen components to a number."""
    nibbles = (mix(signatures) & np.uint64(15)).reshape(len(signatures), -1, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def _alike_components(a: Column, b: Column) -> Column:
    """How many of the 16 components in two numbers agree."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.lit(16) - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The exact similarity: sum over common x of 1 / sum over all y of max(a_y / a_x, b_y / b_x)."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio, where = np.unique(x / y, return_inverse=True)
    if len(ratio) == 1:
        total = np.array([np.maximum(x, y * ratio[0]).sum() + only_a + only_b * ratio[0]])
    else:
        total = np.array([np.maximum(x, y * r).sum() + only_a + only_b * r for r in ratio])
    return float((x / total[where]).sum())


def _text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that name a text."""
    return [F.xxhash64(text).alias("r1"), F.xxhash64(F.lit(1), text).alias("r2")]


def _signed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc_id, r1, r2, digest, bands): of each row, two hashes of its text, a digest of its words and the keys of its bands.

    The digest is null without words.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        known = WordHashes()
        for batch in batches:
            texts = batch["t"].tolist()
            start = 0
            while start < len(texts):
                keys, weights, digests, n, end = [], [], [], 0, start
                while end < len(texts) and n < SHINGLES_AT_ONCE:
                    words = (texts[end] or "").encode().lower().split()
                    k, w = np.unique(windows(known.of(words), SHINGLE), return_counts=True)
                    keys.append(k)
                    weights.append(w)
                    digests.append(xxhash.xxh128_hexdigest(b" ".join(words)) if words else None)
                    n += len(k)
                    end += 1
                owner = np.repeat(np.arange(end - start), [len(k) for k in keys])
                bands = band_keys(probminhash(np.concatenate(keys), np.concatenate(weights), owner, end - start)).view(np.int64)
                yield batch[["k", "e", "r1", "r2"]].iloc[start:end].assign(digest=digests, bands=list(bands))
                start = end

    k = F.col(doc).cast("long")  # a null would make pandas turn the column into floats
    rows = docs.select(F.coalesce(k, F.lit(0)).alias("k"), k.isNull().alias("e"), *_text_key(F.col(text)), F.col(text).alias("t"))
    signed = rows.mapInPandas(scan, "k long, e boolean, r1 long, r2 long, digest string, bands array<long>")
    return signed.select(F.when(~F.col("e"), F.col("k")).alias("doc_id"), "r1", "r2", "digest", "bands")


def _shingle_table(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(u, s, w, sketch): each text's shingles, how often they occur, and its sketch."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            ids, texts = batch["k"].to_numpy(), batch["t"].tolist()
            for a in range(0, len(texts), 200):
                made = [weighted_shingles(t, known) for t in texts[a : a + 200]]
                keys, weights = (np.concatenate(x) for x in zip(*made, strict=True))
                owner = np.repeat(np.arange(len(made)), [len(k) for k, _ in made])
                sketch = sketches(probminhash(keys, weights, owner, len(made), SKETCH)).view(np.int64)
                yield pd.DataFrame({"u": ids[a : a + 200], "s": [k.view(np.int64) for k, _ in made], "w": [w.astype(np.int32) for _, w in made], "sketch": list(sketch)})

    return docs.select(F.col(doc).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(scan, "u long, s array<long>, w array<int>, sketch array<long>")


def _verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact similarity is SIMILARITY or more, with it."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            alike = [
                probability_jaccard(np.asarray(sa).view(np.uint64), np.asarray(wa), np.asarray(sb).view(np.uint64), np.asarray(wb))
                for sa, wa, sb, wb in zip(batch["sa"], batch["wa"], batch["sb"], batch["wb"], strict=True)
            ]
            out = pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": alike})
            yield out[out["similarity"] >= SIMILARITY]

    one = shingles.select(F.col("u").alias("a"), F.col("s").alias("sa"), F.col("w").alias("wa"))
    two = shingles.select(F.col("u").alias("b"), F.col("s").alias("sb"), F.col("w").alias("wb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "wa", "sb", "wb").mapInPandas(scan, "a long, b long, similarity double")


def _screened_pairs(named: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts of different classes that share a band and may be alike; named has (band, u, c, bands, sketch).

    In each bucket only texts outside its largest class are paired with the others. Both sides of a bucket are cut into
    blocks of about BLOCK texts, and blocks meet in groups of their own, so a hot bucket is spread over the tasks. A
    pair comes out once, at the first band it shares, if its sketches agree well enough, so what leaves the join is near
    the number of links.
    """
    sizes = named.groupBy("band", "c").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "c"))
    main = sizes.groupBy("band").agg(largest.alias("m"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    main = main.select("band", F.col("m.c").alias("main"), blocks(F.col("all") - F.col("m.n")).alias("nx"), blocks(F.col("all")).alias("ny"))
    entries = named.join(main, "band")
    own = lambda n: F.pmod(F.xxhash64("u"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    x = entries.filter("c <> main").withColumn("block", own(F.col("nx"))).select("band", F.col("u").alias("x"), F.col("c").alias("cx"), F.col("bands").alias("bx"), F.col("sketch").alias("sx"), "block", every(F.col("ny")).alias("with"))
    y = entries.withColumn("with", own(F.col("ny"))).withColumn("block", every(F.col("nx"))).select(F.col("band").alias("band_y"), F.col("block").alias("block_y"), F.col("with").alias("with_y"), F.col("u").alias("y"), F.col("c").alias("cy"), F.col("c").eqNullSafe(F.col("main")).alias("inside"), F.col("bands").alias("by"), F.col("sketch").alias("sy"))
    some = sum(_alike_components(F.col("sx")[i], F.col("sy")[i]) for i in range(FIRST // 16))
    all_ = F.aggregate(F.zip_with("sx", "sy", _alike_components), F.lit(0), lambda n, k: n + k)
    shared = F.filter(F.zip_with("bx", "by", lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull())
    once = F.col("inside") | (F.col("x") < F.col("y"))
    on = (F.col("band") == F.col("band_y")) & (F.col("block") == F.col("block_y")) & (F.col("with") == F.col("with_y")) & (F.col("cx") != F.col("cy")) & once & (some >= LEAST_FIRST) & (all_ >= LEAST_ALL) & (shared[0] == F.col("band"))
    return x.join(y, on).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _classified(docs: DataFrame, store: Store, doc: str, text: str) -> DataFrame:
    """(doc_id, r1, r2, digest, c, class_id) of each row: c numbers the classes of texts with words, class_id names them."""
    signed = store.keep(_signed(docs, doc, text))
    first = F.min(F.struct("r1", "r2"))
    grouped = signed.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), first.alias("r"))
    # written once, so the numbers stay
    texts = store.keep(grouped.select("digest", "least", "bands", "r.*", F.monotonically_increasing_id().alias("u")))
    members = texts.select("u", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = store.keep(members.join(buckets, "band"))
    met = store.keep(shared.groupBy("u").agg(F.sum("n").alias("met")))
    heads = shared.join(met, "u").groupBy("band").agg(F.max(F.struct("met", F.xxhash64("u").alias("h"), "u"))["u"].alias("head"))
    pairs = store.keep(
        shared.join(heads, "band").filter("u <> head").select(F.least("u", "head").alias("a"), F.greatest("u", "head").alias("b")).distinct()
    )
    wanted = store.keep(texts.select("u", "r1", "r2").join(met, "u", "left_semi"))
    # each task drops copies before texts are dealt, once; the join keeps that partitioning
    once = docs.select(*_text_key(F.col(text)), F.col(text).alias("t")).dropDuplicates(["r1", "r2"])
    shingles = store.keep(_shingle_table(once.join(wanted, ["r1", "r2"]), "u", "t"))
    links = store.keep(_verified(pairs, shingles))
    labels = components(links, store)
    named = store.keep(shared.select("band", "u").join(labels, F.col("u") == F.col("v"), "left").select("band", "u", F.coalesce("c", "u").alias("c")))
    mixed = named.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("band")
    left = named.join(mixed, "band", "left_semi").join(texts.select("u", "bands"), "u").join(shingles.select("u", "sketch"), "u")
    more = store.keep(_verified(_screened_pairs(store.keep(left)), shingles))
    labels = components(links.unionByName(more), store)
    numbered = store.keep(texts.join(labels, F.col("u") == F.col("v"), "left").select("digest", "least", F.coalesce("c", "u").alias("c")))
    # a class that only null ids carry has a negative number made from its least digest
    unnamed = -F.shiftrightunsigned(F.xxhash64(F.min("digest")), 1) - 1
    names = numbered.groupBy("c").agg(F.coalesce(F.min("least"), unnamed).alias("class_id"))
    classes = store.keep(numbered.join(names, "c").select("digest", "c", "class_id"))
    return store.release(signed.select("doc_id", "r1", "r2", "digest").join(classes, "digest", "left"))


def duplicate_classes(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id) of each row of docs: class_id is the least doc_id of its class of near copies.

    A class is a connected component of links; a link is a probability Jaccard of five-word shingles, weighted by how
    often they occur, of 0.8 or more (word order alone counts in a text of fewer words). Equal word sequences are one
    text first. Among texts that share a band, every text is verified against the bucket's head, the text that meets
    most others over all its bands. Texts of different classes that still share a bucket are screened by longer
    sketches and verified pair by pair, so a large group costs about its size in verified pairs, and no link between
    its classes is left out.
    Texts without words are alone in their classes. A null doc_id takes the class of its text; a class that only null
    ids carry has a negative number made from its words. Rows of one doc_id with different texts are classed by their
    texts, and two classes whose least doc_id is the same have that one name; repeated rows share a class; an empty table gives no rows; other columns aren't read.
    """
    rows = _classified(docs, Store(docs.sparkSession, "near"), doc, text)
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, the least by doc_id (nulls last) and words; columns unchanged.

    Texts without words are one document for each doc_id; with a null doc_id all of them stay.
    """
    store, near = Store(docs.sparkSession, "dedup"), Store(docs.sparkSession, "near")
    classified = _classified(docs, near, "doc_id", "text")
    key = F.struct(F.col("doc_id").isNull().alias("e"), "doc_id", "digest", "r1", "r2")
    group = F.struct("c", F.when(F.col("c").isNull(), F.col("doc_id")).alias("d"))
    rows = store.keep(classified.filter("c is not null or doc_id is not null").select(group.alias("g"), key.alias("key")))
    # rows that meet others of their class are few, so only they are compared as rows
    many = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).filter("n > 1").select("g", "least")
    met = rows.join(many, "g").select("key.e", "key.r1", "key.r2", F.coalesce("key.doc_id", F.lit(0)).alias("k"), F.col("key").eqNullSafe(F.col("least")).alias("first"))
    named = ["e", "k", "r1", "r2"]
    met = near.release(store.release(store.keep(met.groupBy(*named).agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("n")))))
    # the texts are dealt once, each with its row; only equal rows of the kept ones are gathered
    r1, r2 = _text_key(F.col("text"))
    k = F.col("doc_id").cast("long")
    dealt = docs.select(F.struct("*").alias("row"), k.isNull().alias("e"), F.coalesce(k, F.lit(0)).alias("k"), r1, r2).join(met, named, "left")
    once = dealt.filter("first is null or first and n = 1").select("row")
    repeated = dealt.filter("first and n > 1").dropDuplicates(named).select("row")
    return once.unionByName(repeated).select("row.*")

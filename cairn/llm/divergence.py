"""How far the sources of a language lie apart: the most telling terms of each, and sums over all terms for each pair."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, text_or_empty

#: Documents of a language that a kept term is in at least, terms reported for a group, and what a probability of 1 is.
LEAST_DOCS, TOP, ONE = 3, 200, 1_000_000_000
#: Entries that a task adds up before it hands them on; counts up to EXACT have a bucket each, larger ones EIGHTH an octave.
HELD, EXACT, EIGHTH = 400_000, 32, 8
#: ASCII letters and all other characters beyond ASCII make up terms; A-Z become small.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
SCHEMA = "lang string, source string, part string, item string, value long, rank int"


def group_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs) as tasks add them up, several rows for a term; the term '' stands for the group itself."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (of_lang, of_source), (counts, seen) in held.items():
                terms = [t.decode("utf-8", "replace") for t in counts]
                n = len(terms)
                columns = [pa.array([of_lang] * n, pa.string()), pa.array([of_source] * n, pa.string()), pa.array(terms, pa.string()), pa.array(counts.values(), pa.int64()), pa.array([seen[t] for t in counts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for of_lang, of_source, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts, seen = held.setdefault((of_lang, of_source), (Counter(), Counter()))
                before = len(counts)
                own = Counter(body.encode().translate(LETTERS).split())
                own[b""] = 0
                for term, n in own.items():
                    counts[term] += n
                seen.update(own.keys())
                size += len(counts) - before
                if size > HELD:
                    yield from handed_on()
                    size = 0
        yield from handed_on()

    return docs.select(*(text_or_empty(F.col(c)).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text")))).mapInArrow(scan, "lang string, source string, term string, n long, docs long")


def over(a: Column, b: Column) -> Column:
    """Whole-numbered quotient."""
    return F.call_function("div", a, b)


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(ONE * (count + 1) / (total + terms)), by long division in steps of 1000, so that no product leaves 64 bits."""
    below = total + terms
    rest, value = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        step = over(rest * 1000, below)
        value, rest = value * 1000 + step, rest * 1000 - step * below
    return value + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return over((p - q) * (p - q), q)


def bucket(count: Column) -> Column:
    """A number for each small count, and for each eighth of an octave of larger ones."""
    return F.when(count < EXACT, count).otherwise(F.lit(EXACT) + F.floor(F.log2(count.cast("double")) * EIGHTH)).cast("int")


def top_terms(terms: DataFrame, store: Store, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms of each group with the largest f among those with p > q.

    Terms of a group are put into buckets by count. The largest p and the least q of a bucket bound f in it from above.
    Buckets are taken best bound first until they hold enough terms; the least value of the top of these is what others
    must reach. Then the rest of the buckets whose bound reaches it is evaluated, and none whose bound is strictly below.
    """
    group = ["lang", "source"]
    more = terms.filter("p > q")
    buckets = more.groupBy(*group, "bucket").agg(F.count("*").alias("n"), F.max("p").alias("p"), F.min("q").alias("q"))
    buckets = buckets.withColumn("bound", divergence(F.col("p"), F.col("q")))  # hundreds a group, whatever the corpus
    ahead = Window.partitionBy(*group).orderBy(F.col("bound").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = store.keep(buckets.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)) < top).select(*group, "bucket", "bound", "first"))
    best = Window.partitionBy(*group).orderBy(F.col("value").desc(), "item")

    def evaluated(some: DataFrame) -> DataFrame:
        rows = more.join(some.select(*group, "bucket"), [*group, "bucket"], "left_semi")
        return rows.select(*group, F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))

    def leading(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    first = store.keep(leading(evaluated(buckets.filter("first"))))
    kth = store.keep(first.filter(F.col("rank") == top).select(*group, F.col("value").alias("kth")))
    reaching = buckets.filter("not first").join(kth, group, "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
    return leading(first.drop("rank").unionByName(evaluated(reaching)))


def shared_terms(postings: DataFrame) -> DataFrame:
    """(lang, source, item, value): what the terms that both sources have add to a pair's sum beyond its other parts.

    A posting has a term's sources with p and p0; tasks add up what they read, so a pair of sources makes few rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            keys = list(sums)
            out = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([sums[k] for k in keys], pa.int64())], ["lang", "source", "item", "value"])
            sums.clear()
            return out

        for batch in batches:
            lists = batch.column("s")
            flat = lists.flatten()
            lengths = np.diff(np.asarray(lists.offsets))
            langs, names = batch.column("lang").dictionary_encode(), flat.field("source").dictionary_encode()
            labels, name = langs.dictionary.to_pylist(), names.dictionary.to_pylist()
            of_lang = np.repeat(np.asarray(langs.indices), lengths)
            code, p, p0 = np.asarray(names.indices).astype(np.int64), np.asarray(flat.field("p")), np.asarray(flat.field("p0"))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            cuts = np.searchsorted(np.cumsum(lengths.astype(np.int64) ** 2), np.arange(0, int((lengths.astype(np.int64) ** 2).sum()), 1_000_000), "right")
            for low, high in zip(cuts, [*cuts[1:], len(lengths)], strict=True):  # postings with about a million pairs
                n = lengths[low:high].astype(np.int64)
                a = np.repeat(np.arange(starts[low], starts[high]), np.repeat(n, n))
                b = np.arange(len(a)) - np.repeat(np.cumsum(n * n) - n * n, n * n)
                b = b % np.repeat(n, n * n) + np.repeat(starts[low:high], n * n)
                a, b = a[a != b], b[a != b]
                f = lambda x, y: (x - y) ** 2 // y
                value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
                key = (of_lang[a] * len(name) + code[a]) * len(name) + code[b]
                found, at = np.unique(key, return_inverse=True)
                total = np.zeros(len(found), np.int64)
                np.add.at(total, at, value)
                for k, v in zip(found.tolist(), total.tolist(), strict=True):
                    sums[labels[k // len(name) ** 2], name[k // len(name) % len(name)], name[k % len(name)]] += v
                if len(sums) > HELD:
                    yield handed_on()
        yield handed_on()

    return postings.mapInArrow(scan, "lang string, source string, item string, value long")


def pair_sums(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each group and other source of its language, f summed over all kept terms.

    Over most terms a source has none, so its p is the same p0. The sum is that of p0 against p0 over all terms, what
    the terms of either source change in it alone (from the numbers of terms with each p), and what shared terms add.
    """
    p0 = groups.select("lang", "source", "v", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"))
    p, a, b = F.col("p"), F.col("p0"), F.col("o0")
    pairs = p0.join(other, "lang").filter("source <> item")
    base = pairs.select("lang", "source", "item", (F.col("v") * divergence(a, b)).alias("value"))
    levels = terms.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    met = levels.join(other, "lang").filter("source <> item")
    own = met.select("lang", "source", "item", (F.col("n") * (divergence(p, b) - divergence(a, b))).alias("value"))
    theirs = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("n") * (divergence(b, p) - divergence(b, a))).alias("value"))
    postings = terms.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("s")).filter(F.size("s") > 1).select("lang", "s")
    parts = [x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (own, theirs, shared_terms(postings))]
    whole = base
    for x in parts:
        whole = whole.unionByName(x)
    return whole.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of each group (lang, source): part ``pair`` compares it with each other
    source of its language over all kept terms, part ``term`` has the terms that tell it from the language most.

    Terms are counted in tasks and added up by term, once dealt, so a hot source or term is a row for each task. Everything after
    that goes by distinct terms of groups; numbers are whole and exact. Null text, lang and source are ''. Repeated
    rows are documents of their own; groups without terms have pairs alone; a language without kept terms has sums of
    0; ties go by item; an empty table gives no rows. Other columns are not read.
    """
    store = Store(docs.sparkSession, "divergence")
    dealt = group_terms(docs, lang, source, text).repartition("lang", "term")  # tasks have added up what they read
    counted = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counted.groupBy("lang", "term").agg(F.sum("n").alias("c"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("s"))
    kept = store.keep(by_term.filter((F.col("docs") >= LEAST_DOCS) | (F.col("term") == "")).select("lang", "term", "c", "s"))
    postings = kept.filter("term <> ''")
    rows = postings.select("lang", "term", "c", F.inline("s"))
    langs = postings.groupBy("lang").agg(F.count("*").alias("v"), F.sum("c").alias("lang_n"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = kept.filter("term = ''").select("lang", F.inline("s")).select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", *(F.coalesce(F.col(c), zero).alias(c) for c in ("n", "v", "lang_n")))
    p0 = F.when(F.col("v") > 0, probability(zero, F.col("n"), F.greatest("v", F.lit(1)))).otherwise(1)
    groups = store.keep(groups.withColumn("p0", p0))
    known = groups.select("lang", "source", F.col("n").alias("group_n"), "v", "lang_n", "p0")
    p, q = probability(F.col("n"), F.col("group_n"), F.col("v")), probability(F.col("c"), F.col("lang_n"), F.col("v"))
    terms = store.keep(rows.join(known, ["lang", "source"]).select("lang", "source", "term", bucket(F.col("n")).alias("bucket"), p.alias("p"), q.alias("q"), "p0"))
    store.drop(kept)
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_sums(terms, groups).withColumn("rank", F.row_number().over(best))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").unionByName(named(top_terms(terms, store, top), "term"))

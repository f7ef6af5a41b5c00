"""The source divergence audit against a plain reading of its definition."""

from __future__ import annotations

import collections
import re

import pytest

from cairn.llm import divergence

from ..conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, docs int, part string, value double"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALLER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(rows, top):
    """(lang, source, part, item, value, rank) with dictionaries and Python's whole numbers."""
    docs = [(text or "", lang or "", source or "") for text, lang, source in rows]
    groups, seen, counts = collections.defaultdict(set), collections.Counter(), collections.Counter()
    for text, lang, source in docs:
        groups[lang].add(source)
        terms = [t.translate(SMALLER) for t in TERM.findall(text)]
        seen.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in seen.items() if x == lang and n >= divergence.LEAST_DOCS]
        v = len(kept)
        of_lang = {t: sum(counts[lang, s, t] for s in sources) for t in kept}

        def chances(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (x + 1) // (n + v) for t, x in c.items()}

        q = chances(of_lang)
        p = {s: chances({t: counts[lang, s, t] for t in kept}) for s in sources}
        for s in sources:
            f = lambda a, b: (a - b) ** 2 // b
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, n + 1) for n, (item, value) in enumerate(ranked)]
    return sorted(out)


def rows_of(df):
    return [(r.text, r.lang, r.source) for r in df.select("text", "lang", "source").collect()]


@pytest.mark.parametrize("top", [1, 5, 200])
def test_documents(spark, top):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = divergence.source_divergence(df, top=top).collect()
    assert sorted(map(tuple, got)) == audit(rows_of(df), top)


@pytest.mark.parametrize("held", [5, 400_000])
def test_odd_rows(spark, held, monkeypatch):
    """Nulls, groups without terms, a language without kept terms, ties, repeated rows, letters beyond ASCII, a hot source."""
    monkeypatch.setattr(divergence, "HELD", held)
    texts = [
        ("The CAT sat; the cat's mat", "en", "a"), ("the dog_sat 12 the", "en", "b"), ("THE cat the dog", "en", None), (None, "en", "d"), ("", "en", "e"), ("été ÉTÉ été naïve 😀", "fr", "a"), ("été 😀 naïve", "fr", "b"),
        ("été 😀 seul", "fr", None), ("once", "de", "a"), ("twice", "de", "b"), (None, None, None), ("x y", None, "s"), ("x y", "", "s"), ("x", None, "t"), ("\x00nul\x7fend", "fr", "a"),
    ]
    rows = texts + [("the hot word " * 50 + f"w{chr(97 + i % 9)}", "en", "hot") for i in range(40)] + [texts[0]] * 3
    df = spark.createDataFrame([(i, *r, "t", 1, 2, "p", 0.5) for i, r in enumerate(rows)], SCHEMA)
    got = sorted(map(tuple, divergence.source_divergence(df, top=3).collect()))
    assert got == audit(rows, 3)
    assert {r[1] for r in got if r[0] == "de"} == {"a", "b"} and all(r[4] == 0 for r in got if r[0] == "de")


def test_no_rows(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_top_terms_by_bounds(spark):
    """Buckets whose bounds tie with the last of the top are evaluated too, and the order of ties is that of items."""
    rows = [("en", "a", f"t{i:05d}", 1 + i % 20, 10**6 - i % 3, 1000 + i % 7, 10) for i in range(5000)] + [("en", "a", f"h{i}", 500 + i, 2 * 10**8, 1000, 10) for i in range(10)]
    rows += [("en", "b", f"t{i}", 1 + i % 4, 5000, 1000, 10) for i in range(100)]
    terms = spark.createDataFrame(rows, "lang string, source string, term string, n long, p long, q long, p0 long").withColumn("bucket", divergence.bucket(divergence.F.col("n")))
    for top in (5, 50, 3000):
        got = collections.defaultdict(list)
        for r in sorted(divergence.top_terms(terms, divergence.Store(spark, "bounds"), top).collect(), key=lambda r: r["rank"]):
            got[r.source].append((-r.value, r.item))
        for s in "ab":
            assert got[s] == sorted((-((p - q) ** 2 // q), t) for _, x, t, _, p, q, _ in rows if x == s)[:top]

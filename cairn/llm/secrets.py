"""Secrets in texts: fixed patterns, and strings that a tokenizer finds inefficient."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_columns, ids_of

#: The base kinds, in order; kind -> (pattern, group measured, least characters of it).
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
}
#: A text without any of these has no match of the first pattern.
KEYWORD = re.compile(r"passw|secret|token|api_?k", re.I | re.A)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Lengths of common digests in hexadecimal digits, and of ids in groups.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
#: Parts of identifiers, paths and words: letters alone, or figures alone, or letters with a short number behind.
IDENTIFIER = re.compile(r"(?:[A-Za-z]+\d{0,4}|\d+)?(?:[+/_=-]+(?:[A-Za-z]+\d{0,4}|\d+)?)*")
#: The letters and the figures of one part of an identifier.
NAMED = re.compile(r"([A-Za-z]*)(\d*)")
#: Digests and other parts of a candidate, and its pieces around signs of assignment.
PART = re.compile(rf"(?<![A-Za-z0-9])(?:{DIGEST.pattern})(?![A-Za-z0-9])|[A-Za-z0-9]+", re.I)
PIECE = re.compile(r"[^=]+=*")
#: Fewer characters a token than this mark a random string.
LEAST_RATIO = 2.2
#: Letters of a part that tell nothing if they are fewer, of a part that can be a word between others, and of a string.
LEAST_LETTERS, LEAST_WORD, LEAST_CHARS = 3, 4, 20


def encoder(ranks: bytes, pattern: str):
    """A tiktoken encoding from the lines of a rank file."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _tokens(s: str, encode) -> int:
    return len(encode(s))


def is_random(s: str, encode) -> bool:
    """Few characters a token, and neither a digest nor made of identifier parts whose letters are words by tokens."""
    if DIGEST.fullmatch(s) or len(s) >= LEAST_RATIO * _tokens(s, encode):
        return False
    if not IDENTIFIER.fullmatch(s):
        return True
    letters = [x for x in re.findall("[A-Za-z]+", s) if len(x) >= LEAST_LETTERS]
    return sum(map(len, letters)) < LEAST_RATIO * sum(_tokens(x, encode) for x in letters)


def _is_word(part: str, encode) -> bool:
    """A digest, or a part of an identifier whose letters are words by tokens."""
    if DIGEST.fullmatch(part):
        return True
    if not IDENTIFIER.fullmatch(part):
        return False
    letters = NAMED.match(part)[1]
    return len(letters) >= LEAST_WORD and len(letters) >= LEAST_RATIO * _tokens(letters, encode)


def random_parts(s: str, encode) -> list[tuple[int, int]]:
    """(start, end) of the random strings in a candidate: itself, else its pieces around =, else what is in these.

    In a piece those are the runs of parts between words, and the single parts of a run that isn't random as a whole.
    So readable text before or behind a key doesn't hide it.
    """
    if is_random(s, encode):
        return [(0, len(s))]
    found = []
    long = lambda a, b: b - a >= LEAST_CHARS and is_random(s[a:b], encode)
    for piece in PIECE.finditer(s):
        if len(piece[0]) < LEAST_CHARS:
            continue
        if piece[0] != s and long(*piece.span()):
            found.append(piece.span())
            continue
        runs: list[list[tuple[int, int]]] = [[]]
        for part in PART.finditer(s, *piece.span()):
            if _is_word(part[0], encode):
                runs.append([])
            else:
                runs[-1].append(part.span())
        for run in filter(None, runs):
            a, b = run[0][0], run[-1][1]
            found += [(a, b)] if long(a, b) else [x for x in run if long(*x)]
    return found


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, number of the kind, kind, end) of the base kinds, in order."""
    found = []
    for k, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        if kind != "assign" or KEYWORD.search(text):
            found += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def random_spans(text: str, encode) -> list[tuple[int, int, str, int]]:
    return [(m.start() + a, len(BASE), "random", m.start() + b) for m in CANDIDATE.finditer(text) for a, b in random_parts(m.group(), encode)]


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def secret_spans(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of each row of docs; no shuffle.

    Spans are ``kind:start:end`` in code points over the whole text. ``vocabulary`` is the path of a tiktoken rank
    file that the driver reads; its content (under 1 MB, checked to be under 16 MB) is broadcast. Null and empty
    texts have no spans; repeated rows are treated alike; other columns are not read.
    """
    import public_tokenizers

    spark = docs.sparkSession
    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    if len(ranks) > 16 << 20:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = spark.sparkContext.broadcast((ranks, pattern or public_tokenizers.PATTERN))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for batch in batches:
            rows = []
            for doc, body in zip(ids_of(batch), batch["t"], strict=True):
                body = body or ""
                base = base_spans(body)
                if encode is None and CANDIDATE.search(body):
                    encode = encoder(*shared.value).encode_ordinary
                more = random_spans(body, encode) if encode else []
                kinds = [s[2] for s in base]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((doc, *(kinds.count(k) for k in BASE), digest, _joined(sorted(base + more)), len(more)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return docs.select(*id_columns(F.col(key)), F.col(text).alias("t")).mapInPandas(scan, schema)

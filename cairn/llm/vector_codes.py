"""Vector compression: product codes by Elkan's form of Lloyd's iteration, in whole numbers throughout."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, id_columns

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows whose distances are looked at together; a lower bound is stored in 16 bits, and a larger one held there is still one.
ROWS, HIGHEST = 1024, 65535


def finite(vector: str) -> F.Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & F.coalesce(F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def roots(squares: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down, of whole numbers below 2^62."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def roots_up(squares: np.ndarray) -> np.ndarray:
    r = roots(squares)
    return r + (r * r < squares)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries; in doubles where these hold every whole number that occurs."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 2**53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)


def first_assignment(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row (ties: lower index), squared distance, upper bound and a lower bound for each entry."""
    d = squared(x, entries)
    at = d.argmin(1)
    best = d[np.arange(len(x)), at]
    return at, best, roots_up(best), np.minimum(roots(d), HIGHEST)


def next_assignment(x: np.ndarray, entries: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same after the entries have moved, with distances only where the bounds leave a choice.

    Bounds are shifted by the entries' movement, rounded up. An entry is pruned only where a bound says that it is
    strictly farther than the row's own; all others are compared by exact squared distances, ties to the lower index.
    between: distances between entries, rounded down. The squared distance of a row that keeps its entry unseen is -1.
    """
    upper = upper + moved[at]
    lower = np.maximum(lower - moved[None, :], 0)
    best = np.full(len(x), -1, np.int64)
    own = np.arange(len(entries))[None, :] == at[:, None]

    def open_entries(rows: np.ndarray) -> np.ndarray:
        u = upper[rows, None]
        return (lower[rows] <= u) & (between[at[rows]] <= 2 * u) & ~own[rows]

    rows = np.flatnonzero(open_entries(np.arange(len(x))).any(1))
    if len(rows):
        best[rows] = ((x[rows] - entries[at[rows]]) ** 2).sum(1)
        upper[rows] = roots_up(best[rows])
        lower[rows, at[rows]] = np.minimum(roots(best[rows]), HIGHEST)
        r, j = np.nonzero(open_entries(rows))
        r = rows[r]
        d = ((x[r] - entries[j]) ** 2).sum(1)
        lower[r, j] = np.minimum(roots(d), HIGHEST)
        order = np.lexsort((j, d, r))
        first = order[np.flatnonzero(np.diff(r[order], prepend=-1))]
        r, j, d = r[first], j[first], d[first]
        wins = (d < best[r]) | ((d == best[r]) & (j < at[r]))
        r, j, d = r[wins], j[wins], d[wins]
        at, upper = at.copy(), upper
        at[r], best[r], upper[r] = j, d, roots_up(d)
    return at, best, upper, lower


class Codebooks:
    """The entries of each part position, and what their last movement was."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries  # parts x entries x width
        self.moved = None if before is None else roots_up(((entries - before) ** 2).sum(2))
        self.between = np.stack([roots(squared(e, e)) for e in entries])

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def column(batch: pa.RecordBatch, name: str, kind: type, width: int) -> np.ndarray:
    """A binary column as a matrix."""
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, width)


def binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(matrix)], pa.binary())


def assigned(rows: DataFrame, books: Codebooks, last: bool) -> DataFrame:
    """rows (k, e, y, x and, after the first round, a, u, l) with what a round's assignment gives: the entries a, upper
    bounds u and lower bounds l; the last has code and error instead."""
    parts, n_entries, width = books.entries.shape
    named = "k long, e boolean, y " + dict(rows.dtypes)["y"]
    first = "a" not in rows.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                n = batch.num_rows
                x = column(batch, "x", np.int32, parts * width).astype(np.int64)
                out = {"a": np.zeros((n, parts), np.uint8), "u": np.zeros((n, parts), np.int64), "l": np.zeros((n, parts, n_entries), np.uint16)}
                error = np.zeros(n, np.int64)
                if not first:
                    a, u = column(batch, "a", np.uint8, parts), column(batch, "u", np.int64, parts)
                    lower = column(batch, "l", np.uint16, parts * n_entries).reshape(n, parts, n_entries)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    if first:
                        at, best, up, low = first_assignment(own, books.entries[p])
                    else:
                        at, best, up, low = next_assignment(own, books.entries[p], a[:, p].astype(np.int64), u[:, p], lower[:, p].astype(np.int64), books.moved[p], books.between[p])
                    if last:
                        unseen = best < 0
                        best[unseen] = ((own[unseen] - books.entries[p][at[unseen]]) ** 2).sum(1)
                        error += best
                    out["a"][:, p], out["u"][:, p], out["l"][:, p] = at, up, low
                kept = [batch.column(c) for c in ("k", "e", "y")]
                if last:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array([c.tobytes().hex() for c in out["a"]], pa.string()), pa.array(error)], ["k", "e", "y", "code", "error"])
                else:
                    more = [batch.column("x"), *(binary(out[c].reshape(n, -1)) for c in ("a", "u", "l"))]
                    yield pa.RecordBatch.from_arrays([*kept, *more], ["k", "e", "y", "x", "a", "u", "l"])

    return rows.mapInArrow(scan, f"{named}, code string, error long" if last else f"{named}, x binary, a binary, u binary, l binary")


def moved_entries(state: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the componentwise floor of its parts' mean; unused ones stay.

    Tasks add up what they read; the driver gets a row for each entry in use, so a number of rows set by the parameters.
    """
    parts, n_entries, width = books.entries.shape
    sums = [f"s{i}" for i in range(width)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, n_entries, width), np.int64), np.zeros((parts, n_entries), np.int64)
        for batch in batches:
            x = column(batch, "x", np.int32, parts * width).astype(np.int64)
            a = column(batch, "a", np.uint8, parts)
            for p in range(parts):
                np.add.at(total[p], a[:, p], x[:, p * width : (p + 1) * width])
                count[p] += np.bincount(a[:, p], minlength=n_entries)
        p, j = np.nonzero(count)
        values = [pa.array(p.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(count[p, j]), *(pa.array(total[p, j, i]) for i in range(width))]
        yield pa.RecordBatch.from_arrays(values, ["p", "j", "n", *sums])

    partial = state.select("x", "a").mapInArrow(scan, "p int, j int, n long, " + ", ".join(f"{s} long" for s in sums))
    entries = books.entries.copy()
    for r in partial.groupBy("p", "j").agg(*(F.sum(c).alias(c) for c in ("n", *sums))).collect():
        entries[r.p, r.j] = [r[s] // r.n for s in sums]
    return Codebooks(entries, books.entries)


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, label: str, parts: int) -> tuple[DataFrame, int]:
    """(k, e, y, x), the rows that take part, and their common length; x is the array of floor(1024 * component).

    Shorter vectors, and a length that the parts don't divide, are filled up with zeros. Rows of which a component lies
    beyond the range in which every squared distance fits a long are left out like those with components that aren't finite.
    """
    kept = vectors.select(*id_columns(F.col(vec_id)), F.col(label).alias("y"), F.col(vector).alias("x")).filter(finite("x"))
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 1
    length = -(-longest // parts) * parts
    bound = min(2**30, int((2**62 / length) ** 0.5 / 2))
    x = F.transform("x", lambda c: F.floor(c.cast("double") * SCALE))
    fits = F.forall("x", lambda c: F.abs(c.cast("double")) * SCALE < bound)
    padded = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("x")))
    return kept.filter(fits).withColumn("x", F.transform(padded, lambda c: c.cast("int"))), length


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row whose vector is there and finite.

    After each round's assignment a table holds, for every row, its parts' entries, an upper bound of the distance to
    each and a lower bound for every entry (2 bytes each); the next round reads it, shifts the bounds and computes only
    distances that they leave open. Bounds are whole numbers rounded to the safe side, so the codes are those of plain
    Lloyd, ties included. Two such tables exist at a time. Work on a row doesn't depend on others, so hot labels and
    repeated vectors make no uneven tasks.

    Codebooks start with the rows of the n_entries (256 at most) smallest ids, null ids last, equal ids by vector; with
    fewer rows there are fewer entries. Repeated rows count as often as they occur; an empty table gives no rows. See
    whole_vectors() for vectors of other lengths and of very large components; other columns are not read.
    """
    store = Store(vectors.sparkSession, "codes")
    ready, length = whole_vectors(vectors, vec_id, vector, label, parts)
    first = [r.x for r in ready.orderBy("e", "k", "x").limit(n_entries).select("x").collect()]
    shape = (len(first), parts, length // parts)
    books = Codebooks(np.array(first, np.int64).reshape(shape).transpose(1, 0, 2).copy() if first else np.zeros((parts, 1, length // parts), np.int64))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            matrix = np.asarray(x.flatten(), np.int32).reshape(batch.num_rows, length)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "e", "y")), binary(matrix)], ["k", "e", "y", "x"])

    state = ready.mapInArrow(packed, f"k long, e boolean, y {dict(ready.dtypes)['y']}, x binary")
    for n in range(rounds):
        newer = store.keep(assigned(state, books, False))
        if n:
            store.drop(state)
        state = newer
        books = moved_entries(state, books)
    coded = store.keep(assigned(state, books, True))
    labels = store.keep(coded.groupBy("y").agg(F.sum("error").alias("label_error")).withColumnRenamed("y", "of"))
    store.drop(state)
    joined = coded.join(labels, F.col("y").eqNullSafe(F.col("of")))
    return joined.select(F.when(~F.col("e"), F.col("k")).alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))

"""Mixing sources to target weights on a low-discrepancy schedule."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Store, cumulated, text_or_empty

#: Words in a block of the schedule; weights of the sources in order, repeating; most passes over a source.
BLOCK = 1
WEIGHTS = (5, 2, 1)
MOST = 3
#: Slots in a cell, and turns of a source that are looked up together.
SLOTS_A_CELL, TURNS = 100_000, 1 << 16
LIMB = 1 << 20
#: Places on the ring of points, and shares of a word in which targets are laid out along it.
RING, SHARES = 1 << 40, 1024


def n_words(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST, store: Store | None = None) -> DataFrame:
    """(src, source, source_size, target) of each source; src numbers them by code point, null last.

    Shares of the total by weight; a target above most times the source's size stops there and the excess goes to
    the others by weight, until none is above. Each round sends two sums to the driver.
    """
    store = store or Store(sizes.sparkSession, "targets")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    table = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    table = store.keep(cumulated(table, [F.col("source").asc_nulls_last()], F.lit(1), store).withColumnRenamed("before", "src").withColumn("weight", w))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = most * F.col("source_size") < F.lit(level) * F.col("weight")
        held, free, n = table.agg(
            F.sum(F.when(full, most * F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))
        ).first()
        if n == capped or not free:
            break
        capped, level = n, (total - (held or 0)) / free
    target = F.when(full, (most * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return table.select("src", "source", "source_size", target.alias("target"))


def golden_step(n: int) -> int:
    """The whole number near n / golden ratio that shares no factor with n, so its multiples modulo n meet every number once."""
    step = max(1, round(n * (math.sqrt(5) - 1) / 2))
    while math.gcd(step, n) != 1:
        step += 1
    return step


def golden_point(slot: Column, n: int, step: int) -> Column:
    """slot * step modulo n, in two limbs so that nothing overflows for n up to 2**41."""
    high, low = divmod(step % n, LIMB)
    return ((slot * F.lit(high) % n) * LIMB % n + slot * F.lit(low) % n) % n


def block_size(words: int) -> int:
    """Words in a block: the same for mixes of all sizes."""
    return BLOCK


def served_in(cell: int, total: int, step: int, ends: np.ndarray) -> np.ndarray:
    """Who is served in each slot of a cell: the number of the stretch, of those with these ends, that holds the slot's point."""
    slots = np.arange(cell * SLOTS_A_CELL, min(total, (cell + 1) * SLOTS_A_CELL), dtype=np.uint64)
    points = slots * np.uint64(step) & np.uint64(RING - 1)  # what overflows is a multiple of the ring
    return np.searchsorted(ends, points.astype(np.int64), side="right")


def turns(sources: DataFrame, total: int, step: int, store: Store) -> tuple[DataFrame, np.ndarray]:
    """(turns, ends): (cell, src, n, before) of each cell of slots, with how many of its slots serve the source and how
    many turns, of all sources in order, come before those; and the ends of the sources' stretches.

    Slot i takes point i of the golden-ratio sequence, and the source whose stretch of the cumulative targets holds the
    point is served. The sequence isn't closed to a ring of its own length, so a source is served as often as its share
    says but for the sequence's discrepancy, which is a few slots whatever their number. Slots are made cell by cell in
    the tasks and only counted, so no slot is shuffled or kept; each task has the ends, eight bytes a source.
    """
    if math.gcd(step, RING) != 1:
        raise ValueError(f"the step {step} shares a factor with the ring of {RING} places")
    whole = sources.agg(F.coalesce(F.sum("share"), F.lit(0))).first()[0]
    place = F.floor((F.col("first_share") + F.col("share")) / F.lit(float(whole or 1)) * float(RING)).cast("long")
    ends = np.array([r[0] for r in sources.select(place, "src").orderBy("src").collect()], np.int64)
    cells = -(-total // SLOTS_A_CELL) if whole else 0

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cell in frame["id"]:
                src, n = np.unique(served_in(int(cell), total, step, ends), return_counts=True)
                yield pd.DataFrame({"cell": cell, "src": src, "n": n})

    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = spark.range(0, cells, 1, parts).mapInPandas(counted, "cell long, src long, n long")
    return store.keep(cumulated(counts, ["src", "cell"], "n", store)), ends


def with_slots(asked: DataFrame, turned: DataFrame, ends: np.ndarray, total: int, step: int) -> DataFrame:
    """asked with ``slot``: the slot of its ``turn``, a number through the turns of all sources in order; null for null.

    A turn meets the cell that has it by ranges of TURNS turns; the cell's slots are made again, in the task that looks
    up all turns asked of it.
    """
    span = lambda x: F.floor(x / TURNS).cast("long")
    cells = turned.withColumn("span", F.explode(F.sequence(span(F.col("before")), span(F.col("before") + F.col("n") - 1))))
    numbers = asked.filter("turn is not null").select("turn").distinct().withColumn("span", span(F.col("turn")))
    met = numbers.join(cells.hint("merge"), "span").filter((F.col("turn") >= F.col("before")) & (F.col("turn") < F.col("before") + F.col("n")))

    def found(group: pd.DataFrame) -> pd.DataFrame:
        served = served_in(int(group["cell"].iloc[0]), total, step, ends)
        order = np.argsort(served, kind="stable")
        src = group["src"].to_numpy()
        at = np.searchsorted(served[order], src) + (group["turn"] - group["before"]).to_numpy()
        return pd.DataFrame({"turn": group["turn"], "slot": int(group["cell"].iloc[0]) * SLOTS_A_CELL + order[at]})

    slots = met.select("cell", "src", "turn", "before").groupBy("cell").applyInPandas(found, "turn long, slot long")
    return asked.join(slots.hint("merge"), "turn", "left").drop("turn")


def mix_pieces(
    docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 42, step: int | None = None, slots: int | None = None, doc: str = "doc_id", text: str = "text", source: str = "source", each: bool = False
) -> DataFrame:
    """What the mix takes: (doc_id, source, size, copy, copies, source_size, target, pass, words, slot), a row for each
    pass that takes words of a document, with the slot of the first; with ``each`` a row for each word. Documents that
    nothing is taken of have one row, with null. See mix_schedule."""
    store = Store(docs.sparkSession, "mix")
    sizes = store.keep(
        docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    sources = store.keep(source_targets(sizes, weights, most, store).withColumn("share", F.floor(F.col("target") * SHARES)))
    sources = cumulated(sources, ["src"], "source_size", store).withColumnRenamed("before", "first_word")
    sources = store.keep(cumulated(sources, ["src"], "share", store).withColumnRenamed("before", "first_share"))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    total = total if slots is None else min(total, slots)
    step = step or golden_step(RING)
    turned, ends = turns(sources, total, step, store)
    counts = sources.join(turned.groupBy("src").agg(F.sum("n").alias("quota")), "src", "left").fillna(0, ["quota"])
    stop = F.least(F.col("quota"), most * F.col("source_size"))
    sources = store.keep(cumulated(counts.withColumn("stop", stop), ["src"], "quota", store).withColumnRenamed("before", "first_turn"))
    named = sources.withColumnRenamed("source", "name")
    rows = sizes.join(named, sizes["source"].eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "copy"))
    rows = cumulated(rows, ["src", "h", "doc_id", "size", "copy"], "size", store)
    wanted = lambda p: (F.col("size") > 0) & (F.col("start") + p * F.col("source_size") < F.col("stop"))
    passes = rows.withColumn("start", F.col("before") - F.col("first_word")).withColumn("pass", F.explode_outer(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), wanted)))
    pieces = passes.withColumn("from", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("words", F.when(F.col("pass").isNotNull(), F.least("size", F.col("stop") - F.col("from"))))
    if each:
        pieces = pieces.withColumn("from", F.explode_outer(F.when(F.col("pass").isNotNull(), F.sequence("from", F.col("from") + F.col("words") - 1)))).withColumn("words", F.when(F.col("from").isNotNull(), F.lit(BLOCK).cast("long")))
    keep = ["doc_id", "source", "size", "copy", "copies", "source_size", "target", "pass", "words"]
    pieces = store.keep(pieces.select(*keep, (F.col("first_turn") + F.col("from")).alias("turn")))
    return store.release(with_slots(pieces, turned, ends, total, step)).select(*keep, "slot")


def mix_schedule(docs: DataFrame, **options) -> DataFrame:
    """Words of the mix: (doc_id, source, size, copy, copies, source_size, target, pass, slot, words), in slot order if sorted.

    A source's documents, shuffled by hash, form a stream of words that repeats at most ``most`` times; the source's
    turn r, a slot, hands out its word r, in mixes of any size. What the mix takes of a source is what its slots hand
    out, so it is its target but for a few words and for the end of the last pass. With ``slots`` only so many slots are
    served. ``words`` is null for documents that the mix takes nothing of. Null texts have size 0; null sources are a
    source of their own; repeated rows count as separate documents; an empty table gives no rows; other columns are not
    read. A row for each word is much for large tables: mix_counts and mixed_documents look up a document's first slots
    alone.
    """
    return mix_pieces(docs, each=True, **options).select("doc_id", "source", "size", "copy", "copies", "source_size", "target", "pass", "slot", "words")


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copy, first_slot, n_slots) of each document; see mix_schedule.

    ``taken`` sums the words that the schedule serves, one a slot; first_slot is null if there is none.
    """
    return (
        mix_pieces(docs, **options)
        .groupBy("doc_id", "source", "size", "copy", "source_size", "target")
        .agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken"), F.min("slot").alias("first_slot"))
        .withColumn("n_slots", F.col("taken"))
        .select("doc_id", "size", "source_size", "target", "taken", "source", "copy", "first_slot", "n_slots")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs in the order of the mix's slots, each row once for each pass that takes half its words or more; columns unchanged.

    Rows of one doc_id, source and size share their passes. The row travels as one column, so its columns may have any
    names.
    """
    taken = mix_pieces(docs, **options).filter("slot is not null").groupBy("doc_id", "source", "size", "copies", "pass").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    passes = taken.filter(2 * F.col("words") >= F.col("size") * F.col("copies")).select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("n"), "slot")
    rows = docs.select(F.struct("*").alias("row"), n_words(F.col("text")).alias("words"))
    on = F.col("row.doc_id").eqNullSafe(F.col("d")) & F.col("row.source").eqNullSafe(F.col("s")) & (F.col("words") == F.col("n"))
    return rows.join(passes, on).orderBy("slot").select("row.*")

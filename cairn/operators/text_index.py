"""A stored inverted index of English text: postings with positions in files by lexeme, kept up batch by batch."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import STOP_WORDS, stem
from . import versions
from .checkpoints import checkpoint_folder

POSTINGS = "lexeme string, id long, places array<struct<position: int, weight: string>>"
DOCUMENTS = "id long, lexemes array<string>"


@dataclass(frozen=True)
class Phrase:
    """Words that stand in a row, by their distances from the first; without ``wanted``, documents must not have it."""

    words: tuple[tuple[str, int], ...]
    wanted: bool = True


def parsed(query: str) -> list[list[Phrase]]:
    """Web-search syntax as alternatives of phrases that are all needed: "a phrase" in a row, -word not, or between.

    Stop words are left out, and leave their place in a phrase.
    """
    groups: list[list[Phrase]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\w+))', query.lower()):
        if word == "or" and not minus:
            groups.append([])
            continue
        words = [(w, i) for i, w in enumerate(re.findall(r"[a-z0-9]+", phrase or word)) if w not in STOP_WORDS]
        if words:
            groups[-1].append(Phrase(tuple((w, i - words[0][1]) for w, i in words), not minus))
    return [g for g in groups if g]


def postings_of(documents: DataFrame) -> DataFrame:
    """Postings of (id, document), the document as stemming.document() makes it."""
    rows = documents.select("id", F.explode("document").alias("x")).select("id", "x.*")
    return rows.groupBy("lexeme", "id").agg(F.array_sort(F.collect_list(F.struct("position", "weight"))).alias("places"))


def stems_of(spark: SparkSession, groups: list[list[Phrase]]) -> dict[str, str]:
    """The stems of a query's words, which are few; the literals that stand for them are then plain."""
    words = sorted({w for g in groups for p in g for w, _ in p.words})
    return {r.word: r.stem for r in spark.createDataFrame([(w,) for w in words], "word string").select("word", stem(F.col("word")).alias("stem")).collect()} if words else {}


def _minus(distance: int):
    return lambda p: p - distance


def _matching(groups: list[list[Phrase]], positions) -> Column:
    """Whether a document matches: positions of a phrase's words, by ``positions(word)``, intersect once they are shifted."""
    test = F.lit(not groups)
    for g in groups:
        whole = F.lit(True)
        for p in g:
            met = None
            for w, d in p.words:
                here = F.transform(positions(w), _minus(d))
                met = here if met is None else F.array_intersect(met, here)
            whole = whole & (F.size(met) > 0 if p.wanted else F.size(met) == 0)
        test = test | whole
    return test


class TextIndex:
    """Postings in buckets by lexeme, and each document's lexemes in buckets by id, under one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.postings, self.documents = f"{root}/postings", f"{root}/documents"

    def update(self, batch: DataFrame) -> None:
        """Adds (id, document) rows, one an id, or replaces what the index has of these ids; an empty document deletes one.

        Only buckets are rewritten that hold a lexeme of the new or of the replaced documents. Both tables get the next
        version; readers of postings see the batch once its manifest is there.
        """
        spark, number = self.spark, (versions.versions(self.spark, self.postings) or [0])[-1] + 1
        checkpoint_folder(spark)
        batch = batch.select("id", "document").checkpoint()  # read several times
        ids = batch.select("id")
        touched_ids = versions.touched_buckets(ids, ["id"], self.buckets)
        known = versions.read(spark, self.documents, DOCUMENTS, touched_ids)
        new = postings_of(batch)
        lexemes = known.join(ids, "id", "left_semi").select(F.explode("lexemes").alias("lexeme")).unionByName(new.select("lexeme"))
        touched = versions.touched_buckets(lexemes, ["lexeme"], self.buckets)
        kept = versions.read(spark, self.postings, POSTINGS, touched).join(ids, "id", "left_anti")
        present = batch.filter(F.size("document") > 0).select("id", F.array_distinct(F.transform("document", lambda x: x["lexeme"])).alias("lexemes"))
        rest = known.join(ids, "id", "left_anti")
        versions.write(rest.unionByName(present), self.documents, number, touched_ids, versions.bucket_of(["id"], self.buckets))
        versions.write(kept.unionByName(new), self.postings, number, touched, versions.bucket_of(["lexeme"], self.buckets))

    def looked_up(self, lexemes: list[str]) -> DataFrame:
        """Postings of some lexemes, from the files of their buckets alone."""
        if not lexemes:
            return self.spark.createDataFrame([], POSTINGS)
        asked = self.spark.createDataFrame([(w,) for w in lexemes], "lexeme string")
        found = versions.read(self.spark, self.postings, POSTINGS, versions.touched_buckets(asked, ["lexeme"], self.buckets))
        return found.filter(F.col("lexeme").isin(lexemes))

    def ids(self) -> DataFrame:
        return versions.read(self.spark, self.documents, DOCUMENTS).select("id")

    def matching(self, query: str) -> DataFrame:
        """Ids of documents that match web-search syntax. A query without words matches all; a hit is one row."""
        groups = parsed(query)
        if not groups:
            return self.ids()
        stems = stems_of(self.spark, groups)
        places = F.map_from_entries(F.collect_list(F.struct("lexeme", F.transform("places", lambda x: x["position"]))))
        found = self.looked_up(sorted(set(stems.values()))).groupBy("id").agg(places.alias("places"))
        if not all(any(p.wanted for p in g) for g in groups):
            found = self.ids().join(found, "id", "left")  # an alternative of exclusions alone matches what has none of them

        def positions(word: str) -> Column:
            return F.coalesce(F.try_element_at("places", F.lit(stems[word])), F.array().cast("array<int>"))

        return found.filter(_matching(groups, positions)).select("id")


def matches(document: Column, query: str) -> Column:
    """The same test on a document column, where there is no index."""
    groups = parsed(query)
    stems = stems_of(SparkSession.active(), groups)

    def positions(word: str) -> Column:
        return F.transform(F.filter(document, lambda x: x["lexeme"] == stems[word]), lambda x: x["position"])

    return _matching(groups, positions)

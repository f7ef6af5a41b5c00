"""Porter2 stems, weighted documents, web searches, and the stored index under updates."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from cairn.functions import stemming
from cairn.operators import discovery, text_index, versions

#: Words and stems of the algorithm's published sample, and of its rules.
STEMS = """
consign consign consigned consign consignment consign consistency consist consistently consist consolation consol consolatory consolatori consoling consol consolingly consol consonant conson conspiracy conspiraci
conspirator conspir conspiring conspir constables constabl constancy constanc knackeries knackeri knaves knave knavish knavish kneeled kneel knightly knight knitted knit knives knive knockers knocker knopp knopp
hoping hope hopping hop ties tie cries cri gas gas this this kiwis kiwi luxuriated luxuri generously generous communities communiti arsenal arsenal enjoy enjoy sayyid sayyid skies sky dying die succeeded succeed relational relat
conditional condit analogy analog rational ration happily happili feed feed agreed agre replacement replac adoption adopt controlled control probate probat rate rate cease ceas hopefulness hope formalize formal yes yes toying toy
by by ab3s ab3s 1939 1939 inning inning innings inning using use news news yy yy y y only onli gently gentl
""".split()


def test_stems(spark):
    rows = spark.createDataFrame(list(zip(STEMS[::2], STEMS[1::2], strict=True)), "word string, stem string")
    assert [(r.word, r.got) for r in rows.withColumn("got", stemming.stem(F.col("word"))).collect() if r.got != r.stem] == []


def test_documents_count_positions_of_stop_words(spark):
    parts = [("A", F.lit("The Tower of London and the")), ("B", F.lit("in Towns 1066")), ("C", F.lit(None).cast("string"))]
    (row,) = spark.range(1).select(stemming.document([(w, discovery.text_tokens(x)) for w, x in parts]).alias("d")).collect()
    assert [tuple(x) for x in row.d] == [("tower", "A", 2), ("london", "A", 4), ("town", "B", 6), ("1066", "B", 7)]


TEXTS = {
    1: "The Church of All Saints, and its churchyard", 2: "churches of saints", 3: "Castles and a castle's halls", 4: "South-west farms", 5: "west of the South farm", 6: "", 7: None, 8: "saint of the church of all", 9: "hall " * 50 + "farm",
}
FOUND = {
    "church": {1, 2, 8}, '"church of all saints"': {1}, "saints church": {1, 2, 8}, "churches -churchyard": {2, 8}, '"south west" or castle': {3, 4}, '"west of the south"': {5}, "-hall": {1, 2, 4, 5, 8}, "the of": {1, 2, 3, 4, 5, 8, 9},
    "missing": set(), "hall or -south": {1, 2, 3, 8, 9}, '-"south west" farm': {5, 9}, "Farms": {4, 5, 9},
}


def documents(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    return rows.select("id", stemming.document([("A", discovery.text_tokens(F.col("text")))]).alias("document"))


@pytest.fixture(scope="module")
def index(spark):
    made = text_index.TextIndex(spark, tempfile.mkdtemp(prefix="spark-index-"), 8)
    made.update(documents(spark, TEXTS))
    return made


@pytest.mark.parametrize("query", FOUND)
def test_searches(spark, index, query):
    assert {r.id for r in index.matching(query).collect()} == FOUND[query]
    there = documents(spark, TEXTS).filter(F.size("document") > 0).filter(text_index.matches(F.col("document"), query))
    assert {r.id for r in there.collect()} == FOUND[query]


def test_a_search_reads_only_its_words_buckets(index):
    files = index.looked_up(["church", "farm"]).inputFiles()
    assert files and {f.split("bucket=")[1].split("/")[0] for f in files} <= {str(b) for b in versions.touched_buckets(index.spark.createDataFrame([("church",), ("farm",)], "w string"), ["w"], 8)}


def everything(index):
    rows = versions.read(index.spark, index.postings, text_index.POSTINGS).collect()
    return sorted((r.lexeme, r.id, [tuple(p) for p in r.places]) for r in rows)


def test_updates_equal_a_rebuild(spark):
    """Batches that replace, delete, add and come twice leave what one build of the last texts has; only touched buckets are written."""
    kept = text_index.TextIndex(spark, tempfile.mkdtemp(prefix="spark-index-"), 8)
    for batch in ({k: TEXTS[k] for k in (1, 2, 3)}, {k: TEXTS[k] for k in (4, 5, 6, 7, 9)}, {2: "a ruin", 3: None, 8: TEXTS[8]}, {2: "a ruin", 3: None, 8: TEXTS[8]}):
        kept.update(documents(spark, batch))
    whole = text_index.TextIndex(spark, tempfile.mkdtemp(prefix="spark-index-"), 8)
    whole.update(documents(spark, TEXTS | {2: "a ruin", 3: None}))
    assert everything(kept) == everything(whole)
    assert {r.id for r in kept.matching("church").collect()} == {1, 8} and {r.id for r in kept.matching("ruins").collect()} == {2}
    before = versions.manifest(spark, kept.postings)
    kept.update(documents(spark, {2: "an old ruin"}))
    after = versions.manifest(spark, kept.postings)
    touched = set(versions.touched_buckets(spark.createDataFrame([("ruin",), ("old",)], "w string"), ["w"], 8))
    assert {b for b in after if after[b] != before.get(b)} == touched
    assert versions.expire(spark, kept.postings) > 0 and versions.versions(spark, kept.postings) == [5]
    assert {r.id for r in kept.matching("ruins").collect()} == {2}


def test_versions_are_whole(spark):
    """A version without its manifest isn't seen; a number written again replaces what a failed run left."""
    root = tempfile.mkdtemp(prefix="spark-versions-")
    rows = lambda *x: spark.createDataFrame([(i, v) for i, v in x], "id long, v string")
    bucket = versions.bucket_of(["id"], 4)
    put = lambda df, n: versions.write(df, root, n, versions.touched_buckets(df, ["id"], 4), bucket)
    put(rows(*[(i, "a") for i in range(20)]), 1)
    rows((99, "lost")).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{root}/v2")  # died before its manifest
    assert versions.versions(spark, root) == [1] and versions.read(spark, root, "id long, v string").filter("v <> 'a'").count() == 0
    one = versions.touched_buckets(rows((3, "")), ["id"], 4)
    versions.write(versions.read(spark, root, "id long, v string", one).filter("id <> 3"), root, 2, one, bucket)
    assert {r.id for r in versions.read(spark, root, "id long, v string").collect()} == set(range(20)) - {3}
    assert versions.read(spark, root, "id long, v string", upto=1).count() == 20
    versions.write(spark.createDataFrame([], "id long, v string"), root, 3, one, bucket)
    left = {r.id for r in versions.read(spark, root, "id long, v string").collect()}
    assert left and left < set(range(20)) - {3} and set(versions.manifest(spark, root)) == {0, 1, 2, 3} - set(one)

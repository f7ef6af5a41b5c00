"""English full text: stems, weighted documents and the stored index, with Porter2 written out in SQL beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import stemming
from ..operators import discovery as op
from ..operators import text_index
from ..operators.checkpoints import shared_folder
from ..operators.spread import spread
from .catalog import query
from .substrate import twin, view

c = F.col
TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda t: t <> '')"
STOPPED = "(" + ", ".join(f"'{w}'" for w in stemming.STOP_WORDS) + ")"


def _when(word: str, endings: dict[str, str], start: str, special: dict[str, str]) -> str:
    """CASE text: the longest ending first; where its condition fails the word stays."""
    cases = []
    for e in sorted(endings, key=len, reverse=True):
        rest = f"left({word}, length({word}) - {len(e)})"
        test = f"length({word}) - {len(e)} >= {start}" + (f" AND {special[e].format(rest)}" if e in special else "")
        cases.append(f"WHEN ends_with({word}, '{e}') THEN CASE WHEN {test} THEN {rest} || '{endings[e]}' ELSE {word} END")
    return "CASE " + " ".join(cases) + f" ELSE {word} END"


def stems_sql(words: str) -> str:
    """CTEs up to ``stems`` (word, stem) of the distinct words of a query with a column ``word``."""
    v, n = "[aeiouy]", "[^aeiouy]"
    short = f"regexp_matches({{0}}, '(^{v}{n}$)|({n}{v}[^aeiouywxY]$)')"
    odd = "CASE word " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in stemming.IRREGULAR.items()) + " END"
    same = ", ".join(f"'{w}'" for w in stemming.INVARIANT)
    singular = ", ".join(f"'{w}'" for w in stemming.INVARIANT_SINGULAR)
    li = {"ogi": "ends_with({0}, 'l')", "li": "regexp_matches({0}, '[cdeghkmnrt]$')"}
    return f"""s0 AS (SELECT DISTINCT word FROM ({words})),
s1 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '({v})y', '\\1Y', 'g') AS w FROM s0 WHERE length(word) > 2 AND NOT regexp_matches(word, '[^a-z]') AND word NOT IN ({same}) AND {odd} IS NULL),
s2 AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|arsen)') THEN 5 WHEN starts_with(w, 'commun') THEN 6 WHEN regexp_matches(w, '{v}{n}') THEN length(regexp_extract(w, '^{n}*{v}+{n}')) ELSE length(w) END AS r1 FROM s1),
s3 AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{v}{n}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^{n}*{v}+{n}')) ELSE length(w) END AS r2 FROM s2),
s4 AS (SELECT word, r1, r2, CASE WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2) WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
    WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w WHEN regexp_matches(w, '{v}.+s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM s3),
s5 AS (SELECT *, CASE WHEN ends_with(w, 'eedly') THEN 5 WHEN ends_with(w, 'ingly') THEN 5 WHEN ends_with(w, 'edly') THEN 4 WHEN ends_with(w, 'eed') OR ends_with(w, 'ing') THEN 3 WHEN ends_with(w, 'ed') THEN 2 ELSE 0 END AS k FROM s4 WHERE w NOT IN ({singular})),
s6 AS (SELECT *, left(w, length(w) - k) AS b FROM s5),
s7 AS (SELECT word, r1, r2, CASE WHEN k = 0 THEN w WHEN ends_with(w, 'eed') OR ends_with(w, 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END WHEN NOT regexp_matches(b, '{v}') THEN w WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
    WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(b, length(b) - 1) WHEN r1 >= length(b) AND {short.format('b')} THEN b || 'e' ELSE b END AS w FROM s6),
s8 AS (SELECT word, r1, r2, CASE WHEN regexp_matches(w, '^.+{n}[yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM s7),
s9 AS (SELECT word, r1, r2, {_when('w', stemming.STEP_2, 'r1', li)} AS w FROM s8),
s10 AS (SELECT word, r1, r2, {_when('w', stemming.STEP_3, 'r1', {'ative': 'length({0}) >= r2'})} AS w FROM s9),
s11 AS (SELECT word, r1, r2, {_when('w', dict.fromkeys(stemming.STEP_4, ''), 'r2', {'ion': "regexp_matches({0}, '[st]$')"})} AS w FROM s10),
s12 AS (SELECT word, CASE WHEN ends_with(w, 'e') AND (length(w) > r2 OR (length(w) > r1 AND NOT {short.format('left(w, length(w) - 1)')})) OR ends_with(w, 'll') AND length(w) > r2 THEN left(w, length(w) - 1) ELSE w END AS w FROM s11),
stems AS (SELECT s0.word, coalesce(lower(s12.w), (SELECT any_value(w) FROM s4 WHERE s4.word = s0.word AND w IN ({singular})), {odd.replace('CASE word', 'CASE s0.word')}, s0.word) AS stem FROM s0 LEFT JOIN s12 ON s12.word = s0.word)"""


TEXT_WORDS = f"SELECT unnest({TOKENS.format('text')}) AS word FROM documents WHERE lang = 'en' UNION SELECT unnest({TOKENS.format('name')}) AS word FROM v_names"


@query("fts_stem", twin(f"WITH {stems_sql(TEXT_WORDS)} SELECT word, stem FROM stems"))
def fts_stem(spark, d):
    """The stem of every word that names and English texts have; each word is stemmed once, not each of its places."""
    of = lambda df, column: df.select(F.explode(op.text_tokens(c(column))).alias("word"))
    words = of(view(spark, d, "documents").filter("lang = 'en'"), "text").unionByName(of(view(spark, d, "v_names"), "name")).distinct()
    return words.select("word", stemming.stem(c("word")).alias("stem"))


#: The parts of a place's document, as (weight, SQL text).
PARTS = (("A", "title"), ("B", "concat_ws(' ', town, county)"), ("C", "survival_status"))
_PLACE_WORDS = " UNION ALL ".join(f"SELECT id, '{w}' AS w, {i} AS part, unnest({TOKENS.format(x)}) AS word, generate_subscripts({TOKENS.format(x)}, 1) AS i FROM v_places" for i, (w, x) in enumerate(PARTS))
#: (id, lexeme, weight, position) of every place's document: a part's positions go on from the last lexeme before it.
PLACE_LEXEMES = f"""t AS MATERIALIZED ({_PLACE_WORDS}), {stems_sql('SELECT word FROM t')}, k AS (SELECT id, w, part, stem, i FROM t JOIN stems USING (word) WHERE word NOT IN {STOPPED}),
e AS (SELECT id, part, max(i) AS n FROM k GROUP BY ALL), o AS (SELECT id, part, coalesce(sum(n) OVER (PARTITION BY id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
x AS MATERIALIZED (SELECT k.id, stem AS lexeme, w AS weight, CAST(i + before AS INTEGER) AS position, part FROM k JOIN o USING (id, part))"""


def place_documents(spark, d):
    places = spread(view(spark, d, "v_places"), "id")
    parts = (("A", c("title")), ("B", F.concat_ws(" ", "town", "county")), ("C", c("survival_status")))
    return places.select("id", stemming.document([(w, op.text_tokens(x)) for w, x in parts]).alias("document"))


@query("fts_document", twin(f"""WITH {PLACE_LEXEMES} SELECT p.id, coalesce(string_agg('''' || lexeme || ''':' || position || weight, ' ' ORDER BY position), '') AS document FROM v_places p LEFT JOIN x ON x.id = p.id GROUP BY 1"""))
def fts_document(spark, d):
    """Weighted English document of each place: stems without stop words, as 'lexeme':position and weight."""
    entry = lambda x: F.concat(F.lit("'"), x["lexeme"], F.lit("':"), x["position"].cast("string"), x["weight"])
    return place_documents(spark, d).select("id", F.array_join(F.transform("document", entry), " ").alias("document"))


def _index(spark, d, batches: int = 1) -> text_index.TextIndex:
    """An index of the places' documents in a folder of this run."""
    index = text_index.TextIndex(spark, f"{shared_folder(spark)}/cairn/index-{uuid.uuid4().hex}", 16)
    documents = place_documents(spark, d)
    for i in range(batches):
        index.update(documents.filter(c("id") % batches == i) if batches > 1 else documents)
    return index


#: Words are stemmed on both sides; a phrase keeps the place of its stop words; exclusions; alternatives.
SEARCHES = {"halls": "halls", "phrase": '"church of all saints"', "without": "churches -mary", "either": 'castles or "south west farms"', "none of": "-towns"}
_HAS = "EXISTS (SELECT 1 FROM x WHERE x.id = p.id AND lexeme = '{0}')"
_ROW = "EXISTS (SELECT 1 FROM x a{1} WHERE a.id = p.id AND a.lexeme = '{0}'{2})"


def _in_a_row(*words: tuple[str, int]) -> str:
    joins = "".join(f" JOIN x x{d} ON x{d}.id = a.id AND x{d}.lexeme = '{w}' AND x{d}.position = a.position + {d}" for w, d in words[1:])
    return _ROW.format(words[0][0], joins, "")


_TESTS = {
    "halls": _HAS.format("hall"),
    "phrase": _in_a_row(("church", 0), ("saint", 3)),
    "without": f"{_HAS.format('church')} AND NOT {_HAS.format('mari')}",
    "either": f"{_HAS.format('castl')} OR {_in_a_row(('south', 0), ('west', 1), ('farm', 2))}",
    "none of": f"NOT {_HAS.format('town')}",
}


@query("fts_index_search", twin(f"WITH {PLACE_LEXEMES} " + " UNION ALL ".join(f"SELECT '{k}' AS search, id FROM v_places p WHERE {t}" for k, t in _TESTS.items())))
def fts_index_search(spark, d):
    """Web searches answered from the stored index, each from the files of its own words."""
    index = _index(spark, d)
    out = None
    for name, words in SEARCHES.items():
        found = index.matching(words).select(F.lit(name).alias("search"), "id")
        out = found if out is None else out.unionByName(found)
    return out


@query("fts_index_update", twin(f"WITH {PLACE_LEXEMES} SELECT lexeme, count(DISTINCT id) AS documents, count(*) AS places, CAST(sum(position) AS BIGINT) AS positions FROM x GROUP BY 1"))
def fts_index_update(spark, d):
    """The index built in three batches, the second of which comes again: every lexeme's documents and places as if built at once."""
    index = _index(spark, d, 3)
    index.update(place_documents(spark, d).filter(c("id") % 3 == 1))
    rows = text_index.versions.read(spark, index.postings, text_index.POSTINGS)
    summed = F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + x["position"])
    return rows.groupBy("lexeme").agg(F.countDistinct("id").alias("documents"), F.sum(F.size("places")).alias("places"), F.sum(summed).alias("positions"))

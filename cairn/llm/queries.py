"""The queries of this subpackage: one opN_<name> for each operation, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, divergence, html_extraction, language_model, mixing, near_duplicates, neighbours, quality, repeated_bytes, secrets, sharding, toxicity, vector_codes
from .common import read_table


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.katz_scores(read_table(spark, sf_dir, "documents"))


def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_slots(read_table(spark, sf_dir, "documents"))


def op3_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read_table(spark, sf_dir, "documents"))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the widest policy does to the corpus, from the ledger of op4."""
    return quality.ablations(quality.rule_ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "v3")


def op5_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.duplicate_classes(read_table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(read_table(spark, sf_dir, "pages"))


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.without_repeats(read_table(spark, sf_dir, "documents"))


def op9_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(read_table(spark, sf_dir, "documents"))


def op10_mix_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(read_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read_table(spark, sf_dir, "documents"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(read_table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_katz_scores,
        op2_jump_shards,
        op3_toxic_spans,
        op4_rule_ledger,
        rule_ablations,
        op5_benchmark_passages,
        op6_near_duplicates,
        op7_main_text,
        op8_repeated_bytes,
        op9_secret_spans,
        op10_mix_schedule,
        op11_source_divergence,
        op12_nearest_neighbours,
        op13_vector_codes,
    )
}
_SPACE = r"[\x20\x09-\x0D]"
_LEDGER = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
k AS (SELECT r, i, array_to_string(w[i:i + 7], chr(1)) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM k) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, (length(t) - length(replace(t, '!!', ''))) // 2 AS n_exclaims,
    len(list_filter(l, lambda x: regexp_matches(x, '{quality.BULLET}'))) AS n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '{quality.ELLIPSIS}'))) AS n_ellipses, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_lettered FROM w LEFT JOIN rep ON rep.r = w.r),
b AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_exclaims > 3 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 32 ELSE 0 END + CASE WHEN 10 * n_bullets > 9 * n_lines THEN 64 ELSE 0 END
    + CASE WHEN 10 * n_ellipses > 3 * n_lines THEN 128 ELSE 0 END + CASE WHEN 10 * n_lettered < 7 * n_words THEN 256 ELSE 0 END AS bits FROM m)"""
_RULES = ", ".join(f"('{rule}', {1 << bit})" for rule, (bit, _) in quality.RULES.items())
_DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.LEAST_DOCS}),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(c) AS n FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT w.lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, coalesce(v, 0) AS v, coalesce(m, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS m FROM c GROUP BY ALL) USING (lang, source)),
p AS MATERIALIZED (SELECT g.lang, g.source, term, coalesce(c.c, 0) AS c, 1 + {divergence.ONE} * (coalesce(c.c, 0) + 1) // (g.n + g.v) AS p, 1 + {divergence.ONE} * (k.c + 1) // (l.n + g.v) AS q
    FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= {divergence.TOP}"""


def _codes(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """Plain Lloyd: each row's part against every entry of its position, with the entry's squared distance and then its index as order."""
    sql = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
d AS (SELECT max(len(x)) // {parts} AS width FROM v),
x AS MATERIALIZED (SELECT r, vec_id, label, p, list_transform(x[p * width + 1:(p + 1) * width], lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM v, d, (SELECT unnest(range(0, {parts})) AS p)),
i AS (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j FROM x),
c0 AS MATERIALIZED (SELECT p, j, x AS c FROM i WHERE j < {entries})"""
    for n in range(rounds + 1):
        sql += f""",
a{n} AS MATERIALIZED (SELECT r, p, vec_id, label, any_value(x) AS x, arg_min(j, (e, j)) AS j, min(e) AS e FROM
    (SELECT x.*, j, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS e FROM x JOIN c{n} USING (p)) GROUP BY r, p, vec_id, label)"""
        if n < rounds:
            sql += f""",
m{n} AS (SELECT p, j, list(CAST(m AS BIGINT) ORDER BY k) AS m FROM (SELECT p, j, k, floor(sum(s) / count(*)) AS m FROM (SELECT p, j, unnest(x) AS s, generate_subscripts(x, 1) AS k FROM a{n}) GROUP BY ALL) GROUP BY p, j),
c{n + 1} AS MATERIALIZED (SELECT p, j, coalesce(m, c) AS c FROM c{n} LEFT JOIN m{n} USING (p, j))"""
    return f"""{sql},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS h FROM c{rounds}),
e AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(j AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(e) AS BIGINT) AS error FROM a{rounds} GROUP BY r, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM e, h"""


ORACLES = {
    "op11_source_divergence": _DIVERGENCE,
    "op13_vector_codes": _codes(),
    "op4_rule_ledger": f"{_LEDGER} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits % 4 <> 0 AS base_failed, bits % 64 = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits, 'v2' AS policy FROM b",
    "rule_ablations": f"""{_LEDGER} SELECT rule, count(*) FILTER (WHERE bits & bit <> 0) AS failed, count(*) FILTER (WHERE bits = bit) AS only_this, count(*) FILTER (WHERE bits = 0 OR bits = bit) AS kept_without
FROM b, (SELECT * FROM (VALUES {_RULES}) AS t(rule, bit)) GROUP BY 1""",
}

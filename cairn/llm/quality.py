"""Quality rules as a ledger of failure bits, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, text_or_empty, words_of

WINDOW = 8

#: Rule name -> (bit, failure test on the measured columns). A bit never changes its meaning; new rules take new bits.
RULES = {
    "few_words": (0, lambda: F.col("n_words") < 20),
    "repeated_windows": (1, lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    "symbols": (2, lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    "repeated_lines": (3, lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    "shouting": (4, lambda: 10 * F.col("n_exclaims") > 3 * F.col("n_words")),
    "word_length": (5, lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
    "bullets": (6, lambda: 10 * F.col("n_bullet_lines") > 9 * F.col("n_lines")),
    "ellipses": (7, lambda: 10 * F.col("n_ellipsis_lines") > 3 * F.col("n_lines")),
    "letterless": (8, lambda: 10 * F.col("n_letter_words") < 7 * F.col("n_words")),
}
BASE_RULES = ("few_words", "repeated_windows")
#: Versions of the policy: the rules whose failure drops a document.
POLICIES = {"v1": BASE_RULES, "v2": tuple(RULES)[:6], "v3": tuple(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_bullet_lines", "n_ellipsis_lines", "n_letter_words")
#: A line that starts with a bullet, one that ends in an ellipsis, and a word with a letter in it.
BULLET, ELLIPSIS, LETTERED = rf"^[{SPACE}]*[-*•‣▪◦]", rf"(?:\.\.\.|…)[{SPACE}]*\z", rf"[^{SPACE}]*?\p{{L}}[^{SPACE}]*"


def mask_of(rules) -> int:
    return sum(1 << RULES[r][0] for r in rules)


def _covered(starts: Column) -> Column:
    """Words covered by windows at these ascending starts."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that the text holds twice or more, the first one included.

    Words are hashed once and windows by the hashes of their words, to 64 bits. Only texts that have a repeat sort
    their windows.
    """
    n = F.size(words) - WINDOW + 1
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    hashes = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))

    def repeats(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = lambda i, j: F.get(p, i)["h"] == F.get(p, j)["h"]
            hit = F.filter(p, lambda x, i: F.coalesce(same(i, i + 1), F.lit(False)) | F.coalesce(same(i, i - 1), F.lit(False)))
            return F.array_sort(F.transform(hit, lambda x: x["i"]))

        return F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(let(pairs, starts))).otherwise(0)

    return F.when(n > 1, let(hashes, repeats)).otherwise(0)


def rule_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures of MEASURES (long) and fail_bits (long), each rule evaluated once; no shuffle.

    Measured over the whole text; null counts as empty. Columns of docs with these names are replaced, others kept,
    whatever their names.
    """
    body = text_or_empty(F.col(text))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
    number = lambda x, name: x.cast("long").alias(name)

    def measured(w: Column) -> Column:
        return F.struct(number(F.size(w), "n_words"), number(F.length(F.array_join(w, "")), "word_chars"), number(_repeat_words(w), "n_repeat_words"))

    def counted(x: Column) -> Column:
        like = lambda pattern, name: number(F.size(F.filter(x, lambda y: y.rlike(pattern))), name)
        return F.struct(number(F.size(x), "n_lines"), number(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines"), like(BULLET, "n_bullet_lines"), like(ELLIPSIS, "n_ellipsis_lines"))

    counts = F.struct(
        number(F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")), "n_symbols"), number(F.regexp_count(body, F.lit("!!")), "n_exclaims"), number(F.regexp_count(body, F.lit(LETTERED)), "n_letter_words")
    )
    told = docs.select(F.struct("*").alias("row"), let(words_of(F.col(text)), measured).alias("w"), let(lines, counted).alias("l"), counts.alias("n"))
    of = {"n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l", "n_bullet_lines": "l", "n_ellipsis_lines": "l"}
    rest = [F.col(f"row.`{c}`") for c in docs.columns if c not in MEASURES and c != "fail_bits"]
    out = told.select(*rest, *[F.col(f"{of.get(m, 'n')}.{m}") for m in MEASURES])
    bits = [F.when(test(), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, test in RULES.values()]
    return out.withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def apply_policy(ledger: DataFrame, version: str = "v2", kept: str = "kept") -> DataFrame:
    """The ledger with a verdict under a version of the policy; the texts aren't read again."""
    return ledger.withColumn(kept, F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[version]))) == 0)


def ablations(ledger: DataFrame, version: str = "v2") -> DataFrame:
    """(rule, failed, only_this, kept_without) for each rule of a policy.

    One shuffle of at most 2**rules counts; each rule's figures are sums over the distinct bit patterns.
    """
    rules = POLICIES[version]
    mask = mask_of(rules)
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in rules]))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return (
        patterns.withColumn("r", each)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(total(hit).alias("failed"), total(alone).alias("only_this"), total((F.col("bits") == 0) | alone).alias("kept_without"))
    )


def quality_verdicts(docs: DataFrame, version: str = "v2") -> DataFrame:
    """(doc_id, the measures, base_failed, kept, fail_bits, policy) of each row of docs."""
    ledger = apply_policy(rule_ledger(docs.select("doc_id", "text")), version)
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask_of(BASE_RULES))) != 0
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"), "fail_bits", F.lit(version).alias("policy")
    )

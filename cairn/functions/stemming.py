"""English lexemes: Porter2 stems and stop words, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: English words that no document is found by.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split()
#: Words with stems of their own, and words that stay as they are, before and after a plural's end is gone.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
INVARIANT_SINGULAR = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Endings and what becomes of them, where they stand after the first region's start.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
#: Endings that go after the second region's start.
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
#: y is a vowel, Y a consonant. A region starts after the first consonant that follows a vowel.
REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
FIRST_REGION = f"^(?:gener|commun|arsen)|{REGION}"
SHORT = "^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$"


def _ending(word: Column, endings) -> Column:
    """The longest of the endings that the word has: the one that starts first."""
    return F.regexp_extract(word, f"(?:{'|'.join(sorted(endings, key=len, reverse=True))})$", 0)


def _without(word: Column, ending: Column | int) -> Column:
    return F.left(word, F.length(word) - ending)


def _plural(word: Column) -> Column:
    def of(end: Column) -> Column:
        cut = F.when(end == "sses", 2).when(end.isin("ied", "ies"), F.when(F.length(word) > 4, 2).otherwise(1)).when((end == "s") & word.rlike("[aeiouy].+s$"), 1).otherwise(0)
        return _without(word, cut)

    return let(_ending(word, ("sses", "ied", "ies", "us", "ss", "s")), of)


def _past(word: Column, first: Column) -> Column:
    def rest(base: Column) -> Column:
        mended = F.when(base.rlike("(?:at|bl|iz)$"), F.concat(base, F.lit("e"))).when(base.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _without(base, 1))
        return mended.when((first >= F.length(base)) & base.rlike(SHORT), F.concat(base, F.lit("e"))).otherwise(base)

    def of(end: Column) -> Column:
        base = _without(word, F.length(end))
        kept = F.when(end == "", word).when(end.isin("eed", "eedly"), F.when(F.length(base) >= first, F.concat(base, F.lit("ee"))).otherwise(word))
        return kept.when(base.rlike("[aeiouy]"), let(base, rest)).otherwise(word)

    return let(_ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly")), of)


def _replaced(word: Column, endings: dict[str, str], allowed) -> Column:
    """The word with its ending replaced, if ``allowed(ending, what is before it)`` holds."""
    table = F.create_map(*[F.lit(x) for pair in endings.items() for x in pair])

    def of(w: Column, end: Column) -> Column:
        base = _without(w, F.length(end))
        return F.when((end != "") & allowed(end, base), F.concat(base, F.element_at(table, end))).otherwise(w)

    return let(word, lambda w: let(_ending(w, endings), lambda end: of(w, end)))


def _last(word: Column, first: Column, second: Column) -> Column:
    base = _without(word, 1)
    n = F.length(base)
    goes = F.when(word.endswith("e"), (n >= second) | ((n >= first) & ~base.rlike(SHORT))).otherwise(word.endswith("ll") & (n >= second))
    return F.when(goes, base).otherwise(word)


def stem(word: Column) -> Column:
    """Porter2 stem of a word in small letters; words of one or two letters, or with a figure, stay."""

    def regular(w: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y")
        return let(marked, lambda m: let(F.coalesce(F.nullif(F.length(F.regexp_extract(m, FIRST_REGION, 0)), F.lit(0)), F.length(m)), lambda first: with_regions(m, first)))

    def with_regions(m: Column, first: Column) -> Column:
        found = F.length(F.regexp_extract(F.substr(m, first + 1), REGION, 0))
        second = F.when(found > 0, first + found).otherwise(F.length(m))
        return let(second, lambda s: let(_plural(m), lambda x: F.when(x.isin(*INVARIANT_SINGULAR), x).otherwise(derived(x, first, s))))

    def derived(x: Column, first: Column, second: Column) -> Column:
        in_first = lambda end, base: F.length(base) >= first
        in_second = lambda end, base: F.length(base) >= second
        step_2 = lambda e, b: in_first(e, b) & F.when(e == "ogi", b.endswith("l")).when(e == "li", b.rlike("[cdeghkmnrt]$")).otherwise(True)
        step_3 = lambda e, b: in_first(e, b) & ((e != "ative") | in_second(e, b))
        step_4 = lambda e, b: in_second(e, b) & ((e != "ion") | b.rlike("[st]$"))
        after = let(_past(x, first), lambda w: F.regexp_replace(w, "^(.+[^aeiouy])[yY]$", "$1i"))
        for endings, allowed in ((STEP_2, step_2), (STEP_3, step_3), (dict.fromkeys(STEP_4, ""), step_4)):
            after = _replaced(after, endings, allowed)
        return F.lower(let(after, lambda w: _last(w, first, second)))

    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])

    def of(w: Column) -> Column:
        stays = (F.length(w) <= 2) | w.rlike("[^a-z]") | w.isin(*INVARIANT)
        return F.when(stays, w).when(w.isin(*IRREGULAR), F.element_at(irregular, w)).otherwise(regular(w))

    return let(word, of)


def lexemes(tokens: Column, weight: str | None = None, offset: Column | int = 0) -> Column:
    """Array of (lexeme, weight, position) of tokens that aren't stop words; positions count all tokens from 1."""
    kept = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("token"), (i + 1 + offset).cast("int").alias("position"))), lambda x: ~x["token"].isin(*STOP_WORDS))
    return F.transform(kept, lambda x: F.struct(stem(x["token"]).alias("lexeme"), F.lit(weight).cast("string").alias("weight"), x["position"].alias("position")))


def _after(tokens: Column, weight: str):
    def body(before: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(before, lambda x: x["position"])), F.lit(0))
        return F.concat(before, lexemes(tokens, weight, last))

    return body


def document(parts: list[tuple[str, Column]]) -> Column:
    """Weighted document of (weight, tokens) parts: the lexemes of one after the other, positions counted on from the last lexeme."""
    whole = None
    for weight, tokens in parts:
        if whole is None:
            whole = lexemes(tokens, weight)
        else:
            whole = let(whole, _after(tokens, weight))
    return whole

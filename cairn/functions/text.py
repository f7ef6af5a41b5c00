"""Column functions on names, labels, codes and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they are without the accent.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: Words without identifying force.
STOPWORDS = ("the", "of", "and", "a", "an", "at", "in", "on", "to", "near", "by", "with")
#: Words that stay small inside a title.
SMALL_WORDS = ("of", "the", "and", "to", "at", "in", "on", "for", "a", "an")
ROMAN = "^(i{1,3}|iv|v|vi{1,3}|ix|x)$"


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise_name(name: Column) -> Column:
    """Accents, case, apostrophes and punctuation removed; & spelled out; single spaces."""
    x = F.lower(F.translate(name, ACCENTED, PLAIN))
    x = F.regexp_replace(F.regexp_replace(x, "&", " and "), "['’]", "")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def tokenise(name: Column) -> Column:
    """Tokens of the normalised name without stop words."""
    return F.filter(F.split(normalise_name(name), " "), lambda t: (t != "") & ~t.isin(*STOPWORDS))


def tidy_name(name: Column) -> Column:
    """Title case for names in capitals; small words stay small and numerals large, except first."""
    clean = F.regexp_replace(F.trim(name), r"\s+", " ")
    words = F.split(F.lower(clean), " ")
    # only a leading a-z is raised, so initcap doesn't fit
    first = lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))).otherwise(w)
    titled = F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).when((i > 0) & w.rlike(ROMAN), F.upper(w)).otherwise(first(w)))
    return F.when(clean == F.upper(clean), F.array_join(titled, " ")).otherwise(clean)


def alternative_names(original: Column, primary: Column) -> Column:
    """The part before ; or : tidied, if over two characters, and the original; each once, without the primary."""
    head = F.trim(F.split(original, "[;:]")[0])
    names = F.array(F.when(F.length(head) > 2, tidy_name(head)), F.trim(original))
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != primary)))


def slugify(name: Column, default: str = "place", longest: int = 120) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.left(F.coalesce(F.nullif(slug, F.lit("")), F.lit(default)), F.lit(longest))


def strip_html(markup: Column) -> Column:
    """Tags to spaces, six families of references decoded, single spaces; empty is null."""
    x = F.regexp_replace(markup, "<[^>]*>", " ")
    for pattern, to in (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#0*39;|&apos;", "'")):
        x = F.regexp_replace(x, pattern, to)
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-case host without www.; the text itself, lowered, if it has none."""
    return F.lower(F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1), F.lit("")), url), "^www[.]", ""))


def leading_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^(-?\d{1,6})", 1), F.lit("")).cast("int")


def capture_scale_metres(scale: Column) -> Column:
    """Half a millimetre at the scale; 25 where it isn't stated."""
    n = F.nullif(F.regexp_extract(F.coalesce(scale, F.lit("")), r"1\s*:\s*(\d+)", 1), F.lit("")).cast("double")
    return F.when(n > 0, n * 0.0005).otherwise(F.lit(25.0))


def postcode_key(code: Column) -> Column:
    return F.upper(F.regexp_replace(code, r"\s+", ""))


def mask_numbers(reason: Column) -> Column:
    return F.regexp_replace(reason, r"\d+(\.\d+)?", "N")


def label(code: Column) -> Column:
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def bigrams(x: Column) -> Column:
    return F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substr(x, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def bigram_set(x: Column) -> Column:
    """The bigrams of x, each with its number among equal ones, so that sets of them intersect like multisets.

    A bigram is one long: its code points in 21 bits each, the number above them. Sets of longs intersect without objects.
    """
    among = lambda grams, g, i: F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda y: y == g))
    number = lambda grams, g, i: F.when(F.array_position(grams, g) == i + 1, 1).otherwise(among(grams, g, i))
    code = lambda g: F.ascii(g).cast("long") * F.lit(2**21) + F.ascii(F.substr(g, F.lit(2), F.lit(1)))
    return let(x, lambda s: let(F.transform(bigrams(s), code), lambda grams: F.transform(grams, lambda g, i: number(grams, g, i).cast("long") * F.lit(2**42) + g)))


def bigram_dice(a: Column, grams_a: Column, b: Column, grams_b: Column) -> Column:
    """Sorensen-Dice coefficient of two texts whose bigram sets are given."""
    score = F.lit(2.0) * F.size(F.array_intersect(grams_a, grams_b)) / (F.length(a) + F.length(b) - 2)
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(score)


def dice(a: Column, b: Column) -> Column:
    """Sorensen-Dice coefficient on character-bigram multisets."""
    both = F.struct(a.alias("a"), b.alias("b"))
    return let(both, lambda p: bigram_dice(p["a"], bigram_set(p["a"]), p["b"], bigram_set(p["b"])))


def containment(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller token set; 0 without tokens."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def is_subset(inner: Column, outer: Column) -> Column:
    return (F.size(inner) > 0) & (F.size(F.array_except(inner, outer)) == 0)


def same_tokens(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def csv_quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))


def format_year(year: Column) -> Column:
    """800 BC or AD 409; from 10000 BC on, thousands."""
    before = -year
    thousands = F.format_number((F.floor(before / 1000.0 + 0.5) * 1000).cast("long"), 0)
    return F.when(before >= 10000, F.concat(thousands, F.lit(" BC"))).when(year < 0, F.concat(before.cast("string"), F.lit(" BC"))).otherwise(F.concat(F.lit("AD "), year.cast("string")))


def round_half_up(x: Column, places: int) -> Column:
    """Half goes to the larger number, also below zero."""
    return F.floor(x * float(10**places) + 0.5).cast("double") / float(10**places)


def iso_from_millis(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

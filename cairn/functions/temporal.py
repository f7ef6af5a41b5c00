"""Periods and centuries that a text claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that blank all claims, in three families.
FALSE_FRIENDS = (
    r"\broman\s+catholic\b",
    r"\bnorman\s+(?:road|street|avenue|close|court|terrace|way|house|cottage|lodge|farm)\b",
    r"\bvictoria\b",
    r"\b(?:roman|norman|victoria|stuart|tudor|george|albert)\s+(?:road|street|avenue|lane|close|drive|way|terrace|crescent|gardens|place|square|walk|rise|grove)\b",
    r"\bstatue\s+of\b",
    r"\b(?:king|queen|sir|lord|lady|saint|st)\s+\w*\s*(?:stuart|tudor|norman)\b",
    r"\b(tudor|georgian|victorian|norman|roman|saxon|stuart)\s+(cottage|house|barn|farm|farmhouse|hall|lodge|cottages|bungalow|inn|court|lea|view|mount|bank|croft)\b",
)
#: Nouns that make a period word a description.
MONUMENT_NOUNS = (
    r"\b(?:villa|fort|fortlet|camp|settlement|enclosure|barrow|cairn|henge|tumulus|earthwork|dyke|hillfort|rampart|burial|cemetery|cist|monument|monastery|nunnery|abbey|priory|friary"
    r"|chapel|church|minster|castle|motte|bailey|keep|moat|moated|manor|grange|mill|kiln|furnace|bloomery|quarry|mine|bridge|causeway|signal\s+station|watchtower|pillbox|bunker|decoy|radar"
    r"|battery|aerodrome|airfield|defences?|site|remains|ruins?|cross|font|sundial|tomb|effigy|gatehouse|arch|tower|platform|deserted\s+(?:medieval\s+)?village|field\s+system|trackway)\b"
)
#: Period words in order.
PERIOD_WORDS = (
    ("palaeolithic", r"\b(?:palaeolithic|paleolithic)\b"),
    ("mesolithic", r"\bmesolithic\b"),
    ("neolithic", r"\bneolithic\b"),
    ("bronze_age", r"\bbronze[\s-]age\b"),
    ("iron_age", r"\biron[\s-]age\b"),
    ("roman", r"\b(?:romano[\s-]british|roman)\b"),
    ("early_medieval", r"\b(?:anglo[\s-]saxon|saxon|viking|early[\s-]medi(?:e|ae)val)\b"),
    ("norman", r"\bnorman\b"),
    ("medieval", r"\bmedi(?:e|ae)val\b"),
    ("tudor", r"\btudor\b"),
    ("stuart", r"\b(?:stuart|jacobean|civil war)\b"),
    ("georgian", r"\b(?:georgian|regency)\b"),
    ("victorian", r"\bvictorian\b"),
    ("edwardian", r"\bedwardian\b"),
    ("wwi", r"\b(?:first world war|world war (?:i|one)|ww1|wwi)\b"),
    ("wwii", r"\b(?:second world war|world war (?:ii|two)|ww2|wwii)\b"),
    ("postwar", r"\b(?:cold war)\b"),
)
SPELLED = ("tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth")


def is_false_friend(text: Column) -> Column:
    out = F.lit(False)
    for pattern in FALSE_FRIENDS:
        out = out | text.rlike(f"(?i){pattern}")
    return out


def centuries(text: Column) -> Column:
    """Array of century numbers, 1 to 21, in the order of the three ways to write them."""
    figures = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    spelled = F.transform(
        F.regexp_extract_all(text, F.lit(rf"(?i)\b({'|'.join(SPELLED)})[\s-]century\b"), F.lit(1)),
        lambda x: (F.array_position(F.array(*[F.lit(s) for s in SPELLED]), F.lower(x)) + 9).cast("int"),
    )
    found = F.concat(figures(r"\bC(\d{1,2})\b"), figures(r"(?i)\b(\d{1,2})(?:st|nd|rd|th)[\s-]century\b"), spelled)
    return F.filter(found, lambda n: n.between(1, 21))


def period_words(text: Column, descriptive: Column) -> Column:
    """Array of (period, text) of the period words, where the text describes a monument."""
    hits = [F.when(text.rlike(f"(?i){p}"), F.struct(F.lit(k).alias("period"), F.regexp_extract(text, f"(?i){p}", 0).alias("text"))) for k, p in PERIOD_WORDS]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return F.when(descriptive | text.rlike(f"(?i){MONUMENT_NOUNS}"), found).otherwise(F.filter(found, lambda x: F.lit(False)))


def period_of_span(start: Column, end: Column, periods) -> Column:
    """The period of a registry (id, name, first, last) that overlaps most; the first of equals."""
    ranked = [F.struct((F.least(end, F.lit(z)) - F.greatest(start, F.lit(a))).alias("overlap"), F.lit(-i).alias("order"), F.lit(k).alias("id")) for i, (k, _, a, z) in enumerate(periods)]
    best = F.array_max(F.array(*ranked))
    return F.when(best["overlap"] > 0, best["id"])


def claims(text: Column, descriptive: Column, periods) -> Column:
    """Array of (period, start_year, end_year, precision): centuries, then period words; the first claim of a period."""
    spans = {k: (a, z) for k, _, a, z in periods}
    start = lambda n: (n - 1) * 100 + 1
    dated = F.transform(
        centuries(text),
        lambda n: F.struct(period_of_span(start(n), n * 100, [p for p in periods if p[0] != "prehistory"]).alias("period"), start(n).alias("start_year"), (n * 100).alias("end_year"), F.lit("century").alias("precision")),
    )
    edge = lambda x, i: F.create_map(*[v for k, s in spans.items() for v in (F.lit(k), F.lit(s[i]))])[x["period"]]
    named = F.transform(period_words(text, descriptive), lambda x: F.struct(x["period"].alias("period"), edge(x, 0).alias("start_year"), edge(x, 1).alias("end_year"), F.lit("period").alias("precision")))
    both = F.filter(F.concat(dated, named), lambda x: x["period"].isNotNull())
    first = F.filter(both, lambda x, i: (F.array_position(F.transform(both, lambda y: y["period"]), x["period"]) - 1) == i)
    return F.when(text.isNull() | is_false_friend(text), F.filter(both, lambda x: F.lit(False))).otherwise(first)

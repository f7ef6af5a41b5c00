"""Kinds of place from names and designations, grades, and which kinds agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules in order (rule, pattern, kind, confidence); the first that matches counts.
PLACE_RULES = (
    ("farm-not-castle", r"\b(castle|abbey|priory)\s+(farm|farmhouse|cottage|barn|house|inn)\b", "monument", 0.2),
    ("named-works", r"\bworks\s*$", "industrial_site", 0.7),
    ("cathedral", r"\bcathedrals?\b|\bminster\b", "cathedral", 0.9),
    ("abbey", r"\babbeys?\b", "abbey", 0.9),
    ("priory", r"\bpriory\b|\bpriories\b|\bmonaster(y|ies)\b|\bnunner(y|ies)\b", "priory", 0.85),
    ("churchyard-monument", r"\bchurchyard\s+cross\b|\bchurchyard\s+monument\b|\btombs?\b|\bheadstones?\b", "monument", 0.85),
    ("church", r"\bchurch(es)?\b|\bchapels?\b", "church", 0.9),
    ("pillbox", r"\bpill\s?box(es)?\b", "pillbox", 0.9),
    ("bunker", r"\bbunkers?\b|\bair\s?raid\s+shelters?\b", "bunker", 0.85),
    ("airfield", r"\bairfields?\b|\baerodromes?\b", "airfield", 0.85),
    ("military", r"\banti-?aircraft\b|\bgun\s+(site|emplacement|battery|batteries)s?\b|\bordnance\s+factor(y|ies)\b|\bbarracks\b|\bmilitary\b", "military_installation", 0.8),
    ("battlefield", r"\bbattle\s+of\b|\bbattlefield\b", "battlefield", 0.95),
    ("hillfort", r"\bhill\s?forts?\b|\bpromontory\s+forts?\b", "hillfort", 0.9),
    ("castle", r"\bcastles?\b", "castle", 0.85),
    ("fort", r"\bforts?\b|\bfortlets?\b|\bsignal\s+stations?\b", "fort", 0.8),
    ("roman-villa", r"\bvillas?\b", "roman_villa", 0.8),
    ("roman-settlement", r"\broman\s+(town|settlement|fort|road|camp)s?\b", "archaeological_site", 0.75),
    ("prehistoric", r"\b(barrows?|cairns?|henges?|tumulus|tumuli|standing\s+stones?|stone\s+circles?|cross-?dykes?|dykes?|earthworks?|enclosures?|oppidum|settlements?)\b", "archaeological_site", 0.8),
    ("deserted-village", r"\bdeserted\b.*\bvillage\b|\bmedieval\s+village\b|\bdeserted\s+settlement\b", "archaeological_site", 0.85),
    ("colliery", r"\bcollier(y|ies)\b|\bmines?\b|\bcoke\s+ovens?\b|\bfoundr(y|ies)\b|\bforges?\b|\bkilns?\b", "industrial_site", 0.85),
    ("mill", r"\bmills?\b|\bwindmills?\b", "industrial_site", 0.75),
    ("railway", r"\brailways?\b|\bsignal\s+box(es)?\b|\bstations?\b|\bviaducts?\b|\bengine\s+sheds?\b", "railway_site", 0.75),
    ("canal", r"\bcanals?\b|\blocks?\b|\baqueducts?\b|\bwharf\b|\btowpaths?\b", "canal_structure", 0.8),
    ("garden", r"\bgardens?\b|\bpleasure\s+ground\b|\barboretum\b", "garden", 0.75),
    ("park", r"\bpark\b|\bdeer\s+park\b", "historic_landscape", 0.7),
    ("country-house", r"\bhalls?\b|\bmanors?\b|\bcourt\b|\bpalaces?\b", "country_house", 0.7),
    ("monument", r"\bcross(es)?\b|\bmonuments?\b|\bmemorials?\b|\bmilestones?\b|\bobelisks?\b|\bstocks\b", "monument", 0.8),
    ("ruin", r"\bruins?\b", "ruin", 0.7),
    ("lost", r"^\s*(site of|remains of)\b|\bsite\s+of\s+(the\s+)?former\b", "lost_structure", 0.8),
    (
        "building",
        r"\b(house|houses|cottages?|farmhouses?|barns?|terraces?|almshouses?|vicarage|rectory|parsonage|schools?|inns?|hotels?|stables?|granar(y|ies)|warehouses?|dovecotes?|lodges?)\b",
        "building", 0.7,
    ),
    (
        "structure",
        r"\b(bridges?|walls?|gates?|gate\s+piers?|piers?|railings?|culverts?|steps?|fountains?|troughs?|pumps?|posts?|boundary\s+stones?|sundials?|gazebos?|follies|folly)\b",
        "structure", 0.7,
    ),
)
FALLBACK = "generic-fallback"
#: What a designation implies where the name says nothing.
FALLBACK_KINDS = {
    "listed_building": "structure", "scheduled_monument": "archaeological_site", "registered_park_garden": "historic_landscape",
    "registered_battlefield": "battlefield", "protected_wreck": "archaeological_site",
}
GRADES = ("I", "II*", "II", "A", "B", "C")
#: Groups of kinds that don't argue against each other, and the built kinds that a structure may be.
KIN = (
    ("abbey", "priory", "church", "cathedral", "ruin", "monument"),
    ("castle", "fort", "hillfort", "ruin", "archaeological_site"),
    ("country_house", "palace", "garden", "historic_landscape", "building"),
    ("industrial_site", "railway_site", "canal_structure", "building"),
    ("military_installation", "pillbox", "bunker", "airfield"),
    ("archaeological_site", "settlement", "historic_village", "lost_structure", "roman_villa"),
)
BUILT = tuple(
    """structure building monument castle church abbey priory cathedral country_house palace fort ruin industrial_site railway_site canal_structure
    military_installation pillbox bunker museum lost_structure""".split()
)
AREAS = ("registered_park_garden", "registered_battlefield", "world_heritage_site")


def place_type(name: Column, designation: Column) -> Column:
    """Struct (kind, confidence, rule): a telling designation, else the first rule of the name, else the fallback."""

    def found(kind: str, confidence: float, rule: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule"))

    out = F.when(designation == "registered_battlefield", found("battlefield", 0.98, "designation:battlefield"))
    out = out.when(designation == "registered_park_garden", found("historic_landscape", 0.9, "designation:park-garden"))
    for rule, pattern, kind, confidence in PLACE_RULES:
        out = out.when(name.rlike(f"(?i){pattern}"), found(kind, confidence, rule))
    for d, kind in FALLBACK_KINDS.items():
        out = out.when(designation == d, found(kind, 0.3, f"{FALLBACK}:{d}"))
    return out.otherwise(found("unknown", 0.0, FALLBACK))


def is_fallback(rule: Column) -> Column:
    return rule.startswith(FALLBACK)


def grade(raw: Column) -> Column:
    """The grade if it is a known one."""
    return F.when(F.trim(raw).isin(*GRADES), F.trim(raw))


def types_compatible(a: Column, b: Column) -> Column:
    out = (a == b) | (a == "unknown") | (b == "unknown") | ((a == "structure") & b.isin(*BUILT)) | ((b == "structure") & a.isin(*BUILT))
    for group in KIN:
        out = out | (a.isin(*group) & b.isin(*group))
    return out


def _kin_bits(kind: Column, of_all: int, of_unknown: int, of_structure: int, of_built: int) -> Column:
    """A long of kind: a bit for each group of kin, and what types_compatible says of unknown kinds and of structures."""
    bits = F.lit(of_all).cast("long")
    told = [(kind == "unknown", of_unknown), (kind == "structure", of_structure), (kind.isin(*BUILT), of_built), *[(kind.isin(*group), 16 << i) for i, group in enumerate(KIN)]]
    for holds, bit in told:
        bits = bits + F.when(holds, bit).otherwise(0)
    return bits


def asked_kin(kind: Column) -> Column:
    """What kinds_fit compares of a pair's left side; made once a record."""
    return _kin_bits(kind, 2, 1, 4, 8)


def given_kin(kind: Column) -> Column:
    """What kinds_fit compares of a pair's right side; made once a record."""
    return _kin_bits(kind, 1, 2, 8, 4)


def kinds_fit(a: Column, b: Column, asked: Column, given: Column) -> Column:
    """types_compatible of two kinds, by their bits: a pair costs two comparisons instead of one for each kind listed."""
    return (a == b) | (asked.bitwiseAND(given) != 0)


def is_area(designation: Column) -> Column:
    return designation.isin(*AREAS)


def area_against_structure(a: Column, b: Column) -> Column:
    """One array of designations has areas alone and the other doesn't."""
    area = lambda x: F.forall(x, is_area)
    return (F.size(a) > 0) & (F.size(b) > 0) & (area(a) != area(b))

"""Items of a knowledge base as candidates: kind, designations, position and what is odd about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import stated_accuracy_m

#: The kind of place that a class label stands for; other labels stand for none.
CLASSES = {
    "castle": "castle",
    "episcopal palace": "country_house",
    "english country house": "country_house",
    "country house": "country_house",
    "palace": "palace",
    "abbey": "abbey",
    "monastery": "abbey",
    "priory": "priory",
    "cathedral": "cathedral",
    "church building": "church",
    "church": "church",
    "chapel": "church",
    "battle": "battlefield",
    "battlefield": "battlefield",
    "model village": "historic_village",
    "village": "historic_village",
    "deserted medieval village": "archaeological_site",
    "bowl barrow": "archaeological_site",
    "round barrow": "archaeological_site",
    "archaeological site": "archaeological_site",
    "roman town": "archaeological_site",
    "hillfort": "hillfort",
    "mill building": "industrial_site",
    "mill": "industrial_site",
    "mine": "industrial_site",
    "colliery": "industrial_site",
    "lock": "canal_structure",
    "weir": "canal_structure",
    "railway station": "railway_site",
    "botanical garden": "garden",
    "french formal garden": "garden",
    "garden": "garden",
    "park": "historic_landscape",
    "museum": "museum",
    "market cross": "monument",
    "high cross": "monument",
    "monument": "monument",
    "memorial": "monument",
    "house": "building",
    "architectural structure": "structure",
    "wall": "structure",
    "bridge": "structure",
    "ruins": "ruin",
}
#: The designation that a label stands for.
DESIGNATION_LABELS = {
    "grade i listed building": "listed_building",
    "grade ii* listed building": "listed_building",
    "grade ii listed building": "listed_building",
    "listed building": "listed_building",
    "scheduled monument": "scheduled_monument",
    "world heritage site": "world_heritage_site",
    "registered historic park or garden": "registered_park_garden",
    "registered battlefield": "registered_battlefield",
}
#: The confidence of a mapped kind; metres from which a position is approximate.
SURE, APPROXIMATE_M = 0.85, 250.0


def _of_label(label: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(label)))


def normalise_items(items: DataFrame) -> DataFrame:
    """(qid, name, place_type, type_confidence, rule, lng, lat, accuracy_m, method, identifiers, designations, alt_names, warnings, rejected).

    Items have qid, label, aliases, lat, lon, precision (degrees), instance_of, designations and register_ids, arrays of
    labels. The first class label that is mapped gives the kind; an item without a possible position is rejected.
    """
    c = F.col
    labels = lambda k: F.coalesce(c(k), F.array().cast("array<string>"))
    known = F.filter(F.transform(labels("instance_of"), lambda x: F.struct(F.lower(F.trim(x)).alias("label"), _of_label(x, CLASSES).alias("kind"))), lambda x: x["kind"].isNotNull())
    first = F.get(known, F.lit(0))
    metres = stated_accuracy_m(c("precision"))
    mapped = F.array_distinct(F.array_compact(F.transform(labels("designations"), lambda x: _of_label(x, DESIGNATION_LABELS))))
    n = F.size(labels("register_ids"))
    odd = F.array(
        F.when(first.isNull() & (F.size(labels("instance_of")) > 0), "no class is mapped"),
        F.when(n > 1, F.concat(n.cast("string"), F.lit(" register entries"))),
        F.when(c("precision").isNotNull() & (metres > c("precision") * 111_320.0 + 1e-6), "stated precision is no measured accuracy"),
    )
    rejected = F.when(c("lat").isNull() | c("lon").isNull(), "no position").when((F.abs("lat") > 90) | (F.abs("lon") > 180), "impossible position")
    ids = F.concat(F.array(F.concat(F.lit("wikidata:"), "qid")), F.transform(labels("register_ids"), lambda x: F.concat(F.lit("register:"), x)))
    return items.select(
        "qid", F.trim("label").alias("name"), F.coalesce(first["kind"], F.lit("unknown")).alias("place_type"), F.when(first.isNotNull(), SURE).otherwise(0.0).alias("type_confidence"),
        F.coalesce(F.concat(F.lit("instance-of:"), first["label"]), F.lit("unmapped")).alias("rule"), c("lon").alias("lng"), "lat", F.round(metres, 1).alias("accuracy_m"),
        F.when(metres > APPROXIMATE_M, "approximate").otherwise("source").alias("method"), ids.alias("identifiers"), mapped.alias("designations"),
        F.filter(labels("aliases"), lambda x: (x != "") & (x != c("label"))).alias("alt_names"), F.array_compact(odd).alias("warnings"), rejected.alias("rejected"),
    )

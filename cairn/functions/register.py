"""Register rows as candidates: names, kind, designation, position, identifiers, what is odd about them, or why they are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import classify, geo, text

#: Predicates that may be published, in their registry's order.
PREDICATES = (
    "inception_year", "completion_year", "demolished_year", "official_website", "commons_category", "heritage_designation",
    "designation_reference", "first_designated", "former_name", "historic_use", "area_hectares",
)
NO_ADDRESS = "the register gives no town, county or postcode here"
NO_DESIGNATION = "no statutory designation"


def plain_number(x: Column) -> Column:
    """A number as text, whole ones without a point."""
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def normalise_register(rows: DataFrame) -> DataFrame:
    """(id, name, alt_names, place_type, type_confidence, rule, lng, lat, method, accuracy_m, designations, identifiers, keys,
    area_hectares, warnings, rejected) of register rows.

    Rows have id, entry (the register's own number), name, designation, grade, easting, northing, capture_scale,
    area_ha (not null for areas) and designated_ms. A row without a position, or with one outside the grid, is rejected and
    keeps its name and entry alone. An unknown grade is left out and warned of, as is a kind that no rule tells.
    """
    c = F.col
    kind, grade = classify.place_type(c("name"), c("designation")), classify.grade(c("grade"))
    at, where = geo.osgb36_to_wgs84(geo.grid_to_osgb36(c("easting"), c("northing"))), geo.position_estimate(c("capture_scale"), c("area_ha"), c("area_ha").isNotNull())
    told = rows.withColumns({"k": kind, "g": grade, "at": at, "where": where, "tidy": text.tidy_name(c("name"))})
    outside = F.concat(F.lit("grid reference outside Great Britain (E"), plain_number(c("easting")), F.lit(" N"), plain_number(c("northing")), F.lit(")"))
    rejected = F.when(c("easting").isNull() | c("northing").isNull(), "missing easting or northing").when(c("at").isNull(), outside)
    one = F.struct("designation", c("g").alias("grade"), c("entry").alias("reference"), text.iso_from_millis(c("designated_ms")).alias("first_designated"))
    odd = F.array(
        F.when(classify.is_fallback(c("k.rule")), F.concat(F.lit("no kind could be told from the name; fell back to "), c("k.kind"), F.lit(" by "), c("k.rule"))),
        F.when(c("designation").isNull(), NO_DESIGNATION),
        F.when(c("designation").isNotNull() & (F.trim("grade") != "") & c("g").isNull(), F.concat(F.lit('unknown grade "'), c("grade"), F.lit('"'))),
        F.lit(NO_ADDRESS),
    )
    kept = lambda x: F.when(c("rejected").isNull(), x)
    told = told.withColumn("rejected", rejected)
    identifier = F.struct(F.lit("nhle").alias("scheme"), c("entry").alias("value"))
    out = {
        "place_type": c("k.kind"), "type_confidence": c("k.confidence"), "rule": c("k.rule"), "lng": c("at.lng"), "lat": c("at.lat"), "method": c("where.method"), "accuracy_m": c("where.accuracy_m"),
        "alt_names": text.alternative_names(c("name"), c("tidy")), "designations": F.array_compact(F.array(F.when(c("designation").isNotNull(), one))), "identifiers": F.array(identifier),
        "area_hectares": c("area_ha"), "warnings": F.array_compact(odd),
    }
    return told.select("id", c("tidy").alias("name"), "entry", *[kept(x).alias(k) for k, x in out.items()], "rejected")


def candidate_facts(candidates: DataFrame) -> DataFrame:
    """(id, predicate, value, source_value) of candidates: each fact once, empty ones left out, of registered predicates alone.

    Candidates have id, name, alt_names, designations, area_hectares and, if they have them, inception_year,
    completion_year, demolished_year, official_website, commons_category and historic_use.
    """
    c, kind = F.col, "array<struct<predicate: string, value: string, source_value: string>>"
    has = set(candidates.columns)

    def fact(predicate: str, value: Column, source: Column | None = None) -> Column:
        return F.struct(F.lit(predicate).alias("predicate"), value.cast("string").alias("value"), (F.lit(None) if source is None else source).cast("string").alias("source_value"))

    area = plain_number(c("area_hectares")) if "area_hectares" in has else F.lit(None)
    single = [fact("inception_year", c("inception_year"), c("inception_year"))] if "inception_year" in has else []
    single += [fact(p, c(p)) for p in ("completion_year", "demolished_year", "official_website", "commons_category", "historic_use") if p in has]
    single.append(fact("area_hectares", area))
    none = F.array().cast(kind)
    of = lambda x, body: F.coalesce(F.transform(x, body), none)
    facts = F.concat(
        F.array(*single),
        of(c("designations"), lambda d: fact("designation_reference", d["reference"])),
        of(c("designations"), lambda d: fact("first_designated", F.left(d["first_designated"], F.lit(10)), d["first_designated"])),
        of(F.filter("alt_names", lambda n: n != c("name")), lambda n: fact("former_name", n)),
    )
    rows = candidates.select("id", F.explode(F.array_distinct(facts)).alias("f")).select("id", "f.*")
    return rows.filter((F.col("value") != "") & F.col("predicate").isin(*PREDICATES))

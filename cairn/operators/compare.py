"""What two sources say of one place, field by field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.text import host_of

AGREEMENT, COMPLEMENTARY, CONFLICT = "AGREEMENT", "COMPLEMENTARY", "CONFLICT"
#: Names this alike agree; years this near agree.
SAME_NAME, YEARS = 0.92, 25


def identifiers(known: Column, new: Column) -> Column:
    """Outcome of one scheme's identifiers, two arrays: none known, none shared, or shared; null if nothing is new."""
    return F.when(F.size(new) > 0, F.when(F.size(known) == 0, COMPLEMENTARY).when(F.arrays_overlap(known, new), AGREEMENT).otherwise(CONFLICT))


def further_identifiers(known: Column, new: Column) -> Column:
    """Identifiers that the new source adds to a scheme on which both agree."""
    return F.when(F.arrays_overlap(known, new), F.array_except(new, known)).otherwise(F.filter(new, lambda x: F.lit(False)))


def name(similarity: Column) -> Column:
    return F.when(similarity >= SAME_NAME, AGREEMENT).otherwise(COMPLEMENTARY)


def kind(a: Column, a_sure: Column, b: Column, b_sure: Column) -> Column:
    """Null where the new source isn't sure of the kind."""
    fits = F.when(classify.types_compatible(a, b), AGREEMENT).otherwise(CONFLICT)
    return F.when(b_sure >= 0.7, F.when(a_sure < 0.7, COMPLEMENTARY).otherwise(fits))


def position(conflict: Column) -> Column:
    return F.when(conflict, CONFLICT).otherwise(AGREEMENT)


def year(a: Column, b: Column) -> Column:
    return F.when(b.isNotNull(), F.when(a.isNull(), COMPLEMENTARY).when(F.abs(a - b) <= YEARS, AGREEMENT).otherwise(CONFLICT))


def website(a: Column, b: Column) -> Column:
    return F.when(b.isNotNull(), F.when(a.isNull(), COMPLEMENTARY).when(host_of(a) == host_of(b), AGREEMENT).otherwise(CONFLICT))


def designation(known: Column, new: Column) -> Column:
    return F.when(F.array_contains(known, new), AGREEMENT).otherwise(COMPLEMENTARY)


def overall(fields: Column) -> Column:
    """Conflict before complement before agreement, over an array of outcomes."""
    has = lambda x: F.exists(fields, lambda f: f == x)
    return F.when(has(CONFLICT), CONFLICT).when(has(COMPLEMENTARY), COMPLEMENTARY).otherwise(AGREEMENT)


def for_review(known: Column, new: Column, positional: bool = False) -> Column:
    """The reviewer's view of a field: missing, complementary, agreement, positional or conflict."""
    differ = F.lit("positional") if positional else F.lit("conflict")
    return F.when(new.isNull(), "missing").when(known.isNull(), "complementary").when(known == new, "agreement").otherwise(differ)

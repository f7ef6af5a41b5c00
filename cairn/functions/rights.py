"""Licences, attribution and the state of a media file's rights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_html

#: Licence patterns in order.
LICENCES = (
    (r"^cc0\b|creative\s*commons\s*zero|public\s*domain\s*dedication", "CC0"),
    (r"^cc[\s-]*by[\s-]*sa[\s-]*4\.0", "CC-BY-SA-4.0"),
    (r"^cc[\s-]*by[\s-]*sa[\s-]*3\.0", "CC-BY-SA-3.0"),
    (r"^cc[\s-]*by[\s-]*sa[\s-]*2\.5", "CC-BY-SA-2.5"),
    (r"^cc[\s-]*by[\s-]*sa[\s-]*2\.0", "CC-BY-SA-2.0"),
    (r"^cc[\s-]*by[\s-]*4\.0", "CC-BY-4.0"),
    (r"^cc[\s-]*by[\s-]*3\.0", "CC-BY-3.0"),
    (r"^cc[\s-]*by[\s-]*2\.5", "CC-BY-2.5"),
    (r"^cc[\s-]*by[\s-]*2\.0", "CC-BY-2.0"),
    (r"public\s*domain|^pd(-|\b)", "PUBLIC-DOMAIN"),
    (r"fair\s*use|non[\s-]*commercial|\bnc\b|no[\s-]*deriv|\bnd\b|all\s*rights\s*reserved|copyright(ed)?\b", "UNSUPPORTED"),
)
#: How a licence is shown; the CC BY family needs attribution, and all here may be reused.
SHOWN = {
    "CC0": "CC0 1.0", "PUBLIC-DOMAIN": "Public domain", "CC-BY-2.0": "CC BY 2.0", "CC-BY-2.5": "CC BY 2.5", "CC-BY-3.0": "CC BY 3.0", "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-SA-2.0": "CC BY-SA 2.0", "CC-BY-SA-2.5": "CC BY-SA 2.5", "CC-BY-SA-3.0": "CC BY-SA 3.0", "CC-BY-SA-4.0": "CC BY-SA 4.0",
}
SOURCE = "Wikimedia Commons"


def licence(*raw: Column) -> Column:
    """The licence of the first text that any pattern fits; UNKNOWN without one."""
    tests = []
    for text in raw:
        plain = strip_html(text)
        match = F.lit(None).cast("string")
        for pattern, code in reversed(LICENCES):
            match = F.when(plain.rlike(f"(?i){pattern}"), code).otherwise(match)
        tests.append(match)
    return F.coalesce(*tests, F.lit("UNKNOWN"))


def needs_attribution(code: Column) -> Column:
    return code.startswith("CC-BY")


def is_reusable(code: Column) -> Column:
    return code.isin(*SHOWN)


def shown(code: Column) -> Column:
    out = F.lit("Unknown")
    for k, v in {**SHOWN, "UNSUPPORTED": "Not reusable"}.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def attribution(title: Column, creator: Column, code: Column, source: str = SOURCE) -> Column:
    """"title", by creator, licence, via source; null if a creator is needed and missing."""
    quoted = F.when(title != "", F.concat(F.lit('"'), title, F.lit('"')))
    line = F.concat_ws(", ", quoted, F.concat(F.lit("by "), creator), shown(code), F.lit(f"via {source}"))
    return F.when(~(needs_attribution(code) & creator.isNull()), line)


def association(depicts: Column, qid: Column, category: Column) -> Column:
    """Struct (outcome, confidence): the file depicts the entity, was found by its category, or neither."""
    case = lambda name, x: F.struct(F.lit(name).alias("outcome"), F.lit(x).alias("confidence"))
    return F.when(depicts == qid, case("media_match_confident", 0.95)).when(category != "", case("media_match_review", 0.5)).otherwise(case("media_no_match", 0.0))


def state(media_url: Column, page_url: Column, creator: Column, code: Column, line: Column, confident: Column) -> Column:
    """The first thing that stands in the way, else media_ready."""
    return (
        F.when(media_url.isNull() | page_url.isNull(), "media_invalid")
        .when(code == "UNKNOWN", "media_rights_incomplete")
        .when(~is_reusable(code), "media_licence_unsupported")
        .when(needs_attribution(code) & creator.isNull(), "media_creator_unknown")
        .when(line.isNull(), "media_rights_incomplete")
        .when(~confident, "media_association_review")
        .otherwise("media_ready")
    )

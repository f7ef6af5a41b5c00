"""Inputs of the discovery API, with what is wrong with them."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qs, urlencode

MODES = ("all", "sacred", "industry")


@dataclass
class SearchRequest:
    """A search: text to 200 characters, radius to 200 km, 1 to 100 rows, an offset from 0."""

    words: str | None = None
    radius_m: float | None = None
    limit: int = 50
    offset: int = 0

    def problems(self) -> list[str]:
        tests = (
            (self.words is not None and len(self.words) > 200, "text is over 200 characters"),
            (self.radius_m is not None and not 0 < self.radius_m <= 200_000, "radius is not within 0 and 200000"),
            (not 1 <= self.limit <= 100, "limit is not within 1 and 100"),
            (self.offset < 0, "offset is negative"),
        )
        return [why for bad, why in tests if bad]


@dataclass
class ReviewRequest:
    """A review: 1 to 5 stars, and a visit of at most a day."""

    rating: int
    visit_minutes: int | None = None

    def problems(self) -> list[str]:
        tests = ((not 1 <= self.rating <= 5, "rating is not within 1 and 5"), (self.visit_minutes is not None and not 0 <= self.visit_minutes <= 1440, "visit is over 1440 minutes"))
        return [why for bad, why in tests if bad]


@dataclass
class CorrectionRequest:
    """A correction: a value or a note."""

    field: str
    value: str | None = None
    note: str | None = None

    def problems(self) -> list[str]:
        return [] if self.value or self.note else ["a value or a note is needed"]


def comma_list(value: str | None) -> list[str] | None:
    """Trimmed parts of a comma list, empty ones left out; None for none at all."""
    return [x.strip() for x in value.split(",") if x.strip()] if value else None


def _number(value: str | None, default: float) -> float:
    try:
        x = float(value) if value is not None else default
    except ValueError:
        return default
    return x if x - x == 0 else default


def _year(value: str | None) -> int | None:
    """A whole year; there is no year 0."""
    try:
        return int(value or "") or None
    except ValueError:
        return None


@dataclass
class DiscoveryState:
    """What a discovery link says; what is missing or unreadable takes the default."""

    lng: float = -1.55
    lat: float = 53.96
    zoom: float = 8.0
    words: str = ""
    period: str | None = None
    first_year: int | None = None
    last_year: int | None = None
    mode: str = "all"
    types: list[str] = field(default_factory=list)
    with_image: bool = False
    selected: str | None = None

    @classmethod
    def parse(cls, query: str, periods: tuple[str, ...]) -> DiscoveryState:
        said = {k: v[0] for k, v in parse_qs(query.lstrip("?"), keep_blank_values=True).items()}
        get = said.get
        return cls(
            _number(get("lng"), cls.lng), _number(get("lat"), cls.lat), _number(get("z"), cls.zoom), get("q", ""), get("period") if get("period") in periods else None, _year(get("from")), _year(get("to")),
            get("mode") if get("mode") in MODES else "all", comma_list(get("types")) or [], get("image") == "1", get("place"),
        )

    def query(self) -> str:
        """The link's parameters; but for the position only what differs from the default."""
        said = {"lng": f"{self.lng:.4f}", "lat": f"{self.lat:.4f}", "z": f"{self.zoom:.1f}", "q": self.words, "period": self.period, "from": self.first_year, "to": self.last_year}
        said |= {"mode": self.mode if self.mode != "all" else None, "types": ",".join(self.types), "image": "1" if self.with_image else None, "place": self.selected}
        return urlencode({k: v for k, v in said.items() if v not in (None, "")})

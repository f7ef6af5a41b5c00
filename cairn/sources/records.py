"""A paged register service read in parallel, with filters pushed to it, and as a stream of edited records.

``spark.read.format("cairn_records")`` and ``spark.readStream.format("cairn_records")`` after ``register(spark)``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .remote import get_json

SCHEMA = "layer int, entry long, easting double, northing double, edited timestamp, attributes string"
WIDEST = (0.0, 0.0, 800_000.0, 1_400_000.0)
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Pages(InputPartition):
    """Pages of a layer from one offset up to another; without an end, until one isn't full."""

    def __init__(self, layer: int, first: int, end: int | None):
        super().__init__((layer, first, end))
        self.layer, self.first, self.end = layer, first, end


class Service:
    """What is asked of the service: layers, a box on the national grid, and times of edits, as (after, up to) in milliseconds."""

    def __init__(self, options: dict):
        self.url = options["url"]
        self.layers = [int(x) for x in options["layers"].split(",")]
        self.size = int(options.get("page_size", 1000))
        self.pages = int(options.get("pages_a_task", 20))
        self.box = list(WIDEST)
        self.after: int | None = None
        self.upto: int | None = None

    def params(self) -> dict[str, str]:
        edited = [f"Edited > {self.after}"] * (self.after is not None) + [f"Edited <= {self.upto}"] * (self.upto is not None)
        out = {"where": " AND ".join(edited) or "1=1", "outFields": "*", "returnGeometry": "false", "orderByFields": "ListEntry ASC", "f": "json"}
        if tuple(self.box) != WIDEST:
            corners = dict(zip(("xmin", "ymin", "xmax", "ymax"), self.box, strict=True))
            out |= {"geometry": json.dumps(corners), "geometryType": "esriGeometryEnvelope", "inSR": "27700", "spatialRel": "esriSpatialRelIntersects"}
        return out

    def ask(self, layer: int, more: dict[str, str]) -> dict:
        body = get_json(f"{self.url}/{layer}/query", self.params() | more, retries=4)
        if body.get("error"):
            raise OSError(f"layer {layer}: {body['error'].get('message', 'unknown error')}")
        return body

    def partitions(self) -> list[InputPartition]:
        """So many pages a task, by a count of each layer's records; the last task of a layer reads on while pages are full."""
        out: list[InputPartition] = []
        step = self.size * self.pages
        for layer in self.layers:
            n = int(self.ask(layer, {"returnCountOnly": "true"}).get("count", 0))
            starts = list(range(0, max(n, 1), step))
            out += [Pages(layer, a, a + step if a != starts[-1] else None) for a in starts]
        return out

    def read(self, part: Pages) -> Iterator[tuple]:
        at, full = part.first, True
        while full and (part.end is None or at < part.end):
            features = self.ask(part.layer, {"resultOffset": str(at), "resultRecordCount": str(self.size)}).get("features", [])
            for x in features:
                a = x.get("attributes", {})
                edited = a.get("Edited")
                number = lambda k: float(a[k]) if isinstance(a.get(k), int | float) else None  # noqa: B023, E731
                entry = a.get("ListEntry")
                yield part.layer, entry if isinstance(entry, int) else None, number("Easting"), number("Northing"), None if edited is None else datetime.fromtimestamp(edited / 1000, UTC), json.dumps(a)
            at, full = at + self.size, len(features) == self.size

    def latest(self) -> int:
        """The last edit in any layer."""
        self.after = self.upto = None  # of a batch that was read before
        newest = [self.ask(x, {"orderByFields": "Edited DESC", "resultOffset": "0", "resultRecordCount": "1"}).get("features", []) for x in self.layers]
        return max((f[0]["attributes"].get("Edited") or 0 for f in newest if f), default=0)


class Records(DataSource):
    """Options: ``url`` (before /<layer>/query), ``layers`` (comma list), ``page_size``, ``pages_a_task``."""

    @classmethod
    def name(cls) -> str:
        return "cairn_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(Service(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RecordStream(Service(self.options))


class RecordReader(DataSourceReader):
    def __init__(self, service: Service):
        self.service = service

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows what the service is asked for: bounds of easting and northing become its box, earliest edits its where
        clause, layers those that are asked. Spark tests every filter again, as the service rounds and includes edges."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("easting", "northing"):
                at = ("easting", "northing").index(column)
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.service.box[at] = max(self.service.box[at], float(f.value))
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.service.box[at + 2] = min(self.service.box[at + 2], float(f.value))
            elif column == "edited" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                moment = f.value if f.value.tzinfo else f.value.replace(tzinfo=UTC)
                self.service.after = max(self.service.after or 0, int(moment.timestamp() * 1000) - 1)
            elif column == "layer" and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.service.layers = [x for x in self.service.layers if x in wanted]
            yield f

    def partitions(self) -> list[InputPartition]:
        box = self.service.box
        return [] if box[0] > box[2] or box[1] > box[3] else self.service.partitions()

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        return self.service.read(partition) if partition else iter(())  # no partitions are one without pages to Spark


class RecordStream(DataSourceStreamReader):
    """Batches of the records edited since the last one; an offset is a time of edit in milliseconds."""

    def __init__(self, service: Service):
        self.service = service

    def initialOffset(self) -> dict:
        return {"edited": -1}

    def latestOffset(self) -> dict:
        return {"edited": self.service.latest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.service.after, self.service.upto = start["edited"], end["edited"]
        return [] if start["edited"] >= end["edited"] else [Between(p, start["edited"], end["edited"]) for p in self.service.partitions()]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:
            return iter(())
        self.service.after, self.service.upto = partition.after, partition.upto
        return self.service.read(partition.pages)

    def commit(self, end: dict) -> None:
        pass


class Between(InputPartition):
    def __init__(self, pages: Pages, after: int, upto: int):
        super().__init__((pages.value, after, upto))
        self.pages, self.after, self.upto = pages, after, upto


def register(spark: SparkSession) -> None:
    """Registers the source, and lets Spark offer it the query's filters."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Records)

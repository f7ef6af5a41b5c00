"""Sources behind web services, as Python data sources: paged register layers, query bindings and media files.

Register them with ``register(spark)`` and read them with ``spark.read.format(name).options(...).load()``. Each partition
asks its own pages; what a service limits to one request at a time is one partition.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGENT = "cairn-ingestion/1.0"


def get_json(url: str, params: dict[str, str], retries: int = 0, backoff: float = 5.0) -> dict:
    """The JSON document at a URL. A 429 answer is asked again, each time after a longer pause; other errors are raised."""
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", headers={"Accept": "application/json", "User-Agent": AGENT})
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code != 429 or attempt == retries:
                raise OSError(f"{url}: HTTP {e.code}") from e
            time.sleep(backoff * (attempt + 1))
    raise AssertionError


class Layer(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class PagedLayers(DataSource):
    """Features of a paged register service, in order of entry: (layer int, attributes string of JSON).

    Options: ``url`` (before /<layer>/query), ``layers`` (comma list), ``page_size``, and ``box`` (west, south, east, north
    on the national grid), which the service filters by. A layer ends at its first page that isn't full; an error in
    the status or in the body ends the read.
    """

    @classmethod
    def name(cls) -> str:
        return "cairn_layers"

    def schema(self) -> str:
        return "layer int, attributes string"

    def reader(self, schema) -> DataSourceReader:
        return LayerReader(self.options)


class LayerReader(DataSourceReader):
    def __init__(self, options):
        self.url = options["url"]
        self.layers = [int(x) for x in options["layers"].split(",")]
        self.size = int(options.get("page_size", 1000))
        self.box = [float(x) for x in options["box"].split(",")] if options.get("box") else None

    def partitions(self) -> list[InputPartition]:
        return [Layer(x) for x in self.layers]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        params = {"where": "1=1", "outFields": "*", "returnGeometry": "false", "orderByFields": "ListEntry ASC", "f": "json", "resultRecordCount": str(self.size)}
        if self.box:
            corners = dict(zip(("xmin", "ymin", "xmax", "ymax"), self.box, strict=True))
            params |= {"geometry": json.dumps(corners), "geometryType": "esriGeometryEnvelope", "inSR": "27700", "spatialRel": "esriSpatialRelIntersects"}
        offset, full = 0, True
        while full:
            body = get_json(f"{self.url}/{partition.value}/query", params | {"resultOffset": str(offset)})
            if body.get("error"):
                raise OSError(f"layer {partition.value}: {body['error'].get('message', 'unknown error')}")
            features = body.get("features", [])
            for x in features:
                yield partition.value, json.dumps(x.get("attributes", {}))
            offset, full = offset + self.size, len(features) == self.size


class Bindings(DataSource):
    """Rows of a SPARQL query's result: (binding string of JSON). Options: ``url``, ``query``."""

    @classmethod
    def name(cls) -> str:
        return "cairn_bindings"

    def schema(self) -> str:
        return "binding string"

    def reader(self, schema) -> DataSourceReader:
        return BindingReader(self.options)


class BindingReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.query = options["url"], options["query"]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in get_json(self.url, {"query": self.query, "format": "json"}).get("results", {}).get("bindings", []):
            yield (json.dumps(row),)


class MediaFiles(DataSource):
    """Files of media categories: (category string, file string of JSON, one page of the service's answer each).

    Options: ``url``, ``categories`` (lines), ``per_category``, ``pause`` and ``backoff`` in seconds. One partition, as the
    service wants one request at a time; refused requests are repeated up to four times.
    """

    @classmethod
    def name(cls) -> str:
        return "cairn_media"

    def schema(self) -> str:
        return "category string, file string"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.categories = options["url"], options["categories"].splitlines()
        self.most = options.get("per_category", "3")
        self.pause, self.backoff = float(options.get("pause", 1.2)), float(options.get("backoff", 5.0))

    def ask(self, **params: str) -> dict:
        body = get_json(self.url, {"action": "query", "format": "json"} | params, retries=4, backoff=self.backoff)
        time.sleep(self.pause)
        return body.get("query", {})

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for category in self.categories:
            members = self.ask(list="categorymembers", cmtitle=f"Category:{category}", cmtype="file", cmlimit=self.most).get("categorymembers", [])
            if not members:
                continue
            titles = "|".join(m["title"] for m in members)
            pages = self.ask(titles=titles, prop="imageinfo", iiprop="url|extmetadata|mime|size|user", iiurlwidth="320").get("pages", {})
            for page in pages.values():
                if page.get("imageinfo"):
                    yield category, json.dumps(page)


def register(spark: SparkSession) -> None:
    for source in (PagedLayers, Bindings, MediaFiles):
        spark.dataSource.register(source)


def register_entries(features: DataFrame) -> DataFrame:
    """(layer, entry, name, attributes) of features with (layer, attributes), without those that lack a whole-numbered entry or a name."""
    at = lambda k: F.get_json_object("attributes", f"$.{k}")
    return features.filter(at("ListEntry").rlike(r"^\d+$") & (F.trim(at("Name")) != "")).select("layer", at("ListEntry").cast("long").alias("entry"), F.trim(at("Name")).alias("name"), "attributes")


#: Fields of a binding of which the first or last value counts, and those whose distinct values are kept.
FIRST = {"itemLabel": "label", "inception": "inception", "website": "website", "commons": "commons", "modified": "modified"}
LAST = {"lat": "lat", "lon": "lon", "geoPrecision": "precision"}
EVERY = {"nhleId": "register_ids", "instanceOfLabel": "instance_of", "architectLabel": "architects", "heritageLabel": "designations"}


def collapse_bindings(bindings: DataFrame, order: str | None = None) -> DataFrame:
    """One item for each qid of bindings (binding JSON): first and last values in order, and sets of the others, sorted.

    Without an order column the text of the binding orders rows, so the result doesn't depend on partitions.
    """
    at = lambda k: F.get_json_object("binding", f"$.{k}.value")
    rows = bindings.select(F.element_at(F.split(at("item"), "/"), -1).alias("qid"), F.struct(*([F.col(order)] if order else []), "binding").alias("o"), *[at(k).alias(v) for k, v in (FIRST | LAST | EVERY).items()])
    pick = lambda f, v: f(v, F.when(F.col(v).isNotNull(), F.col("o"))).alias(v)
    items = rows.filter(F.coalesce("qid", F.lit("")) != "").groupBy("qid").agg(
        *[pick(F.min_by, v) for v in FIRST.values()], *[pick(F.max_by, v) for v in LAST.values()], *[F.sort_array(F.collect_set(F.nullif(v, F.lit("")))).alias(v) for v in EVERY.values()]
    )
    return items.withColumns({v: F.col(v).cast("double") for v in LAST.values()})


def named_items(items: DataFrame) -> DataFrame:
    """Items with a proper qid and a label, as (source_id, source_record_id, name, lng, lat, modified)."""
    kept = items.filter(F.col("qid").rlike(r"^Q\d+$") & (F.trim(F.coalesce("label", F.lit(""))) != ""))
    return kept.select(F.lit("wikidata").alias("source_id"), F.col("qid").alias("source_record_id"), F.trim("label").alias("name"), F.col("lon").alias("lng"), "lat", F.col("modified").cast("timestamp").alias("modified"))


def media_records(files: DataFrame) -> DataFrame:
    """Raw media fields of (category, file JSON): no rights decision is taken here."""
    at = lambda k: F.get_json_object("file", f"$.{k}")
    info = lambda k: at(f"imageinfo[0].{k}")
    meta = lambda k: info(f"extmetadata.{k}.value")
    return files.select(
        at("title").alias("source_file_id"), F.regexp_replace(at("title"), "^File:", "").alias("title"), info("descriptionurl").alias("page_url"), info("url").alias("media_url"), info("thumburl").alias("thumbnail_url"),
        info("mime").alias("mime"), info("width").cast("int").alias("width"), info("height").cast("int").alias("height"), meta("Artist").alias("artist"), meta("LicenseShortName").alias("licence_short"),
        meta("LicenseUrl").alias("licence_url"), meta("Credit").alias("credit"), meta("UsageTerms").alias("usage_terms"), info("user").alias("uploader"), F.col("category").alias("via_category"),
    ).filter("source_file_id is not null")

"""Remote sources against a small local service, the common contract, and the link state."""

from __future__ import annotations

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from cairn.operators.requests import DiscoveryState, comma_list
from cairn.sources import SOURCES, remote

from .conftest import SMALL

ENTRIES = [{"ListEntry": 1000 + i, "Name": f"Hall {i}"} for i in range(25)] + [{"ListEntry": 7.5, "Name": "half"}, {"ListEntry": 9, "Name": " "}]
BINDINGS = [
    {"item": {"value": "http://w/Q1"}, "itemLabel": {"value": "One"}, "lat": {"value": "53.5"}, "lon": {"value": "-1.5"}, "nhleId": {"value": "10"}},
    {"item": {"value": "http://w/Q1"}, "itemLabel": {"value": "One"}, "nhleId": {"value": "9"}, "architectLabel": {"value": "Ann"}},
    {"item": {"value": "http://w/Q2"}}, {"item": {"value": "http://w/P3"}, "itemLabel": {"value": "not an item"}},
]


class Service(BaseHTTPRequestHandler):
    asked: list[dict] = []
    refusals = 2

    def log_message(self, *args):
        pass

    def do_GET(self):
        path, _, query = self.path.partition("?")
        q = dict(urllib.parse.parse_qsl(query))
        Service.asked.append(q)
        status, body = 200, {}
        if path == "/0/query":
            at, n = int(q["resultOffset"]), int(q["resultRecordCount"])
            body = {"features": [{"attributes": x} for x in ENTRIES[at : at + n]]}
        elif path == "/6/query":
            body = {"error": {"message": "no such layer"}}
        elif path == "/sparql":
            body = {"results": {"bindings": BINDINGS}}
        elif path == "/media" and Service.refusals:
            Service.refusals -= 1
            status = 429
        elif path == "/media" and q.get("list"):
            body = {"query": {"categorymembers": [{"title": "File:A.jpg"}] if "Halls" in q["cmtitle"] else []}}
        elif path == "/media":
            info = {"url": "u", "descriptionurl": "d", "mime": "image/jpeg", "width": 3, "height": 4, "user": "me", "extmetadata": {"LicenseShortName": {"value": "CC0"}}}
            body = {"query": {"pages": {"1": {"title": q["titles"], "imageinfo": [info]}, "2": {"title": "File:gone.jpg"}}}}
        else:
            status = 404
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())


@pytest.fixture(scope="module")
def url(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    remote.register(spark)
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_paged_layers(spark, url):
    read = spark.read.format("cairn_layers").option("url", url).option("page_size", "10")
    rows = remote.register_entries(read.option("layers", "0").option("box", "1,2,3,4").load()).collect()
    assert sorted(r.entry for r in rows) == list(range(1000, 1025)) and {r.layer for r in rows} == {0}
    assert {q["resultOffset"] for q in Service.asked} == {"0", "10", "20"} and json.loads(Service.asked[0]["geometry"])["xmax"] == 3
    with pytest.raises(Exception, match="no such layer"):
        read.option("layers", "6").load().collect()
    with pytest.raises(Exception, match="HTTP 404"):
        read.option("layers", "8").load().collect()


def test_bindings(spark, url):
    items = remote.collapse_bindings(spark.read.format("cairn_bindings").option("url", f"{url}/sparql").option("query", "SELECT *").load())
    one = {r.qid: r for r in items.collect()}["Q1"]
    assert (one.label, one.lat, one.lon, one.register_ids, one.architects, one.instance_of) == ("One", 53.5, -1.5, ["10", "9"], ["Ann"], [])
    assert [(r.source_record_id, r.name, r.lng) for r in remote.named_items(items).collect()] == [("Q1", "One", -1.5)]


def test_media(spark, url):
    files = spark.read.format("cairn_media").option("url", f"{url}/media").option("categories", "Empty\nHalls").option("pause", "0").option("backoff", "0.01").load()
    (row,) = remote.media_records(files).collect()
    assert (row.source_file_id, row.title, row.licence_short, row.width, row.artist, row.via_category) == ("File:A.jpg", "A.jpg", "CC0", 3, None, "Halls")


def test_contract(spark):
    for reader in SOURCES.values():
        df = reader(spark, {"dir": SMALL})
        assert [f.name for f in df.schema] == ["source_id", "source_record_id", "name", "lng", "lat", "modified"]
    box = SOURCES["customers"](spark, {"dir": SMALL, "box": (-2.0, 53.5, -1.0, 54.0)}).collect()
    assert box and all(-2 <= r.lng <= -1 and 53.5 <= r.lat <= 54 for r in box)
    assert SOURCES["customers"](spark, {"dir": SMALL, "since": "2024-01-01"}).count() == 0


def test_link_state():
    assert comma_list("a, b,,") == ["a", "b"] and comma_list("") is None and comma_list(None) is None
    assert DiscoveryState.parse("", ("roman",)) == DiscoveryState()
    state = DiscoveryState.parse("?lng=-1.25&lat=x&z=12&q=hall&period=roman&from=0&to=-43&mode=sacred&types=church,abbey&image=1&place=p", ("roman",))
    assert state == DiscoveryState(-1.25, 53.96, 12.0, "hall", "roman", None, -43, "sacred", ["church", "abbey"], True, "p")
    assert DiscoveryState.parse(state.query(), ("roman",)) == state and DiscoveryState.parse("period=jurassic&mode=odd", ("roman",)) == DiscoveryState()
    assert DiscoveryState().query() == "lng=-1.5500&lat=53.9600&z=8.0"

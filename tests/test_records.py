"""The paged register source: parallel pages, filters in the requests, and a stream of edits."""

from __future__ import annotations

import json
import re
import tempfile
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from cairn.sources import records

LAYERS = {0: [{"ListEntry": 1000 + i, "Easting": 400_000 + 10 * i, "Northing": 430_000 - i, "Edited": 1_600_000_000_000 + 1000 * i} for i in range(57)], 6: [{"ListEntry": 5, "Easting": None, "Northing": "x", "Edited": None}], 9: []}


class Register(BaseHTTPRequestHandler):
    asked: list[dict] = []

    def log_message(self, *args):
        pass

    def do_GET(self):
        path, _, query = self.path.partition("?")
        q = dict(urllib.parse.parse_qsl(query)) | {"layer": path.split("/")[1]}
        Register.asked.append(q)
        rows = LAYERS[int(q["layer"])]
        if "geometry" in q:
            box = json.loads(q["geometry"])
            rows = [r for r in rows if isinstance(r["Easting"], int) and box["xmin"] <= r["Easting"] <= box["xmax"] and box["ymin"] <= r["Northing"] <= box["ymax"]]
        for sign, n in re.findall(r"Edited (>|<=) (-?\d+)", q["where"]):
            rows = [r for r in rows if r["Edited"] is not None and (r["Edited"] > int(n) if sign == ">" else r["Edited"] <= int(n))]
        if q.get("returnCountOnly"):
            body = {"count": len(rows)}
        else:
            if q["orderByFields"] == "Edited DESC":
                rows = sorted(rows, key=lambda r: -(r["Edited"] or 0))
            a, n = int(q["resultOffset"]), int(q["resultRecordCount"])
            body = {"features": [{"attributes": r} for r in rows[a : a + n]]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())


@pytest.fixture(scope="module")
def options(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Register)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    records.register(spark)
    yield {"url": f"http://127.0.0.1:{server.server_port}", "layers": "0,6,9", "page_size": "5", "pages_a_task": "2"}
    server.shutdown()


def test_pages_are_read_by_many_tasks(spark, options):
    df = spark.read.format("cairn_records").options(**options).load()
    assert df.rdd.getNumPartitions() == 6 + 1 + 1
    rows = df.collect()
    assert sorted(r.entry for r in rows if r.layer == 0) == [1000 + i for i in range(57)]
    assert [(r.entry, r.easting, r.northing, r.edited) for r in rows if r.layer == 6] == [(5, None, None, None)]


def test_filters_reach_the_service_and_spark_keeps_the_rest(spark, options):
    Register.asked.clear()
    df = spark.read.format("cairn_records").options(**options).load()
    got = df.filter("layer = 0 AND easting >= 400100 AND easting < 400200 AND edited >= timestamp'2020-09-13 12:26:52Z' AND length(attributes) > 0").collect()
    assert sorted(r.entry for r in got) == list(range(1012, 1020))
    pages = [q for q in Register.asked if "resultOffset" in q]
    assert pages and all(q["layer"] == "0" and json.loads(q["geometry"])["xmin"] == 400100.0 and q["where"] == "Edited > 1600000011999" for q in pages)
    assert len(pages) <= 4
    assert df.filter("easting > 500 AND easting < 400").count() == 0


def test_a_stream_of_edits(spark, options):
    """Each batch has the records edited since the one before; an edited record comes again, others don't."""
    root, seen = tempfile.mkdtemp(prefix="spark-records-"), []

    def run():
        stream = spark.readStream.format("cairn_records").options(**options | {"layers": "0"}).load()
        out = stream.select("entry", "edited").writeStream.foreachBatch(lambda df, n: seen.append(sorted(r.entry for r in df.collect())))
        out.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    assert sum(seen, []) == [1000 + i for i in range(57)]
    seen.clear()
    run()
    assert sum(seen, []) == []
    LAYERS[0][3]["Edited"] = 1_700_000_000_000
    try:
        run()
    finally:
        LAYERS[0][3]["Edited"] = 1_600_000_003_000
    assert sum(seen, []) == [1003]

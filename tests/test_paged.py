"""Paged services over a local page server: partitions by offset, retries, streams that resume from their cursor."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from geoloom.sources import paged


class Service:
    """Objects 0..n-1 by offset or by cursor; it counts requests and can be busy, slow to give, or wrong."""

    def __init__(self, n=2500, gives=1000):
        self.n, self.gives, self.asked, self.busy, self.wrong = n, gives, [], {}, None
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
                cursor = self.headers.get("CMR-Search-After")
                service.asked.append(cursor if "umm" in self.path else q.get("resultOffset", "count"))
                if service.busy.get(service.asked[-1], 0) > 0:
                    service.busy[service.asked[-1]] -= 1
                    self.send_response(503)
                    self.send_header("Retry-After", "0")
                    self.end_headers()
                    return
                headers = {}
                if "umm" in self.path:
                    at, size = int(cursor or 0), int(q["page_size"])
                    body = {"hits": service.n, "items": [{"id": k} for k in range(at, min(service.n, at + size))]}
                    if at + size < service.n:
                        headers["CMR-Search-After"] = str(at + size)
                elif "returnCountOnly" in q:
                    body = {"count": service.n}
                elif service.wrong == q["resultOffset"]:
                    body = {"error": {"message": "no such field"}}
                else:
                    at = int(q["resultOffset"])
                    end = min(service.n, at + min(service.gives, int(q["resultRecordCount"])))
                    body = {"features": [{"attributes": {"OBJECTID": k % 2400, "name": f"é{k}"}} for k in range(at, end)]}
                self.send_response(200)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def options(s, **more):
    return {"url": f"{s.url}/query?resultOffset={{offset}}&resultRecordCount={{page}}", "count_url": f"{s.url}/query?returnCountOnly=true", "pause": "0", **more}


def test_offset_pages_are_partitions(spark, service):
    paged.register(spark)
    df = spark.read.format("offset_pages").options(**options(service)).load()
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    assert sorted(r.start for r in rows) == list(range(2500)) and json.loads(rows[0].value).keys() == {"OBJECTID", "name"}
    assert {"0", "1000", "2000"} <= set(service.asked)
    held = spark.read.format("offset_pages").options(**options(service, at_once="2", page="100")).load()
    assert held.rdd.getNumPartitions() == 2 and held.count() == 2500


def test_offset_pages_of_a_service_that_gives_less(spark, service):
    """A server whose own page is shorter is asked on; of a repeated object the first stays; busy answers are retried."""
    service.gives, service.busy = 300, {"1000": 2, "count": 1}
    got = paged.objects(spark, schema="OBJECTID long, name string", key="OBJECTID", **options(service))
    rows = {r.OBJECTID: r.name for r in got.collect()}
    assert rows == {k: f"é{k}" for k in range(2400)} and service.asked.count("1000") >= 3
    service.n = 0
    assert paged.objects(spark, schema="OBJECTID long, name string", key="OBJECTID", **options(service)).count() == 0


def test_offset_pages_fail_loudly(spark, service):
    service.wrong = "1000"
    with pytest.raises(Exception, match="no such field"):
        spark.read.format("offset_pages").options(**options(service)).load().count()
    service.wrong, service.busy = None, {"2000": 50}
    with pytest.raises(Exception, match="HTTP 503"):
        spark.read.format("offset_pages").options(**options(service)).load().count()


def run(spark, kind, o, folder):
    df = spark.readStream.format(kind).options(**o).load()
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").start()
    return q


def test_offset_stream_reads_what_is_new(spark, service, tmp_path):
    paged.register(spark)
    for n in (1200, 2500, 2500):
        service.n, service.asked = n, []
        q = run(spark, "offset_pages", options(service), tmp_path)
        q.processAllAvailable()
        q.stop()
    assert set(service.asked) == {"count"}  # the last run found nothing new
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.start for r in rows) == list(range(2500))


def test_cursor_stream_resumes_from_its_cursor(spark, service, tmp_path):
    paged.register(spark)
    service.n = 1050
    o = {"url": f"{service.url}/umm?page_size={{page}}", "page": "100", "rows": "items", "row": "", "most": "-1", "pause": "0"}
    service.busy = {"400": 4}  # fails for good at the fifth page
    q = run(spark, "cursor_pages", o, tmp_path)
    with pytest.raises(Exception, match="HTTP 503"):
        q.processAllAvailable()
    q.stop()
    before = len(service.asked)
    service.busy = {}
    q = run(spark, "cursor_pages", o, tmp_path)
    q.processAllAvailable()
    q.stop()
    again = service.asked[before:]
    assert None not in again and "100" not in again and "1000" in again
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.start for r in rows) == list(range(1050)) and {json.loads(r.value)["id"] for r in rows} == set(range(1050))


def test_cursor_stream_ends_at_the_most(spark, service, tmp_path):
    paged.register(spark)
    o = {"url": f"{service.url}/umm?page_size={{page}}", "page": "100", "rows": "items", "row": "", "most": "250", "pause": "0"}
    q = run(spark, "cursor_pages", o, tmp_path)
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 250 and len(service.asked) == 3


def test_pages_in_folders(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"page={k * 10}").mkdir()
        (tmp_path / f"page={k * 10}" / "part-0").write_text(json.dumps({"features": [{"id": i} for i in range(k * 10, min(25, k * 10 + 10))]}))
    got = paged.objects(spark, f"file://{tmp_path}/page={{offset}}", "id long", "id", count=25, page=10)
    assert sorted(r.id for r in got.collect()) == list(range(25))

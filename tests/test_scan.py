"""Conditional scans of a table of sources against a server of this machine."""

import hashlib
import threading
import time
from collections import defaultdict
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quillspark.sources import web

SOURCES, EVIDENCE = "source_id string, url string", "source_id string, fetched_at timestamp, content_hash string, etag string, last_modified string"


@pytest.fixture(scope="module")
def server():
    asked = defaultdict(list)

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path].append((time.monotonic(), self.headers.get("If-None-Match"), self.headers.get("If-Modified-Since")))
            code, kind, body, tag = 200, "text/html; charset=utf-8", f"<p>{self.path}</p>".encode(), f'"{self.path}"'
            if self.path.startswith("/same") and self.headers.get("If-None-Match") == tag:
                code, body = 304, b""
            elif self.path == "/flaky" and len(asked[self.path]) == 1:
                code = 503
            elif self.path == "/gone":
                code = 404
            elif self.path == "/image":
                kind = "image/png"
            self.send_response(code)
            for k, v in (("Content-Type", kind), ("ETag", tag), ("Last-Modified", "Thu, 01 Oct 2026 00:00:00 GMT"), ("Content-Length", str(len(body) if code != 304 else 0))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body if code != 304 else b"")

        def log_message(self, *args):
            pass

    site = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{site.server_address[1]}", asked
    site.shutdown()


def test_scan(spark, server, tmp_path):
    base, asked = server
    paths = ["/new", "/same", "/same-lost", "/other", "/flaky", "/gone", "/image"]
    sources = [(p, base + p) for p in paths] + [("/nohost", "http://127.0.0.1:1/x"), ("/broken", "no url"), ("/null", None)]
    old, older = datetime(2026, 10, 2), datetime(2026, 10, 1)
    evidence = [
        ("/same", older, "h0", '"stale"', None), ("/same", old, "h1", '"/same"', "Thu, 01 Oct 2026 00:00:00 GMT"), ("/other", old, "h2", '"x"', None), ("/gone", old, "h3", None, None),
        ("/nohost", old, "h4", None, None),
    ]
    known = spark.createDataFrame(evidence, EVIDENCE)
    fetched = web.scan(spark.createDataFrame(sources, SOURCES).repartition(3), known, spacing=0.2, backoff=0.01)
    fetched.write.parquet(f"{tmp_path}/fetched")
    fetched = spark.read.parquet(f"{tmp_path}/fetched")
    got = {r.source_id: r for r in web.outcomes(fetched, known).collect()}
    sha = lambda p: hashlib.sha256(f"<p>{p}</p>".encode()).hexdigest()
    assert {k: (r.status, r.last_good) for k, r in got.items()} == {
        "/new": ("FETCHED", sha("/new")), "/same": ("UNCHANGED", "h1"), "/same-lost": ("FETCHED", sha("/same-lost")), "/other": ("CHANGED", sha("/other")), "/flaky": ("FETCHED", sha("/flaky")),
        "/gone": ("FAILED", "h3"), "/image": ("FAILED", None), "/nohost": ("FAILED", "h4"), "/broken": ("FAILED", None), "/null": ("FAILED", None),
    }
    assert got["/same"].http_status == 304 and got["/same"].body is None and bytes(got["/new"].body) == b"<p>/new</p>" and got["/new"].etag == '"/new"'
    assert got["/gone"].error == "status 404" and got["/image"].error == "content type image/png"
    assert asked["/same"] == [(asked["/same"][0][0], '"/same"', "Thu, 01 Oct 2026 00:00:00 GMT")] and asked["/new"][0][1:] == (None, None)
    assert len(asked["/flaky"]) == 2
    times = sorted(t for calls in asked.values() for t, *_ in calls)
    assert times[-1] - times[0] > 0.19 * (len(times) - 1)  # one host, one request at a time


def test_outcomes_by_hand(spark):
    known = spark.createDataFrame([("a", datetime(2026, 1, 1), "x", None, None), ("a", datetime(2026, 1, 2), "y", None, None)], EVIDENCE)
    rows = [("a", 200, "y", None), ("a", 200, "x", None), ("a", 200, "z", None), ("a", 304, None, None), ("a", 500, None, "status 500"), ("b", 304, None, None), ("b", 200, "x", None), (None, 200, "x", None), ("a", None, None, None)]
    got = [(r.status, r.last_good) for r in web.outcomes(spark.createDataFrame(rows, "source_id string, http_status int, content_hash string, error string").coalesce(1), known).orderBy("source_id", "http_status", "content_hash").collect()]
    assert sorted(got, key=str) == sorted(
        [("UNCHANGED", "y"), ("UNCHANGED", "x"), ("CHANGED", "z"), ("UNCHANGED", "y"), ("FAILED", "y"), ("FAILED", None), ("FETCHED", "x"), ("FETCHED", "x"), ("FAILED", "y")], key=str
    )

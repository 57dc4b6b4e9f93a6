from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillspark.operators import tables
from quillspark.sources import files, registry, web
from quillspark.streaming import state


def test_registry(spark):
    r = registry.registry(spark)
    assert registry.enabled(r).count() == 3 and registry.lookup(r, "source1")["enabled"]
    with pytest.raises(KeyError):
        registry.lookup(r, "nope")


def test_landed_files_and_row_sets(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"12345")
    (tmp_path / "a" / "big.bin").write_bytes(b"1" * 100)
    assert [bytes(r.content) for r in files.landed(spark, str(tmp_path / "a"), 50).collect()] == [b"12345"]
    (tmp_path / "r.json").write_text('[{"results": [{"id": "a"}, {"id": "b"}]}]')
    (tmp_path / "s.json").write_text('{"results": [{"id": "c"}]}')
    assert sorted(r.id for f in ("r", "s") for r in files.row_sets(spark, str(tmp_path / f"{f}.json"), "id: string").collect()) == ["a", "b", "c"]


def test_types(spark):
    df = spark.createDataFrame([("Text/HTML; charset=utf-8",), (" application/pdf ",), ("text/plain",), ("image/png",), (None,)], "t string")
    got = df.select(files.dispatch(F.col("t")).alias("k"), files.accepted(F.col("t"), ["text/html"]).alias("ok")).collect()
    assert [r.k for r in got] == ["html", "pdf", "text", None, None] and [r.ok for r in got] == [True, False, False, False, False]


def test_text_and_paged_documents(spark):
    df = spark.createDataFrame([("a", bytearray(b"ok \xff")), ("b", bytearray(b" "))], "path string, content binary")
    assert [r.quality.level for r in files.text_documents(df).collect()] == ["MEDIUM", "FAILED"]

    def broken(raw):
        raise OSError

    pages = lambda raw: ["page one"] if raw != b" " else []
    longer = lambda raw: ["page one is longer", "two"]
    got = files.page_documents(df, pages, longer).orderBy("path").collect()
    assert got[0].page_count == 2 and got[0].warnings == ["check found more text"]
    got = files.page_documents(df, broken, ocr=lambda raw: ["seen by eye, in full"]).collect()
    assert all(r.body_text == "seen by eye, in full" and r.warnings == ["primary failed: OSError"] for r in got)


def test_robots_and_sitemaps(spark):
    df = spark.createDataFrame([("https://a/x", "User-agent: *\nDisallow: /x"), ("https://a/y", "User-agent: *\nDisallow: /x"), ("https://a/z", None), (None, "")], "url string, robots_text string")
    assert [r.url for r in web.allowed_by_robots(df, "bot").collect()] == ["https://a/y"]
    xml = "<u:urlset xmlns:u='x'><u:url><u:loc>https://a/1</u:loc></u:url><url><loc> https://a/1 </loc></url><url><loc>ftp://a/2</loc></url></u:urlset>"
    assert spark.range(1).select(web.sitemap_urls(F.lit(xml)).alias("u")).first().u == ["https://a/1"]


LINES = [
    "User-agent: *", "user-agent : Bot", "User-Agent: other", "User-agent: bo", "Disallow: /x", "Disallow: /x/y?", "Allow: /x/y", "Disallow:", "Disallow: *", "allow: /%7Ea b",
    "Disallow: /%7ea%20b;", "", "", "   ", "# a note", "Crawl-delay: 3", "Request-rate: 1/5", "Sitemap: https://a/s.xml", "nonsense", "Disallow: /x # c", "Disallow: /a+b", "Allow: /100%", "Disallow: /é#",
]
PATHS = ["", "/", "/x", "/x/y", "/x/y?", "/x/y?q=1", "/x/y?#f", "/~a b", "/%7Ea%20b;", "/a+b", "/a b", "/100%", "/100%25", "/%C3%A9#", "/é/1", "/z;p?q#f"]


def test_robots_against_the_standard_parser(spark):
    import random
    from urllib.robotparser import RobotFileParser

    draw, rows = random.Random(5), []
    for _ in range(400):
        text = draw.choice(["\n", "\r\n", "\n"]).join(draw.choices(LINES, k=draw.randint(0, 14)))
        rows += [("https://A.b" + p, text) for p in draw.sample(PATHS, 5)]

    def allowed(url, text):
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        return parser.can_fetch("Bot/2.0 (x)", url)

    df = spark.createDataFrame(rows, "url string, robots_text string")
    got = sorted(map(tuple, web.allowed_by_robots(df, "Bot/2.0 (x)").collect()))
    want = sorted(r for r in rows if allowed(*r))
    assert got == want and 0 < len(got) < len(rows)


def test_robots_gate(spark):
    pages = spark.createDataFrame(
        [(1, "https://A.b/x", "s"), (2, "https://a.b/y", None), (3, "https://gone.b/y", "s"), (4, "https://never.b/", "s"), (5, None, "s"), (6, "no host", "s"), (7, "https://a.b/x", "s"), (1, "https://A.b/x", "s")],
        "id int, url string, site string",
    )
    robots = spark.createDataFrame(
        [("https://a.b", 200, "User-agent: *\nDisallow: /x"), ("https://a.b", 500, None), ("https://gone.b", 404, "User-agent: *\nAllow: /"), ("https://c.b", 200, None), (None, None, None)],
        "site string, status int, robots_text string",
    )
    got = web.robots_gate(pages, robots, "bot")
    assert got.columns == ["id", "url", "site", "robots_verdict"]
    want = [(1, "REFUSED"), (1, "REFUSED"), (2, "ALLOWED"), (3, "FAILED"), (4, "FAILED"), (5, "FAILED"), (6, "FAILED"), (7, "REFUSED")]
    assert sorted((r.id, r.robots_verdict) for r in got.collect()) == want
    assert "PythonUDF" not in (plan := got._jdf.queryExecution().toString()) and "MapInArrow" not in plan
    assert web.robots_gate(pages.limit(0), robots, "bot").count() == 0
    assert {r.robots_verdict for r in web.robots_gate(pages, robots.limit(0), "bot").collect()} == {"FAILED"}
    sent, web.SENT_RULES = web.SENT_RULES, -1
    try:
        assert sorted((r.id, r.robots_verdict) for r in web.robots_gate(pages, robots, "bot").collect()) == want
    finally:
        web.SENT_RULES = sent


def test_discovered_sources(spark):
    declared = registry.registry(spark, [("s", "S", "https://A.b/", False)])
    pages = spark.createDataFrame([("https://a.b/1",), ("https://c.d/1",), ("HTTPS://c.d/2",), ("https://e.f",), (None,), ("x",)], "url string")
    got = {r.id: (r.name, r.base_url, r.enabled) for r in registry.discovered(pages, declared, least=2).collect()}
    assert got == {"s": ("S", "https://A.b/", False), "https://c.d": ("c.d", "https://c.d/", True), "https://e.f": ("e.f", "https://e.f/", False)}


def test_health_counts_rows(spark, sf, tmp_path):
    spark.range(0).write.parquet(f"{tmp_path}/empty")
    found = lambda **t: {r.dependency: (r.ok, r.n_rows) for r in tables.health(spark, t).collect()}
    n = spark.read.parquet(f"{sf}/pages.parquet").count()
    assert found(pages=f"{sf}/pages.parquet") == {"pages": (True, n), "service": (True, n)}
    assert found(pages=f"{sf}/pages.parquet", empty=f"{tmp_path}/empty", none=f"{tmp_path}/none") == {"pages": (True, n), "empty": (False, 0), "none": (False, 0), "service": (False, 0)}


def test_fetching():
    slept, calls = [], []

    def transport(answers):
        def go(url, headers):
            calls.append(headers)
            a = answers.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

        return go

    fetch = lambda *answers, **k: web.Fetcher(transport(list(answers)), sleep=slept.append, clock=lambda: 0.0, **k).fetch("https://a/", "tag", "when")
    assert fetch(web.Response(503), OSError(), web.Response(200, {}, b"x")).body == b"x" and slept == [1.0, 2.0]
    assert calls[0] == {"If-None-Match": "tag", "If-Modified-Since": "when"}
    assert fetch(web.Response(429, {"Retry-After": "7"}), web.Response(304)).status == 304 and slept[-1] == 7.0
    assert fetch(*[web.Response(500)] * 3).status == 500
    with pytest.raises(ValueError):
        fetch(web.Response(200, {}, b"xx"), most_bytes=1)
    with pytest.raises(OSError):
        fetch(*[OSError()] * 3)
    assert web.retry_after("Thu, 01 Oct 2026 00:00:10 GMT", datetime(2026, 10, 1, tzinfo=timezone.utc)) == 10.0 and web.retry_after("soon") is None


def test_ledger_batches_run_again(spark, tmp_path):
    sink = state.ledger_sink(f"file://{tmp_path}/ledger")
    rows = lambda *r: spark.createDataFrame([(i, datetime(2026, 1, 1), 1, "i", "R", k, s) for i, (k, s) in enumerate(r)], "event_id int, ts timestamp_ntz, user_id int, item_id string, kind string, key string, status string")
    sink(rows(("a", "SENT"), ("b", "FAILED")), 0)
    for _ in range(2):  # the second time is a retry
        sink(rows(("a", "PENDING"), ("b", "PENDING"), ("c", "SENT")), 1)
    got = sorted((r.key, r.status, r.batch) for r in spark.read.parquet(f"file://{tmp_path}/ledger").collect())
    assert got == [("a", "SENT", 0), ("b", "FAILED", 0), ("b", "PENDING", 1), ("c", "SENT", 1)]


def test_claim_states_against_the_table(spark, tmp_path):
    moves = [("c", 1, "VERIFIED"), ("c", 2, "UNVERIFIED"), ("c", 3, "EXPIRED"), ("c", 4, "SUPERSEDED"), ("d", 1, "EXPIRED")]
    spark.createDataFrame([(c, datetime(2026, 1, d), s) for c, d, s in moves], "claim_id string, ts timestamp, next_state string").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = state.drain(state.claim_states(state.table_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = [(r.claim_id, r.state, r.accepted) for r in out.orderBy("claim_id", "ts").collect()]
    assert got == [("c", "VERIFIED", True), ("c", "VERIFIED", False), ("c", "EXPIRED", True), ("c", "EXPIRED", False), ("d", "UNVERIFIED", False)]

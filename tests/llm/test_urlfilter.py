from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from quillspark.llm import urlfilter as u
from quillspark.llm.queries import ORACLE_SQL, URL_RULES, op3_url_filter, table


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    return host, tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]


def brute(urls, rules, edges):
    """{url: (rule, verdict)} by walking the alias graph."""
    near = defaultdict(set)
    for a, b in edges:
        if a and b:
            near[a.split("#")[0]].add(b.split("#")[0])
            near[b.split("#")[0]].add(a.split("#")[0])

    def own(url):
        host, path = split(url)
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        return max(fit, key=lambda r: (len(r[0] + r[1]), r[2] == "allow"), default=None)

    out = {}
    for url in urls:
        seen, todo = set(), [url.split("#")[0]] if url else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        said = {r[2] for x in seen if (r := own(x))}
        r = own(url)
        out[url] = (r[0] + r[1] if r else None, r[2] if r else "allow" if "allow" in said or not said else "block")
    return out


def test_query_against_brute_force_and_sql(spark, sf):
    pages = table(spark, sf, "pages").collect()
    want = brute([p.url for p in pages], URL_RULES, [])
    got = op3_url_filter(spark, sf).collect()
    assert all((r.host, r.path) == split(p.url) and (r.rule, r.verdict) == want[p.url] for r, p in zip(sorted(got), sorted(pages)))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    sql = con.execute(ORACLE_SQL["op3_url_filter"]).fetchall()
    assert sorted(map(str, sql)) == sorted(str(tuple(r)) for r in got)


def test_no_python_in_the_plan(spark, sf):
    plan = op3_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


URLS = [
    "http://a.bad.com/en/1", "http://mirror.io/x", "http://hop.io/1#frag", "https://good.example.com/en/77", "https://copy.io/77", "HTTP://BAD.com/EN/", "http://bad.com?en", "no-scheme.com/en/", "", None,
    "http://x.net/de/8", "http://both.io/", "http://fine.org/es/1", "http://lone.io/", "x://y://z/en/",
]
EDGES = [
    ("http://mirror.io/x", "http://hop.io/1"), ("http://hop.io/1", "http://a.bad.com/en/1#z"), ("https://copy.io/77", "https://good.example.com/en/77"), ("http://both.io/", "http://a.bad.com/en/1"),
    ("http://both.io/", "https://good.example.com/en/77"), (None, "http://lone.io/"), ("http://lone.io/", None), ("http://gone.io/1", "http://x.net/de/8"),
]


def test_aliases(spark):
    pages = spark.createDataFrame([(i, x, None, "v") for i, x in enumerate(URLS)] + [(None, URLS[1], None, "v")], "page_id bigint, url string, html string, verdict string")
    edges = spark.createDataFrame(EDGES, "a string, b string")
    want = brute(URLS, URL_RULES, EDGES)
    assert want["http://both.io/"][1] == "allow" and want["http://mirror.io/x"][1] == "allow"  # one component, and an explicit allow in it
    want2 = brute(URLS, URL_RULES, EDGES[:3])
    assert want2["http://mirror.io/x"][1] == "block" and want2["https://copy.io/77"][1] == "allow"
    frame = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    for rules in (URL_RULES, frame):
        for e, w in ((edges, want), (edges.limit(3), want2)):
            got = u.judge(pages, rules, e).collect()
            assert len(got) == len(URLS) + 1
            for r in got:
                assert (r.rule, r.verdict) == w[r.url], r


def test_links_of_pages(spark):
    rows = [
        ("http://a.io/p/q?x#f", '<head><LINK href="/canon" rel=canonical></head>'), ("http://b.io/p", "<link rel='canonical' href='//c.io/z#y'>"), ("http://d.io/dir/page", '<meta http-equiv="refresh" content="0; url=other">'),
        ("http://e.io/", '<link rel="canonical" href="http://e.io/">'), ("http://f.io/", None), (None, '<link rel="canonical" href="http://e.io/">'), ("http://g.io/", '<link rel="stylesheet" href="canonical.css">'),
    ]
    got = {tuple(r) for r in u.page_links(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {("http://a.io/p/q?x", "http://a.io/canon"), ("http://b.io/p", "http://c.io/z"), ("http://d.io/dir/page", "http://d.io/dir/other")}


def test_pages_that_state_links(spark, tmp_path):
    rows = [(1, "http://a.com/en/1", "x"), (2, "http://b.io/1", '<link rel="canonical" href="http://a.com/en/1">'), (3, "http://b.io/2", '<link rel="canonical" href="http://b.io/1">'), (4, "http://c.io", "")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in op3_url_filter(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"} == {r[0]: r[4] for r in con.execute(ORACLE_SQL["op3_url_filter"]).fetchall()}


def test_empty_table(spark):
    assert u.judge(spark.createDataFrame([], "page_id bigint, url string, html string"), URL_RULES).count() == 0


def test_many_rules(spark):
    rules = [(f"h{i % 7}.io", f"/p{i}", "block" if i % 2 else "allow") for i in range(300)]
    pages = spark.createDataFrame([(i, f"http://w.h{i % 9}.io/p{i}/x") for i in range(400)], "page_id bigint, url string").withColumn("html", F.lit(""))
    want = brute([f"http://w.h{i % 9}.io/p{i}/x" for i in range(400)], rules, [])
    assert all((r.rule, r.verdict) == want[r.url] for r in u.judge(pages, rules).collect())


def test_ties_are_the_same_inline_and_joined(spark):
    rules = [("b.com", "/x", "block"), ("com", "/x/yz", "block"), ("c.com", "/x", "block"), ("com", "/x/yy", "allow")]
    pages = spark.createDataFrame([(1, "http://a.b.com/x/yz"), (2, "http://a.c.com/x/yy"), (3, "http://b.com/x/yy")], "page_id bigint, url string").withColumn("html", F.lit(""))
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    inline, joined = ({r.page_id: (r.rule, r.verdict) for r in u.judge(pages, x).collect()} for x in (rules, frame))
    assert inline == joined

"""Web policy and fetching: robots rules, sitemaps, conditional requests, scans of a table of sources."""

from __future__ import annotations

import hashlib
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from http.client import HTTPException

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

RETRIED = (408, 425, 429, 500, 502, 503, 504)


#: Bytes of rules that go to every task; more meet the pages in a shuffle.
SENT_RULES = 8 << 20


def _unquoted(value: Column) -> Column:
    """Percent escapes decoded; a percent sign that starts none stays, as does a plus sign."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B"))


def _tidy(path: Column) -> Column:
    """A path without empty parameters, query or fragment."""
    for empty in (r"^((?:[^?#]*/)?[^;/?#]*);(?=[?#]|$)", r"^([^?#]*)\?(?=#|$)", r"^([^#]*)#$"):
        path = F.regexp_replace(path, empty, "$1")
    return path


def site_of(url: Column) -> Column:
    """Scheme and host of a url, in lower case: whose robots text counts. Empty if there is no host."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", 0))


def robots_target(url: Column) -> Column:
    """What robots rules are held against: the decoded url from its path on, ``/`` if nothing is left."""
    rest = _tidy(F.regexp_replace(_unquoted(url), r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?", ""))
    return F.when(rest == "", "/").otherwise(rest)


def robots_rules(texts: DataFrame, agent: str, robots: str = "robots_text") -> DataFrame:
    """(robots_text, rules) for every different text; rules is the array of (allow, path), in their order, of the group
    that ``agent`` has to follow: the first whose names occur in its own, else the first for all (``*``).

    A text's lines are rows, and a group starts behind a blank line, or with a name that follows a rule. Groups without
    a name or without a rule don't count; comments and unknown keys are skipped. A text has one window of its lines.
    """
    me = agent.split("/")[0].lower()
    each = texts.select(F.col(robots).alias("robots_text")).filter("robots_text is not null").distinct()
    lines = each.select("robots_text", F.posexplode(F.split("robots_text", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")).alias("pos", "line"))
    body = F.trim(F.regexp_replace("line", r"(?s)#.*$", ""))
    parts = lines.select(
        "robots_text", "pos", (F.col("line") == "").alias("blank"), F.lower(F.regexp_extract(body, r"(?s)^([^:]*?)\s*:", 1)).alias("key"),
        _unquoted(F.regexp_extract(body, r"(?s)^[^:]*:\s*(.*)$", 1)).alias("value"),
    )
    known = parts.filter(F.col("blank") | F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay", "request-rate"))
    order = Window.partitionBy("robots_text").orderBy("pos")
    named = F.col("key") == "user-agent"
    starts = F.col("blank") | (named & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent"))
    known = known.withColumn("starts", starts.cast("int")).withColumn("group", F.sum("starts").over(order)).filter("not blank")
    rule = F.when(F.col("key").isin("allow", "disallow"), F.struct("pos", ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"), _tidy(F.col("value")).alias("path")))
    mine = named & (F.col("value") != "*") & F.lit(me).contains(F.lower("value"))
    groups = known.groupBy("robots_text", "group").agg(
        F.max(named & (F.col("value") == "*")).alias("for_all"), F.max(mine).alias("for_me"), F.max(~named).alias("ruled"), F.sort_array(F.collect_list(rule)).alias("rules")
    )
    groups = groups.filter("ruled and (for_all or for_me)")
    chosen = groups.groupBy("robots_text").agg(F.min_by("rules", F.struct("for_all", "group")).alias("rules"))
    found = each.join(chosen, "robots_text", "left")
    none = F.array().cast("array<struct<allow:boolean,path:string>>")
    return found.select("robots_text", F.coalesce(F.transform("rules", lambda r: F.struct(r["allow"].alias("allow"), r["path"].alias("path"))), none).alias("rules"))


def _followed(rules: Column, target: Column) -> Column:
    """The first rule whose path the page's begins with decides, wildcards meaning themselves; without one a page may be
    fetched."""
    first = F.get(F.filter(rules, lambda r: target.startswith(r["path"])), F.lit(0))
    return F.coalesce(first["allow"], F.lit(True))


def _meet(pages: DataFrame, rules: DataFrame, on: Column) -> DataFrame:
    """A left join that sends the rules to every task while they are small, so that no site's pages have to meet."""
    size = rules.agg(F.sum(F.length(F.to_json("rules")) + F.length(rules.columns[0]) + 64)).first()[0] or 0
    return pages.join(F.broadcast(rules) if size <= SENT_RULES else rules, on, "left")


def allowed_by_robots(pages: DataFrame, agent: str, url: str = "url", robots: str = "robots_text") -> DataFrame:
    """``pages`` that their site's robots text lets ``agent`` fetch; a null text stands for a failed request: refused."""
    rules = robots_rules(pages, agent, robots).toDF("__text", "__rules").withColumnRenamed("__rules", "rules")
    met = _meet(pages.select(F.struct("*").alias("__page")), rules, F.col(f"__page.`{robots}`") == F.col("__text"))
    may = F.col(f"__page.`{url}`").isNotNull() & F.col("__text").isNotNull() & _followed(F.col("rules"), robots_target(F.col(f"__page.`{url}`")))
    return met.filter(may).select("__page.*")


def robots_gate(pages: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """``pages`` with ``robots_verdict``: ALLOWED or REFUSED by the robots text of the page's site; FAILED where that was not
    had, or the url has no host. ``robots`` has (site, status, robots_text), a row for each site asked; of several the one
    with the least status counts, then the least text. A status outside 200 to 299 or a null text is a failed request.
    """
    good = F.col("status").between(200, 299) & F.col("robots_text").isNotNull()
    asked = robots.groupBy(F.lower("site").alias("site")).agg(F.min(F.struct("status", "robots_text")).alias("got")).select("site", "got.*").filter(good)
    rules = asked.join(robots_rules(asked, agent), "robots_text").select(F.col("site").alias("__site"), "rules")
    met = _meet(pages.select(F.struct("*").alias("__page")), rules, site_of(F.col(f"__page.`{url}`")) == F.col("__site"))
    verdict = F.when(F.col("__site").isNull(), "FAILED").when(_followed(F.col("rules"), robots_target(F.col(f"__page.`{url}`"))), "ALLOWED").otherwise("REFUSED")
    return met.select("__page.*", verdict.alias("robots_verdict"))


def sitemap_urls(xml: Column) -> Column:
    """All ``loc`` of a sitemap in any name space, http and https only, each once. Broken XML is an error."""
    found = F.transform(F.xpath(xml, F.lit("//*[name()='loc' or substring-after(name(), ':') = 'loc']/text()")), lambda u: F.trim(u))
    return F.array_distinct(F.filter(found, lambda u: u.rlike("(?i)^https?://")))


@dataclass
class Response:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""


def retry_after(value: str | None, now: datetime | None = None) -> float | None:
    """Seconds that a Retry-After header asks for: a number, or a date."""
    if not value:
        return None
    if value.strip().isdigit():
        return float(value)
    try:
        when = parsedate_to_datetime(value)
    except (TypeError, ValueError):
        return None
    return max(0.0, (when - (now or datetime.now(timezone.utc))).total_seconds())


class Fetcher:
    """Conditional GET with bounded retries; transport, clock and sleep are arguments.

    transport(url, headers) gives a Response or raises OSError.
    """

    def __init__(self, transport: Callable[[str, dict[str, str]], Response], most_bytes: int = 10 << 20, retries: int = 2, backoff: float = 1.0, spacing: float = 0.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        self.transport, self.most_bytes, self.retries, self.backoff, self.spacing, self.sleep, self.clock = transport, most_bytes, retries, backoff, spacing, sleep, clock
        self.last: float | None = None

    def fetch(self, url: str, etag: str | None = None, modified: str | None = None) -> Response:
        """The response; 304 keeps an empty body. Too large a body is a ValueError, a last transport error is raised."""
        headers = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", modified)) if v}
        for attempt in range(self.retries + 1):
            if self.last is not None and (wait := self.spacing - (self.clock() - self.last)) > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                got = self.transport(url, headers)
            except OSError:
                if attempt == self.retries:
                    raise
                self.sleep(self.backoff * 2**attempt)
                continue
            if got.status in RETRIED and attempt < self.retries:
                asked = retry_after(got.headers.get("Retry-After"))
                self.sleep(self.backoff * 2**attempt if asked is None else asked)
                continue
            if len(got.body) > self.most_bytes:
                raise ValueError(f"{url}: body of {len(got.body)} bytes")
            return got
        raise AssertionError("unreachable")


def http_get(url: str, headers: dict[str, str], timeout: float = 20.0) -> Response:
    """A transport over the standard library; any status is an answer, a body is read up to the default limit and one byte."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as got:
            return Response(got.status, dict(got.headers.items()), got.read((10 << 20) + 1))
    except urllib.error.HTTPError as answer:
        return Response(answer.code, dict(answer.headers.items()), b"")


SCANNED = "source_id string, url string, fetched_at timestamp, http_status int, content_type string, etag string, last_modified string, content_hash string, body binary, error string"


def scan(
    sources: DataFrame, evidence: DataFrame, content_types: tuple[str, ...] = ("text/html", "text/plain", "application/pdf", "application/json"),
    transport: Callable[[str, dict[str, str]], Response] = http_get, spacing: float = 1.0, retries: int = 2, backoff: float = 1.0,
) -> DataFrame:
    """What each source (source_id, url) answers now, asked only for what changed since its last evidence (source_id,
    fetched_at, etag, last_modified): SCANNED, with http_status 304 and no body if nothing did, and an error if it failed -
    no answer, a status of 400 or more, a content type that isn't allowed, too large a body.

    A host's sources are one task's, in order of source_id and ``spacing`` seconds apart, retries included; hosts go in
    parallel. Asking twice may give two answers: write the result once, then take outcomes() of what is written.
    """
    last = evidence.groupBy(F.col("source_id").alias("__s")).agg(F.max_by(F.struct("etag", "last_modified"), F.struct("fetched_at", "etag", "last_modified")).alias("last"))
    asked = sources.join(last, F.col("source_id") == F.col("__s"), "left").select(
        F.col("source_id").cast("string").alias("source_id"), "url", "last.etag", "last.last_modified", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host")
    )
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c.split(" ")[0] for c in SCANNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, fetcher = None, None
        for r in (r for b in batches for r in b.to_pylist()):
            if fetcher is None or r["host"] != host:
                host, fetcher = r["host"], Fetcher(transport, retries=retries, backoff=backoff, spacing=spacing)
            row = dict.fromkeys(names) | {"source_id": r["source_id"], "url": r["url"], "fetched_at": datetime.now(timezone.utc)}
            try:
                got = fetcher.fetch(r["url"] or "", r["etag"], r["last_modified"])
                headers = {k.lower(): v for k, v in got.headers.items()}
                kind = (headers.get("content-type") or "").split(";")[0].strip().lower()
                row |= {"http_status": got.status, "etag": headers.get("etag"), "last_modified": headers.get("last-modified"), "content_type": kind or None}
                if got.status >= 400:
                    row["error"] = f"status {got.status}"
                elif got.status != 304 and kind not in content_types:
                    row["error"] = f"content type {kind or 'missing'}"
                elif got.status != 304:
                    row |= {"body": got.body, "content_hash": hashlib.sha256(got.body).hexdigest()}
            except (OSError, ValueError, HTTPException) as failed:
                row["error"] = str(failed) or type(failed).__name__
            yield pa.RecordBatch.from_pylist([row], schema=kinds)  # one answer at a time: bodies may be large

    kinds = to_arrow_schema(sources.sparkSession.createDataFrame([], SCANNED).schema)
    return asked.repartition(parts, "host").sortWithinPartitions("host", "source_id", "url").mapInArrow(run, SCANNED)


def outcomes(fetched: DataFrame, evidence: DataFrame) -> DataFrame:
    """``fetched`` (source_id, http_status, content_hash, error, ...) with ``status`` and ``last_good``, the hash of the content
    that holds after it, by the source's ``evidence`` (source_id, content_hash, fetched_at): FAILED and UNCHANGED keep the
    last one; a source's first content is FETCHED, other new content CHANGED, content that it had before UNCHANGED. A 304
    without evidence fails."""
    last = evidence.groupBy(F.col("source_id").alias("__s")).agg(F.max_by("content_hash", F.struct("fetched_at", "content_hash")).alias("__last"))
    had = evidence.select(F.col("source_id").alias("__t"), F.col("content_hash").alias("__h")).distinct().withColumn("__had", F.lit(True))
    rows = fetched.join(last, F.col("source_id") == F.col("__s"), "left").join(had, (F.col("source_id") == F.col("__t")) & (F.col("content_hash") == F.col("__h")), "left")
    same = F.coalesce(F.col("http_status") == 304, F.lit(False))
    failed = F.col("error").isNotNull() | F.coalesce(F.col("http_status") >= 400, F.lit(True)) | (same & F.col("__last").isNull()) | (~same & F.col("content_hash").isNull())
    status = F.when(failed, "FAILED").when(same, "UNCHANGED").when(F.col("__last").isNull(), "FETCHED").when(F.col("__had"), "UNCHANGED").otherwise("CHANGED")
    return rows.select(*[F.col(c) for c in fetched.columns], status.alias("status"), F.when(failed | same, F.col("__last")).otherwise(F.col("content_hash")).alias("last_good"))

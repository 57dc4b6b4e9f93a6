"""URL rules that follow redirects and canonical links, in DataFrame functions alone.

A rule is a host, a path prefix and a verdict; the longest rule that fits a url decides it. Urls without a rule take
the decision of their aliases: the connected component over redirect and canonical-link edges is allowed if an
explicit allow rule fits any member, else blocked if a block rule fits any, else allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import components

#: Rules up to which the test is one expression; more are joined by host suffix and path prefix.
INLINE_RULES = 200
#: Parts into which a component is dealt while its urls learn its verdict.
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, to ``?``, ``#`` or the end; else empty."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def node_of(url: Column) -> Column:
    """The url without its fragment."""
    return F.substring_index(url, "#", 1)


def inline_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null. Of rules as long, allow goes first, then by text."""
    test = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        test = F.when(fits, value) if test is None else test.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if test is None else test


def joined_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``decision`` as in inline_rule, for any number of rules (host, path, verdict).

    Each distinct (host, path) meets its host's suffixes and its path's prefixes of the lengths that rules have, so a
    host with many rules multiplies nothing.
    """
    lengths = [r.n for r in rules.select(F.length("path").alias("n")).distinct().collect()]
    keys = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    spread = keys.withColumn("h", F.explode(suffix)).withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths]))).filter(F.length("path") >= F.col("n"))
    spread = spread.withColumn("p", F.substring("path", F.lit(1), F.col("n")))
    named = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict")
    hit = spread.join(named, ["h", "p"])
    rank = F.struct(-F.length(F.concat("h", "p")).alias("n"), (F.col("verdict") != "allow").alias("a"), F.concat("h", "p").alias("rule"), F.col("verdict"))
    best = hit.groupBy("host", "path").agg(F.min(rank).alias("best"))
    best = best.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.struct("best.rule", "best.verdict").alias("decision"))
    return urls.join(best, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left").drop("__h", "__p")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) from each page's url to its canonical link and to its refresh target; both without fragments."""
    tags = (
        (r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"),
        (r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?is)\burl\s*=\s*(?:'([^'\">]*)'|\"([^\"]*)\"|([^\s\"'>]+))"),
    )
    page, out = F.col(url), None
    for tag, target in tags:
        found = F.regexp_extract(F.col(html), tag, 0)
        rows = pages.filter(page.isNotNull() & F.col(html).rlike(tag)).select(page.alias("u"), found.alias("t"))
        rows = rows.select("u", F.trim(F.concat(*[F.regexp_extract("t", target, k) for k in (1, 2, 3)])).alias("t")).filter("t <> ''")
        scheme, origin = F.substring_index("u", "://", 1), F.regexp_extract("u", "^[^:/?#]+://[^/?#]*", 0)
        t = F.col("t")
        whole = F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.startswith("//"), F.concat(scheme, F.lit(":"), t)).when(t.startswith("/"), F.concat(origin, t))
        whole = whole.otherwise(F.concat(origin, F.regexp_replace(F.concat(path_of(F.col("u")), F.lit("")), "[^/]*$", ""), t))
        edges = rows.select(node_of(F.col("u")).alias("a"), node_of(whole).alias("b"))
        out = edges if out is None else out.unionByName(edges)
    return out.filter("a <> b").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, edges: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` (without ``html``) with host, path, rule and verdict.

    ``edges`` (a, b): redirects and canonical links between urls; by default those that the pages state. Null urls and
    those without ``://`` have an empty host and path, no rule and no alias, and are allowed. Repeated rows and urls
    each keep their row. Columns of ``pages`` named like the results are replaced.
    """
    links = materialize((page_links(pages, url, html) if edges is None else edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))), "links")

    def decided(df: DataFrame, column: str) -> DataFrame:
        df = df.withColumns({"host": host_of(F.col(column)), "path": path_of(F.col(column))})
        if isinstance(rules, DataFrame):
            return joined_rule(df, rules)
        if len(rules) > INLINE_RULES:
            return joined_rule(df, df.sparkSession.createDataFrame(rules, "host string, path string, verdict string"))
        return df.withColumn("decision", inline_rule(rules, F.col("host"), F.col("path")))

    rest = [c for c in pages.columns if c not in (html, "host", "path", "rule", "verdict", "decision")]
    out = decided(pages.select(*rest), url)
    own = F.col("decision.verdict")
    if links.isEmpty():
        alias = F.lit(None).cast("string")
    else:
        nodes = materialize(components(links), "nodes")
        by_rule = decided(nodes, "node")
        roots = by_rule.groupBy("root").agg(F.max(own == "allow").alias("allowed"), F.max(own == "block").alias("blocked"))
        verdict = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
        # a component may hold a third of all urls, so it is dealt to SALTS parts, each with a copy of its verdict
        roots = roots.select("root", verdict.alias("__verdict")).filter("__verdict is not null").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        known = nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(roots, ["root", "salt"]).select(F.col("node").alias("__node"), "__verdict")
        out = out.join(known, node_of(F.col(url)) == F.col("__node"), "left")
        alias = F.col("__verdict")
    return out.select(*rest, "host", "path", F.col("decision.rule").alias("rule"), F.coalesce(own, alias, F.lit("allow")).alias("verdict"))

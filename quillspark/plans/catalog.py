"""Every query of the engine by name, over the driver's tables, in plain column types."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, ids, render, temporal, text
from ..functions.temporal import at
from ..operators import acquisition, claims, items, nearest, notices, relate, submissions, tables, trust
from ..operators.trigrams import TrigramIndex
from ..sources import files, registry, web
from ..sources.snapshots import Snapshots
from ..streaming import keyed, reminders, state
from . import named
from .bridge import EVENT_NOW, ITEM_NOW, Tables

SCOPE = {"program": "BUILDING", "branch": None, "year": 2, "semester": None}
CATEGORIES = ("DEADLINE", "EXAM", "FEES", "REGISTRATION")
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register f(tables) under its name, its result in plain types."""
    Q[f.__name__] = lambda spark, folder: plain(f(Tables(spark, folder)))
    return f


def plain(df: DataFrame) -> DataFrame:
    """Times as text, whole numbers as long, fractions to 6 places, lists of text joined by a bar."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("timestamp_ntz", "timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), 6)
        elif kind == "array<string>":
            c = F.array_join(c, "|")
        out.append(c.alias(name))
    return df.select(*out)


def views(t: Tables, scope: bool = True, categories: tuple[str, ...] = ()) -> named.Views:
    return named.Views(t.items(), t.claims(), t.relationships(), SCOPE if scope else {}, categories)


def _ids(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", "category", "importance", "title", *more)


# Named queries.
@query
def latest(t):
    return _ids(named.latest(views(t, categories=CATEGORIES), ITEM_NOW), "published_at")


@query
def public_feed(t):
    return _ids(named.public_feed(views(t), ITEM_NOW, "EXAM", 50), "published_at")


@query
def public_feed_json(t):
    return named.public_feed_json(views(t), ITEM_NOW, "EXAM", 50)


@query
def upcoming(t):
    return _ids(named.upcoming(views(t, scope=False), ITEM_NOW), "due_at", "starts_at")


@query
def search_all_tokens(t):
    return _ids(named.search(views(t), ITEM_NOW, "Notice nation_19", scoped=False))


@query
def search_any_token(t):
    rows = views(t).current(ITEM_NOW, scoped=False).filter(trust.any_token(("germany", "france", "exam")))
    return _ids(rows.orderBy(*named._newest()).limit(30))


@query
def natural_week(t):
    return _ids(named.search_natural(views(t, scope=False), ITEM_NOW, "show my exam notice this week"))


@query
def retrieval_candidates(t):
    return _ids(named.retrieval_candidates(views(t), ITEM_NOW))


@query
def changes_timeline(t):
    return _ids(named.changes_timeline(views(t, scope=False), ITEM_NOW), "change_kind", "changed_at", "old_title")


@query
def calendar_items(t):
    return _ids(named.calendar_items(views(t), ITEM_NOW, 15), "starts_at")


@query
def calendar_feed(t):
    return _ids(named.calendar_feed(views(t), ITEM_NOW), "due_at", "starts_at")


@query
def important_documents(t):
    return _ids(named.important_documents(views(t), ITEM_NOW))


@query
def deadline_conflicts(t):
    return _ids(named.deadline_conflicts(views(t, scope=False), ITEM_NOW), "due_at")


@query
def deadline_groups(t):
    return relate.anchored_groups(named.deadline_conflicts(views(t, scope=False), ITEM_NOW), 24 * 3600)


@query
def archive_search_default(t):
    return named.search_archive(t.items(), scope=SCOPE).select("id", "importance").limit(50)


@query
def archive_search_query(t):
    return named.search_archive(t.items(), "exam notice NATION 19").select("id", "importance").limit(50)


@query
def archive_search_at(t):
    return named.search_archive(t.items(), category="EXAM", now=ITEM_NOW).select("id", "due_at").limit(50)


# Evidence and runs.
@query
def evidence_append(t):
    e = t.evidence()
    return acquisition.append(e.filter("doc_id % 3 = 0"), e.filter("doc_id % 3 <> 0")).select("source_id", "content_hash", "doc_id")


@query
def evidence_latest(t):
    return acquisition.latest(t.evidence())


@query
def evidence_late(t):
    """Fetches that arrive after newer ones of their source: what is late, and that the latest row stays."""
    e = t.evidence()
    held, fetched = e.filter("doc_id % 3 <> 0"), e.filter("doc_id % 3 = 0")
    fetched = fetched.withColumn("fetched_at", F.col("fetched_at") - F.make_dt_interval(F.lit(1)))
    last = acquisition.latest(held.unionByName(acquisition.append(held, fetched)))
    return acquisition.late(held, fetched).select("source_id", "doc_id").join(last.select("source_id", F.col("doc_id").alias("latest_doc")), "source_id")


@query
def evidence_history(t):
    return acquisition.history(t.evidence(), "src1").select("doc_id", "fetched_at")


@query
def acquisition_status(t):
    e = t.evidence()
    both = e.unionByName(e.filter("doc_id % 5 = 0").withColumn("fetched_at", F.col("fetched_at") + F.make_dt_interval(F.lit(30))).withColumn("doc_id", F.col("doc_id") + 10_000_000))
    return acquisition.change_status(both).select("doc_id", "source_id", "status", "reverted")


@query
def source_health_streak(t):
    return claims.failed_streak(t.evidence())


@query
def run_rollup(t):
    rows = acquisition.change_status(t.evidence()).withColumn("bytes", F.octet_length("text").cast("bigint"))
    return tables.run_summary(rows)


@query
def run_manifest(t):
    return tables.manifest_hash(t.read("orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey")))


@query
def duplicate_ids(t):
    return tables.duplicate_keys(t.read("lineitem").selectExpr("l_orderkey", "l_suppkey % 3 AS shelf"), ["l_orderkey", "shelf"])


@query
def content_gate(t):
    """Landed bodies by content type: what is accepted and which extractor takes it."""
    kinds = ("text/html; charset=utf-8", "APPLICATION/PDF", " text/plain ;x", "application/json", "application/xhtml+xml", "image/png", None)
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("page_id") % len(kinds) + 1).cast("int"))
    rows = t.read("pages").select("page_id", kind.alias("content_type"))
    return rows.select("page_id", files.media_type(F.col("content_type")).alias("media_type"), files.accepted(F.col("content_type"), ["text/html", "application/pdf"]).cast("int").alias("accepted"), files.dispatch(F.col("content_type")).alias("extractor"))


@query
def text_documents(t):
    rows = t.read("documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return files.text_documents(rows, most_chars=None).select("doc_id", F.sha2("body_text", 256).alias("sha256"), F.col("quality.level").alias("level"), F.col("quality.score").alias("score"), "extraction_kind")


@query
def source_registry(t):
    found = registry.discovered(t.read("pages"), registry.registry(t.spark), least=2)
    return registry.enabled(found)


# Text to structure.
@query
def normalize_text(t):
    return t.read("documents").select("doc_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("sha256"))


@query
def statement_fingerprint(t):
    return t.read("documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"), F.array_size(text.token_set(F.col("text"))).alias("tokens"))


@query
def claim_ids(t):
    c = t.claims()
    mark = text.fingerprint(F.col("statement"))
    return c.select("k", ids.claim_id(F.col("document_id"), mark).alias("claim_id"), ids.evidence_id(F.col("source_id"), mark).alias("evidence_id"), ids.relationship_id(F.lit("SIMILAR"), F.col("id"), F.col("document_id")).alias("rel_id"), ids.source_relative_id(F.col("source_id"), F.lit("u"), F.col("k")).alias("rel_source_id"))


@query
def extract_dates(t):
    found = t.notices().select("k", F.posexplode(text.extract_dates(F.col("text"))).alias("n", "d"))
    return found.select("k", "n", F.col("d.value").alias("value"), F.col("d.source_text").alias("source_text"), F.col("d.confidence").alias("confidence"))


@query
def date_tokens(t):
    return t.notices().select("k", F.array_sort(text.date_tokens(F.concat(F.col("text"), F.lit(" 3/4/26, May 5, 2026 and 40-13-99")))).alias("tokens"))


def _statements(t, f):
    found = t.notices().select("k", F.posexplode(f(F.col("text"))).alias("n", "d"))
    return found.select("k", "n", F.col("d.title").alias("title"), F.col("d.at").alias("at"), F.col("d.source_text").alias("source_text"))


@query
def extract_deadlines(t):
    return _statements(t, text.extract_deadlines)


@query
def extract_events(t):
    return _statements(t, text.extract_events)


@query
def classify_notice(t):
    return t.notices().select("k", text.classify_notice(F.col("text"), F.col("source_id")).alias("category"))


@query
def category_map(t):
    return t.notices().select("k", text.assert_mapped(text.classify_notice(F.col("text"))).alias("category"))


@query
def academic_calendar(t):
    x = _calendar_rows(t)
    return x.select("k", "id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "label", "confidence", "source_text")


def _calendar_rows(t: Tables) -> DataFrame:
    """The last of equal rows of a text stays."""
    rows = t.notices().select("k", "source_id", "url", F.posexplode(text.calendar_lines(F.col("text"))).alias("n", "r")).select("k", "source_id", "url", "n", "r.*")
    rows = rows.withColumn("id", ids.calendar_row_id(F.col("source_id"), F.col("url"), F.col("start"), F.col("end"), F.col("label")))
    return rows.groupBy("k", "id").agg(F.max_by(F.struct("start", "end", "label", "confidence", "source_text"), "n").alias("x")).select("k", "id", "x.*")


@query
def calendar_dates(t):
    x = _calendar_rows(t).select("k", "id", F.explode(text.calendar_dates(*[F.col(c) for c in ("start", "end", "label", "source_text", "confidence")])).alias("d"))
    return x.select("k", "id", "d.value", "d.label", "d.confidence")


@query
def claims_from_documents(t):
    docs = t.notices().selectExpr("concat('doc:', k) AS id", "concat('ev:', k) AS evidence_id", "source_id", "text AS body_text")
    return claims.claims_from_documents(docs, ITEM_NOW).select("id", "document_id", "statement", "normalized_statement", "fingerprint", "effective_from")


# Claims and relations.
@query
def dedupe_claims(t):
    c = t.text_claims().withColumn("fingerprint", text.fingerprint(F.col("statement")))
    return claims.deduplicate(c.select("pos", "id", "fingerprint")).select("id", "fingerprint")


@query
def same_content_pairs(t):
    c = t.text_claims().withColumn("fingerprint", text.fingerprint(F.col("statement")))
    return relate.same_content(c)


@query
def content_classes(t):
    c = t.text_claims().withColumn("fingerprint", text.fingerprint(F.col("statement")))
    return relate.content_classes(c)


def _sets(t):
    # Without the labels of text_claims(): their join would shuffle the texts.
    docs = t.read("documents").selectExpr("doc_id AS pos", "concat('claim:', doc_id) AS id", "source AS source_id", "text AS statement")
    return docs.select("pos", "id", "source_id", text.fingerprint(F.col("statement")).alias("fingerprint"), text.token_set(F.col("statement")).alias("toks"))


@query
def cross_source_similarity(t):
    return relate.cross_source_similarity(_sets(t))


@query
def same_source_conflicts(t):
    return relate.conflicts(_sets(t)).select("left", "right", "similarity")


@query
def url_canonical(t):
    return t.read("pages").select("page_id", text.url_canonical(F.col("url")).alias("canonical"), text.url_identity(F.col("url")).alias("identity"))


@query
def url_replacements(t):
    """A page is its own document; its key, which others may have too, is but shown."""
    old = t.read("pages").selectExpr("'site' AS source_id", "page_id AS key", "url")
    new = old.withColumn("url", F.when(F.col("key") % 4 == 0, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("/"))).when(F.col("key") % 4 == 1, F.concat(F.col("url"), F.lit("x"))).otherwise(F.col("url")))
    return relate.url_replacements(old, new).select((F.col("key") % 100000).alias("key"), "old_url", "new_url")


def _evidence_at_hand(t):
    return t.spark.range(0, 1000).filter("id % 3 <> 0").selectExpr("concat('ev:', id) AS id")


@query
def verify_claims(t):
    return claims.verify(t.claims(), _evidence_at_hand(t))


@query
def publishable(t):
    return claims.publishable(t.claims(), _evidence_at_hand(t)).select("id", "evidence_id")


def _moves(t):
    states = F.array(*[F.lit(s) for s in ("UNVERIFIED", "VERIFIED", "CONFLICTING", "EXPIRED", "SUPERSEDED", "REMOVED")])
    return t.read("orders").select(F.col("o_orderkey").alias("k"), F.element_at(states, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("state"), F.element_at(states, (F.floor(F.col("o_orderkey") / 6) % 6 + 1).cast("int")).alias("next_state"))


@query
def state_transitions(t):
    good, bad = claims.move(_moves(t))
    return good.withColumn("accepted", F.lit(1)).unionByName(bad.withColumn("accepted", F.lit(0)))


@query
def resolve_state(t):
    c = t.claims()
    state = claims.resolved(F.col("state"), F.col("k") % 5 == 0, F.col("k") % 7 == 0, claims.is_expired(F.col("effective_until"), at(ITEM_NOW)))
    rows = c.select("id", "state", state.alias("next_state"))
    return rows.withColumn("accepted", claims.legal(F.col("state"), F.col("next_state")).cast("int"))


@query
def expiration(t):
    return t.claims().filter(claims.is_expired(F.col("effective_until"), at(ITEM_NOW))).select("id", "effective_until")


@query
def provenance(t):
    evidence = t.spark.range(0, 1000).selectExpr("concat('ev:', id) AS id", "sha2(CAST(id AS STRING), 256) AS content_hash", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT)) AS fetched_at")
    return claims.provenance(t.claims(), evidence, registry.registry(t.spark))


@query
def evidence_links(t):
    return claims.evidence_links(t.claims())


@query
def explicit_edges(t):
    """Stated edges of each kind."""
    kinds = enumerate(claims.STATED)
    pairs = t.claims().filter("k % 9 = 0")
    parts = [claims.explicit_edges(pairs.filter(f"k % 27 = {9 * n}").selectExpr("id AS left", "concat('claim:', k + 1) AS right"), kind, ITEM_NOW) for n, kind in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Items.
@query
def derive_priority(t):
    return items.prioritise(t.items(), ITEM_NOW, F.col("k") % 9 == 0).select("id", "importance", "urgency")


@query
def build_items(t):
    docs = t.claims().selectExpr("document_id AS id", "concat('  Title ', k, ' ') AS title", "element_at(array('FEES','EVENT','UNKNOWN'), CAST(k % 3 AS INT) + 1) AS category", "concat('https://x.example.org/', k) AS url", "array(concat('https://x.example.org/', k), 'https://y.example.org/') AS links")
    return items.build_items(t.claims(), docs, ITEM_NOW).select("id", "claim_id", "title", "category", "importance", "urgency", "starts_at", "source_links")


@query
def scope_match(t):
    a = t.users().select("user_id", *[F.col(c).alias(f"u_{c}") for c in trust.SCOPE])
    b = t.items().withColumn("user_id", F.col("k") % 1500)
    return a.join(b, "user_id").filter(trust.scopes_match("u_", "")).select("user_id", "id")


@query
def scope_specificity(t):
    return t.items().select("id", trust.specificity().alias("specificity"))


@query
def item_relationships(t):
    refs = t.items().selectExpr("id", "CASE WHEN k % 2 = 0 THEN concat('info:', k - 1) END AS changed_from_item_id", "CASE WHEN k % 3 = 0 THEN concat('info:', k - 1) END AS supersedes_item_id", "CASE WHEN k % 5 = 0 THEN concat('info:', k - 1) END AS corrected_item_id")
    return claims.history_edges(refs)


@query
def retract_sources(t):
    rows = t.items().select("id", "k", F.when(F.col("k") % 2 == 0, F.concat(F.lit("info:"), F.col("k") - 1)).alias("changed_from_item_id"))
    left, _ = tables.retract(rows, t.relationships(), rows.filter("k % 6 = 5"))
    return left


@query
def retract_edges(t):
    rows = t.items().select("id", "k")
    return tables.retract(rows, t.relationships(), rows.filter("k % 6 = 5"))[1].select("id", "old_item_id", "new_item_id")


@query
def facts_grouped(t):
    rows = t.read("lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS pos", "concat('part ', l_partkey % 100) AS title", "concat('u', l_suppkey % 5) AS url", "concat(l_returnflag, l_linestatus, l_linenumber) AS fact")
    return items.facts_grouped(rows)


@query
def item_lines(t):
    rows = trust.with_state(t.items(), t.claims())
    return rows.select("id", render.item_line(F.coalesce("due_at", "starts_at")).alias("line"))


@query
def conflict_membership(t):
    return relate.in_conflict(t.items(), t.claim_edges()).select("id")


# Tables.
@query
def upsert_latest(t):
    o = t.read("orders").selectExpr("o_orderkey % 5000 AS k", "o_orderkey AS version", "o_orderdate AS first_seen_at", "o_orderstatus AS state")
    return tables.upsert(o.filter("version % 2 = 0"), o.filter("version % 2 = 1"), ["k"], "version", keep_first=("first_seen_at",))


@query
def insert_if_absent(t):
    o = t.read("orders").selectExpr("o_custkey AS k", "o_orderkey AS pos", "o_orderstatus AS state")
    return tables.insert_if_absent(o.filter("pos % 2 = 0"), o.filter("pos % 2 = 1"), ["k"], "pos")


@query
def update_by_key(t):
    old = t.users().select("user_id", "status", "quiet_start")
    return tables.update(old, t.users().filter("user_id % 3 = 0").selectExpr("user_id", "'BLOCKED' AS status"), "user_id", ["status"])


@query
def upsert_odd_versions(t):
    """Versions that are null or tied: any other beats a null one, a new row an old one."""
    o = t.read("orders").selectExpr("o_orderkey % 3000 AS k", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 5 END AS version", "o_orderkey AS id", "o_orderstatus AS state")
    return tables.upsert(o.filter("id % 2 = 0"), o.filter("id % 2 = 1"), ["k"], "version")


@query
def update_repeated_keys(t):
    changes = t.users().filter("user_id % 3 = 0").selectExpr("user_id", "explode(array('BLOCKED', 'PAUSED', NULL)) AS status")
    return tables.update(t.users().select("user_id", "status"), changes, "user_id", ["status"])


@query
def replace_rows(t):
    """Replaced orders lose what the new row does not set."""
    old = t.read("orders").selectExpr("o_orderkey AS k", "o_orderstatus AS state", "o_orderpriority AS priority")
    new = t.read("orders").filter("o_orderkey % 4 = 0").selectExpr("o_orderkey AS k", "'X' AS state")
    return tables.replace(old, new.unionByName(t.spark.createDataFrame([(-1, "X")], "k bigint, state string")), ["k"])


@query
def replace_cascade(t):
    """The lines of replaced orders go with them."""
    new = t.read("orders").filter("o_orderkey % 4 = 0").select("o_orderkey")
    return tables.replaced_children(t.read("lineitem").select("l_orderkey", "l_linenumber"), new, "l_orderkey", "o_orderkey")


@query
def delete_by_key(t):
    return tables.delete(t.users().select("user_id", "status"), t.users().filter("user_id % 4 = 0"), "user_id")


@query
def retract_links(t):
    links = t.read("lineitem").selectExpr("concat('claim:', l_orderkey) AS claim_id", "concat('ev:', l_partkey) AS evidence_id", "l_linenumber")
    doomed = t.claims().filter("source_id = 'source2'").select("id")
    return tables.retract_links(links, doomed, "claim_id")


@query
def health_probe(t):
    named = ("documents", "pages", "events", "no_such_table")
    found = tables.health(t.spark, {name: f"{t.folder}/{name}.parquet" for name in named})
    return found.select("dependency", F.col("ok").cast("int").alias("ok"), "n_rows")


@query
def blob_chunks(t):
    rows = t.read("documents").selectExpr("doc_id", "CAST(text AS BINARY) AS body")
    return tables.chunks(rows, "doc_id", "body", 1000).select("doc_id", "chunk_index", F.sha2("chunk", 256).alias("sha256"))


@query
def blob_reassembly(t):
    rows = t.read("documents").selectExpr("doc_id", "CAST(text AS BINARY) AS body")
    return tables.reassemble(tables.chunks(rows, "doc_id", "body", 1000), "doc_id").select("doc_id", F.sha2("body", 256).alias("sha256"))


@query
def constraint_violations(t):
    checks = {"state": F.col("state").isin(*claims.TRANSITIONS), "statement": F.length("statement") > 0, "window": F.col("effective_until") > F.col("effective_from"), "odd_key": F.col("k") % 2 == 0}
    return tables.violations(t.claims(), checks)


# Submissions.
@query
def submission_scores(t):
    return submissions.scores(t.submissions(), t.archive(), dated=submissions.DATED).select("submission_id", "item_id", "score", "shared")


@query
def submission_dates(t):
    """Submitted notices against items that share no word with them but a date, by when they are due."""
    sent = t.notices().filter("k % 8 = 0").selectExpr("concat('s:', k) AS id", "text")
    kept = t.read("orders").filter("o_orderkey % 8 = 1").selectExpr("concat('info:', o_orderkey) AS id", "concat('item a', o_orderkey) AS title", "'' AS summary", "CAST(add_months(CAST(o_orderdate AS DATE), 240) AS TIMESTAMP_NTZ) AS due_at")
    return submissions.scores(sent, kept, dated=submissions.DATED).select("submission_id", "item_id", "score", "shared", F.col("date_hit").cast("int").alias("date_hit"))


@query
def submission_batch(t):
    sent = t.submissions().select("id", "user_id", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("up/"), F.col("id"))).alias("object_key"))
    edges = t.archive().filter("in_conflict").selectExpr("id AS left_claim_id", "'CONFLICTS' AS kind")
    rows = submissions.batch(sent, t.archive().select("id", "title"), edges, "file:///objects/")
    return rows.select("part", "id", "user_id", "object_key", "object_file", "title", "left_claim_id", "kind")


@query
def submission_best(t):
    return submissions.best(submissions.scores(t.submissions(), t.archive(), dated=submissions.DATED)).select("submission_id", "item_id", "rank", "reason")


def _to_places(score):
    """Six places as the SQL rounds them: a half is one of the product, not of the number as it is written."""
    return F.round(score * 1e6) / 1e6


def _verdicts(t):
    scored = submissions.scores(t.submissions(), t.archive(), dated=submissions.DATED)
    bad = t.archive().filter("in_conflict").select(F.col("id").alias("item_id"))
    return scored, submissions.classify(t.submissions(), scored, bad, strong=0.2)


@query
def submission_classify(t):
    return _verdicts(t)[1]


@query
def review_queue(t):
    scored, verdicts = _verdicts(t)
    return submissions.review_queue(verdicts, scored).withColumn("top_score", _to_places(F.col("top_score")))


@query
def verification_matches(t):
    return named.verification_matches(views(t), ITEM_NOW, "Please check the exam notice for building orders of germany").select("item_id", "score", "rank", "reason")


# Vectors and answers.
@query
def vector_topk(t):
    v = t.vectors()
    q = tables.one_row(v.filter("id = 0"), "vector 0")["embedding"]
    return named.vector_top(v, q).select("id", "score")


@query
def semantic_topk(t):
    """The nearest six of the twenty best candidates; items borrow the vectors of the embeddings table."""
    near = named.retrieval_candidates(views(t, scope=False), ITEM_NOW, 20)
    q = tables.one_row(t.vectors().filter("id = 0"), "vector 0")["embedding"]
    rows = near.select("id", (F.col("k") % 500).alias("v")).join(t.vectors().select(F.col("id").alias("v"), "embedding"), "v")
    return named.vector_top(rows, q).select("id", "score")


@query
def embedding_cache(t):
    cache = t.vectors().selectExpr("concat('info:', id % 50) AS item_id", "concat('m', label % 2) AS model", "sha2(CAST(id % 7 AS STRING), 256) AS content_hash", "id")
    return named.cached_embedding(cache, "info:7", "m1", hashlib.sha256(b"3").hexdigest()).select("id", "item_id", "model")


@query
def calendar_token_user(t):
    tokens = t.read("customer").selectExpr("c_custkey AS user_id", "sha2(CAST(c_custkey % 20 AS STRING), 256) AS token_hash", "TIMESTAMP_NTZ '1998-05-01 00:00:00' + make_dt_interval(CAST(c_custkey % 90 AS INT)) AS expires_at")
    return named.token_owner(tokens, hashlib.sha256(b"3").hexdigest(), ITEM_NOW)


@query
def citation_check(t):
    rows = t.claims().select("k", "statement", F.array(F.concat(F.lit("e"), F.col("k") % 3), F.concat(F.lit("e"), F.col("k") % 5)).alias("cites"))
    return rows.select("k", render.cites_only(F.col("statement"), F.col("cites"), F.array(F.lit("e0"), F.lit("e1"), F.lit("e2"))).cast("int").alias("ok"))


@query
def grounded_prompts(t):
    """A question for each order with its lines as evidence, and the prompt escaped for a message."""
    lines = t.read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("e"), F.col("l_linenumber")).alias("id"), F.concat(F.lit("part <"), F.col("l_partkey"), F.lit("> & more")).alias("title"), F.col("l_returnflag").alias("summary")))).alias("evidence"))
    prompt = render.grounded_prompt(F.concat(F.lit("What of order "), F.col("l_orderkey"), F.lit("?")), F.col("evidence"))
    return lines.select(F.col("l_orderkey").alias("k"), prompt.alias("prompt"), render.html_escape(prompt).alias("escaped"))


@query
def file_names(t):
    return t.read("pages").select("page_id", render.file_name(F.col("url")).alias("name"))


@query
def json_from_fence(t):
    wrapped = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```"))
    return t.read("events").select("event_id", F.get_json_object(render.json_object(wrapped), "$.k").cast("bigint").alias("k"))


# People.
@query
def personal_feed_all_users(t):
    live = trust.current(t.items(), t.claims(), t.relationships(), ITEM_NOW)
    return notices.feed(notices.active_users(t.users()), live, [F.coalesce("due_at", "starts_at").asc_nulls_last(), F.col("id")], 3).select("user_id", "rank", "item_id")


@query
def notification_users(t):
    return notices.active_users(t.users()).select("user_id", "program", notices.categories().alias("categories"))


@query
def user_preferences(t):
    """Users with their preferences; one user in eleven has none."""
    users = t.users()
    prefs = users.filter("user_id % 11 <> 0").select("user_id", "program", "branch", "year", notices.categories().alias("categories"), "reminders", "digest", "muted", "quiet_start", "quiet_end")
    found = notices.with_preferences(users.select("user_id", "status"), prefs)
    return found.select("user_id", "status", "program", "branch", "year", "categories", *[F.col(c).cast("int").alias(c) for c in ("reminders", "digest", "muted")], "quiet_start", "quiet_end")


@query
def preferences_of_user(t):
    users = t.users()
    return notices.preferences_of(users.select("user_id", "status"), users.select("user_id", "program", "year"), 7)


@query
def feed_other_categories(t):
    """Items of a null or a further category reach users who filter nothing."""
    live = trust.current(t.items(), t.claims(), t.relationships(), ITEM_NOW)
    live = live.withColumn("category", F.expr("CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'SPORT' ELSE category END"))
    return notices.feed(notices.active_users(t.users()), live, [F.col("published_at").desc(), F.col("id")], 4).select("user_id", "rank", "item_id")


@query
def delivery_status(t):
    # a notification is a user's digest of a week
    marks = t.ledger().select("user_id", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), "ts", "event_id", "status")
    return notices.delivery_status(marks, ["user_id", "week"], ["ts", "event_id"])


@query
def quiet_hours(t):
    rows = t.read("events").selectExpr("event_id", "date_format(ts, 'HH:mm') AS clock", "element_at(array('22:00','08:00','00:00'), CAST(event_id % 3 AS INT) + 1) AS a", "element_at(array('07:00','12:00','00:00'), CAST(event_id % 3 AS INT) + 1) AS b")
    return rows.select("event_id", temporal.is_quiet(F.col("a"), F.col("b"), F.col("clock")).cast("int").alias("quiet"), temporal.is_clock_time(F.col("clock")).cast("int").alias("valid"))


@query
def reminders_due(t):
    live = trust.current(t.items(), t.claims(), t.relationships(), ITEM_NOW)
    return notices.reminders_due(t.users(), live, ITEM_NOW, hours=72)


@query
def weekly_digest(t):
    live = trust.current(t.items(), t.claims(), t.relationships(), ITEM_NOW)
    return notices.weekly_digest(t.users(), live, datetime(1998, 6, 1, 3, 5))


@query
def notification_ledger(t):
    ledger = t.ledger()
    wanted = ledger.filter("event_id % 2 = 0")
    return notices.to_send(wanted, ledger.filter("event_id % 3 = 0"), EVENT_NOW, lease_minutes=7 * 24 * 60).select("id", "status")


@query
def iso_week_key(t):
    return t.read("orders").select("o_orderkey", temporal.iso_week_key(F.col("o_orderdate")).alias("week"), temporal.hour_key(F.col("o_orderdate")).alias("hour"))


@query
def message_parts(t):
    whole = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    parts = t.read("documents").select("doc_id", whole.alias("w"), F.posexplode(render.message_parts(whole)).alias("n", "part"))
    return parts.groupBy("doc_id").agg(F.max(F.length("part") <= render.MESSAGE_CHARS).cast("int").alias("fits"), F.sum(F.length(F.regexp_replace("part", "\n\n", ""))).alias("chars"))


# Parsers, calendar text, streams.
@query
def html_extract(t):
    docs = html.html_documents(t.read("pages"))
    return docs.select("page_id", "title", "body_text", "links", F.col("quality.level").alias("quality"), "extraction_kind")


@query
def ics_feed(t):
    live = trust.current(t.items(), t.claims(), t.relationships(), ITEM_NOW)
    ranked = notices.feed(notices.active_users(t.users()), live.filter(F.coalesce("due_at", "starts_at") >= at(ITEM_NOW)), [F.coalesce("starts_at", "due_at"), F.col("id")], 5)
    rows = ranked.select("user_id", "rank", F.col("item_id").alias("id")).join(live, "id")
    return render.ics_feed(rows, at(ITEM_NOW), "user_id")


@query
def sitemap_urls(t):
    xml = F.concat(F.lit("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc> "), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url><url><loc>ftp://x/</loc></url></urlset>"))
    return t.read("pages").select("page_id", F.explode(web.sitemap_urls(xml)).alias("url"))


@query
def robots_allowed(t):
    rows = t.read("pages").select("page_id", "url", F.lit("User-agent: *\nDisallow: /en/\n").alias("robots_text"))
    return web.allowed_by_robots(rows, "bot").select("page_id")


@query
def robots_gate(t):
    pages = t.read("pages").select("page_id", "url")
    # what sites answer, by the length of their name: a group for all, a group for another, a failure, two groups
    texts = [
        "User-agent: *\nDisallow: /en/ # not yet\nAllow: /en/7\n", "User-agent: other\nDisallow: /\n\nUser-agent: *\nallow: /de/7\ndisallow: /%64e/\n", None,
        "User-agent: *\nDisallow: /\n\nUser-agent: x\nUser-agent: Bot\nCrawl-delay: 5\nDisallow:\n", "",
    ]
    sites = pages.select(web.site_of(F.col("url")).alias("site")).distinct()
    kind = F.length("site") % len(texts)
    answer = F.element_at(F.array(*[F.lit(x) for x in texts]), kind + 1)
    robots = sites.select("site", F.when(kind == 2, 404).otherwise(200).alias("status"), answer.alias("robots_text"))
    return web.robots_gate(pages, robots, "bot/1.0").select("page_id", "robots_verdict")


def _scratch(t: Tables) -> str:
    """A folder that the driver and all executors share; one of this machine only where all work is done here."""
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base and t.spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or 'file:///tmp/checkpoints'}/stream-{uuid.uuid4().hex}"


def _event_stream(t: Tables) -> DataFrame:
    return state.table_stream(t.spark, f"{t.folder}/events.parquet")


LEDGER = ["event_id", "ts", "user_id", "concat('info:', event_id % 500) AS item_id", "'REMINDER' AS kind", "date_format(ts, \"yyyy-MM-dd'T'HH\") AS key", "element_at(array('PENDING','SENT','FAILED','SKIPPED'), CAST(event_id % 4 AS INT) + 1) AS status"]


@query
def stream_ledger(t):
    path = _scratch(t)
    rows = _event_stream(t).selectExpr(*LEDGER)
    rows.writeStream.foreachBatch(state.ledger_sink(f"{path}/ledger")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{path}/ledger").select(*state.KEYS, "status")


@query
def stream_once_only(t):
    path = _scratch(t)
    rows = _event_stream(t).selectExpr("CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_type", "date_format(ts, 'yyyy-MM-dd') AS day")
    return state.drain(state.once_only(rows, "ts", "60 days", ["user_id", "event_type", "day"]).select("user_id", "event_type", "day"), f"{path}/out", f"{path}/checkpoint")


@query
def stream_queue(t):
    path = _scratch(t)
    queued = state.table_stream(t.spark, f"{t.folder}/conversations.parquet").filter("role = 'user'").selectExpr("concat(conv_id, ':', turn) AS id", "text")
    queued.writeStream.foreachBatch(state.queue_sink(f"{path}/verdicts", t.archive(), 0.2)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return state.queue_verdicts(t.spark, f"{path}/verdicts")


@query
def stream_claim_state(t):
    path = _scratch(t)
    rows = _event_stream(t).selectExpr("concat('claim:', user_id) AS claim_id", "CAST(ts AS TIMESTAMP) AS ts", "element_at(array('VERIFIED','CONFLICTING','EXPIRED','SUPERSEDED','REMOVED'), CAST(event_id % 5 AS INT) + 1) AS next_state")
    return state.drain(state.claim_states(rows), f"{path}/out", f"{path}/checkpoint")


@query
def stream_new_content(t):
    path = _scratch(t)
    rows = state.table_stream(t.spark, f"{t.folder}/documents.parquet").selectExpr("source AS source_id", "sha2(text, 256) AS content_hash", "CAST(TIMESTAMP_NTZ '2024-01-01 00:00:00' AS TIMESTAMP) AS fetched_at")
    return state.drain(state.new_content(rows).select("source_id", "content_hash"), f"{path}/out", f"{path}/checkpoint")


def _seconds(column: str) -> str:
    return f"CAST(date_trunc('second', {column}) AS TIMESTAMP)"


@query
def stream_claim_expiry(t):
    """Four hundred claims; two events in five say until when the claim holds."""
    path = _scratch(t)
    states = "CASE WHEN event_id % 97 = 0 THEN 'SUPERSEDED' WHEN event_id % 101 = 0 THEN 'REMOVED' ELSE element_at(array('VERIFIED','CONFLICTING','VERIFIED','EXPIRED','VERIFIED','CONFLICTING'), CAST(event_id % 6 AS INT) + 1) END"
    until = f"CASE WHEN event_id % 5 < 2 THEN {_seconds('ts')} + make_dt_interval(0, CAST(event_id % 90 - 5 AS INT)) END"
    rows = _event_stream(t).selectExpr("concat('claim:', event_id % 400) AS claim_id", f"{_seconds('ts')} AS ts", f"{states} AS next_state", f"{until} AS effective_until")
    return state.drain(keyed.claim_states(rows, "2 days"), f"{path}/out", f"{path}/checkpoint")


@query
def stream_change_status(t):
    """A fetch every seven minutes; contents come back, some fetches fail and some are not modified."""
    path = _scratch(t)
    code = "CASE WHEN doc_id % 9 = 0 THEN 500 WHEN doc_id % 7 = 0 THEN 304 ELSE 200 END"
    rows = state.table_stream(t.spark, f"{t.folder}/documents.parquet").selectExpr(
        "source AS source_id", "CAST(TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(7 * doc_id AS INT)) AS TIMESTAMP) AS fetched_at", "doc_id", "substr(sha2(text, 256), 1, 2) AS content_hash", f"{code} AS http_status"
    )
    found = keyed.change_status(rows, "6 hours")
    return state.drain(found, f"{path}/out", f"{path}/checkpoint").select("source_id", "doc_id", "status", "reverted", "last_good")


@query
def stream_delivery(t):
    """Seven hundred notifications: claims, what became of them, and leases of three days that run out."""
    path = _scratch(t)
    mark = "element_at(array('CLAIM','SENT','CLAIM','FAILED','CLAIM','SKIPPED'), CAST((event_id * 7 + event_id DIV 700) % 6 AS INT) + 1)"
    rows = _event_stream(t).selectExpr("concat('notification:', event_id % 700) AS notification_id", f"{_seconds('ts')} AS ts", "event_id", f"{mark} AS mark")
    found = keyed.deliveries(rows, "2 days", lease_minutes=3 * 24 * 60, keep_days=5)
    return state.drain(found, f"{path}/out", f"{path}/checkpoint")


# Stored tables.
@query
def stored_upsert(t):
    """Orders by a repeating key: made, upserted twice, rows deleted; read as stored."""
    rows = t.read("orders").selectExpr("o_orderkey % 5000 AS k", "o_orderkey AS version", "o_orderdate AS first_seen_at", "o_orderstatus AS state")
    part = [rows.filter(x) for x in ("version < 5000", "version >= 5000 AND version < 10000", "version >= 10000")]
    table = Snapshots(t.spark, f"{_scratch(t)}/table")
    table.create(tables.upsert(rows.limit(0), part[0], ["k"], "version", ("first_seen_at",)), ["k"])
    table.upsert(part[1], "version", keep_first=("first_seen_at",))
    table.upsert(part[2], "version", keep_first=("first_seen_at",))
    table.delete(rows.filter("k % 11 = 0").select("k"))
    return table.read()


@query
def stored_replace(t):
    """Customers; some are replaced by rows without a segment, new ones come, and the version before is read beside."""
    rows = t.read("customer").selectExpr("c_custkey AS k", "c_name AS name", "c_mktsegment AS segment")
    table = Snapshots(t.spark, f"{_scratch(t)}/table")
    first = table.create(rows.filter("k % 2 = 0"), ["k"])
    table.replace(rows.filter("k % 3 = 0").select("k", "name"))
    table.insert_if_absent(rows.filter("k % 5 < 3"), "name")
    old = table.read(first).select("k", F.lit(1).alias("before"))
    return table.read().join(old, "k", "left").select("k", "name", "segment", F.coalesce("before", F.lit(0)).alias("before"))


@query
def stream_reminders(t):
    """Five ticks, a quarter of an hour apart, around the hour of the digest; one user in nine can't be delivered to."""
    path = _scratch(t)
    ticks = state.table_stream(t.spark, f"{t.folder}/region.parquet").selectExpr("TIMESTAMP_NTZ '1998-06-01 02:45:00' + make_dt_interval(0, 0, CAST(15 * r_regionkey AS INT)) AS ts")
    ledger = reminders.open_ledger(t.spark, f"{path}/ledger", buckets=8)
    trust.current(t.items(), t.claims(), t.relationships(), ITEM_NOW).select("id", "category", *trust.SCOPE, "due_at", "starts_at").filter("due_at is not null or starts_at is not null").write.parquet(f"{path}/live")
    live = lambda: t.spark.read.parquet(f"{path}/live")  # noqa: E731  one clock for all ticks, so the items are made once
    deliver = lambda claims: claims.withColumn("status", F.expr("CASE WHEN user_id % 9 = 0 THEN 'FAILED' ELSE 'SENT' END"))
    sink = reminders.reminder_sink(ledger, t.users, live, deliver)
    ticks.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ledger.read()


@query
def gap_groups(t):
    """A user's events in groups of six hours from the first of each."""
    rows = t.read("events").select("user_id", "event_id", "ts")
    return relate.gap_anchors(rows, 6 * 3600, "user_id", "ts").groupBy("user_id", "anchor").agg(F.count("*").alias("events"), F.max("event_id").alias("last_event"))


@query
def scan_outcomes(t):
    """Half of the documents are what sources answered, the other half the evidence they have; some answers are 304 or fail."""
    rows = t.read("documents").selectExpr("doc_id", "concat(source, ':', doc_id % 50) AS source_id", "substr(sha2(text, 256), 1, 1) AS content_hash", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT)) AS fetched_at")
    code = "CASE WHEN doc_id % 10 = 1 THEN 304 WHEN doc_id % 14 = 3 THEN 503 ELSE 200 END"
    fetched = rows.filter("doc_id % 2 = 1").selectExpr("doc_id", "source_id", f"{code} AS http_status", f"CASE WHEN {code} = 200 THEN content_hash END AS content_hash", "CASE WHEN doc_id % 22 = 5 THEN 'content type image/png' END AS error")
    found = web.outcomes(fetched, rows.filter("doc_id % 2 = 0 AND doc_id % 50 < 40"))
    return found.select("doc_id", "source_id", "status", "last_good")


def _indexed(t):
    """An index of all items and their statements, and the current ones."""
    index = TrigramIndex(t.spark, f"{_scratch(t)}/trigrams", buckets=32)
    index.append(trust.with_state(t.items(), t.claims()))
    return index, views(t).current(ITEM_NOW, scoped=False)


@query
def indexed_all_tokens(t):
    """Every current item whose texts hold all three words, the last one too short for the index."""
    index, rows = _indexed(t)
    return _ids(index.all_tokens(rows, ["NATION_1", "clerk 1", "u"]))


@query
def indexed_any_token(t):
    index, rows = _indexed(t)
    return _ids(index.any_token(rows, ["customer#00000001", "calendar notice", "no such word"]))


@query
def nearest_vectors(t):
    """The six nearest of all vectors for each whose id is divisible by 50."""
    v = t.vectors().select("id", "embedding")
    return nearest.nearest(v, v.filter("id % 50 = 0"), 6)


@query
def similarity_classes(t):
    """Every document's class of equal sets and its number of similar documents in other sources."""
    return relate.similar_classes(_sets(t), 0.80)[0]


@query
def similarity_class_links(t):
    return relate.similar_classes(_sets(t), 0.80)[1]


@query
def conflict_classes(t):
    return relate.similar_classes(_sets(t), 0.65, same_source=True)[0]


# Messages.
@query
def message_part_texts(t):
    """Whole texts with a blank line after each sentence, in parts of 300 characters at most."""
    whole = F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n"))
    return t.read("documents").select("doc_id", F.posexplode(render.message_parts(whole, 300)).alias("n", "part")).select("doc_id", "n", F.sha2("part", 256).alias("sha256"))


@query
def list_messages(t):
    """The first five orders of each customer as a list; some have none."""
    rows = t.read("orders").selectExpr(
        "o_custkey AS user_id", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank", "concat('kind <', o_orderkey % 2, '>') AS title", "concat('https://x.example.org/?a=1&b=', o_orderkey % 3 % 2) AS primary_source_url",
        "concat(o_orderstatus, '\n by  ', o_orderpriority, '\r\n\n', o_orderstatus) AS summary", "CASE WHEN o_orderkey % 3 = 0 THEN 'A&B' END AS program", "CAST(NULL AS STRING) AS branch", "o_orderkey % 5 AS year",
        "CAST(NULL AS INT) AS semester", "CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS due_at", "CAST(NULL AS TIMESTAMP_NTZ) AS starts_at", "CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END AS ends_at",
    )
    return render.list_messages(t.read("customer").select(F.col("c_custkey").alias("user_id")), rows, "user_id", "Verified ORDER results", 5)


@query
def item_texts(t):
    refs = "CASE WHEN k % {0} = 0 THEN concat('info:', k - 1) END AS {1}"
    rows = t.items().select("*", *[F.expr(refs.format(n, c)) for n, c in ((3, "supersedes_item_id"), (2, "changed_from_item_id"), (5, "corrected_item_id"))])
    return rows.select("id", render.item_text().alias("message"))


@query
def preference_texts(t):
    rows = t.users().withColumn("categories", notices.categories())
    return rows.select("user_id", render.preferences_text().alias("message"))


@query
def answer_texts(t):
    """Each order's status as an answer; one of its two citations may be no evidence."""
    one = lambda n: F.struct(F.lit(f"e{n}").alias("id"), F.concat(F.lit(f"Note {n} <of> "), F.col("o_orderkey")).alias("title"), F.lit(f"https://x.example.org/?n={n}&m").alias("url"))
    cites = F.array(*[F.concat(F.lit("e"), F.col("o_orderkey") % n) for n in (4, 3)])
    said = F.concat(F.lit(" Status is <"), F.col("o_orderstatus"), F.lit("> "))
    return t.read("orders").select("o_orderkey", render.answer_text(said, cites, F.array(one(0), one(1), one(2))).alias("message"))


@query
def whole_numbers(t):
    """What users may set as a year, as they spell it."""
    spelt = F.element_at(F.array(*[F.concat(F.lit(a), F.col("event_id") % 13, F.lit(b)) for a, b in (("", ""), (" ", ".0 "), ("-", ""), ("+", ""), ("", "th"), ("", ".5"))]), (F.col("event_id") % 6 + 1).cast("int"))
    return t.read("events").select("event_id", temporal.whole_number(spelt, 1, 10).alias("year"))


@query
def claims_all_publishable(t):
    """Publishable claims pass the guard that raises for any other."""
    hand = _evidence_at_hand(t)
    return claims.all_publishable(claims.publishable(t.claims(), hand), hand).select("id", "evidence_id")


@query
def html_structure(t):
    """Notices as pages: what the documents made of them name."""
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("</p><p>"))
    page = F.concat(F.lit("<html><head><title>x</title></head><body><nav><a href='/'>due 1 May 2020</a></nav><main><h1>"), F.col("source_id"), F.lit("</h1><p>"), body, F.lit("</p></main></body></html>"))
    docs = html.assembled(t.notices().select("k", "source_id", "url", page.alias("html")), key="k")
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.date_format(x["at"], "yyyy-MM-dd"), F.lit(" "), x["title"])), "|").alias(c)
    return docs.select("k", "title", F.sha2("body_text", 256).alias("sha256"), F.size("dates").alias("dates"), listed("deadlines"), listed("events"), F.size("calendar").alias("calendar"), "notice_category")

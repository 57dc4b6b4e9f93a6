"""The parameterised queries over items. Every one takes its clock and limits as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intent import parse_intent
from ..functions.temporal import at, in_effect
from ..functions.text import content_tokens, slash_dates, token_set
from ..functions.vectors import cosine
from ..operators import relate, submissions, trust

CALENDAR_VIEW = ("EVENT", "HOLIDAY", "CALENDAR")
CALENDAR_FEED = ("DEADLINE", "EXAM", "REGISTRATION", "EVENT", "HOLIDAY", "CALENDAR")
FEED_TIMES = ("published_at", "effective_from", "effective_until", "due_at", "starts_at", "ends_at")
DOCUMENTS = ("NOTICE", "CALENDAR")
PREFILTER_ROWS, PREFILTER_TOKENS = 30, 12


@dataclass
class Views:
    """The relations that the queries read."""

    items: DataFrame
    claims: DataFrame
    edges: DataFrame
    scope: dict[str, object] = field(default_factory=dict)
    categories: tuple[str, ...] = ()

    def current(self, now: datetime, scoped: bool = True) -> DataFrame:
        rows = self.items.filter(trust.scope_filter(self.scope)) if scoped else self.items
        return trust.current(rows, self.claims, self.edges, now)


def _newest():
    return [F.coalesce("published_at", "effective_from", "created_at").desc_nulls_last(), F.col("id")]


def _relevant(text_order: bool):
    return [trust.importance_order(text_order), F.coalesce("published_at", "created_at").desc_nulls_last(), F.col("id")]


def latest(v: Views, now: datetime, limit: int = 8) -> DataFrame:
    return v.current(now).filter(trust.category_filter(v.categories)).orderBy(*_newest()).limit(limit)


def public_feed(v: Views, now: datetime, category: str | None = None, limit: int = 20) -> DataFrame:
    """Without a scope; the limit is held between 1 and 20."""
    rows = v.current(now, scoped=False)
    if category:
        rows = rows.filter(F.col("category") == category)
    return rows.orderBy(*_newest()).limit(max(1, min(20, limit)))


def public_feed_json(v: Views, now: datetime, category: str | None = None, limit: int = 20) -> DataFrame:
    """One row: public_feed() as a JSON document, times in UTC, absent values null."""
    rows = public_feed(v, now, category, limit)
    rows = rows.withColumn("__n", F.row_number().over(Window.orderBy(*_newest())))  # 20 rows at most
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    item = F.struct("id", "title", "summary", "category", "importance", "program", "branch", "year", "semester", *[stamp(c) for c in FEED_TIMES], "primary_source_url")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__n", item.alias("item")))), lambda x: x["item"])
    head = [F.lit(True).alias("ok"), F.lit("verified").alias("trust"), F.lit(now.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("generated_at")]
    return rows.agg(F.to_json(F.struct(*head, listed.alias("items")), {"ignoreNullFields": "false"}).alias("feed"))


def upcoming(v: Views, now: datetime, days: int = 30, limit: int = 8) -> DataFrame:
    """Due, else starting, within a window closed at both ends."""
    when = F.coalesce("due_at", "starts_at")
    rows = v.current(now).filter(trust.category_filter(v.categories)).filter((when >= at(now)) & (when <= at(now + timedelta(days=days))))
    return rows.orderBy(when, "id").limit(limit)


def search(v: Views, now: datetime, query: str, limit: int = 8, scoped: bool = True, text_order: bool = False) -> DataFrame:
    """Every word in the title, summary or statement. No words, no rows."""
    words = query.lower().split()
    rows = v.current(now, scoped).filter(trust.category_filter(v.categories if scoped else ())).filter(trust.all_tokens(words) if words else F.lit(False))
    return rows.orderBy(*_relevant(text_order)).limit(limit)


def search_natural(v: Views, now: datetime, question: str, limit: int = 10, text_order: bool = False) -> DataFrame:
    intent = parse_intent(question, now)
    rows = v.current(now).filter(trust.category_filter((intent.category,) if intent.category else v.categories)).filter(trust.all_tokens(intent.words))
    when = F.coalesce("due_at", "starts_at", "effective_from", "published_at")
    if not intent.by_time:
        return rows.orderBy(*_relevant(text_order)).limit(limit)
    return rows.filter((when >= at(intent.start)) & (when < at(intent.end))).orderBy(when, "id").limit(limit)


def retrieval_candidates(v: Views, now: datetime, limit: int = 30, text_order: bool = False) -> DataFrame:
    return v.current(now).orderBy(*_relevant(text_order)).limit(limit)


def verification_matches(v: Views, now: datetime, query: str, limit: int = 5, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """The newest rows that hold one of the query's first words, scored against the query by title and summary."""
    spark = v.items.sparkSession
    asked = spark.createDataFrame([(query,)], "text string")
    words = asked.select(content_tokens(F.col("text"), stop_words)).first()[0]
    if not words:
        return v.items.filter(F.lit(False)).select(F.lit("").alias("submission_id"), F.col("id").alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).alias("shared"), F.lit(False).alias("date_hit"), F.lit(0).alias("rank"), F.lit("").alias("reason"))
    near = v.current(now, scoped=False).filter(trust.any_token(words, PREFILTER_TOKENS)).orderBy(*_newest()).limit(PREFILTER_ROWS)
    scored = submissions.scores(asked.select(F.lit("query").alias("id"), "text"), near.select("id", "title", "summary"), stop_words=stop_words, dates=slash_dates, dated=submissions.DATED)
    return submissions.best(scored, limit)


def changes_timeline(v: Views, now: datetime, days: int = 30, limit: int = 10) -> DataFrame:
    """Items that recent edges lead to, with the old item's title. Superseded items are not left out here."""
    edges = v.edges.filter(F.col("kind").isin("CHANGED", "SUPERSEDES", "CORRECTS") & (F.col("created_at") >= at(now - timedelta(days=days))) & (F.col("created_at") <= at(now)))
    edges = edges.select(F.col("new_item_id").alias("id"), "old_item_id", F.col("kind").alias("change_kind"), F.col("created_at").alias("changed_at"))
    rows = v.items.filter(in_effect(F.col("effective_from"), F.col("effective_until"), at(now))).filter(trust.scope_filter(v.scope)).join(edges, "id")
    rows = trust.with_state(rows, v.claims.filter("state = 'VERIFIED'"))
    old = v.items.select(F.col("id").alias("old_item_id"), F.col("title").alias("old_title"))
    return rows.join(old, "old_item_id", "left").orderBy(F.desc("changed_at"), "id").limit(limit)


def _calendar(v: Views, now: datetime, days: int, limit: int, categories: tuple[str, ...]) -> DataFrame:
    when = F.coalesce("starts_at", "due_at")
    rows = v.current(now).filter(F.col("category").isin(*categories) & (when >= at(now)) & (when < at(now + timedelta(days=days))))
    return rows.orderBy(when, "id").limit(limit)


def calendar_items(v: Views, now: datetime, days: int = 7, limit: int = 20) -> DataFrame:
    return _calendar(v, now, days, limit, CALENDAR_VIEW)


def calendar_feed(v: Views, now: datetime, days: int = 90, limit: int = 100) -> DataFrame:
    return _calendar(v, now, days, limit, CALENDAR_FEED)


def important_documents(v: Views, now: datetime, limit: int = 8, text_order: bool = False) -> DataFrame:
    rows = v.current(now).filter(F.col("category").isin(*DOCUMENTS) & F.col("importance").isin("HIGH", "CRITICAL"))
    return rows.orderBy(*_relevant(text_order)).limit(limit)


def deadline_conflicts(v: Views, now: datetime, days: int = 14, hours: int = 24, limit: int = 30) -> DataFrame:
    """Deadlines with another verified deadline in effect nearby, whatever its scope."""
    ahead = lambda df: df.filter((F.col("due_at") >= at(now)) & (F.col("due_at") < at(now + timedelta(days=days))))
    rows = ahead(v.current(now).filter(trust.category_filter(v.categories)))
    others = ahead(trust.with_state(v.items.filter(in_effect(F.col("effective_from"), F.col("effective_until"), at(now))), v.claims.filter("state = 'VERIFIED'")))
    return relate.near_in_time(rows, others, hours * 3600).orderBy("due_at", "id").limit(limit)


def search_archive(items: DataFrame, query: str = "", category: str | None = None, scope: dict[str, object] | None = None, now: datetime | None = None, include_expired: bool = False) -> DataFrame:
    """The library's search: whole words in title and summary; ordered by time if a clock is given, else by hits, else
    by importance. Nulls of times go last."""
    rows = items if category is None else items.filter(F.col("category") == category)
    rows = rows.filter(trust.scope_filter(scope or {}))
    if now is not None and not include_expired:
        rows = rows.filter(in_effect(F.col("effective_from"), F.col("effective_until"), at(now)))
    rank = trust.importance_rank().desc()
    published = F.col("published_at").desc_nulls_last()
    words = items.sparkSession.createDataFrame([(query,)], "q string").select(token_set(F.col("q"))).first()[0]
    if words:
        q = F.array(*[F.lit(w) for w in words])
        rows = rows.filter(F.size(F.array_except(q, F.concat(token_set(F.col("title")), token_set(F.col("summary"))))) == 0)
    if now is not None:
        order = [F.col("due_at").isNull(), F.coalesce("due_at", "starts_at", "effective_from").asc_nulls_last(), rank, F.col("id")]
    elif words:
        hits = lambda c: F.size(F.array_intersect(q, token_set(F.col(c)))).desc()
        order = [hits("title"), hits("summary"), rank, published, F.col("id")]
    else:
        order = [rank, published, F.col("id")]
    return rows.orderBy(*order)


def vector_top(vectors: DataFrame, query: list[float], most: int = 6) -> DataFrame:
    """The nearest rows (id, embedding) to one query vector, by cosine, then id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", cosine(F.col("embedding"), q)).orderBy(F.desc("score"), "id").limit(most)


def cached_embedding(cache: DataFrame, item_id: str, model: str, content_hash: str) -> DataFrame:
    """The cached vector for this very content, model and item; stale content has none."""
    return cache.filter((F.col("item_id") == item_id) & (F.col("model") == model) & (F.col("content_hash") == content_hash))


def token_owner(tokens: DataFrame, token_hash: str, now: datetime) -> DataFrame:
    """The user of a calendar token that has not run out."""
    return tokens.filter((F.col("token_hash") == token_hash) & (F.col("expires_at") > at(now))).select("user_id")

"""Items: importance and urgency, projection of claims, fact groups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions.temporal import at
from .trust import specificity

# Fixed values.
EXPLICIT_WORDS = ("urgent", "immediate", "last date", "final date", "important", "mandatory", "must")
CONSEQUENCE = ("EXAM", "FEES", "REGISTRATION", "DEADLINE")
IMMEDIATE_DAYS, SOON_DAYS = 2, 7
SUMMARY_CHARS = 2000
MOST_FACTS = 12


def urgency(target: Column, now: Column) -> Column:
    days = lambda n: now + F.make_dt_interval(F.lit(n))
    return F.when(target.isNull(), "NONE").when(target < now, "OVERDUE").when(target <= days(IMMEDIATE_DAYS), "IMMEDIATE").when(target <= days(SOON_DAYS), "SOON").otherwise("UPCOMING")


def importance(category: Column, urgent: Column, words: Column, changed: Column, scope: Column) -> Column:
    """The first that holds: overdue, or immediate with consequences; changed, said to matter, or with consequences;
    a narrow audience; a notice or calendar; else low."""
    said, plain = F.lit(False), text.normalize_statement(words)
    for w in EXPLICIT_WORDS:
        said = said | plain.contains(w)
    heavy = category.isin(*CONSEQUENCE)
    return (
        F.when((urgent == "OVERDUE") | ((urgent == "IMMEDIATE") & heavy), "CRITICAL").when(changed | said | heavy, "HIGH").when(scope >= 3, "HIGH").when(category.isin("NOTICE", "CALENDAR"), "NORMAL").otherwise("LOW")
    )


def prioritise(items: DataFrame, now: datetime, changed: Column | None = None) -> DataFrame:
    """Items with importance and urgency worked out anew."""
    rows = items.withColumn("urgency", urgency(F.coalesce("due_at", "starts_at"), at(now)))
    words = F.concat_ws(" ", "title", "summary")
    return rows.withColumn("importance", importance(F.col("category"), F.col("urgency"), words, F.lit(False) if changed is None else changed, specificity()))


def build_items(claims: DataFrame, documents: DataFrame, now: datetime, due_from_deadline: bool = True) -> DataFrame:
    """Items of verified claims (id, document_id, state, statement, effective_from) and their documents (id, title,
    category, url, links). With ``due_from_deadline`` a deadline sentence's date is due, else all dates are starts."""
    docs = documents.select(F.col("id").alias("document_id"), F.col("title").alias("doc_title"), text.map_category(F.col("category")).alias("category"), "url", "links")
    rows = claims.filter("state = 'VERIFIED'").join(docs, "document_id")
    deadline = text.has_term(F.col("statement"), text.DEADLINE_TERMS) & F.lit(due_from_deadline)
    out = rows.select(
        ids.item_id(F.col("id"), F.col("category")).alias("id"), F.col("id").alias("claim_id"), F.trim("doc_title").alias("title"), F.trim(F.substring("statement", 1, SUMMARY_CHARS)).alias("summary"), "category",
        *[F.lit(None).cast(t).alias(c) for c, t in (("program", "string"), ("branch", "string"), ("year", "int"), ("semester", "int"))],
        F.when(deadline, F.col("effective_from")).alias("due_at"), F.when(~deadline, F.col("effective_from")).alias("starts_at"),
        F.array_distinct(F.concat(F.array("url"), F.coalesce("links", F.array().cast("array<string>")))).alias("source_links"), F.col("url").alias("primary_source_url"),
    )
    return prioritise(out, now)


def facts_grouped(rows: DataFrame, most: int = MOST_FACTS) -> DataFrame:
    """(title, url, facts, first_pos): the distinct facts of rows (pos, title, url, fact) by title and url, in order of
    first sight and ``most`` at most.

    Distinct facts are found by an aggregate, so a group that holds many rows is reduced before it is gathered.
    """
    seen = rows.groupBy("title", "url", "fact").agg(F.min("pos").alias("pos"))
    listed = seen.groupBy("title", "url").agg(F.array_sort(F.collect_list(F.struct("pos", "fact"))).alias("xs"))
    return listed.select("title", "url", F.transform(F.slice("xs", 1, most), lambda x: x["fact"]).alias("facts"), F.get("xs", F.lit(0))["pos"].alias("first_pos"))

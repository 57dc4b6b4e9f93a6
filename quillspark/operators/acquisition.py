"""Evidence over time: append by content, latest version, what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_id", "content_hash"]


def append(history: DataFrame, fetched: DataFrame) -> DataFrame:
    """The fetched rows that are new evidence: content that the source had neither before nor earlier in this batch."""
    order = F.struct("fetched_at", "doc_id")
    first = fetched.groupBy(*KEY).agg(F.min_by(F.struct(*fetched.columns), order).alias("__row")).select("__row.*")
    return first.join(history.select(*KEY).distinct(), KEY, "left_anti")


def latest(evidence: DataFrame) -> DataFrame:
    """The last version of each source; partial aggregates combine before the shuffle."""
    return evidence.groupBy("source_id").agg(F.max_by(F.struct("fetched_at", "content_hash", "doc_id"), F.struct("fetched_at", "doc_id")).alias("__row")).select("source_id", "__row.*")


def late(history: DataFrame, fetched: DataFrame) -> DataFrame:
    """The fetched rows that are older than the last evidence their source has: they go into its history by append(), but
    latest() stays as it was. A source without evidence has no late rows."""
    last = history.groupBy("source_id").agg(F.max("fetched_at").alias("__last"))
    return fetched.join(last, "source_id").filter(F.col("fetched_at") < F.col("__last")).select(*fetched.columns)


def history(evidence: DataFrame, source_id: str) -> DataFrame:
    return evidence.filter(F.col("source_id") == source_id).orderBy("fetched_at", "doc_id")


def change_status(fetches: DataFrame) -> DataFrame:
    """Fetches with ``status``: FAILED; FETCHED for a source's first content; UNCHANGED if the content was seen before;
    else CHANGED. ``reverted``: seen before, but not the last content seen.

    First sights are found by an aggregate on (source, content), so each window row knows whether its content is new
    without a scan of the source's past. The last content before a row is its day's, by a window of a source's day, or
    else carried from the days before, by a window that has a row for each day: a source of many fetches is many tasks.
    """
    order = F.struct("fetched_at", "doc_id")
    good = F.col("http_status") < 400
    first = fetches.filter(good).groupBy(*KEY).agg(F.min(order).alias("first_seen"))
    start = fetches.filter(good).groupBy("source_id").agg(F.min(order).alias("source_start"))
    rows = fetches.join(first, KEY, "left").join(start, "source_id", "left")
    before = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    day = F.coalesce(F.col("fetched_at").cast("date"), F.lit("0001-01-01").cast("date"))
    days = fetches.groupBy(F.col("source_id").alias("__source"), day.alias("__date")).agg(F.max_by("content_hash", F.when(good, order)).alias("last"))
    days = days.select("__source", "__date", before("last", Window.partitionBy("__source").orderBy("__date")).alias("carried"))
    rows = rows.withColumn("__day", day)
    rows = rows.withColumn("inside", before(F.when(good, F.col("content_hash")), Window.partitionBy("source_id", "__day").orderBy("fetched_at", "doc_id")))
    rows = rows.join(days, F.col("source_id").eqNullSafe(F.col("__source")) & (F.col("__day") == F.col("__date")), "left").withColumn("previous", F.coalesce("inside", "carried"))
    status = F.when(~good, "FAILED").when(order == F.col("source_start"), "FETCHED").when(order > F.col("first_seen"), "UNCHANGED").otherwise("CHANGED")
    reverted = good & (order > F.col("first_seen")) & (F.col("previous") != F.col("content_hash"))
    return rows.select(*fetches.columns, status.alias("status"), F.coalesce(reverted, F.lit(False)).alias("reverted"))

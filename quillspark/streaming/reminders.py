"""Reminders and digests as one flow: clock ticks meet users and items, a stored ledger says what is still to be sent."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import at
from ..operators import notices
from ..sources.snapshots import Snapshots
from .state import KEYS

LEDGER = "id string, user_id {user}, item_id string, kind string, key string, status string, ts timestamp_ntz, delivered_at timestamp_ntz"
#: Fixed value: the item of a digest.
DIGEST_ITEM = "__WEEKLY_DIGEST__"
TICK = "tick"


def open_ledger(spark: SparkSession, path: str, user_type: str = "bigint", buckets: int = 64) -> Snapshots:
    """The ledger stored below ``path``, made empty if there is none."""
    ledger = Snapshots(spark, path)
    if not ledger.versions():
        ledger.create(spark.createDataFrame([], LEDGER.format(user=user_type)), KEYS, buckets)
    return ledger


def wanted(users: DataFrame, items: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """(user_id, item_id, kind, key) of all that a tick asks for: reminders, and digests while the gate is open."""
    due = notices.reminders_due(users, items, now, hours)
    digest = notices.weekly_digest(users, items, now).select("user_id", F.lit(DIGEST_ITEM).alias("item_id"), F.lit("WEEKLY_DIGEST").alias("kind"), "key")
    return due.unionByName(digest) if notices.digest_gate(now) else due


def tick(ledger: Snapshots, users: DataFrame, items: DataFrame, now: datetime, deliver: Callable[[DataFrame], DataFrame], lease_minutes: int | None = None, hours: int = 24) -> DataFrame | None:
    """What happens at ``now``: what is wanted and the ledger doesn't suppress is claimed, then given to ``deliver``, which
    returns (user_id, item_id, kind, key, status), then marked.

    Claims are committed with the tick before anything is sent. A tick that the ledger has, or that is older than its
    last one, is over: None. So a tick that dies before its claims are stored starts anew, and one that dies later sends
    nothing again; its claims stay PENDING, until their lease ends if there is one.
    """
    stamp = int(now.replace(tzinfo=timezone.utc).timestamp())
    if ledger.manifest()["marks"].get(TICK, stamp - 1) >= stamp:
        return None
    claims = notices.to_send(wanted(users, items, now, hours), ledger.read(), now, lease_minutes)
    claims = claims.withColumn("ts", at(now)).withColumn("delivered_at", F.lit(None).cast("timestamp_ntz"))
    folder = f"{ledger.path}/claims/{stamp}"  # computed once; a tick that starts anew writes it anew
    claims.write.mode("overwrite").parquet(folder)
    sent = ledger.spark.read.schema(ledger.read().schema).parquet(folder)
    ledger.upsert(sent, "ts", marks={TICK: stamp})
    marks = sent.drop("status", "delivered_at").join(deliver(sent).select(*KEYS, "status"), KEYS)
    ledger.upsert(marks.withColumn("delivered_at", at(now)), "ts")
    return sent


def reminder_sink(
    ledger: Snapshots, users: Callable[[], DataFrame], items: Callable[[], DataFrame], deliver: Callable[[DataFrame], DataFrame], lease_minutes: int | None = None, hours: int = 24
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over clock ticks (ts): each tick once, in order. ``users`` and ``items`` are read at each."""

    def run(batch: DataFrame, number: int) -> None:
        times = [r[0] for r in batch.select(F.col("ts").cast("timestamp_ntz")).filter("ts is not null").distinct().orderBy("ts").collect()]  # a clock's ticks
        for now in times:
            tick(ledger, users(), items(), now, deliver, lease_minutes, hours)

    return run

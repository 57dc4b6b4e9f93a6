"""Personal feeds and idempotent notifications, set-based over all users."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.temporal import at, hour_key, is_quiet, iso_week_key
from .trust import SCOPE

CATEGORIES = "array<string>"
PER_USER = 5
#: Stands for every category.
ANY = "*"


def categories(json_column: str = "categories_json") -> Column:
    """The list of a JSON text; malformed text is an empty list, which filters nothing."""
    return F.coalesce(F.from_json(json_column, CATEGORIES), F.array().cast(CATEGORIES))


def with_preferences(users: DataFrame, preferences: DataFrame) -> DataFrame:
    """Users with their row of ``preferences`` (user_id, ...); users without one are left out."""
    return users.join(preferences, "user_id")


def preferences_of(users: DataFrame, preferences: DataFrame, user_id) -> DataFrame:
    """The preferences of one user, or no row. The key reaches both scans."""
    mine = F.col("user_id") == F.lit(user_id)
    return with_preferences(users.filter(mine), preferences.filter(mine))


#: Where a notification's delivery may go from each status.
DELIVERY = {"PENDING": ("SENT", "FAILED", "SKIPPED"), "FAILED": ("PENDING",), "SKIPPED": ("PENDING",), "SENT": ()}


def delivery_status(marks: DataFrame, keys: list[str], order: list[str], status: str = "status") -> DataFrame:
    """(*keys, status, delivered_at): the status that a notification's marks lead to, from PENDING, in ``order``; a mark
    that its status doesn't allow changes nothing. delivered_at is the time (the first of ``order``) of the last mark that
    sent or failed. A notification has few marks, which one task gathers."""
    allowed = F.create_map(*[x for a, bs in DELIVERY.items() for x in (F.lit(a), F.array(*[F.lit(b) for b in bs]).cast("array<string>"))])
    walk = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(status).alias("s"))))
    kind = marks.schema[order[0]].dataType.simpleString()
    start = F.struct(F.lit("PENDING").alias("s"), F.lit(None).cast(kind).alias("t"))
    step = lambda acc, x: F.when(
        F.array_contains(allowed[acc["s"]], x["s"]), F.struct(x["s"].alias("s"), F.when(x["s"].isin("SENT", "FAILED"), x["o0"]).otherwise(acc["t"]).alias("t"))
    ).otherwise(acc)
    done = marks.filter(F.col(status).isNotNull()).groupBy(*keys).agg(F.aggregate(walk, start, step).alias("x"))
    return done.select(*keys, F.col("x.s").alias("status"), F.col("x.t").alias("delivered_at"))


def active_users(users: DataFrame) -> DataFrame:
    return users.filter("status = 'ACTIVE'")


def feed(users: DataFrame, items: DataFrame, order: list[Column], per_user: int) -> DataFrame:
    """The first ``per_user`` items of each user by ``order``, within the user's scope and categories.

    Users with equal preferences have equal feeds: items meet the distinct preferences, not the users, and only the
    few that remain meet the users. Items of one category and scope are seen by the same users, so no more than the
    first ``per_user`` of each go on; that limit is taken before the shuffle too.
    """
    prefs = users.select(*SCOPE, categories().alias("cats")).withColumn("pref", F.xxhash64(*SCOPE, F.array_sort("cats")))
    who = users.select("user_id", F.xxhash64(*SCOPE, F.array_sort(categories())).alias("pref"))
    names = F.when(F.size("cats") > 0, F.array_distinct("cats")).otherwise(F.array(F.lit(ANY)))
    asked = prefs.dropDuplicates(["pref"]).select("pref", *[F.col(c).alias(f"p_{c}") for c in SCOPE], F.explode(names).alias("category"))
    test = F.lit(True)
    for c in SCOPE:
        test = test & F.coalesce(F.col(f"p_{c}").isNull() | F.col(c).isNull() | (F.col(f"p_{c}") == F.col(c)), F.lit(True))
    items = items.unionByName(items.withColumn("category", F.lit(ANY)))  # an empty list filters nothing, a null category included
    first = items.withColumn("__n", F.row_number().over(Window.partitionBy("category", *SCOPE).orderBy(*order))).filter(F.col("__n") <= per_user).drop("__n")
    met = asked.join(first, "category").filter(test)
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("pref").orderBy(*order))).filter(F.col("rank") <= per_user)
    return who.join(ranked.select("pref", "rank", F.col("id").alias("item_id"), "due_at", "starts_at"), "pref").drop("pref")


def deliverable(users: DataFrame, flag: str, now: datetime) -> DataFrame:
    """Active users who have switched ``flag`` on, are not muted and have no quiet hours at ``now``."""
    clock = F.lit(now.strftime("%H:%M"))
    return active_users(users).filter(F.col(flag) & ~F.col("muted") & ~is_quiet(F.col("quiet_start"), F.col("quiet_end"), clock))


def reminders_due(users: DataFrame, items: DataFrame, now: datetime, hours: int = 24, per_user: int = PER_USER) -> DataFrame:
    """(user_id, item_id, kind, key): deadlines in (now, now + hours], the key being the hour they are due."""
    due = items.filter((F.col("due_at") > at(now)) & (F.col("due_at") <= at(now + timedelta(hours=hours))))
    rows = feed(deliverable(users, "reminders", now), due, [F.col("due_at"), F.col("id")], per_user)
    return rows.select("user_id", "item_id", F.lit("REMINDER").alias("kind"), hour_key(F.col("due_at")).alias("key"))


def digest_gate(now: datetime) -> bool:
    """Mondays from 03:00 to 03:14, UTC."""
    return now.weekday() == 0 and now.hour == 3 and now.minute < 15


def weekly_digest(users: DataFrame, items: DataFrame, now: datetime, days: int = 7, per_user: int = 10, force: bool = False) -> DataFrame:
    """(user_id, n_items, kind, key): one digest for each user with anything ahead who can be reached now, the key being the
    ISO week."""
    open_ = F.lit(bool(force or digest_gate(now)))
    when = F.coalesce("due_at", "starts_at")
    ahead = items.filter(open_ & (when >= at(now)) & (when <= at(now + timedelta(days=days))))
    rows = feed(deliverable(users, "digest", now), ahead, [when, F.col("id")], per_user)
    return rows.groupBy("user_id").agg(F.count("*").alias("n_items")).select("user_id", "n_items", F.lit("DIGEST").alias("kind"), iso_week_key(at(now)).alias("key"))


def to_send(wanted: DataFrame, ledger: DataFrame, now: datetime | None = None, lease_minutes: int | None = None) -> DataFrame:
    """Wanted notifications that the ledger (user_id, item_id, kind, key, status, ts) doesn't suppress: SENT and PENDING
    do, FAILED and SKIPPED are tried again. With a lease, a PENDING row older than it counts as failed."""
    keys = ["user_id", "item_id", "kind", "key"]
    held = F.col("status").isin("SENT", "PENDING")
    if now is not None and lease_minutes is not None:
        held = held & ~((F.col("status") == "PENDING") & (F.col("ts") < at(now - timedelta(minutes=lease_minutes))))
    done = ledger.filter(held).select(*keys)
    out = wanted.select(*keys).distinct().join(done, keys, "left_anti")
    return out.withColumn("id", ids.notification_id(F.col("user_id"), F.col("kind"), F.col("item_id"), F.col("key"))).withColumn("status", F.lit("PENDING"))

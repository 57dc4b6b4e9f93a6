"""Stored tables: what is written, which files it touches, failures and old readers; reminders on a stored ledger."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import notices, tables
from quillspark.plans.bridge import Tables
from quillspark.sources.snapshots import Conflict, Snapshots
from quillspark.streaming import reminders

KIND = "k bigint, g string, version int, state string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some(n, seed, keys=200):
    rng = random.Random(seed)
    out = {(rng.choice([None, *range(keys)]), rng.choice(["a", "b", None])): (rng.choice([None, 1, 2, 3]), f"s{rng.randrange(99)}") for _ in range(n)}
    return [(*k, *v) for k, v in out.items()]


@pytest.fixture
def stored(spark, tmp_path):
    base = spark.createDataFrame(some(150, 1), KIND)
    table = Snapshots(spark, f"file://{tmp_path}/table")
    assert table.create(base, ["k", "g"], buckets=16) == 0
    return table, base


def test_writes_equal_the_operators(spark, stored):
    table, want = stored
    for seed in range(2, 5):
        new = spark.createDataFrame(some(40, seed), KIND)
        table.upsert(new, "version", keep_first=("state",))
        want = spark.createDataFrame(rows_of(tables.upsert(want, new, ["k", "g"], "version", ("state",))), KIND)
        assert rows_of(table.read()) == rows_of(want)
    new = spark.createDataFrame(some(60, 7, keys=300), KIND)
    table.insert_if_absent(new, "version")
    want = spark.createDataFrame(rows_of(want.unionByName(tables.insert_if_absent(want, new, ["k", "g"], "version"))), KIND)
    assert rows_of(table.read()) == rows_of(want)
    part = spark.createDataFrame([(1, "a", "x"), (None, None, "y"), (900, "b", "z")], "k int, g string, state string")  # other types of keys are cast
    table.replace(part)
    want = spark.createDataFrame(rows_of(tables.replace(want, part.withColumn("k", F.col("k").cast("bigint")), ["k", "g"])), KIND)
    assert rows_of(table.read()) == rows_of(want)
    table.delete(part)
    assert rows_of(table.read()) == [r for r in rows_of(want) if (r[0], r[1]) not in {(1, "a"), (None, None), (900, "b")}]
    assert table.versions() == list(range(7))


def test_untouched_buckets_keep_their_files(spark, stored):
    table, _ = stored
    before = table.manifest()["folders"]
    table.upsert(spark.createDataFrame([(3, "a", 9, "new")], KIND), "version")
    after = table.manifest()["folders"]
    assert len([b for b in after if after[b] != before.get(b)]) == 1
    assert (3, "a", 9, "new") in rows_of(table.read())


def test_no_changes_no_version(spark, stored):
    table, base = stored
    assert table.upsert(base.limit(0), "version") == 0 and table.versions() == [0]
    assert table.upsert(base.limit(0), "version", marks={"batch": 4}) == 1
    assert table.manifest()["marks"] == {"batch": 4} and rows_of(table.read()) == rows_of(base)


def test_a_failed_write_leaves_the_version_before(spark, stored):
    table, base = stored
    broken = lambda old, new: old.unionByName(new).withColumn("state", F.raise_error(F.lit("disk is gone")).cast("string"))
    with pytest.raises(Exception, match="disk is gone"):
        table.rewrite(base, broken)
    assert table.versions() == [0] and rows_of(table.read()) == rows_of(base)
    table.upsert(spark.createDataFrame([(3, "a", 9, "new")], KIND), "version")
    table.expire(1)
    assert table.versions() == [1] and (3, "a", 9, "new") in rows_of(table.read())
    used = {f.split("/")[0] for f in table.manifest()["folders"].values()}
    assert set(table._names("data")) == used  # what the failed write left is gone


def test_old_readers_go_on(spark, stored):
    table, base = stored
    old = table.read()
    for seed in (11, 12):
        table.upsert(spark.createDataFrame(some(100, seed), KIND), "version")
    assert rows_of(old) == rows_of(base) == rows_of(table.read(0))
    table.expire(2)
    assert table.versions() == [1, 2] and table.read(1).count() > 0


def test_two_writers_of_one_version(spark, stored):
    table, base = stored
    other = Snapshots(spark, table.path)

    def meanwhile(old, new):
        other.upsert(spark.createDataFrame([(5, "a", 9, "theirs")], KIND), "version")
        return tables.upsert(old, new, ["k", "g"], "version")

    with pytest.raises(Conflict):
        table.rewrite(base, meanwhile)
    assert table.versions() == [0, 1] and (5, "a", 9, "theirs") in rows_of(table.read())
    with pytest.raises(Conflict):
        table.create(base, ["k"])


def test_a_bucket_can_become_empty(spark, stored):
    table, base = stored
    table.delete(base.select("g", "k"))
    assert table.manifest()["folders"] == {} and table.read().count() == 0 and table.read().columns == base.columns
    table.insert_if_absent(base, "version")
    assert rows_of(table.read()) == rows_of(base)


# Reminders.
MONDAY = datetime(1998, 6, 1, 3, 0)


@pytest.fixture
def people(spark, sf):
    users = Tables(spark, sf).users().cache()
    rows = [(f"info:{i}", "DEADLINE", MONDAY + timedelta(hours=h)) for i, h in enumerate((1, 5, 20, 23, 26, 50))]
    items = spark.createDataFrame(rows, "id string, category string, due_at timestamp_ntz")
    items = items.selectExpr("*", "CAST(NULL AS TIMESTAMP_NTZ) AS starts_at", "CAST(NULL AS STRING) AS program", "CAST(NULL AS STRING) AS branch", "CAST(NULL AS INT) AS year", "CAST(NULL AS INT) AS semester")
    return users, items.cache()


def all_sent(claims):
    return claims.withColumn("status", F.lit("SENT"))


def test_two_ticks_in_one_hour_send_once(spark, tmp_path, people):
    users, items = people
    ledger = reminders.open_ledger(spark, f"file://{tmp_path}/ledger", buckets=4)
    first = reminders.tick(ledger, users, items, MONDAY, all_sent)
    want = rows_of(reminders.wanted(users, items, MONDAY))
    assert rows_of(first.select("user_id", "item_id", "kind", "key")) == want
    assert {w[2] for w in want} == {"REMINDER", "WEEKLY_DIGEST"}
    assert reminders.tick(ledger, users, items, MONDAY + timedelta(minutes=10), all_sent).count() == 0
    assert {r.status for r in ledger.read().select("status").distinct().collect()} == {"SENT"}
    assert ledger.read().count() == len(want)


def test_failures_are_tried_again_and_skipped_ticks_are_over(spark, tmp_path, people):
    users, items = people
    ledger = reminders.open_ledger(spark, f"file://{tmp_path}/ledger", buckets=4)
    failing = lambda claims: claims.withColumn("status", F.expr("CASE WHEN user_id % 2 = 0 THEN 'FAILED' ELSE 'SENT' END"))
    even = {r.user_id for r in reminders.tick(ledger, users, items, MONDAY, failing).collect() if r.user_id % 2 == 0}
    assert even and reminders.tick(ledger, users, items, MONDAY, failing) is None
    assert reminders.tick(ledger, users, items, MONDAY - timedelta(hours=1), failing) is None
    again = reminders.tick(ledger, users, items, MONDAY + timedelta(minutes=5), all_sent)
    assert {r.user_id for r in again.collect()} == even


def test_a_tick_that_dies_sends_once(spark, tmp_path, people):
    users, items = people
    ledger = reminders.open_ledger(spark, f"file://{tmp_path}/ledger", buckets=4)
    sent = []

    def dies(claims):
        sent.append(claims.count())
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        reminders.tick(ledger, users, items, MONDAY, dies)
    assert reminders.tick(ledger, users, items, MONDAY, dies) is None and len(sent) == 1  # the batch runs again
    assert reminders.tick(ledger, users, items, MONDAY + timedelta(minutes=5), all_sent, lease_minutes=15).count() == 0
    late = reminders.tick(ledger, users, items, MONDAY + timedelta(minutes=16), all_sent, lease_minutes=15)
    assert late.filter("kind = 'REMINDER'").count() > 0  # the lease of the claims is over


def test_the_digest_leaves_out_who_cannot_be_reached(people):
    users, items = people
    quiet = MONDAY.strftime("%H:%M")
    got = {r.user_id for r in notices.weekly_digest(users, items, MONDAY).collect()}
    blocked = {r.user_id for r in users.filter(F.col("muted") | (F.col("quiet_start") <= quiet) | (F.col("quiet_end") > quiet)).collect()}
    assert got and blocked and not got & blocked

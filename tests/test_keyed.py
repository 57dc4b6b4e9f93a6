"""Keyed state: the same rows under any cut into batches, and those of a plain fold over all events in order."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest

from quillspark.operators import acquisition
from quillspark.streaming import keyed, state

START = datetime(2024, 3, 1)


def us(t):
    return None if t is None else int(t.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000


def run(spark, folder, rows, schema, batches, build, jitter, seed=0):
    """Write the rows as files in order of time, each at most ``jitter`` places off, and drain the stream built on them."""
    rng = random.Random(seed)
    late = sorted(range(len(rows)), key=lambda i: i + rng.uniform(0, jitter))
    cut = -(-len(rows) // batches)
    for b in range(batches):
        part = [rows[i] for i in late[b * cut : (b + 1) * cut]]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/{b:04d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    return sorted((tuple(r) for r in state.drain(build(stream), f"{folder}/out", f"{folder}/checkpoint").collect()), key=str)


def brute(fold, rows, delay, key, time, event, order):
    """The fold over each key's events that the watermark passes in the end."""
    end = us(max(r[time] for r in rows)) - us(datetime(1970, 1, 1) + delay)
    out = []
    for k in {r[key] for r in rows}:
        mine = [(us(r[time]), {c: us(r[c]) if isinstance(r[c], datetime) else r[c] for c in event}) for r in rows if r[key] == k]
        mine.sort(key=lambda x: (x[0], *[(x[1][c] is not None, x[1][c] or 0) for c in order]))

        class Table(dict):
            def put(self, a, b):
                self[a] = b

            def forget(self, before):
                for a in [a for a, b in self.items() if b < before]:
                    del self[a]

        _, rows_out, _ = keyed.settle(fold, None, mine, end, Table())
        out += [(k, START.fromtimestamp(o[0] / 1e6, timezone.utc).replace(tzinfo=None), *o[1:]) for o in rows_out]
    return sorted(out, key=str)


def claim_events(n=400):
    rng, rows = random.Random(1), []
    for i in range(n):
        t = START + timedelta(minutes=10 * i)
        until = t + timedelta(minutes=rng.choice([-30, 0, 45, 600, 3000])) if rng.random() < 0.4 else None
        rows.append({"claim_id": f"c{rng.randrange(8)}", "ts": t, "next_state": rng.choice(["VERIFIED", "VERIFIED", "CONFLICTING", "SUPERSEDED", "EXPIRED", "NONSENSE", None]), "effective_until": until})
    return rows


CLAIMS = "claim_id string, ts timestamp, next_state string, effective_until timestamp"


@pytest.mark.parametrize("batches", [1, 5, 12])
def test_claims_expire_under_any_cut(spark, tmp_path, batches):
    rows = claim_events()
    build = lambda s: keyed.claim_states(s, "6 hours")
    got = run(spark, tmp_path, [tuple(r.values()) for r in rows], CLAIMS, batches, build, jitter=20)
    want = brute(keyed.ClaimFold(), rows, timedelta(hours=6), "claim_id", "ts", ["next_state", "effective_until"], ["next_state", "effective_until"])
    assert got == want
    assert sum(g[4] == "expiry" for g in got) > 10  # rows that no event caused


def test_claim_rules():
    """By hand: expiry between events, an illegal move, an expiry that is past at once, a removed claim that can't expire."""
    fold, hour = keyed.ClaimFold(), 3_600_000_000
    steps = [(0, "VERIFIED", 2), (1, "EXPIRED", None), (3, "VERIFIED", 3), (5, "VERIFIED", 9), (6, "CONFLICTING", None), (7, "UNVERIFIED", None), (12, "REMOVED", 20), (13, "VERIFIED", None)]
    events = [(t * hour, {"next_state": s, "effective_until": None if u is None else u * hour}) for t, s, u in steps]
    _, out, taken = keyed.settle(fold, None, events, 100 * hour, {})
    assert taken == len(steps)
    assert [(t // hour, *rest) for t, *rest in out] == [
        (0, "VERIFIED", True, "event"), (1, "EXPIRED", True, "event"), (3, "VERIFIED", True, "event"), (3, "EXPIRED", True, "expiry"), (5, "VERIFIED", True, "event"),
        (6, "CONFLICTING", True, "event"), (7, "CONFLICTING", False, "event"), (9, "EXPIRED", True, "expiry"), (12, "REMOVED", True, "event"), (13, "REMOVED", False, "event"),
    ]


FETCHES = "source_id string, fetched_at timestamp, doc_id bigint, content_hash string, http_status int"


def fetches(n=300, codes=(200, 200, 200, 500)):
    rng = random.Random(2)
    return [{"source_id": f"s{rng.randrange(4)}", "fetched_at": START + timedelta(minutes=i), "doc_id": i, "content_hash": f"h{rng.randrange(12)}", "http_status": rng.choice(codes)} for i in range(n)]


@pytest.mark.parametrize("batches", [1, 8])
def test_changes_equal_the_batch_form(spark, tmp_path, batches):
    rows = fetches()
    got = run(spark, tmp_path, [tuple(r.values()) for r in rows], FETCHES, batches, lambda s: keyed.change_status(s, "30 minutes"), jitter=10)
    table = spark.createDataFrame([tuple(r.values()) for r in rows], FETCHES)
    end = rows[-1]["fetched_at"] - timedelta(minutes=30)
    want = sorted((r.source_id, r.fetched_at, r.doc_id, r.status, r.reverted) for r in acquisition.change_status(table).collect() if r.fetched_at < end)
    assert sorted(g[:5] for g in got) == want and {g[3] for g in got} == {"FAILED", "FETCHED", "CHANGED", "UNCHANGED"}


def test_not_modified_keeps_the_last_good(spark, tmp_path):
    codes = [("s", 304, None), ("s", 200, "a"), ("s", 304, None), ("s", 503, None), ("s", 200, "b"), ("s", 200, "a"), ("s", 200, None), (None, 200, "a"), ("z", 200, "q")]
    rows = [(s, START + timedelta(hours=i), i, h, code) for i, (s, code, h) in enumerate(codes)]
    got = run(spark, tmp_path, rows, FETCHES, 3, lambda s: keyed.change_status(s, "30 minutes"), jitter=0)
    assert [(g[2], *g[3:]) for g in sorted(got, key=lambda g: g[2])] == [
        (0, "FAILED", False, None), (1, "FETCHED", False, "a"), (2, "UNCHANGED", False, "a"), (3, "FAILED", False, "a"), (4, "CHANGED", False, "b"),
        (5, "UNCHANGED", True, "a"), (6, "FAILED", False, "a"), (7, "FETCHED", False, "a"),
    ]


def test_contents_are_forgotten(spark, tmp_path):
    rows = [("s", START + timedelta(days=d), i, h, 200) for i, (d, h) in enumerate([(0, "a"), (1, "b"), (2, "a"), (20, "b"), (21, "a"), (60, "b"), (99, "z")])]
    got = run(spark, tmp_path, rows, FETCHES, 7, lambda s: keyed.change_status(s, "1 hour", keep_days=18), jitter=0)
    assert [g[3] for g in sorted(got, key=lambda g: g[2])] == ["FETCHED", "CHANGED", "UNCHANGED", "CHANGED", "CHANGED", "CHANGED"]


def delivery_events(n=400):
    rng = random.Random(3)
    return [{"notification_id": f"n{rng.randrange(12)}", "ts": START + timedelta(minutes=i), "event_id": i, "mark": rng.choice(["CLAIM", "CLAIM", "SENT", "FAILED", "SKIPPED", "WHAT", None]) if i % 40 else "CLAIM"} for i in range(n)]


DELIVERIES = "notification_id string, ts timestamp, event_id bigint, mark string"


@pytest.mark.parametrize("batches", [1, 8])
def test_deliveries_under_any_cut(spark, tmp_path, batches):
    rows = [r for r in delivery_events() if r["mark"] != "SENT" or r["event_id"] % 3]
    build = lambda s: keyed.deliveries(s, "30 minutes", lease_minutes=20, keep_days=1)
    got = run(spark, tmp_path, [tuple(r.values()) for r in rows], DELIVERIES, batches, build, jitter=10)
    fold = keyed.DeliveryFold(20 * 60_000_000, keyed.DAY)
    assert got == brute(fold, rows, timedelta(minutes=30), "notification_id", "ts", ["event_id", "mark"], ["event_id", "mark"])
    assert sum(g[3] == "LAPSED" and g[2] is None for g in got) > 3


def test_lease_rules():
    fold, minute = keyed.DeliveryFold(15 * 60_000_000, 0), 60_000_000
    steps = [(0, "SENT"), (1, "CLAIM"), (2, "CLAIM"), (16, "CLAIM"), (20, "FAILED"), (21, "CLAIM"), (40, "SENT"), (41, "CLAIM"), (90, "CLAIM")]
    _, out, _ = keyed.settle(fold, None, [(t * minute, {"event_id": t, "mark": m}) for t, m in steps], 1000 * minute, {})
    assert [(t // minute, *rest) for t, *rest in out] == [
        (0, 0, None, 0, False), (1, 1, "PENDING", 1, True), (2, 2, "PENDING", 1, False), (16, None, "LAPSED", 1, True), (16, 16, "PENDING", 2, True), (20, 20, "FAILED", 2, True),
        (21, 21, "PENDING", 3, True), (36, None, "LAPSED", 3, True), (40, 40, "SENT", 3, True), (41, 41, "SENT", 3, False), (90, 90, "PENDING", 1, True), (105, None, "LAPSED", 1, True),
    ]


def test_a_batch_run_again_gives_the_same(spark, tmp_path):
    """The last batch's commit is taken back, as if the driver had died before it: the rows come out once."""
    import os

    rows = [tuple(r.values()) for r in delivery_events(120)]
    build = lambda s: keyed.deliveries(s, "10 minutes", lease_minutes=20)
    got = run(spark, tmp_path, rows, DELIVERIES, 4, build, jitter=0)
    commits = sorted((f for f in os.listdir(tmp_path / "checkpoint/commits") if f.isdigit()), key=int)
    for f in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(tmp_path / "checkpoint/commits" / f):
            os.remove(tmp_path / "checkpoint/commits" / f)
    stream = spark.readStream.schema(DELIVERIES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    again = state.drain(build(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint").collect()
    assert sorted((tuple(r) for r in again), key=str) == got and json.dumps(len(got))


def test_empty_stream(spark, tmp_path):
    assert run(spark, tmp_path, [("n", None, 1, "CLAIM")], DELIVERIES, 1, keyed.deliveries, jitter=0) == []

"""Keyed state in order of event time: claim states with expiry, change status of fetches, delivery with leases.

A fold says what one key's events do, one at a time. Events wait in the key's state until the watermark has passed them
and are then folded in order of time, with the alarms that the fold has set between them: the rows that come out are the
same however the stream is cut into batches, and an event that comes late, but within the delay, takes its place. What a
key holds is its events of the delay, its fold's value and, for change status, the contents it remembers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.claims import TRANSITIONS
from .state import use_rocksdb

DAY = 24 * 3600 * 1_000_000


class Fold:
    """What events do to one key. Times are microseconds; values are plain, as they are kept as JSON.

    ``start`` is the value of a key without events, ``step`` and ``ring`` give the value after an event and after an
    alarm, with the rows (time, ...) that come out; ``due`` is when the next alarm is, or None. ``seen`` is a table of
    text to number that the key keeps besides.
    """

    #: Columns that come out besides the key and ts.
    columns = ""

    def start(self) -> dict:
        raise NotImplementedError

    def step(self, value: dict, at: int, event: dict, seen) -> tuple[dict | None, list[tuple]]:
        raise NotImplementedError

    def due(self, value: dict) -> int | None:
        return None

    def ring(self, value: dict, at: int, seen) -> tuple[dict | None, list[tuple]]:
        return value, []


def settle(fold: Fold, value: dict | None, events: list[tuple[int, dict]], upto: int, seen) -> tuple[dict | None, list[tuple], int]:
    """Fold what lies before ``upto``: (value, rows that come out, number of events taken). At one time an alarm goes before
    events. ``events`` are in order; a value of None is a key that is forgotten."""
    out, taken = [], 0
    while True:
        alarm = None if value is None else fold.due(value)
        following = events[taken][0] if taken < len(events) and events[taken][0] < upto else None
        if alarm is not None and alarm < upto and (following is None or alarm <= following):
            value, rows = fold.ring(value, alarm, seen)
        elif following is not None:
            value, rows = fold.step(fold.start() if value is None else value, *events[taken], seen)
            taken += 1
        else:
            return value, out, taken
        out += rows


class Seen:
    """A key's map state as a table."""

    def __init__(self, state) -> None:
        self.state = state

    def get(self, k: str) -> int | None:
        return self.state.getValue((k,))[0] if self.state.containsKey((k,)) else None

    def put(self, k: str, v: int) -> None:
        self.state.updateValue((k,), (v,))

    def forget(self, before: int) -> None:
        for (k,), (v,) in list(self.state.iterator()):
            if v < before:
                self.state.removeKey((k,))


class InOrder(StatefulProcessor):
    """Runs a fold over each key's events (ts in microseconds, event as JSON)."""

    def __init__(self, fold: Fold, key: str, names: list[str], order: list[str]) -> None:
        self.fold, self.key, self.names, self.order = fold, key, names, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts bigint, event string")
        self.value = handle.getValueState("value", "value string")
        self.seen = Seen(handle.getMapState("seen", "k string", "at bigint"))

    def _alarm(self, at: int) -> None:
        """A timer that fires once the watermark has passed ``at``."""
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [x for f in rows for x in zip(f["us"].tolist(), f["event"].tolist(), strict=True)]
        self.waiting.appendList(events)
        self._alarm(min(at for at, _ in events))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [(at, json.loads(e)) for at, e in self.waiting.get()] if self.waiting.exists() else []
        held.sort(key=lambda x: (x[0], *[(x[1].get(c) is not None, x[1].get(c) if x[1].get(c) is not None else 0) for c in self.order]))
        value = json.loads(self.value.get()[0]) if self.value.exists() else None
        value, out, taken = settle(self.fold, value, held, timerValues.getCurrentWatermarkInMs() * 1000, self.seen)
        if value is None:
            self.value.clear()
        else:
            self.value.update((json.dumps(value),))
        if taken == len(held):
            self.waiting.clear()
        else:
            self.waiting.put([(at, json.dumps(e)) for at, e in held[taken:]])
        times = [held[taken][0]] if taken < len(held) else []
        alarm = None if value is None else self.fold.due(value)
        times += [] if alarm is None else [alarm]
        if times:
            self._alarm(min(times))
        if out:
            yield pd.DataFrame({self.key: [key[0]] * len(out), "ts": pd.to_datetime([o[0] for o in out], unit="us")} | {n: [o[i + 1] for o in out] for i, n in enumerate(self.names)})

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, fold: Fold, key: str, time: str, event: list[str], order: list[str], delay: str) -> DataFrame:
    """(key, ts, columns of the fold): ``fold`` over each key's events in order of ``time``, then ``order``, which are
    columns of ``event``. Events older than the watermark, which follows the latest one at ``delay``, are dropped, as
    are those without a time; a null key is a key. Timestamps of ``event`` are given to the fold in microseconds."""
    use_rocksdb(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    plain = [F.unix_micros(c).alias(c) if stream.schema[c].dataType.typeName() == "timestamp" else F.col(c) for c in event]
    rows = stream.filter(F.col(time).isNotNull()).withWatermark(time, delay)
    rows = rows.select(key, time, F.unix_micros(time).alias("us"), F.to_json(F.struct(*plain)).alias("event"))
    names = [c.split(" ")[0] for c in fold.columns.split(", ")]
    return rows.groupBy(key).transformWithStateInPandas(InOrder(fold, key, names, order), f"{key} {kind}, ts timestamp, {fold.columns}", "append", "eventTime")


class ClaimFold(Fold):
    """A claim's state. An event moves it, if the move is legal; one that gives effective_until sets when the claim expires,
    that time being past at once if it lies before the event. An expiry that finds a claim which can't expire has no row."""

    columns = "state string, accepted boolean, cause string"
    legal = {k: (*v, k) for k, v in TRANSITIONS.items()}

    def start(self) -> dict:
        return {"state": "UNVERIFIED", "until": None}

    def step(self, value: dict, at: int, event: dict, seen) -> tuple[dict, list[tuple]]:
        good = event.get("next_state") in self.legal[value["state"]]
        until = event.get("effective_until")
        value = {"state": event["next_state"] if good else value["state"], "until": value["until"] if until is None else max(until, at)}
        return value, [(at, value["state"], good, "event")]

    def due(self, value: dict) -> int | None:
        return value["until"]

    def ring(self, value: dict, at: int, seen) -> tuple[dict, list[tuple]]:
        expires = value["state"] != "EXPIRED" and "EXPIRED" in self.legal[value["state"]]
        value = {"state": "EXPIRED" if expires else value["state"], "until": None}
        return value, [(at, "EXPIRED", True, "expiry")] if expires else []


def claim_states(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """(claim_id, ts, state, accepted, cause) of events (claim_id, ts, next_state, effective_until): the state after each
    event and each expiry. Events of one time go by next_state. An illegal move leaves the state and is not accepted."""
    return in_order(stream, ClaimFold(), "claim_id", "ts", ["next_state", "effective_until"], ["next_state", "effective_until"], delay)


class ChangeFold(Fold):
    """What a fetch found: FAILED, UNCHANGED, FETCHED for a source's first content or CHANGED. A 304 leaves all as it was, and
    fails a source that has shown no content yet. A content not seen for ``keep`` microseconds is new again."""

    columns = "doc_id bigint, status string, reverted boolean, last_good string"

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def start(self) -> dict:
        return {"last": None, "purge": None}

    def step(self, value: dict, at: int, event: dict, seen) -> tuple[dict, list[tuple]]:
        code, content, last = event.get("http_status"), event.get("content_hash"), value["last"]
        if code is None or code >= 400 or (code == 304 and last is None) or (code != 304 and content is None):
            return value, [(at, event.get("doc_id"), "FAILED", False, last)]
        content = last if code == 304 else content
        before = seen.get(content)
        known = before is not None and at - before <= self.keep
        seen.put(content, at)
        status = "UNCHANGED" if known else "FETCHED" if last is None else "CHANGED"
        return {"last": content, "purge": value["purge"] or at + self.keep}, [(at, event.get("doc_id"), status, known and content != last, content)]

    def due(self, value: dict) -> int | None:
        return value["purge"]

    def ring(self, value: dict, at: int, seen) -> tuple[dict, list[tuple]]:
        seen.forget(at - self.keep)
        return {"last": value["last"], "purge": at + self.keep if seen.get(value["last"]) is not None else None}, []


def change_status(stream: DataFrame, delay: str = "1 day", keep_days: int = 3650) -> DataFrame:
    """(source_id, ts, doc_id, status, reverted, last_good) of fetches (source_id, fetched_at, doc_id, content_hash,
    http_status): what each found, whether its content was one seen before but not the last, and the hash of the source's
    last good content after it, which failures and 304s keep."""
    return in_order(stream, ChangeFold(keep_days * DAY), "source_id", "fetched_at", ["doc_id", "content_hash", "http_status"], ["doc_id"], delay)


class DeliveryFold(Fold):
    """A notification's delivery. CLAIM takes it if it is new, failed, skipped or lapsed; SENT, FAILED and SKIPPED settle a claim
    that is pending, and SENT also one that has lapsed, so that it isn't sent again. A pending claim lapses when its lease
    is over. What has not changed for ``keep`` is forgotten."""

    columns = "event_id bigint, status string, attempt int, accepted boolean"

    def __init__(self, lease: int, keep: int) -> None:
        self.lease, self.keep = lease, max(lease, keep)

    def start(self) -> dict:
        return {"status": None, "at": None, "n": 0}

    def step(self, value: dict, at: int, event: dict, seen) -> tuple[dict, list[tuple]]:
        mark, now = event.get("mark"), value["status"]
        good = now in (None, "FAILED", "SKIPPED", "LAPSED") if mark == "CLAIM" else mark in ("SENT", "FAILED", "SKIPPED") and (now == "PENDING" or (now, mark) == ("LAPSED", "SENT"))
        if good:
            value = {"status": "PENDING" if mark == "CLAIM" else mark, "at": at, "n": value["n"] + (mark == "CLAIM")}
        elif now is None:
            return None, [(at, event.get("event_id"), None, 0, False)]
        return value, [(at, event.get("event_id"), value["status"], value["n"], good)]

    def due(self, value: dict) -> int | None:
        return value["at"] + (self.lease if value["status"] == "PENDING" else self.keep)

    def ring(self, value: dict, at: int, seen) -> tuple[dict | None, list[tuple]]:
        if value["status"] == "PENDING":
            return {**value, "status": "LAPSED", "at": at}, [(at, None, "LAPSED", value["n"], True)]
        return None, []


def deliveries(stream: DataFrame, delay: str = "1 hour", lease_minutes: int = 15, keep_days: int = 30) -> DataFrame:
    """(notification_id, ts, event_id, status, attempt, accepted) of events (notification_id, ts, event_id, mark): the status
    after each mark, which attempt it is of, and whether the mark counted; a row without event_id where a lease ran out.
    Events of one time go by event_id. State is one small value for each notification of the last ``keep_days``."""
    fold = DeliveryFold(lease_minutes * 60_000_000, keep_days * DAY)
    return in_order(stream, fold, "notification_id", "ts", ["event_id", "mark"], ["event_id", "mark"], delay)

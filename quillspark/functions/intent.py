"""A natural question as a category, a time window and remaining words. Runs on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from .temporal import day_window, week_window

# Fixed values.
ALIASES = {
    "deadline": "DEADLINE", "deadlines": "DEADLINE", "exam": "EXAM", "exams": "EXAM", "examination": "EXAM", "fee": "FEES", "fees": "FEES", "registration": "REGISTRATION", "registrations": "REGISTRATION",
    "notice": "NOTICE", "notices": "NOTICE", "circular": "NOTICE", "circulars": "NOTICE", "event": "EVENT", "events": "EVENT", "holiday": "HOLIDAY", "holidays": "HOLIDAY", "calendar": "CALENDAR", "calendars": "CALENDAR",
}
STOP_WORDS = frozenset(
    "a an and are at be by for from in is me my of on or please show tell the to what when which with this week next today tomorrow upcoming soon important near due date".split()
)
CATEGORIES = ("DEADLINE", "EXAM", "FEES", "REGISTRATION", "NOTICE", "EVENT", "HOLIDAY", "CALENDAR")


@dataclass(frozen=True)
class Intent:
    words: tuple[str, ...]
    category: str | None = None
    start: datetime | None = None
    end: datetime | None = None

    @property
    def by_time(self) -> bool:
        return self.start is not None


def parse_intent(question: str, now: datetime) -> Intent:
    """The first alias is the category; of the phrases today, tomorrow, next week, this week the first one present, in
    that order, is the window; stop words and aliases are left out of the words."""
    text = question.lower().strip()
    words = text.split()
    category = next((ALIASES[w] for w in words if w in ALIASES), None)
    windows = (("today", lambda: day_window(now)), ("tomorrow", lambda: day_window(now, 1)), ("next week", lambda: week_window(now, 1)), ("this week", lambda: week_window(now)))
    start, end = next((f() for phrase, f in windows if phrase in text), (None, None))
    return Intent(tuple(w for w in words if w not in STOP_WORDS and w not in ALIASES), category, start, end)


def parse_categories(text: str) -> list[str]:
    """``ALL`` or a comma list; unknown names are an error; [] stands for no filter."""
    names = list(dict.fromkeys(x.strip().upper() for x in text.split(",") if x.strip()))
    if names == ["ALL"]:
        return list(CATEGORIES)
    if unknown := [n for n in names if n not in CATEGORIES]:
        raise ValueError(f"unknown categories: {unknown}")
    return names


def split_command(text: str) -> tuple[str, str]:
    """``/name@bot rest`` as (name, rest)."""
    head, _, rest = text.strip().partition(" ")
    return head.lstrip("/").split("@")[0].lower(), rest.strip()

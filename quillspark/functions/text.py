"""Text to structure: normal forms, dates, deadlines, events, calendar rows, categories, scores.

All are Column expressions; generators give arrays of structs, which callers explode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, terms and confidences that results depend on.
MONTHS = (
    "january february march april may june july august september october november december".split(),
    "jan feb mar apr may jun jul aug sep oct nov dec".split(),
)
DEADLINE_TERMS = ("deadline", "due", "last date", "closes", "closing date", "submit by", "submission")
EVENT_TERMS = ("event", "seminar", "workshop", "webinar", "orientation", "fest", "conference", "ceremony")
CATEGORY_TERMS = (
    ("EXAMINATION", ("exam", "examination", "semester end", "date sheet", "admit card")),
    ("FEES", ("fee", "fees", "payment", "tuition", "scholarship fee")),
    ("REGISTRATION", ("registration", "register", "enrolment", "enrollment", "form submission")),
    ("HOLIDAY", ("holiday", "holidays", "vacation", "closed")),
    ("EVENT", EVENT_TERMS),
    ("ACADEMIC", ("academic calendar", "semester", "session", "academic year", "classes")),
    ("GENERAL", ("notice", "circular", "notification", "information")),
)
CATEGORY_MAP = {"ACADEMIC": "CALENDAR", "EXAMINATION": "EXAM", "FEES": "FEES", "REGISTRATION": "REGISTRATION", "EVENT": "EVENT", "HOLIDAY": "HOLIDAY", "GENERAL": "NOTICE", "UNKNOWN": "NOTICE"}
#: Words without weight in submissions. Callers add their organisation's own name.
STOP_WORDS = ("a", "an", "and", "are", "be", "by", "for", "from", "in", "is", "of", "on", "or", "that", "the", "this", "to", "with", "notice", "please")
DATE_CONFIDENCE, ISO_CONFIDENCE, DEADLINE_CONFIDENCE, EVENT_CONFIDENCE = 0.95, 0.99, 0.88, 0.84
RANGE_CONFIDENCE, SINGLE_CONFIDENCE = 0.94, 0.82

DAY_FIRST = r"\b([0-9]{1,2})[\s./-]+([A-Za-z]{3,9}|[0-9]{1,2})[\s./-]+(20[0-9]{2})\b"
ISO_DATE = r"\b20[0-9]{2}-[0-9]{2}-[0-9]{2}\b"
SPACES = r"(?U)\s+"
DATE_TYPE = "array<struct<value:timestamp_ntz,source_text:string,confidence:double>>"


def casefold(text: Column) -> Column:
    """Lower case with sharp s as ss: what case folding does to the letters of western European texts."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize_text(text: Column) -> Column:
    """White space inside lines becomes one blank; lines without anything else go."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.trim(F.regexp_replace(x, SPACES, " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def tokens(text: Column) -> Column:
    """Runs of ``a-z0-9`` in order, with repeats."""
    return F.regexp_extract_all(casefold(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_statement(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def fingerprint(text: Column) -> Column:
    return F.sha2(normalize_statement(text), 256)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def content_tokens(text: Column, extra_stop_words: tuple[str, ...] = ()) -> Column:
    """Distinct tokens of two characters or more that are no stop words; plain lower case, a dotted capital I too."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS + tuple(extra_stop_words)])
    plain = F.array_distinct(F.regexp_extract_all(F.lower(F.translate(text, "\u0130", "i")), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.array_except(F.filter(plain, lambda x: F.length(x) >= 2), stop)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; two empty ones are equal, one empty one shares nothing."""
    both = F.array_size(F.array_intersect(a, b))
    union = F.array_size(a) + F.array_size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / F.greatest(union, F.lit(1)))


def match_score(query: Column, candidate: Column, date_hit: Column) -> Column:
    """0.55 Jaccard + 0.30 coverage of the query + 0.15 for a shared date, at most 1; 0 if a side is empty."""
    both = F.array_size(F.array_intersect(query, candidate))
    size = F.array_size(query)
    score = F.least(F.lit(1.0), 0.55 * jaccard(query, candidate) + 0.30 * both / F.greatest(size, F.lit(1)) + F.when(date_hit, 0.15).otherwise(0.0))
    return F.when((size == 0) | (F.array_size(candidate) == 0), 0.0).otherwise(score)


def _month(name: Column) -> Column:
    known = {m: i + 1 for names in MONTHS for i, m in enumerate(names)} | {"sept": 9}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.expr("CAST(NULL AS INT)"))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.to_timestamp_ntz(F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd").cast("string"))


def extract_dates(text: Column) -> Column:
    """Dates in order of (value, source text), each spelling once; dates that don't exist are left out."""

    def day_first(m: Column) -> Column:
        part = lambda k: F.regexp_extract(m, DAY_FIRST, k)
        month = F.when(part(2).rlike("^[0-9]"), part(2)).otherwise(_month(part(2)).cast("string"))
        value = F.when(month.isNotNull(), _date(part(3), month, part(1)))
        return F.struct(value.alias("value"), m.alias("source_text"), F.lit(DATE_CONFIDENCE).alias("confidence"))

    def iso(m: Column) -> Column:
        return F.struct(_date(F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2)).alias("value"), m.alias("source_text"), F.lit(ISO_CONFIDENCE).alias("confidence"))

    found = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), f) for p, f in ((DAY_FIRST, day_first), (ISO_DATE, iso))])
    return F.array_sort(F.array_distinct(F.filter(found, lambda d: d["value"].isNotNull())))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` made once however often f uses it: a list of one gives it a name."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first_by(rows: Column, key: Callable[[Column], Column]) -> Column:
    """An array's elements, in their order, without those whose key an earlier one has.

    Equal keys come together by a sort, so the work is that of a sort, not of a comparison of each with each.
    """
    keyed = F.array_sort(F.transform(rows, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"), x.alias("x"))))
    opens = lambda s: F.filter(s, lambda y, j: (j == 0) | ~F.get(s, j - 1)["key"].eqNullSafe(y["key"]))
    firsts = once(keyed, opens)
    return F.transform(F.array_sort(F.transform(firsts, lambda y: F.struct(y["i"], y["x"]))), lambda y: y["x"])


def has_term(text: Column, terms: tuple[str, ...]) -> Column:
    low, test = F.lower(text), F.lit(False)
    for t in terms:
        test = test | low.contains(t)
    return test


def sentences(text: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` before white space, and at line feeds."""
    return F.split(F.regexp_replace(text, r"(?U)([.!?])\s+", "$1\n"), "\n")


def title_of(sentence: Column, default: str) -> Column:
    """A sentence as a title of at most 180 characters."""
    t = F.regexp_replace(F.regexp_replace(sentence, SPACES, " "), r"^[ .:-]+|[ .:-]+$", "")
    t = F.when(F.length(t) > 180, F.concat(F.rtrim(F.substring(t, 1, 177)), F.lit("..."))).otherwise(t)
    return F.when(t == "", default).otherwise(t)


def _statements(text: Column, terms: tuple[str, ...], confidence: float, first_only: bool, default: str) -> Column:
    def of(s: Column) -> Column:
        dates = extract_dates(s)
        dates = F.slice(dates, 1, 1) if first_only else dates
        return F.transform(dates, lambda d: F.struct(title_of(s, default).alias("title"), d["value"].alias("at"), F.trim(s).alias("source_text"), F.lit(confidence).alias("confidence")))

    found = F.flatten(F.transform(F.filter(sentences(text), lambda s: has_term(s, terms)), of))
    return first_by(found, lambda x: F.struct(x["at"], x["title"]))


def extract_deadlines(text: Column, default_title: str = "Deadline") -> Column:
    """One row for each date of each sentence with a deadline term."""
    return _statements(text, DEADLINE_TERMS, DEADLINE_CONFIDENCE, False, default_title)


def extract_events(text: Column, default_title: str = "Event") -> Column:
    """One row for the earliest date of each sentence with an event term."""
    return _statements(text, EVENT_TERMS, EVENT_CONFIDENCE, True, default_title)


def count_of(text: Column, term: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def classify_notice(text: Column, title: Column | None = None) -> Column:
    """The category whose terms occur most; the first declared wins a tie; without any term UNKNOWN."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")) if title is not None else F.lit(""), text))
    scores = [(name, sum((count_of(hay, t) for t in terms[1:]), count_of(hay, terms[0]))) for name, terms in CATEGORY_TERMS]
    best = F.greatest(*[s for _, s in scores])
    out = F.when(best == 0, "UNKNOWN")
    for name, s in scores:
        out = out.when(s == best, name)
    return out


def map_category(category: Column) -> Column:
    """The item category of a notice category; null for unknown ones, which assert_mapped() turns into an error."""
    table = F.create_map(*[F.lit(x) for pair in CATEGORY_MAP.items() for x in pair])
    return F.try_element_at(table, F.upper(category))


def assert_mapped(category: Column) -> Column:
    return F.coalesce(map_category(category), F.raise_error(F.concat(F.lit("unsupported notice category: "), F.coalesce(category, F.lit("null")))))


def calendar_label(line: Column, dates: Column) -> Column:
    label = F.aggregate(dates, line, lambda acc, d: F.replace(acc, d["source_text"], F.lit(" ")))
    label = F.regexp_replace(F.regexp_replace(label, r"(?i)\b(?:to|through|until)\b", " "), SPACES, " ")
    label = F.regexp_replace(label, r"^[ :\-|\t–—]+|[ :\-|\t–—]+$", "")
    return F.when(label == "", "Academic calendar entry").otherwise(label)


def calendar_lines(text: Column) -> Column:
    """Rows (start, end, label, source_text, confidence) of the lines that have a date, in the order of the lines."""

    def row(line: Column, dates: Column) -> Column:
        two = F.array_size(dates) > 1
        return F.struct(
            F.get(dates, F.lit(0))["value"].alias("start"), F.get(dates, F.lit(1))["value"].alias("end"), calendar_label(line, dates).alias("label"),
            line.alias("source_text"), F.when(two, RANGE_CONFIDENCE).otherwise(SINGLE_CONFIDENCE).alias("confidence"),
        )

    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = F.transform(lines, lambda line: once(extract_dates(line), lambda dates: row(line, dates)))
    return F.filter(rows, lambda r: r["start"].isNotNull())


# Fixed value: spellings of dates that count as they stand.
RAW_DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}|[A-Za-z]{3,9}\s+\d{1,2},\s+\d{4})\b"


def date_tokens(text: Column) -> Column:
    """What a text names as dates, for shared-date tests: ISO dates, then spellings in lower case, which may have
    two-digit years, the month first or no valid date; each once."""
    known = F.transform(extract_dates(text), lambda d: F.date_format(d["value"], "yyyy-MM-dd"))
    return F.array_distinct(F.concat(known, F.transform(F.regexp_extract_all(text, F.lit(RAW_DATE), F.lit(0)), F.lower)))


def slash_dates(text: Column) -> Column:
    """Dates spelt day/month/year, with dashes too, as ``yyyy-mm-dd``; two-digit years are of this century."""
    pattern = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b"

    def of(m: Column) -> Column:
        day, month, year = (F.regexp_extract(m, pattern, k) for k in (1, 2, 3))
        return F.concat_ws("-", F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))

    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of))


def quality_level(length: Column, medium: float = 0.80) -> Column:
    """struct(level, score) by length: HTML has 0.80 for medium, PDF 0.78."""
    pair = lambda level, score: F.struct(F.lit(level).alias("level"), F.lit(score).alias("score"))
    return F.when(length >= 400, pair("HIGH", 0.98)).when(length >= 100, pair("MEDIUM", medium)).when(length > 0, pair("LOW", 0.45)).otherwise(pair("FAILED", 0.0))


def url_canonical(url: Column) -> Column:
    """Scheme and host in lower case, an empty path as ``/``, no fragment."""
    bare = F.substring_index(url, "#", 1)
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    rest = F.substr(bare, F.length(head) + 1)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(head != "", F.concat(F.lower(head), path)).otherwise(bare)


def url_identity(url: Column) -> Column:
    return F.regexp_replace(url_canonical(url), "/+$", "")


def calendar_dates(start: Column, end: Column, label: Column, source_text: Column, confidence: Column) -> Column:
    """The dates of a calendar row: its start, and its end, if it has one, under the label with ``end``."""
    one = lambda value, name: F.struct(value.alias("value"), name.alias("label"), source_text.alias("source_text"), confidence.alias("confidence"))
    return F.filter(F.array(one(start, label), one(end, F.concat(label, F.lit(" end")))), lambda d: d["value"].isNotNull())

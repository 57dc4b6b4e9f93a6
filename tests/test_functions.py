"""Example values for functions, by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import html, ids, intent, render, temporal, text, vectors
from quillspark.functions.temporal import at


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def dates(spark, s):
    return [(d.value.strftime("%Y-%m-%d"), d.source_text) for d in one(spark, text.extract_dates(F.lit(s)))]


def test_dates(spark):
    assert [d for d, _ in dates(spark, "20 September 2026; 31 February 2026; 2026-10-01")] == ["2026-09-20", "2026-10-01"]
    spellings = "1 January 2026, 2 Jan 2026, 3/3/2026, 4.4.2026 and 05-05-2026"
    assert [d for d, _ in dates(spark, spellings)] == ["2026-01-01", "2026-01-02", "2026-03-03", "2026-04-04", "2026-05-05"]
    for none in ("20 September, 2026", "September 20, 2026", "1st October 2026", "2026-9-1", "2026-10-15T10:00", "3 Foo 2026", "1 May 1999", ""):
        assert dates(spark, none) == []
    assert dates(spark, "10-12 October 2026") == [("2026-10-12", "12 October 2026")]
    assert len(dates(spark, "2 Sept 2026 2 Sept 2026 2 sept 2026")) == 2


def test_deadlines_and_events(spark):
    got = one(spark, text.extract_deadlines(F.lit("The exam form closes on 20 September 2026. Classes start on 1 October 2026.")))
    assert [(d.title, d["at"].strftime("%Y-%m-%d")) for d in got] == [("The exam form closes on 20 September 2026", "2026-09-20")]
    long = "Submission due " + "word " * 60 + "5 May 2026"
    assert one(spark, text.extract_deadlines(F.lit(long)))[0].title.endswith("...")
    events = one(spark, text.extract_events(F.lit("Seminar from 3 May 2026 to 1 May 2026")))
    assert len(events) == 1 and events[0]["at"].day == 1


@pytest.mark.parametrize(
    "said, category",
    [("Exam date sheet", "EXAMINATION"), ("Tuition payment", "FEES"), ("Register now", "REGISTRATION"), ("Vacation", "HOLIDAY"), ("Workshop", "EVENT"), ("Classes and session", "ACADEMIC"), ("A circular", "GENERAL"), ("Hello", "UNKNOWN"), ("exam fee", "EXAMINATION")],
)
def test_categories(spark, said, category):
    assert one(spark, text.classify_notice(F.lit(said))) == category


def test_category_map(spark):
    assert one(spark, text.map_category(F.lit("academic"))) == "CALENDAR" and one(spark, text.map_category(F.lit("?"))) is None
    with pytest.raises(Exception, match="unsupported notice category"):
        one(spark, text.assert_mapped(F.lit("?")))


def test_calendar_lines(spark):
    rows = one(spark, text.calendar_lines(F.lit("Classes 1 July 2026 to 30 November 2026\n15 August 2026 - Holiday\n15 August 2026 - Holiday\nno date")))
    assert [(r.label, r.start.day, r.end and r.end.day, r.confidence) for r in rows][:2] == [("Classes", 1, 30, 0.94), ("Holiday", 15, None, 0.82)] and len(rows) == 3


def test_normal_forms(spark):
    assert one(spark, text.normalize_text(F.lit(" a \t b \n\n c d "))) == "a b\nc d"
    assert one(spark, text.normalize_statement(F.lit("Straße: It's DUE!"))) == "strasse it s due"
    empty, a, b = F.array().cast("array<string>"), F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    assert one(spark, text.jaccard(empty, empty)) == 1.0 and one(spark, text.jaccard(a, empty)) == 0.0 and abs(one(spark, text.jaccard(a, b)) - 1 / 3) < 1e-9
    assert one(spark, text.match_score(a, a, F.lit(True))) == 1.0 and one(spark, text.match_score(empty, a, F.lit(True))) == 0.0
    assert one(spark, text.content_tokens(F.lit("Please THE exam of a 1 x2 acme"), ("acme",))) == ["exam", "x2"]


def test_urls(spark):
    for url, canonical in (("HTTPS://Example.ORG", "https://example.org/"), ("https://a.org/X?q#f", "https://a.org/X?q"), ("http://A.org?q", "http://a.org/?q"), ("not a url", "not a url")):
        assert one(spark, text.url_canonical(F.lit(url))) == canonical
    assert one(spark, text.url_identity(F.lit("https://a.org/x/"))) == one(spark, text.url_identity(F.lit("https://A.org/x#y")))


def test_quality(spark):
    assert [one(spark, text.quality_level(F.lit(n))).level for n in (400, 399, 99, 0)] == ["HIGH", "MEDIUM", "LOW", "FAILED"]


def test_ids(spark):
    assert one(spark, ids.sha(F.lit("hello"))).startswith("2cf24dba")
    ab, ba = (one(spark, ids.relationship_id(F.lit("SIMILAR"), F.lit(x), F.lit(y))) for x, y in ("ab", "ba"))
    assert ab == ba and ab.startswith("rel:") and len(ab) == 36


def test_clock(spark):
    assert temporal.week_window(datetime(2026, 10, 1, 12)) == (datetime(2026, 9, 28), datetime(2026, 10, 5))
    assert temporal.day_window(datetime(2026, 10, 1, 12), 1) == (datetime(2026, 10, 2), datetime(2026, 10, 3))
    assert one(spark, temporal.iso_week_key(at(datetime(2027, 1, 1)))) == "2026-W53"
    for a, b, now, quiet in (("22:00", "07:00", "23:30", True), ("22:00", "07:00", "07:00", False), ("09:00", "10:00", "09:00", True), ("09:00", "09:00", "12:00", True), (None, "07:00", "01:00", False)):
        assert one(spark, temporal.is_quiet(F.lit(a), F.lit(b), F.lit(now))) is quiet
    assert [one(spark, temporal.is_clock_time(F.lit(x))) for x in ("23:59", "24:00", "7:00", None)] == [True, False, False, False]


def test_intents():
    got = intent.parse_intent("show my exam forms this week", datetime(2026, 10, 1, 9))
    assert (got.category, got.words, got.start, got.end) == ("EXAM", ("forms",), datetime(2026, 9, 28), datetime(2026, 10, 5))
    assert intent.parse_intent("exams?", datetime(2026, 10, 1)).category is None
    assert intent.parse_intent("today or tomorrow", datetime(2026, 10, 1)).start == datetime(2026, 10, 1)
    assert intent.parse_categories("exam, FEES,exam") == ["EXAM", "FEES"] and len(intent.parse_categories("all")) == 8
    with pytest.raises(ValueError):
        intent.parse_categories("nope")
    assert intent.split_command("/Search@bot exam forms") == ("search", "exam forms")


def test_cosine(spark):
    v = lambda *xs: F.array(*[F.lit(float(x)) for x in xs]) if xs else F.array().cast("array<double>")
    assert [one(spark, vectors.cosine(*p)) for p in ((v(1, 0), v(1, 0)), (v(1, 0), v(0, 1)), (v(), v()), (v(1), v(1, 2)), (v(0, 0), v(1, 1)))] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_answers(spark):
    e = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, render.cites_only(F.lit("yes"), F.array(F.lit("a")), e)) and not one(spark, render.cites_only(F.lit("yes"), F.array(F.lit("z")), e))
    assert not one(spark, render.cites_only(F.lit(" "), F.array(F.lit("a")), e)) and not one(spark, render.cites_only(F.lit("x"), F.array().cast("array<string>"), e))
    assert one(spark, render.json_object(F.lit('```json\n{"a": {"b": 1}}\n```'))) == '{"a": {"b": 1}}' and one(spark, render.json_object(F.lit("{nope"))) is None
    assert one(spark, render.ics_escape(F.lit("a;b,c\\d\ne"))) == "a\\;b\\,c\\\\d\\ne"
    assert one(spark, render.html_escape(F.lit('<a href="x">&'))) == '&lt;a href="x"&gt;&amp;'
    assert one(spark, render.html_escape(F.lit('<a href="x">&'), quotes=True)) == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert one(spark, render.html_escape(F.lit("<a&b>"))) == "&lt;a&amp;b&gt;"
    assert one(spark, render.file_name(F.lit("a b/ü.pdf"))) == "a_b__.pdf"


@pytest.mark.parametrize("most", [5, 9])
@pytest.mark.parametrize("s", ["a", "aaaa\n\nbbbb", "a" * 23, "aa\n\n" * 6, "aaaaaa\n\nb\n\ncccccccccccc", "", "\n\na", "aaaaaaa\n\n\n\nb\n\n", "b\n\n" + "a" * 11 + "\n\nb"])
def test_message_parts(spark, s, most):
    assert one(spark, render.message_parts(F.lit(s), most)) == render.split_message(s, most)


def test_parts_by_rule():
    assert render.split_message("\n\na\n\n", 9) == ["\n\na\n\n"]  # fits: as it is
    assert render.split_message("b\n\n" + "a" * 11 + "\n\nc", 9) == ["b", "a" * 9, "aa", "c"]  # no slice takes the next block along
    assert render.split_message("aaaa\n\nbb\n\ncc", 9) == ["aaaa\n\nbb", "cc"]


def test_first_by(spark):
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("b", 1), ("a", 2), ("b", 0), ("a", 2), ("c", None))])
    assert [tuple(r) for r in one(spark, text.first_by(rows, lambda x: x["k"]))] == [("b", 1), ("a", 2), ("c", None)]
    assert one(spark, text.first_by(F.slice(rows, 1, 0), lambda x: x["k"])) == []


def test_whole_number(spark):
    got = [one(spark, temporal.whole_number(F.lit(x), 1, 10)) for x in ("3", " 10 ", "2.0", "+4", "0", "11", "-1", "2.5", "x", "", None, "9" * 40)]
    assert got == [3, 10, 2, 4] + [None] * 8


PAGE = """<html><head><title>T</title><meta name="date" content="2026-01-02T03:04:05+05:30"><meta property="description" content="d"></head><body><nav><a href="/n">n</a></nav>
<div class="cookie-banner">We use cookies</div><div><a href="/1">one link text</a> <a href="/2">two link text</a> <a href="/3">three link text</a> <a href="/4">four link text</a></div>
<article><h1>Head  line</h1><p>First para<p>Second <a href="doc.pdf#x">file</a> <a href="doc.pdf">again</a> <a href="mailto:x@y.z">mail</a></article><script>var x = "<p>no</p>"</script><footer>foot</footer></body></html>"""


def test_html():
    got = html.extract(PAGE, "https://a.org/dir/page")
    assert got["title"] == "Head line" and got["links"] == ["https://a.org/dir/doc.pdf"]
    assert got["body_text"] == "Head line\nFirst para\nSecond file again mail"
    assert got["metadata"] == [{"key": "date", "value": "2026-01-02T03:04:05+05:30"}, {"key": "description", "value": "d"}] and got["published"] == "2026-01-02T03:04:05+05:30"
    for odd in (None, "", "<", "<p", "</div></p>", "<a href='http://[bad'>x</a>", "<div>" * 2000 + "deep"):
        assert html.extract(odd, None)["title"] == "Untitled"


def test_html_documents(spark, sf):
    rows = html.html_documents(spark.createDataFrame([(1, "https://a.org/", PAGE), (2, None, None)], "page_id bigint, url string, html string")).orderBy("page_id").collect()
    assert rows[0].quality.level == "LOW" and rows[0].published_at.isoformat() == "2026-01-01T21:34:05" and rows[1].quality.level == "FAILED"


def test_date_tokens_spellings(spark):
    told = one(spark, F.array_join(text.date_tokens(F.lit("Due 14 Sept 2026, May 5, 2026, 3/4/26 and 31-02-2026; x12/3/24")), "|"))
    assert told == "2026-09-14|14 sept 2026|may 5, 2026|3/4/26|31-02-2026"
    assert one(spark, F.array_join(text.slash_dates(F.lit("3/4/26, 03-04-2026 and 5/6/2027")), "|")) == "2026-04-03|2027-06-05"
    assert one(spark, F.size(text.date_tokens(F.lit("")))) == 0
    assert one(spark, text.date_tokens(F.lit(None).cast("string"))) is None


def test_assembled(spark):
    page = PAGE.replace("First para", "Fee payment is due by 3 May 2026! First para")
    pages = spark.createDataFrame([(1, "s", "https://x.org/a", page), (2, "s", "https://x.org/b", None)], "page_id int, source_id string, url string, html string")
    a, b = html.assembled(pages).orderBy("page_id").collect()
    assert [d.title for d in a.deadlines] == ["Fee payment is due by 3 May 2026!"] and [str(d.value) for d in a.dates] == ["2026-05-03 00:00:00"]
    assert a.notice_category == "FEES" and a.events == [] and len(a.calendar) == 1 and [m.key for m in a.metadata] == sorted(m.key for m in a.metadata)
    assert a.id != b.id and a.source_relative_id.startswith("s:") and b.body_text == "" and b.dates == b.deadlines == b.calendar == [] and b.notice_category == "UNKNOWN"

"""Texts for people and calendars, answers and their citations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGE_CHARS = 4096
STATE_LABELS = {"VERIFIED": "Verified", "UNVERIFIED": "Unverified", "CONFLICTING": "Conflicting", "SUPERSEDED": "Superseded", "EXPIRED": "Expired", "REMOVED": "Removed"}


def html_escape(text: Column, quotes: bool = False) -> Column:
    """``text`` with the marks of HTML escaped, with ``quotes`` the double quote too."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if quotes else [])):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def split_message(text: str, most: int = MESSAGE_CHARS) -> list[str]:
    """Parts of at most ``most`` characters. A text that fits is one part as it is; a longer one is cut at blank lines, and
    the slices of a block that is itself too long stand alone."""
    if len(text) <= most:
        return [text]
    parts, held = [], ""
    for block in text.split("\n\n"):
        joined = f"{held}\n\n{block}" if held else block
        if len(joined) <= most:
            held = joined
            continue
        parts += [held] * bool(held)
        held = "" if len(block) > most else block
        if not held:
            parts += [block[i : i + most] for i in range(0, len(block), most)]
    return parts + [held] * bool(held)


def message_parts(text: Column, most: int = MESSAGE_CHARS) -> Column:
    """split_message() as a Column."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    flushed = lambda acc: F.when(acc["held"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"])))
    slices = lambda b: F.transform(F.sequence(F.lit(0), F.ceil(F.length(b) / most).cast("int") - 1), lambda i: F.substring(b, i * most + 1, F.lit(most)))

    def step(acc: Column, b: Column) -> Column:
        whole = F.when(acc["held"] == "", b).otherwise(F.concat(acc["held"], F.lit("\n\n"), b))
        fits, long = F.length(whole) <= most, F.length(b) > most
        done = F.when(fits, acc["done"]).when(long, F.concat(flushed(acc), slices(b))).otherwise(flushed(acc))
        return F.struct(done.alias("done"), F.when(fits, whole).when(long, "").otherwise(b).alias("held"))

    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.aggregate(F.split(text, "\n\n"), start, step, flushed))


def fact_lines(text: Column) -> Column:
    """The lines of a text without blank ones, trimmed, two blanks as one."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: F.replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit("  "), F.lit(" ")))
    return F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x != "")


def scope_line() -> Column:
    """Whom an item row is for; empty if for everyone. Zero counts as no year and no semester."""
    number = lambda name, c: F.when(F.col(c) != 0, F.concat(F.lit(f"{name} "), F.col(c).cast("string")))
    return F.concat_ws(" · ", *[F.nullif(F.col(c), F.lit("")) for c in ("program", "branch")], number("Year", "year"), number("Semester", "semester"))


def date_line() -> Column:
    """When an item row is due, starts and ends; empty without any."""
    named = lambda name, c: F.concat(F.lit(f"{name}: "), F.date_format(c, "yyyy-MM-dd HH:mm"))
    return F.concat_ws(" · ", named("Due", "due_at"), named("Starts", "starts_at"), named("Ends", "ends_at"))


def _if_any(head: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(head), html_escape(text, quotes=True)))


def _link(url: Column, name: str | Column) -> Column:
    return F.concat(F.lit('<a href="'), html_escape(url, quotes=True), F.lit('">'), F.lit(name) if isinstance(name, str) else name, F.lit("</a>"))


def item_text() -> Column:
    """An item row in full: title, summary, scope, dates, what it does to an earlier item, and its source."""
    did = F.when(F.col("supersedes_item_id").isNotNull(), "Supersedes an earlier item").when(F.col("changed_from_item_id").isNotNull(), "Changed from an earlier item")
    did = did.when(F.col("corrected_item_id").isNotNull(), "Corrects an earlier item").otherwise("Current")
    title = F.concat(F.lit("<b>"), html_escape(F.col("title"), quotes=True), F.lit("</b>"))
    return F.concat_ws(
        "\n", title, F.nullif(html_escape(F.col("summary"), quotes=True), F.lit("")), _if_any("<b>Applies to:</b> ", scope_line()), _if_any("", date_line()),
        F.concat(F.lit("State: "), did), F.concat(F.lit("Source: "), _link(F.col("primary_source_url"), "official source")),
    )


def heading_of(title: str) -> str:
    """``Verified EXAM results`` is ``Verified exam information``; other titles stay."""
    found = re.fullmatch(r"Verified ([A-Za-z]+) results", title, re.IGNORECASE)
    return f"Verified {found[1].lower()} information" if found else title


def list_messages(owners: DataFrame, items: DataFrame, owner: str, title: str, most_items: int, most_facts: int = 12) -> DataFrame:
    """(owner, message): one list for each of ``owners``, of its first ``most_items`` item rows (owner, rank, ...) by rank, which
    is unique within an owner.

    Items of one title and source are one numbered section, with the facts of their summaries: those of the first item,
    then further ones that the section doesn't have, ``most_facts`` at most; scope and dates are the first item's. An
    owner without items gets a message that says so.
    """
    group = Window.partitionBy(owner, "title", "primary_source_url")
    head = F.struct("rank", scope_line().alias("scope"), date_line().alias("dates"))
    rows = items.filter(F.col("rank") <= most_items).select(owner, "rank", "title", "primary_source_url", head.alias("head"), F.posexplode_outer(fact_lines(F.col("summary"))).alias("n", "fact"))
    rows = rows.withColumn("first", F.min("rank").over(group)).withColumn("again", F.row_number().over(Window.partitionBy(owner, "title", "primary_source_url", "fact").orderBy("rank", "n")) > 1)
    fact = F.when(F.col("fact").isNotNull() & ((F.col("rank") == F.col("first")) | ~F.col("again")), F.struct("rank", "n", "fact"))
    made = rows.groupBy(owner, "title", "primary_source_url").agg(F.min("head").alias("head"), F.array_sort(F.collect_list(fact)).alias("facts"))
    body = F.concat_ws(
        "\n", F.transform(F.slice("facts", 1, most_facts), lambda x: F.concat(F.lit("• "), html_escape(x["fact"], quotes=True))), _if_any("Applies to: ", F.col("head.scope")), _if_any("", F.col("head.dates")),
        F.lit("✓ Officially verified"), F.concat(F.lit("🔗 "), _link(F.col("primary_source_url"), "Official source")),
    )
    section = F.struct(F.col("head.rank").alias("rank"), html_escape(F.col("title"), quotes=True).alias("title"), body.alias("body"))
    listed = made.groupBy(owner).agg(F.array_sort(F.collect_list(section)).alias("sections"))
    bold = lambda text: F.lit("<b>" + text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;") + "</b>")
    numbered = F.transform("sections", lambda x, i: F.concat(F.lit("<b>"), (i + 1).cast("string"), F.lit(". "), x["title"], F.lit("</b>\n"), x["body"]))
    message = F.when(F.col("sections").isNull(), F.concat(bold(title), F.lit("\nNo matching verified information found."))).otherwise(F.concat_ws("\n\n", bold(heading_of(title)), numbered))
    return owners.select(owner).distinct().join(listed, owner, "left").select(owner, message.alias("message"))


def preferences_text() -> Column:
    """The settings of a preference row, absent values as ``not set``."""
    said = lambda c: html_escape(F.coalesce(F.col(c).cast("string"), F.lit("not set")), quotes=True)
    switch = lambda c, yes, no: F.when(F.coalesce(F.col(c).cast("boolean"), F.lit(False)), yes).otherwise(no)
    chosen = F.coalesce(F.nullif(F.array_join("categories", ", "), F.lit("")), F.lit("none"))
    quiet = F.coalesce(F.concat(F.nullif("quiet_start", F.lit("")), F.lit("–"), F.nullif("quiet_end", F.lit("")), F.lit(" (UTC)")), F.lit("off"))
    lines = [(c.capitalize(), said(c)) for c in ("program", "branch", "year", "semester")] + [("Categories", html_escape(chosen, quotes=True))]
    lines += [("Reminders", switch("reminders", "on", "off")), ("Weekly digest", switch("digest", "on", "off")), ("Muted", switch("muted", "yes", "no")), ("Quiet hours", quiet)]
    return F.concat_ws("\n", F.lit("<b>Your settings</b>"), *[F.concat(F.lit(f"{name}: "), value) for name, value in lines])


def answer_text(answer: Column, citations: Column, evidence: Column) -> Column:
    """An answer with links to what it cites (evidence: array of struct<id,title,url>), in the order of the citations; what is
    no evidence is left out."""
    cited = F.transform(citations, lambda c: F.get(F.filter(evidence, lambda e: e["id"] == c), F.lit(0)))
    links = F.transform(F.filter(cited, lambda e: e.isNotNull()), lambda e: F.concat(F.lit("• "), _link(e["url"], html_escape(e["title"], quotes=True))))
    return F.concat(F.lit("<b>Answer</b>\n\n"), html_escape(F.trim(answer), quotes=True), F.lit("\n\n<b>Verified evidence</b>\n"), F.array_join(links, "\n"))


def item_line(when: Column) -> Column:
    """``[State] title (audience), date`` of an item row with claim_state."""
    state = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in STATE_LABELS.items() for x in p]), F.col("claim_state")), F.lit("Unknown"))
    scope = F.concat_ws(", ", "program", "branch", F.concat(F.lit("year "), F.col("year").cast("string")), F.concat(F.lit("semester "), F.col("semester").cast("string")))
    audience = F.when(scope == "", "everyone").otherwise(scope)
    day = F.coalesce(F.date_format(when, "yyyy-MM-dd"), F.lit("no date"))
    return F.concat(F.lit("["), state, F.lit("] "), F.col("title"), F.lit(" ("), audience, F.lit("), "), day)


def ics_escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def ics_event(stamp: Column) -> Column:
    """A VEVENT of an item row; a missing end is an hour after the start, a missing start is when it is due."""
    utc = lambda ts: F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
    start = F.coalesce("starts_at", "due_at")
    end = F.coalesce("ends_at", start + F.make_dt_interval(F.lit(0), F.lit(1)))
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("id")), F.concat(F.lit("DTSTAMP:"), utc(stamp)), F.concat(F.lit("DTSTART:"), utc(start)), F.concat(F.lit("DTEND:"), utc(end)), F.concat(F.lit("SUMMARY:"), ics_escape(F.col("title"))), F.concat(F.lit("DESCRIPTION:"), ics_escape(F.col("summary"))), F.concat(F.lit("URL:"), F.col("primary_source_url")), F.lit("END:VEVENT")]
    return F.concat_ws("\r\n", *lines)


def ics_feed(items: DataFrame, stamp: Column, owner: str, name: str = "Notices", most: int = 100) -> DataFrame:
    """(owner, ics): one calendar for each owner with its first ``most`` events by start; ``rank`` gives the order."""
    events = items.filter(F.coalesce("starts_at", "due_at").isNotNull() & (F.col("rank") <= most)).select(owner, "rank", ics_event(stamp).alias("e"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "e"))), lambda x: x["e"]), "\r\n")
    head, tail = f"BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//notices//EN\r\nX-WR-CALNAME:{name}\r\n", "\r\nEND:VCALENDAR\r\n"
    return events.groupBy(owner).agg(F.concat(F.lit(head), body, F.lit(tail)).alias("ics"))


def json_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}`` of a text, as around it a fence may stand; null if that is not JSON."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def cites_only(answer: Column, citations: Column, evidence_ids: Column) -> Column:
    """Whether an answer has words and cites at least one piece of evidence, and none besides."""
    return F.coalesce((F.length(F.trim(answer)) > 0) & (F.size(citations) > 0) & (F.size(F.array_except(citations, evidence_ids)) == 0), F.lit(False))


def grounded_prompt(question: Column, evidence: Column) -> Column:
    """A question with numbered evidence (array of struct<id,title,summary>)."""
    listed = F.transform(evidence, lambda e, i: F.concat(F.lit("["), e["id"], F.lit("] "), e["title"], F.lit(": "), e["summary"]))
    return F.concat(F.lit("Answer only from the evidence and cite ids.\n"), F.array_join(listed, "\n"), F.lit("\nQuestion: "), question)


def file_name(name: Column, most: int = 100) -> Column:
    """Characters other than letters, digits, dot, dash and underscore become an underscore."""
    return F.substring(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), 1, most)

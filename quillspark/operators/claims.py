"""Claims: making them from documents, deciding on them, their states over time, their provenance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions.temporal import at

# Legal moves between states; a state may always stay.
TRANSITIONS = {
    "UNVERIFIED": ("VERIFIED", "CONFLICTING", "REMOVED"),
    "VERIFIED": ("CONFLICTING", "SUPERSEDED", "EXPIRED", "REMOVED"),
    "CONFLICTING": ("VERIFIED", "SUPERSEDED", "EXPIRED", "REMOVED"),
    "SUPERSEDED": (),
    "EXPIRED": ("VERIFIED", "REMOVED"),
    "REMOVED": (),
}
FALLBACK_CHARS = 1000


def claims_from_documents(docs: DataFrame, observed_at: datetime) -> DataFrame:
    """Unverified claims of documents (id, evidence_id, source_id, body_text): one for each deadline and event, else one
    for the start of the body."""
    rows = docs.withColumn("found", F.concat(text.extract_deadlines(F.col("body_text")), text.extract_events(F.col("body_text"))))
    body = F.col("body_text")
    whole = F.when(F.length(F.trim(body)) > 0, F.array(F.struct(F.substring(body, 1, FALLBACK_CHARS).alias("s"), F.lit(None).cast("timestamp_ntz").alias("t"))))
    stated = F.transform("found", lambda x: F.struct(x["source_text"].alias("s"), x["at"].alias("t")))
    rows = rows.withColumn("one", F.explode(F.when(F.size("found") > 0, stated).otherwise(whole)))
    mark = text.fingerprint(F.col("one.s"))
    return rows.select(
        ids.claim_id(F.col("id"), mark).alias("id"), F.col("id").alias("document_id"), "evidence_id", "source_id", F.trim("one.s").alias("statement"), text.normalize_statement(F.col("one.s")).alias("normalized_statement"),
        mark.alias("fingerprint"), F.lit("UNVERIFIED").alias("state"), at(observed_at).alias("first_seen_at"), at(observed_at).alias("last_seen_at"), F.col("one.t").alias("effective_from"), F.lit(None).cast("timestamp_ntz").alias("effective_until"),
    )


def deduplicate(claims: DataFrame, by: str = "fingerprint", position: str = "pos") -> DataFrame:
    """The first claim of each fingerprint in the order of ``position``: an aggregate, so a fingerprint that many
    claims share combines before the shuffle."""
    return claims.groupBy(by).agg(F.min_by(F.struct(*claims.columns), F.col(position)).alias("__row")).select("__row.*")


def verify(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """A decision for each claim: verified if its evidence is at hand. ``evidence``: (id)."""
    known = evidence.select(F.col("id").alias("evidence_id")).distinct().withColumn("there", F.lit(True))
    yes = F.coalesce(F.col("there"), F.lit(False))
    return claims.join(known, "evidence_id", "left").select(
        F.col("id").alias("claim_id"), F.when(yes, "VERIFIED").otherwise("UNVERIFIED").alias("state"), "evidence_id",
        F.when(yes, "claim is traceable to an available evidence record").otherwise("no available evidence record matches the claim").alias("reason"),
    )


def publishable(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verified claims whose evidence is at hand."""
    return claims.filter("state = 'VERIFIED'").join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi")


def all_publishable(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claims`` as they are, if each is publishable; else whoever reads the rows gets an error that names one."""
    known = evidence.select(F.col("id").alias("evidence_id"), F.lit(True).alias("__known")).distinct()
    fit = F.coalesce((F.col("state") == "VERIFIED") & F.col("__known"), F.lit(False))
    held = F.when(fit, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("claim is not publishable: "), F.coalesce("id", F.lit("null")))))
    return claims.join(known, "evidence_id", "left").select(*[held.alias("id") if c == "id" else F.col(c) for c in claims.columns])


def legal(old: Column, new: Column) -> Column:
    test = old == new
    for state, moves in TRANSITIONS.items():
        if moves:
            test = test | ((old == state) & new.isin(*moves))
    return F.coalesce(test, F.lit(False))


def move(rows: DataFrame, old: str = "state", new: str = "next_state") -> tuple[DataFrame, DataFrame]:
    """Rows whose move is legal, and the others, for quarantine."""
    test = legal(F.col(old), F.col(new))
    return rows.filter(test), rows.filter(~test)


def is_expired(until: Column, now: Column) -> Column:
    return F.coalesce(until <= now, F.lit(False))


def resolved(base: Column, conflict: Column, superseded: Column, expired: Column) -> Column:
    """The state that facts call for: conflict before supersession before expiry before the decision."""
    return F.when(conflict, "CONFLICTING").when(superseded, "SUPERSEDED").when(expired, "EXPIRED").otherwise(base)


def history_edges(items: DataFrame) -> DataFrame:
    """(id, old_item_id, new_item_id, kind) of the back-references of items."""
    named = (("changed_from_item_id", "CHANGED", "change"), ("supersedes_item_id", "SUPERSEDES", "supersedes"), ("corrected_item_id", "CORRECTS", "corrects"))
    edges = F.array(*[F.struct(F.col(c).alias("old"), F.lit(kind).alias("kind"), F.concat(F.lit(p + ":"), F.col(c), F.lit(":"), F.col("id")).alias("id")) for c, kind, p in named])
    rows = items.select(F.col("id").alias("new_item_id"), F.explode(edges).alias("e")).filter("e.old is not null")
    return rows.select("e.id", F.col("e.old").alias("old_item_id"), "new_item_id", "e.kind")


#: Why an edge that someone states holds.
STATED = {
    "CORRECTS": "new claim explicitly corrects an earlier claim",
    "SUPERSEDES": "new claim supersedes the earlier claim",
    "CONFLICTS": "claims describe the same logical subject with incompatible statements",
}


def explicit_edges(pairs: DataFrame, kind: str, now: datetime) -> DataFrame:
    """Edges (left, right) of a kind that someone states, with their reason; other kinds follow from content and are refused."""
    if kind not in STATED:
        raise ValueError(f"kind must be one of {', '.join(STATED)}")
    ends = [F.col("left").alias("left_claim_id"), F.col("right").alias("right_claim_id")]
    return pairs.select(ids.relationship_id(F.lit(kind), F.col("left"), F.col("right")).alias("id"), *ends, F.lit(kind).alias("kind"), at(now).alias("created_at"), F.lit(STATED[kind]).alias("reason"))


def provenance(claims: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Claim, evidence hash, url and source name, and a line that sums them up."""
    rows = claims.join(evidence.select(F.col("id").alias("evidence_id"), "content_hash", "fetched_at"), "evidence_id").join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "base_url"), "source_id")
    said = F.format_string("%s: %s, fetched %s, sha256 %s", F.col("source_name"), F.col("base_url"), F.date_format("fetched_at", "yyyy-MM-dd HH:mm"), F.substring("content_hash", 1, 12))
    return rows.select(F.col("id").alias("claim_id"), "state", "evidence_id", "content_hash", "source_name", said.alias("summary"))


def evidence_links(claims: DataFrame, role: str = "primary evidence") -> DataFrame:
    return claims.select(F.col("id").alias("claim_id"), "evidence_id", F.lit(role).alias("role"))


def failed_streak(outcomes: DataFrame) -> DataFrame:
    """(source_id, consecutive_failures, last_success_at): failures since the last success, by source.

    Failures are counted by source and time before they meet their source's last success, so that no task has all rows
    of a source.
    """
    ok = F.col("http_status") < 400
    last = outcomes.groupBy("source_id").agg(F.max(F.when(ok, F.col("fetched_at"))).alias("last_success_at"))
    failed = outcomes.filter(~ok).groupBy(F.col("source_id").alias("__source"), "fetched_at").agg(F.count("*").alias("n"))
    after = F.col("last_success_at").isNull() | (F.col("fetched_at") > F.col("last_success_at"))
    same = F.col("source_id").eqNullSafe(F.col("__source"))
    since = failed.join(last, same).filter(after).groupBy("__source").agg(F.sum("n").alias("n"))
    return last.join(since, same, "left").select("source_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("consecutive_failures"), "last_success_at")

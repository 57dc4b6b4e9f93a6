"""Deterministic identities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\u0000"


def sha(*parts: Column, sep: str = ":") -> Column:
    """Hex SHA-256 of the parts joined by ``sep``; null parts count as empty."""
    return F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def evidence_id(source_id: Column, content_hash: Column) -> Column:
    return sha(source_id, content_hash)


def document_id(source_id: Column, url: Column, raw_hash: Column, parser_version: Column) -> Column:
    return sha(source_id, url, raw_hash, parser_version)


def source_relative_id(source_id: Column, url: Column, key: Column) -> Column:
    """Stable inside one source only."""
    return F.concat(source_id, F.lit(":"), F.substring(sha(source_id, url, key, sep=NUL), 1, 24))


def claim_id(document: Column, fingerprint: Column) -> Column:
    return F.concat(F.lit("claim:"), document, F.lit(":"), F.substring(fingerprint, 1, 24))


def relationship_id(kind: Column, left: Column, right: Column) -> Column:
    """The same for both directions; edges keep their direction in columns of their own."""
    return F.concat(F.lit("rel:"), F.substring(sha(kind, F.least(left, right), F.greatest(left, right), sep=NUL), 1, 32))


def item_id(claim: Column, category: Column) -> Column:
    return F.concat(F.lit("info:"), F.substring(sha(claim, category), 1, 24))


def calendar_row_id(source_id: Column, url: Column, start: Column, end: Column, label: Column) -> Column:
    iso = lambda ts: F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return source_relative_id(source_id, url, sha(iso(start), iso(end), F.lower(label)))


def notification_id(user: Column, kind: Column, item: Column, key: Column) -> Column:
    return F.concat_ws(":", F.lit("notification"), user.cast("string"), kind, item, key)


def submission_id(user: Column, message: Column) -> Column:
    return F.concat_ws(":", F.lit("verification"), user.cast("string"), message.cast("string"))

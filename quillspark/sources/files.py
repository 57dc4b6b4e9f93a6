"""Readers of landed files and of JSON row sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quality_level

# Files and texts beyond these are left out and cut.
MOST_BYTES, MOST_CHARS = 10 << 20, 1_500_000
Extractor = Callable[[bytes], list[str]]


def landed(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, modificationTime, length, content) of files below ``path`` of at most ``most_bytes``; the size test
    reaches the scan, so larger files are never opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= most_bytes)


def row_sets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files that wrap them as ``{"results": [...]}``, or as a list of such objects."""
    wrapped = spark.read.schema(f"results array<struct<{schema}>>").json(path, multiLine=True)
    return wrapped.select(F.explode("results").alias("x")).select("x.*")


def media_type(content_type: Column) -> Column:
    """The type before ``;``, trimmed, in lower case."""
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def accepted(content_type: Column, allowed: list[str]) -> Column:
    return F.coalesce(media_type(content_type).isin(*allowed), F.lit(False))


def text_documents(rows: DataFrame, body: str = "content", most_chars: int | None = MOST_CHARS) -> DataFrame:
    """Rows with body_text, quality and kind of plain text or XML bodies; broken UTF-8 is replaced. ``truncated`` marks
    texts that were cut after ``most_chars``; None cuts none."""
    whole = F.make_valid_utf8(F.col(body).cast("string"))
    cut = F.lit(False) if most_chars is None else F.coalesce(F.length(whole) > most_chars, F.lit(False))
    rows = rows.withColumn("body_text", whole if most_chars is None else F.substring(whole, 1, most_chars)).withColumn("truncated", cut)
    good = F.length(F.trim("body_text")) > 0
    q = F.struct(F.when(good, "MEDIUM").otherwise("FAILED").alias("level"), F.when(good, 0.8).otherwise(0.0).alias("score"))
    return rows.withColumn("quality", q).withColumn("extraction_kind", F.lit("text"))


def page_documents(rows: DataFrame, primary: Extractor, check: Extractor | None = None, ocr: Extractor | None = None, body: str = "content", key: str = "path") -> DataFrame:
    """(key, body_text, page_count, warnings, quality) of paged files by pluggable extractors, each from bytes to the
    pages' texts: the longer text of ``primary`` and ``check`` wins, and ``ocr`` runs where ten characters or fewer
    were found. An extractor that fails leaves a warning."""

    def extract(raw: bytes) -> tuple[str, int, list[str]]:
        pages, warnings = [], []
        for name, f in (("primary", primary), ("check", check), ("ocr", ocr)):
            if f is None or name == "ocr" and len("".join(pages).strip()) > 10:
                continue
            try:
                found = list(f(raw))
            except Exception as e:  # noqa: BLE001 - foreign parsers fail in any way
                warnings.append(f"{name} failed: {type(e).__name__}")
                continue
            if len("".join(found)) > len("".join(pages)):
                if pages:
                    warnings.append(f"{name} found more text")
                pages = found
        return "\n".join(pages)[:MOST_CHARS], len(pages), warnings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(x or b"") for x in b.column(1).to_pylist()]
            kinds = (pa.string(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], ["key", "body_text", "page_count", "warnings"])

    out = rows.select(F.col(key).alias("key"), F.col(body).alias("body")).mapInArrow(run, "key string, body_text string, page_count int, warnings array<string>")
    return out.withColumn("quality", quality_level(F.length(F.trim("body_text")), 0.78)).withColumnRenamed("key", key)


def dispatch(content_type: Column) -> Column:
    """The extractor for a content type: html, pdf or text; null for others, which callers reject."""
    kind = media_type(content_type)
    return F.when(kind.isin("text/html", "application/xhtml+xml"), "html").when(kind == "application/pdf", "pdf").when(kind.startswith("text/") | kind.isin("application/xml", "application/json"), "text")

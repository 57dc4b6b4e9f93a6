"""Personal data: four base patterns, and terms that corpus co-occurrence shows to give a protected entity away.

A protected entity is the value of a base match, and the classes that it belongs to: its mail domain, network, card or
number prefix, and its kind. A term of its surroundings reveals it to the degree PMI(entity, term) / IC(entity), in
documents of the whole corpus: 1 if the term occurs with that entity only, 0 if the two are independent. One further
document with the term and without the entity is assumed, as few documents prove little. Terms beyond ``threshold`` that
are likelier than CERTAIN to stand beside the entity, in at least ``support`` different texts, are masked in the texts
that hold the entity.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, text_chunks

KINDS = ("email", "ip", "card", "phone")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
#: Words on either side of an entity that count as its surroundings.
REACH = 10
SUPPORT = 2
THRESHOLD = 0.8
#: Least share of a term's documents, one more assumed, that hold the entity.
CERTAIN, ASSUMED = 0.6, 1
SALTS = 16
#: Terms or texts that are broadcast at most; beyond it the same step is a join.
BROADCAST_ROWS = 200_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# The look-behind and the possessive marks change no match: a start inside a run of digits fails as the run's start does.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
EDGES = "\"'`´.,;:!?()[]{}<>|*#$%&/\\=+-_~^@«»„“”‘’…"


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in that order; kind indexes KINDS."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, last := m.end()))
        at = text.find("@", max(last, at + 1))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def term(word: str) -> str:
    """A word as a term: lower case, without punctuation at its ends; empty if it has fewer than 3 characters."""
    word = word.lower().strip(EDGES)
    return word if len(word) > 2 else ""


def _entity(text: str, span: tuple[int, int, int]) -> str:
    value = text[span[0] : span[2]].lower()
    return f"{KINDS[span[1]]}:{value if span[1] < 2 else ''.join(c for c in value if c.isdigit())}"


def _levels(entity: str) -> tuple[str, ...]:
    """An entity and the classes that it belongs to; a class ends in an asterisk."""
    kind, value = entity.split(":", 1)
    part = {"email": lambda: "@" + value.rsplit("@", 1)[1], "ip": lambda: value.rsplit(".", 1)[0], "card": lambda: value[:6], "phone": lambda: value[:4]}[kind]()
    return entity, f"{kind}:{part}*", f"{kind}:*"


def _near(text: str, span: tuple[int, int, int], reach: int) -> set[str]:
    """Terms among the ``reach`` words on either side. Words of over 200 characters end the view."""
    left, right = text[max(0, span[0] - 200 * reach) : span[0]].split()[-reach:], text[span[2] : span[2] + 200 * reach].split()[:reach]
    return {t for w in left + right if (t := term(w)) and not any(c.isdigit() or c == "@" for c in t)}


def mentions(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """(key, entity, terms) for each entity, and each class of entities, that a text holds; key is the text's xxhash64, so
    copies share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "text"):
            rows = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                near: dict[str, set[str]] = {}
                for span in base_spans(t):
                    terms = _near(t, span, reach)
                    for level in _levels(_entity(t, span)):
                        near.setdefault(level, set()).update(terms)
                rows.extend((key, e, sorted(terms)) for e, terms in near.items())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.list_(pa.string())))], ["key", "entity", "terms"])

    narrow = docs.select(F.xxhash64(text).alias("key"), F.col(text).alias("text")).filter("text is not null")
    return small_batches(narrow).mapInArrow(run, "key bigint, entity string, terms array<string>")


def _frequencies(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(term, n): documents, of all, that hold each term of ``wanted``."""
    if wanted.count() <= BROADCAST_ROWS:
        sent = docs.sparkSession.sparkContext.broadcast({r.term for r in wanted.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: dict[str, int] = {}
            for b in text_chunks(batches, "text"):
                for t in b.column(0).to_pylist():
                    for w in {term(w) for w in set(t.split())} & sent.value:
                        counts[w] = counts.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "k"])

        found = docs.select(F.col(text).alias("text")).filter("text is not null").mapInArrow(run, "term string, k bigint")
        return found.groupBy("term").agg(F.sum("k").alias("n"))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([w for t in b.column(0).to_pylist() for w in {term(w) for w in set(t.split())}], pa.string())], ["term"])

    words = docs.select(F.col(text).alias("text")).filter("text is not null").mapInArrow(every, "term string")
    return words.groupBy("term").agg(F.count("*").alias("n")).join(wanted, "term", "left_semi")


def revealing(docs: DataFrame, text: str = "text", reach: int = REACH, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """(key, terms): for the texts that hold an entity, the terms that give it away. Counts cover all documents."""
    found = materialize(mentions(docs, text, reach), "mentions")
    total = docs.count()
    pairs = found.select("key", "entity", F.explode("terms").alias("term"))
    by_text = pairs.groupBy("entity", "term", "key").agg(F.count("*").alias("k"))
    shown = by_text.groupBy("entity", "term").agg(F.sum("k").alias("both"), F.count("*").alias("texts")).filter(F.col("texts") >= support)
    shown = materialize(shown, "shown")
    often = found.groupBy("entity").agg(F.count("*").alias("held"))
    counts = _frequencies(docs, text, materialize(shown.select("term").distinct(), "terms"))
    info = F.log(F.lit(float(max(total, 1))) / F.col("held"))
    share = F.col("both") / (F.col("n") + ASSUMED)
    degree = F.when(info > 0, 1 + F.log(share) / info).otherwise(0.0)
    # a kind may hold a third of all pairs: its terms are dealt to SALTS parts, each with a copy of its count
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    shown = shown.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    hits = shown.join(often, ["entity", "salt"]).join(counts, "term").filter((degree >= threshold) & (share >= CERTAIN)).select("entity", "term")
    return pairs.join(hits, ["entity", "term"]).groupBy("key").agg(F.collect_set("term").alias("terms"))


def _term_spans(text: str, terms: set[str], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out, at = [], 0
    for m in re.finditer(r"\S+", text):
        word = m[0]
        if term(word) in terms:
            start = m.start() + len(word) - len(word.lstrip(EDGES))
            end = start + len(word.strip(EDGES))
            while at < len(base) and base[at][2] <= start:
                at += 1
            if at == len(base) or base[at][0] >= end:
                out.append((start, len(KINDS), end))
    return out


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind's label; spans that overlap become one, under the first's label."""
    out, at, i = [], 0, 0
    names = (*KINDS, "term")
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], LABELS[names[kind]]]
        at = end
    return "".join([*out, text[at:]])


def find(docs: DataFrame, text: str = "text", reach: int = REACH, support: int = SUPPORT, threshold: float = THRESHOLD, keep: tuple[str, ...] = (), mask: bool = False) -> DataFrame:
    """(*keep, spans, base_sha256, n_email, n_ip, n_card, n_phone[, masked]) for every row of ``docs``.

    Null text counts as empty (``masked`` stays null). Repeated rows each get their row; copies count as one text
    towards ``support``. spans: kind:start:end by start, then kind, in code points, the end exclusive.
    """
    known = materialize(revealing(docs, text, reach, support, threshold), "revealing")
    wide = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    rows = known.count()
    if rows:
        side = known.select(F.col("key").alias("__key"), F.col("terms").alias("__terms"))
        joined = wide.withColumn("__key2", F.xxhash64("__text"))
        wide = joined.join(F.broadcast(side) if rows <= BROADCAST_ROWS // 10 else side, F.col("__key2") == F.col("__key"), "left").select(*keep, "__text", "__terms")
    else:
        wide = wide.withColumn("__terms", F.lit(None).cast("array<string>"))
    names = (*KINDS, "term")
    kept = len(keep)
    if clash := {"spans", "base_sha256", "n_email", "n_ip", "n_card", "n_phone", "masked"} & set(keep):
        raise ValueError(f"kept columns named like results: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "__text"):
            shown, digests, counts, clean = [], [], ([], [], [], []), []
            for t, terms in zip(b.column(kept).to_pylist(), b.column(kept + 1).to_pylist()):
                base = base_spans(t or "")
                spans = sorted(base + _term_spans(t, set(terms), base)) if terms and t else base
                say = lambda found: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in found)
                shown.append(say(spans))
                digests.append(hashlib.sha256(say(base).encode()).hexdigest())
                for i in range(4):
                    counts[i].append(sum(k == i for _, k, _ in base))
                if mask:
                    clean.append(t if t is None else masked(t, spans))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:kept], pa.array(shown, pa.string()), pa.array(digests, pa.string()), *(pa.array(c, pa.int64()) for c in counts), *([pa.array(clean, pa.string())] * mask)],
                [*b.schema.names[:kept], "spans", "base_sha256", "n_email", "n_ip", "n_card", "n_phone", *(["masked"] * mask)],
            )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in wide.schema[:kept])
    return small_batches(wide).mapInArrow(run, f"{fields}spans string, base_sha256 string, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint" + ", masked string" * mask)


def sanitise(docs: DataFrame, text: str = "text", length: str = "n_chars", reach: int = REACH, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all rows and columns, with masked texts; ``length``, if there, becomes the new text's where it
    changed. Rows without personal data stay as they are."""
    columns = [f"c{i}" for i in range(len(docs.columns))]
    at = columns[docs.columns.index(text)]
    rest = tuple(c for c in columns if c != at)
    done = find(docs.toDF(*columns), at, reach, support, threshold, rest, mask=True)
    out = {c: F.col("masked") if c == at else F.col(c) for c in columns}
    if length in docs.columns:
        size = columns[docs.columns.index(length)]
        out[size] = F.when(F.col("spans") != "", F.char_length("masked").cast(docs.schema[length].dataType)).otherwise(F.col(size))
    return done.select(*[v.alias(c) for c, v in out.items()]).toDF(*docs.columns)

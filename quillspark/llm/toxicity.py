"""Toxicity by compression distance between two zstandard dictionaries.

The ordinary dictionary is trained by zstandard on windows of ordinary text. The toxic one is the same base followed by
segments trained on toxic text: word beginnings that far more toxic than ordinary documents have. (Two dictionaries
that zstandard trains on either text alone differ mostly by chance, as what is frequent in both is the same; README has
the figures.) Every window is compressed with both; a window that holds toxic segments gets shorter with the toxic one.

Words are tiled twice, half a window apart, so each half window lies in two windows: its saving is the lesser of
theirs, which removes most of the chance in match choices. Half windows with a saving are compressed again alone and in
parts. A logistic calibration turns a document's savings into its score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, materialize, small_batches, text_chunks

#: Words in half a window.
HALF = 8
LEVEL = 3
BASE_BYTES = 48 * 1024
#: Labelled documents of either kind that the fit takes at most; half of them train the dictionaries, half calibrate.
MAX_ROWS = 4000
#: Windows of each ordinary document that zstandard's trainer sees.
TRAINING_WINDOWS = 40
#: Longer windows - of words without blanks - train nothing.
WINDOW_CHARS = 2000
#: A segment's share of toxic documents over that of ordinary ones, its significance, its least share of toxic
#: documents (groups of copies are rarer), and its characters.
MIN_RATIO, MIN_SIGMA, MIN_SHARE, SHORTEST, LONGEST = 8.0, 6.0, 0.02, 4, 12
MOST_SEGMENTS = 500
TWICE = "\x02"
RIDGE = 1e-3
NAMES = ("top", "top3", "count", "mean", "alone", "alone3", "part", "part3", "words")


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def beginnings(text: str | None) -> set[str]:
    """Beginnings of the text's words, a blank before and, for whole words, after; marked TWICE besides if two or more
    different words share them, as the forms of one toxic stem do."""
    out: Counter = Counter()
    for w in set(words_of(text)):
        w = f" {w[:LONGEST]} " if len(w) < LONGEST else f" {w[:LONGEST]}"
        out.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
    return set(out) | {s + TWICE for s, n in out.items() if n > 1}


def chosen(counts: dict[str, tuple[int, int]], toxic: int, ordinary: int) -> list[str]:
    """Segments of the toxic dictionary, the most frequent last: of each family of beginnings that pass the tests the
    longest that still has four fifths of the family's documents."""

    def passes(t: int, o: int) -> bool:
        p, q = t / toxic, o / max(1, ordinary)
        pooled = (t + o) / (toxic + ordinary)
        sigma = (p - q) / math.sqrt(max(1e-12, pooled * (1 - pooled) * (1 / toxic + 1 / max(1, ordinary))))
        return p / ((o + 0.5) / max(1, ordinary)) >= MIN_RATIO and sigma >= MIN_SIGMA

    out: dict[str, int] = {}
    for mark in ("", TWICE):
        here = {s.removesuffix(TWICE): c for s, c in counts.items() if s.endswith(TWICE) == bool(mark)}
        good = {s for s, c in here.items() if passes(*c)}
        for s in (s for s in good if not any(s[:k] in good for k in range(SHORTEST, len(s)))):
            while True:
                longer = [x for x in good if len(x) == len(s) + 1 and x.startswith(s) and here[x][0] >= 0.8 * here[s][0]]
                if not longer:
                    break
                s = max(longer, key=lambda x: (here[x][0], x))
            out[s] = max(out.get(s, 0), here[s][0])
    kept = [s for s in out if not any(x != s and s.startswith(x) for x in out)]  # a stem covers its forms
    return sorted(kept, key=lambda s: (out[s], s))[-MOST_SEGMENTS:]


@dataclass
class Dictionaries:
    """base: content shared by both; toxic: what the toxic one has besides."""

    base: bytes
    toxic: bytes

    @classmethod
    def of(cls, windows: list[bytes], segments: list[str]) -> Dictionaries:
        try:
            base = zstandard.train_dictionary(BASE_BYTES, windows, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little text to train on
            base = b" ".join(windows)[-BASE_BYTES:] or b" " * 64
        own = b"\0".join(s.encode() for s in segments)
        while len(own) % 3 != 1:  # zstandard indexes every third byte: three copies, one at each remainder
            own += b"\0"
        return cls(base, own * 3)


class Saver:
    """Savings of windows, and the features of a text."""

    def __init__(self, d: Dictionaries) -> None:
        plain = {"write_content_size": 0, "write_checksum": 0, "write_dict_id": 0, "min_match": 3}
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, **plain)
        self.pair = []
        for body in (d.base + b"\0" * len(d.toxic), d.base + d.toxic):
            kept = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(compression_params=params)
            self.pair.append(zstandard.ZstdCompressor(dict_data=kept, compression_params=params).compress)

    def saving(self, words: str) -> int:
        ordinary, toxic = self.pair
        raw = f" {words} ".encode()
        return len(ordinary(raw)) - len(toxic(raw))

    def features(self, text: str | None) -> list[float]:
        words = words_of(text)
        if not words:
            return [0.0] * len(NAMES)
        halves = [" ".join(words[i : i + HALF]) for i in range(0, len(words), HALF)]
        n = len(halves)
        even = [self.saving(" ".join(halves[i : i + 2])) for i in range(0, n, 2)]
        odd = [self.saving(halves[0]), *(self.saving(" ".join(halves[i : i + 2])) for i in range(1, n, 2))]
        both = np.array([min(even[j // 2], odd[(j + 1) // 2]) for j in range(n)])
        alone, part = [0, 0, 0], [0, 0, 0]
        for j in np.flatnonzero(both >= 1).tolist():
            own = halves[j].split(" ")
            alone.append(self.saving(halves[j]))
            part.append(max(self.saving(" ".join(own[i : i + 4])) for i in range(0, len(own), 2)))
        best = np.sort(both)[::-1]
        three = lambda xs: float(min(15, sum(sorted(xs, reverse=True)[:3])))
        return [
            float(min(6, best[0])), float(min(15, best[:3].sum())), math.log1p(int((both >= 2).sum())), 5 * float(both.mean()), float(min(6, max(alone))), three(alone), float(min(6, max(part))), three(part), math.log1p(len(words)),
        ]


def segment_counts(rows: DataFrame) -> DataFrame:
    """(s, toxic, ordinary): documents of (text, y) that have each beginning, combined in the worker and again before
    the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(held[0] | held[1])
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([held[1][s] for s in names], pa.int64()), pa.array([held[0][s] for s in names], pa.int64())], ["s", "toxic", "ordinary"])
            held[0].clear(), held[1].clear()
            return out

        for b in text_chunks(batches, "text"):
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[y].update(beginnings(t))
            if len(held[0]) + len(held[1]) > 200_000:
                yield flush()
        yield flush()

    parts = small_batches(rows.select("text", "y")).mapInArrow(run, "s string, toxic bigint, ordinary bigint")
    return parts.groupBy("s").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def training_windows(rows: DataFrame) -> DataFrame:
    """(w): windows spread evenly over each text, as the trainer sees them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "text"):
            out = []
            for t in b.column(0).to_pylist():
                words = words_of(t)
                step = max(2 * HALF, len(words) // TRAINING_WINDOWS)
                out.extend(w for i in range(0, len(words), step) if len(w := f" {' '.join(words[i : i + 2 * HALF])} ") <= WINDOW_CHARS)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["w"])

    return small_batches(rows.select("text")).mapInArrow(run, "w string")


def train(docs: DataFrame, sample: DataFrame, id_col: str, text: str) -> Dictionaries:
    """sample: (k, y) of bounded size."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("k")).filter("text is not null").select("text", "y")
    rows = materialize(rows.distinct(), "sample")  # copies count once
    size = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # of at most MAX_ROWS texts, each with about TRAINING_WINDOWS; in an order that no partitioning changes
    windows = sorted(r.w.encode() for r in training_windows(rows.filter("y = 0")).collect())
    if not size.get(1):
        return Dictionaries.of(windows, [])
    frequent = segment_counts(rows).filter(F.col("toxic") >= max(5, size[1] * MIN_SHARE)).filter((F.col("toxic") / size[1]) >= MIN_RATIO * (F.col("ordinary") + 0.5) / max(1, size.get(0, 0)))
    counts = {r.s: (r.toxic, r.ordinary) for r in frequent.orderBy(F.desc("toxic"), "s").limit(20 * MOST_SEGMENTS).collect()}
    return Dictionaries.of(windows, chosen(counts, size[1], size.get(0, 0)))


def feature_table(docs: DataFrame, dictionaries: Dictionaries, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, f): the features of every row's whole text; null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast((dictionaries.base, dictionaries.toxic))  # plain, as workers may lack this package
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        saver = Saver(Dictionaries(*sent.value))
        for b in text_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([saver.features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["id", "f"])

    return small_batches(narrow).mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, f array<double>")


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Weights of the features and a constant, by Newton's method on weighted logistic loss."""
    if not len(y) or not len(np.unique(y)) == 2:
        return [0.0] * len(NAMES) + [math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -math.log(9)]
    x = np.column_stack((x, np.ones(len(x))))
    w, n = np.zeros(x.shape[1]), weight.sum()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x / n + RIDGE * np.eye(len(w)), x.T @ (weight * (y - p)) / n - RIDGE * w)
        w += step / max(1.0, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def logistic(f: Column, weights: list[float]) -> Column:
    total = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        total = total + f[i] * F.lit(w)
    return 1 / (1 + F.exp(F.greatest(F.least(-total, F.lit(500.0)), F.lit(-500.0))))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(id, score) for every row of ``docs``; ``labels`` (id, label) are the rows that may be learned from.

    Null and empty texts have no saving and are scored as such; repeated rows are scored one by one. Rows without a
    label or id teach nothing. Without labels of both kinds every text has the same score, the share of label 1.
    """
    sample = labelled_sample(labels, id_col, label, MAX_ROWS).withColumn("part", F.pmod(F.xxhash64("k", F.lit("half")), F.lit(2)))
    sample = materialize(sample, "labelled")
    dictionaries = train(docs, sample.filter("part = 0").select("k", "y"), id_col, text)
    table = materialize(feature_table(docs, dictionaries, id_col, text), "features")
    found = table.join(F.broadcast(sample.filter("part = 1")), table.id == F.col("k")).groupBy("id", "y", "f").count().orderBy(F.xxhash64("id"), "id", "f").limit(2 * MAX_ROWS).select("y", "f").toArrow()
    x, y = np.array(found.column("f").to_pylist(), float).reshape(-1, len(NAMES)), found.column("y").to_numpy()
    share = {r[0]: r[1] for r in labels.filter(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    weight = np.array([share.get(int(v), 1) / max(1, (y == v).sum()) for v in y])
    return table.select("id", logistic(F.col("f"), calibrate(x, y, weight)).alias("score"))

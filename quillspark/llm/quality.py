"""Document quality by Bradley-Terry pairwise ranking over counts of characters, words and lines.

Preference pairs set a good labelled document against a bad one; logistic loss on the difference of their features
gives weights, the weighted sum is a document's score, and a quantile of the training scores - the share of bad
documents among all that are labelled - is the threshold, which the reported score places at 0.5.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled, materialize, small_batches, text_chunks

#: Labelled rows of either label up to which the driver fits all of them; more are fitted by Spark, all of them too.
MAX_ROWS = 10_000
#: Preference pairs that the driver's fit draws.
PAIRS = 60_000
RIDGE = 1e-3

CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\n\x0b\x0c", b".,;:?'\"()-", b"!", b"|", b"#$%&*+=@^~<>[]{}\\/_`")
NAMES = ("upper", "lower", "digit", "space", "stop", "shout", "bar", "symbol", "length", "words", "word_length", "distinct", "top_word", "repeats", "line_length", "same_lines", "marked_words", "high_bytes")


def features(text: str | None) -> list[float]:
    """The values of NAMES: logarithms of shares (and of sizes), each finite, for any text."""
    raw = (text or "").encode()
    n = len(raw)
    counts = [n - len(raw.translate(None, c)) for c in CLASSES]
    share = lambda k, of: math.log(1e-3 + k / of) if of else math.log(1e-3)
    words, lines = (text or "").split(), [x for x in (text or "").split("\n") if x]
    w = len(words)
    kinds = Counter(words)
    repeats = sum(map(str.__eq__, words, words[1:]))
    marked = sum(k for x, k in kinds.items() if not x[-1].isalnum() and x[-1] not in ".,;:?")
    return [
        *(share(k, n) for k in counts), math.log1p(n), math.log1p(w), math.log1p(n / w if w else 0), share(len(kinds), w), share(max(kinds.values(), default=0), w), share(repeats, w),
        math.log1p(n / len(lines) if lines else 0), share(len(lines) - len(set(lines)), len(lines)), share(marked, w), share(n - len((text or "").encode("ascii", "ignore")), n),
    ]


def feature_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, f): the features of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["id", "f"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return small_batches(narrow).mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, f array<double>")


@dataclass
class Ranking:
    """Weights on raw features; a score is their sum less ``threshold``, over ``scale``."""

    weights: list[float]
    threshold: float
    scale: float

    def column(self, f: Column) -> Column:
        """The score from 0 to 1, 0.5 at the threshold."""
        total = F.lit(-self.threshold)
        for i, w in enumerate(self.weights):
            total = total + f[i] * F.lit(w)
        return 1 / (1 + F.exp(F.greatest(F.least(-total / self.scale, F.lit(500.0)), F.lit(-500.0))))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 7, totals: tuple[int, int] | None = None) -> Ranking:
    """Newton's method on the logistic loss of feature differences. Without both labels every score is 0.5.

    ``totals``: how many rows have label 0 and label 1 where ``x`` and ``y`` are a sample of them; by default they are all.
    A sampled row counts for as many as it stands for, so that the threshold and the scale don't depend on the sample's mix.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking([0.0] * (x.shape[1] if x.ndim == 2 else len(NAMES)), 0.0, 1.0)
    mean, dev = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z, draw = (x - mean) / dev, np.random.default_rng(seed)
    d = z[good[draw.integers(0, len(good), pairs)]] - z[bad[draw.integers(0, len(bad), pairs)]]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))  # chance that the pair is ranked the wrong way
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    below, above = totals or (len(bad), len(good))
    each = np.where(y == 1, above / len(good), below / len(bad))
    order = np.argsort(z @ w, kind="stable")
    s, each = (z @ w)[order], each[order]
    at = min(int(np.searchsorted(np.cumsum(each), below - 1e-6)), len(s) - 1)
    cut = (s[at] + s[min(at + 1, len(s) - 1)]) / 2
    spread = np.sqrt(np.average((s - np.average(s, weights=each)) ** 2, weights=each))
    raw = w / dev
    return Ranking(raw.tolist(), float(cut + raw @ mean), float(max(1e-6, spread / 4)))


def _numbered(rows: DataFrame) -> DataFrame:
    """(i, f): ``rows`` (id, f) numbered from 0 in the order of a hash of their id, over all tasks."""
    order = rows.orderBy(F.xxhash64("id"), "id", "f").select("f").rdd.zipWithIndex()
    return rows.sparkSession.createDataFrame(order.map(lambda r: (r[1], r[0][0])), "i bigint, f array<double>")


def fit_all(rows: DataFrame, bad: int, good: int, ridge: float = RIDGE) -> Ranking:
    """fit() over tables: ``rows`` (id, y, f) has ``bad`` rows of label 0 and ``good`` of label 1.

    Each row is in a preference pair at least: the rows of the rarer label go round until all of the other have one. Tasks
    sum up the gradient and the second derivatives of their pairs, the driver solves for a step. Mean, deviation, the
    threshold's place and the scale are those of all rows.
    """
    k, most = len(NAMES), max(bad, good)
    stats = rows.agg(*[g(F.col("f")[i]) for g in (F.avg, F.stddev_pop) for i in range(k)]).first()
    mean, dev = np.array(stats[:k]), np.maximum(np.array(stats[k:]), 1e-6)
    sides = []
    for y, n in ((1, good), (0, bad)):
        side = _numbered(rows.filter(F.col("y") == y).select("id", "f"))
        sides.append(side.select(F.explode(F.sequence("i", F.lit(most - 1), F.lit(n))).alias("i"), F.col("f").alias(f"f{y}")))
    pairs = materialize(sides[0].join(sides[1], "i").select("f1", "f0"), "pairs")
    w = np.zeros(k)
    for _ in range(30):

        def run(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k + k * k)
            for b in batches:
                d = (b.column(0).flatten().to_numpy() - b.column(1).flatten().to_numpy()).reshape(-1, k) / dev
                p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
                total += np.concatenate((d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

        sums = np.sum([r.s for r in pairs.mapInArrow(run, "s array<double>").collect()], axis=0)  # a row for each task
        step = np.linalg.solve(sums[k:].reshape(k, k) / most + ridge * np.eye(k), sums[:k] / most - ridge * w)
        w = w + step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    raw = w / dev
    s = sum((F.col("f")[i] * float(x) for i, x in enumerate(raw)), F.lit(0.0))
    scores = rows.select(s.alias("s"))
    ends = scores.orderBy("s").rdd.zipWithIndex().filter(lambda r: bad - 1 <= r[1] <= bad).map(lambda r: r[0][0]).collect()  # two rows
    return Ranking(raw.tolist(), float(np.mean(ends)), float(max(1e-6, scores.agg(F.stddev_pop("s")).first()[0] / 4)))


def rank(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(id, score) for every row of ``docs``; ``labels`` (id, label) are the rows that may be learned from.

    Null and empty texts are scored like any other. Rows without a label, with a null one or without an id teach
    nothing; repeated documents are scored row by row. With an empty table or without labels of both kinds every
    score is 0.5.
    """
    table = materialize(feature_table(docs, id_col, text), "features")
    known = labelled(labels, id_col, label)
    rows = table.join(known, table.id == known.k).select("id", "y", "f").distinct()
    counts = dict(rows.groupBy("y").count().collect())
    bad, good = counts.get(0, 0), counts.get(1, 0)
    if bad and good and max(bad, good) > MAX_ROWS:
        model = fit_all(materialize(rows, "labelled"), bad, good)
    else:
        few = rows.orderBy(F.xxhash64("id"), "id", "f").select("y", "f").toArrow()
        x = np.array(few.column("f").to_pylist(), float).reshape(-1, len(NAMES))
        model = fit(x, few.column("y").to_numpy())
    return table.select("id", model.column(F.col("f")).alias("score"))


def learned_from(labels: DataFrame, id_col: str = "doc_id", parts: int = 3, held_out: int = 1) -> DataFrame:
    """The rows of ``labels`` outside the held-out fold."""
    return labels.filter(fold(F.col(id_col), parts) != held_out)

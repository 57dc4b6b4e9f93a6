"""Hard negatives by distributed radix selection over integer scores.

Anchors go in blocks of a bounded size, each of which meets all rows as one matrix product per record batch. What is
wanted of an anchor, or of an anchor and a positive, is a window: the k best rows of a range of scores. No pass sends
the rows of a window anywhere before its kth best row is located: tasks count scores in BUCKETS buckets of each window,
the counts are added up, the bucket that holds the kth row is cut into BUCKETS again, and so on, digit by digit. Rows of
one score go on by the digits of their ids. Only then a last pass gathers the rows up to the kth.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, remove, small_batches

#: Anchors of one block; a block's vectors, windows and counts are what the driver and each worker hold.
ANCHORS = 1024
#: Buckets of a digit, of DIGIT bits.
DIGIT, BUCKETS = 6, 64
#: A window is gathered once at most so many rows lie in the kth row's bucket and the better ones.
GATHER = 64
#: Scores count as at most so much, either way: percentages of them fit 64 bits.
MOST_SCORE = 1 << 55
ALL = np.uint64((1 << 64) - 1)


def integers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(usable, whole): which vectors have finite components only, and floor(scale * component) of those, one row for
    each, short ones with zeros behind."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)  # null components become nan
    row = np.repeat(np.arange(len(column)), sizes)
    usable = np.asarray(column.is_valid()) & (np.bincount(row[~np.isfinite(flat)], minlength=len(column)) == 0)
    width = int(sizes[usable].max(initial=0))
    if len(column) and usable.all() and (sizes == width).all():
        return usable, np.floor(flat.reshape(len(column), width) * scale)
    out, chosen = np.zeros((len(column), width)), usable[row]
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[chosen], at[chosen]] = np.floor(flat[chosen] * scale)
    return usable, out[usable]


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact integer inner products of each row with each anchor, at most MOST_SCORE either way; components that one side
    lacks count as zero."""
    width = min(rows.shape[1], anchors.shape[1])
    rows, anchors = rows[:, :width], anchors[:, :width]
    if not rows.size or not anchors.size:
        return np.zeros((len(rows), len(anchors)), np.int64)
    exact = np.abs(rows).max(axis=1) * np.abs(anchors).max() * width < 2.0**53  # doubles hold such sums
    out = (np.where(exact[:, None], rows, 0) @ anchors.T).astype(np.int64)
    if not exact.all():
        whole = np.frompyfunc(int, 1, 1)
        out[~exact] = np.clip(whole(rows[~exact]) @ whole(anchors).T, -MOST_SCORE, MOST_SCORE).astype(np.int64)
    return out


def order_of(ids: np.ndarray) -> np.ndarray:
    """64-bit ids as unsigned numbers of the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _shift(span: np.ndarray) -> np.ndarray:
    """How far numbers up to ``span`` are shifted so that one digit is left."""
    bits = np.array([int(x).bit_length() for x in span], np.int64)
    return np.maximum(0, bits - DIGIT).astype(np.uint64)


class Windows:
    """Where the kth best row of each window lies: the state of the radix selection.

    A row's place is its distance from the window's greatest score; among rows of the kth score, ``by_id`` windows go on
    by the place of the id. ``limit`` and ``id_limit`` are what is known in the end: rows at less than ``limit``
    qualify, and those at it if their ids are up to ``id_limit``.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, ids: tuple[int, int], k: int) -> None:
        n = len(low)
        self.low, self.high, self.k = low, high, k
        self.first, self.last = (order_of(np.array([x])) for x in ids)
        self.open = high >= low
        self.by_id = np.zeros(n, bool)
        self.base, self.limit, self.id_limit = np.zeros(n, np.uint64), np.full(n, ALL), np.full(n, ALL)
        self.shift = _shift(np.where(self.open, high - low, 0))
        self.better = np.zeros(n, np.int64)

    def places(self, w: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance from the greatest score, place of the id)."""
        return (self.high[w] - scores).view(np.uint64), order_of(ids) - self.first[0]

    def count(self, w: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and buckets of the rows that lie in what is open of their windows."""
        far, at = self.places(w, scores, ids)
        by_id = self.by_id[w]
        place = np.where(by_id, at, far)
        inside = self.open[w] & (~by_id | (far == self.limit[w])) & (place >= self.base[w])
        w, place = w[inside], place[inside]
        bucket = (place - self.base[w]) >> self.shift[w]
        held = bucket < BUCKETS
        return w[held], bucket[held].astype(np.int64)

    def settle(self, counts: np.ndarray) -> None:
        """Take one more digit from the counts by window and bucket."""
        total = self.better[:, None] + np.cumsum(counts, axis=1)
        for w in np.flatnonzero(self.open):
            if total[w, -1] < self.k:  # the whole window has fewer than k rows
                self.open[w] = False
                continue
            b = int(np.argmax(total[w] >= self.k))
            base, shift = int(self.base[w]) + (b << int(self.shift[w])), int(self.shift[w])
            end = np.uint64(min(base + (1 << shift) - 1, int(ALL)))
            if total[w, b] <= max(GATHER, self.k) or (shift == 0 and self.by_id[w]):
                self.open[w] = False
                (self.id_limit if self.by_id[w] else self.limit)[w] = end
                continue
            self.better[w] = total[w, b - 1] if b else self.better[w]
            if shift:
                self.base[w], self.shift[w] = base, max(0, shift - DIGIT)
            else:
                self.by_id[w], self.limit[w], self.base[w] = True, base, 0
                self.shift[w] = _shift(self.last - self.first)[0]

    def chosen(self, w: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which rows qualify, no more than the k best of a window among these."""
        far, at = self.places(w, scores, ids)
        out = np.flatnonzero((far < self.limit[w]) | ((far == self.limit[w]) & (at <= self.id_limit[w])))
        out = out[np.lexsort((at[out], far[out], w[out]))]
        ranked = w[out]
        start = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(out) else np.empty(0, np.int64)
        rank = np.arange(len(out)) - np.repeat(start, np.diff(np.r_[start, len(out)]))
        return out[rank < self.k]


class Block:
    """A block of anchors; ``each`` windows of an anchor stand together."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, scale: float) -> None:
        self.ids, self.labels, self.vectors, self.scale = ids, labels, vectors, scale

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, labels, scores by row and anchor) of a batch's usable rows."""
        usable, whole = integers(batch.column(2), self.scale)
        ids, labels = (batch.column(i).to_numpy(zero_copy_only=False)[usable] for i in (0, 1))
        return ids, labels, products(whole, self.vectors)

    def alike(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, score, id) of each row and anchor that share a label and are not the same id."""
        ids, labels, scores = self.read(batch)
        r, a = np.nonzero((labels[:, None] == self.labels[None, :]) & (ids[:, None] != self.ids[None, :]))
        return a, scores[r, a], ids[r]

    def unlike(self, batch: pa.RecordBatch, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, score, id) of the rows of another label that lie in a window; low and high are by anchor and window."""
        ids, labels, scores = self.read(batch)
        near = (scores >= low.min(axis=1)) & (scores <= high.max(axis=1)) & (labels[:, None] != self.labels[None, :])
        r, a = np.nonzero(near)
        s, v = scores[r, a], ids[r]
        for j in range(low.shape[1]):
            inside = (s >= low[a, j]) & (s <= high[a, j])
            yield a[inside] * low.shape[1] + j, s[inside], v[inside]


Rows = Callable[[Block, pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _again(kind: type, state: dict):
    """An object from the vars() of another: workers get plain values, as they may lack this package."""
    out = kind.__new__(kind)
    out.__dict__.update(state)
    return out


def _pass(rows: DataFrame, values: tuple, run: Callable, schema: str) -> DataFrame:
    """One reading of the rows by ``run`` over (values, batches); the values go to the workers as a broadcast."""
    sent, kinds = rows.sparkSession.sparkContext.broadcast([vars(v) for v in values]), [type(v) for v in values]
    return small_batches(rows).mapInArrow(lambda batches: run([_again(k, x) for k, x in zip(kinds, sent.value, strict=True)], batches), schema)


def _locate(rows: DataFrame, block: Block, windows: Windows, pairs: Rows) -> None:
    """Refine the windows until each knows its kth row: one reading of the rows for each digit."""

    def counted(values: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows = values
        counts = np.zeros(len(windows.low) * BUCKETS, np.int64)
        for batch in batches:
            for found in pairs(block, batch):
                w, bucket = windows.count(*found)
                counts += np.bincount(w * BUCKETS + bucket, minlength=len(counts))
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["cell", "n"])

    while windows.open.any():
        added = _pass(rows, (block, windows), counted, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
        got, counts = added.toArrow(), np.zeros(len(windows.low) * BUCKETS, np.int64)  # as many cells as the block has at most
        counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
        windows.settle(counts.reshape(-1, BUCKETS))


def _gather(rows: DataFrame, block: Block, windows: Windows, pairs: Rows) -> DataFrame:
    """(w, rank, score, id): the k best of each window."""

    def kept(values: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows = values
        for batch in batches:
            for w, scores, ids in pairs(block, batch):
                best = windows.chosen(w, scores, ids)
                yield pa.RecordBatch.from_arrays([pa.array(x[best].astype(np.int64)) for x in (w, scores, ids)], ["w", "score", "id"])

    found = _pass(rows, (block, windows), kept, "w bigint, score bigint, id bigint")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= windows.k)


def _positives(rows: DataFrame, block: Block, ids: tuple[int, int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(there, id, score) by anchor and rank: the k best rows of the anchor's own label."""

    def ranges(values: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = values[0]
        n = len(block.ids)
        low, high = np.full(n, MOST_SCORE), np.full(n, -MOST_SCORE - 1)
        for batch in batches:
            a, scores, _ = block.alike(batch)
            np.minimum.at(low, a, scores)
            np.maximum.at(high, a, scores)
        some = np.flatnonzero(high >= low)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(low[some]), pa.array(high[some])], ["a", "low", "high"])

    got = _pass(rows, (block,), ranges, "a bigint, low bigint, high bigint").groupBy("a").agg(F.min("low"), F.max("high")).toArrow()
    n = len(block.ids)
    low, high = np.zeros(n, np.int64), np.full(n, -1)
    low[got.column(0).to_numpy()], high[got.column(0).to_numpy()] = got.column(1).to_numpy(), got.column(2).to_numpy()
    windows = Windows(low, high, ids, k)
    pairs: Rows = lambda block, batch: iter([block.alike(batch)])
    _locate(rows, block, windows, pairs)
    best = _gather(rows, block, windows, pairs).toArrow()
    there, pos, score = np.zeros((n, k), bool), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
    at = best.column("w").to_numpy(), best.column("rank").to_numpy() - 1
    there[at], pos[at], score[at] = True, best.column("id").to_numpy(), best.column("score").to_numpy()
    return there, pos, score


def _negatives(rows: DataFrame, block: Block, ids: tuple[int, int], positives: tuple, k: int, low: int, high: int) -> DataFrame:
    there, pos, score = positives
    least, most = -((-low * score) // 100), (high * score) // 100
    least, most = np.where(there, least, 1), np.where(there, most, 0)  # no row fits a positive that isn't there
    windows = Windows(least.ravel(), most.ravel(), ids, k)
    pairs: Rows = lambda block, batch: block.unlike(batch, least, most)
    _locate(rows, block, windows, pairs)
    best = _gather(rows, block, windows, pairs)
    sent = rows.sparkSession.sparkContext.broadcast((np.repeat(block.ids, pos.shape[1]), pos.ravel(), score.ravel()))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(0).to_numpy()
            anchor, positive, points = (pa.array(x[w]) for x in sent.value)
            yield pa.RecordBatch.from_arrays([anchor, positive, b.column(1), b.column(2), points, b.column(3)], SCHEMA)

    kinds = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return best.select("w", "rank", "id", "score").mapInArrow(named, kinds)


SCHEMA = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5,
    scale: float = 256, low: int = 80, high: int = 100, block_size: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    ``positives`` other rows of its label, the first ``negatives`` rows of another label with a score between ``low`` and
    ``high`` percent of the positive's.

    A score is the inner product of floor(``scale`` * component), exact in integers; higher scores come first, ties by
    smaller id. Ids are integers. Rows with a null id, label or vector, or with a null or non-finite component take no
    part. A vector that is shorter than another has zeros behind. Repeated rows count as often as they stand; an anchor
    that repeats as a whole counts once, and rows of an anchor's own id are none of its positives. An empty table, or
    one without anchors, gives an empty result. Other columns don't matter.
    """
    spark, held = rows.sparkSession, []
    narrow = rows.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    narrow = narrow.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("vector"), is_anchor.alias("is_anchor"))
    anchors, narrow = narrow.filter("is_anchor").select("id", "label", "vector").distinct(), narrow.select("id", "label", "vector")
    anchors = materialize(anchors, "anchors", held)
    n, ids = anchors.count(), narrow.agg(F.min("id"), F.max("id")).first()
    blocks, paths = -(-n // block_size), []
    for b in range(blocks):
        mine = anchors.filter(F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks)) == b).toArrow()  # a bounded block
        usable, whole = integers(mine.column(2), scale)
        if not usable.any():
            continue
        block = Block(*(mine.column(i).to_numpy()[usable] for i in (0, 1)), whole, scale)
        found = _negatives(narrow, block, ids, _positives(narrow, block, ids, positives), negatives, low, high)
        materialize(found, "negatives", paths)
    remove(spark, held)
    kinds = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.read.schema(kinds).parquet(*paths) if paths else spark.createDataFrame([], kinds)

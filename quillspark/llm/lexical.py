"""Ranked lexical search as a blocked product of sparse matrices.

Items are rows of one matrix (how often an item has a term), documents are columns of another (the int64 impact of a term
in a document). Tasks hold blocks of documents by term; each item's row of the product is merged from the rows of its
terms, as in Gustavson's algorithm, and only the k best of a block go on: to the task's k best, then over tasks in two
steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, small_batches, text_chunks

#: Bytes of item texts searched for in one reading of the documents; more items take further readings.
ITEM_BYTES = 4 << 20
#: Documents and postings of a block.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 2_000_000
#: Parts in which the k best of tasks meet before all of an item do.
PARTS = 64
#: Bytes that end a term become blanks, A-Z become a-z; all bytes beyond ASCII belong to terms.
FOLDED = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(FOLDED).split() if text else []


def weight(n: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """A document's m by its number of terms, exact beyond 64 bits."""
    kinds, at = np.unique(n, return_inverse=True)
    return np.array([75 + 25 * int(x) * docs // total for x in kinds], np.int64)[at]


def item_blocks(items: DataFrame, item_id: str, text: str, most_bytes: int) -> Iterator[list[tuple]]:
    """Lists of (place, item_id, terms with their numbers) of all items with a text, each list of at most ``most_bytes``
    of text or one item."""
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("t is not null").orderBy("i", "t")
    held, size = [], 0
    for place, r in enumerate(rows.toLocalIterator()):
        raw = r.t.encode()
        if held and size + len(raw) > most_bytes:
            yield held
            held, size = [], 0
        held.append((place, r.i, Counter(terms_of(raw))))
        size += len(raw)
    if held:
        yield held


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of each document with a term: n counts its terms with repeats, terms are those of the
    vocabulary, numbered from 1."""
    narrow = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for b in text_chunks(batches, "text"):
            n, ends, terms, tfs = [], [0], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(text)
                kinds, times = np.unique(np.fromiter(filter(None, map(number, words)), np.int32), return_counts=True)
                n.append(len(words))
                ends.append(ends[-1] + len(kinds))
                terms.append(kinds)
                tfs.append(times)
            flat = [np.concatenate(x) if x else np.empty(0) for x in (terms, tfs)]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in flat]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tfs"])
            yield out.filter(pc.greater(out.column(1), 0))

    kind = narrow.schema["id"].dataType.simpleString()
    return small_batches(narrow).mapInArrow(run, f"id {kind}, n bigint, terms array<int>, tfs array<int>")


class Best:
    """The k best documents of each item: by score, equal ones by ascending id, null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.held = k, [[] for _ in range(items)]

    def least(self, item: int) -> int:
        """The score that a document must have at least."""
        held = self.held[item]
        return -held[-1][0] if len(held) == self.k else 1

    def add(self, item: int, scores: np.ndarray, order: np.ndarray, ids: pa.Array) -> None:
        """Take a block's scores; ``order`` is the place of each document's id among the block's."""
        at = np.flatnonzero(scores >= self.least(item))
        if len(at) > self.k:
            at = at[scores[at] >= np.partition(scores[at], -self.k)[-self.k]]
        at = at[np.lexsort((order[at], -scores[at]))][: self.k]
        if len(at):
            new = zip((-scores[at]).tolist(), ids.take(pa.array(at)).to_pylist(), strict=True)
            self.held[item] = sorted(self.held[item] + [(s, i is None, i) for s, i in new], key=lambda x: x[:2] if x[1] else x)[: self.k]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of postings joined to blocks of documents."""
    held, docs, size = [], 0, 0
    for b in batches:
        held, docs, size = [*held, b], docs + b.num_rows, size + len(b.column(2).flatten())
        if docs >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, docs, size = [], 0, 0
    if docs:
        yield pa.Table.from_batches(held).combine_chunks()


def block_product(table: pa.Table, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, docs: int, total: int) -> Iterator[np.ndarray]:
    """Each item's scores of a block's documents."""
    n, lists, tfs = table.column("n").to_numpy(), table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
    term, tf = lists.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(n)), np.asarray(pc.list_value_length(lists)))
    impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * lengths(n, docs, total)[doc]))
    by_term = np.argsort(term, kind="stable")
    term, doc, impact = term[by_term], doc[by_term], impact[by_term]
    for mine, times in items:
        out = np.zeros(len(n), np.int64)
        for start, end, m in zip(np.searchsorted(term, mine), np.searchsorted(term, mine, side="right"), times, strict=True):
            out[doc[start:end]] += m * impact[start:end]  # a term has a document once
        yield out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("id")]
    part = found.withColumn("part", F.spark_partition_id() % PARTS)
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = ITEM_BYTES
) -> DataFrame:
    """(item_id, rank, id, score): the k documents of the highest score above 0 of each item, equal scores by ascending id.

    All documents with a term are counted and searched. Null and empty texts have no term; items without a term, or
    whose terms no document has, have no row. Repeated documents are documents of their own, as are repeated items:
    each has its own ranks. Null ids rank last among equal scores. Empty tables give an empty result.
    """
    spark, out = docs.sparkSession, None
    kind, id_kind = items.schema[item_id].dataType, docs.schema[id_col].dataType.simpleString()
    schema = f"item bigint, item_id {kind.simpleString()}, id {id_kind}, score bigint"
    arrow, id_arrow = to_arrow_type(kind), to_arrow_type(docs.schema[id_col].dataType)
    for block in item_blocks(items, item_id, item_text, most_bytes):
        words = sorted({t for _, _, terms in block for t in terms})
        vocabulary = {t: i for i, t in enumerate(words, 1)}
        table = materialize(postings(docs, vocabulary, id_col, text_col), "postings")
        n, total = table.agg(F.count("*"), F.sum("n")).first()
        if not n:
            continue
        weights = np.zeros(len(words) + 1, np.int64)
        for r in table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():
            weights[r.t] = weight(n, r.df)
        rows = [(np.array(sorted(vocabulary[t] for t in terms), np.int64), np.array([c for _, c in sorted((vocabulary[t], c) for t, c in terms.items())], np.int64)) for _, _, terms in block]
        sent = spark.sparkContext.broadcast((rows, weights, n, total, [p for p, _, _ in block], [i for _, i, _ in block]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, k=k) -> Iterator[pa.RecordBatch]:
            rows, weights, n, total, places, names = sent.value
            best = Best(len(rows), k)
            for table in _blocks(batches):
                ids = table.column("id").combine_chunks()
                order = np.empty(len(ids), np.int64)
                order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                for item, scores in enumerate(block_product(table, rows, weights, n, total)):
                    best.add(item, scores, order, ids)
            flat = [(i, *x) for i, held in enumerate(best.held) for x in held]
            yield pa.RecordBatch.from_arrays(
                [pa.array([places[f[0]] for f in flat], pa.int64()), pa.array([names[f[0]] for f in flat], arrow), pa.array([f[3] for f in flat], id_arrow), pa.array([-f[1] for f in flat], pa.int64())],
                ["item", "item_id", "id", "score"],
            )

        found = small_batches(table).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return _ranked(out, k).select("item_id", "rank", "id", "score")

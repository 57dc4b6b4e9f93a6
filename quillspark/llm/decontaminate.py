"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Every training text is cut into overlapping passages; each passage is a query. An item is retrieved if the passage's
BM25 score reaches ``threshold`` of the score that the item's own text gets. WAND's test of upper bounds runs for a
batch of passages at a time: first on the terms' maxima, then on the maxima of blocks of items; only blocks that can
reach the threshold have their postings scored. Retrieved pairs are verified by the five-word shingles of the item's
question and answer found in the passage.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches, text_chunks

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE_WORDS = 5
#: Bytes of item texts in one index; more items make further indexes, with the same statistics.
INDEX_BYTES = 16 << 20
#: Indexes that a worker holds and searches in one reading of the texts; more take a further reading.
HELD = 4
MOST_BLOCKS = 32
CACHE_WORDS = 200_000
EDGES = "\"'`´.,;:!?()[]{}<>|*#$%&/\\=+-_~^@«»„“”‘’…"


def words_of(text: str) -> list[str]:
    """Lower-cased words without punctuation at their ends."""
    return [w for x in text.lower().split() if (w := x.strip(EDGES))]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Five-word shingles; of fewer words the whole sequence."""
    return {tuple(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))} if words else set()


def shared(part: set[tuple[str, ...]], words: list[str], have: set[tuple[str, ...]]) -> float:
    """Share of the shingles of ``part`` that a passage has; a part of fewer than five words is looked for as a whole."""
    first = next(iter(part), ())
    if len(first) < SHINGLE_WORDS:
        return float(f" {' '.join(first)} " in f" {' '.join(words)} ")
    return len(part & have) / len(part)


def parts(text: str) -> tuple[list[str], list[str]]:
    """An item's question and answer: its last sentence is the answer, if another one stands before it."""
    sentences = [w for s in re.split(r"(?<=[.!?])\s+|\n+", text) if (w := words_of(s))]
    return [w for s in sentences[:-1] for w in s] or (sentences[-1] if sentences else []), sentences[-1] if len(sentences) > 1 else []


@dataclass
class Statistics:
    """What BM25 takes from all items, however they are cut into indexes: their number, mean and greatest length, and in
    how many of them each word stands."""

    n: int
    mean: float
    longest: int
    df: Counter

    @classmethod
    def of(cls, texts) -> Statistics:
        n, total, longest, df = 0, 0, 1, Counter()
        for t in texts:
            if t and (w := words_of(t)):
                n, total, longest = n + 1, total + len(w), max(longest, len(w))
                df.update(set(w))
        return cls(n, total / n if n else 1.0, longest, df)


class Index:
    """Postings of BM25 impacts, each divided by its item's own score, with their maxima by term and by block."""

    def __init__(self, items: list[tuple], every: Statistics | None = None) -> None:
        """items: (item_id, text). Items without a word are left out. ``every``: statistics of all items, if there are more."""
        every = every or Statistics.of(t for _, t in items)
        kept = [(i, t, w) for i, t in items if t and (w := words_of(t))]
        self.ids = [i for i, _, _ in kept]
        self.words = [w for _, _, w in kept]
        self.all = [shingles(w) for w in self.words]
        self.parts = [tuple(shingles(p) for p in parts(t)) for _, t, _ in kept]
        n = len(kept)
        counts = [Counter(w) for w in self.words]
        df = sorted({t for c in counts for t in c})  # sums go by word, whatever the cut
        self.vocabulary = {t: k for k, t in enumerate(df)}
        mean, self.longest = every.mean, every.longest
        idf = {t: math.log(1 + (every.n - every.df[t] + 0.5) / (every.df[t] + 0.5)) for t in df}
        block = max(1, -(-n // MOST_BLOCKS))
        self.block = block
        self.postings: list[list[tuple[int, float]]] = [[] for _ in df]
        self.block_max = np.zeros((len(df) + 1, -(-n // block) if n else 0), np.float32)
        for i, c in enumerate(counts):
            impact = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(self.words[i]) / mean)) for t, f in c.items()}
            own = sum(impact.values())
            for t, x in impact.items():
                k = self.vocabulary[t]
                self.postings[k].append((i, x / own))
                self.block_max[k, i // block] = max(self.block_max[k, i // block], x / own)
        self.most = self.block_max.max(axis=1) if n else np.zeros(len(df) + 1, np.float32)

    def score(self, terms: set[int], block: int) -> dict[int, float]:
        """Normalised BM25 of one block's items for a query of distinct terms."""
        low, high, out = (block * self.block,), ((block + 1) * self.block,), {}
        for t in sorted(terms):
            held = self.postings[t]  # by item
            for i, x in held[bisect_left(held, low) : bisect_left(held, high)]:
                out[i] = out.get(i, 0.0) + x
        return out

    @classmethod
    def again(cls, state: dict) -> Index:
        """An index from the vars() of another: workers get plain values, as they may lack this package."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out


class Terms(dict):
    """Words as they stand to term ids: unknown words have the last id, marks without a letter or digit -1."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        bare = word.strip(EDGES)
        self[word] = k = self.vocabulary.get(bare, len(self.vocabulary)) if bare else -1
        return k


class Searcher:
    """Queries texts against one index; keeps a bounded table of words seen."""

    def __init__(self, index: Index, threshold: float, overlap: float) -> None:
        self.index, self.threshold, self.overlap = index, threshold, overlap
        self.seen = Terms(index.vocabulary)
        self.window = max(128, 2 * index.longest)
        self.stride = self.window - index.longest

    def _ids(self, text: str) -> list[int]:
        """Term ids of a text's words."""
        return [k for k in map(self.seen.__getitem__, text.lower().split()) if k >= 0]

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float, float]]:
        """(text's place, item's place, score, overlap, question's, answer's) of every pair found, best passage first."""
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        unknown = len(self.index.vocabulary)
        for place, t in enumerate(texts):
            if not t:
                continue
            ids = np.array(self._ids(t), np.int64)
            starts = np.arange(0, max(1, len(ids) - self.index.longest), self.stride)
            ends = np.minimum(starts + self.window, len(ids))
            if not len(ids) or not len(self.index.ids):
                continue
            eps = 1e-4  # 32-bit sums
            most = np.concatenate(([0], np.cumsum(self.index.most[ids], dtype=np.float64)))
            able = np.flatnonzero(most[ends] - most[starts] >= self.threshold - eps)
            best: dict[int, tuple] = {}
            for p in able.tolist():
                terms = np.unique(ids[starts[p] : ends[p]])
                bound = self.index.block_max[terms].sum(axis=0)
                blocks = np.flatnonzero(bound >= self.threshold - eps)
                if not len(blocks):
                    continue
                query, passage = {k for k in terms.tolist() if k != unknown}, None
                for block in blocks.tolist():
                    for i, x in self.index.score(query, block).items():
                        if x >= self.threshold and x > best.get(i, (0,))[0]:
                            if passage is None:
                                words = words_of(t)[starts[p] : ends[p]]
                                passage = words, shingles(words)
                            whole = shared(self.index.all[i], *passage)
                            sides = [shared(s, *passage) if s else whole for s in self.index.parts[i]]
                            if whole >= self.overlap and min(sides) > 0:
                                best[i] = (x, whole, *sides)
            for i, found in sorted(best.items()):
                yield place, i, *found


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", most_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes over all items, each of at most ``most_bytes`` of text (or one item), with the statistics of all."""
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("t is not null").orderBy("i", "t")
    every, held, size = Statistics.of(r.t for r in rows.toLocalIterator()), [], 0
    for r in rows.toLocalIterator():
        n = len(r.t.encode())
        if held and size + n > most_bytes:
            yield Index(held, every)
            held, size = [], 0
        held.append((r.i, r.t))
        size += n
    yield Index(held, every)


def _held(docs: DataFrame, items: DataFrame, item_id: str, text: str) -> Iterator:
    """Broadcasts of up to HELD indexes' plain values each."""
    held: list[dict] = []
    for index in indexes(items, item_id, text):
        held.append(vars(index))
        if len(held) == HELD:
            yield docs.sparkSession.sparkContext.broadcast(held)
            held = []
    if held:
        yield docs.sparkSession.sparkContext.broadcast(held)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(id, item_id, score, overlap, question_overlap, answer_overlap): each row of ``docs`` with each item it holds.

    Null and empty texts hold none; repeated rows and repeated items each give their own rows. Whole texts are
    searched. No shuffle: items go to the workers, in indexes of a bounded size; where they are cut changes nothing.
    """
    out, kind = None, items.schema[item_id].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    arrow = to_arrow_type(items.schema[item_id].dataType)
    for sent in _held(docs, items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searchers = [Searcher(Index.again(state), threshold, overlap) for state in sent.value]
            for b in text_chunks(batches, "text"):
                texts = b.column(1).to_pylist()
                found = [(f[0], s.index.ids[f[1]], *f[2:]) for s in searchers for f in s(texts)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], arrow), *(pa.array([f[k] for f in found], pa.float64()) for k in range(2, 6))],
                    ["id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"],
                )

        hits = small_batches(narrow).mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, item_id {kind}, score double, overlap double, question_overlap double, answer_overlap double")
        out = hits if out is None else out.unionByName(hits)
    return out


def remove(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    at, wide = docs.columns.index(text), docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    for sent in _held(docs, items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searchers = [Searcher(Index.again(state), threshold, overlap) for state in sent.value]
            for b in text_chunks(batches, f"c{at}"):
                texts = b.column(at).to_pylist()
                bad = {f[0] for s in searchers for f in s(texts)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        wide = small_batches(wide).mapInArrow(run, wide.schema)
    return wide.toDF(*docs.columns)

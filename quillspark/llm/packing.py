"""Harmonic packing of tokenised documents into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: a length in (C/(k+1), C/k] is of class k, and every sequence of class k
takes k pieces. A document is cut into full sequences, then into halves of the capacity down to ``smallest`` tokens;
those pieces fill their classes to the last token, and only the short rest of a document leaves padding. Each task
fills its own sequences from its own rows in their order, so nothing is shuffled and a task run again gives the same.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbering, small_batches, text_chunks

CAPACITY = 2048
END_ID = 1
SMALLEST = 64
CACHE_WORDS = 400_000


#: How a tokenizer must normalise and cut texts for its words to be encoded one by one, as its file says it.
NORMALISED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def by_words(tokenizer) -> bool:
    """Whether a tokenizer drops white space and letters' case, by the normaliser and the cuts that Encoder relies on."""
    steps = [json.loads(x.__getstate__()) if x is not None else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    return steps[0] == NORMALISED and (steps[1].get("pretokenizers") or [None])[0] == CUT


class Encoder:
    """Token ids of texts. Where by_words() holds, no token spans a blank, and the ids are those of the words one after
    another; with any other tokenizer whole texts are encoded.

    Words are kept with A-Z in lower case, and cut where an ASCII mark other than the apostrophe follows a letter, as
    the tokenizer cuts there in any case. New words are encoded many at a time around a mark that is a token of its own.
    """

    MARK = "\x01"
    STOPS = re.compile(rb"(?<=[a-z])([!-&(-/:-@\[-`{-~])")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread to a task
        self.tokenizer = Tokenizer.from_file(path)
        self.whole = not by_words(self.tokenizer)
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._reset()

    def _reset(self) -> None:
        self.seen = Numbering()
        self.pool, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        plain = self.mark is not None and not any("<|" in t or self.MARK in t for t in texts)
        parts = [f" {self.MARK} ".join(texts[i : i + 256]) for i in range(0, len(texts), 256)] if plain else texts
        got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        if plain:
            flat = np.concatenate([x for g in got for x in (g, [np.uint32(self.mark)])])
            ends = np.flatnonzero(flat == self.mark)
            size = np.diff(np.concatenate(([-1], ends))) - 1
            if len(size) != len(words):  # a word gives the mark itself
                self.mark = None
                return self._learn(words)
            flat = flat[flat != self.mark]
        else:
            flat, size = np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(size) - size))
        self.size, self.pool = np.concatenate((self.size, size)), np.concatenate((self.pool, flat))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.whole:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.seen) > CACHE_WORDS:
            self._reset()
        ids, counts, number = [], [], self.seen.__getitem__
        for t in texts:
            raw = t.encode()
            words = raw.split() if b"<|" in raw else self.STOPS.sub(rb" \1", raw.lower()).split()
            ids.extend(map(number, words))
            counts.append(len(words))
        for i in range(0, len(self.seen.new), 8192):
            self._learn(self.seen.new[i : i + 8192])
        self.seen.new.clear()
        at = np.array(ids, np.int64)
        size, start = self.size[at], self.start[at]
        ends = np.cumsum(size)
        flat = self.pool[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - start, size)]
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def cut(total: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths of a document's pieces, longest first."""
    out = [capacity] * (total // capacity)
    rest, half = total % capacity, capacity // 2
    while rest and half >= smallest:
        if rest >= half:
            out.append(half)
            rest -= half
        half //= 2
    return out + [rest] * (rest > 0)


class Packer:
    """Sequences of one task. Holds at most one open sequence for each class."""

    def __init__(self, first_id: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next, self.open = capacity, first_id, {}

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for p in pieces:
            yield (*p, self.next, offset)
            offset += p[2]
        self.next += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        """piece: (id, start, length, ...). Yields (..., sequence, offset) of the sequence that became full."""
        k = self.capacity // piece[2]
        mine = self.open.setdefault(k, [])
        mine.append(piece)
        if len(mine) == k:
            yield from self._sequence(self.open.pop(k))

    def close(self) -> Iterator[tuple]:
        """Sequences left open share the last ones: by first fit, longest pieces first."""
        bins: list[list] = []
        for p in sorted((p for ps in self.open.values() for p in ps), key=lambda p: -p[2]):
            fit = next((b for b in bins if b[0] + p[2] <= self.capacity), None)
            if fit is None:
                bins.append(fit := [0, []])
            fit[0] += p[2]
            fit[1].append(p)
        for _, pieces in bins:
            yield from self._sequence(pieces)
        self.open = {}


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, smallest: int = SMALLEST, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Null text counts as empty: such a document has the end id alone. Repeated rows and ids are packed once for each
    row. ``tokenizer`` is a file that every executor can open. Longest texts are held one at a time.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(tokenizer), Packer(TaskContext.get().partitionId() << 40, capacity)
        kind = None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found)) or [()] * 8
            out = [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in (cols[1], cols[2], cols[3], cols[5], cols[6], cols[7]))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[4]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(out, names)

        for b in text_chunks(batches, "text"):
            kind, found = b.schema.field(0).type, []
            for key, ids in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start = 0
                for n in cut(len(ids), capacity, smallest):
                    body = ids[start : start + n].tobytes()
                    found.extend(packer.add((key, start, n, zlib.crc32(body), body if with_ids else b"", len(ids))))
                    start += n
            if found:
                yield rows(found)
        if last := list(packer.close()):
            yield rows(last)

    key = narrow.schema["id"].dataType.simpleString()
    return small_batches(narrow).mapInArrow(run, f"id {key}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids)

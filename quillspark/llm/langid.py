"""Language identification by interpolated Kneser-Ney character models kept in sorted hash arrays.

A text is read as lower-cased letter runs; each letter, and the end of each run, is predicted from up to three
characters before it in the run. The language of the lowest cross-entropy per character is chosen. Cross-entropies of
the training rows calibrate how high one may be before a text is rejected.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Numbering, materialize, small_batches, text_chunks

ORDER = 4
PAD, END = 1, 2
#: Scored words and n-grams that a worker keeps.
CACHE_WORDS = 200_000
CACHE_GRAMS = 400_000
#: Standard deviations above a language's mean cross-entropy at which a text is rejected. Texts that mix learned
#: languages lie 6 to 13 above it and stay; letters in no learned order lie beyond 30.
REJECT_SIGMA = 16.0


def _codes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (16 bits) of the tokens' letters with separators, and each position's token."""
    text = re.sub(r"[^\w\n]|[\d_]", " ", "\n".join(tokens).lower()) + "\n"
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    owner = np.cumsum(c == 10) - (c == 10)
    c = np.where(c > 0xFFFF, 0xFFFD, c).astype(np.uint64)
    c[(c == 10) | (c == 32)] = END
    return c, owner


def grams(tokens: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For every letter and run end: packed n-grams of orders 1..ORDER (exact 16-bit fields, newest lowest), and the
    token it belongs to. Context before the run is PAD."""
    if not tokens:
        return [np.empty(0, np.uint64)] * ORDER, np.empty(0, np.int64)
    c, owner = _codes(tokens)
    before = np.concatenate((np.full(ORDER - 1, END, np.uint64), c))
    n = len(c)
    real = (c != END) | (before[ORDER - 2 : ORDER - 2 + n] != END)
    packed, past, out = c.copy(), np.zeros(n, bool), []
    out.append(packed[real])
    for k in range(1, ORDER):
        prev = before[ORDER - 1 - k : ORDER - 1 - k + n]
        past = past | (prev == END)
        packed = packed | (np.where(past, np.uint64(PAD), prev) << np.uint64(16 * k))
        out.append(packed[real])
    return out, owner[real]


def count_grams(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n): counts of the highest order over all texts with a language, summed in the worker and again
    before the shuffle. The packed gram is a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        rows = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                keys, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for b in text_chunks(batches, "text"):
            words: dict[str, Counter] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words.setdefault(name, Counter()).update(t.split())
            for name, counter in words.items():
                tokens = list(counter)
                packed, owner = grams(tokens)
                weights = np.fromiter(counter.values(), np.int64, len(tokens))[owner]
                held.setdefault(name, []).append(merged([(packed[-1], weights)]))
                held[name] = [merged(held[name])] if len(held[name]) > 4 else held[name]
            rows = sum(len(k) for parts in held.values() for k, _ in parts)
            if rows > 500_000:
                yield from flush()
                held = {}
        yield from flush()

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    return small_batches(rows).mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted n-gram arrays per order with a column per language: discounted probabilities and back-off weights."""

    langs: list[str]
    grams: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    base: np.ndarray

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], max_grams: int | None = None) -> Model:
        """counts: packed highest-order n-grams and their counts, by language. Lower orders use continuation counts.
        ``max_grams`` drops probabilities of the rarest highest-order n-grams, in whole count buckets, when all counts
        have been used; what they had goes to the back-off weights."""
        langs, per = sorted(counts), []
        for name in langs:
            keys, n = counts[name]
            order = np.argsort(keys)
            keys, n, levels = keys[order], n[order].astype(float), []
            for k in range(ORDER, 0, -1):
                n1, n2 = (n == 1).sum(), (n == 2).sum()
                d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
                ctx, inverse = np.unique(keys >> np.uint64(16), return_inverse=True)
                total, kinds = np.bincount(inverse, n), np.bincount(inverse)
                held, probs, weights = keys, np.maximum(n - d, 0) / total[inverse], d * kinds / total
                if k == ORDER and max_grams is not None and len(keys) > max_grams:
                    bucket = np.floor(np.log2(n) * 8).astype(int)
                    sizes = np.bincount(bucket)[::-1]
                    fit = max(int((np.cumsum(sizes) <= max_grams).sum()), int(np.flatnonzero(sizes)[0]) + 1)
                    stay = bucket >= len(sizes) - fit
                    weights = weights + np.bincount(inverse[~stay], probs[~stay], len(ctx))
                    held, probs = keys[stay], probs[stay]
                levels.append((held, probs, ctx, weights))
                if k > 1:  # distinct left neighbours of each shorter n-gram
                    keys, n = np.unique(keys & np.uint64((1 << 16 * (k - 1)) - 1), return_counts=True)
                    n = n.astype(float)
            per.append(levels[::-1])
        out: tuple[list, ...] = ([], [], [], [])
        for k in range(ORDER):
            for at, values, missing in ((0, 1, 0.0), (2, 3, 1.0)):
                keys = np.unique(np.concatenate([p[k][at] for p in per])) if per else np.empty(0, np.uint64)
                table = np.full((len(keys), len(langs)), missing, np.float32)
                for j, p in enumerate(per):
                    table[np.searchsorted(keys, p[k][at]), j] = p[k][values]
                out[at].append(keys)
                out[at + 1].append(table)
        letters = len(out[0][0]) + 1
        return cls(langs, *out, np.full(len(langs), 1.0 / letters))

    def bits(self, packed: np.ndarray) -> np.ndarray:
        """Minus log2 probability, under each language, of the newest character of packed highest-order n-grams."""
        p = np.broadcast_to(self.base, (len(packed), len(self.langs)))
        for k in range(ORDER):
            gram = packed & np.uint64((1 << 16 * (k + 1)) - 1)
            for keys, table, wanted, missing in ((self.contexts[k], self.weights[k], gram >> np.uint64(16), 1), (self.grams[k], self.probs[k], gram, 0)):
                if not len(keys):
                    continue
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                value = table[at]
                value[keys[at] != wanted] = missing
                p = p * value if missing else p + value
        return -np.log2(np.maximum(p, 1e-12))


class Scorer:
    """Costs of words under each language. Keeps bounded tables of n-grams and words seen: an n-gram's cost depends on
    the model only, a word's on its n-grams."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.width = len(model.langs)
        self._reset()

    def _reset(self) -> None:
        self.seen, self.costs = Numbering(), np.zeros((0, self.width + 1), np.float32)
        self.keys, self.bits = np.empty(0, np.uint64), np.empty((0, self.width), np.float32)

    def _gram_costs(self, packed: np.ndarray) -> np.ndarray:
        """Places of n-grams in the table, which takes up new ones."""
        at = np.minimum(np.searchsorted(self.keys, packed), max(0, len(self.keys) - 1))
        fresh = np.unique(packed[self.keys[at] != packed] if len(self.keys) else packed)
        if len(fresh):
            keys = np.concatenate((self.keys, fresh))
            order = np.argsort(keys, kind="stable")
            self.bits = np.concatenate((self.bits, self.model.bits(fresh).astype(np.float32)))[order]
            self.keys = keys[order]
            at = np.searchsorted(self.keys, packed)
        return at

    def _learn(self, words: list[str]) -> None:
        packed, owner = grams(words)
        fresh = np.zeros((len(words), self.width + 1), np.float32)
        if len(owner):
            at = self._gram_costs(packed[-1])
            for j in range(self.width):
                fresh[:, j] = np.bincount(owner, self.bits[at, j], len(words))
            fresh[:, self.width] = np.bincount(owner, minlength=len(words))
        self.costs = np.concatenate((self.costs, fresh))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row for each text: summed bits under each language, and the number of characters."""
        if len(self.seen) > CACHE_WORDS or len(self.keys) > CACHE_GRAMS:
            self._reset()
        ids, sizes, number = [], [], self.seen.__getitem__
        for t in texts:
            words = t.split()
            sizes.append(len(words))
            ids.extend(map(number, words))
        for i in range(0, len(self.seen.new), 16384):
            self._learn(self.seen.new[i : i + 16384])
        self.seen.new.clear()
        ids, ends = np.array(ids, np.int32), np.cumsum(sizes)
        out = np.zeros((len(texts), self.width + 1))
        for j in range(self.width + 1):
            total = np.concatenate(([0.0], np.cumsum(self.costs[ids, j], dtype=np.float64)))
            out[:, j] = total[ends] - total[ends - sizes]
        return out


def train(docs: DataFrame, lang: str = "lang", text: str = "text", max_grams: int | None = None) -> Model:
    """Count over all ``docs`` on the executors; every language and, without ``max_grams``, every n-gram is learned."""
    table = materialize(count_grams(docs, lang, text), "grams").toArrow()
    keys, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    coded = table.column("lang").combine_chunks().dictionary_encode()
    at, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    order = np.argsort(at, kind="stable")
    ends = np.cumsum(np.bincount(at, minlength=len(names)))
    return Model.fit({name: (keys[mine], n[mine]) for name, mine in zip(names, np.split(order, ends[:-1]))}, max_grams)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score, bits, letters) for every row. bits: cross-entropy per character of the chosen
    language. Null text or text without a letter: lang_pred ``und``, score 0, bits null, letters 0. ``score`` is the
    chosen language's share after a softmax over cross-entropies, at most 32 characters counting as independent."""
    spark = docs.sparkSession
    # plain values, as workers may lack this package
    sent = spark.sparkContext.broadcast((model.langs, model.grams, model.probs, model.contexts, model.weights, model.base))
    narrow = docs.select(F.col(id_col).alias("id"), *keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        scorer, n_langs = Scorer(m), len(m.langs)
        for b in text_chunks(batches, "__text"):
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            sums = scorer(texts)
            sums[[not any(map(str.isalpha, t)) for t in texts]] = 0  # numerals alone are no letters
            letters = sums[:, n_langs].round().astype(np.int64)
            names, scores, bits = [], [], []
            for s, n in zip(sums[:, :n_langs], letters):
                if not n or not n_langs:
                    names.append("und"), scores.append(0.0), bits.append(None)
                    continue
                h = s / n
                best = int(h.argmin())
                names.append(m.langs[best])
                scores.append(float(1 / np.exp2(np.clip((h[best] - h) * min(n, 32), -1000, 0)).sum()))
                bits.append(float(h[best]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64()), pa.array(letters)],
                [*b.schema.names[:-1], "lang_pred", "score", "bits", "letters"],
            )

    return small_batches(narrow).mapInArrow(run, f"{fields}, lang_pred string, score double, bits double, letters bigint")


def limits(scored: DataFrame, truth: Column) -> dict[str, tuple[float, float, float]]:
    """By language, over the scored rows whose known language ``truth`` was predicted: mean cross-entropy, its
    standard deviation between long texts, and the standard deviation that one character adds."""
    right = scored.filter((truth == F.col("lang_pred")) & (F.col("letters") > 0))
    mean = {r.lang_pred: r.m for r in right.groupBy("lang_pred").agg((F.sum(F.col("bits") * F.col("letters")) / F.sum("letters")).alias("m")).collect()}
    if not mean:
        return {}
    centre = F.create_map(*[x for k, v in mean.items() for x in (F.lit(k), F.lit(v))])[F.col("lang_pred")]
    off = F.pow(F.col("bits") - centre, 2)
    got = right.groupBy("lang_pred").agg(F.avg(F.when(F.col("letters") >= 400, off)).alias("between"), F.avg(F.when(F.col("letters") < 400, off * F.col("letters"))).alias("each")).collect()
    return {r.lang_pred: (mean[r.lang_pred], math.sqrt(r.between or 0.01), max(2.0, math.sqrt(r.each or 0))) for r in got}


def rejected(known: dict[str, tuple[float, float, float]], sigma: float = REJECT_SIGMA) -> Column:
    """True where no language fits: no letter, or a cross-entropy beyond the calibrated limit for texts that long."""
    test = F.lit(False)
    for name, (mean, between, each) in known.items():
        far = F.col("bits") > mean + sigma * F.sqrt(F.lit(between**2) + F.lit(each**2) / F.col("letters"))
        test = F.when(F.col("lang_pred") == name, far).otherwise(test)
    return F.coalesce((F.col("letters") == 0) | test, F.lit(True))


def keep_recognised(docs: DataFrame, lang: str = "lang", text: str = "text", sigma: float = REJECT_SIGMA) -> DataFrame:
    """The rows of ``docs``, all columns, that some learned language fits. Trained and calibrated on all rows with a
    language; without any such row there is no model and nothing to reject, so all rows with a letter stay."""
    model = train(docs, lang, text)
    if not model.langs:
        return docs.filter(F.col(text).rlike(r"\p{L}"))
    scored = materialize(score(docs, model, id_col=lang, text=text), "scored")
    known = limits(scored, F.col("id"))
    columns = [f"c{i}" for i in range(len(docs.columns))]
    wide = docs.toDF(*columns)
    marked = score(wide, model, columns[docs.columns.index(text)], columns[docs.columns.index(text)], tuple(columns))
    return marked.filter(~rejected(known, sigma)).select(*columns).toDF(*docs.columns)

"""MinHash near-duplicates by an LSH forest.

A text's signature is ORDERS bands of BAND least hash values. The forest has as many sorted orders of the signatures: order
t reads band t first, then the bands after it, round and round. Texts stand near in an order if they share a long prefix.
Texts that share the first band of an order are a region, and all linked texts share one; a region is searched as a whole.
One of more than CROWD texts first loses those that can have no link: too many of their shingles are in no other text of a
crowd. What remains meets its neighbours of the longest common prefix before all else, as most of these are links, and then
only texts that links don't connect yet are held against each other. A pair whose shingles can't be alike enough by their
numbers and parity sketches is not made at all. Links are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SENT_KEYS, having, join_copies, materialize, remove, small_batches, text_chunks
from .simhash import Vocabulary, _classes, connect

SHINGLE_WORDS = 3
#: Links have 100 times the common shingles at least SIMILAR times all.
SIMILAR = 85
#: Two texts at that similarity share no first band of any order in 2 of 10^8 cases.
ORDERS, BAND = 24, 4
#: Texts of a region from which it is a crowd, bands of a prefix that are compared there, those that neighbours share to be
#: looked at before all else, and how often a crowd loses what can have no link.
CROWD, DEPTH, CLOSE, PEELS = 64, 8, 4, 2
#: Rounds of linking within regions, the last of which takes all pairs left over. Pairs are excluded inside the join, so
#: one round of stars before is enough, and a round's own jobs cost more than the pairs that further ones would save.
STARS = 2
#: One bit of each signature value stays for a first look at a pair; at the least similarity 7 of 96 differ, 2.6 being one
#: standard deviation, so a pair that passes 26 is none.
MOST_BITS = 26
#: Bits of a set's parity sketch: each says whether an odd number of shingles fall on it. Two sketches differ in no more
#: bits than their sets in shingles, so what they rule out is no link.
PARITY = 512
PRINT = ["n", "bits0", "bits1", *(f"parity{i}" for i in range(PARITY // 64))]
MULTIPLIERS = np.random.default_rng(42).integers(0, 1 << 63, ORDERS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def signature(grams: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(keys, bits): a hash of each band's least values, its number included, and two longs with a bit of each value."""
    least = np.full(ORDERS * BAND, (1 << 64) - 1, np.uint64)
    for at in range(0, len(grams), block):
        np.minimum(least, (grams[at : at + block, None].view(np.uint64) * MULTIPLIERS).min(axis=0), out=least)
    bands, keys = least.reshape(ORDERS, BAND), np.arange(1, ORDERS + 1, dtype=np.uint64) * MIX
    for i in range(BAND):
        keys = (keys ^ bands[:, i]) * MIX
        keys ^= keys >> np.uint64(29)
    bits = np.zeros(128, np.uint8)
    bits[: len(least)] = (least >> np.uint64(31)) & np.uint64(1)
    return keys.view(np.int64), np.packbits(bits).view("<i8")


def parity(grams: np.ndarray) -> np.ndarray:
    """The parity sketch of a set, as longs."""
    at = (grams.view(np.uint64) * MIX) >> np.uint64(64 - PARITY.bit_length() + 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).view("<i8")


def may_link(a: str, b: str, similar: int = SIMILAR) -> Column:
    """Whether texts can be linked by their prints, the columns PRINT with prefixes ``a`` and ``b``."""
    n_a, n_b = F.col(f"{a}n"), F.col(f"{b}n")
    apart = lambda names: reduce(Column.__add__, [F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))) for c in names])
    alike = (100 + similar) * apart(PRINT[3:]) <= (100 - similar) * (n_a + n_b)
    return (100 * F.least(n_a, n_b) >= similar * F.greatest(n_a, n_b)) & alike & (apart(PRINT[1:3]) <= MOST_BITS)


def _sets(docs: DataFrame, id_col: str, text_col: str, full: bool) -> DataFrame:
    """(id, fp, n) with keys, bits of the signature and parity sketch, or if ``full`` with grams, the set's hashes. fp is the set's hash; a
    text without a word has n 0 and nothing else."""
    names, kinds = (["grams"], ["array<bigint>"]) if full else (["keys", *PRINT[1:]], ["array<bigint>", *["bigint"] * len(PRINT[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary()
        for b in text_chunks(batches, "text"):
            fps, sizes, more = [], [], []
            for text in b.column(1).to_pylist():
                grams = known.shingles(known.words(text), SHINGLE_WORDS)
                sizes.append(len(grams))
                fps.append(xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else None)
                if full:
                    more.append((grams,))
                else:
                    keys, bits = signature(grams) if len(grams) else (None, (None, None))
                    more.append((keys, *bits, *(parity(grams) if len(grams) else [None] * (PARITY // 64))))
            columns = [pa.array([m[i] for m in more], pa.list_(pa.int64()) if k[0] == "a" else pa.int64()) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), *columns], ["id", "fp", "n", *names])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = ", ".join([f"id {narrow.schema['id'].dataType.simpleString()}", "fp bigint", "n bigint", *(f"{n} {k}" for n, k in zip(names, kinds, strict=True))])
    return small_batches(narrow).mapInArrow(run, schema)


def neighbours(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b, shared) of each fp and the next one in the order of ``keys`` and fp, if their first keys agree; shared is the
    number of keys of their common prefix.

    The order is one over all rows, dealt to tasks by ranges, which cut the largest groups too; the pairs at the cuts are
    joined by the driver, two rows of a task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(*keys, "fp").repartitionByRange(parts, *keys, "fp").sortWithinPartitions(*keys, "fp")
    cut = [f"{c} bigint" for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for b in batches:
            if not b.num_rows:
                continue
            got = np.stack([c.to_numpy() for c in b.columns])
            first = got[:, 0] if first is None else first
            whole = got if last is None else np.concatenate((last[:, None], got), axis=1)
            last = got[:, -1]
            same = np.cumprod(whole[:-1, 1:] == whole[:-1, :-1], axis=0).sum(axis=0)
            at = np.flatnonzero(same)
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(whole[-1, at]), pa.array(whole[-1, at + 1]), pa.array(same[at]), pa.nulls(len(at), pa.int32()), *[none] * len(keys)], names)
        if first is not None:
            ends = np.stack([first, last], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ends[-1]), pa.nulls(2, pa.int64()), pa.nulls(2, pa.int64()), pa.array([0, 1], pa.int32()), *map(pa.array, ends[:-1])], names)

    names = ["a", "b", "shared", "end", *keys]
    found = ordered.mapInArrow(run, f"a bigint, b bigint, shared bigint, end int, {', '.join(cut)}").withColumn("task", F.spark_partition_id())
    found = materialize(found, "neighbours")
    ends = [tuple(r) for r in found.filter("end is not null").orderBy("task", "end").select("a", *keys).collect()]  # two of a task
    joined = []
    for x, y in zip(ends[1::2], ends[2::2]):
        same = int(np.cumprod(np.array(x[1:]) == np.array(y[1:])).sum())
        if same:
            joined.append((x[0], y[0], same))
    return found.filter("end is null").select("a", "b", "shared").unionByName(rows.sparkSession.createDataFrame(joined, "a bigint, b bigint, shared bigint"))


def _alike_once(regions: DataFrame) -> DataFrame:
    """(block, fp): one block of those regions (block, fp) that have the same members."""
    marks = regions.groupBy("block").agg(F.count("*").alias("n"), F.min("fp").alias("least"), F.bit_xor(F.xxhash64("fp")).alias("all"))
    chosen = marks.groupBy("n", "least", "all").agg(F.min("block").alias("block")).select("block")
    return regions.join(chosen, "block").select("block", "fp")


def linkable(sets: DataFrame, similar: int, held: list[str]) -> DataFrame:
    """(fp) of the texts (fp, grams) that may have a link among them: enough of a text's shingles are in others too. Without
    those that can't, others have none either, so it goes over them again."""
    alive = sets.select("fp", F.size("grams").alias("n"))
    for _ in range(PEELS):
        each = having(sets, alive, "fp").select("fp", F.explode("grams").alias("gram"))
        alone = each.groupBy("gram").agg(F.count("*").alias("texts"), F.min("fp").alias("fp")).filter("texts = 1").groupBy("fp").agg(F.count("*").alias("alone"))
        enough = 100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= similar * F.col("n")
        alive = materialize(alive.join(alone, "fp", "left").filter(enough).select("fp", "n"), "linkable", held)
    return alive.select("fp")


def shared_bands(reps: DataFrame, held: list[str]) -> DataFrame:
    """(order, k0, fp, n): a text (fp, keys) by its first band of each order that n texts share, more than one."""
    each = reps.select("fp", F.posexplode("keys").alias("order", "k0"))
    shared = each.groupBy("k0").agg(F.count("*").alias("n")).filter("n > 1")
    return materialize(each.join(shared, "k0").select("order", "k0", "fp", "n"), "regions", held)


def regions(reps: DataFrame, bands: DataFrame, sets: DataFrame, held: list[str], similar: int = SIMILAR, crowd: int | None = None) -> DataFrame:
    """(block, fp, first) of the texts (fp, keys) that are to be compared, by shared_bands() and their sets (fp, grams):
    regions without what can have no link in a crowd. ``first`` marks the blocks to begin with, which are small regions and
    neighbours in crowds."""
    crowd = CROWD if crowd is None else crowd
    out = [_alike_once(bands.filter(F.col("n") <= crowd).select(F.col("k0").alias("block"), "fp")).withColumn("first", F.lit(True))]
    wide = bands.filter(F.col("n") > crowd)
    if not wide.isEmpty():
        inside = materialize(wide.select("fp").distinct(), "crowded", held)
        alive = linkable(having(sets, inside, "fp"), similar, held)
        left = materialize(having(wide, alive, "fp").select("order", "k0", "fp"), "deeper", held)
        deeper = [F.element_at("keys", (F.col("order") + j) % ORDERS + 1).alias(f"k{j}") for j in range(1, DEPTH)]
        near = neighbours(left.join(reps.select("fp", "keys"), "fp").select("fp", "k0", *deeper), [f"k{j}" for j in range(DEPTH)])
        near = near.filter(F.col("shared") >= CLOSE).select("a", "b").distinct().withColumn("block", F.xxhash64("a", "b"))
        out.append(near.select("block", F.explode(F.array("a", "b")).alias("fp")).withColumn("first", F.lit(True)))
        out.append(_alike_once(left.select(F.col("k0").alias("block"), "fp")).withColumn("first", F.lit(False)))
    return materialize(reduce(DataFrame.unionByName, out).join(reps.select("fp", *PRINT), "fp"), "members", held)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """(id, n, component, kept) for every row of ``docs``: the number of its different shingles, the least id that links
    reach from it, and whether that is its own.

    A text with fewer words than a shingle has its whole sequence as one shingle; a text without words, or null, is
    linked with nothing. Texts with equal sets are linked, repeated rows with them. Rows that repeat an id are all kept,
    if one is. A component without any id has a null component and keeps its rows. An empty table gives an empty result.
    Equal sets are told by a 64-bit hash, shingles too.
    """
    held: list[str] = []
    prints = materialize(_sets(docs, id_col, text_col, full=False), "prints")
    some = prints.filter("n > 0").groupBy("fp")
    reps = some.agg(F.count("*").alias("copies"), F.min("id").alias("first"), *[F.first(c).alias(c) for c in ("keys", *PRINT)])
    reps = materialize(reps, "texts", held)
    bands = shared_bands(reps, held)
    wanted = materialize(reps.join(bands.select("fp").distinct(), "fp").select("fp", F.col("first").alias("id")), "wanted", held)
    texts = having(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), wanted, "id")
    full = _sets(texts, "id", "text", full=True).join(wanted.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("grams").alias("grams"))
    full = materialize(full, "sets", held)
    members = regions(reps, bands, full, held, similar)

    tested: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        if tested:  # no pair is looked at twice
            pairs = pairs.join(reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti")
        pairs = materialize(pairs.select("a", "b"), "tested", held)
        tested.append(pairs)
        used = having(full, materialize(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "used", held), "fp")
        both = pairs
        for s in "ab":
            both = both.join(used.toDF(s, f"grams_{s}"), s)
        common = F.size(F.array_intersect("grams_a", "grams_b"))
        return both.filter(100 * common >= similar * (F.size("grams_a") + F.size("grams_b") - common)).select("a", "b")

    blocks = members.drop("first")
    edges = connect(blocks, verify, held=held, first=members.filter("first").drop("first"), may=lambda a, b: may_link(a, b, similar), stars=STARS, sent=SENT_KEYS)
    classes = materialize(_classes(reps.select(F.col("first").alias("id"), "fp"), edges, held, SENT_KEYS), "classes").select("fp", "component")
    worded = join_copies(prints.filter("n > 0").select("id", "fp", "n"), classes, "fp", reps.select("fp", "copies"))
    out = worded.select("id", "n", "component").unionByName(prints.filter("n = 0").select("id", "n", F.col("id").alias("component")))
    remove(docs.sparkSession, held)
    return out.withColumn("kept", F.expr("id <=> component"))

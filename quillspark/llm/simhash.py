"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Numbering, join_copies, materialize, remove, small_batches, spread, text_chunks
from .graph import components

SHINGLE_WORDS = 3
RADIUS = 2
#: Bits of 128 by which word sets of near copies may differ; fewer in texts below LONG_WORDS, where one word is many bits.
WORD_BITS, SHORT_BITS, LONG_WORDS = 16, 8, 100
#: Rounds of linking within blocks, the last of which takes all pairs left over; a block that has at most PAIRS_EACH such
#: pairs for each member goes there at once.
STARS, PAIRS_EACH = 4, 32
#: Members of a block that one task holds against those outside its largest component, where pairs are excluded as they meet.
SLICE = 256
#: Words of the shingles that verify links of word sets, and the least similarity of two texts' sets of them: the same
#: words in another order are no copy. Near copies of the given tables lie at 0.39 or more.
GRAM_WORDS, MIN_SHARED = 5, 0.3
#: A text's SKETCH least shingle hashes stand for its shingles: all of them in a text of up to so many different ones, a
#: bottom-k sample of them in a longer one. Texts with all also meet by shingles: each pair of them with NEAR fifths in
#: common is found. As a text below 100 words has up to 95, those that it can be near to have up to 118.
SKETCH, NEAR = 128, 4
#: Words that a worker keeps the hashes of.
CACHE_WORDS = 100_000
#: Parts into which a component is dealt while its members learn its least id: copies may be a third of all rows.
SALTS = 32


def fingerprint(text: str | None, k: int = SHINGLE_WORDS, block: int = 16384) -> int:
    """Unsigned 64-bit SimHash of the ``k``-word shingles; 0 without words, the whole sequence if shorter."""
    words = (text or "").encode().lower().split()  # ASCII case and the six ASCII white spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < k:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), block):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at : at + block].tolist(), ends[at : at + block].tolist())], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): fp holds the fingerprint's 64 bits as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "text"):
            fps = np.array([fingerprint(t, shingle_words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return small_batches(narrow).mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, fp bigint")


def links(prints: DataFrame, radius: int = RADIUS, once: bool = False) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within ``radius`` bits of one another. ``once`` says that ``prints`` is a
    written table of different ones; else they are made different and written first, as the rows that become many have to
    be spread over all tasks, which a shuffle for the distinct ones alone is not.

    Each distinct fingerprint emits all variants within half the radius; two within the radius share a variant. All
    that share a variant lie within the radius of each other, so every one is linked to the least of them: as many
    edges as members, not pairs. A variant has at most 65 distinct fingerprints, copies having met before. Candidates
    are verified by their bit distance.
    """
    if radius != 2:
        raise ValueError("the ball of half the radius is built for radius 2")
    masks = F.array(*[F.lit(m) for m in [0, *((1 << i) - (1 << 64 if i == 63 else 0) for i in range(64))]])
    single = prints.select("fp") if once else materialize(prints.select("fp").distinct(), "single")
    variants = spread(single, "fp").select("fp", F.explode(masks).alias("mask"))
    variants = variants.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant")))
    met = met.filter("least <> fp").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


class Vocabulary:
    """Numbers words and keeps the 128 bits of each one's hash; bounded by CACHE_WORDS and one text's words."""

    def __init__(self) -> None:
        self.number, self.raw = Numbering(), np.empty((1024, 16), np.uint8)

    def words(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words, in order; ASCII letters count in lower case."""
        known = self.number
        if len(known) > CACHE_WORDS:
            known.clear()
        found = (text or "").encode().lower().split()
        out = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        if known.new:
            while len(known) > len(self.raw):
                self.raw = np.concatenate((self.raw, self.raw))
            self.raw[len(known) - len(known.new) : len(known)] = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known.new)), np.uint8).reshape(-1, 16)
            known.new.clear()
        return out

    def word_print(self, words: np.ndarray) -> tuple[int, int, int]:
        """Two signed halves of a 128-bit SimHash of the set of words, and the number of words."""
        if not len(words):
            return 0, 0, 0
        kinds, counts = np.unique(words), np.zeros(128, np.int64)
        for at in range(0, len(kinds), 16384):
            counts += np.unpackbits(self.raw[kinds[at : at + 16384]], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        hi, lo = np.packbits(counts * 2 > len(kinds), bitorder="little").view("<i8").tolist()
        return hi, lo, len(words)

    def shingles(self, words: np.ndarray, k: int = GRAM_WORDS) -> np.ndarray:
        """Hashes of the different runs of ``k`` words, in order; of the whole sequence if shorter."""
        if not len(words):
            return np.empty(0, np.int64)
        k = min(k, len(words))
        each, n = self.raw.view(np.uint64)[:, 0][words], len(words) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):  # the words' order counts, and every bit of each reaches every bit of the sum
            out = (out ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out.view(np.int64))


def word_print(text: str | None) -> tuple[int, int, int]:
    """Two signed halves of a 128-bit SimHash of a text's set of words, and the number of words."""
    known = Vocabulary()
    return known.word_print(known.words(text))


def _with_word_prints(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``hi``, ``lo`` and ``words``, and the text's hash ``fp``; no shuffle."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary()
        for b in text_chunks(batches, text):
            found = np.array([known.word_print(known.words(t)) for t in b.column(at).to_pylist()], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(found[:, k]) for k in range(3))], [*b.schema.names, "hi", "lo", "words"])

    fields = [StructField(n, LongType()) for n in ("hi", "lo", "words")]
    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, *fields])).withColumn("fp", F.xxhash64(text))


def _members(variants: DataFrame, held: list[str]) -> DataFrame:
    """(block, fp): the variants that several share, one block of those with the same members."""
    variants = variants.repartition("variant")  # one shuffle, which the aggregate and the join both read
    several = variants.groupBy("variant").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least <> most").select("variant")
    mine: list[str] = []
    shared = materialize(variants.join(several, "variant").select("variant", "fp"), "shared", mine)
    alike = shared.groupBy("variant").agg(F.count("*").alias("n"), F.min("fp").alias("least"), F.bit_xor(F.xxhash64("fp")).alias("all"))
    chosen = alike.groupBy("n", "least", "all").agg(F.min("variant").alias("variant")).select("variant")
    members = materialize(shared.join(chosen, "variant").select(F.col("variant").alias("block"), "fp"), "members", held)
    remove(variants.sparkSession, mine)
    return members


def connect(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], stars: int = STARS, held: list[str] | None = None, first: DataFrame | None = None, may: Callable[[str, str], Column] | None = None, sent: int = 0
) -> DataFrame:
    """Edges (a, b) that connect all of a block whom verified pairs connect; ``verify`` keeps the pairs (a, b) it likes.

    First a star in each block, from its least member. A pair of others may be near where both are far from that one, so
    all pairs of a block that lie in different components follow. As one of each such pair is outside the block's largest
    component, a block of one large component and a few others has about as many of them as members. Blocks that have
    many more take further stars, from other members, before. If ``first`` is given, the first stars are those of its
    blocks, of the same kind, instead.

    With ``may``, members have more columns than (block, fp), and no pair is made whose columns, by two prefixes of their
    names, it excludes; blocks of more than SLICE members are searched in slices. ``sent`` is that of components().
    """
    chosen = members if first is None else first
    more = [c for c in members.columns if c not in ("block", "fp")] if may else []
    fits = may("h_", "") if may else F.lit(True)
    if may:
        least = chosen.groupBy("block").agg(F.min(F.struct("fp", *more)).alias("h")).select("block", *[F.col(f"h.{c}").alias(f"h_{c}") for c in ("fp", *more)])
        star = chosen.join(least, "block").filter("h_fp <> fp").filter(fits).select(F.col("h_fp").alias("a"), F.col("fp").alias("b"))
    else:
        least = chosen.groupBy("block").agg(F.min("fp").alias("a"))
        star = chosen.join(least, "block").filter("a <> fp").select("a", F.col("fp").alias("b"))
    edges = materialize(verify(star.distinct()), "links", held)
    fresh = not edges.isEmpty()
    for k in range(1, stars + 1):
        if fresh:
            roots = materialize(components(edges, sent=sent), "roots", held)
            edges = roots.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        tagged = members.withColumn("c", F.col("fp"))
        if not edges.isEmpty():
            tagged = members.join(roots, F.col("fp") == F.col("node"), "left").select("block", "fp", F.coalesce("root", "fp").alias("c"), *more)
        counts = tagged.groupBy("block", "c").agg(F.count("*").alias("n")).groupBy("block")
        counts = counts.agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.max_by("c", F.struct("n", "c")).alias("major"))
        few = F.lit(k == stars) | (F.col("n") * F.col("n") - F.col("squares") <= 2 * PAIRS_EACH * F.col("n"))
        parts = [F.ceil(F.col("n") / SLICE).alias("parts")] if may else []
        members = materialize(tagged.join(counts.filter("kinds > 1").withColumn("few", few).select("block", "major", "few", *parts), "block"), "open", held)  # the others are done
        ends, by = members.filter("few"), ["block", "part"] if may else ["block"]
        minor = ends.filter("c <> major").select("block", *[F.explode(F.expr("sequence(0L, parts - 1)")).alias("part")] * len(parts), *[F.col(c).alias(f"h_{c}") for c in ("fp", "c", *more)])
        ends = ends.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts"))) if may else ends
        pairs = ends.select(*by, "fp", "c", *more).join(minor, by).filter("c <> h_c").filter(fits).select(F.col("h_fp").alias("x"), F.col("fp").alias("y"))
        members = members.filter("not few").select("block", "fp", "c", *more)
        left = not members.isEmpty()
        if left:
            heads = members.groupBy("block").agg(F.min_by(F.struct("fp", "c", *more), F.xxhash64("fp", F.lit(k))).alias("h"))
            heads = heads.select("block", *[F.col(f"h.{c}").alias(f"h_{c}") for c in ("fp", "c", *more)])
            pairs = pairs.unionByName(members.join(heads, "block").filter("c <> h_c").filter(fits).select(F.col("h_fp").alias("x"), F.col("fp").alias("y")))
        found = materialize(verify(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()), "links", held)
        fresh = not found.isEmpty()
        edges = edges.unionByName(found) if fresh else edges
        if not left:
            break
        members = members.select("block", "fp", *more)
    return edges


def word_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hi, lo, words, n, grams, fp) for every row; grams has the SKETCH least shingle hashes, n their number if these
    are all, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary()
        for b in text_chunks(batches, "text"):
            found, sizes, sets = np.empty((b.num_rows, 3), np.int64), [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                words = known.words(t)
                found[i] = known.word_print(words)
                grams = known.shingles(words)
                sizes.append(len(grams) if len(grams) <= SKETCH else None)
                sets.append(grams[:SKETCH])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(found[:, k]) for k in range(3)), pa.array(sizes, pa.int32()), pa.array(sets, pa.list_(pa.int64())), b.column(1)], ["id", "hi", "lo", "words", "n", "grams", "fp"]
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"))
    return small_batches(narrow).mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, hi bigint, lo bigint, words bigint, n int, grams array<bigint>, fp bigint")


def similarity(a: str, b: str) -> Column:
    """Jaccard similarity of the shingles of two texts (n_x, grams_x): exact where both have all, else estimated from the
    SKETCH least hashes of both together."""
    grams = F.col(f"grams_{a}"), F.col(f"grams_{b}")
    common, least = F.array_intersect(*grams), F.slice(F.sort_array(F.array_union(*grams)), 1, SKETCH)
    exact = F.try_divide(F.size(common), F.col(f"n_{a}") + F.col(f"n_{b}") - F.size(common))  # null for two empty texts
    sampled = F.try_divide(F.size(F.array_intersect(common, least)), F.size(least))
    return F.coalesce(F.when(F.col(f"n_{a}").isNotNull() & F.col(f"n_{b}").isNotNull(), exact).otherwise(sampled), F.lit(1.0))


def shingle_blocks(short: DataFrame) -> DataFrame:
    """(fp, variant): the rarest shingles of texts (fp, grams), so many that two texts with NEAR fifths of all their
    shingles in common have one of those in common."""
    each = short.select("fp", F.size("grams").alias("n"), F.explode("grams").alias("variant"))
    often = each.groupBy("variant").agg(F.count("*").alias("df")).filter("df > 1")
    mine = Window.partitionBy("fp")
    ranked = each.join(often, "variant").withColumn("rank", F.row_number().over(mine.orderBy("df", "variant")) + F.col("n") - F.count("*").over(mine))
    return ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * NEAR / 5) + 1).select("fp", "variant")


def word_links(prints: DataFrame, shingled: bool = True, held: list[str] | None = None) -> DataFrame:
    """Edges (a, b) that connect texts whose word sets few words tell apart, and short texts that share shingles.

    The 128 bits are four parts; each part emits its variants within one bit, so that two within two bits in any part
    meet. Who meets need not be near as a whole, so connect() finds the links; the whole 128 bits verify each
    (WORD_BITS, for short texts SHORT_BITS), and, if ``shingled``, their shingles (MIN_SHARED). Then texts that have all
    their shingles in ``prints`` also meet by these: one word of theirs is many bits.
    """
    held = [] if held is None else held
    rows = prints.groupBy("fp").agg(F.min("hi").alias("hi"), F.min("lo").alias("lo"), F.max("words").alias("words"), *([F.max("n").alias("n")] if shingled else []))
    known = materialize(rows if shingled else rows.withColumn("n", F.lit(None).cast("int")), "known", held)
    parts = [F.shiftrightunsigned(c, n).bitwiseAND(F.lit(0xFFFFFFFF)) for c in ("hi", "lo") for n in (0, 32)]
    keyed = F.explode(F.array(*[p.bitwiseOR(F.lit(t << 32)) for t, p in enumerate(parts)]))
    masks = F.array(*[F.lit(m) for m in [0, *(1 << i for i in range(32))]])
    variants = spread(known.select("fp", "hi", "lo"), "fp").select("fp", keyed.alias("part")).select("fp", "part", F.explode(masks).alias("mask")).select("fp", F.col("part").bitwiseXOR(F.col("mask")).alias("variant"))
    if shingled:
        short = prints.filter("n is not null").select("fp", "grams").dropDuplicates(["fp"])
        variants = variants.unionByName(materialize(shingle_blocks(short), "shingles", held))
    members = _members(variants, held)
    if shingled:
        met = prints.select("fp", "grams").join(members.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"])
        sketches = materialize(met, "sketches", held)

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda s: known.select(F.col("fp").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("hi", "lo", "words", "n")])
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        apart = F.bit_count(F.col("hi_a").bitwiseXOR(F.col("hi_b"))) + F.bit_count(F.col("lo_a").bitwiseXOR(F.col("lo_b")))
        both = both.select("a", "b", "n_a", "n_b", (apart <= F.when(F.least("words_a", "words_b") >= LONG_WORDS, WORD_BITS).otherwise(SHORT_BITS)).alias("close"))
        if not shingled:
            return both.filter("close").select("a", "b")
        may = F.coalesce(5 * F.least("n_a", "n_b") >= NEAR * F.greatest("n_a", "n_b"), F.lit(False)) & F.col("n_a").isNotNull() & F.col("n_b").isNotNull()
        both = materialize(both.filter(F.col("close") | may), "pairs", held)
        used = sketches.join(both.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi")
        for s in "ab":
            both = both.join(used.toDF(s, f"grams_{s}"), s)
        both = both.withColumn("like", similarity("a", "b"))
        return both.filter((F.col("close") & (F.col("like") >= MIN_SHARED)) | (may & (F.col("like") >= NEAR / 5))).select("a", "b")

    return connect(members, verify, held=held)


def _classes(prints: DataFrame, edges: DataFrame, held: list[str], sent: int = 0) -> DataFrame:
    """(fp, component, root) of materialised prints (id, fp); component is the least id reachable over edges, root the same
    for all that are connected. Only the nodes of edges have to learn their component, and a component is dealt to SALTS
    parts, each of which has a copy of its least id."""
    roots = materialize(components(edges, sent=sent), "roots", held)
    first = prints.groupBy("fp").agg(F.min("id").alias("first"))
    joined = materialize(first.join(roots, first.fp == roots.node, "left").select("fp", "first", "root"), "joined", held)
    linked = joined.filter("root is not null").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    best = linked.groupBy("root", "salt").agg(F.min("first").alias("first")).groupBy("root").agg(F.min("first").alias("component"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    alone = joined.filter("root is null").select("fp", F.col("first").alias("component"), F.col("fp").alias("root"))
    return linked.join(best, ["root", "salt"]).select("fp", "component", "root").unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp, component) for every row of ``docs``; component is the least id reachable over links.

    Repeated ids keep their rows. Empty and null texts have fingerprint 0 and link like any other; a component
    without any id has a null component. An empty table gives an empty result.
    """
    held: list[str] = []
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words), "prints")
    texts = materialize(prints.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "texts", held)
    classes = materialize(_classes(texts.select("id", "fp"), links(texts, radius, once=True), held).select("fp", "component"), "classes")
    out = join_copies(prints, classes, "fp", texts.select("fp", "copies")).select("id", "fp", "component")
    remove(docs.sparkSession, held)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies stays, all columns: the one with the least id (of several, the one of the
    least hash and then text). Of a group without any id one row stays.

    Near copies are found on fingerprints of word sets: a similarity of 0.8 of five-word shingles lets about one word in
    fifty differ, which moves 9 of 64 bits of a shingle fingerprint, but 11 of 128 of this one. The texts' shingles verify
    them, as the same words in another order have the same fingerprint.

    Rows whose ids differ, as they should, go by an anti-join of ids; only rows that share an id or have none are
    ranked, in a window over fingerprints' groups that holds just such rows.
    """
    held: list[str] = []
    prints = materialize(word_prints(docs, id_col, text_col), "prints", held)
    classes = materialize(_classes(prints.select("id", "fp"), word_links(prints, held=held), held), "classes")
    marked = materialize(prints.select("id", "fp").join(classes, "fp").select("id", "fp", "component"), "marked")
    remove(docs.sparkSession, held)
    gone = marked.filter("id <> component").select(F.col("id").alias("__gone")).distinct()
    odd = materialize(marked.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").select(F.col("id").alias("__odd")), "odd")
    if odd.isEmpty():
        return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
    plain = docs.join(odd, docs[id_col].eqNullSafe(odd["__odd"]), "left_anti")
    plain = plain.join(gone, plain[id_col] == gone["__gone"], "left_anti")
    columns = [f"c{i}" for i in range(len(docs.columns))]
    key, text = columns[docs.columns.index(id_col)], columns[docs.columns.index(text_col)]
    rest = _with_word_prints(docs.join(odd, docs[id_col].eqNullSafe(odd["__odd"]), "left_semi").toDF(*columns), text)
    rest = rest.join(classes.toDF("fp", "__c", "__root"), "fp").filter((F.col(key) == F.col("__c")) | F.col("__c").isNull())
    order = Window.partitionBy(key, F.when(F.col("__c").isNull(), F.col("__root"))).orderBy("fp", text)
    rest = rest.withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    return plain.unionByName(rest.select(*columns).toDF(*docs.columns))

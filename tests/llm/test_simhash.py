import random
import re
from collections import defaultdict

import xxhash
from hypothesis import given
from hypothesis import strategies as st

from quillspark.llm import graph, simhash
from quillspark.llm.queries import op5_simhash


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """{fingerprint: members' root} by union-find over all pairs."""
    fps, parent = sorted(set(prints)), {}
    for f in fps:
        parent[f] = f

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(b)] = root(a)
    return {f: root(f) for f in fps}


def expected(rows):
    roots = brute_components([f for _, f in rows])
    least = defaultdict(lambda: None)
    for key, f in rows:
        if key is not None and (least[roots[f]] is None or key < least[roots[f]]):
            least[roots[f]] = key
    return sorted((str(k), f"{f:016x}", least[roots[f]]) for k, f in rows)


def test_query_against_brute_force(spark, sf, documents):
    rows = [(r.doc_id, brute_print(r.text)) for r in documents.collect()]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in op5_simhash(spark, sf).collect())
    assert got == expected(rows)
    assert len({c for _, _, c in got}) < len(got)


def test_hot_fingerprints_meet_nothing_in_a_shuffle(spark):
    """A third of all rows are copies: they learn their component by a broadcast, and every row is there."""
    rows = [(i, "the same few words here") for i in range(400)] + [(400 + i, f"text number {i} {i * 7} {i * 11} of many") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = sorted((str(r.id), f"{r.fp & (1 << 64) - 1:016x}", r.component) for r in simhash.near_duplicates(df).collect())
    assert got == expected([(k, brute_print(t)) for k, t in rows])
    plan = simhash.near_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Union" in plan


def test_variants_come_from_all_tasks(spark):
    prints = spark.createDataFrame([(i,) for i in range(50)], "fp bigint")
    for once in (False, True):
        plan = simhash.links(prints, once=once)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan


def test_chains_of_near_prints(spark):
    prints = [0, 1, 7, 31, 1 << 63, (1 << 63) | 3, 0xFF00FF00FF00FF00, 0xFF00FF00FF00FF03, 0xFF00FF00FF0000FF]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "id bigint, fp bigint")
    want = brute_components(prints)
    got = {r.node & (1 << 64) - 1: r.root for r in graph.components(simhash.links(df)).collect()}
    for a in prints:
        for b in prints:
            assert (want[a] == want[b]) == (got.get(a, a) == got.get(b, b) if a in got and b in got else a == b)


def test_odd_rows(odd_documents):
    rows = [(r.doc_id, brute_print(r.text)) for r in odd_documents.collect()]
    got = simhash.near_duplicates(odd_documents).collect()
    assert sorted((str(r.id), f"{r.fp & (1 << 64) - 1:016x}", r.component) for r in got) == expected(rows)


def test_keep_one_odd_rows(odd_documents):
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    got = sorted((str(r.doc_id), (r.text or "")[:20]) for r in kept.collect())
    # 2 copies 1; 3, 4, 5 and a row without id are all empty; the rows of id 7 are two texts, of which one stays. The other
    # row without id is row 1's text and one word more: 11 of 12 five-word shingles are common, and 0.8 is the limit.
    assert [g[0] for g in got] == ["1", "10", "3", "7", "8", "9"]


def test_keep_one_leaves_a_row_without_id_below_the_limit(spark, odd_documents):
    base = odd_documents.filter("doc_id = 1").first().text
    rows = [(1, base), (None, base + " again and then some more of it"), (None, base + " again")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame(rows[:2], kept.schema).collect()))


def brute_word_components(texts):
    """Roots by union-find over all pairs of distinct word prints that are near in some part and as a whole."""
    prints = {simhash.word_print(x)[:2]: 0 for x in texts}
    for x in texts:
        hi, lo, n = simhash.word_print(x)
        prints[hi, lo] = max(prints[hi, lo], n)
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    whole = lambda p: (p[0] & (1 << 64) - 1) << 64 | p[1] & (1 << 64) - 1
    for a in prints:
        for b in prints:
            x = whole(a) ^ whole(b)
            if a < b and any((x >> s & 0xFFFFFFFF).bit_count() <= 2 for s in (0, 32, 64, 96)) and x.bit_count() <= (16 if min(prints[a], prints[b]) >= 100 else 8):
                parent[root(b)] = root(a)
    return {p: root(p) for p in prints}


def test_keep_one_against_all_pairs(spark, sf, documents):
    rows = documents.select("doc_id", "text").collect()
    roots = brute_word_components([r.text for r in rows])
    least = {}
    for r in rows:
        k = roots[simhash.word_print(r.text)[:2]]
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    got = {r.doc_id for r in simhash.keep_one(documents).collect()}
    # stars link through the least member only, so at worst a chain of near copies keeps a further document
    assert set(least.values()) <= got and len(got) <= len(least) + 2


def test_keep_one_of_altered_copies(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3))
    rows, clean = [], []
    for k in range(40):
        base = [word() for _ in range(300)]
        rows.append((1000 * k, " ".join(base)))
        clean.append(1000 * k)
        for j in range(1, 5):
            copy = list(base)
            for _ in range(3):
                copy[rng.randrange(300)] = word()
            rows.append((1000 * k + j, " ".join(copy)))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(clean) <= kept and len(kept) <= len(clean) + 8


def test_near_pair_behind_a_stranger(spark):
    """1 and 2 are near but meet in one part only, where the least, 0, is far from both. A large block in rounds gives the same."""
    low = 0xABCDEF01
    wide = lambda k: int.from_bytes(xxhash.xxh64_digest(str(k).encode()), "big", signed=True)
    near = [(0, low, wide(0), 200), (1, (0x1234567 << 32) | low, wide(1), 200), (2, (0x1234560 << 32) | low, wide(1) ^ (0b111 << 40 | 0b111), 200)]
    df = spark.createDataFrame([(fp, fp, hi, lo, n) for fp, hi, lo, n in near], "id bigint, fp bigint, hi bigint, lo bigint, words bigint")
    assert {(r.a, r.b) for r in simhash.word_links(df, shingled=False).collect()} == {(1, 2)}
    rows = [(1, i) for i in range(60)] + [(2, i) for i in range(58, 70)]
    alike = lambda pairs: pairs.filter("a % 7 = b % 7 and abs(a - b) < 15")
    edges = simhash.connect(spark.createDataFrame(rows, "block bigint, fp bigint"), alike)
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    # block 2 alone ties 65 to 58, 66 to 59, and 60, 61, 62 to 67, 68, 69
    assert roots == {i: i % 7 for i in range(60)} | {65: 2, 66: 3} | {i: 60 + (i - 60) % 7 for i in (60, 61, 62, 67, 68, 69)}


def test_same_words_in_another_order_stay(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3)) for _ in range(200)]
    near = list(words)
    near[70] = "other"
    rows = [(1, words), (2, near)] + [(k, rng.sample(words, 200)) for k in range(3, 9)]
    rows = [(k, " ".join(w)) for k, w in rows] + [(None, "No id"), (None, "no  id")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "5", "6", "7", "8", "None"]


def test_short_near_copies_go(spark):
    """Every pair of short texts at a five-word similarity of 0.8 is in one component, a common line or not."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3))
    line, texts = [word() for _ in range(12)], []
    for k in range(80):
        base = [word() for _ in range(rng.randrange(15, 100))] + line * (k % 2)
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            copy[rng.choice([0, 1, len(copy) // 2, -1])] = word()
            texts.append(copy)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    edges = simhash.word_links(simhash.word_prints(docs))
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    fp = {r.id: r.fp for r in simhash.word_prints(docs).collect()}
    assert len(pairs) > 150
    assert [p for p in pairs if roots.get(fp[p[0]], p[0]) != roots.get(fp[p[1]], p[1])] == []


def test_empty_table(no_documents):
    assert simhash.near_duplicates(no_documents).count() == 0
    assert simhash.keep_one(no_documents).count() == 0


@given(st.text(max_size=80))
def test_fingerprint(text):
    text = text.encode("utf-8", "ignore").decode()
    for k in (3, 5):
        assert simhash.fingerprint(text, k) == brute_print(text, k)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3), (7, 8)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1100)}

import random
import re
from collections import defaultdict

import pytest

from quillspark.llm import graph, minhash
from quillspark.llm.queries import op13_minhash


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(rows):
    """(id, n, component, kept) by union-find over all pairs of sets, cut only by their sizes."""
    sets = {frozenset(shingles(t)) for _, t in rows}
    parent = {s: s for s in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted((s for s in sets if s), key=len)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if 100 * len(a) < 85 * len(b):
                break
            common = len(a & b)
            if 100 * common >= 85 * (len(a) + len(b) - common):
                parent[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for k, t in rows:
        r = root(frozenset(shingles(t)))
        if k is not None and r and (least[r] is None or k < least[r]):
            least[r] = k
    out = []
    for k, t in rows:
        s = frozenset(shingles(t))
        c = least[root(s)] if s else k
        out.append((k, len(s), c, k == c))
    return sorted(out, key=str)


def found(df, **more):
    got = minhash.near_duplicates(df, **more)
    assert got.columns == ["id", "n", "component", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_query_against_brute_force(spark, sf, documents):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op13_minhash(spark, sf).collect()]
    assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in documents.collect()])
    assert sum(not g[3] for g in got) > 5


def test_odd_rows(odd_documents):
    assert found(odd_documents) == brute([(r.doc_id, r.text) for r in odd_documents.collect()])


def test_empty_table(no_documents):
    assert found(no_documents) == []


def test_order_and_case_of_words(spark):
    rows = [(5, "A b C d e"), (4, "a B c D E"), (3, "e d c b a"), (2, "É b c"), (1, "é b c"), (9, "one"), (8, "ONE"), (7, "one two"), (6, "one two")]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


@pytest.fixture(scope="module")
def crowd():
    """Near copies of one text, far more than a region takes, of texts that hardly reach the similarity, and chains."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    rows, base = [], fresh(300)
    for i in range(260):  # about 0.9 to 0.99 to the first one, about 0.85 to one another
        w = list(base)
        for _ in range(rng.randrange(1, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    other = fresh(200)
    for i in range(150):  # below the limit to most others
        w = list(other)
        for _ in range(12):
            w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    w = fresh(400)
    for i in range(60):  # each is near the one before only
        w = w[6:] + fresh(6)
        rows.append((2000 + i, " ".join(w)))
    rows += [(3000 + i, rows[0][1]) for i in range(100)] + [(4000 + i, " ".join(fresh(100))) for i in range(200)]
    return rows


def test_crowded_regions(spark, crowd):
    df = spark.createDataFrame(crowd, "doc_id bigint, text string").repartition(5)
    want = brute(crowd)
    assert found(df) == want
    assert len({w[2] for w in want if 2000 <= w[0] < 3000}) == 1  # the chain is one component


def test_recall_in_smaller_regions(spark, crowd, monkeypatch):
    """With regions of a tenth of the size most texts stand in crowds: no link is wrong, and hardly one is missed."""
    monkeypatch.setattr(minhash, "CROWD", 8)
    want = {w[0]: w[2] for w in brute(crowd)}
    got = {g[0]: g[2] for g in found(spark.createDataFrame(crowd, "doc_id bigint, text string"))}
    assert all(want[c] == want[i] for i, c in got.items())
    assert sum(want[i] != c for i, c in got.items()) <= len(want) // 50


def test_crowds_lose_no_link(spark, crowd, monkeypatch):
    """Nearly all regions are crowds, of which many texts hardly reach the similarity: the components are the exact ones."""
    monkeypatch.setattr(minhash, "CROWD", 3)
    some = [r for r in crowd if r[0] < 2060]
    assert found(spark.createDataFrame(some, "doc_id bigint, text string")) == brute(some)


def test_pairs_at_the_limit(spark):
    """100 * common >= 85 * all holds with equality: 34 of 40 shingles; one fewer is no link."""
    w = [f"w{i}" for i in range(39)]
    at, below = [], []
    for k in range(60):
        tag = [f"{x}t{k}" for x in w]
        at += [(4 * k, " ".join(tag)), (4 * k + 1, " ".join(tag[:36] + [f"z{k}"] * 3))]
    got = found(spark.createDataFrame(at + below, "doc_id bigint, text string"))
    assert got == brute(at)


def test_neighbours_share_prefixes(spark):
    keys = ["k0", "k1", "k2"]
    rows = [(i % 3, i % 5 // 2, i % 7, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k0 bigint, k1 bigint, k2 bigint, fp bigint").repartition(6)
    ordered = sorted(rows)
    want = sorted((x[3], y[3], next((i for i in range(3) if x[i] != y[i]), 3)) for x, y in zip(ordered, ordered[1:], strict=False) if x[0] == y[0])
    assert sorted(tuple(r) for r in minhash.neighbours(df, keys).collect()) == want


def test_components_of_few_edges(spark):
    """The same components, by less than half of the shuffles."""
    rng = random.Random(11)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1012)] + [(2000, i) for i in range(1900, 2100)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    roots = lambda sent: sorted(tuple(r) for r in graph.components(edges, sent=sent).collect())
    assert roots(10**6) == roots(0)
    state = edges.filter("a > b").toDF("u", "v")
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    few, more = (shuffles(graph._small_star(graph._large_star(state, small), small).distinct()) for small in (True, False))
    assert 2 * few <= more

import math
import re
from collections import Counter

import pytest

from quillspark.llm import lexical
from quillspark.llm.queries import ORACLE_SQL, op12_lexical_search, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    """Every document scored for every item, in Python's integers."""
    held = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    sizes = [sum(c.values()) for _, c in held]
    n, total, df = len(held), sum(sizes), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for (i, c), size in zip(held, sizes, strict=True):
            m = 75 + 25 * size * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in Counter(terms(text)).items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, **more):
    got = lexical.search(docs, items, **more)
    assert got.columns == ["item_id", "rank", "id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_query_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in op12_lexical_search(spark, sf).collect()]
    assert sorted(got) == sorted(con.execute(ORACLE_SQL["op12_lexical_search"]).fetchall())
    assert len(got) == 20 * len({g[0] for g in got}) > 0


def test_against_brute_force(spark, sf, documents):
    items = table(spark, sf, "benchmark")
    want = brute([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(documents.repartition(7), items) == want
    assert found(documents, items, most_bytes=700) == want  # many readings of the documents


@pytest.fixture(scope="module")
def odd_items(spark):
    rows = [(1, "The quick BROWN fox", "a"), (1, "fox fox fox", "b"), (2, None, "c"), (3, "", "d"), (4, "...!", "e"), (None, "Straße Bäume 678", "f"), (5, "mot fin", "g"), (6, "nowhere-at-all_x", "h"), (7, "the 😀", "i")]
    return spark.createDataFrame(rows, "item_id bigint, text string, doc_id string")


def test_odd_rows(spark, odd_documents, odd_items):
    docs, items = [(r.doc_id, r.text) for r in odd_documents.collect()], [(r.item_id, r.text) for r in odd_items.collect()]
    for k in (1, 3, 20):
        assert found(odd_documents, odd_items, k=k) == brute(docs, items, k)


def test_ties_go_by_id_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 50)
    rows = [((i * 7919) % 1000, "alpha beta" if i % 3 else "alpha beta gamma") for i in range(900)] + [(i, "delta") for i in range(1000, 1400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    items = spark.createDataFrame([(1, "alpha"), (2, "gamma beta")], "item_id bigint, text string")
    want = brute(rows, [(1, "alpha"), (2, "gamma beta")])
    assert found(docs, items) == want and len(want) == 40


def test_other_kinds_of_ids(spark):
    docs = spark.createDataFrame([("é", "alpha"), ("b", "alpha"), ("a", "alpha beta"), (None, "alpha")], "key string, body string")
    items = spark.createDataFrame([("i", "alpha beta")], "item_id string, text string")
    got = found(docs, items, id_col="key", text_col="body")
    assert [g[2] for g in got] == ["a", "b", "é", None]


def test_empty_tables(spark, no_documents, odd_documents, odd_items):
    assert found(no_documents, odd_items) == []
    assert found(odd_documents, odd_items.filter("false")) == []


def test_exact_lengths_beyond_64_bits():
    import numpy as np

    n = np.array([10**6, 3, 10**6])
    docs, total = 10**13, 4 * 10**13
    assert lexical.lengths(n, docs, total).tolist() == [75 + 25 * x * docs // total for x in (10**6, 3, 10**6)]

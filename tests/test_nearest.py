"""Nearest vectors of many queries against one query at a time."""

import random

import pytest

from quillspark.operators.nearest import nearest
from quillspark.plans import named

SCHEMA = "id bigint, embedding array<double>"


def some(seed, n):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(n)]
    # Copies, multiples and opposites of earlier ones make ties.
    return [(i, v if i % 4 else [x * rng.choice([1.0, 2.0, -1.0]) for x in base[rng.randrange(n)]]) for i, v in enumerate(base)]


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


def one_by_one(vectors, asked, most):
    out = []
    for i, q in asked:
        found = named.vector_top(vectors, q, most).collect()
        out += [(i, n + 1, r.id, r.score) for n, r in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("most", [1, 4])
def test_as_one_query_at_a_time(spark, most):
    data = some(most, 240)
    v = spark.createDataFrame(data, SCHEMA).repartition(3)
    asked = [r for r in data if r[0] % 40 == 0]
    q = spark.createDataFrame(asked, SCHEMA)
    want = one_by_one(v, asked, most)
    assert rows(nearest(v, q, most)) == want
    assert rows(nearest(v.repartition(7), q, most, block_bytes=100)) == want  # three blocks, other tasks


def test_slices_of_a_batch(spark, monkeypatch):
    data = some(9, 300)
    v, asked = spark.createDataFrame(data, SCHEMA).coalesce(1), data[:9]
    want = one_by_one(v, asked, 3)
    monkeypatch.setattr("quillspark.operators.nearest.ROWS", 7)
    monkeypatch.setattr("quillspark.operators.nearest.QUERIES", 4)
    assert rows(nearest(v, spark.createDataFrame(asked, SCHEMA), 3)) == want


def test_odd_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, [-1.0, 0.0])], SCHEMA)
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], SCHEMA)
    got = rows(nearest(v, q, 9))
    assert got == [(1, 1, 1, 1.0), *[(1, k, k, 0.0) for k in range(2, 8)], (1, 8, 8, -1.0), *[(2, k, k, 0.0) for k in range(1, 9)]]
    assert rows(nearest(v.limit(0), q, 2)) == rows(nearest(v, q.limit(0), 2)) == []
    with pytest.raises(ValueError):
        nearest(v, v, 2)  # several lengths
    with pytest.raises(ValueError):
        nearest(v, q, 0)


def test_many_copies_and_keys_as_text(spark):
    v = spark.createDataFrame([(f"k{i:05}", [1.0, 2.0] if i % 3 else [float(i), 1.0]) for i in range(6000)], "id string, embedding array<float>")
    got = rows(nearest(v, v.filter("id = 'k00001'"), 3))
    assert [r[2] for r in got] == ["k00001", "k00002", "k00004"]

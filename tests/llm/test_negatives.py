import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import negatives
from quillspark.llm.queries import ORACLE_SQL, op11_hard_negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor, positives=5, k=5):
    """All scores of all anchors, sorted, with Python's integers."""
    used = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    anchors, out = {(i, label, tuple(v)) for i, label, v in used if is_anchor(i)}, []
    for a, mine, v in anchors:
        score = lambda w: max(-negatives.MOST_SCORE, min(negatives.MOST_SCORE, sum(x * y for x, y in zip(v, w, strict=False))))  # noqa: B023,E731
        scored = sorted((-score(w), i, label) for i, label, w in used)
        for s, p, _ in [x for x in scored if x[2] == mine and x[1] != a][:positives]:
            fits = [x for x in scored if x[2] != mine and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, p, rank, x[1], -s, -x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(out)


def found(df, **more):
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **more)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


def test_query_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got = op11_hard_negatives(spark, sf)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(con.execute(ORACLE_SQL["op11_hard_negatives"]).fetchall())
    assert got.count() > 50


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(size=6).round(2).tolist()) for i in range(200)]
    same = [0.5, 0.25, 0.5, 0.25, 0.5, 0.75]  # ties: more of one score than a gathering takes, of either label
    rows += [(1000 + i, i % 2, same) for i in range(320)]
    rows += [(2000, 1, same)] * 90  # repeated rows; 2000 is an anchor
    rows += [(None, 1, same), (3000, None, same), (3010, 1, None), (3020, 1, [1.0, None]), (3030, 1, [math.nan] * 6), (3040, 0, [math.inf] + same[1:])]
    rows += [(4000, 2, []), (4010, 2, [0.5]), (4020, 0, same + [9.0, 9.0]), (-10, 1, same), (-7, 0, [-x for x in same])]
    return rows


@pytest.mark.parametrize("block_size", [1024, 7])
def test_odd_rows(spark, odd, block_size):
    df = spark.createDataFrame([(*r, "x", "y") for r in odd], "vec_id bigint, label int, embedding array<float>, id string, score string").repartition(5)
    stored = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    want = brute(stored, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert found(df, block_size=block_size) == want


def test_large_components_stay_exact(spark):
    rows = [(i, i % 2, [float((i * 7919) % 1000) * 1e6, 3e38 if i == 3 else 1e9, -float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    assert found(df) == brute(rows, lambda i: i % 10 == 0)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>")
    assert found(empty) == []
    assert found(spark.createDataFrame([(1, 1, [1.0])], empty.schema)) == []  # no anchor
    assert found(spark.createDataFrame([(10, 1, [1.0]), (11, 2, [1.0])], empty.schema)) == []  # an anchor without a positive


def test_ids_of_any_size(spark):
    far = [-(1 << 63), (1 << 63) - 1, 0, 10, -10]
    rows = [(i, k % 2, [1.0, 1.0]) for k, i in enumerate(far)] + [(100 + i, 1, [1.0, 1.0]) for i in range(1, 100)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    assert found(df) == brute(rows, lambda i: math.fmod(i, 10) == 0)

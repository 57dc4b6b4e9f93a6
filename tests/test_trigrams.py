"""Substring search by trigrams against the plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import trust
from quillspark.operators.trigrams import TrigramIndex, grams_of, trigrams

SCHEMA = "id bigint, title string, summary string, statement string, bucket int"


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé%_") for _ in range(rng.randint(1, 6)))
    line = lambda: None if rng.random() < 0.1 else " ".join(word() for _ in range(rng.randint(0, 5))).title()
    return [(i, line(), line(), line(), i % 3) for i in range(n)]


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    made = TrigramIndex(spark, str(tmp_path_factory.mktemp("grams")), buckets=16, key_type="bigint")
    made.append(spark.createDataFrame(texts(1, 300), SCHEMA))
    return made


def test_trigrams(spark):
    got = spark.range(1).select(trigrams(F.lit("Añb\n😀aññb")).alias("a"), trigrams(F.lit("ab")).alias("b"), trigrams(F.lit(None).cast("string")).alias("c")).first()
    assert set(grams_of("añb\n😀aññb")) <= set(got.a) and got.b == [] and got.c == []


@pytest.mark.parametrize("seed", range(4))
def test_against_the_scan(spark, index, seed):
    rows = spark.createDataFrame(texts(1, 300), SCHEMA)
    rng = random.Random(seed)
    pool = [w for r in texts(1, 300) for f in r[1:4] if f for w in f.split()]
    for size in (1, 2, 3):
        words = [w[: rng.randint(2, 6)] for w in rng.sample(pool, size)]
        assert ids(index.all_tokens(rows, words)) == ids(rows.filter(trust.all_tokens(words)))
        assert ids(index.any_token(rows, words)) == ids(rows.filter(trust.any_token(words)))


def test_odd_words(spark, index):
    rows = spark.createDataFrame(texts(1, 300), SCHEMA)
    assert ids(index.all_tokens(rows, [])) == ids(index.any_token(rows, [])) == []
    assert ids(index.all_tokens(rows, ["zzzz"])) == ids(index.any_token(rows, ["zzzz"])) == []
    assert ids(index.any_token(rows, ["zzzz", "abc"])) == ids(rows.filter(trust.any_token(["abc"])))
    assert ids(index.all_tokens(rows, ["a"])) == ids(rows.filter(trust.all_tokens(["a"])))  # too short: the scan
    many = ["zzz"] * 12 + ["abc"]
    assert ids(index.any_token(rows, many)) == []  # the thirteenth word is not searched


def test_changed_rows(spark, tmp_path):
    index = TrigramIndex(spark, str(tmp_path), buckets=4, key_type="bigint")
    old = spark.createDataFrame([(1, "old title", None, None, 0), (None, "old title", "x", "y", 0), (2, "another", None, None, 0)], SCHEMA)
    index.append(old)
    now = spark.createDataFrame([(1, "new title", None, None, 0), (2, "another", None, None, 0), (3, "title three", None, None, 0)], SCHEMA)
    index.append(now.filter("id <> 2"))
    assert ids(index.all_tokens(now, ["title"])) == [1, 3]
    assert ids(index.all_tokens(now, ["old"])) == []
    assert ids(index.any_token(now, ["new", "other"])) == [1, 2]


def test_only_the_words_buckets_are_read(spark, index):
    found = index.candidates(["abca"], every=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:120]
    assert found.inputFiles()
    scanned = index._of("postings", grams_of("abca")).select(F.input_file_name().alias("f")).distinct().collect()
    assert 0 < len({r.f.split("bucket=")[1].split("/")[0] for r in scanned}) <= len(grams_of("abca"))


def test_empty_table(spark, tmp_path):
    index = TrigramIndex(spark, str(tmp_path), buckets=4, key_type="bigint")
    none = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        index.append(none.withColumn("id", F.lit("a")))
    index.append(none)
    assert ids(index.all_tokens(none, ["abc"])) == ids(index.any_token(none, ["abc"])) == []


def test_tasks_write_postings_without_a_shuffle(spark, tmp_path):
    """One input partition makes one file of a bucket at most, in a folder of its append; counts add up over appends."""
    index, before = TrigramIndex(spark, str(tmp_path), buckets=4, key_type="bigint"), spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    for k in range(2):
        index.append(spark.createDataFrame([(i + 100 * k, "abcd " * 3, f"xyz{i}", None, 0) for i in range(50)], SCHEMA).coalesce(1))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    files = [p for p in tmp_path.glob("postings/batch=*/bucket=*/*.parquet")]
    assert 0 < len(files) <= 2 * 4 and len({p.parent for p in files}) == len(files)
    assert index._of("counts", ["abc"]).agg(F.sum("n")).first()[0] == index._of("postings", ["abc"]).count() == 100

import random

import numpy as np

from quillspark.llm import toxicity as t
from quillspark.llm.queries import op6_toxicity, table


def test_query_held_out(spark, documents):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op6_toxicity(spark, folder).collect()}
    assert len(got) == table(spark, folder, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(r.toxic, got[r.doc_id].predicted) for r in table(spark, folder, "labels").collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.94
    toxic = [p for y, p in held if y]
    assert toxic and sum(toxic) / len(toxic) > 0.7


def made(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        if i % 2:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zzyxx", "qworble", "wyvrock"])
        out.append((i, " ".join(words), i % 2))
    return out


def test_made_text(spark):
    rows = made(600, 1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    scores = {r.id: r.score for r in t.classify(docs.drop("toxic"), docs.filter("doc_id < 400").select("doc_id", "toxic")).collect()}
    right = [(scores[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 400]
    assert sum(right) / len(right) > 0.95


def test_segments_against_brute_force(spark):
    rows = made(120, 2)
    df = spark.createDataFrame([(x, y) for _, x, y in rows], "text string, y int")
    got = {r.s: (r.toxic, r.ordinary) for r in t.segment_counts(df).collect()}
    sets = [(t.beginnings(x), y) for _, x, y in rows]
    assert got == {s: (sum(s in b for b, y in sets if y), sum(s in b for b, y in sets if not y)) for b, _ in sets for s in b}
    picked = t.chosen(got, 60, 60)
    assert {p.strip()[:4] for p in picked} == {"zzyx", "qwor", "wyvr"}


def test_savings():
    rows = made(200, 3)
    d = t.Dictionaries.of([x.encode() for _, x, y in rows if not y], [" zzyxx ", " qworble "])
    saver = t.Saver(d)
    plain = "bada gitu fela mona pera sodu"
    assert saver.saving(f"{plain} qworble {plain}") >= 2 > saver.saving(f"{plain} {plain}")
    for text in (None, "", " ", "x" * 100_000, "qworble", "é " * 5000):
        f = saver.features(text)
        assert len(f) == len(t.NAMES) and np.isfinite(f).all()


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (5, None), (None, 1), (8, 0), (7, 1), (99, 0)], "doc_id bigint, toxic int")
    got = t.classify(odd_documents, labels).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 for r in got)
    assert t.classify(odd_documents, labels.limit(0)).filter("score is null").count() == 0
    assert t.classify(no_documents, labels).count() == 0

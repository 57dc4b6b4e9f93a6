import math
import struct
import zlib

import numpy as np
import xxhash

from quillspark.llm import quality
from quillspark.llm.queries import op10_quality, table


def test_query_held_out(spark, sf, documents):
    got = {r.doc_id: r for r in op10_quality(spark, sf).collect()}
    assert set(got) == {r.doc_id for r in documents.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(r.quality, got[r.doc_id].predicted) for r in table(spark, sf, "labels").collect() if got[r.doc_id].held_out]
    assert held and sum(a == b for a, b in held) / len(held) > 0.9


def test_held_out_labels_teach_nothing(spark, sf):
    labels = table(spark, sf, "labels")
    learned = quality.learned_from(labels)
    assert 0 < learned.count() < labels.count()
    assert {r.doc_id for r in learned.collect()} == {r.doc_id for r in labels.collect() if __import__("zlib").crc32(str(r.doc_id).encode()) % 3 != 1}


def test_fit_minimises_the_pairwise_loss():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    y = (x @ [2, -1, 0, 0.5] + rng.logistic(size=400) > 0).astype(int)
    model = quality.fit(x, y, pairs=20000)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.array(model.weights) * x.std(axis=0)
    g = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[good[g.integers(0, len(good), 20000)]] - z[bad[g.integers(0, len(bad), 20000)]]
    loss = lambda v: np.log1p(np.exp(-(d @ v))).mean() + quality.RIDGE / 2 * v @ v
    assert all(loss(w) <= loss(w + e) for e in np.vstack([np.eye(4), -np.eye(4)]) * 0.02)
    assert abs((x @ model.weights < model.threshold).mean() - (y == 0).mean()) < 0.01


def test_threshold_is_that_of_all_labels():
    """A sample with as many rows of either label gives the cut of the whole, where a fifth is bad."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30000, 3))
    y = (x @ [2, -1, 0.5] + rng.logistic(size=30000) > -2.6).astype(int)
    bad, good = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    part = np.concatenate((bad[:2000], good[:2000]))
    model, whole = quality.fit(x[part], y[part], totals=(len(bad), len(good))), quality.fit(x, y)
    share = lambda m: (x @ m.weights < m.threshold).mean()
    assert abs(share(whole) - len(bad) / len(y)) < 0.001 and abs(share(model) - len(bad) / len(y)) < 0.02
    assert abs(share(quality.fit(x[part], y[part])) - len(bad) / len(y)) > 0.1  # as if half were bad
    assert abs(model.scale / np.std(x @ model.weights) - whole.scale / np.std(x @ whole.weights)) < 0.02
    twice = quality.fit(x, y, totals=(len(bad), len(good)))
    assert twice.threshold == whole.threshold


def brute_features(text):
    """Character by character, word by word."""
    text = text or ""
    raw = text.encode()
    share = lambda k, of: math.log(0.001 + (k / of if of else 0))
    words, lines = text.split(), [x for x in text.split("\n") if x]
    kinds = [lambda c: "A" <= c <= "Z", lambda c: "a" <= c <= "z", lambda c: "0" <= c <= "9", lambda c: c in " \t\r\n\x0b\x0c", lambda c: c in ".,;:?'\"()-", lambda c: c == "!", lambda c: c == "|", lambda c: c in "#$%&*+=@^~<>[]{}\\/_`"]
    out = [share(sum(map(kind, text)), len(raw)) for kind in kinds]
    out += [math.log(1 + len(raw)), math.log(1 + len(words)), math.log(1 + len(raw) / len(words)) if words else 0]
    out += [share(len(set(words)), len(words)), share(max([words.count(x) for x in set(words)], default=0), len(words))]
    out.append(share(sum(words[i] == words[i + 1] for i in range(len(words) - 1)), len(words)))
    out.append(math.log(1 + len(raw) / len(lines)) if lines else 0)
    out.append(share(sum(x in lines[:i] for i, x in enumerate(lines)), len(lines)))
    out.append(share(sum(not x[-1].isalnum() and x[-1] not in ".,;:?" for x in words), len(words)))
    return [*out, share(sum(byte > 127 for byte in raw), len(raw))]


def test_query_against_brute_force(spark, sf, documents):
    """Features, choice of rows, threshold and score afresh; that the weights are the optimum is another test's matter."""
    docs = {r.doc_id: brute_features(r.text) for r in documents.collect()}
    taught = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in docs}
    ids = sorted(taught, key=lambda k: np.uint64(xxhash.xxh64_intdigest(struct.pack("<q", k), 42)).astype(np.int64))
    x, y = np.array([docs[k] for k in ids]), np.array([taught[k] for k in ids])
    model = quality.fit(x, y)
    s = np.sort(x @ model.weights)
    bad = int((y == 0).sum())
    assert abs(model.threshold - (s[bad - 1] + s[bad]) / 2) < 1e-6
    for r in op10_quality(spark, sf).collect():
        want = 1 / (1 + math.exp(-(np.dot(docs[r.doc_id], model.weights) - model.threshold) / model.scale))
        assert abs(r.score - want) < 1e-6


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (5, None), (None, 1), (8, 0), (7, 1), (99, 0)], "doc_id bigint, quality int")
    got = quality.rank(odd_documents, labels).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.rank(odd_documents, labels.filter("quality = 1")).collect()} == {0.5}
    assert quality.rank(no_documents, labels).count() == 0


def test_features_are_finite():
    for t in (None, "", " ", "\n\n", "é" * 1000, "!!!", "a b\nc", "😀"):
        assert len(quality.features(t)) == len(quality.NAMES) and np.isfinite(quality.features(t)).all()


def test_more_labels_than_the_driver_takes_all_count(spark, monkeypatch):
    """Beyond MAX_ROWS each labelled row still teaches: the cut is that of all rows, and the weights order them as a fit of all."""
    monkeypatch.setattr(quality, "MAX_ROWS", 20)
    texts = [(i, ("good words here. " if i % 4 else "BAD! ") * (1 + i % 7) + "xyz "[: i % 4] * (i % 11), int(i % 4 > 0 or i % 20 == 0)) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, quality int")
    scores = {r.id: r.score for r in quality.rank(docs, docs.select("doc_id", "quality")).collect()}
    y = np.array([t[2] for t in texts])
    got = np.array([scores[t[0]] for t in texts])
    bad = int((y == 0).sum())
    s = np.sort(got)
    assert s[bad - 1] <= 0.5 + 1e-9 and s[bad] >= 0.5 - 1e-9 and len(got) == 300
    whole = quality.fit(np.array([quality.features(t[1]) for t in texts]), y)
    want = np.array([quality.features(t[1]) for t in texts]) @ whole.weights
    assert np.corrcoef(np.log(got / (1 - got)), want)[0, 1] > 0.98

import math

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import langid
from quillspark.llm.common import fold
from quillspark.llm.queries import op1_language_id


def test_query_held_out_accuracy(spark, sf, documents):
    got = {r.doc_id: r for r in op1_language_id(spark, sf).collect()}
    held = documents.select("doc_id", "lang", (fold(F.col("doc_id"), 4) == 2).alias("h")).collect()
    assert len(got) == len(held) and {r.doc_id for r in held if r.h} == {k for k, r in got.items() if r.held_out}
    right = [got[r.doc_id].lang_pred == r.lang for r in held if r.h]
    assert sum(right) / len(right) > 0.97
    assert sum(r.rejected for r in got.values()) <= 0.01 * len(got)


def brute_probability(words, target, context):
    """Interpolated Kneser-Ney by definition, over strings: the last of ``context + target``, order by order."""
    order = langid.ORDER
    top = {}
    for w in words:
        padded = "^" * (order - 1) + w + "$"
        for i in range(order - 1, len(padded)):
            g = padded[i - order + 1 : i + 1]
            top[g] = top.get(g, 0) + 1
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1
    p = 1 / (len(levels[1]) + 1)
    for k in range(1, order + 1):
        c, ctx = levels[k], context[len(context) - k + 1 :] if k > 1 else ""
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        mine = {g: v for g, v in c.items() if g[:-1] == ctx}
        if mine:
            total = sum(mine.values())
            p = max(mine.get(ctx + target, 0) - d, 0) / total + d * len(mine) / total * p
    return p


def test_model_against_definition():
    words = ["banana", "band", "bandana", "cab", "an", "a", "cabana"]
    packed, owner = langid.grams(words)
    keys, n = np.unique(packed[-1], return_counts=True)
    model = langid.Model.fit({"x": (keys, n)})
    for probe in ("banana", "bb", "zan"):
        bits = model.bits(langid.grams([probe])[0][-1])[:, 0]
        padded = "^" * (langid.ORDER - 1) + probe + "$"
        for i, b in enumerate(bits):
            at = i + langid.ORDER - 1
            assert abs(b + math.log2(brute_probability(words, padded[at], padded[at - langid.ORDER + 1 : at]))) < 1e-4


def test_strangers_are_rejected(spark, documents):
    strange = spark.createDataFrame([(10**6, " ".join("qxzvkj"[i % 6] * 3 + "wqk"[i % 3] for i in range(200)), None)], "doc_id bigint, text string, lang string")
    both = documents.select("doc_id", "text", "lang").unionByName(strange)
    kept = {r.doc_id for r in langid.keep_recognised(both).collect()}
    assert 10**6 not in kept and len(kept) > 0.99 * documents.count()


def test_odd_rows(odd_documents, no_documents):
    model = langid.train(odd_documents)
    got = langid.score(odd_documents, model).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == "und" for r in got) == 5  # null texts, empty, blank, digits only
    kept = langid.keep_recognised(odd_documents)
    assert kept.columns == odd_documents.columns and kept.filter("text is null").count() == 0
    assert langid.keep_recognised(no_documents).count() == 0
    assert langid.score(odd_documents, langid.train(no_documents)).filter("lang_pred <> 'und'").count() == 0


def test_numerals_are_no_letters(spark, documents):
    df = spark.createDataFrame([(1, "² ½ Ⅷ ___"), (2, "x²")], "doc_id bigint, text string")
    assert [r.lang_pred == "und" for r in langid.score(df, langid.train(documents)).orderBy("id").collect()] == [True, False]


def test_size_bound(documents):
    model = langid.train(documents, max_grams=500)
    assert all(len(g) for g in model.grams) and model.probs[-1].astype(bool).sum(axis=0).max() <= 600


def test_all_languages_and_grams_are_learned(spark):
    rare = " ".join(chr(0x4E00 + i // 400) + chr(0x4E00 + i % 400) for i in range(160_000))
    rows = [(f"l{k:03}", chr(0x3400 + 4 * k) * 3) for k in range(210)] + [("zh", "\u9000\u9001 " * 50 + rare)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.langs) == 211
    assert (model.probs[-1][:, model.langs.index("zh")] > 0).sum() > 160_000


def test_size_bound_keeps_discounts():
    words = ["banana", "band", "bandana", "cab", "an", "a", "cabana"]
    keys, n = np.unique(langid.grams(words * 2 + ["banana"] * 3)[0][-1], return_counts=True)
    whole, cut = langid.Model.fit({"x": (keys, n)}), langid.Model.fit({"x": (keys, n)}, 8)
    assert 0 < len(cut.grams[-1]) <= 8 < len(whole.grams[-1])
    assert all((a == b).all() for a, b in zip(whole.probs[:-1], cut.probs[:-1]))
    sums = np.bincount(np.searchsorted(cut.contexts[-1][:], cut.grams[-1] >> np.uint64(16)), cut.probs[-1][:, 0], len(cut.contexts[-1]))
    assert np.allclose(sums + cut.weights[-1][:, 0], 1)

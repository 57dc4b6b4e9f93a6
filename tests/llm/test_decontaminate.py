from collections import Counter

from quillspark.llm import decontaminate as d
from quillspark.llm.queries import op8_decontamination, table


def brute(text, items):
    """Items of which four fifths of the shingles stand in the text, by exhaustive comparison."""
    have = d.shingles(d.words_of(text or ""))
    return {i for i, t in items if t and (s := d.shingles(d.words_of(t))) and len(s & have) / len(s) >= 0.8}  # items have five words or more


def test_query_finds_what_exhaustive_comparison_finds(spark, sf, documents):
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    want = {(r.doc_id, i) for r in documents.collect() for i in brute(r.text, items)}
    got = {(r.doc_id, r.item_id) for r in op8_decontamination(spark, sf).collect()}
    assert want and got == want


def test_wand_scores_equal_exhaustive_bm25(spark, sf, documents):
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    index = d.Index(items)
    search = d.Searcher(index, d.THRESHOLD, 0.0)
    for r in documents.limit(60).collect():
        words = d.words_of(r.text)
        want = Counter()
        for at in range(0, max(1, len(words) - index.longest), search.stride):
            terms = {index.vocabulary[w] for w in words[at : at + search.window] if w in index.vocabulary}
            score = Counter()
            for t in terms:
                for i, x in index.postings[t]:
                    score[i] += x
            for i, x in score.items():
                want[i] = max(want[i], x)
        got = {i: x for _, i, x, *_ in search([r.text])}
        for i, x in want.items():
            if x >= d.THRESHOLD + 1e-3 and brute(r.text, [items[i]]):
                assert abs(got[i] - x) < 1e-6


def test_hidden_in_long_text_and_altered(spark):
    item = "What is the capital of the old kingdom by the northern sea? It is the harbour town of Valmora near the cliffs."
    filler = " ".join(f"word{i}" for i in range(3000))
    docs = [(1, f"{filler} {item.upper()} {filler}"), (2, filler), (3, item.replace("old", "young")), (4, item.split("?")[0]), (5, None), (6, ""), (None, item)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, None), (3, "...")], "item_id bigint, text string")
    assert sorted(str(r.id) for r in d.matches(df, items).collect()) == ["1", "None"]
    assert sorted(str(r.doc_id) for r in d.remove(df, items).collect()) == ["2", "3", "4", "5", "6"]
    small = list(d.indexes(spark.createDataFrame([(i, f"{item} {i}") for i in range(5)], "item_id bigint, text string"), most_bytes=150))
    assert len(small) == 5


def test_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away")], "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert sorted(str(r.id) for r in d.matches(odd_documents, items).collect()) == ["1", "1", "2", "None"]
    kept = d.remove(odd_documents, items)
    assert kept.count() == odd_documents.count() - 4 and kept.columns == odd_documents.columns
    assert d.remove(odd_documents, none).count() == odd_documents.count() and d.remove(no_documents, items).count() == 0


def test_parts():
    assert d.parts("Who? Me.") == (["who"], ["me"]) and d.parts("one only") == (["one", "only"], []) and d.parts("") == ([], [])


def test_cuts_of_the_index_change_nothing(spark, sf, documents, monkeypatch):
    items = table(spark, sf, "benchmark")
    whole = sorted(map(str, d.matches(documents, items).collect()))
    monkeypatch.setattr(d.indexes, "__defaults__", ("item_id", "text", 900))
    assert sum(1 for _ in d.indexes(items)) > 2 * d.HELD
    assert sorted(map(str, d.matches(documents, items).collect())) == whole

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillspark.llm import packing
from quillspark.llm.queries import op2_packing, tokenizer_path


def brute(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 1]


def holds(rows, texts):
    """Every id of every row of texts lies in exactly one piece; sequences are gapless and within the capacity."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for key, pieces in by_doc.items():
        want = [brute(t) for k, t in texts if k == key]
        assert sum(p["length"] for p in pieces) == sum(map(len, want))
        crcs = sorted((p["start"], p["length"], p["ids_crc32"]) for p in pieces)
        assert all(any(zlib.crc32(np.array(w[s : s + n], "<u4").tobytes()) == c for w in want) for s, n, c in crcs)
        if len(want) == 1:
            at = 0
            for s, n, _ in crcs:
                assert s == at
                at += n
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.CAPACITY
    assert set(by_doc) == {k for k, _ in texts}
    return by_seq


def test_query_against_whole_tokenisation(spark, sf, documents):
    rows = [dict(r.asDict(), id=r.doc_id) for r in op2_packing(spark, sf).collect()]
    sequences = holds(rows, [(r.doc_id, r.text) for r in documents.collect()])
    total = sum(r["length"] for r in rows)
    padded = sum(s if (s := sum(p["length"] for p in ps)) & (s - 1) == 0 else packing.CAPACITY for ps in sequences.values())
    assert padded / total < 1.05


def test_odd_rows(odd_documents):
    holds([r.asDict() for r in packing.pack(odd_documents, tokenizer_path()).collect()], [(r.doc_id, r.text) for r in odd_documents.collect()])


def test_ids_come_along(odd_documents):
    for r in packing.pack(odd_documents, tokenizer_path(), with_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_empty_table(no_documents):
    assert packing.pack(no_documents, tokenizer_path()).count() == 0


@given(st.integers(1, 100_000))
def test_cut_is_exact(n):
    pieces = packing.cut(n)
    assert sum(pieces) == n and all(p == packing.CAPACITY or p & (p - 1) == 0 or p < packing.SMALLEST for p in pieces)


@given(st.lists(st.integers(1, 2048), max_size=300))
def test_packer_places_each_piece_once(lengths):
    p = packing.Packer(0)
    out = [x for i, n in enumerate(lengths) for x in p.add((i, 0, n))] + list(p.close())
    assert sorted(x[0] for x in out) == list(range(len(lengths)))
    used = defaultdict(int)
    for x in out:
        assert x[-1] == used[x[-2]]
        used[x[-2]] += x[2]
    assert all(v <= packing.CAPACITY for v in used.values())


@pytest.mark.parametrize("text", ["<|endoftext|> a<|startoftext|>b", "don't  stop now x　y", "İstanbul ΑΣ ΑΣ. é", "a\x1cb\x85c d", ""])
def test_words_encode_as_the_whole(text):
    assert packing.Encoder(tokenizer_path())([text])[0].tolist() == brute(text)[:-1]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_ids_of_whole_texts(name, documents):
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    encode, tokenizer = packing.Encoder(path), Tokenizer.from_file(path)
    assert encode.whole == (name == "byte_bpe_50k.json")
    texts = ["", " ", "A Tale  of\nTwo Cities", "it's  WE'LL 1234", "<|im_end|> x<|im_end|>", "é e\u0301 Ǆ İstanbul", *(r.text or "" for r in documents.limit(40).collect())]
    for text, got in zip(texts, encode(texts)):
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packs_with_another_tokenizer(odd_documents):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer, pieces = Tokenizer.from_file(path), defaultdict(dict)
    rows = packing.pack(odd_documents.filter("id = 'x' and doc_id in (2, 4, 10)"), path, with_ids=True).collect()
    for r in rows:
        pieces[r.id][r.start] = r.ids
    texts = {r.doc_id: r.text for r in odd_documents.collect()}
    for k, found in pieces.items():
        assert sum((found[s] for s in sorted(found)), []) == [*tokenizer.encode(texts[k], add_special_tokens=False).ids, 1]
    assert set(pieces) == {2, 4, 10}

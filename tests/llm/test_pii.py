import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st

from quillspark.llm import pii
from quillspark.llm.queries import op4_pii


def brute(text):
    """The patterns as they stand, scanned by the regular expression engine alone."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@given(st.text(alphabet="ab@.-+% 0123456789()\né", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 100_000, "1." * 100_000, "+1(" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


def test_query_against_patterns(spark, sf, documents):
    names = ("email", "ip", "card", "phone")
    got = {r.doc_id: r for r in op4_pii(spark, sf).collect()}
    assert len(got) == documents.count()
    for r in documents.collect():
        spans = brute(r.text or "")
        said = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(said.split(",")) <= set(g.spans.split(","))


def corpus(spark):
    rows = [(i, f"note {i} on project zanzibar from jo@corp.example.org, thanks to everybody") for i in range(6)]
    rows += [(100 + i, f"plain text {i} from everybody with thanks") for i in range(60)] + [(500, "zanzibar"), (501, None), (502, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_terms_that_reveal(spark):
    docs = corpus(spark)
    got = {r.doc_id: r for r in pii.find(docs, keep=("doc_id",), mask=True).collect()}
    text = docs.first().text
    at = text.index("zanzibar")
    assert f"term:{at}:{at + 8}" in got[0].spans.split(",") and "email:" in got[0].spans
    assert got[0].masked == "[TERM] 0 on [TERM] [TERM] from [EMAIL], thanks to everybody".replace("[TERM] 0", "[TERM] 0")
    assert all(not got[i].spans for i in range(100, 160)) and got[500].spans == "" and got[501].masked is None and got[502].masked == ""


def test_terms_against_brute_force(spark, monkeypatch):
    import math

    docs = corpus(spark).collect()
    words = [{pii.term(w) for w in (r.text or "").split()} for r in docs]
    held = [any(k == 0 for _, k, _ in brute(r.text or "")) for r in docs]
    near = {w for ws, h in zip(words, held) if h for w in ws if w and "@" not in w}
    want = set()
    for w in near:
        both, n, e = sum(h and w in ws for ws, h in zip(words, held)), sum(w in ws for ws in words), sum(held)
        if both >= 3 and math.log(both * len(docs) / (n * e)) / math.log(len(docs) / e) >= pii.THRESHOLD:
            want.add(w)
    for bound in (10**6, 0):
        monkeypatch.setattr(pii, "BROADCAST_ROWS", bound)
        got = {t for r in pii.revealing(corpus(spark)).collect() for t in r.terms}
        assert got == want and "zanzibar" in got


def test_classes_that_reveal(spark):
    """Every address stands in one text, its domain in several; the term beside them gives the domain away."""
    rows = [(i, f"word{i} from k{i}@hidden.example.org at fernhill with thanks") for i in range(5)] + [(100 + i, f"plain {i} from all with thanks at home") for i in range(80)]
    rows += [(200 + i, f"other{i} from p{i}@open.example.com at sea with thanks") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.find(docs, keep=("doc_id",), mask=True).collect()}
    assert got[0].masked == "word0 from [EMAIL] at [TERM] with thanks" and got[201].masked == "other1 from [EMAIL] at [TERM] with thanks"
    assert all(not got[100 + i].spans for i in range(80))
    assert pii._levels("ip:10.2.3.4") == ("ip:10.2.3.4", "ip:10.2.3*", "ip:*") and pii._levels("phone:17885552942")[1] == "phone:1788*"


def test_odd_rows(odd_documents, no_documents):
    assert pii.find(odd_documents, keep=("doc_id", "fp", "terms")).count() == odd_documents.count()
    done = pii.sanitise(odd_documents)
    assert done.columns == odd_documents.columns and done.count() == odd_documents.count()
    assert pii.sanitise(no_documents).count() == 0


def test_sanitise_leaves_clean_rows_alone(documents):
    before, after = ({r.doc_id: r for r in d.collect()} for d in (documents, pii.sanitise(documents)))
    dirty = {k for k, r in before.items() if brute(r.text)}
    assert dirty and all(before[k] == after[k] for k in before if k not in dirty)
    assert all(not brute(after[k].text) and after[k].n_chars == len(after[k].text) for k in dirty)


def test_overlapping_spans_become_one():
    assert pii.masked("abcdefgh", [(1, 3, 4), (2, 2, 6)]) == "a[PHONE]gh"

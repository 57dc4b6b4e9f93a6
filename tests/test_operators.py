"""Operators on literal rows, and set operators against brute force."""

import os
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import acquisition, claims, items, notices, relate, submissions, tables, trust
from quillspark.plans import named
from quillspark.plans.catalog import Q
from quillspark.plans.oracle import SQL
from quillspark.streaming import state

DAY = datetime(2026, 10, 1, 9)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_append_latest_history(spark):
    e = spark.createDataFrame([("s", "a", DAY, 1, 200), ("s", "a", DAY + timedelta(hours=1), 2, 200), ("s", "b", DAY + timedelta(hours=2), 3, 200)], "source_id string, content_hash string, fetched_at timestamp_ntz, doc_id int, http_status int")
    new = acquisition.append(e.limit(0), e)
    assert rows(new, "content_hash", "doc_id") == [("a", 1), ("b", 3)]
    assert acquisition.append(new, e).count() == 0  # again: nothing new
    assert acquisition.latest(e).first().content_hash == "b"


def test_change_status(spark):
    seen = [("A", 200), ("A", 200), ("B", 200), ("A", 200), ("C", 500), ("B", 200)]
    e = spark.createDataFrame([("s", h, DAY + timedelta(hours=i), i, s) for i, (h, s) in enumerate(seen)], "source_id string, content_hash string, fetched_at timestamp_ntz, doc_id int, http_status int")
    got = [(r.status, r.reverted) for r in acquisition.change_status(e).orderBy("doc_id").collect()]
    assert got == [("FETCHED", False), ("UNCHANGED", False), ("CHANGED", False), ("UNCHANGED", True), ("FAILED", False), ("UNCHANGED", True)]


def claim_rows(spark, statements):
    df = spark.createDataFrame([(i, f"c{i}", s, t) for i, (s, t) in enumerate(statements)], "pos int, id string, source_id string, statement string")
    return df.withColumn("fingerprint", text.fingerprint(F.col("statement"))).withColumn("toks", text.token_set(F.col("statement")))


def test_dedupe_and_same_content(spark):
    c = claim_rows(spark, [("a", "Fees due!"), ("b", "fees  DUE"), ("a", "other")])
    assert rows(claims.deduplicate(c), "id") == [("c0",), ("c2",)]
    assert rows(relate.same_content(c), "left", "right") == [("c0", "c1")]
    assert rows(relate.content_classes(c), "id", "class_id") == [("c0", "c0"), ("c1", "c0"), ("c2", "c2")]


def test_similar_and_conflicting(spark):
    c = claim_rows(spark, [("a", "fees due on 25 September for all"), ("b", "fees due on 25 september for all"), ("a", "fees due on 30 September for all"), ("c", "other")])
    assert rows(relate.cross_source_similarity(c), "left", "right", "similarity") == [("c0", "c1", 1.0)]
    assert rows(relate.conflicts(c), "left", "right") == [("c0", "c2")]
    with pytest.raises(ValueError):
        relate.conflicts(c, 0)


@pytest.mark.parametrize("threshold", [0.3, 0.65, 0.8, 1.0])
def test_similarity_join_against_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    sets = [("abc"[rng.randrange(3)], " ".join(rng.choice(["the"] * 5 + [f"w{k}" for k in range(12)]) for _ in range(rng.randint(0, 9)))) for _ in range(90)]
    c = claim_rows(spark, sets)
    local = [(r.id, r.source_id, r.fingerprint, set(r.toks)) for r in c.orderBy("pos").collect()]

    def sim(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    pairs = [(x, y) for i, x in enumerate(local) for y in local[i + 1 :] if sim(x[3], y[3]) >= threshold - 1e-12]
    assert rows(relate.cross_source_similarity(c, threshold), "left", "right") == sorted((x[0], y[0]) for x, y in pairs if x[1] != y[1])
    assert rows(relate.conflicts(c, threshold), "left", "right") == sorted((x[0], y[0]) for x, y in pairs if x[1] == y[1] and x[2] != y[2])
    shuffled = c.repartition(7, "id")
    assert rows(relate.cross_source_similarity(shuffled, threshold), "left", "right") == rows(relate.cross_source_similarity(c, threshold), "left", "right")


def test_near_in_time_against_all_pairs(spark):
    rng = random.Random(5)
    times = [(f"i{k}", DAY + timedelta(minutes=rng.randint(0, 9000)) if k % 9 else None) for k in range(120)]
    df = spark.createDataFrame(times, "id string, due_at timestamp_ntz")
    for seconds in (60, 3600):
        want = sorted((a,) for a, t in times if t and any(b != a and u and abs((u - t).total_seconds()) <= seconds for b, u in times))
        assert rows(relate.near_in_time(df, df, seconds), "id") == want


def test_anchored_groups(spark):
    due = [("a", datetime(2026, 10, 3, 9)), ("b", datetime(2026, 10, 4, 8)), ("x", datetime(2026, 10, 4, 10)), ("c", datetime(2026, 10, 10, 9)), ("n", None)]
    df = spark.createDataFrame(due, "id string, due_at timestamp_ntz")
    assert [r.members for r in relate.anchored_groups(df, 24 * 3600).collect()] == [["a", "b"]]  # x is near b, not near a
    both = df.withColumn("user_id", F.lit(1)).unionByName(df.filter("id in ('a','c')").withColumn("user_id", F.lit(2)))
    assert rows(relate.anchored_groups(both, 24 * 3600, "user_id"), "user_id", "members") == [(1, ["a", "b"])]


def walked(times, seconds):
    """The anchor of each time, by a walk."""
    out, anchor = {}, None
    for t in sorted(set(times)):
        anchor = t if anchor is None or t - anchor > seconds else anchor
        out[t] = anchor
    return out


def test_gap_anchors_against_a_walk(spark):
    import random

    rng, start = random.Random(4), datetime(2026, 1, 1)
    data = [(i, rng.choice(["a", "b", None]), rng.randrange(0, 4000) if i % 3 else rng.randrange(0, 10**6)) for i in range(700)] + [(1000 + i, "long", 61 * i) for i in range(300)]
    df = spark.createDataFrame([(i, o, start + timedelta(seconds=s)) for i, o, s in data] + [(9999, "a", None)], "id bigint, user_id string, due_at timestamp_ntz").repartition(6)
    for seconds in (0, 60, 5000):
        want = {o: walked([s for _, p, s in data if p == o], seconds) for o in {d[1] for d in data}}
        base = int((start - datetime(1970, 1, 1)).total_seconds())
        got = {r.id: r.anchor - base for r in relate.gap_anchors(df, seconds, "user_id").collect()}
        assert got == {i: want[o][s] for i, o, s in data}
        every = walked([s for _, _, s in data], seconds)
        assert {r.id: r.anchor - base for r in relate.gap_anchors(df, seconds).collect()} == {i: every[s] for i, _, s in data}
    numbers = [(r.group_no, len(r.members)) for r in relate.anchored_groups(df.filter("user_id = 'long'"), 60, "user_id").collect()]
    assert numbers == []
    pairs = relate.anchored_groups(df.filter("user_id = 'long'"), 61, "user_id").collect()
    assert sorted(r.group_no for r in pairs) == list(range(150)) and all(len(r.members) == 2 for r in pairs)
    assert relate.anchored_groups(df.filter("false"), 60).collect() == []


def test_transitions(spark):
    states = list(claims.TRANSITIONS)
    df = spark.createDataFrame([(a, b) for a in states for b in states], "state string, next_state string")
    good, bad = claims.move(df)
    want = sorted((a, b) for a in states for b in states if a == b or b in claims.TRANSITIONS[a])
    assert rows(good, "state", "next_state") == want and bad.count() == 36 - len(want)


def test_verify_and_publish(spark):
    c = spark.createDataFrame([("c1", "e1", "VERIFIED"), ("c2", "e9", "VERIFIED"), ("c3", "e1", "UNVERIFIED")], "id string, evidence_id string, state string")
    e = spark.createDataFrame([("e1",), ("e1",)], "id string")
    assert rows(claims.verify(c, e), "claim_id", "state") == [("c1", "VERIFIED"), ("c2", "UNVERIFIED"), ("c3", "VERIFIED")]
    assert rows(claims.publishable(c, e), "id") == [("c1",)]


def test_claims_from_documents(spark):
    docs = spark.createDataFrame([("d1", "e", "s", "Fees due 1 May 2026. Seminar on 2 May 2026."), ("d2", "e", "s", "x" * 2000), ("d3", "e", "s", " "), ("d4", "e", "s", None)], "id string, evidence_id string, source_id string, body_text string")
    got = claims.claims_from_documents(docs, DAY)
    assert sorted((r.document_id, len(r.statement)) for r in got.collect()) == [("d1", 20), ("d1", 22), ("d2", 1000)]


def test_priority(spark):
    cases = [("FEES", timedelta(days=1), "CRITICAL", "IMMEDIATE"), ("EVENT", timedelta(days=30), "LOW", "UPCOMING"), ("NOTICE", None, "NORMAL", "NONE"), ("EVENT", timedelta(days=-1), "CRITICAL", "OVERDUE"), ("EVENT", timedelta(days=2), "LOW", "IMMEDIATE"), ("EXAM", timedelta(days=7), "HIGH", "SOON")]
    df = spark.createDataFrame([(c, "t", "s", DAY + d if d is not None else None, None, None, None, None, None) for c, d, _, _ in cases], "category string, title string, summary string, due_at timestamp_ntz, starts_at timestamp_ntz, program string, branch string, year int, semester int")
    assert [(r.importance, r.urgency) for r in items.prioritise(df, DAY).collect()] == [c[2:] for c in cases]


def test_facts_grouped(spark):
    df = spark.createDataFrame([(1, "t", "u", "b"), (2, "t", "u", "a"), (3, "t", "u", "b"), (4, "t", "v", "c")], "pos int, title string, url string, fact string")
    assert rows(items.facts_grouped(df), "url", "facts") == [("u", ["b", "a"]), ("v", ["c"])]
    assert items.facts_grouped(df, 1).filter("url = 'u'").first().facts == ["b"]


def test_scores_against_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(15)] + ["the", "please", "2026-05-01", "1 May 2026"]
    subs = [(f"s{i}", " ".join(rng.choices(words, k=rng.randint(0, 8)))) for i in range(25)]
    arch = [(f"i{i}", " ".join(rng.choices(words, k=rng.randint(0, 5))), " ".join(rng.choices(words, k=3))) for i in range(25)]
    s, a = spark.createDataFrame(subs, "id string, text string"), spark.createDataFrame(arch, "id string, title string, summary string")
    tb = F.concat_ws(" ", "title", "summary")
    pairs = s.select(F.col("id").alias("submission_id"), "text").crossJoin(a.select(F.col("id").alias("item_id"), tb.alias("b"), "summary"))
    # A title's dates are words only: the rule takes dates from the summary, the statement and the times.
    hit = F.arrays_overlap(text.date_tokens(F.col("text")), text.date_tokens(F.col("summary")))
    want = pairs.withColumn("score", F.round(text.match_score(text.content_tokens(F.col("text")), text.content_tokens(F.col("b")), hit), 9)).filter("score >= 0.15")
    got = submissions.scores(s, a).withColumn("score", F.round("score", 9))
    assert rows(got, "submission_id", "item_id", "score") == rows(want, "submission_id", "item_id", "score")
    best = submissions.best(submissions.scores(s, a), 2)
    assert best.groupBy("submission_id").count().agg(F.max("count")).first()[0] == 2 and best.filter("reason like '%matching date%'").count() > 0


def test_verdicts(spark):
    s = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    scored = spark.createDataFrame([("a", "i", 0.5), ("b", "j", 0.9), ("b", "i", 0.4), ("c", "i", 0.2)], "submission_id string, item_id string, score double")
    verdicts = submissions.classify(s, scored, spark.createDataFrame([("j",), ("j",)], "item_id string"))
    assert rows(verdicts, "submission_id", "verdict") == [("a", "MATCHED"), ("b", "CONFLICTING"), ("c", "UNVERIFIED")]
    assert rows(submissions.review_queue(verdicts, scored), "submission_id") == [("b",), ("c",)]


def at_the_limit(spark):
    """A submission of 6 words and an item of 30 that have 3 in common: 0.2 in decimals, whose double sum is below it."""
    s = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(6)))], "id string, text string")
    a = spark.createDataFrame([("i", " ".join(f"w{i}" for i in range(3, 33)), "", True)], "id string, title string, summary string, in_conflict boolean")
    return s, a


def test_score_at_a_limit_is_that_of_decimals(spark):
    s, a = at_the_limit(spark)
    scored = submissions.scores(s, a)
    want = duckdb.sql("SELECT least(1.0, 0.55 * n / (na + nb - n) + 0.30 * n / na) FROM (SELECT 6::BIGINT AS na, 30::BIGINT AS nb, 3::BIGINT AS n)").fetchall()
    assert [(r.score,) for r in scored.collect()] == want
    assert rows(submissions.classify(s, scored, a.select(F.col("id").alias("item_id")), 0.2), "submission_id", "verdict") == [("a", "UNVERIFIED")]


def test_review_queue_takes_a_score_at_the_limit_as_unverified(spark):
    s, a = at_the_limit(spark)
    scored = submissions.scores(s, a)
    verdicts = submissions.classify(s, scored, a.select(F.col("id").alias("item_id")), 0.2)
    assert rows(submissions.review_queue(verdicts, scored), "submission_id", "verdict") == [("a", "UNVERIFIED")]


def test_queue_sink_takes_a_score_at_the_limit_as_unverified(spark, tmp_path):
    s, a = at_the_limit(spark)
    state.queue_sink(str(tmp_path), a, 0.2)(s, 0)
    assert rows(spark.read.parquet(str(tmp_path)), "submission_id", "verdict") == [("a", "UNVERIFIED")]


def test_review_queue_rounds_halves_as_its_sql(spark, tmp_path):
    """An item's 19 tokens, all among 32: 0.5046875, whose product with 10^6 is below a half."""
    words = [f"w{i}" for i in range(31)]
    spark.createDataFrame([(1, 0, "user", " ".join([*words, "item"]))], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(2, " ".join(words[:18]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for name in ("conversations", "benchmark"):
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = duck.execute(SQL["review_queue"]).fetchall()
    assert rows(Q["review_queue"](spark, str(tmp_path)), "submission_id", "verdict", "top_score") == want == [("1:0", "CONFLICTING", 0.504687)]


def test_submissions_that_come_twice(spark, tmp_path):
    """The same id in one batch, in the 1st and the 66th file of a stream of 64 files a batch, with another text, without an id;
    an item without text, a dotted capital I."""
    words = [f"w{i}" for i in range(40)]
    sent = {0: [(1, 0, " ".join(words[:8])), (1, 0, " ".join(words[:8])), (2, 0, "none of them"), (3, 0, " ".join(words[:3])), (None, 0, " ".join(words[:8])), (None, 0, "item"), (5, 0, None), (6, 0, "w1 \u0130tem")]}
    sent |= {k: [(100 + k, 0, f"other{k} item")] for k in range(1, 65)}
    sent[65] = [(1, 0, "gone"), (2, 0, " ".join(words[:8])), (3, 0, " ".join(words[20:28])), (4, 0, " ".join(words[:2]))]
    items = [(1, " ".join(words[:12])), (2, " ".join(words[20:30])), (31, None), (5, " ".join(words[:30]))]
    duck = duckdb.connect()
    (tmp_path / "conversations.parquet").mkdir()
    for k, found in sent.items():
        duck.execute("create or replace table c (conv_id bigint, turn bigint, role varchar, text varchar)")
        duck.executemany("insert into c values (?, ?, 'user', ?)", found)
        path = tmp_path / "conversations.parquet" / f"part-{k:04}.parquet"
        duck.execute(f"copy c to '{path}' (format parquet)")
        os.utime(path, (10**9 + k, 10**9 + k))
    duck.execute("create table b (item_id bigint, text varchar)")
    duck.executemany("insert into b values (?, ?)", items)
    duck.execute(f"copy b to '{tmp_path}/benchmark.parquet' (format parquet)")
    duck.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'; create view benchmark as select * from b")
    for name in ("stream_queue", "submission_classify", "review_queue", "submission_scores"):
        want = duck.execute(SQL[name])
        columns = [c[0] for c in want.description]
        got = Q[name](spark, str(tmp_path))
        if name == "submission_scores":
            got = got.withColumn("score", F.round("score", 6))
        assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall())), name


def test_url_replacements_of_pages_with_one_shown_key(spark, tmp_path):
    """Pages 4 and 100,004 are shown by one key; each moved by itself, and neither to the other's url."""
    pages = [(4, "http://a.org/x#y"), (100_004, "http://b.org/x?q=1"), (5, "http://a.org/z"), (100_006, "http://a.org/w")]
    spark.createDataFrame(pages, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = Q["url_replacements"](spark, str(tmp_path))
    assert rows(got, "key", "old_url", "new_url") == sorted(duck.execute(SQL["url_replacements"]).fetchall())


def test_tables(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 1, "d"), (3, 0, "e")], "k int, v int, x string")
    merged = tables.upsert(old, new, ["k"], "v")
    assert rows(merged, "k", "x") == [(1, "a"), (2, "c"), (3, "d")] == rows(tables.upsert(merged, new, ["k"], "v"), "k", "x")
    assert rows(tables.upsert(old, new, ["k"], "v", ("x",)), "k", "v", "x") == [(1, 1, "a"), (2, 2, "b"), (3, 1, "e")]
    assert rows(tables.insert_if_absent(old, new, ["k"], "v"), "k", "x") == [(3, "e")]
    changed = tables.update(old, spark.createDataFrame([(1, None)], "k int, x string"), "k", ["x"])
    assert sorted(changed.collect(), key=lambda r: r.k)[0].x is None
    with pytest.raises(ValueError):
        tables.update(old, new, "k", ["nope"])
    assert rows(tables.delete(old, new, "k"), "k") == [(1,)]
    assert rows(tables.duplicate_keys(new, ["k"]), "k", "rows") == [(3, 2)]
    assert tables.manifest_hash(old).first() == tables.manifest_hash(old.repartition(3).select("x", "v", "k")).first() != tables.manifest_hash(new).first()
    with pytest.raises(KeyError):
        tables.one_row(old.filter("k = 9"), "9")


def test_retract(spark):
    i = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, supersedes_item_id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "old_item_id string, new_item_id string")
    left, edges = tables.retract(i, e, i.filter("id = 'a'").select("id"))
    assert sorted((r.id, r.supersedes_item_id or "-") for r in left.collect()) == [("b", "-"), ("c", "b")] and rows(edges, "old_item_id") == [("b",), ("x",)]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_chunks(spark, size):
    df = spark.createDataFrame([(1, bytearray(range(256))), (2, bytearray()), (3, None)], "k int, body binary")
    parts = tables.chunks(df, "k", "body", size)
    assert sorted((r.k, bytes(r.body)) for r in tables.reassemble(parts.repartition(3), "k").collect()) == [(1, bytes(range(256))), (2, b"")]


def test_run_summary(spark):
    summary = lambda *s: tables.run_summary(spark.createDataFrame([(x, 5) for x in s], "status string, bytes long")).first()
    assert [summary(*s).status for s in (("FETCHED",), ("FETCHED", "FAILED"), ("FAILED",), ())] == ["SUCCEEDED", "PARTIAL", "FAILED", "SUCCEEDED"]


def test_ledger(spark):
    w = spark.createDataFrame([(1, "i", "R", k) for k in "abcd"], "user_id int, item_id string, kind string, key string")
    ledger = spark.createDataFrame([(1, "i", "R", "a", "SENT", DAY), (1, "i", "R", "b", "FAILED", DAY), (1, "i", "R", "c", "PENDING", DAY - timedelta(hours=2))], "user_id int, item_id string, kind string, key string, status string, ts timestamp_ntz")
    assert rows(notices.to_send(w, ledger), "key") == [("b",), ("d",)]
    assert rows(notices.to_send(w, ledger, DAY, 60), "key") == [("b",), ("c",), ("d",)]
    assert notices.digest_gate(datetime(2026, 9, 28, 3, 14)) and not notices.digest_gate(datetime(2026, 9, 28, 3, 15)) and not notices.digest_gate(datetime(2026, 9, 29, 3, 0))


def test_scopes(spark):
    df = spark.createDataFrame([(1, "P", None, 2, None), (2, "Q", None, None, None), (3, None, None, None, None)], "id int, program string, branch string, year int, semester int")
    assert rows(df.filter(trust.scope_filter({"program": "P", "year": 2})), "id") == [(1,), (3,)]
    assert rows(df.select("id", trust.specificity().alias("n")), "id", "n") == [(1, 2), (2, 1), (3, 0)]
    assert df.withColumn("category", F.lit("x")).filter(trust.category_filter([])).count() == 3


def test_archive_search_orders_and_nulls(spark):
    cols = "id string, title string, summary string, category string, program string, branch string, year int, semester int, importance string, published_at timestamp_ntz, effective_from timestamp_ntz, effective_until timestamp_ntz, due_at timestamp_ntz, starts_at timestamp_ntz"
    rec = lambda i, title, imp, pub, due=None: (i, title, "exam forms", "EXAM", None, None, None, None, imp, pub, None, DAY + timedelta(days=1), due, None)
    df = spark.createDataFrame([rec("a", "forms", "LOW", None), rec("b", "exam forms", "LOW", DAY, DAY), rec("c", "other", "CRITICAL", DAY)], cols)
    order = lambda d: [r.id for r in d.collect()]
    assert order(named.search_archive(df)) == ["c", "b", "a"]
    assert order(named.search_archive(df, "Exam FORMS")) == ["b", "a", "c"]
    assert order(named.search_archive(df, now=DAY)) == ["b", "c", "a"]
    assert order(named.search_archive(df, now=DAY + timedelta(days=1))) == [] and len(order(named.search_archive(df, now=DAY + timedelta(days=1), include_expired=True))) == 3
    assert order(named.search_archive(df, "exam form")) == []


def test_change_status_by_brute_force(spark):
    draw = random.Random(5)
    fetched = [(i, draw.choice("ab"), draw.choice("xyz"), DAY + timedelta(hours=draw.randrange(200)), draw.choice([200, 200, 500])) for i in range(120)]
    df = spark.createDataFrame(fetched, "doc_id long, source_id string, content_hash string, fetched_at timestamp_ntz, http_status int")
    want, seen, last = [], {}, {}
    for i, source, mark, _, status in sorted(fetched, key=lambda r: (r[3], r[0])):
        known = seen.setdefault(source, set())
        said = "FAILED" if status >= 400 else "FETCHED" if not known else "UNCHANGED" if mark in known else "CHANGED"
        want.append((i, said, said == "UNCHANGED" and last[source] != mark))
        if status < 400:
            known.add(mark)
            last[source] = mark
    assert rows(acquisition.change_status(df), "doc_id", "status", "reverted") == sorted(want)


def test_late_evidence_and_batches(spark):
    cols = "source_id string, content_hash string, doc_id long, fetched_at timestamp_ntz"
    held = spark.createDataFrame([("a", "x", 1, DAY), ("b", "y", 2, DAY)], cols)
    new = spark.createDataFrame([("a", "z", 3, DAY - timedelta(1)), ("a", "w", 4, DAY), ("b", "v", 5, None), ("c", "u", 6, DAY)], cols)
    assert rows(acquisition.late(held, new), "doc_id") == [(3,)]
    assert rows(acquisition.latest(held.unionByName(acquisition.append(held, new.filter("doc_id = 3")))), "source_id", "doc_id") == [("a", 1), ("b", 2)]
    sent = spark.createDataFrame([("s1", "k/1"), ("s2", None), ("s3", "")], "id string, object_key string")
    whole = submissions.batch(sent, spark.createDataFrame([("i1", "T")], "id string, title string"), spark.createDataFrame([("i1",)], "left_claim_id string"), "/objects")
    got = {(r.part, r.id): (r.object_file, r.title, r.left_claim_id) for r in whole.collect()}
    assert got == {("submission", "s1"): ("/objects/s1", None, None), ("submission", "s2"): (None, None, None), ("submission", "s3"): (None, None, None), ("item", "i1"): (None, "T", None), ("conflict", None): (None, None, "i1")}


def test_scores_use_statements_and_times(spark):
    sent = spark.createDataFrame([("s", "fees due 14 September 2026")], "id string, text string")
    kept = spark.createDataFrame([("a", "other", "word", "fees", None), ("b", "other", "word", "none", datetime(2026, 9, 14)), ("c", "14 September 2026", "word", "none", None)], "id string, title string, summary string, statement string, due_at timestamp_ntz")
    got = {r.item_id: (r.shared, r.date_hit) for r in submissions.scores(sent, kept, keep=0.1, dated=submissions.DATED).collect()}
    assert got["a"] == (1, False) and got["b"] == (0, True) and not got["c"][1]


def shuffled_rows(spark, run):
    """Rows that the stages of ``run`` wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_scores_shuffle_no_pairs_of_copies(spark):
    """200 submissions of one text and 200 items of their date: 40,000 pairs, none of which is shuffled."""
    sent = spark.range(200).selectExpr("concat('s', id) AS id", "'fees due 14 September 2026' AS text")
    kept = spark.range(200).selectExpr("concat('i', id) AS id", "concat('item a', id) AS title", "'' AS summary", "TIMESTAMP_NTZ '2026-09-14 00:00:00' AS due_at")
    got = []
    assert shuffled_rows(spark, lambda: got.extend(submissions.scores(sent, kept).collect())) < 4000
    assert len(got) == 40_000 and len({(r.submission_id, r.item_id) for r in got}) == 40_000
    assert {(r.score, r.shared, r.date_hit) for r in got} == {(0.15, 0, True)}


def test_failed_streak(spark):
    fetched = [("a", 200, 0), ("a", 500, 1), ("a", 404, 1), ("a", 500, -1), ("b", 500, 0), ("b", 500, 2), ("c", 200, 0), (None, 500, 0)]
    df = spark.createDataFrame([(s, status, DAY + timedelta(hours=h)) for s, status, h in fetched], "source_id string, http_status int, fetched_at timestamp_ntz")
    got = {r.source_id: (r.consecutive_failures, r.last_success_at) for r in claims.failed_streak(df).collect()}
    assert got == {"a": (2, DAY), "b": (2, None), "c": (0, DAY), None: (1, None)}


def test_guards(spark):
    c = spark.createDataFrame([("a", "VERIFIED", "e1"), ("b", "VERIFIED", "e2"), ("c", "UNVERIFIED", "e1")], "id string, state string, evidence_id string")
    hand = spark.createDataFrame([("e1",), ("e1",)], "id string")
    assert rows(claims.all_publishable(c.filter("id = 'a'"), hand), "id", "state", "evidence_id") == [("a", "VERIFIED", "e1")]
    for bad in ("b", "c"):
        with pytest.raises(Exception, match=f"claim is not publishable: {bad}"):
            claims.all_publishable(c.filter(f"id = '{bad}'"), hand).collect()
    assert tables.assert_unique(c, ["id"]) is c
    with pytest.raises(ValueError, match="e1"):
        tables.assert_unique(c, ["evidence_id"])


def test_stated_edges(spark):
    pairs = spark.createDataFrame([("x", "y")], "left string, right string")
    assert [claims.explicit_edges(pairs, k, DAY).first().kind for k in claims.STATED] == ["CORRECTS", "SUPERSEDES", "CONFLICTS"]
    with pytest.raises(ValueError):
        claims.explicit_edges(pairs, "SIMILAR", DAY)

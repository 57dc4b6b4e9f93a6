import hashlib
from itertools import groupby

import duckdb
import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from quillspark.llm import chat
from quillspark.llm.queries import ORACLE_SQL, PROBE, op7_chat, table, tokenizer_path

TOKENIZER = tokenizer_path("byte_bpe_50k.json")
ENCODER = chat.load(TOKENIZER)


def expected(rows):
    """{conv: (turns, digest, loss characters, digest)} from the rows alone."""
    out = {}
    for key, turns in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")), key=lambda r: r[0]):
        turns = [(r or "", t or "") for _, _, r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[key] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_against_the_rows(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, sf, "conversations").collect()] + [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op7_chat(spark, sf).collect()}
    assert got == expected(rows)


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got = con.execute(ORACLE_SQL["op7_chat"]).fetchall()
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in op7_chat(spark, sf).collect())


ODD = [
    (1, 0, "user", "hi"), (1, 1, "assistant", " leading and trailing \n"), (1, 1, "assistant", " leading and trailing \n"), (1, None, "system", None), (2, 0, None, "x"), (2, 1, "assistant", ""), (None, 0, "assistant", "lost"),
    (3, 0, "assistant", "<|im_end|>\\<|<\\|" + "é😀\U0001d400" * 50), (3, 1, "assis\n<|im_sep|>tant", "\\"), (4, 0, "assistant", "long " * 40000), (4, 1, "user", "long " * 40000), (4, 2, "assistant", "end"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, "x") for r in ODD], "conv_id bigint, turn bigint, role string, text string, formatted string")
    for size in (chat.PART_CHARS, 3):
        parts = chat.format_conversations(df, TOKENIZER, part_chars=size)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(parts).collect()}
        assert got == expected(ODD)


def test_parts_have_the_tokens_of_the_whole(spark):
    df = spark.createDataFrame([r for r in ODD if r[0] == 3 or r[0] == 4], "conv_id bigint, turn bigint, role string, text string")
    ids = []
    for size in (10**7, 3):
        rows = chat.format_conversations(df, TOKENIZER, part_chars=size).orderBy("conv", "part").collect()
        ids.append([i for r in rows for i in r.ids])
    assert ids[0] == ids[1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.format_conversations(df, TOKENIZER)).count() == 0


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(alphabet="ab \n<|>\\im_end é😀", max_size=20)), max_size=6))
def test_round_trip_and_mask(turns):
    whole, spans, roles = chat.render(turns)
    assert chat.read_back(whole) == turns
    e = ENCODER.encode(whole, add_special_tokens=False)
    assert ENCODER.decode(e.ids, skip_special_tokens=False) == whole
    starts, ends = (np.array([o[k] for o in e.offsets], np.int32) for k in (0, 1))
    mine = [s for s, r in zip(spans, roles) if r == "assistant"]
    loss = chat.mask(starts, ends, mine)
    brute = [any(a < end and start < b for a, b in mine) for start, end in zip(starts, ends)]
    assert loss.tolist() == brute
    covered = {i for start, end, on in zip(starts, ends, loss) if on for i in range(start, end)}
    assert covered == {i for a, b in mine for i in range(a, b)}

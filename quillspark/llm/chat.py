"""Chat formatting with loss masks aligned to token offsets.

A turn is rendered as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed. Inside roles and texts a backslash
is doubled and ``<|`` becomes ``<\\|``, so control strings stand for themselves only, and both can be read back. The
rendering is encoded once, with offsets; the sorted spans of assistant texts are intersected with the sorted token
spans by binary search. Control strings are tokens of their own, so no token crosses the edge of a text, and a long
conversation may be encoded in parts that end between turns with the same tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, SEP, END)
#: Characters of rendered turns that are encoded at a time; a longer turn stands alone.
PART_CHARS = 1 << 20
TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], list[str]]:
    """The text of (role, text) turns, the span of each turn's text in it, and the roles."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans, [r for r, _ in turns]


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendering."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def load(path: str):
    """A byte-level tokenizer with the control strings as tokens and offsets that leave no character out."""
    from tokenizers import Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens(list(CONTROL))
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens that lie in one of the sorted spans; both ends are found by binary search."""
    out = np.zeros(len(starts), bool)
    for a, b in spans:
        if a < b:
            out[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = True
    return out


def format_conversations(rows: DataFrame, tokenizer: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",), part_chars: int = PART_CHARS, with_ids: bool = True) -> DataFrame:
    """(conv, part, formatted, ids, starts, ends, loss): the parts of each conversation, in order, in one task. Without
    ``with_ids`` the ids are null.

    Turns go by ``turn``, then role and text; null turns come first. A null text or role is empty, and rows with a null
    conversation form one of their own. Extra columns are ignored; an empty table has no parts. Rows are sorted into
    conversations, not gathered: a worker holds one part.
    """
    narrow = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    narrow = narrow.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = load(tokenizer), None

        def part(key, number: int, turns: list[tuple[str, str]]) -> list:
            whole, spans, roles = render(turns)
            e = encoder.encode(whole, add_special_tokens=False)
            starts, ends = np.fromiter(chain.from_iterable(e.offsets), np.int32).reshape(-1, 2).T.copy()
            loss = mask(starts, ends, [s for s, r in zip(spans, roles) if r in loss_roles])
            return [key, number, whole, np.array(e.ids, np.int32) if with_ids else None, starts, ends, loss]

        def batch(found: list) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["conv", "part", "formatted", "ids", "starts", "ends", "loss"])

        key, number, turns, size, found, first = None, 0, [], 0, [], True
        for b in batches:
            kind = b.schema.field(0).type
            for k, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if turns and (k != key or size + len(t) > part_chars):
                    found.append(part(key, number, turns))
                    number, turns, size = number + 1, [], 0
                if first or k != key:
                    key, number, first = k, 0, False
                turns.append((r, t))
                size += len(t)
                if len(found) >= 64 or found and size > part_chars // 2:
                    yield batch(found)
                    found = []
        if turns:
            found.append(part(key, number, turns))
        if found:
            yield batch(found)

    return narrow.mapInArrow(run, f"conv {narrow.schema['conv'].dataType.simpleString()}, part bigint, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def digests(parts: DataFrame, conv: str = "conv_id", ordered: bool = False) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the parts. ``ordered``: they
    come straight from format_conversations(), in its order; stored or shuffled ones are sorted first."""
    parts = parts.select("conv", "part", "formatted", "starts", "ends", "loss")
    if not ordered:
        parts = parts.repartition("conv").sortWithinPartitions("conv", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        for b in batches:
            done = []
            cols = [b.column(n).to_pylist() for n in ("conv", "part", "formatted")]
            for i, (key, number, whole) in enumerate(zip(*cols)):
                if number == 0:
                    done += [state] * bool(state)
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(whole):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                loss = b.column("loss")[i].values.to_numpy(zero_copy_only=False)
                starts, ends = b.column("starts")[i].values.to_numpy(), b.column("ends")[i].values.to_numpy()
                edge = np.flatnonzero(np.diff(np.concatenate(([False], loss, [False])).astype(np.int8)))
                for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    text = unescape(whole[starts[lo] : ends[hi - 1]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(whole)
            if done:
                yield batch(b, done)
        if state:
            yield batch(b, [state])

    def batch(b: pa.RecordBatch, done: list) -> pa.RecordBatch:
        kinds = [b.schema.field("conv").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols = zip(*[[s.hexdigest() if hasattr(s, "hexdigest") else s for s in row] for row in done])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = parts.schema["conv"].dataType.simpleString()
    return parts.mapInArrow(run, f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").withColumnRenamed("conv", conv)

"""Chat formatting by columnar byte assembly, with a loss mask, and the way back.

A turn is written ``### role``, a newline, its text, ``</turn>`` and a newline. Inside roles and texts a backslash, the first
byte of a control string (``###`` or ``</turn>``) and, in roles, a newline get a backslash before them, so the output can be
read back exactly. For every Arrow batch the segment lengths, their cumulative offsets and the scatter indices are computed
in numpy, and headers and contents are copied into one preallocated Arrow buffer.

A conversation is cut into chunks of ``CHUNK`` turn numbers, so that one of any length is spread over tasks; only digests over
whole conversations read its chunks in order, one at a time.

Defined cases: null texts and roles are empty; bytes that are not UTF-8 are read as U+FFFD; rows without ``conv_id`` are dropped; a null turn comes first; rows of equal turns
stand in order of role and text; repeated rows are turns of their own; an empty table gives no conversations; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import map_arrow, with_id
from .text_kernels import buffers, valid_text

#: Fixed values of the template.
HEADER, ROLE_END, TURN_END, ESCAPE = b"### ", b"\n", b"</turn>\n", b"\\"
CONTROLS = (b"###", b"</turn>")
#: Turn numbers of one chunk of a conversation.
CHUNK = 64
_UNESCAPE = re.compile(rb"\\(.)", re.S)


def escapes(buf: np.ndarray, off: np.ndarray, newline: bool) -> np.ndarray:
    """Which bytes of a column get a backslash before them."""
    out = buf == ESCAPE[0]
    if newline:
        out |= buf == 10
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(buf))  # bytes to the end of the row
    for control in CONTROLS:
        at = np.flatnonzero((buf == control[0]) & (left >= len(control)))
        for k in range(1, len(control)):
            at = at[buf[at + k] == control[k]]
        out[at] = True
    return out


def scatter(out: np.ndarray, start: np.ndarray, buf: np.ndarray, off: np.ndarray, esc: np.ndarray) -> None:
    """Copy each row of ``buf``, escaped, to its place in ``out``."""
    before = np.concatenate([[0], np.cumsum(esc)])
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.arange(len(buf)) + before[1:] + (start - off[:-1] - before[off[:-1]])[row]
    out[at] = buf
    out[at[esc] - 1] = ESCAPE[0]


def constant(out: np.ndarray, start: np.ndarray, value: bytes) -> None:
    out[start[:, None] + np.arange(len(value))] = np.frombuffer(value, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, list[list[dict]]]:
    """The formatted text of every group of consecutive rows, and the code-point spans of assistant texts in it.

    ``group``: offsets of the groups in the rows.
    """
    (rb, ro), (tb, to) = buffers(roles), buffers(texts)
    re_, te = escapes(rb, ro, True), escapes(tb, to, False)
    r_esc, t_esc = np.concatenate([[0], np.cumsum(re_)]), np.concatenate([[0], np.cumsum(te)])
    r_len, t_len = np.diff(ro) + np.diff(r_esc[ro]), np.diff(to) + np.diff(t_esc[to])
    total = len(HEADER) + r_len + len(ROLE_END) + t_len + len(TURN_END)
    seg = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
    data = pa.allocate_buffer(int(seg[-1]))
    out = np.frombuffer(data, np.uint8) if seg[-1] else np.zeros(0, np.uint8)
    constant(out, seg[:-1], HEADER)
    role_at = seg[:-1] + len(HEADER)
    scatter(out, role_at, rb, ro, re_)
    constant(out, role_at + r_len, ROLE_END)
    text_at = role_at + r_len + len(ROLE_END)
    scatter(out, text_at, tb, to, te)
    constant(out, text_at + t_len, TURN_END)
    offsets = seg[group]
    formatted = pa.LargeStringArray.from_buffers(len(group) - 1, pa.py_buffer(offsets.astype(np.int64)), data)
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    masked = np.array([r == "assistant" for r in roles.to_pylist()], bool)
    of = np.searchsorted(group, np.arange(len(roles)), "right") - 1
    spans: list[list[dict]] = [[] for _ in range(len(group) - 1)]
    for i in np.flatnonzero(masked):
        base = points[offsets[of[i]]]
        spans[of[i]].append({"start": int(points[text_at[i]] - base), "end": int(points[text_at[i] + t_len[i]] - base)})
    return formatted, spans


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, chunk, part, formatted, loss_spans``: the parts of each conversation, in order of (chunk, part)."""
    turns = with_id(rows, "conv_id").select("conv_id", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**62))).cast("long").alias("chunk"), "turn", "role", "text")
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = turns.repartition(int(parts), "conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "role", "text")

    def run(batches):
        last, part = None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            conv, chunk = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.ones(n, bool)
            new[1:] = (conv[1:] != conv[:-1]) | (chunk[1:] != chunk[:-1])
            first = np.flatnonzero(new)
            formatted, spans = assemble(valid_text(b.column(3)), valid_text(b.column(4)), np.append(first, n))
            number = np.zeros(len(first), np.int64)
            if (conv[0], chunk[0]) == last:
                number[0] = part + 1
            last, part = (conv[-1], chunk[-1]), int(number[-1])
            yield pa.RecordBatch.from_arrays([pa.array(conv[first]), pa.array(chunk[first]), pa.array(number), formatted.cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["conv_id", "chunk", "part", "formatted", "loss_spans"])

    return map_arrow(dealt, run, "conv_id long, chunk long, part long, formatted string, loss_spans array<struct<start:long,end:long>>")


def unescape(data: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1", data)


def _ends_here(data: bytes, at: int) -> bool:
    """Whether the byte at ``at`` is not escaped: an even number of backslashes stands before it."""
    k = at
    while k and data[k - 1] == ESCAPE[0]:
        k -= 1
    return (at - k) % 2 == 0


def parse(data: bytes):
    """(role, text) of every turn of a formatted string."""
    at = 0
    while at < len(data):
        if not data.startswith(HEADER, at):
            raise ValueError(f"no turn begins at byte {at}")
        at += len(HEADER)
        end = data.index(ROLE_END, at)
        while not _ends_here(data, end):
            end = data.index(ROLE_END, end + 1)
        role, at = data[at:end], end + len(ROLE_END)
        end = data.index(TURN_END, at)
        while not _ends_here(data, end):
            end = data.index(TURN_END, end + 1)
        yield unescape(role), unescape(data[at:end])
        at = end + len(TURN_END)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation the digests of what can be read from the formatted parts and their loss masks."""
    parts = formatted.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = formatted.repartition(int(parts), "conv_id").sortWithinPartitions("conv_id", "chunk", "part")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now, state, done = None, None, []
        for b in batches:
            for conv, text, spans in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if conv != now:
                    if state:
                        done.append((now, *_end(state)))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text.encode()):
                    state[0] += 1
                    state[1].update(role + b"\n" + said + b"\n")
                for s in spans:
                    loss = unescape(text[s["start"] : s["end"]].encode())
                    state[2] += len(loss.decode())
                    state[3].update(loss)
                state[4] += len(text)
            if len(done) >= 1000:
                yield _table(done, names)
                done = []
        if state:
            done.append((now, *_end(state)))
        if done:
            yield _table(done, names)

    return map_arrow(dealt, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _end(state):
    n, turns, chars, loss, total = state
    return n, turns.hexdigest(), chars, loss.hexdigest(), total


def _table(rows, names):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

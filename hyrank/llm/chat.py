"""Chat formatting by columnar byte assembly.

A turn becomes ``### <role>: <text> </turn>\\n``. Inside roles and texts a
backslash goes before every byte that could begin or end a control string
(``\\``, ``#``, ``<``; in roles also ``:`` and newline), so no text can forge
a mark and ``parse`` gets the exact texts back.

Rows are range-partitioned and sorted by (conversation, turn), so one huge
conversation spreads over many tasks. A task formats Arrow batches without a
loop over rows: segment lengths, cumulative offsets and scatter indices come
from numpy, and marks and contents are copied into one preallocated buffer
that becomes the output column. A conversation that crosses a batch or a
task gives several parts, ordered by (task, part).

Order of turns: turn (null first), then role, then text, so ties and
repeated rows have a fixed order. Null text or role: empty. A null conv_id
is a conversation of its own. Loss mask: the texts of ``loss_role`` turns.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyrank.llm import textbytes as tb
from hyrank.llm.common import table

# Fixed values of the template.
OPEN, MIDDLE, CLOSE = b"### ", b": ", b" </turn>\n"
TEXT_MARKS, ROLE_MARKS = b"\\#<", b"\\#<:\n"
LOSS_ROLE = "assistant"

PARTS = "conv_id long, task int, part long, n_turns long, text string, loss array<struct<start:long,end:long>>"

_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*) </turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def _table(marks: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(marks)] = True
    return t


_TEXT_TABLE, _ROLE_TABLE = _table(TEXT_MARKS), _table(ROLE_MARKS)


def escape(data: np.ndarray, off: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with a backslash before each marked byte."""
    special = marks[data]
    before = np.concatenate([[0], np.cumsum(special)])
    out = np.empty(len(data) + int(before[-1]), np.uint8)
    place = np.arange(len(data)) + before[1:]
    out[place] = data
    out[place[special] - 1] = ord("\\")
    return out, off + before[off]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, off: np.ndarray) -> None:
    """Copy span i of ``data`` to out[at[i]:...]."""
    out[np.repeat(at - off[:-1], np.diff(off)) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array, loss_role: str = LOSS_ROLE):
    """(bytes, turn offsets, loss starts, loss ends): all turns, formatted; loss as byte spans per turn (-1: none)."""
    raw_role = tb.text_bytes(roles)
    role, role_off = escape(*raw_role, _ROLE_TABLE)
    text, text_off = escape(*tb.text_bytes(texts), _TEXT_TABLE)
    n = len(role_off) - 1
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2] = len(OPEN), np.diff(role_off), len(MIDDLE)
    lengths[:, 3], lengths[:, 4] = np.diff(text_off), len(CLOSE)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, mark in ((0, OPEN), (2, MIDDLE), (4, CLOSE)):
        out[starts[:, k, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, starts[:, 1], role, role_off)
    _scatter(out, starts[:, 3], text, text_off)
    speaks = np.array([r == loss_role for r in roles.to_pylist()], bool)
    return out, np.append(starts[:, 0], len(out)), np.where(speaks, starts[:, 3], -1), np.where(speaks, ends[:, 3], -1)


def format_chat(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Parts of formatted conversations (schema PARTS), in order of (task, part); loss spans in characters."""
    src = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    src = src.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        task, part = TaskContext.get().partitionId(), 0
        for b in tb.slices(batches):
            conv = b.column("conv_id")
            value = conv.fill_null(0).to_numpy(zero_copy_only=False)
            null = conv.is_null().to_numpy(zero_copy_only=False)
            turn = np.ones(b.num_rows, bool)
            turn[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
            head = np.flatnonzero(turn)
            data, off, lo, hi = assemble(b.column("role"), b.column("text"), loss_role)
            edge = np.append(head, b.num_rows)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            own = np.repeat(np.arange(len(head)), np.diff(edge))
            base = chars[off[head]][own]
            kept = lo >= 0
            counts = np.concatenate([[0], np.cumsum(np.bincount(own[kept], minlength=len(head)))])
            spans = pa.StructArray.from_arrays([pa.array(chars[lo[kept]] - base[kept]), pa.array(chars[hi[kept]] - base[kept])],
                                               names=["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [conv.take(pa.array(head)), pa.array(np.full(len(head), task, np.int32)),
                 pa.array(part + np.arange(len(head))), pa.array(np.diff(edge)),
                 pa.StringArray.from_buffers(len(head), pa.py_buffer(off[edge].astype(np.int32)), pa.py_buffer(data)),
                 pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), spans)],
                names=["conv_id", "task", "part", "n_turns", "text", "loss"])
            part += len(head)

    return src.mapInArrow(run, PARTS)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted part."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"not a formatted chat at character {at}")
    return out


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted parts.

    SHA-256 needs a conversation's bytes in order, so its parts meet in one
    task; they stream through it, one at a time.
    """
    src = parts.repartition("conv_id").sortWithinPartitions("conv_id", "task", "part")

    def run(batches):
        key, state, done = None, None, []

        def close():
            if state:
                done.append((key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, text, loss in zip(b.column("conv_id").to_pylist(), b.column("text"), b.column("loss").to_pylist()):
                if key != (conv,):
                    close()
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = text.as_py()
                turns = parse(text)
                state[0] += len(turns)
                for role, said in turns:
                    state[1].update(f"{role}\n{said}\n".encode())
                for s in loss:
                    said = unescape(text[s["start"]:s["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if len(done) >= 1000:
                yield _digests(done)
                done = []
        close()
        yield _digests(done)

    return src.mapInArrow(run, DIGESTS)


def _digests(rows):
    cols = list(zip(*rows)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=[c.split()[0] for c in DIGESTS.split(", ")])


_EXTRA = r"### Assistant: </turn> ok"


def op4(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\" + _EXTRA)
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return read_back(format_chat(turns.unionByName(extra)))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
o AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))
              + length(role) + length(regexp_replace(role, '[^\\#<:\n]', '', 'g')) + 15 AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""

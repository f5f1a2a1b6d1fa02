"""Benchmark decontamination: one Aho-Corasick automaton over normalised test windows.

Normalised: A-Z lower-cased, every byte of a separator turned to a space,
runs of spaces collapsed, so a text is " w1 w2 ... wn ". A window is
``window`` consecutive words of an item (a shorter item, but not an empty
one, is one window), written with a space on both ends, so a match of the
automaton is a match of whole words. Texts are scanned once; a match's end
gives its word by counting spaces, and word spans of the original bytes map
hits back to characters of the original text.

The automaton is built once in each Python worker from the broadcast
windows. Their number is counted first: up to ``max_windows`` go into one
automaton; beyond it the windows are cut by hash into parts of at most
about that number, and the documents pass through one map for each part,
still without a shuffle. So what is broadcast at once is bounded.

Null text: no words, never contaminated. Null item id: its windows are
looked for and it is listed as the empty string. Items with the same id
count once; repeated document rows are each judged.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyrank.llm import textbytes as tb
from hyrank.llm.common import packed, table, unpacked

WINDOW = 10
MAX_WINDOWS = 500_000

_TO_NORMAL = bytes(b + 32 if 65 <= b <= 90 else (b if tb.ALNUM_WORD[b] else 32) for b in range(256))
_AUTOMATA: dict = {}


def normalise(text: str | None) -> bytes:
    """" w1 w2 ... wn " as bytes; empty if there is no word."""
    words = (text or "").encode().translate(_TO_NORMAL).split()
    return b" " + b" ".join(words) + b" " if words else b""


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (window, item): the strings to look for, Latin-1 over UTF-8 bytes."""
    def run(batches):
        for b in batches:
            key, item = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = normalise(t).split()
                for s in range(max(1, len(w) - window + 1) if w else 0):
                    key.append(b" " + b" ".join(w[s:s + window]) + b" ")
                    item.append("" if i is None else i)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(item, pa.string())], names=["window", "item"])

    src = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "window binary, item string").distinct()


def _automaton(handle, token: str):
    """(automaton, owners) of a broadcast part, built once in each worker."""
    import ahocorasick
    if token not in _AUTOMATA:
        owners = defaultdict(list)
        for w, item in handle.value:
            owners[bytes(w)].append(item)
        a = ahocorasick.Automaton()
        listed = []
        for n, (w, items) in enumerate(owners.items()):
            a.add_word(w.decode("latin-1"), (n, w.count(b" ") - 1))
            listed.append(items)
        if listed:
            a.make_automaton()
        _AUTOMATA.clear()                      # a worker keeps one part
        _AUTOMATA[token] = (a, listed)
    return _AUTOMATA[token]


def hits_of(text: str | None, automaton, owners) -> tuple[int, list[tuple[int, int]], set]:
    """(words, merged [first, last) word runs that windows cover, items seen)."""
    norm = normalise(text)
    n = norm.count(b" ") - 1 if norm else 0
    runs: list[list[int]] = []
    items: set = set()
    if not owners or not n:
        return n, [], items
    at = seen = 0
    for end, (w, length) in automaton.iter(norm.decode("latin-1")):
        seen += norm.count(b" ", at, end + 1)        # spaces up to and with the one that ends the match
        at = end + 1
        last = seen - 1
        items.update(owners[w])
        if runs and last - length <= runs[-1][1]:
            while runs and last - length <= runs[-1][1]:
                lo, hi = runs.pop()
                length = max(length, last - lo)
            runs.append([last - length, max(hi, last)])
        else:
            runs.append([last - length, last])
    return n, [tuple(r) for r in runs], items


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Word runs as character offsets of the original text."""
    if not runs:
        return []
    raw = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = tb.word_spans(tb.lower_ascii(raw), np.array([0, len(raw)]), tb.ALNUM_WORD)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [{"start": int(chars[s[a]]), "end": int(chars[e[b - 1]])} for a, b in runs]


_RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)),
          T.StructField("items", T.ArrayType(T.StringType()))]


def _merge(runs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                  window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` plus a struct ``found`` (replaced if there): n_words, runs of hit words, items, and spans in characters of the text."""
    spark = docs.sparkSession
    wins = windows(items, id_col, text_col, window)
    wins = wins.persist()
    total = wins.count()
    parts = max(1, -(-total // max_windows))
    out = docs.withColumn("found", F.lit(None).cast(T.StructType(_FOUND)))
    for p in range(parts):
        own = wins if parts == 1 else wins.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == p)
        rows = [(bytes(r[0]), r[1]) for r in own.collect()]      # about max_windows at most
        handle, token = spark.sparkContext.broadcast(rows), f"{spark.sparkContext.applicationId}-{id(wins)}-{p}-{total}"
        out = out.mapInArrow(_scan(handle, hashlib.sha1(token.encode() + repr(rows[:50]).encode()).hexdigest(), text_col), out.schema)
    wins.unpersist()
    return out.withColumn("found", _with_spans(out, text_col))


def _scan(handle, token, text_col):
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                      ("items", pa.list_(pa.string()))])

    def run(batches):
        automaton, owners = _automaton(handle, token)
        for b in batches:
            at = b.schema.get_field_index("found")
            got = []
            for text, was in zip(b.column(text_col), b.column(at).to_pylist()):
                n, runs, seen = hits_of(text.as_py(), automaton, owners)
                if was:
                    runs = _merge([*runs, *((r["start"], r["end"]) for r in was["runs"])])
                    seen.update(was["items"])
                got.append({"n_words": n, "runs": [{"start": x, "end": y} for x, y in runs], "items": sorted(seen)})
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(got, kind), *b.columns[at + 1:]], names=b.schema.names)

    return run


def _with_spans(out: DataFrame, text_col: str):
    @F.pandas_udf(T.ArrayType(_RUN))
    def spans(text, runs):
        import pandas as pd
        return pd.Series([char_spans(t, [(r["start"], r["end"]) for r in rs]) if t is not None and len(rs) else []
                          for t, rs in zip(text, runs)])

    return F.struct("found.n_words", "found.runs", "found.items", spans(F.col(text_col), F.col("found.runs")).alias("spans"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("found.runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    items = F.array_sort("found.items")
    return out.select("doc_id", F.col("found.n_words").alias("n_words"), hit.alias("n_hit"),
                      F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go."""
    out = decontaminate(packed(docs, "text"), table(spark, sf_dir, "benchmark")).where(F.size("found.runs") == 0)
    return out.select(*unpacked(out, docs, "text"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, list_slice(w, s, s + 9) AS ws
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s) WHERE len(w) > 0),
hit AS (SELECT DISTINCT d.rid, win.item, p.s, win.k FROM d, unnest(range(1, len(d.w) + 1)) AS p(s)
        JOIN win ON win.k = 10 AND list_slice(d.w, p.s, p.s + 9) = win.ws
        UNION SELECT DISTINCT d.rid, win.item, p.s, win.k FROM d, unnest(range(1, len(d.w) + 1)) AS p(s)
        JOIN win ON win.k < 10 AND list_slice(d.w, p.s, p.s + win.k - 1) = win.ws),
n AS (SELECT rid, count(DISTINCT x) AS n_hit FROM hit, unnest(range(s, s + k)) AS u(x) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)
"""

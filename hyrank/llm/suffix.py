"""Removal of repeated byte strings with a two-stage suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts
somewhere else in the corpus. Suffixes are sorted where equal strings can
meet, not all in one array:

1. Routing. The anchor of a start is the place of the smallest hash of a
   ``GRAM``-byte window inside its LENGTH bytes, so equal strings have equal anchors at equal
   distances. Neighbouring starts with one anchor whose distance lies in one
   block of ``blocks[0]`` values form a segment; their strings share a core
   of LENGTH - block + 1 bytes, whose hash is the segment's key. Equal strings
   thus always lie in segments of one key. Only keys that occur twice go on.
2. Equal segments (same key, bytes and distance) are one, with a count;
   grouping combines map-side, so a passage in a third of all documents is one row.
3. A key with more than ``HOT`` different segments (the edges of a common passage) is
   cut into smaller blocks with longer cores, at the end blocks of two
   starts, whose members can differ in two bytes only. So no key is unbounded.
4. Tasks take runs of keys of about ``BATCH`` bytes and sort the suffixes at
   their starts in two stages (Itoh-Tanaka / Ko-Aluru): those smaller than their
   successor are sorted directly; the others are induced by one scan over the
   buckets of the first byte. Adjacent common prefixes of LENGTH bytes mark
   repeated strings; suffixes of a segment that occurs twice have an equal copy beside them.
5. Marked starts return to all places of their segment and are merged by document.

Null text: empty. An empty table gives an empty result. Texts shorter than LENGTH keep all bytes. Equal document
rows are separate places (so both lose what they share). Long texts are
hashed in pieces that overlap by LENGTH - 1 bytes, which changes nothing in the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyrank.llm import textbytes as tb
from hyrank.llm.common import cut, few, packed, table, unpacked
from hyrank.session import scratch_path

LENGTH = 400
GRAM = 32
BLOCKS = (128, 16, 2)
HOT = 4096
BATCH = 1 << 20
PIECE = 1 << 20

SEGMENT = "_key long, key long, seg long, start long, n long, far long"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (width - span)], x[width - span:])


def anchors(data: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of the anchor of every start of a full string in ``data``."""
    _, inv = tb.powers(len(h))
    g = tb.mix64((h[GRAM:] - h[:-GRAM]) * inv[:len(h) - GRAM]) >> np.uint64(32)
    packed = (g << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    return (_sliding_min(packed, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def cut_segments(h: np.ndarray, starts: np.ndarray, anchor: np.ndarray, block: int, salt: np.ndarray | None = None):
    """(key, seg, start, n, far): runs of ``starts`` with one anchor and one distance block.

    ``far`` is the distance of the first start to the anchor.
    """
    if not len(starts):
        return [np.zeros(0, np.int64)] * 5
    part = (anchor - starts) // block
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
    if salt is not None:
        new[1:] |= salt[1:] != salt[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(starts)))
    s, p, b = starts[at], anchor[at], part[at]
    core = p - b * block
    with np.errstate(over="ignore"):
        key = tb.span_hashes(h, core, core - block + 1 + LENGTH) + (b * 2 + 1).astype(np.uint64)
        if salt is not None:
            key = key ^ tb.mix64(salt[at].view(np.uint64))
        seg = tb.span_hashes(h, s, s + n - 1 + LENGTH) + (p - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [tb.mix64(key).view(np.int64), tb.mix64(seg).view(np.int64), s, n, p - s]


def _rows(key_of, cols):
    return pa.RecordBatch.from_arrays([pa.array(key_of), *(pa.array(c) for c in cols)],
                                      names=["_key", "key", "seg", "start", "n", "far"])


def segments(docs: DataFrame, block: int) -> DataFrame:
    """All segments of (_key, text) rows."""
    def run(batches):
        for b in tb.slices(batches, limit=PIECE):
            data, off = tb.text_bytes(b.column("text"))
            doc = b.column("_key").to_numpy(zero_copy_only=False)
            for lo in range(0, max(1, len(data)), PIECE):
                piece = data[lo:lo + PIECE + LENGTH - 1]
                if len(piece) < LENGTH:
                    continue
                with np.errstate(over="ignore"):
                    h = tb.prefix_hash(piece)
                    anchor = anchors(piece, h)
                at = np.arange(len(anchor))
                own = np.searchsorted(off, at + lo, "right") - 1
                inside = at + lo + LENGTH <= off[own + 1]
                key, seg, s, n, far = cut_segments(h, at[inside], anchor[inside], block)
                if len(s):
                    d = np.searchsorted(off, s + lo, "right") - 1
                    yield _rows(doc[d], (key, seg, s + lo - off[d], n, far))

    return docs.select("_key", "text").mapInArrow(run, SEGMENT)


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Each wanted document once, with its places in an array ``at``."""
    per = cut(places.groupBy("_key").agg(F.collect_list(F.struct(*[c for c in places.columns if c != "_key"])).alias("at")))
    return few(docs, per.select("_key"), "_key").dropDuplicates(["_key"]).join(per, "_key")


def recut(docs: DataFrame, hot: DataFrame, block: int) -> DataFrame:
    """The segments ``hot`` cut again by a smaller block; keys carry the old key along."""
    def run(batches):
        for b in tb.slices(batches):
            for doc, text, at in zip(b.column("_key").to_pylist(), b.column("text"), b.column("at").to_pylist()):
                raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                for p in at:
                    lo, n = p["start"], p["n"]
                    with np.errstate(over="ignore"):
                        h = tb.prefix_hash(raw[lo:lo + n - 1 + LENGTH])
                    starts = np.arange(n)
                    key, seg, s, m, far = cut_segments(h, starts, np.full(n, p["far"]), block, np.full(n, p["key"]))
                    yield _rows(np.full(len(s), doc), (key, seg, s + lo, m, far))

    return with_places(docs, hot.select("_key", "key", "start", "n", "far")).select("_key", "text", "at").mapInArrow(run, SEGMENT)


def _twice(segs: DataFrame) -> DataFrame:
    """Segments whose key occurs at least twice.

    Keys are counted map-side; only the keys that recur meet the segments, where those are if they are few.
    """
    keys = cut(segs.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"))
    return few(segs, keys, "key")


def candidates(docs: DataFrame, blocks=BLOCKS, hot_limit: int = HOT) -> DataFrame:
    """Segments that can hold repeated strings, no key with an unbounded number of different ones."""
    done, now = None, cut(_twice(written(segments(docs, blocks[0]), "suffix-segments")))
    for block in blocks[1:]:
        hot = cut(now.select("key", "seg").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("c"))
                  .where(F.col("c") > hot_limit).select("key"))
        if hot.isEmpty():
            break
        cold = few(now, hot, "key", inside=False)
        done = cold if done is None else done.unionByName(cold)
        now = cut(_twice(cut(recut(docs, few(now, hot, "key"), block))))
    return now if done is None else done.unionByName(now)


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def suffix_order(text: np.ndarray, seg_off: np.ndarray, n_starts: np.ndarray) -> np.ndarray:
    """Starts (the first ``n_starts`` places of each segment) in suffix order, by their first LENGTH bytes.

    Stage one sorts the suffixes smaller than their successor. Stage two
    scans the buckets of the first byte upward and puts the predecessor of each
    suffix, if larger than its successor, next into its own bucket.
    """
    size = len(text)
    step = np.zeros(size, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    last = seg_off[1:] - 1
    step[last] = -1                                    # a segment's end is smaller than any byte
    at = np.where(step != 0, np.arange(size), size)
    small = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
    # the places needed: starts, and after the last one all up to the next directly sorted place
    nxt = np.where(small, np.arange(size), size)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    final = seg_off[:-1] + n_starts - 1
    stop = np.minimum(nxt[final], last)
    mark = np.zeros(size + 1, np.int32)
    np.add.at(mark, seg_off[:-1], 1)
    np.add.at(mark, stop + 1, -1)
    used = np.cumsum(mark[:-1]) > 0
    seeds = np.flatnonzero(small & used)
    raw = text.tobytes()
    seg_end = seg_off[np.searchsorted(seg_off, seeds, "right")]
    slices = [raw[a:b] for a, b in zip(seeds.tolist(), np.minimum(seeds + LENGTH, seg_end).tolist())]
    seeds = seeds[np.array(sorted(range(len(slices)), key=slices.__getitem__), np.int64)] if len(seeds) else seeds
    heads = np.searchsorted(text[seeds], np.arange(257))

    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger = ~small & used
    first = np.zeros(size, bool)
    first[seg_off[:-1]] = True

    def induce(places: np.ndarray) -> None:
        before = places[~first[places]] - 1
        put(before[larger[before]])

    def put(places: np.ndarray) -> None:
        if not len(places):
            return
        c = text[places]
        order = np.argsort(c, kind="stable")
        places, c = places[order], c[order]
        cuts = np.flatnonzero(np.diff(c)) + 1
        for chunk in np.split(places, cuts):
            induced[text[chunk[0]]].append(chunk)

    put(last[larger[last]])                            # bucket of the ends, before all bytes
    out = []
    for c in range(256):
        n = 0
        while n < len(induced[c]):                     # grows while it is read
            induce(induced[c][n])
            n += 1
        direct = seeds[heads[c]:heads[c + 1]]
        induce(direct)
        out += [*induced[c], direct]
    order = np.concatenate(out) if out else seeds
    is_start = np.zeros(size + 1, np.int32)
    np.add.at(is_start, seg_off[:-1], 1)
    np.add.at(is_start, final + 1, -1)
    return order[np.cumsum(is_start[:-1])[order] > 0]


def equal_neighbours(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For starts in suffix order: does one share a prefix of LENGTH bytes with the next?"""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:len(text)]
    words = np.ascontiguousarray(words).view("<u8").ravel()
    alive = np.arange(max(0, len(order) - 1))
    for k in range(0, LENGTH, 8):
        if not len(alive):
            break
        k = min(k, LENGTH - 8)
        alive = alive[words[order[alive] + k] == words[order[alive + 1] + k]]
    same = np.zeros(max(0, len(order) - 1), bool)
    same[alive] = True
    return same


def repeated_starts(parts: list[bytes], n_starts: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """For segments of one batch: which of their starts begin a string that also starts elsewhere."""
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    text = np.frombuffer(b"".join(parts), np.uint8)
    order = suffix_order(text, off, n_starts)
    same = equal_neighbours(text, order)
    hit = np.zeros(len(text), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [np.arange(n) if t > 1 else np.flatnonzero(hit[o:o + n]) for o, n, t in zip(off[:-1], n_starts, times)]


RUNS = "key long, seg long, runs array<struct<lo:long,hi:long>>"


def repeated_runs(distinct: DataFrame) -> DataFrame:
    """(key, seg, runs of starts [lo, hi)) from (key, seg, n, times, piece)."""
    src = distinct.repartition("key").sortWithinPartitions("key", "seg")

    def run(batches):
        held, size = [], 0

        def flush():
            got = repeated_starts([h[4] for h in held], np.array([h[2] for h in held]), np.array([h[3] for h in held]))
            key, seg, off, lo, hi = [], [], [0], [], []
            for h, at in zip(held, got):
                if len(at):
                    edge = np.flatnonzero(np.diff(at, prepend=-2, append=1 << 60) != 1)
                    lo.append(at[edge[:-1]])
                    hi.append(at[edge[1:] - 1] + 1)
                    key.append(h[0])
                    seg.append(h[1])
                    off.append(off[-1] + len(edge) - 1)
            if key:
                runs = pa.StructArray.from_arrays([pa.array(np.concatenate(lo)), pa.array(np.concatenate(hi))], names=["lo", "hi"])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(seg), pa.ListArray.from_arrays(
                    pa.array(off, pa.int32()), runs)], names=["key", "seg", "runs"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "seg", "n", "times", "piece"))):
                if size >= BATCH and row[0] != held[-1][0]:
                    yield from flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from flush()

    return src.mapInArrow(run, RUNS)


def pieces(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of segments, read at their first places."""
    def run(batches):
        for b in tb.slices(batches):
            out = []
            for text, at in zip(b.column("text"), b.column("at").to_pylist()):
                raw = (text.as_py() or "").encode()
                out += [(p["key"], p["seg"], p["n"], p["times"], raw[p["start"]:p["start"] + p["n"] - 1 + LENGTH]) for p in at]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)],
                                             names=["key", "seg", "n", "times", "piece"])

    return with_places(docs, wanted).select("text", "at").mapInArrow(run, "key long, seg long, n long, times long, piece binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(_key, runs): byte runs [lo, hi) to remove, unmerged, for rows (_key, text)."""
    found = candidates(docs)
    distinct = found.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("_key", "start", "n")).alias("p"))
    wanted = distinct.select("p._key", "key", "seg", "times", "p.start", "p.n")
    hits = repeated_runs(pieces(docs, wanted))
    runs = F.transform("runs", lambda r: F.struct((F.col("start") + r["lo"]).alias("lo"),
                                                  (F.col("start") + r["hi"] - 1 + LENGTH).alias("hi")))
    placed = found.join(hits, ["key", "seg"]).select("_key", F.explode(runs).alias("run")).distinct()
    return placed.groupBy("_key").agg(F.sort_array(F.collect_list("run")).alias("runs"))


EXTRA = "removed array<struct<lo:long,hi:long>>, n_bytes long, kept binary"


def dedup_substrings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``removed`` (merged byte runs), ``n_bytes`` and the kept bytes' ``kept`` (binary).

    The caller's columns of these three names are replaced; any others pass through, whatever their names.
    """
    docs = docs.drop("removed", "n_bytes", "kept")
    ids = ["doc_id"] if "doc_id" in docs.columns else []
    inner = packed(docs, *ids, text_col).withColumnRenamed(text_col, "text")
    keyed = inner.withColumn("_key", F.xxhash64(*ids, F.coalesce("text", F.lit(""))))
    spans = cut(repeated_spans(keyed.select("_key", "text")))
    names = spans.select("_key")
    both = few(keyed, names, "_key").join(spans, "_key").unionByName(
        few(keyed, names, "_key", inside=False).withColumn("runs", F.lit(None).cast(spans.schema["runs"].dataType))).drop("_key")
    schema = T.StructType([*inner.schema.fields, *T._parse_datatype_string(EXTRA).fields])
    names, own = schema.names, inner.columns

    def run(batches):
        for b in tb.slices(batches):
            removed, size, kept = [], [], []
            for text, runs in zip(b.column("text"), b.column("runs").to_pylist()):
                raw = (text.as_py() or "").encode()
                merged: list[list[int]] = []
                for r in runs or ():
                    if merged and r["lo"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r["hi"])
                    else:
                        merged.append([r["lo"], r["hi"]])
                edge = [0, *(x for m in merged for x in m), len(raw)]
                removed.append([{"lo": lo, "hi": hi} for lo, hi in merged])
                size.append(len(raw))
                kept.append(b"".join(raw[a:z] for a, z in zip(edge[::2], edge[1::2])))
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in own), pa.array(removed, kind), pa.array(size, pa.int64()), pa.array(kept, pa.binary())],
                names=names)

    out = both.mapInArrow(run, schema).withColumnRenamed("text", text_col)
    return out.select(*unpacked(out, docs, *ids, text_col), "removed", "n_bytes", "kept")


def op7(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["hi"] - r["lo"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Merged runs to remove, by counting every LENGTH-byte string (small inputs)."""
    from collections import Counter
    seen = Counter(t[i:i + LENGTH] for t in texts for i in range(len(t) - LENGTH + 1))
    out = []
    for t in texts:
        runs: list[list[int]] = []
        for i in range(len(t) - LENGTH + 1):
            if seen[t[i:i + LENGTH]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + LENGTH
                else:
                    runs.append([i, i + LENGTH])
        out.append([tuple(r) for r in runs])
    return out

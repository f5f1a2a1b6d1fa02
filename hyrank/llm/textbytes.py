"""Vectorised word work on the bytes of an Arrow string column.

Everything runs on one batch of whole texts at a time. ``slices`` cuts an
Arrow batch into runs of rows of a few MB, so memory follows the largest
single text, never the size of a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_class(separators: list[tuple[int, int]]) -> np.ndarray:
    """256 booleans: True for the bytes outside every (first, last) range."""
    word = np.ones(256, bool)
    for lo, hi in separators:
        word[lo:hi + 1] = False
    return word


#: Separators of the two word rules (bytes of a lower-cased UTF-8 text).
ALNUM_WORD = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
NONSPACE_WORD = byte_class([(0x20, 0x20), (0x09, 0x0D)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    n = len(col)
    offsets = np.frombuffer(off, np.int64, n + 1, col.offset * 8) if off is not None and n else np.zeros(n + 1, np.int64)
    if data is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def slices(batches, text_col: str = "text", limit: int = SLICE_BYTES):
    """Cut record batches into runs of rows of at most ``limit`` text bytes (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text_col)), 0).to_numpy(zero_copy_only=False)
        end = np.cumsum(size, dtype=np.int64)
        lo = 0
        while lo < b.num_rows:
            base = end[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(end, base + limit, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """(starts, ends, first): byte spans of all words; text i owns words first[i]:first[i+1]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | edge[:-1]))
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    ends = np.flatnonzero(w & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(h: np.ndarray) -> np.ndarray:
    """Final avalanche of a 64-bit hash (public murmur constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse (kept per worker, a few MB)."""
    if len(_POW[0]) < n:
        m = max(n, SLICE_BYTES + 1)
        if m > 8 * SLICE_BYTES:      # one huge text: do not keep its tables
            return _powers(_P, m), _powers(_P_INV, m)
        _POW[0], _POW[1] = _powers(_P, m), _powers(_P_INV, m)
    return _POW[0][:n], _POW[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] = sum (byte+1) * base^i over i in [s, e), modulo 2^64."""
    p, _ = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:len(data)], out=h[1:])
    return h


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, independent of its place."""
    _, inv = powers(len(h))
    return mix64((h[ends] - h[starts]) * inv[starts])


def window_hashes(words: np.ndarray, first: np.ndarray, k: int):
    """(hashes, counts): hash of each run of k word hashes inside a text, in order.

    A text of fewer, but not none, gives one hash of its whole sequence.
    """
    n = np.diff(first)
    m = len(words)
    mul = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    acc = np.zeros(max(0, m - k + 1), np.uint64)
    for j in range(k):
        acc += words[j:m - k + 1 + j] * mul[j] if m >= k else acc
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_first = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(out_first[-1], np.uint64)
    full = n >= k
    if full.any():
        src = np.repeat(first[:-1][full] - np.concatenate([[0], np.cumsum(counts[full])[:-1]]), counts[full]) \
            + np.arange(counts[full].sum())
        dst = np.repeat(out_first[:-1][full] - np.concatenate([[0], np.cumsum(counts[full])[:-1]]), counts[full]) \
            + np.arange(counts[full].sum())
        out[dst] = mix64(acc[src])
    for i in np.flatnonzero((n > 0) & ~full):
        x = words[first[i]:first[i + 1]]
        out[out_first[i]] = mix64((x * np.array(mul[:len(x)], np.uint64)).sum(dtype=np.uint64) + np.uint64(len(x)))
    return out, counts

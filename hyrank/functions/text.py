"""Text functions: tokeniser, BM25 weight expression, hashing embedder.

Tokenisation runs JVM-side (``regexp_extract_all`` on the lower-cased
text), so the same token arrays feed BM25, the dense embedder and the
late-interaction embedder.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. They must equal the external defaults the searched system
# relies on (BM25 sparse model and its IDF modifier); do not tune them.
#   BM25: k1 = 1.2, b = 0.75, average document length = 256.0 (a constant)
#   IDF:  ln((N - n + 0.5) / (n + 0.5) + 1)
#   RRF:  sum over branches of 1 / (2 + rank), rank counted from 0
# ---------------------------------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
BM25_AVGDL = 256.0
RRF_C = 2.0
RRF_RANK_BASE = 0

TOKEN_PATTERN = r"[\p{L}\p{N}_]+"


def tokens(text: Column | str) -> Column:
    """Lower-cased word tokens of the whole text (array<string>)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def bm25_weight(tf: Column, dl: Column, k1: float = BM25_K1, b: float = BM25_B,
                avgdl: float = BM25_AVGDL) -> Column:
    """tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), in double."""
    tf = tf.cast("double")
    dl = dl.cast("double")
    return tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / F.lit(avgdl)))


def idf(n_docs: Column, doc_freq: Column) -> Column:
    n = n_docs.cast("double")
    df = doc_freq.cast("double")
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


# ---------------------------------------------------------------------------
# Hashing embedder: the offline default behind the pluggable embedders.
# Component i of token t is (byte (i mod 16) of md5("<i div 16>:" + t) - 127.5)
# / 127.5, so any dimension is available and SQL engines can reproduce it.
# ---------------------------------------------------------------------------

def _token_bytes(token: str, dim: int) -> bytes:
    """The md5 blocks of a token: its first ``dim`` bytes are its components."""
    return b"".join([hashlib.md5(f"{j}:{token}".encode("utf-8")).digest() for j in range((dim + 15) // 16)])


def _token_vector(token: str, dim: int) -> np.ndarray:
    return (np.frombuffer(_token_bytes(token, dim), dtype=np.uint8)[:dim].astype(np.float64) - 127.5) / 127.5


class HashEmbedder:
    """Deterministic token -> vector map with a bounded per-worker cache.

    The cache holds a token's bytes, an eighth of its vector; the vectors of a call are made from them at once.
    """

    def __init__(self, dim: int, cache_size: int = 200_000):
        self.dim = dim
        self.cache_size = cache_size
        self._cache: dict[str, bytes] = {}

    def vectors(self, toks) -> np.ndarray:
        cache, raw = self._cache, []
        for t in toks:
            v = cache.get(t)
            if v is None:
                v = _token_bytes(t, self.dim)
                if len(cache) >= self.cache_size:
                    cache.clear()
                cache[t] = v
            raw.append(v)
        width = 16 * ((self.dim + 15) // 16)
        out = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), width)[:, :self.dim].astype(np.float64)
        out -= 127.5
        out /= 127.5
        return out


def hash_component_sql(token_sql: str, i: int) -> str:
    """DuckDB/ANSI-ish expression for component i of the hashing embedder."""
    j, p = divmod(i, 16)
    return (f"((('0x' || substr(md5('{j}:' || {token_sql}), {2 * p + 1}, 2))::INTEGER - 127.5) / 127.5)")

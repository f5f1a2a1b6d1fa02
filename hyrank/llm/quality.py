"""Quality classifier: hashed word n-grams, logistic regression by FTRL, sparse scoring.

Training takes a bounded sample of labelled rows (``sample_rows``, lowest
hash of the id first), spread over ``shards`` tasks; each task runs
follow-the-regularised-leader over its rows and the shard models are
averaged. The model is one float per hash bucket (2^18, 1 MB), so its
broadcast has a fixed size whatever the corpus. Scoring is one map over the
documents: no shuffle, whole texts, batches of a few MB.

A token is a run of letters and digits (case kept, every digit reads 0), or
a run of other visible bytes; features are hashed runs of one and two tokens
and of one to three token forms (capital, small, digit), valued by the root
of their count and scaled to unit length. Only the text is read: never lang, source, id
or labels of other rows.

Null text: empty. An empty text has the bias feature only and still gets a
score. Without labels every score is 0.5. A document id labelled twice
counts once per row; rows with a null label are not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyrank.llm import textbytes as tb
from hyrank.llm.common import packed, table, unpacked

BITS = 18
SAMPLE_ROWS = 12_000
SHARDS = 4
THRESHOLD = 0.3
HELD_OUT_MOD = 5

_SPACE, _WORD, _PUNCT = 0, 1, 2
_CLASS = np.full(256, _PUNCT, np.uint8)
for _lo, _hi, _c in ((0x00, 0x20, _SPACE), (0x7F, 0x7F, _SPACE), (0x30, 0x39, _WORD), (0x41, 0x5A, _WORD),
                     (0x61, 0x7A, _WORD), (0x80, 0xFF, _WORD)):
    _CLASS[_lo:_hi + 1] = _c
_DIGIT = np.arange(256, dtype=np.uint8)
_DIGIT[0x30:0x3A] = 0x30
_FORM = np.full(256, 4, np.uint64)       # upper, lower, digit or other letter
_FORM[0x41:0x5B], _FORM[0x61:0x7B], _FORM[0x30:0x3A] = 1, 2, 3


def features(col: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket ids, values, first): text i owns positions first[i]:first[i+1]; bucket 0 is the bias.

    A value is the root of the feature's count; the text's features have unit length together.
    """
    data, off = tb.text_bytes(col)
    n = len(off) - 1
    bias = np.arange(n, dtype=np.int64) << bits
    mask = np.uint64((1 << bits) - 1)
    keys = []
    if len(data):
        kind = _CLASS[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        turn = edge[:-1].copy()
        turn[1:] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(turn)
        end = np.append(at[1:], len(data))
        seen = kind[at] != _SPACE
        at, end = at[seen], end[seen]
        doc = np.searchsorted(off, at, "right") - 1
        word = tb.span_hashes(tb.prefix_hash(_DIGIT[data]), at, end)
        # a word's form: its first byte class and the class of the rest; other runs stand for themselves
        rest = np.minimum(at + 1, len(data) - 1)
        form = np.where(kind[at] == _WORD, (_FORM[data[at]] * np.uint64(8) + _FORM[data[rest]] * (end - at > 1)), word)
        form = tb.mix64(form + np.uint64(0x51))
        with np.errstate(over="ignore"):
            for series, longest in ((word, 2), (form, 3)):
                h = series
                for k in range(1, longest + 1):
                    if k > 1:
                        h = tb.mix64(h[:-1] * np.uint64(0x9FB21C651E98DF25) + series[k - 1:])
                    own = doc[:len(h)]
                    same = own == doc[k - 1:]
                    keys.append((own[same] << bits) | np.maximum(h[same] & mask, np.uint64(1)).astype(np.int64))
    got, count = np.unique(np.concatenate([bias, *keys]), return_counts=True)
    first = np.searchsorted(got, np.arange(n + 1, dtype=np.int64) << bits)
    value = np.sqrt(count / np.repeat(np.add.reduceat(count, first[:-1]) if n else count, np.diff(first)))
    value[first[:-1]] = 1.0
    return got & ((1 << bits) - 1), value, first


def ftrl(rows, bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """Weights after FTRL-proximal updates over (bucket ids, values, label) rows."""
    z = np.zeros(1 << bits)
    n = np.zeros(1 << bits)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for ids, x, y in rows:
            w = weights(ids)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            root = np.sqrt(n[ids])
            n[ids] += g * g
            z[ids] += g - (np.sqrt(n[ids]) - root) / alpha * w
    return weights(np.arange(1 << bits))


def train(rows: DataFrame, text_col: str = "text", label_col: str = "label", bits: int = BITS, shards: int = SHARDS,
          alpha: float = 12.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.0, epochs: int = 6) -> np.ndarray:
    """Average of ``shards`` FTRL models over (id, text, label) rows, which must already be a bounded sample."""
    def fit(batches):
        seen = []
        for b in tb.slices(batches):
            ids, value, first = features(b.column("text"), bits)
            label = b.column("label").to_numpy(zero_copy_only=False)
            seen += [(ids[first[i]:first[i + 1]], value[first[i]:first[i + 1]], float(label[i]))
                     for i in range(b.num_rows)]
        if seen:
            w = ftrl(seen, bits, alpha, beta, l1, l2, epochs)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at] * len(seen)), pa.array(np.full(len(at), 0))],
                                             names=["bucket", "weight", "rows"])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0.0]), pa.array([len(seen)])],
                                             names=["bucket", "weight", "rows"])

    src = rows.select(F.xxhash64("id").alias("spot"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    # placed and ordered by id, so that reruns train on the same order
    parts = (src.repartition(shards, "spot").sortWithinPartitions("spot", "label", "text")
             .mapInArrow(fit, "bucket long, weight double, rows long"))
    got = parts.groupBy("bucket").agg(F.sum("weight"), F.sum("rows")).collect()   # at most 2^bits + 1 rows
    w = np.zeros(1 << bits)
    total = 0
    for bucket, weight, n in got:
        if bucket < 0:
            total = n
        else:
            w[bucket] = weight
    return (w / max(1, total)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, out: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``out`` (replaced if there): the probability of label 1, from the whole text."""
    docs = docs.drop(out)
    bits = int(len(weights)).bit_length() - 1
    model = docs.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        w = model.value
        for b in tb.slices(batches, text_col):
            ids, value, first = features(b.column(text_col), bits)
            s = np.clip(np.add.reduceat(w[ids] * value, first[:-1]), -35, 35)
            p = 1.0 / (1.0 + np.exp(-s))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``sample_rows`` (text, label) rows, never of a held-out id."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)
    text = docs.select(F.col("doc_id").alias("id"), "text")
    # sample_rows (id, label) pairs are broadcast: 16 bytes each; an id with several texts gives one of them
    return text.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % HELD_OUT_MOD == 0, F.lit(False))


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    w = train(labelled_sample(docs, labels))
    out = score(docs.select("doc_id", "text"), w)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go; all columns of the rest stay."""
    w = train(labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    out = score(packed(docs, "text"), w, "_quality").where(F.col("_quality") >= THRESHOLD)
    return out.select(*unpacked(out, docs, "text"))

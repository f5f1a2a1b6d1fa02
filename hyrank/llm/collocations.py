"""Phrase collocation mining by Toivonen's method: a sample proposes, whole passes decide.

Phrases are runs of 1 to ``LONGEST`` words inside a piece; f counts all their occurrences, language by language.

1. Sample. A share of the documents, by a hash of the row, is mined with a lowered threshold.
   Its frequent phrases S (as hashes) are a set of bits of a table of bounded size.
2. Full pass. Every document is read. Phrases in S are counted by their words. The negative border, i.e.
   all phrases that are not in S though all their parts are (every single word that
   is not in S belongs to it), is counted by hash: sums that are too high at
   most, never too low.
3. Border failures are border phrases with a sum that reaches ``min_count``. They join the table,
   and the next pass over all documents counts them by their words, and by hash the phrases that
   only now have all their parts in the table. When no border phrase fails, no frequent
   phrase can be missing: the set is closed.

So what is returned is counted by words over all documents, each phrase in
exactly one pass: it is counted by words in the first pass in which it and its
parts are in the table, and the table only grows. Hash collisions (of the table, or of border
sums) only lead to phrases counted in vain.

Counting combines in each task: equal phrases of a slice are one row, equal border hashes of a task one
entry of a packed, sorted run. So a phrase in every document costs a row a slice. Runs are merged
by key range. Only the bits of the table reach the driver (``MAX_BITS``: 32 MB at most).

Words: ``[^\\x20\\x09]+`` inside pieces; pieces end at ``[.,;:!?\\x0A-\\x0D]`` and at the end of a text. A-Z
are lower-cased. Null texts are empty; a null lang is ``und``. Repeated rows count as often as they are there;
very long texts are one slice; empty tables give no rows. Ties in the ranking end at the phrase, which is
unique in its language. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyrank.llm import textbytes as tb
from hyrank.llm.common import cut, table, tidy
from hyrank.session import scratch_path

LONGEST = 3
MIN_COUNT = 10
SAMPLE_OF = 8                 # one document in so many is mined first
LOWERED = 2                   # threshold of the sample: MIN_COUNT / SAMPLE_OF, and a little more
SLICE = 2 << 20
PACK_KEYS = 1 << 19
KEY_BITS = 48
KEYS_PER_BUCKET = 1 << 20
MIN_BITS, MAX_BITS = 20, 28
TOP = 2000
SALTS = 64

#: Bytes that end a piece, and those that only end a word.
PIECE_END = ~tb.byte_class([(0x0A, 0x0D), (0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)])
WORD = ~PIECE_END & tb.byte_class([(0x20, 0x20), (0x09, 0x09)])
_MUL = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(LONGEST)]


class Bits:
    """A set of phrase keys as bits of a table; it may claim keys that it does not hold, never the reverse."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(1 << (bits - 6), np.uint64) if words is None else words

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = None
        for spot in spots(keys, self.bits):
            hit = (self.words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1)
            out = hit if out is None else out & hit
        return out.astype(bool)


def spots(keys: np.ndarray, bits: int):
    """The two places of each key in a table of 2^bits."""
    h = tb.mix64(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return (h >> np.uint64(64 - bits), (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits))


class Words:
    """The words of one slice of texts of one language."""

    def __init__(self, col: pa.Array, lang: str):
        data, off = tb.text_bytes(col)
        low = tb.lower_ascii(data)
        start, end, _ = tb.word_spans(low, off, WORD)
        ends = np.concatenate([[0], np.cumsum(PIECE_END[low])])
        doc = np.searchsorted(off, start, "right")
        self.n = len(start)
        #: word i and the next one are in one piece
        self.next = np.zeros(self.n, bool)
        if self.n:
            self.next[:-1] = (doc[1:] == doc[:-1]) & (ends[start[1:]] == ends[end[:-1]])
        inside = WORD[low]
        size = np.concatenate([[0], np.cumsum(end - start)])
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(low[inside])])
        coded = flat.dictionary_encode()
        self.id = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = coded.dictionary.cast(pa.large_string())
        data, off = tb.text_bytes(coded.dictionary)
        h = tb.prefix_hash(data)
        salt = tb.mix64(np.frombuffer(int.from_bytes(lang.encode()[:64], "little").to_bytes(64, "little"), np.uint64)).sum(dtype=np.uint64)
        with np.errstate(over="ignore"):
            self.hash = tb.span_hashes(h, off[:-1], off[1:]) + salt if len(self.names) else np.zeros(0, np.uint64)

    def places(self, size: int) -> np.ndarray:
        """Where a phrase of ``size`` words begins."""
        ok = np.ones(self.n, bool)
        for j in range(size - 1):
            ok[:self.n - j] &= self.next[j:]
            ok[self.n - j:] = False
        return np.flatnonzero(ok)

    def keys(self, at: np.ndarray, size: int) -> np.ndarray:
        """Keys (KEY_BITS bits) of the phrases of ``size`` words at ``at``."""
        with np.errstate(over="ignore"):
            h = np.full(len(at), size, np.uint64)
            for j in range(size):
                h = h + self.hash[self.id[at + j]] * _MUL[j]
            return tb.mix64(h) >> np.uint64(64 - KEY_BITS)

    def counted(self, at: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
        """Phrases at ``at``, each once, and how often; told apart by their words, not by a hash."""
        code = self.id[at]
        for j in range(1, size):
            if j > 1 and len(self.names) >= 1 << 20:
                code = np.unique(code, return_inverse=True)[1]      # else the product could pass 63 bits
            code = code * len(self.names) + self.id[at + j]
        _, first, count = np.unique(code, return_index=True, return_counts=True)
        parts = [self.names.take(pa.array(self.id[at[first] + j])) for j in range(size)]
        return (pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]).cast(pa.string()), count


def by_lang(batches):
    """(lang, slice of texts) of record batches (lang, text)."""
    for b in batches:
        if not b.num_rows:
            continue
        coded = b.column("lang").dictionary_encode()
        for i, lang in enumerate(coded.dictionary.to_pylist()):
            own = b.filter(pc.equal(coded.indices, i)) if len(coded.dictionary) > 1 else b
            for part in tb.slices([own], limit=SLICE):
                yield lang, part.column("text")


# ---------------------------------------------------------------- packed sums by key

PACK = "bucket long, size long, pack binary"


def packed_sums(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows (bucket, size, pack) of sorted keys cut by their top ``bits``: steps between keys as byte planes, then counts."""
    bucket = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(at[1:], len(keys))
    packs = []
    for lo, hi in zip(at, ends):
        step = np.diff(keys[lo:hi] & np.uint64((1 << (KEY_BITS - bits)) - 1), prepend=np.uint64(0)).astype("<u8")
        packs.append(step.view(np.uint8).reshape(-1, 8)[:, :KEY_BITS // 8].T.tobytes()
                     + counts[lo:hi].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array((ends - at).astype(np.int64)), pa.array(packs, pa.binary())],
                                      names=["bucket", "size", "pack"])


def unpacked_sums(size: int, pack: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pack, np.uint8).reshape(-1, size)
    step, count = np.zeros((size, 8), np.uint8), np.zeros((size, 4), np.uint8)
    step[:, :KEY_BITS // 8] = planes[:KEY_BITS // 8].T
    count[:] = planes[KEY_BITS // 8:].T
    return np.cumsum(step.reshape(-1).view("<u8")), count.reshape(-1).view("<u4")


class Sums:
    """Counts of keys, combined up to PACK_KEYS at a time."""

    def __init__(self, bits: int):
        self.bits, self.held, self.size = bits, [], 0

    def add(self, keys: np.ndarray):
        if len(keys):
            got = np.unique(keys, return_counts=True)
            self.held.append(got)
            self.size += len(got[0])
        if self.size >= PACK_KEYS:
            yield from self.out()

    def out(self):
        if self.held:
            keys, at = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([c for _, c in self.held])).astype(np.int64)
            self.held, self.size = [], 0
            yield packed_sums(keys, counts, self.bits)


def frequent_keys(packs: DataFrame, bits: int, least: int) -> DataFrame:
    """(key) whose counts add up to ``least``, from packed sums; a key range at a time."""
    def merge(batches):
        now, held = None, []

        def close():
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([c for _, c in held]))
            full = keys[total >= least] + (np.uint64(now) << np.uint64(KEY_BITS - bits))
            return pa.RecordBatch.from_arrays([pa.array(full.view(np.int64))], names=["key"])

        for b in batches:
            for bucket, size, pack in zip(b.column("bucket").to_pylist(), b.column("size").to_pylist(), b.column("pack")):
                if bucket != now and held:
                    yield close()
                    held = []
                now = bucket
                held.append(unpacked_sums(size, pack.as_py()))
        if held:
            yield close()

    return packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "key long")


def with_keys(table_: Bits, keys: DataFrame) -> Bits:
    """The table with more keys; they become words of bits where they are, and only those reach the driver."""
    bits = table_.bits

    def words(batches):
        for b in batches:
            at = np.concatenate(spots(b.column("key").to_numpy(zero_copy_only=False).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)),
                                              pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    got = keys.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = table_.words.copy()                                 # 2^(bits - 6) rows at most
    out[got.column("word").to_numpy()] |= got.column("bits").to_numpy().view(np.uint64)
    return Bits(bits, out)


# ---------------------------------------------------------------- passes

def sample_sums(docs: DataFrame, bits: int, longest: int) -> DataFrame:
    """Packed sums of all phrases of the sample."""
    def run(batches):
        sums = Sums(bits)
        for lang, col in by_lang(batches):
            w = Words(col, lang)
            for size in range(1, longest + 1):
                yield from sums.add(w.keys(w.places(size), size))
        yield from sums.out()

    return docs.mapInArrow(run, PACK)


COUNTED = "lang string, phrase string, count long, " + PACK


def count_pass(docs: DataFrame, old, new, bits: int, longest: int) -> DataFrame:
    """One pass: rows (lang, phrase, count) of phrases that the table ``new`` brought, and packed sums of
    the border phrases that it brought. ``old``: the table of the pass before (a broadcast of None at first).
    The first pass also gives each language's number of words, under a null phrase."""
    names = [c.split()[0] for c in COUNTED.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def named(lang, phrases, counts):
        n = len(phrases)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), phrases, pa.array(counts, pa.int64()), *(pa.nulls(n, k) for k in kinds[3:])], names=names)

    def border(packs):
        for b in packs:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(b.num_rows, k) for k in kinds[:3]), *b.columns], names=names)

    def run(batches):
        was, now, sums = old.value, new.value, Sums(bits)
        none = lambda keys: np.zeros(len(keys), bool)
        in_old = was.has if was is not None else none
        for lang, col in by_lang(batches):
            w = Words(col, lang)
            if not w.n:
                continue
            if was is None:
                yield named(lang, pa.nulls(1, pa.string()), [w.n])
            # of single words, what the tables say is looked up once a name; every word has its parts
            own = tb.mix64(np.uint64(1) + w.hash * _MUL[0]) >> np.uint64(64 - KEY_BITS)
            known, knew = now.has(own), in_old(own)
            seen = np.bincount(w.id, minlength=len(own))
            fresh = known & ~knew
            if fresh.any():
                yield named(lang, w.names.filter(pa.array(fresh)).cast(pa.string()), seen[fresh])
            if was is None and not known.all():
                at = np.flatnonzero(~known[w.id])
                yield from border(sums.add(own[w.id[at]]))
            known, knew = known[w.id], knew[w.id]               # by place: is the phrase here (and are its parts) in the table?
            for size in range(2, longest + 1):
                at = w.places(size)
                at = at[known[at] & known[at + 1]]               # both parts of one word less
                keys = w.keys(at, size)
                enabled_before = knew[at] & knew[at + 1]
                is_in = now.has(keys)
                was_in = enabled_before & in_old(keys)
                yes = is_in & ~was_in
                if yes.any():
                    yield named(lang, *w.counted(at[yes], size))
                yield from border(sums.add(keys[~is_in & ~enabled_before]))
                known, knew = np.zeros(w.n, bool), np.zeros(w.n, bool)
                known[at], knew[at] = is_in, was_in
        yield from border(sums.out())

    return docs.mapInArrow(run, COUNTED)


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, sample_of: int = SAMPLE_OF,
                     lowered: int = LOWERED) -> tuple[DataFrame, DataFrame, int]:
    """(phrases (lang, phrase, count) with ``min_count`` at least, totals (lang, n), number of whole passes)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.col("text").isNotNull())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # key ranges of about a million keys, if each word began a phrase of its own
    bits = int(min(24, max(6, np.ceil(np.log2(max(1, size / 6) * longest / KEYS_PER_BUCKET)))))

    in_sample = F.pmod(F.xxhash64(F.lit("sample"), "lang", "text"), F.lit(sample_of)) == 0
    found = cut(frequent_keys(sample_sums(docs.where(in_sample), bits, longest), bits, lowered))
    n = found.count()
    now = with_keys(Bits(int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(64 * max(1, n))))))), found)
    was, parts, passes = None, [], 0
    while True:
        path = scratch_path(spark, f"phrases-{passes}")
        before, after = (spark.sparkContext.broadcast(x) for x in (was, now))    # 32 MB each at most
        count_pass(docs, before, after, bits, longest).write.parquet(path)
        passes += 1
        got = spark.read.parquet(path)
        parts.append(got.where("bucket is null").select("lang", "phrase", "count"))
        failed = cut(frequent_keys(got.where("bucket is not null").select("bucket", "size", "pack"), bits, min_count))
        if failed.isEmpty():
            break
        was, now = now, with_keys(now, failed)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    tidy(spark)
    # the shuffle of all counted phrases goes before those of the scores come
    sums = _written(every.groupBy("lang", "phrase").agg(F.sum("count").alias("count"))
                    .where(F.col("phrase").isNull() | (F.col("count") >= min_count)), "phrase-sums")
    return sums.where("phrase is not null"), sums.where("phrase is null").select("lang", F.col("count").alias("n")), passes


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder; the shuffle files that led to it go."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of two words or more, by their lowest-scoring cut; without those whose
    longer phrases account for half of them."""
    words = F.split("phrase", " ")
    long = phrases.select("lang", "phrase", F.col("count").alias("a"), words.alias("w")).where(F.size("w") > 1)
    cuts = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice("w", 1, k), " ").alias("left"), F.array_join(F.slice("w", k + 1, F.size("w")), " ").alias("right")))
    each = long.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    # a small file of phrases is a large table in memory: never broadcast
    side = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("count").alias(f)).hint("merge")
    each = _written(each.join(side("left", "l"), ["lang", "left"]), "phrase-cuts")
    each = each.join(side("right", "r"), ["lang", "right"])
    # decimals of 38 digits, and their whole-number division: exact up to a = 10^15
    each = each.withColumn("score", F.expr(
        "(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    lowest = _written(each.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")), "phrase-scores")
    # every phrase of two words or more inside a longer one
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    longer = long.where(F.size("w") > 2).select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most")).hint("merge")
    kept = lowest.hint("merge").join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < 50 * F.col("a")))
    return kept.join(F.broadcast(totals), "lang").select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def collocations(docs: DataFrame, top: int = TOP, **how) -> DataFrame:
    """The ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    Languages are ranked in two steps (by a salt, then as a whole), so that no task orders all phrases of one.
    """
    phrases, totals, _ = frequent_phrases(docs, **how)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored(phrases, totals).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top)
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS phrase
      FROM w, unnest([1, 2, 3]) AS u(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
a AS (SELECT lang, m, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND c >= 10),
k AS (SELECT lang, phrase, m, a, k, array_to_string(list_slice(w, 1, k), ' ') AS x, array_to_string(list_slice(w, k + 1, m), ' ') AS y
      FROM a, unnest([1, 2]) AS u(k) WHERE k < m),
s AS (SELECT k.*, l.c AS l, r.c AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.c AS HUGEINT) * r.c) AS BIGINT) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.x JOIN f r ON r.lang = k.lang AND r.phrase = k.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM a WHERE m = 3) GROUP BY 1, 2),
t AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE o.a IS NULL OR 100 * o.a < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM t JOIN n USING (lang) QUALIFY rank <= 2000
"""

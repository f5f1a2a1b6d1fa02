"""Language identification by bit-sliced Bloom filters of n-grams.

Learning. Each language learns from about ``rows_per_lang`` of its labelled texts (all, if it
has fewer), drawn by a hash of the id: the only sample here, and a bound on the
work. Its n-grams (``SIZES`` bytes of the lower-cased text, where every run of other
characters than letters is one space) are counted, and the
``TOP`` / languages most frequent enter the language's filter if they are at least
``SHARE`` times as frequent there as in the language that uses them most.

Filter. One table of 2^``BITS`` rows; a row holds one bit for each language (64 to a word, more languages
take more words). The ``PROBES`` rows that an n-gram hashes to, and-ed, give all
languages containing it at once. The table is 8 MB for every 64 languages, whatever the corpus.

Scoring. One map over the documents, whole texts: for each language the number of
n-grams of the text that have its bit is counted, and corrected for false
positives: c = (hits - n f) / (1 - f), where f is the language's share of
set rows to the power of PROBES. The largest c decides, ties go to the smaller name.
``score`` is that c over the sum of all.

Null texts and texts without a letter (Unicode) are ``und`` with score 0. A text with letters whose
n-grams no language knows gets the language with most labelled rows, score 0. Without any
labelled row all is ``und``. Rows repeated count as often as they are there. Only the text is read in scoring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyrank.llm import textbytes as tb
from hyrank.llm.common import packed, table, unpacked

SIZES = (3, 5)
BITS = 20
PROBES = 3
ROWS_PER_LANG = 3000
TOP = 1 << 19
TOP_EACH = 1 << 15
SHARE = 0.2
HELD_OUT = 2
UNKNOWN = "und"
KEYS = 1 << 20

#: 1 for bytes of letters: ASCII letters and all of UTF-8's longer characters.
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the n-grams of each text, with a space before, between and behind its words."""
    data, off = tb.text_bytes(pc.utf8_lower(pc.fill_null(col, "")))
    n = len(off) - 1
    # one separator byte before each text, so that texts do not touch
    out = np.full(len(data) + n + 1, 0x20, np.uint8)
    own = np.repeat(np.arange(n), np.diff(off))
    out[np.arange(len(data)) + own + 1] = data
    edge = off + np.arange(n + 1)                        # text i: its separator at edge[i], the next one's at edge[i + 1]
    letter = _LETTER[out]
    keep = letter.copy()
    keep[1:] |= letter[:-1]                              # one space behind each word
    keep[edge] = True
    text = np.where(letter, out, np.uint8(0x20))[keep]
    first = np.concatenate([[0], np.cumsum(keep)])[edge]
    limit = first[1:] + (text[first[1:] - 1] != 0x20)     # a text that ends with a letter borrows the next one's separator
    h = tb.prefix_hash(text)
    keys, at = [], []
    for size in SIZES:
        starts = np.arange(max(0, len(text) - size + 1))
        doc = np.searchsorted(first, starts, "right") - 1
        inside = doc < n
        inside[inside] = starts[inside] + size <= limit[doc[inside]]
        starts, doc = starts[inside], doc[inside]
        with np.errstate(over="ignore"):
            keys.append(tb.span_hashes(h, starts, starts + size) ^ np.uint64(size))
        at.append(doc)
    order = np.argsort(np.concatenate(at), kind="stable")
    doc = np.concatenate(at)[order]
    return np.concatenate(keys)[order], np.searchsorted(doc, np.arange(n + 1))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def sample(rows: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """(lang, text) of about ``rows_per_lang`` of each language's rows (id, lang, text)."""
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    share = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.join(F.broadcast(counts), "lang").where(share * F.col("_n") < rows_per_lang).select("lang", "text")


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, count) of (lang, text) rows; tasks send sums of about KEYS occurrences."""
    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def out():
            for lang, keys in held.items():
                got, count = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got)), pa.array(got.view(np.int64)), pa.array(count)],
                                                 names=["lang", "gram", "count"])

        for b in tb.slices(batches):
            keys, first = grams(b.column("text"))
            for lang, lo, hi in zip(b.column("lang").to_pylist(), first[:-1], first[1:]):
                held.setdefault(lang, []).append(keys[lo:hi])
            size += len(keys)
            if size >= KEYS:
                yield from out()
                held, size = {}, 0
        yield from out()

    parts = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, count long")
    return parts.groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def chosen_grams(counts: DataFrame, n_langs: int, top: int = TOP, share: float = SHARE) -> DataFrame:
    """(lang, gram) that enter the filters; no more than ``top`` in all."""
    total = counts.groupBy("lang").agg(F.sum("count").alias("_total"))
    often = counts.join(F.broadcast(total), "lang").withColumn("often", F.col("count") / F.col("_total"))
    most = often.groupBy("gram").agg(F.max("often").alias("_most"))
    own = often.join(most, "gram").where(F.col("often") >= share * F.col("_most")).select("lang", "gram", "count")
    each = max(1, min(TOP_EACH, top // max(1, n_langs)))

    def best(batches):
        """The ``each`` most frequent of every language in one task, so that the ranking below orders few rows."""
        held: dict[str, tuple] = {}
        for b in batches:
            names = b.column("lang").dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            gram, count = (b.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "count"))
            for i, name in enumerate(names.dictionary.to_pylist()):
                own = code == i
                if name in held:
                    g, c = (np.concatenate(x) for x in zip(held[name], (gram[own], count[own])))
                else:
                    g, c = gram[own], count[own]
                at = np.lexsort((g, -c))[:each]
                held[name] = g[at], c[at]
        for name, (g, c) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(g)), pa.array(g), pa.array(c)], names=["lang", "gram", "count"])

    order = Window.partitionBy("lang").orderBy(F.col("count").desc(), "gram")
    few = own.mapInArrow(best, "lang string, gram long, count long")
    return few.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each).select("lang", "gram")


class Filters:
    """Bloom filters of several languages side by side: row r, word w holds bits of languages 64 w .. 64 w + 63."""

    def __init__(self, langs: list[str], bits: int = BITS, probes: int = PROBES):
        self.langs, self.bits, self.probes = langs, bits, probes
        self.rows = np.zeros((max(1, -(-len(langs) // 64)), 1 << bits), np.uint64)
        self.false = np.zeros(len(langs))

    def places(self, keys: np.ndarray):
        """Rows an n-gram hashes to, one array a probe."""
        with np.errstate(over="ignore"):
            other = tb.mix64(keys + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            for p in range(self.probes):
                yield ((keys + other * np.uint64(p)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, lang: int, keys: np.ndarray) -> None:
        for at in self.places(keys):
            self.rows[lang // 64, at] |= np.uint64(1) << np.uint64(lang % 64)

    def close(self) -> "Filters":
        """Work out how often each language claims an n-gram it does not have."""
        for i in range(len(self.langs)):
            bit = np.uint64(1) << np.uint64(i % 64)
            self.false[i] = np.count_nonzero(self.rows[i // 64] & bit) / self.rows.shape[1]
        self.false = self.false ** self.probes
        return self

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """(words, n): for each n-gram the languages containing it."""
        out = None
        for at in self.places(keys):
            out = self.rows[:, at] if out is None else out & self.rows[:, at]
        return out

    def corrected(self, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(texts, languages): n-grams of each text that the language contains, false positives taken off."""
        masks = self.masks(keys)
        n = np.diff(first)
        out = np.zeros((len(n), len(self.langs)))
        for i in range(len(self.langs)):
            has = (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits = np.diff(np.concatenate([[0], np.cumsum(has, dtype=np.int64)])[first])
            out[:, i] = np.maximum(0.0, (hits - n * self.false[i]) / (1.0 - self.false[i]))
        return out


def learn(rows: DataFrame, rows_per_lang: int = ROWS_PER_LANG, bits: int = BITS) -> tuple[Filters, str | None]:
    """Filters of all languages of (id, lang, text) rows, and the language with most rows."""
    many = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()       # one row a language
    langs = sorted((r["lang"] for r in many), key=lambda x: x.encode())
    filters = Filters(langs, bits)
    if langs:
        counts = gram_counts(sample(rows, rows_per_lang))
        got = chosen_grams(counts, len(langs)).toPandas()                        # TOP rows at most
        for lang, own in got.groupby("lang"):
            filters.add(langs.index(lang), own["gram"].to_numpy(np.int64).view(np.uint64))
    most = max(many, key=lambda r: (r["n"], r["lang"]), default=None)
    return filters.close(), most["lang"] if most else None


def identify(docs: DataFrame, filters: Filters, usual: str | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "score")
    model = docs.sparkSession.sparkContext.broadcast(filters)            # 8 MB for every 64 languages
    src = packed(docs, text_col).withColumn("_letter", has_letter(F.col(text_col)))
    schema = T.StructType([*src.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = schema.names

    def run(batches):
        f = model.value
        langs = np.array([*f.langs, UNKNOWN], object)
        for b in tb.slices(batches, text_col):
            letter = b.column("_letter").to_numpy(zero_copy_only=False)
            best, score = np.full(b.num_rows, len(f.langs)), np.zeros(b.num_rows)
            if f.langs:
                c = f.corrected(*grams(b.column(text_col)))
                total = c.sum(axis=1)
                best = np.where(total > 0, c.argmax(axis=1), f.langs.index(usual))
                score = np.divide(c.max(axis=1), total, out=np.zeros(len(total)), where=total > 0)
            best = np.where(letter, best, len(f.langs))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs[best], pa.string()), pa.array(np.where(letter, score, 0.0))], names=names)

    out = src.mapInArrow(run, schema)
    return out.select(*unpacked(out, docs, text_col), "lang_pred", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    filters, usual = learn(known.select(F.col("doc_id").alias("id"), "lang", "text"))
    out = identify(docs.select("doc_id", "text"), filters, usual)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

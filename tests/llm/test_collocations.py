"""Phrase mining against a plain count of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hyrank.llm import collocations
from test_llm_operators import DOCS, ODD, folder, rows

SCHEMA = "doc_id long, lang string, text string"


def plain_counts(docs):
    """{(lang, words): count} and {lang: n}."""
    f, n = Counter(), Counter()
    for _, lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i:i + m])) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    return f, n


def plain(docs, least=10, top=2000):
    f, n = plain_counts(docs)
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, w[i:i + 2]) for (lang, w), a in often.items() if len(w) == 3 for i in (0, 1) if 100 * a >= 50 * f[lang, w[i:i + 2]]}
    out = {}
    for (lang, w), a in often.items():
        if (lang, w) not in gone:
            cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, own in out.items()
                  for i, (s, a, p, x, y) in enumerate(sorted(own)[:top], 1))


def corpus(seed=2, n=500):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)] + ["É", "Ab", "😀"]
    fixed = [["new", "York", "city"], ["new", "york"], ["a", "a"], ["a", "a", "a"], ["per", "se"]]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 60)):
            words += rng.choice(fixed) if rng.random() < 0.2 else [rng.choice(pool)]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\x0b"]) for w in words)
        docs.append((i, rng.choice(["en", "de", None]), rng.choice([text, text, text, None, ""]) if i % 9 == 0 else text))
    # phrases that no sampled document may hold: bursts in few documents
    docs += [(n + j, "en", f"rare{j} bird{j} song{j} . " * 10) for j in range(30)]
    return docs


def as_tuples(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.mark.parametrize("how", [{}, {"sample_of": 100, "lowered": 3}, {"sample_of": 1, "lowered": 10}, {"sample_of": 10 ** 9, "lowered": 2}])
def test_same_phrases_whatever_the_sample_says(spark, docs, how):
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    assert as_tuples(collocations.collocations(df, **how)) == plain(docs)


def test_border_failures_lead_to_further_passes(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    _, _, whole = collocations.frequent_phrases(df, sample_of=1, lowered=10)
    _, _, none = collocations.frequent_phrases(df, sample_of=10 ** 9, lowered=2)
    assert whole == 1 and none == 4        # words, then pairs, then triples fail


def test_scores_read_written_tables(spark, docs):
    """Counts and scores are each read back from files, so that the shuffles before them can go."""
    phrases, totals, _ = collocations.frequent_phrases(spark.createDataFrame(docs, SCHEMA))
    assert any("phrase-sums" in f for f in phrases.inputFiles())
    assert any("phrase-scores" in f for f in collocations.scored(phrases, totals).inputFiles())


def test_phrases_and_counts(spark, docs):
    phrases, totals, _ = collocations.frequent_phrases(spark.createDataFrame(docs, SCHEMA))
    f, n = plain_counts(docs)
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["count"] for r in rows(phrases)} == {k: a for k, a in f.items() if a >= 10}
    assert {r["lang"]: r["n"] for r in rows(totals)} == {k: a for k, a in n.items() if a}


def test_a_crowded_table_and_small_packs_change_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(collocations, "MIN_BITS", 6)
    monkeypatch.setattr(collocations, "MAX_BITS", 7)
    monkeypatch.setattr(collocations, "SLICE", 400)
    assert as_tuples(collocations.collocations(spark.createDataFrame(docs, SCHEMA))) == plain(docs)


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    odd = spark.createDataFrame([(*r, 1, "z") for r in ODD], DOCS + ", phrase int, n string")
    assert as_tuples(collocations.collocations(odd)) == plain([(r[0], r[2], r[1]) for r in ODD])
    assert collocations.op12(spark, folder(spark, documents=spark.createDataFrame([], DOCS))).count() == 0


def test_top_and_ties(spark):
    docs = [(i, "en", " . ".join(f"{a}{i} {a}{i}x" for a in "pqr")) for i in range(40) for _ in range(10)]
    got = as_tuples(collocations.collocations(spark.createDataFrame(docs, SCHEMA), top=25))
    assert got == plain(docs, top=25) and len(got) == 25


def test_very_long_text(spark):
    rng = random.Random(8)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(400_000))
    docs = [(1, "en", text)]
    assert as_tuples(collocations.collocations(spark.createDataFrame(docs, SCHEMA))) == plain(docs)


def test_packed_sums_round_trip():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << collocations.KEY_BITS, 5000).astype(np.uint64))
    counts = rng.integers(1, 1 << 30, len(keys))
    got = collocations.packed_sums(keys, counts, 6)
    back = [(k + (np.uint64(b) << np.uint64(collocations.KEY_BITS - 6)), c) for b, (k, c) in
            ((b, collocations.unpacked_sums(n, p)) for b, n, p in zip(*(got.column(i).to_pylist() for i in range(3))))]
    assert (np.concatenate([k for k, _ in back]) == keys).all() and (np.concatenate([c for _, c in back]) == counts).all()


def test_many_names_in_a_slice():
    """Phrase codes stay apart when the names of a slice pass 2^20."""
    text = " ".join(f"n{i}" for i in range((1 << 20) + 5)) + " n1 n2 n3"
    w = collocations.Words(pa.array([text]), "en")
    phrases, counts = w.counted(w.places(3), 3)
    assert len(w.names) > 1 << 20
    assert dict(zip(phrases.to_pylist(), counts.tolist()))["n1 n2 n3"] == 2 and counts.sum() == w.n - 2

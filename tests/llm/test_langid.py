"""Language identification against plain sets, and its accuracy on held-out documents."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hyrank.llm import langid, textbytes as tb
from hyrank.llm.common import table
from test_llm_operators import DOCS, ODD, folder, rows

from conftest import SF_SMALL


def plain_grams(text):
    words = re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())
    s = b" " + b"".join(w + b" " for w in words)
    return [s[i:i + n] for n in langid.SIZES for i in range(len(s) - n + 1)]


def test_grams_of_each_text():
    texts = ["one two", "", None, "Ärger!", "...", " x", "a\n\nb é", "42nd street", "end."]
    keys, first = langid.grams(pa.array(texts))
    for i, t in enumerate(texts):
        want = plain_grams(t)
        got = keys[first[i]:first[i + 1]].tolist()
        assert len(got) == len(want)
        hashed = [int(tb.span_hashes(tb.prefix_hash(np.frombuffer(g, np.uint8)), np.array([0]), np.array([len(g)]))[0]) ^ len(g) for g in want]
        assert sorted(got) == sorted(hashed)


def test_filters_return_all_languages_and_correct_false_positives():
    rng = np.random.default_rng(1)
    langs = [f"l{i:03}" for i in range(130)]                       # more than one word of bits
    f = langid.Filters(langs, bits=12)
    own = {i: tb.mix64(rng.integers(0, 1 << 62, 300).astype(np.uint64)) for i in (0, 63, 64, 129)}
    shared = tb.mix64(rng.integers(0, 1 << 62, 50).astype(np.uint64))
    for i, keys in own.items():
        f.add(i, keys)
        f.add(i, shared)
    f.close()
    masks = f.masks(shared)
    for i in own:
        assert ((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    other = tb.mix64(rng.integers(0, 1 << 62, 200_000).astype(np.uint64))
    hits = langid.Filters.corrected(f, other, np.array([0, len(other)]))
    assert f.false[0] > 0.002 and hits[0, 0] < 0.15 * f.false[0] * len(other)      # what is left of them after the correction
    got = f.corrected(np.concatenate([own[64], shared]), np.array([0, 350]))
    assert got[0].argmax() == 64 and got[0, 64] > 349


def test_odd_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, "z", 1.5) for r in ODD], DOCS + ", lang_pred string, _rest double")
    f, usual = langid.learn(spark.createDataFrame([(1, "en", "the one and the end"), (2, "fr", "le début et la fin")], "id long, lang string, text string"))
    got = rows(langid.identify(docs, f, usual))
    assert len(got) == len(ODD)
    for r in got:
        letters = any(ch.isalpha() for ch in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert r["_rest"] == 1.5
    assert {r["lang_pred"] for r in got if r["doc_id"] == 3} == {"en"}
    empty = langid.identify(spark.createDataFrame([], DOCS), f, usual)
    assert empty.count() == 0
    none, usual = langid.learn(spark.createDataFrame([], "id long, lang string, text string"))
    assert {r["lang_pred"] for r in rows(langid.identify(docs, none, usual))} == {"und"}


def test_unknown_letters_get_the_usual_language(spark):
    f, usual = langid.learn(spark.createDataFrame([(1, "en", "the one"), (2, "en", "the two"), (3, "fr", "le début")], "id long, lang string, text string"))
    got = rows(langid.identify(spark.createDataFrame([(1, "Щ 你好")], "doc_id long, text string"), f, usual))
    assert got[0]["lang_pred"] == "en" and got[0]["score"] == 0


def test_sample_keeps_small_languages(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 40, "xx").otherwise("yy").alias("lang"), F.lit("t").alias("text"))
    n = {r["lang"]: r["count"] for r in langid.sample(df, 500).groupBy("lang").count().collect()}
    assert n["xx"] == 40 and 400 < n["yy"] < 600


def test_very_long_text(spark):
    text = "und der die das " * 200_000                            # 3.2 MB
    f, usual = langid.learn(spark.createDataFrame([(1, "de", "und der die das"), (2, "en", "the one")], "id long, lang string, text string"))
    r = rows(langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), f, usual))[0]
    assert r["lang_pred"] == "de" and r["score"] > 0.9


def test_held_out_accuracy(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    got = langid.op11(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got["held_out"]]
    assert len(held) > 150 and (held["lang"] == held["lang_pred"]).mean() > 0.98


def test_languages_told_apart(spark):
    rng = random.Random(4)
    pools = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(150)]
             for lang, letters in (("aa", "abcdefgh"), ("bb", "abcdijkl"), ("cc", "éüñabß"))}
    say = lambda lang: " ".join(rng.choice(pools[lang]) for _ in range(40))
    train = [(i, lang, say(lang)) for i, lang in enumerate(list(pools) * 60)]
    f, usual = langid.learn(spark.createDataFrame(train, "id long, lang string, text string"))
    test = [(i, lang, say(lang)) for i, lang in enumerate(list(pools) * 20)]
    got = rows(langid.identify(spark.createDataFrame(test, "doc_id long, want string, text string"), f, usual))
    assert all(r["want"] == r["lang_pred"] for r in got)

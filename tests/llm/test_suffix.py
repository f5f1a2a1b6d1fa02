"""Substring dedup: columns of any name, passages around the bound."""

import random
from collections import Counter

from hyrank.llm import suffix
from test_llm_operators import DOCS, folder, rows


def test_any_columns_pass_through(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh") for _ in range(900))
    docs = spark.createDataFrame([(1, text, 1, "r", 5, 7, "k"), (2, text[:500], 2, "s", 6, 8, "l"), (3, None, 3, None, 0, 0, None)],
                                 "doc_id long, text string, _key int, runs string, n_bytes int, kept int, _rest string")
    got = {r["doc_id"]: r for r in rows(suffix.dedup_substrings(docs))}
    assert [(got[i]["_key"], got[i]["runs"], got[i]["_rest"]) for i in (1, 2, 3)] == [(1, "r", "k"), (2, "s", "l"), (3, None, None)]
    assert [(got[i]["n_bytes"], len(got[i]["kept"])) for i in (1, 2, 3)] == [(900, 900 - 500), (500, 0), (0, 0)]


def test_empty_table(spark):
    assert suffix.op7(spark, folder(spark, documents=spark.createDataFrame([], DOCS))).count() == 0


def planted(rng, words, n_words):
    """A passage of so many words, planted in three documents of other words."""
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(n_words)
    return passage, [f"{say(80)} {passage} {say(80)}" for _ in range(3)]


def test_passages_of_over_50_words_go_if_they_have_400_bytes(spark):
    """The bound is 400 bytes, not words: passages of 50 to 120 words go exactly when their bytes reach it."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 10))) for _ in range(4000)]
    cases = [planted(rng, words, n) for n in range(50, 121, 5) for _ in range(2)]
    docs = [(3 * i + j, t) for i, (_, texts) in enumerate(cases) for j, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in rows(suffix.op7(spark, folder(spark, documents=spark.createDataFrame(docs, "doc_id long, text string"))))}
    brute = suffix.brute_force([t.encode() for _, t in docs])
    caught = Counter()
    for i, (passage, texts) in enumerate(cases):
        long = len(passage) >= suffix.LENGTH
        caught[long, got[3 * i][0] > 0] += 1
        for j in range(3):
            assert got[3 * i + j] == (sum(hi - lo for lo, hi in brute[3 * i + j]), len(brute[3 * i + j]))
            assert not long or got[3 * i + j][0] >= len(passage)
    assert caught[True, False] == 0 and caught[True, True] > 5 and caught[False, False] > 5

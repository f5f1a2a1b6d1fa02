"""The quality classifier against plain Python: features, FTRL updates and scores."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from hyrank.llm import quality, textbytes as tb
from test_llm_operators import rows


def plain_ftrl(data, alpha, beta, l1, l2, epochs):
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in data:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                n[i] += g * g
                z[i] += g - sigma * w[i]
    return {i: weight(i) for i in z}


def as_dicts(texts, bits):
    ids, value, first = quality.features(pa.array(texts, pa.string()), bits)
    return [dict(zip(ids[a:b].tolist(), value[a:b].tolist())) for a, b in zip(first[:-1], first[1:])]


def test_updates_and_scores_equal_plain_python(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    good = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    bad = [t.upper().replace(" ", "!! ") for t in good]
    texts = [t for p in zip(good, bad) for t in p] + ["", "x"]
    labels = [1, 0] * 40 + [0, 1]
    bits, how = 12, (12.0, 1.0, 0.001, 0.0, 3)
    data = list(zip(as_dicts(texts, bits), labels))
    got = quality.ftrl([(np.array(list(x)), np.array(list(x.values())), y) for x, y in data], bits, *how)
    want = plain_ftrl(data, *how)
    assert max(abs(got[i] - w) for i, w in want.items()) < 1e-9 and np.count_nonzero(got) == sum(w != 0 for w in want.values())
    weights = got.astype(np.float32)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in rows(quality.score(docs, weights))}
    for i, x in enumerate([x for x, _ in data] + as_dicts([None], bits)):
        assert abs(scores[i] - 1 / (1 + math.exp(-sum(float(weights[j]) * v for j, v in x.items())))) < 1e-6


def test_features_are_counts_of_tokens_and_pairs():
    """``a b a``: tokens a twice and b, the pairs a b and b a, and the runs of one to three word forms."""
    h = lambda *w: tb.span_hashes(tb.prefix_hash(np.frombuffer("".join(w).encode(), np.uint8)), np.array([0]), np.array([len("".join(w))]))
    ids, value, first = quality.features(pa.array(["a b a", "", "7 8"]), 18)
    own = dict(zip(ids[:first[1]].tolist(), value[:first[1]].tolist()))
    token = lambda w: max(1, int(h(w)[0]) & ((1 << 18) - 1))
    assert abs(own[token("a")] / own[token("b")] - math.sqrt(2)) < 1e-12 and own[0] == 1.0
    assert ids[first[1]:first[2]].tolist() == [0]                                  # an empty text: the bias alone
    digits = set(ids[first[2]:first[3]].tolist())
    assert token("0") in digits and token("7") not in digits                       # every digit reads 0


def test_text_longer_than_a_slice(spark):
    text = "Plain words, 42 of them. " * 60_000                                    # 1.5 MB
    w = np.zeros(1 << 12, np.float32)
    ids, value, _ = quality.features(pa.array([text]), 12)
    w[ids[:5]] = 0.5
    got = rows(quality.score(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), w))
    assert abs(got[0]["score"] - 1 / (1 + math.exp(-float((w[ids] * value).sum())))) < 1e-6

"""Each operator of the llm folder on small inputs, against brute force or an exact round trip."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hyrank.llm import ann, chat, decontam, jaccard, licenses, linededup, mixing, quality, suffix, warc
from hyrank.llm.common import table
from hyrank.session import scratch_path

from conftest import SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3),
       (4, "x " * 30_000 + "end", "en", None, 60_003), (None, "no id here", "en", "b", 10),
       (5, "é\x00<#\\ \t\n\r\n\n" * 3, "fr", "b", 30)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def folder(spark, **tables):
    """Tables written the way queries find them."""
    base = scratch_path(spark, "tables")
    for name, df in tables.items():
        df.write.parquet(f"{base}/{name}.parquet")
    return base


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ---------------------------------------------------------------- 1 line dedup

def test_simhash_is_the_majority_of_word_hashes(spark):
    rng = random.Random(5)
    sets = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)] for n in (1, 2, 3, 4, 5, 31, 32, 62, 63)] + [[7, 7, -1]]
    df = spark.createDataFrame([(x,) for x in sets], "h array<long>")
    for r in df.select("h", linededup.simhash(F.col("h")).alias("sim")).collect():
        want = sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in r.h) > len(r.h))
        assert r.sim & ((1 << 64) - 1) == want


def test_an_edited_word_changes_two_blocks_at_most(spark):
    rng = random.Random(6)
    make = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9)))
    pairs = []
    for n in (6, 11, 12, 24, 60, 128, 129, 400):
        words = [make() for _ in range(n)]
        edited = list(words)
        edited[rng.randrange(n)] = make()
        pairs.append((" ".join(words), " ".join(edited)))
    df = spark.createDataFrame(pairs, "a string, b string").select(linededup.line_keys(F.col("a")).alias("a"), linededup.line_keys(F.col("b")).alias("b"))
    for (a, _), r in zip(pairs, df.collect()):
        n = len(a.split())
        assert n < 12 or len(set(r.a) - set(r.b)) <= 4 + 5 * (n == 12)          # two for each number of blocks; of 6 pairs at most 5
        assert len(r.a) == len(set(r.a)) and (n < 24 or set(r.a) & set(r.b))
        assert len(r.a) <= (3 * linededup.BLOCKS if n <= 128 else n // 4)


def test_lines_keep_their_first_occurrence(spark):
    long = " ".join(f"word{i}" for i in range(60))
    near = long.replace("word59", "word5x")
    docs = spark.createDataFrame([(2, f"{long}\nonly two\n---\n", "z"), (1, f"Alone\n{long.upper()}!\n", "y"), (3, f"{near}\n---\n\nonly  TWO", "x")],
                                 "doc_id long, text string, other string")
    got = {r["doc_id"]: r for r in rows(linededup.dedup_lines(docs))}
    assert got[1]["text"] == f"Alone\n{long.upper()}!\n" and got[1]["n_removed"] == 0
    assert got[2]["text"] == "only two\n---\n"
    # a line one word off goes too if a block agrees
    assert got[3]["text"] in ("---\n", f"{near}\n---\n") and got[3]["other"] == "x"


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_links_of_lines_equal_brute_force(spark):
    """Groups are those of the lines that share a block and are similar enough."""
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta omega".split()) + str(rng.randrange(400)) for _ in range(40)) for _ in range(30)]
    lines = base + [b.replace(b.split()[7], "changed", 1) for b in base] + [b + " s" for b in base]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    keys = {r.doc_id: set(r["keys"]) for r in docs.select("doc_id", linededup.line_keys(F.col("text")).alias("keys")).collect()}
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if keys[i] & keys[j] and edit(lines[i], lines[j]) <= 0.15 * max(len(lines[i]), len(lines[j])):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    kept = {r.doc_id for r in linededup.dedup_lines(docs).where("n_removed = 0").collect()}
    assert kept == set(root) and len(kept) == 30


def test_near_lines_of_the_documents_are_found_by_edit_similarity_alone(spark):
    """Recall on the lines of sf0.01 against edit similarity alone: every pair of like lengths with enough
    character 4-grams in common to be similar is compared."""
    docs = table(spark, SF_SMALL.replace("0.001", "0.01"), "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    norm = docs.select(linededup.normal(F.col("line")).alias("x")).where("x != ''").distinct().toPandas()["x"].tolist()
    grams = [{x[i:i + 4] for i in range(max(1, len(x) - 3))} for x in norm]
    by_gram = {}
    for i, own in enumerate(grams):
        for g in own:
            by_gram.setdefault(g, []).append(i)
    near = []
    for i, own in enumerate(grams):
        # 15 % of the characters edited leave 40 % of the 4-grams at least, so one of the rarest 61 % is shared
        rare = sorted(own, key=lambda g: (len(by_gram[g]), g))[:int(0.61 * len(own)) + 1]
        for j in {j for g in rare if len(by_gram[g]) < 200 for j in by_gram[g] if j < i}:
            if min(len(norm[i]), len(norm[j])) >= 0.85 * max(len(norm[i]), len(norm[j])) and len(own & grams[j]) >= 0.39 * max(len(own), len(grams[j])):
                near.append((norm[i], norm[j]))
    pairs = spark.createDataFrame(near, "a string, b string").where("levenshtein(a, b) <= 0.15 * greatest(length(a), length(b))")
    share = pairs.select(F.arrays_overlap(linededup.line_keys(F.col("a")), linededup.line_keys(F.col("b"))).alias("found")).groupBy("found").count()
    found = {r["found"]: r["count"] for r in share.collect()}
    assert found[True] > 250 and found[True] >= 0.95 * sum(found.values())


def test_lines_with_words_changed_are_found(spark):
    rng = random.Random(8)
    syllables = "the on re tion er an in ha st ou wh at ble ly ed ing sh nd".split()

    def line(length):
        out = ""
        while len(out) < length:
            out += rng.choice(syllables) + rng.choice(["", "", " "])
        return out.strip()

    def word_off(x):
        words = x.split(" ")
        at = rng.choice([i for i, w in enumerate(words) if len(w) <= max(1, 0.14 * len(x))] or [0])
        return " ".join(words[:at] + ["".join(rng.choice("abcdefg") for _ in words[at])] + words[at + 1:])

    pairs = [(x, word_off(x)) for n in (40, 47, 48, 60, 90, 150, 300, 600) for x in (line(n) for _ in range(30))]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(x for p in pairs for x in p)], "doc_id long, text string")
    near = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "n long, a string, b string").where(
        "levenshtein(a, b) <= 0.15 * greatest(length(a), length(b))")
    want = {2 * r.n + 1 for r in near.collect()}
    gone = {r.doc_id for r in linededup.dedup_lines(docs).where("n_removed = 1").collect()}
    long = {i for i in want if len(pairs[i // 2][0]) >= 150}
    # short lines have few words to a block: an edit can touch all that both lines have
    assert len(want) > 200 and gone <= want and len(gone) >= 0.8 * len(want) and len(gone & long) >= 0.97 * len(long)


# ---------------------------------------------------------------- 2 quality

def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    good = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(rng.choice(words).upper() + "!!" for _ in range(60)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(good + bad)] + [(900, None, None, None, None), (901, "", "", "", 0)], DOCS)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(0, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    sf = folder(spark, documents=docs, labels=labels)
    got = {r["doc_id"]: r for r in rows(quality.op2(spark, sf))}
    assert len(got) == 302 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(300) if got[i]["held_out"]]
    assert held and all(got[i]["predicted"] == int(i < 150) for i in held)
    assert [r["doc_id"] for r in rows(quality.stage(spark, docs.where("doc_id >= 140 and doc_id < 160"), sf).select("doc_id").sort("doc_id"))] == list(range(140, 150))


def test_quality_without_labels(spark, odd):
    sf = folder(spark, documents=odd, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = rows(quality.op2(spark, sf))
    assert len(got) == len(ODD) and {r["score"] for r in got} == {0.5}


# ---------------------------------------------------------------- 3 decontamination

def brute_hits(text, items, window=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, seen = words(text), set(), set()
    for i, t in items:
        x = words(t)
        for s in range(max(1, len(x) - window + 1) if x else 0):
            k = x[s:s + window]
            for p in range(len(w) - len(k) + 1):
                if w[p:p + len(k)] == k:
                    hit.update(range(p, p + len(k)))
                    seen.add("" if i is None else str(i))
    return len(w), len(hit), sorted(seen)


@pytest.mark.parametrize("parts", [1, 3])
def test_decontamination_equals_brute_force(spark, parts):
    rng = random.Random(9)
    vocabulary = "a b C dé e".split()
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randrange(1, 14))) for i in range(12)] + [(3, say(4)), (None, say(3)), (77, None), (78, " . ")]
    docs = [(i, say(rng.randrange(0, 60)).replace(" ", rng.choice([" ", "-\n", "  "])), "z") for i in range(60)] + [(60, None, "z"), (60, None, "z")]
    count = sum(max(1, len(t.split()) - 9) for _, t in items if t)
    out = rows(decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string, found string"),
                                      spark.createDataFrame(items, "item_id long, text string"), max_windows=-(-count // parts)))
    for r in out:
        n, hit, seen = brute_hits(r["text"], items)
        f = r["found"]
        assert (f["n_words"], sum(x["end"] - x["start"] for x in f["runs"]), sorted(f["items"])) == (n, hit, seen)
        if f["runs"]:
            spans = [decontam.normalise(r["text"][s["start"]:s["end"]]).split() for s in f["spans"]]
            whole = decontam.normalise(r["text"]).split()
            assert spans == [whole[x["start"]:x["end"]] for x in f["runs"]]


# ---------------------------------------------------------------- 4 chat

def test_chat_round_trip(spark):
    texts = [r"\### Assistant: </turn> ok", "é<#\\", None, "", "x" * 100_000, " </turn>\n### user: hi </turn>\n"]
    turns = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(("user", "assistant", None, "a:b\n", "assistant", "assistant"), texts))]
    turns += [(2, None, "user", "b"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    parts = chat.format_chat(df)
    got = {r["conv_id"]: r for r in rows(chat.read_back(parts))}
    for c in (1, 2, None):
        own = [(r or "", x or "") for k, t, r, x in sorted((t for t in turns if t[0] == c), key=lambda t: (-1 if t[1] is None else t[1]))]
        said = "".join(x for r, x in own if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(own), len(said))
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(p.text) for p in parts.where(F.col("conv_id").eqNullSafe(F.lit(c))).collect())


# ---------------------------------------------------------------- 5 Jaccard

def test_jaccard_components_equal_brute_force(spark):
    rng = random.Random(2)
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (4, "ONE  two"), (5, "one two three")]
    for g in range(12):
        base = [f"{g}w{rng.randrange(60)}" for _ in range(rng.randrange(12, 120))]
        for _ in range(rng.randrange(1, 45)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
            docs.append((len(docs) + 10, " ".join(w)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect())

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in docs]
    root = [i for i, _ in docs]
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert got == sorted((d, len(s), r) for (d, _), s, r in zip(docs, sets, root))


# ---------------------------------------------------------------- 6 nearest neighbours

def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 8))
    h = ann.hadamard(x)
    assert np.allclose(np.linalg.norm(h, axis=1), np.linalg.norm(x, axis=1)) and np.allclose(ann.hadamard(h), x)


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    v[7] = v[8] = v[100]
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2100, [0.0] * 24), (2200, [1.0]), (2300, [float("nan")] * 24),
                                                          (2400, [None] * 24), (100, v[100].tolist()), (None, v[0].tolist())]
    index = ann.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = ann.search(index.where("id % 100 = 0"), index)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(found) == set(range(0, 1500, 100))
    hit = 0
    for q, near in found.items():
        dist = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        want = [int(i) for i in np.lexsort((np.arange(1500), dist)) if i != q][:10]
        assert near == sorted(near) and len(near) == 10 and all(dist[i] == s for s, i in near)
        hit += len(set(want) & {i for _, i in near})
    assert hit >= 0.9 * 150
    assert [i for _, i in found[100]][:2] == [7, 8]


@pytest.mark.parametrize("same", (True, False))
def test_screen_counts_ids_not_rows(same):
    rng = np.random.default_rng(3)
    ids = np.repeat(np.arange(40), [1, 25, 1, 30] + [1] * 36)
    v = rng.standard_normal((len(ids), 8))
    for i, far in ((1, 1e-3), (3, 1e-2)):                    # the query's own id, and the nearest other one, 25 and 30 times
        v[ids == i] = far * (np.ones(8) if same else rng.standard_normal(((ids == i).sum(), 8)))
    q = np.zeros((1, 8))
    best = {}
    ann._scan(np.array([1]), q, ids, v, 10, best)
    dist = {int(i): float(np.sqrt((v[ids == i] ** 2).sum(axis=1)).min()) for i in range(40) if i != 1}
    assert [x for _, x in best[1]] == sorted(dist, key=lambda i: (dist[i], i))[:10]


def test_neighbours_of_few_vectors_are_all_found(spark):
    v = [(i, [float(i == j) for j in range(8)]) for i in range(6)]
    index = ann.usable(spark.createDataFrame(v, "vec_id long, embedding array<double>"))
    got = ann.search(index.where("id = 0"), index, probe_count=1)
    assert sorted(r.vec_id for r in got.collect()) == [1, 2, 3, 4, 5]
    assert ann.search(index.limit(0), index.limit(0)).count() == 0


# ---------------------------------------------------------------- 7 suffix array

def test_suffix_order_sorts_by_text():
    rng = random.Random(8)
    for alphabet in (b"ab", b"a", b"abcdefgh\xff\x00"):
        segs = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(401, 700))) for _ in range(6)]
        segs.append(segs[0])
        n = np.array([len(s) - 399 for s in segs])
        off = np.concatenate([[0], np.cumsum([len(s) for s in segs])])
        text = np.frombuffer(b"".join(segs), np.uint8)
        order = suffix.suffix_order(text, off, n)
        raw = text.tobytes()
        assert sorted(order.tolist()) == sorted(int(o + i) for o, m in zip(off, n) for i in range(m))
        keys = [raw[i:i + 400] for i in order]
        assert keys == sorted(keys)


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeated_bytes_equal_brute_force(spark, hot, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage = say(140)
    texts = [None, "", "short", "a" * 2000, say(300), passage, passage[:399], "ab" * 500, "q" + "ab" * 300]
    texts += [say(rng.randrange(50, 200)) + passage + say(rng.randrange(50, 200)) for _ in range(12)]
    texts += [texts[4], texts[9], texts[9][:900] + "!" + texts[9][900:]]
    monkeypatch.setattr(suffix.candidates, "__defaults__", (suffix.BLOCKS, hot))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(4, texts[4])], "doc_id long, text string")
    raw = [(t or "").encode() for t in texts] + [texts[4].encode()]
    want = Counter()
    for i, (t, runs) in enumerate(zip(raw, suffix.brute_force(raw))):
        edge = [0, *(x for r in runs for x in r), len(t)]
        want[(i if i < len(texts) else 4, len(t), tuple(runs), b"".join(t[a:b] for a, b in zip(edge[::2], edge[1::2])))] += 1
    got = Counter((r.doc_id, r.n_bytes, tuple((x.lo, x.hi) for x in r.removed), bytes(r.kept)) for r in suffix.dedup_substrings(docs).collect())
    assert got == want


# ---------------------------------------------------------------- 8 mixing

def test_hypergeometric_inversion(spark):
    from math import comb
    draws = [(30, 12, 7), (5, 5, 3), (9, 0, 4), (40, 40, 40), (100, 3, 50)]
    df = spark.createDataFrame(draws, "n long, k long, d long").crossJoin(spark.range(200).select((F.col("id") / 200 + 0.0025).alias("u")))
    got = df.select("n", "k", "d", "u", mixing.hypergeometric(F.col("n"), F.col("k"), F.col("d"), F.col("u")).alias("x")).collect()
    for r in got:
        p = [comb(r.k, x) * comb(r.n - r.k, r.d - x) / comb(r.n, r.d) if 0 <= r.d - x <= r.n - r.k else 0 for x in range(r.k + 1)]
        c = np.cumsum(p)
        assert r.x == int(np.searchsorted(c, r.u, "left")) or abs(c[r.x] - r.u) < 1e-9


def test_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(1, 100), (2, 7), (3, 0), (4, 1)], "number int, draws long")
    got = mixing.splitting_tree(quotas, 5).collect()
    assert {n: sum(r.draws for r in got if r.number == n) for n in (1, 2, 3, 4)} == {1: 100, 2: 7, 3: 0, 4: 1}
    per = [sum(r.draws for r in got if r.shard == s) for s in range(5)]
    assert sum(per) == 108 and max(per) - min(per) <= 2 and all(r.draws >= 0 for r in got)


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    docs = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 50))), rng.choice(["a", "b", "b", "b", "c", None]), "own") for i in range(900)]
    docs += [(1000, None, "a", "own"), (1001, "", "zero", "own"), (1002, "  x\ty\x0bz", "c", "own"), (1002, "  x\ty\x0bz", "c", "own")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size string")
    from hyrank.llm.common import packed
    got = rows(mixing.mix(packed(df, "doc_id", "text", "source"), block_words=200))
    again = rows(mixing.mix(packed(df.repartition(7), "doc_id", "text", "source"), block_words=200))
    key = lambda r: (r["doc_id"], str(r["mixed"]))
    assert sorted(got, key=key) == sorted(again, key=key)
    size = Counter()
    taken = Counter()
    for r in got:
        n = len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))
        assert r["mixed"]["size"] == n and 0 <= r["mixed"]["times"] <= 3 and len(r["mixed"]["shards"]) == r["mixed"]["times"]
        size[r["source"]] += n
        taken[r["source"]] += n * r["mixed"]["times"]
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.remove(s)
    target |= {s: level * weight[s] for s in free}
    for r in got:
        assert r["mixed"]["target"] == pytest.approx(target[r["source"]]) and r["mixed"]["source_size"] == size[r["source"]]
    assert all(abs(taken[s] - target[s]) <= 50 for s in order)


def test_mix_goes_on_past_a_document_that_does_not_fit(spark):
    # c, f and i hold a document of 40 blocks' words that is longer than their targets
    rng = random.Random(2)
    docs = [(c, n) for c in "cfi" for n in [4000] + [rng.randrange(5, 40) for _ in range(250)]] + [(c, 1000) for c in "abdegh" for _ in range(10)]
    df = spark.createDataFrame([(i, "w " * n, c) for i, (c, n) in enumerate(docs)], "doc_id long, text string, source string")
    got = rows(mixing.mix(df, block_words=100))
    for source in "cfi":
        own = [r["mixed"] for r in got if r["source"] == source]
        assert 3000 < own[0]["target"] < 4000
        assert 0 <= own[0]["target"] - sum(m["size"] * m["times"] for m in own) <= 5


# ---------------------------------------------------------------- 9 licences

def test_contained_spans():
    rng = random.Random(0)
    for _ in range(300):
        spans = [(a, a + rng.randrange(1, 7)) for a in (rng.randrange(10) for _ in range(rng.randrange(12)))]
        assert licenses.contained(spans) == [any(x <= a and b <= y for x, y in spans[:i]) for i, (a, b) in enumerate(spans)]


def test_license_rules_and_gates():
    rules = licenses.rules()
    assert len(rules) > 300
    text = ("Licensed under the GNU General Public License, version 3 or later. See the Apache License 2.0, CC BY-NC 4.0 and\n"
            "https://creativecommons.org/licenses/by-sa/3.0/ SPDX-License-Identifier: MIT all rights\nreserved")
    got = [s["label"] for s in licenses.scan_text(text)["spans"]]
    assert got == ["gpl-3", "apache-2.0", "cc-by-nc-4.0", "cc-by-sa-3.0", "mit", "reserved"]
    # the gate loses nothing: all rules run give the same detections
    low = text.lower()
    s = licenses.scanner()
    all_found = [(n, m.start(), m.end()) for n, r in enumerate(rules) for m in r.pattern.finditer(low)]
    all_found.sort(key=lambda f: (-rules[f[0]].priority, f[1] - f[2], f[1], f[0]))
    kept = [f for i, f in enumerate(all_found) if not any(x <= f[1] and f[2] <= y for _, x, y in all_found[:i])]
    assert sorted((a, b, n) for n, a, b in kept) == s.scan(low.encode())


def _example(tree, rng):
    """A text made from a parsed pattern; look-arounds are left out."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "NOT_LITERAL":
            out += "x"
        elif op == "IN":
            kind, what = rng.choice(arg)
            if str(kind) == "NEGATE":
                out += "x"
            elif str(kind) == "RANGE":
                out += chr(rng.randint(*what))
            elif str(kind) == "CATEGORY":
                out += {"CATEGORY_SPACE": rng.choice(" \n\t"), "CATEGORY_DIGIT": "7", "CATEGORY_WORD": "w"}[str(what)]
            else:
                out += chr(what)
        elif op == "BRANCH":
            out += _example(rng.choice(arg[1]), rng)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(_example(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        elif op == "SUBPATTERN":
            out += _example(arg[-1], rng)
        else:
            assert op in ("AT", "ASSERT", "ASSERT_NOT"), op
    return out


def test_every_match_of_a_rule_holds_its_keyword():
    rng = random.Random(1)
    for r in licenses.rules():
        tree = re._parser.parse(r.pattern.pattern, re.A)
        texts = [x for x in (_example(tree, rng) for _ in range(60)) if r.pattern.search(x)]
        assert texts, r
        for x in texts:
            assert r.keyword in " ".join(x.split()), (r, x)


def test_notices_without_permission_are_found():
    for notice in ("This may not be reproduced without prior written permission.", "It may not be copied without  written\npermission of the owner",
                   "No part may not be reproduced, stored in a retrieval system or transmitted in any form or by any means, electronic, "
                   "mechanical, photocopying, recording or otherwise, without permission of the publisher."):
        got = licenses.scan_text(notice)
        assert [s["label"] for s in got["spans"]] == ["proprietary"] and got["score"] == 0.7
    assert not licenses.scan_text("It may not be copied. Do not enter without permission.")["spans"]


def test_base_phrases_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = "cc by all rights reserved general public license é x9".split()
    docs = [(i, "".join(rng.choice(vocabulary).upper() + rng.choice([" ", ".\n", "-"]) for _ in range(rng.randrange(0, 80)))) for i in range(60)] + [(61, None)]
    sf = folder(spark, documents=spark.createDataFrame(docs, "doc_id long, text string"))
    for r in rows(licenses.op9(spark, sf)):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), dict(docs)[r["doc_id"]] or ""))
        at, base = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i:i + len(p)] == p:
                    at.append(i)
                    base.add(label)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == \
            (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)))
        assert base <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


# ---------------------------------------------------------------- 10 WARC

@pytest.mark.parametrize("split", ["128m", "997"])
def test_warc_round_trip_with_forged_records(spark, split):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = ["<p>é</p>", None, "", "WARC/1.", "WARC/1.WARC/1.", "x" * 50 + fake + "WARC/1.0\r\n\r\ny", fake, "W" * 9 + "WARC\r\n\r\n",
              "WARC/1.WARC/WARC/1.0\r\nContent-Length: 9999\r\n\r\n" + "z" * 99]
    pages = [(i, f"http://x/{i}\r\nForged: 1", bodies[i % len(bodies)] if i % 2 else f"{i}{bodies[i % len(bodies)]}") for i in range(60)]
    path = scratch_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), path, records_per_file=20)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], split)
        spark.conf.set(names[1], "1")
        got = {r.id: r for r in warc.read_warc(spark, path).collect()}
    finally:
        for n, v in zip(names, was):
            spark.conf.set(n, v)
    assert len(got) == len(pages)
    first = {}
    for i, _, t in pages:
        first.setdefault(t or "", i)
    for i, _, t in pages:
        r, raw = got[f"<urn:page:{i}>"], (t or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r.digest == f"sha1:{digest}" and int(r.payload_length) == len(raw)
        if first[t or ""] == i:
            assert (r.type, r.own_digest, r.own_length) == ("response", digest, len(raw))
        else:
            assert (r.type, r.refers, r.own_length) == ("revisit", f"<urn:page:{first[t or '']}>", 0)


# ---------------------------------------------------------------- odd rows, empty tables

QUERIES = {"documents": [decontam.op3, jaccard.op5, suffix.op7, mixing.op8, licenses.op9, linededup.op1, quality.op2]}
STAGES = [quality.stage, linededup.stage, jaccard.stage, decontam.stage, mixing.stage]


@pytest.fixture(scope="module")
def odd_folder(spark, odd):
    clash = odd.withColumns({c: F.lit("mine") for c in ("score", "found", "size", "_quality", "shard", "cls", "n", "component", "at", "runs", "_key_", "block")})
    return folder(spark, documents=clash, benchmark=spark.createDataFrame([(1, None), (None, "no id")], "item_id long, text string"),
                  labels=spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("query", QUERIES["documents"], ids=lambda q: q.__module__.rpartition(".")[2])
def test_odd_rows_and_empty_tables(spark, odd_folder, query):
    assert query(spark, odd_folder).count() == len(ODD)
    none = folder(spark, documents=spark.createDataFrame([], DOCS), benchmark=spark.createDataFrame([], "item_id long, text string"),
                  labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert query(spark, none).collect() == []


@pytest.mark.parametrize("stage", STAGES, ids=lambda q: q.__module__.rpartition(".")[2])
def test_stages_carry_all_columns(spark, odd_folder, stage):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    out = stage(spark, docs, odd_folder)
    assert out.columns[:len(docs.columns)] == docs.columns
    got = rows(out)
    assert all(r[c] == "mine" for r in got for c in ("score", "found", "size", "shard"))
    assert stage(spark, docs.limit(0), odd_folder).collect() == []


def test_empty_conversations_and_pages(spark):
    sf = folder(spark, conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"),
                pages=spark.createDataFrame([], "page_id long, url string, html string"),
                embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert [r.conv_id for r in chat.op4(spark, sf).collect()] == [-7]
    assert warc.op10(spark, sf).count() == 0 and ann.op6(spark, sf).count() == 0


def test_null_pages(spark):
    sf = folder(spark, pages=spark.createDataFrame([(None, None, "a"), (3, None, "a"), (2, "u", None), (2, "u", None)],
                                                   "page_id long, url string, html string"))
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.op10(spark, sf).collect()), key=str)
    assert got == [(2, "response", None), (2, "response", None), (3, "response", None), (None, "revisit", 3)]

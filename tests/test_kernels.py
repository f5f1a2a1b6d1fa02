"""Numpy kernels against brute force (no Spark)."""

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from hyrank.functions import kernels
from hyrank.functions.text import HashEmbedder, hash_component_sql


def brute_topk(ids, scores, k):
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))
    return [ids[i] for i in order[:k]]


def test_select_topk_breaks_ties_by_id():
    ids = np.array([9, 3, 7, 1, 5])
    scores = np.array([0.5, 0.9, 0.5, 0.5, 0.1])
    sel = kernels.select_topk(ids, scores, 3)
    got = sorted(zip(-scores[sel], ids[sel]))
    assert [i for _, i in got] == [3, 1, 7]


def test_topk_buffer_equals_global_selection():
    rng = np.random.default_rng(1)
    ids = np.arange(500)
    scores = np.round(rng.integers(0, 20, 500) / 10.0, 6)   # many ties
    buf = kernels.TopKBuffer(np.array([0]), 17)
    for s in range(0, 500, 64):
        buf.add(0, ids[s:s + 64], scores[s:s + 64])
    out = buf.batch().to_pydict()
    got = [p for _, p in sorted(zip([-x for x in out["score"]], out["point_id"]))]
    assert got == brute_topk(list(ids), list(scores), 17)


def _brute_maxsim(doc, q):
    return sum(max(float(np.dot(qt, dt)) for dt in doc) for qt in q)


def test_maxsim_unequal_token_counts():
    rng = np.random.default_rng(2)
    docs = [rng.standard_normal((n, 4)) for n in (1, 3, 7, 2)]
    queries = [rng.standard_normal((n, 4)) for n in (2, 5)]
    toks = np.concatenate(docs)
    starts = np.cumsum([0] + [len(d) for d in docs[:-1]])
    qtok = np.concatenate(queries)
    qstarts = np.cumsum([0] + [len(q) for q in queries[:-1]])
    utok, inv = np.unique(qtok, axis=0, return_inverse=True)
    got = kernels._maxsim(toks, starts, utok, inv.reshape(-1), qstarts)
    for qi, q in enumerate(queries):
        for di, d in enumerate(docs):
            assert abs(got[qi, di] - _brute_maxsim(d, q)) < 1e-12


class _BC:
    def __init__(self, v):
        self.value = v


def _late_batch(ids, docs):
    arr = pa.array([[list(map(float, t)) for t in d] for d in docs], pa.list_(pa.list_(pa.float32())))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), arr], names=["point_id", "late"])


def test_late_topk_kernel_matches_brute_force():
    rng = np.random.default_rng(3)
    docs = [rng.standard_normal((int(n), 4)).astype(np.float32) for n in rng.integers(1, 6, 40)]
    queries = [rng.standard_normal((n, 4)) for n in (3, 1, 4)]
    qtok = np.concatenate(queries)
    qstarts = np.cumsum([0] + [len(q) for q in queries[:-1]])
    qids = np.array([10, 11, 12])
    run = kernels.late_topk_kernel(_BC((qids, qtok, qstarts)), 5)
    batches = [_late_batch(list(range(0, 20)), docs[:20]), _late_batch(list(range(20, 40)), docs[20:])]
    out = pa.Table.from_batches(list(run(iter(batches)))).to_pydict()
    for qi, q in zip(qids, queries):
        scores = [round(_brute_maxsim(d.astype(np.float64), q), 6) for d in docs]
        want = brute_topk(list(range(40)), scores, 5)
        got = [p for s, p in sorted((-s, p) for qq, p, s in zip(out["query_id"], out["point_id"], out["score"])
                                    if qq == qi)]
        assert got == want


def test_late_pair_kernel_matches_brute_force():
    rng = np.random.default_rng(4)
    docs = [rng.standard_normal((int(n), 4)).astype(np.float32) for n in rng.integers(1, 6, 10)]
    queries = [rng.standard_normal((n, 4)) for n in (2, 3)]
    qtok = np.concatenate(queries)
    qstarts = np.array([0, 2])
    qids = np.array([1, 2])
    cand = [[1], [2], [1, 2], [], [2], [1], [1, 2], [2], [1], [1, 2]]
    b = _late_batch(list(range(10)), docs)
    b = pa.RecordBatch.from_arrays(b.columns + [pa.array(cand, pa.list_(pa.int64()))],
                                   names=["point_id", "late", "qids"])
    out = pa.Table.from_batches(list(kernels.late_pair_kernel(_BC((qids, qtok, qstarts)))(iter([b])))).to_pydict()
    got = {(q, p): s for q, p, s in zip(out["query_id"], out["point_id"], out["score"])}
    want = {(qids[qi], p): round(_brute_maxsim(docs[p].astype(np.float64), queries[qi]), 6)
            for p, cs in enumerate(cand) for qi in range(2) if qids[qi] in cs}
    assert got.keys() == want.keys()
    for key in want:
        assert abs(got[key] - want[key]) < 1e-9


def test_hash_embedder_matches_sql_formula():
    emb = HashEmbedder(20)
    for tok in ["test", "éçà", "qa_2", "日本"]:
        v = emb.vectors([tok])[0]
        raw = hashlib.md5(f"0:{tok}".encode()).digest()
        assert abs(v[0] - (raw[0] - 127.5) / 127.5) < 1e-15
        for i in (0, 5, 15, 16, 19):
            sql = hash_component_sql("'" + tok + "'", i)
            assert abs(duckdb.connect().execute(f"SELECT {sql}").fetchone()[0] - v[i]) < 1e-12


def test_dense_embed_array_normalises_and_nulls_empty():
    emb = HashEmbedder(8)
    arr = kernels.dense_embed_array(pa.array([["a", "b", "a"], [], None], pa.list_(pa.string())), emb)
    vals = arr.to_pylist()
    assert vals[1] is None and vals[2] is None
    v = np.array(vals[0])
    assert abs(np.linalg.norm(v) - 1) < 1e-6
    want = 2 * emb.vectors(["a"])[0] + emb.vectors(["b"])[0]
    assert np.allclose(v, want / np.linalg.norm(want), atol=1e-6)


def test_late_topk_screened_path_is_exact():
    """k small next to the batch takes the float32 screen; compare to float64."""
    rng = np.random.default_rng(9)
    def unit(m):
        return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    docs = [unit(rng.standard_normal((int(n), 16))) for n in rng.integers(1, 30, 400)]
    docs += [docs[5].copy() for _ in range(6)]                      # exact ties
    queries = [unit(rng.standard_normal((n, 16))).astype(np.float64) for n in (12, 3, 30)]
    qtok = np.concatenate(queries)
    qstarts = np.cumsum([0] + [len(q) for q in queries[:-1]])
    qids = np.array([1, 2, 3])
    run = kernels.late_topk_kernel(_BC((qids, qtok, qstarts)), 7)
    out = pa.Table.from_batches(list(run(iter([_late_batch(list(range(len(docs))), docs)])))).to_pydict()
    for qi, q in zip(qids, queries):
        scores = [round(_brute_maxsim(d.astype(np.float64), q), 6) for d in docs]
        want = brute_topk(list(range(len(docs))), scores, 7)
        got = [p for s, p in sorted((-s, p) for qq, p, s in zip(out["query_id"], out["point_id"], out["score"])
                                    if qq == qi)]
        assert got == want


def test_late_pair_kernel_topk_screen_is_exact():
    rng = np.random.default_rng(10)
    def unit(m):
        return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    docs = [unit(rng.standard_normal((int(n), 16))) for n in rng.integers(1, 20, 120)]
    docs += [docs[3].copy() for _ in range(4)]
    queries = [unit(rng.standard_normal((n, 16))).astype(np.float64) for n in (9, 2)]
    qtok = np.concatenate(queries)
    qstarts = np.array([0, 9])
    qids = np.array([5, 6])
    cand = [[5, 6] if p % 3 else [5] for p in range(len(docs))]
    b = _late_batch(list(range(len(docs))), docs)
    b = pa.RecordBatch.from_arrays(b.columns + [pa.array(cand, pa.list_(pa.int64()))],
                                   names=["point_id", "late", "qids"])
    out = pa.Table.from_batches(list(kernels.late_pair_kernel(_BC((qids, qtok, qstarts)), k=5)(iter([b])))).to_pydict()
    for qi, q in zip(qids, queries):
        ps = [p for p, c in enumerate(cand) if qi in c]
        scores = [round(_brute_maxsim(docs[p].astype(np.float64), q), 6) for p in ps]
        want = brute_topk(ps, scores, 5)
        got = [p for s, p in sorted((-s, p) for qq, p, s in zip(out["query_id"], out["point_id"], out["score"])
                                    if qq == qi)]
        assert got == want


@pytest.mark.parametrize("dim", [16, 128])
@pytest.mark.parametrize("scale", [1.0, 1000.0])
def test_late_screen_is_exact_for_any_norm_and_dimension(dim, scale):
    """Near ties: the float32 screen must not lose a true hit."""
    rng = np.random.default_rng(dim)
    base = rng.standard_normal(dim)
    toks = (base + 1e-6 * rng.standard_normal((2000, dim))).astype(np.float32)
    q = scale * rng.standard_normal((4, dim))
    sims = q @ toks.astype(np.float64).T
    exact = kernels.round_scores(sims.sum(axis=0))
    want = sorted(np.lexsort((np.arange(2000), -exact))[:10].tolist())
    bc = type("B", (), {"value": (np.array([0]), q, np.array([0]))})()
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), pa.array([[t] for t in toks.tolist()], pa.list_(pa.list_(pa.float32())))],
                                   names=["point_id", "late"])
    got = [r for out in kernels.late_topk_kernel(bc, 10)(iter([b])) for r in out.column("point_id").to_pylist()]
    assert sorted(got) == want


def test_wrong_dimension_raises():
    bc = type("B", (), {"value": (np.array([0]), np.ones((1, 16)))})()
    b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([[1.0] * 32])], names=["point_id", "dense"])
    with pytest.raises(ValueError, match="32 dimensions searched with 16"):
        list(kernels.dense_topk_kernel(bc, 3, None)(iter([b])))


def test_embedder_caches_bytes_and_makes_the_same_vectors():
    from hyrank.functions.text import _token_vector
    toks = [f"t{i % 70}" for i in range(200)] + ["Äpfel", ""]
    for dim in (8, 16, 20, 32):
        emb = HashEmbedder(dim, cache_size=50)              # smaller than the vocabulary: it is emptied in between
        got = emb.vectors(toks)
        assert got.dtype == np.float64 and np.array_equal(got, np.stack([_token_vector(t, dim) for t in toks]))
        assert 0 < len(emb._cache) <= 50
        assert all(isinstance(v, bytes) and len(v) <= dim + 15 for v in emb._cache.values())
    assert HashEmbedder(32).vectors([]).shape == (0, 32)


def test_late_embedding_gathers_in_the_stored_precision():
    """2^18 tokens of 1000 kinds: 16 MB of float32 vectors, not three times 32 MB of float64."""
    import tracemalloc
    col = pa.array([[f"t{(31 * i + j) % 1000}" for j in range(32)] for i in range(8192)], pa.list_(pa.string()))
    emb = HashEmbedder(16)
    tracemalloc.start()
    got = kernels.late_embed_array(col, emb)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    v = emb.vectors(["t7"])[0]
    assert got[0][7].as_py() == (v / np.linalg.norm(v)).astype(np.float32).tolist()


def test_maxsim_blocks_fit_a_core_s_cache_and_change_nothing(monkeypatch):
    assert kernels.LATE_QBLOCK * kernels.LATE_TILE * 4 <= 1 << 20
    rng = np.random.default_rng(5)
    u, t = rng.standard_normal((300, 16)), rng.standard_normal((5000, 16))
    starts = np.arange(0, 5000, 37)
    want = np.stack([np.stack([(u @ t[lo:lo + 37].T).max(axis=1)]) for lo in starts], axis=2)[0]
    for q, tile in ((kernels.LATE_QBLOCK, kernels.LATE_TILE), (7, 100), (1000, 10_000)):
        monkeypatch.setattr(kernels, "LATE_QBLOCK", q)
        assert np.allclose(kernels._segment_max(u, t, starts), want, rtol=0, atol=1e-12)
        runs = list(kernels._doc_chunks(starts, 5000, tile))
        assert [i for i, _ in runs[1:]] == [j for _, j in runs[:-1]] and runs[-1][1] == len(starts)

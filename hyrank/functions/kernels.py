"""Arrow/numpy batch kernels run inside ``mapInArrow`` tasks.

Spark partitions and shuffles the work; these functions only turn one
Arrow batch (a slice of one partition) into another. The query side
arrives as a broadcast variable whose size the caller has checked.

Vectors are stored as float32 and computed on as float64.
Scores are rounded to 6 decimals *before* any selection so that ties
(exact copies of documents are common) are broken the same way
everywhere: score descending, then point id ascending.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hyrank.functions.text import HashEmbedder

SCORE_DECIMALS = 6

HIT_SCHEMA = pa.schema([("query_id", pa.int64()), ("point_id", pa.int64()), ("score", pa.float64())])


def round_scores(x: np.ndarray) -> np.ndarray:
    """Round to SCORE_DECIMALS; ``+ 0.0`` turns -0.0 into 0.0 (canonical zero)."""
    return np.round(x, SCORE_DECIMALS) + 0.0


def select_topk(ids: np.ndarray, scores: np.ndarray, k: int | None) -> np.ndarray:
    """Indices of the k best (score desc, id asc); exact at the boundary."""
    n = len(scores)
    if k is None or n <= k:
        return np.arange(n)
    kth = np.partition(scores, n - k)[n - k]
    gt = np.flatnonzero(scores > kth)
    eq = np.flatnonzero(scores == kth)
    need = k - len(gt)
    if len(eq) > need:
        eq = eq[np.argsort(ids[eq], kind="stable")[:need]]
    return np.concatenate([gt, eq])


class TopKBuffer:
    """Running per-query top-k over the batches of one partition."""

    def __init__(self, qids: np.ndarray, k: int | None):
        self.qids = qids
        self.k = k
        self.ids = [np.empty(0, np.int64) for _ in qids]
        self.scores = [np.empty(0, np.float64) for _ in qids]

    def add(self, qi: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids) == 0:
            return
        sel = select_topk(ids, scores, self.k)
        ids, scores = ids[sel], scores[sel]
        if len(self.ids[qi]):
            ids = np.concatenate([self.ids[qi], ids])
            scores = np.concatenate([self.scores[qi], scores])
            sel = select_topk(ids, scores, self.k)
            ids, scores = ids[sel], scores[sel]
        self.ids[qi], self.scores[qi] = ids, scores

    def bound(self, qi: int) -> float:
        """The k-th best score so far; nothing below it can enter any more."""
        s = self.scores[qi]
        return float(s.min()) if self.k is not None and len(s) >= self.k > 0 else -np.inf

    def batch(self) -> pa.RecordBatch | None:
        n = [len(x) for x in self.ids]
        if sum(n) == 0:
            return None
        q = np.repeat(self.qids, n)
        return pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int64()), pa.array(np.concatenate(self.ids), pa.int64()),
             pa.array(np.concatenate(self.scores), pa.float64())], schema=HIT_SCHEMA)


def _flat_vectors(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-null rows of a list<double> column -> (row idx, matrix); another size than ``dim`` is an error."""
    col = col.cast(pa.list_(pa.float64())) if col.type != pa.list_(pa.float64()) else col
    lengths = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ok = np.flatnonzero(~col.is_null().to_numpy(zero_copy_only=False))
    if len(ok) == 0:
        return ok, np.empty((0, dim))
    if np.any(lengths[ok] != dim):
        raise ValueError(f"vector of {int(lengths[ok][lengths[ok] != dim][0])} dimensions searched with {dim}")
    if len(ok) == len(col) and col.null_count == 0:
        vals = col.flatten().to_numpy(zero_copy_only=False)
        return ok, vals.reshape(len(col), dim)
    sub = col.take(pa.array(ok))
    return ok, sub.flatten().to_numpy(zero_copy_only=False).reshape(len(ok), dim)


def _unpacked(inner: pa.Array, dim: int) -> np.ndarray:
    """Binary values of ``dim`` float32 each -> matrix."""
    flat = inner.cast(pa.binary(4 * dim))
    return np.frombuffer(flat.buffers()[1], np.float32)[flat.offset * dim:(flat.offset + len(flat)) * dim].reshape(-1, dim)


def packed_tokens(vectors: np.ndarray, per_row: np.ndarray, null_rows: np.ndarray) -> pa.Array:
    """list<binary>: each token vector as the bytes of its float32 components. Equal tokens are equal values, so
    Parquet's dictionary holds a vector once a file (see plans.collection)."""
    raw = np.ascontiguousarray(vectors, dtype="<f4")
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * vectors.shape[1]), len(raw), [None, pa.py_buffer(raw)])
    off = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), fixed.cast(pa.binary()), mask=pa.array(null_rows))


def pack_kernel(col: str):
    """Rows with ``col`` array<array<float>> -> the same, token vectors packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_tok = b.column(col).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            inner = b.column(col).flatten()
            # rows of other dimensions than the rest were rejected before
            dim = int(inner.value_lengths()[0].as_py()) if len(inner) else 1
            mat = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
            new = packed_tokens(mat, n_tok, b.column(col).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([new if n == col else b.column(n) for n in b.schema.names], names=b.schema.names)
    return run


def sliced(batch: pa.RecordBatch, tok_col: str, tokens: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``tokens`` tokens (one row at least), so that what a kernel holds follows
    the tokens, not Arrow's number of rows."""
    tokens = tokens or GATHER
    ends = np.cumsum(batch.column(tok_col).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + tokens, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _flat_multivectors(col: pa.Array, dim: int):
    """list<list<double>> or list<binary> -> (row idx of non-empty rows, token matrix, token starts)."""
    n_tok = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ok = np.flatnonzero(n_tok > 0)
    if len(ok) == 0:
        return ok, np.empty((0, dim)), np.empty(0, np.int64)
    sub = col if len(ok) == len(col) else col.take(pa.array(ok))
    inner = sub.flatten()
    packed = pa.types.is_binary(inner.type) or pa.types.is_large_binary(inner.type)
    inner_len = (pc.divide(pc.binary_length(inner), 4) if packed else inner.value_lengths()).fill_null(0).to_numpy(zero_copy_only=False)
    if np.any(inner_len != dim):
        raise ValueError(f"token vector of {int(inner_len[inner_len != dim][0])} dimensions searched with {dim}")
    if packed:
        tokens = _unpacked(inner, dim)
    else:
        tokens = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    starts = np.concatenate([[0], np.cumsum(n_tok[ok])[:-1]]).astype(np.int64)
    return ok, tokens, starts


def number_kernel(group: list[str]):
    """Rows in order -> the same with the partition's number (``_part``) and a count from 1 within each run of equal groups (``_local``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for c in group:
                col = b.column(c)
                same = pc.fill_null(pc.equal(col.slice(1), col.slice(0, b.num_rows - 1)), False).to_numpy(zero_copy_only=False)
                null = col.is_null().to_numpy(zero_copy_only=False)
                new[1:] |= ~(same | (null[1:] & null[:-1]))
            first = [b.column(c)[0].as_py() for c in group]
            at = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(new, at, 0))
            local = at - start + 1
            if last == first:
                local[start == 0] += seen
            last, seen = [b.column(c)[b.num_rows - 1].as_py() for c in group], int(local[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(local)],
                                             names=[*b.schema.names, "_part", "_local"])
    return run


# ---------------------------------------------------------------------------
# Dense: cosine top-k (vectors are unit length, so cosine = dot product)
# ---------------------------------------------------------------------------

def dense_topk_kernel(bc, k: int | None, threshold: float | None,
                      id_col: str = "point_id", vec_col: str = "dense", after: list | None = None):
    """Local top-k. ``after``: for each query the (score, id) behind which hits count (search-after)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qmat = bc.value
        dim = qmat.shape[1]
        buf = TopKBuffer(qids, k)
        for b in batches:
            ids_all = b.column(id_col).to_numpy(zero_copy_only=False)
            rows, mat = _flat_vectors(b.column(vec_col), dim)
            if len(rows) == 0:
                continue
            ids = ids_all[rows]
            step = TOKEN_TILE          # points per tile: (256 x 4096) scores stay cache-sized
            for s in range(0, len(ids), step):
                tid = ids[s:s + step]
                for q in range(0, len(qids), QBLOCK):
                    for qi, row in enumerate(round_scores(qmat[q:q + QBLOCK] @ mat[s:s + step].T), q):
                        low = buf.bound(qi) if threshold is None else max(threshold, buf.bound(qi))
                        if after is not None:
                            score, pid = after[qi]
                            keep = np.flatnonzero((row >= low) & ((row < score) | ((row == score) & (tid > pid))))
                            buf.add(qi, tid[keep], row[keep])
                        elif low > -np.inf:
                            keep = np.flatnonzero(row >= low)
                            buf.add(qi, tid[keep], row[keep])
                        else:
                            buf.add(qi, tid, row)
                if k is None:
                    # no limit: nothing to merge, so stream hits out per tile
                    out = buf.batch()
                    buf = TopKBuffer(qids, k)
                    if out is not None:
                        yield out
        out = buf.batch()
        if out is not None:
            yield out
    return run


def dense_block_kernel(k: int, seen: str | None = None):
    """Local top-k of each pair of blocks. Rows (qb, pb, side, id, v) come sorted; a pair's queries (side 0) lead.

    Tiles are scored in float32; only pairs that can be among a query's k best (``screen_margin``) are
    scored in float64. ``seen``: a column of bucket numbers, one a hash table; a pair of rows that meets in several
    tables leaves with the first (the number of the table is ``qb`` div BLOCK_SHIFT).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, mats, sigs, buf, first = None, [], [], [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            qb, pb, side, all_ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("qb", "pb", "side", "id"))
            sig = b.column(seen).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if seen else None
            change = np.flatnonzero((qb[1:] != qb[:-1]) | (pb[1:] != pb[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip(np.append(0, change).tolist(), np.append(change, b.num_rows).tolist()):
                if (qb[lo], pb[lo]) != key:
                    out = (first or buf).batch() if buf is not None else None
                    if out is not None:
                        yield out
                    key, asked, mats, sigs, buf, first = (qb[lo], pb[lo]), [], [], [], None, None
                vectors = b.column("v").slice(lo, hi - lo)
                if side[lo] == 0:
                    rows, mat = _flat_vectors(vectors, mats[0].shape[1] if mats else len(vectors[0]))
                    asked.append(all_ids[lo:hi][rows])
                    mats.append(mat.astype(np.float64))
                    if seen:
                        sigs.append(sig[lo:hi][rows])
                    continue
                if not asked:
                    continue
                if buf is None:
                    qids, qmat = np.concatenate(asked).astype(np.int64), np.concatenate(mats)
                    qmat32, qnorms, bounds = qmat.astype(np.float32), token_norms(qmat), np.full(len(qids), -np.inf)
                    buf, first = TopKBuffer(qids, k), TopKBuffer(qids, k) if seen else None
                    qsig, table = np.concatenate(sigs) if seen else None, int(key[0]) // BLOCK_SHIFT
                rows, mat = _flat_vectors(vectors, qmat.shape[1])
                if not len(rows):
                    continue
                ids, psig = all_ids[lo:hi][rows], sig[lo:hi][rows] if seen else None
                for s in range(0, len(ids), TOKEN_TILE):
                    tile, tid = mat[s:s + TOKEN_TILE], ids[s:s + TOKEN_TILE]
                    tile32, longest = np.ascontiguousarray(tile.T, np.float32), float(token_norms(tile).max())
                    for q in range(0, len(qids), QBLOCK):
                        near = qmat32[q:q + QBLOCK] @ tile32
                        low = bounds[q:q + QBLOCK].copy()
                        new = np.flatnonzero(low == -np.inf)
                        if len(new) and len(tid) > k:
                            low[new] = np.partition(near[new], len(tid) - k, axis=1)[:, len(tid) - k]
                        margin = 4 * (qmat.shape[1] + 3) * 2.0 ** -24 * longest * qnorms[q:q + QBLOCK] + 10.0 ** -SCORE_DECIMALS
                        hit = np.flatnonzero(near >= (low - margin)[:, None])
                        row, col = hit // len(tid), hit % len(tid)
                        edge = np.searchsorted(row, np.arange(len(low) + 1))
                        for r in np.unique(row).tolist():
                            at, qi = col[edge[r]:edge[r + 1]], q + r
                            score = round_scores(tile[at] @ qmat[qi])
                            buf.add(qi, tid[at], score)
                            bounds[qi] = buf.bound(qi)
                            if seen:
                                own = ~(psig[s:s + TOKEN_TILE][at, :table] == qsig[qi, :table]).any(axis=1)
                                first.add(qi, tid[at][own], score[own])
        out = (first or buf).batch() if buf is not None else None
        if out is not None:
            yield out
    return run


# ---------------------------------------------------------------------------
# Late interaction: MaxSim = sum over query tokens of max over doc tokens
# ---------------------------------------------------------------------------

BLOCK_SHIFT = 1 << 32   # block numbers: table or bucket times this, plus the part of it
GATHER = 1 << 18   # token vectors an embedder gathers at once
QBLOCK = 256        # query-token rows per GEMM block
QUERY_TILE = 1024   # queries whose scores against a batch exist at once
TOKEN_TILE = 4096   # document tokens per tile: a 256 x 4096 block stays cache-resident
LATE_QBLOCK, LATE_TILE = 128, 2048      # query tokens x document tokens of a MaxSim block: 1 MB of float32, written and reduced in a core's own cache


def _segment_max(u: np.ndarray, t: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """max over each document's tokens of u . t -> (len(u), len(starts)), blocked
    so every similarity block is reduced while it is still in cache."""
    tt = np.ascontiguousarray(t.T)
    out = np.empty((len(u), len(starts)), dtype=np.result_type(u, t))
    for q0 in range(0, len(u), LATE_QBLOCK):
        out[q0:q0 + LATE_QBLOCK] = np.maximum.reduceat(u[q0:q0 + LATE_QBLOCK] @ tt, starts, axis=1)
    return out


def _maxsim(tokens: np.ndarray, starts: np.ndarray, utok: np.ndarray, tok_index: np.ndarray,
            qstarts: np.ndarray) -> np.ndarray:
    """(n_queries x n_docs) MaxSim for documents given as stacked token rows.

    Similarities are computed once per *distinct* query token (``utok``),
    then gathered per query token via ``tok_index``. Laid out
    query-token-major so both reductions run along contiguous memory.
    """
    per_doc = _segment_max(utok, tokens, starts).astype(np.float64, copy=False)     # (n_utok, n_docs)
    return np.add.reduceat(per_doc[tok_index], qstarts, axis=0)    # (n_queries, n_docs)


def _doc_chunks(starts: np.ndarray, n_tok_total: int, budget: int = LATE_TILE):
    """Split documents into runs of about ``budget`` tokens (one doc at least)."""
    ends = np.append(starts[1:], n_tok_total)
    i = 0
    n = len(starts)
    while i < n:
        j = int(np.searchsorted(ends, starts[i] + budget, side="right"))
        j = max(j, i + 1)
        yield i, min(j, n)
        i = min(j, n)


def token_norms(toks: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", toks, toks, dtype=np.float64))


def screen_margin(qnorms: np.ndarray, dim: int, longest: float) -> float:
    """How far a query's float32 MaxSim can move a document across another.

    A float32 dot product of d terms, operands rounded to float32 first, is
    off by at most (d + 3) * 2^-24 * |a| * |b| (to first order; taken
    twice). A maximum moves no more than its terms, the sum adds up over the
    query's tokens, and two documents can move towards each other. The last
    term is the rounding of scores. ``qnorms``: norms of the query's tokens;
    ``longest``: the largest norm of the documents' tokens, taken once a batch.
    """
    total = float(qnorms.sum())
    sums = len(qnorms) * 2.0 ** -24 * total * longest          # adding up the maxima
    return 2 * (2 * (dim + 3) * 2.0 ** -24 * total * longest + sums) + 10.0 ** -SCORE_DECIMALS


def _maxsim_tiled(toks: np.ndarray, starts: np.ndarray, utok: np.ndarray, tok_index: np.ndarray,
                  qstarts: np.ndarray) -> np.ndarray:
    """(n_queries x n_docs) MaxSim in the precision of ``utok``, summed in float64, by runs of documents:
    only (distinct query tokens x documents of a run) maxima exist at once."""
    out = np.empty((len(qstarts), len(starts)))
    for i, j in _doc_chunks(starts, len(toks)):
        t0 = starts[i]
        t1 = starts[j] if j < len(starts) else len(toks)
        out[:, i:j] = _maxsim(toks[t0:t1].astype(utok.dtype, copy=False), starts[i:j] - t0, utok, tok_index, qstarts)
    return out


def late_topk_kernel(bc, k: int | None, id_col: str = "point_id", vec_col: str = "late"):
    """Exact MaxSim top-k per query over one partition.

    When k is small next to the batch, every document is first scored in
    float32 (a third of the GEMM cost); a document can only be in the exact
    top-k if its float32 score is within ``screen_margin`` of the k-th best
    float32 score of the batch and of the k-th best score so far, and only
    those are rescored in float64. The margin follows the dimension and the
    norms of the vectors at hand.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qtok, qstarts = bc.value
        dim = qtok.shape[1]
        qnorms = token_norms(qtok)
        qends = np.append(qstarts[1:], len(qtok))
        groups = []                 # queries scored together: bounds (queries x documents of a batch)
        for g in range(0, len(qids), QUERY_TILE):
            own = qstarts[g:g + QUERY_TILE]
            utok, tok_index = np.unique(qtok[own[0]:qends[g + len(own) - 1]], axis=0, return_inverse=True)
            groups.append((g, utok, tok_index.reshape(-1), own - own[0]))
        buf = TopKBuffer(qids, k)
        for b in batches:
            ids_all = b.column(id_col).to_numpy(zero_copy_only=False)
            rows, toks, starts = _flat_multivectors(b.column(vec_col), dim)
            if len(rows) == 0:
                continue
            ids = ids_all[rows]
            n = len(ids)
            screened = k is not None and n > 4 * k
            lens = np.diff(np.append(starts, len(toks)))
            longest = float(token_norms(toks).max())
            for g, utok, tok_index, own in groups:
                if not screened:
                    scores = round_scores(_maxsim_tiled(toks, starts, utok, tok_index, own))
                    for qi, row in enumerate(scores, g):
                        buf.add(qi, ids, row)
                    continue
                for qi, a in enumerate(_maxsim_tiled(toks, starts, utok.astype(np.float32), tok_index, own), g):
                    span = slice(qstarts[qi], qends[qi])
                    kth = max(np.partition(a, n - k)[n - k], buf.bound(qi))
                    cand = np.flatnonzero(a >= kth - screen_margin(qnorms[span], dim, longest))
                    if not len(cand):
                        continue
                    idx, st = _gather_tokens(starts, lens, cand)
                    exact = np.maximum.reduceat(qtok[span] @ toks[idx].astype(np.float64).T, st, axis=1).sum(axis=0)
                    buf.add(qi, ids[cand], round_scores(exact))
            if k is None:
                out = buf.batch()
                buf = TopKBuffer(qids, k)
                if out is not None:
                    yield out
        out = buf.batch()
        if out is not None:
            yield out
    return run


def _gather_tokens(starts: np.ndarray, lens: np.ndarray, sel: np.ndarray):
    """Token row indices of documents ``sel`` (vectorised ranges) + their starts."""
    ln = lens[sel]
    new_starts = np.concatenate([[0], np.cumsum(ln)[:-1]]).astype(np.int64)
    idx = np.repeat(starts[sel] - new_starts, ln) + np.arange(int(ln.sum()))
    return idx, new_starts


def _pair_scores(qt: np.ndarray, toks: np.ndarray, starts: np.ndarray, lens: np.ndarray, sel: np.ndarray,
                 k: int | None, margin: float = 0.0, bound: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Exact MaxSim of one query against documents ``sel`` (rows of the batch); with k, only a
    superset of the top-k (float32 screen by ``margin``; ``bound``: the k-th best so far) is scored exactly."""
    qt32 = qt.astype(np.float32)
    budget = max(TOKEN_TILE, QBLOCK * TOKEN_TILE // len(qt))
    if k is not None and len(sel) > 4 * k:
        approx = np.empty(len(sel))
        c0 = 0
        while c0 < len(sel):
            csum = np.cumsum(lens[sel[c0:]])
            c1 = c0 + max(1, int(np.searchsorted(csum, budget, side="right")))
            idx, st = _gather_tokens(starts, lens, sel[c0:c1])
            m = _segment_max(qt32, toks[idx], st)
            approx[c0:c1] = m.astype(np.float64).sum(axis=0)
            c0 = c1
        n = len(sel)
        kth = max(np.partition(approx, n - k)[n - k], bound)
        sel = sel[approx >= kth - margin]
    out = np.empty(len(sel))
    c0 = 0
    while c0 < len(sel):
        csum = np.cumsum(lens[sel[c0:]])
        c1 = c0 + max(1, int(np.searchsorted(csum, budget, side="right")))
        idx, st = _gather_tokens(starts, lens, sel[c0:c1])
        out[c0:c1] = _segment_max(qt, toks[idx].astype(np.float64), st).sum(axis=0)
        c0 = c1
    return sel, round_scores(out)


def late_pair_kernel(bc, vec_col: str = "late", qids_col: str = "qids", k: int | None = None):
    """MaxSim for candidate pairs; each point row carries its candidate query ids.

    A point's vectors cross into Python once however many queries selected
    it. With ``k`` only each query's partition-local top-k leaves the task
    (the global top-k is within their union), found with the exact float32
    screen; without ``k`` every pair is scored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qtok, qstarts = bc.value
        dim = qtok.shape[1]
        qends = np.append(qstarts[1:], len(qtok))
        order_q = np.argsort(qids)
        qnorms = token_norms(qtok)
        buf = TopKBuffer(qids, k) if k is not None else None
        for b in batches:
            p_all = b.column("point_id").to_numpy(zero_copy_only=False)
            rows, toks, starts = _flat_multivectors(b.column(vec_col), dim)
            if len(rows) == 0:
                continue
            lens = np.diff(np.append(starts, len(toks)))
            qcol = b.column(qids_col).take(pa.array(rows))
            nq = qcol.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            pair_q = qcol.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            pair_r = np.repeat(np.arange(len(rows)), nq)
            # map query ids to positions in this block; drop pairs of other blocks
            pos = np.clip(np.searchsorted(qids[order_q], pair_q), 0, len(qids) - 1)
            found = qids[order_q][pos] == pair_q
            pair_qi, pair_r = order_q[pos[found]], pair_r[found]
            if len(pair_qi) == 0:
                continue
            o = np.argsort(pair_qi, kind="stable")
            pair_qi, pair_r = pair_qi[o], pair_r[o]
            cuts = np.flatnonzero(np.diff(pair_qi)) + 1
            out_q, out_p, out_s = [], [], []
            longest = float(token_norms(toks).max()) if k is not None else 0.0
            for g0, g1 in zip(np.r_[0, cuts], np.r_[cuts, len(pair_qi)]):
                qi = pair_qi[g0]
                if qends[qi] == qstarts[qi]:
                    continue
                span = slice(qstarts[qi], qends[qi])
                margin, bound = (0.0, -np.inf) if buf is None else (screen_margin(qnorms[span], dim, longest), buf.bound(qi))
                sel, sc = _pair_scores(qtok[span], toks, starts, lens, pair_r[g0:g1], k, margin, bound)
                if buf is not None:
                    buf.add(qi, p_all[rows[sel]], sc)
                else:
                    out_q.append(np.full(len(sel), qids[qi], np.int64))
                    out_p.append(p_all[rows[sel]])
                    out_s.append(sc)
            if out_q:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_q), pa.int64()), pa.array(np.concatenate(out_p), pa.int64()),
                     pa.array(np.concatenate(out_s), pa.float64())], schema=HIT_SCHEMA)
        if buf is not None:
            out = buf.batch()
            if out is not None:
                yield out
    return run


# ---------------------------------------------------------------------------
# Embedders (default: hashing embedder; any callable tokens -> matrix works)
# ---------------------------------------------------------------------------

def _list_of_lists(values: np.ndarray, inner_len: np.ndarray, outer_len: np.ndarray,
                   null_rows: np.ndarray) -> pa.Array:
    inner_off = np.concatenate([[0], np.cumsum(inner_len)]).astype(np.int32)
    outer_off = np.concatenate([[0], np.cumsum(outer_len)]).astype(np.int32)
    inner = pa.ListArray.from_arrays(pa.array(inner_off), pa.array(values.astype(np.float32, copy=False), pa.float32()))
    return pa.ListArray.from_arrays(pa.array(outer_off), inner, mask=pa.array(null_rows))


def _vectors(col: np.ndarray, lengths: np.ndarray, null_rows: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(col.astype(np.float32), pa.float32()),
                                    mask=pa.array(null_rows))


def _token_matrix(tok_col: pa.Array, emb: HashEmbedder):
    n_tok = tok_col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tok_col.flatten()
    uniq = flat.unique()
    idx = pc.index_in(flat, value_set=uniq).to_numpy(zero_copy_only=False)
    vecs = emb.vectors(uniq.to_pylist())
    return n_tok, vecs, idx


def dense_embed_array(tok_col: pa.Array, emb: HashEmbedder, normalize: bool = True) -> pa.Array:
    """Sum of token vectors over the whole text, then L2-normalised."""
    dim = emb.dim
    n_tok, vecs, idx = _token_matrix(tok_col, emb)
    n = len(n_tok)
    out = np.zeros((n, dim))
    if len(idx):
        # sum per row via reduceat over each row's contiguous token run
        nz = np.flatnonzero(n_tok > 0)
        starts = np.concatenate([[0], np.cumsum(n_tok)[:-1]])[nz]
        out[nz] = np.add.reduceat(vecs[idx], starts, axis=0)
    norms = np.linalg.norm(out, axis=1)
    null_rows = norms == 0
    if normalize:
        out = out / np.where(null_rows, 1.0, norms)[:, None]
    lengths = np.where(null_rows, 0, dim)
    return _vectors(out[~null_rows].ravel(), lengths, null_rows)


def _unit_tokens(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct token vectors at unit length in the stored precision, and which of them are not zero."""
    norms = np.linalg.norm(vecs, axis=1)
    good = norms > 0
    return (vecs / np.where(good, norms, 1.0)[:, None]).astype(np.float32), good


def late_embed_array(tok_col: pa.Array, emb: HashEmbedder) -> pa.Array:
    """One L2-normalised hash vector per token (tokens already deduplicated)."""
    dim = emb.dim
    n_tok, vecs, idx = _token_matrix(tok_col, emb)
    unit, some = _unit_tokens(vecs)
    good = some[idx] if len(idx) else np.zeros(0, bool)
    t = unit[idx[good]] if len(idx) else np.empty((0, dim), np.float32)
    row = np.repeat(np.arange(len(n_tok)), n_tok)
    per_row = np.bincount(row[good], minlength=len(n_tok)) if len(row) else np.zeros(len(n_tok), np.int64)
    null_rows = per_row == 0
    return _list_of_lists(t.ravel(), np.full(len(t), dim), per_row, null_rows)


def embedder(dim: int) -> HashEmbedder:
    """The worker's hashing embedder; its token cache outlives the task."""
    if dim not in _EMBEDDERS:
        _EMBEDDERS[dim] = HashEmbedder(dim)
    return _EMBEDDERS[dim]


_EMBEDDERS: dict[int, HashEmbedder] = {}


def sparse_batch(tok_col: pa.Array):
    """(terms, tf, dl, names): each row's distinct tokens and their counts as lists, its number of tokens, and
    what the rows' terms are made of: (row of each term, its place in names, offsets)."""
    n_tok = tok_col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tok_col.flatten()
    coded = flat.dictionary_encode()
    names = coded.dictionary
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key, tf = np.unique(np.repeat(np.arange(len(n_tok)), n_tok) * max(1, len(names)) + code, return_counts=True)
    row, term = key // max(1, len(names)), key % max(1, len(names))
    off = np.searchsorted(row, np.arange(len(n_tok) + 1))
    return n_tok, names, row, term, tf, off


def embed_batch(tok_col: pa.Array, emb: HashEmbedder, late_dim: int, packed: bool = False):
    """(terms, tf, dl, dense, late) of a batch of token lists, from one token dictionary.

    Component i of the hashing embedder does not depend on the dimension, so
    a token's late vector is the first ``late_dim`` components of its dense
    token vector: one md5 pass serves both. Late vectors are one per distinct
    token of each row (MaxSim ignores repeats and order). Token vectors are gathered
    for about ``GATHER`` terms at a time. ``packed``: late vectors as ``packed_tokens``.
    """
    n_tok, names, row, term, tf, off = sparse_batch(tok_col)
    vecs = emb.vectors(names.to_pylist())
    unit, some = _unit_tokens(vecs[:, :late_dim])
    n, dim = len(n_tok), emb.dim
    lists = pa.array(off.astype(np.int32))
    terms = pa.ListArray.from_arrays(lists, names.take(pa.array(term)))
    counts = pa.ListArray.from_arrays(lists, pa.array(tf.astype(np.int32)))
    dense = np.zeros((n, dim))
    late_parts, per_row = [np.empty((0, late_dim), np.float32)], np.zeros(n, np.int64)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + GATHER, "right")) - 1)
        span = slice(off[lo], off[hi])
        if off[hi] > off[lo]:
            full = lo + np.flatnonzero(np.diff(off[lo:hi + 1]))
            own = vecs[term[span]]
            dense[full] = np.add.reduceat(own * tf[span, None], off[full] - off[lo], axis=0)
            good = some[term[span]]
            late_parts.append(unit[term[span][good]])
            per_row += np.bincount(row[span][good], minlength=n)
        lo = hi
    norms = np.linalg.norm(dense, axis=1)
    null_d = norms == 0
    dense = dense / np.where(null_d, 1.0, norms)[:, None]
    dense_arr = _vectors(dense[~null_d].ravel(), np.where(null_d, 0, dim), null_d)
    late_vals = np.concatenate(late_parts)
    if packed:
        late_arr = packed_tokens(late_vals, per_row, per_row == 0)
    else:
        late_arr = _list_of_lists(late_vals.ravel(), np.full(len(late_vals), late_dim), per_row, per_row == 0)
    return terms, counts, n_tok, dense_arr, late_arr


def dense_embed_kernel(dim: int, id_col: str, tok_col: str, out_col: str, normalize: bool = True):
    def run(batches):
        emb = embedder(dim)
        for whole in batches:
            for b in sliced(whole, tok_col):
                yield pa.RecordBatch.from_arrays([b.column(id_col), dense_embed_array(b.column(tok_col), emb, normalize)],
                                                 names=[id_col, out_col])
    return run


def late_embed_kernel(dim: int, id_col: str, tok_col: str, out_col: str, keep: str | None = None):
    """``keep``: the tokens come back too, under that name."""
    def run(batches):
        emb = embedder(dim)
        for whole in batches:
            for b in sliced(whole, tok_col):
                toks = b.column(tok_col)
                kept = [toks] if keep else []
                yield pa.RecordBatch.from_arrays([b.column(id_col), *kept, late_embed_array(toks, emb)],
                                                 names=[id_col, *([keep] if keep else []), out_col])
    return run

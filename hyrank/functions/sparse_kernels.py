"""Arrow/numpy kernels of the block-max postings (see operators.blockmax)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hyrank.functions.kernels import SCORE_DECIMALS, TopKBuffer, round_scores

ENTRY = pa.struct([("term", pa.string()), ("top", pa.float64()), ("places", pa.list_(pa.int32())),
                   ("weights", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])

#: Queries whose scores against one block exist at once.
QUERY_TILE = 1024
#: Allowance for sums added up in another order (relative), beside the rounding of scores.
SLACK = 1e-9


def _runs(values: np.ndarray) -> np.ndarray:
    """Edges of runs of equal values, with both ends."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def block_entries(point_ids: np.ndarray, terms: pa.Array, weights: np.ndarray) -> pa.Array:
    """Entries of one block: first its point ids (term null), then each term with its largest
    weight, the places of its points among the ids, ascending, and their weights."""
    ids, place = np.unique(point_ids, return_inverse=True)
    coded = terms.dictionary_encode()
    names = coded.dictionary.cast(pa.string())
    by_name = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(names), np.int64)
    rank[by_name] = np.arange(len(names))
    code = rank[coded.indices.to_numpy(zero_copy_only=False)]
    order = np.lexsort((place, code))
    place, weights = place[order].astype(np.int32), weights[order]
    edge = np.searchsorted(code[order], np.arange(len(names) + 1))
    n = len(names)
    none = np.zeros(1, np.int32)
    off = np.concatenate([none, edge]).astype(np.int32)              # the first entry holds no postings
    lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(x)) for x in (place, weights)]
    own = pa.ListArray.from_arrays(pa.array(np.append(none, np.full(n + 1, len(ids))).astype(np.int32)), pa.array(ids))
    top = np.concatenate([[0.0], np.maximum.reduceat(weights, edge[:-1])])
    return pa.StructArray.from_arrays([pa.concat_arrays([pa.nulls(1, pa.string()), names.take(pa.array(by_name))]),
                                       pa.array(top), lists[0], lists[1], own], fields=list(ENTRY))


def build_blocks_kernel():
    """Rows (block, point_id, term, weight), sorted by block -> one row (block, entries) a block."""
    def row(block, held):
        entries = block_entries(np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]),
                                np.concatenate([h[2] for h in held]))
        lists = pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), lists], names=["block", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            block = b.column("block").to_numpy(zero_copy_only=False)
            ids, terms = b.column("point_id").to_numpy(zero_copy_only=False), b.column("term")
            weights = b.column("weight").to_numpy(zero_copy_only=False)
            edges = _runs(block)
            for lo, hi in zip(edges[:-1], edges[1:]):
                if block[lo] != now and held:
                    yield row(now, held)
                    held = []
                now = block[lo]
                held.append((ids[lo:hi], terms.slice(lo, hi - lo), weights[lo:hi]))
        if held:
            yield row(now, held)

    return run


def point_blocks_kernel(block_points: int):
    """Rows (point_id, terms, weights) -> one row (block, entries) for each run of about ``block_points`` rows; rows of one
    id that follow one another stay together."""
    def row(block, held):
        ids, terms, weights, size = (x for x in zip(*held))
        entries = block_entries(np.repeat(np.concatenate(ids), np.concatenate(size)), pa.concat_arrays(terms), np.concatenate(weights))
        lists = pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), lists], names=["block", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() * 1_000_003          # apart from other tasks' numbers
        held, n, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            all_ids = b.column("point_id").to_numpy(zero_copy_only=False)
            size = b.column("terms").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < b.num_rows:
                hi = min(b.num_rows, lo + block_points - n) if n < block_points else lo
                while hi < b.num_rows and all_ids[hi] == (all_ids[hi - 1] if hi > lo else last):
                    hi += 1
                if hi > lo:
                    some = b.slice(lo, hi - lo)
                    held.append((all_ids[lo:hi], some.column("terms").flatten(), some.column("weights").flatten().to_numpy(zero_copy_only=False), size[lo:hi]))
                    n, last = n + hi - lo, all_ids[hi - 1]
                if n >= block_points and hi < b.num_rows:
                    yield row(block, held)
                    block, held, n = block + 1, [], 0
                lo = hi
        if held:
            yield row(block, held)

    return run


class QueryTerms:
    """Weighted terms of a block of queries: pair i says query ``query[i]`` asks for ``terms[term[i]]`` with ``coef[i]``."""

    def __init__(self, qids: np.ndarray, terms: list[str], query: np.ndarray, term: np.ndarray, coef: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.qids, self.terms, self.names = qids, terms, pa.array(terms, pa.string())
        self.query, self.term, self.coef = query[order], term[order], coef[order]
        self.edge = np.searchsorted(self.term, np.arange(len(terms) + 1))


def blockmax_kernel(bc, k: int | None, seed=None, stats: dict | None = None):
    """Exact top-k of weighted term sums over the blocks of a task (rows (block, term, top, places, weights, ids)).

    For each block a query's score is bounded by its terms' largest weights there. A query whose
    bound is below its k-th best score so far leaves the block alone; postings that no query is
    left for are never touched. ``seed``: broadcast lower bounds of the k-th best score of each
    query (found on other blocks). ``k`` None: every match, nothing is left out. ``stats`` counts
    (tests).
    """
    def score(asked: QueryTerms, entries: list, buf: TopKBuffer, floor: np.ndarray):
        ids = next(e[4] for e in entries if e[0] is None)
        entries = [e for e in entries if e[0] is not None]
        found = pc.index_in(pa.array([e[0] for e in entries], pa.string()), value_set=asked.names).to_pylist()
        hit = [(t, e) for t, e in zip(found, entries) if t is not None]
        tops = np.zeros(len(asked.terms))
        for t, e in hit:
            tops[t] = e[1]
        bound = np.bincount(asked.query, weights=asked.coef * tops[asked.term], minlength=len(asked.qids))
        low = floor if k is None else np.maximum(floor, [buf.bound(q) for q in range(len(asked.qids))])
        alive = (bound > 0) & (bound * (1 + SLACK) + 10.0 ** -SCORE_DECIMALS >= low)
        if stats is not None:
            stats["pairs"] = stats.get("pairs", 0) + int((bound > 0).sum())
            stats["scored"] = stats.get("scored", 0) + int(alive.sum())
        chosen = np.flatnonzero(alive)
        for g in range(0, len(chosen), QUERY_TILE):
            group = chosen[g:g + QUERY_TILE]
            row = np.full(len(asked.qids), -1)
            row[group] = np.arange(len(group))
            sums = np.zeros((len(group), len(ids)))
            for t, (_, _, places, weights, _) in hit:
                span = slice(asked.edge[t], asked.edge[t + 1])
                rows = row[asked.query[span]]
                mine = rows >= 0
                if not mine.any():
                    continue
                if stats is not None:
                    stats["decoded"] = stats.get("decoded", 0) + 1
                # a query asks for a term once, a point holds it once: plain adds do
                sums[np.ix_(rows[mine], places)] += asked.coef[span][mine, None] * weights[None, :]
            rounded = round_scores(sums)
            for q, raw, own in zip(group.tolist(), sums, rounded):
                at = np.flatnonzero((raw > 0) & (own >= low[q]))
                buf.add(q, ids[at], own[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: QueryTerms = bc.value
        floor = np.full(len(asked.qids), -np.inf) if seed is None else seed.value
        buf = TopKBuffer(asked.qids, k)
        now, held = None, []
        for b in batches:
            b = b.filter(pc.or_(pc.is_null(b.column("term")), pc.is_in(b.column("term"), value_set=asked.names)))
            if not b.num_rows:
                continue
            block = b.column("block").to_numpy(zero_copy_only=False)
            terms, tops = b.column("term").to_pylist(), b.column("top").to_pylist()
            lists = []
            for name in ("places", "weights", "ids"):
                col = b.column(name)
                flat = col.flatten().to_numpy(zero_copy_only=False)
                edge = np.concatenate([[0], np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                lists.append((flat, edge))
            for i in range(b.num_rows):
                if block[i] != now and held:
                    score(asked, held, buf, floor)
                    held = []
                    if k is None:
                        out, buf = buf.batch(), TopKBuffer(asked.qids, k)
                        if out is not None:
                            yield out
                now = block[i]
                held.append((terms[i], tops[i], *(flat[edge[i]:edge[i + 1]] for flat, edge in lists)))
        if held:
            score(asked, held, buf, floor)
        out = buf.batch()
        if out is not None:
            yield out

    return run


def sparse_pair_kernel(bc, k: int | None = None):
    """Scores of given pairs from the points' own term vectors: rows (point_id, terms, weights, qids).

    Only pairs with a common term get a score. With ``k`` only each query's best k of the task leave it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: QueryTerms = bc.value
        place = {int(q): i for i, q in enumerate(asked.qids)}
        buf = TopKBuffer(asked.qids, k)
        # query q's coefficients by term, one sorted list: key = q * terms + t
        key = asked.query * np.int64(len(asked.terms)) + asked.term
        order = np.argsort(key)
        key, coef = key[order], asked.coef[order]
        for b in batches:
            if not b.num_rows:
                continue
            terms, weights = b.column("terms"), b.column("weights")
            size = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.index_in(terms.flatten(), value_set=asked.names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            weight = weights.flatten().to_numpy(zero_copy_only=False)
            asks = b.column("qids")
            n_asks = asks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            pair_q = np.array([place.get(q, -1) for q in asks.flatten().to_pylist()], np.int64)
            pair_r = np.repeat(np.arange(b.num_rows), n_asks)
            pair_q, pair_r = pair_q[pair_q >= 0], pair_r[pair_q >= 0]
            if not len(pair_q) or not len(key):
                continue
            first = np.concatenate([[0], np.cumsum(size)])
            ids = b.column("point_id").to_numpy(zero_copy_only=False)
            step = max(1, (1 << 22) // max(1, int(size.max())))          # pairs at a time: their postings stay a few 10 MB
            scores = np.zeros(len(pair_q))
            for lo in range(0, len(pair_q), step):
                q, r = pair_q[lo:lo + step], pair_r[lo:lo + step]
                n = size[r]
                edge = np.concatenate([[0], np.cumsum(n)])
                at = np.arange(edge[-1]) + np.repeat(first[r] - edge[:-1], n)
                own = np.repeat(np.arange(len(q)), n)
                known = code[at] >= 0
                at, own = at[known], own[known]
                want = q[own] * np.int64(len(asked.terms)) + code[at]
                spot = np.minimum(np.searchsorted(key, want), len(key) - 1)
                both = key[spot] == want
                scores[lo:lo + step] = np.bincount(own[both], weights=coef[spot[both]] * weight[at[both]], minlength=len(q))
            hit = scores > 0
            pair_q, pair_r, scores = pair_q[hit], pair_r[hit], round_scores(scores[hit])
            order = np.argsort(pair_q, kind="stable")
            edges = _runs(pair_q[order]) if len(order) else np.zeros(1, np.int64)
            for lo, hi in zip(edges[:-1], edges[1:]):
                at = order[lo:hi]
                buf.add(int(pair_q[at[0]]), ids[pair_r[at]], scores[at])
            if k is None:
                out, buf = buf.batch(), TopKBuffer(asked.qids, k)
                if out is not None:
                    yield out
        out = buf.batch()
        if out is not None:
            yield out

    return run

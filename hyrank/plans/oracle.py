"""DuckDB SQL twins of the registered queries (the correctness oracle).

The SQL recomputes every representation from the raw tables (documents,
benchmark, ...), so it checks the whole chain, not just the last step.
Conventions shared with the Spark side: scores rounded to 6 decimals
before ranking, ties broken by point id, ranks and counts as BIGINT;
vectors pass through float32 exactly as they are stored.
"""

from __future__ import annotations

from hyrank.functions.text import BM25_AVGDL, BM25_B, BM25_K1, RRF_C, TOKEN_PATTERN
from hyrank.operators.represent import DENSE_DIM, LATE_DIM


def _comp(term: str, i: str) -> str:
    return (f"((('0x' || substr(md5(({i} // 16)::VARCHAR || ':' || {term}), (2 * ({i} % 16) + 1)::INTEGER, 2))"
            f"::INTEGER - 127.5) / 127.5)")


def _bm25(tf: str, dl: str) -> str:
    return (f"({tf} * {BM25_K1 + 1.0}::DOUBLE / ({tf} + {BM25_K1}::DOUBLE * ({1.0 - BM25_B}::DOUBLE + "
            f"{BM25_B}::DOUBLE * {dl} / {BM25_AVGDL}::DOUBLE)))")


def _tok(src: str, id_expr: str, name: str) -> str:
    return f"""{name}_tok AS (
  SELECT {id_expr} AS id, regexp_extract_all(lower(text), '{TOKEN_PATTERN}') AS toks FROM {src}),
{name}_post AS (
  SELECT id, term, count(*)::BIGINT AS tf, any_value(dl)::BIGINT AS dl
  FROM (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM {name}_tok)
  GROUP BY id, term),
{name}_w AS (SELECT id, term, tf, dl, {_bm25('tf', 'dl')} AS weight FROM {name}_post),
{name}_dense_raw AS (
  SELECT id, i, sum(tf * {_comp('term', 'i')}) AS v
  FROM {name}_post, range({DENSE_DIM}) r(i) GROUP BY id, i),
{name}_dense AS (
  SELECT id, i, (v / sqrt(sum(v * v) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS v FROM {name}_dense_raw),
{name}_late_raw AS (
  SELECT id, term, [{', '.join(_comp('term', str(i)) for i in range(LATE_DIM))}]::DOUBLE[{LATE_DIM}] AS raw
  FROM (SELECT DISTINCT id, term FROM {name}_post)),
{name}_late AS MATERIALIZED (
  SELECT id, term,
         list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw)))::FLOAT[{LATE_DIM}]::DOUBLE[{LATE_DIM}] AS v
  FROM {name}_late_raw)"""


def base_ctes(corpus: str = "documents") -> str:
    """Corpus (doc_id, text) and query set (benchmark) representations."""
    return f"""{_tok(corpus, 'doc_id', 'd')},
{_tok('benchmark', 'item_id', 'q')},
d_n AS (SELECT count(DISTINCT id) AS n FROM d_post),
idf AS (
  SELECT term, count(*)::BIGINT AS n,
         ln(((SELECT n FROM d_n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1.0::DOUBLE) AS idf
  FROM d_post GROUP BY term),
dense_scores AS MATERIALIZED (
  SELECT q.id AS query_id, d.id AS point_id, (round(sum(q.v * d.v), 6) + 0.0) AS score
  FROM q_dense q JOIN d_dense d USING (i) GROUP BY q.id, d.id),
sparse_scores AS MATERIALIZED (
  SELECT q.id AS query_id, d.id AS point_id, (round(sum(q.weight * d.weight * idf.idf), 6) + 0.0) AS score
  FROM q_w q JOIN d_w d USING (term) JOIN idf USING (term) GROUP BY q.id, d.id),
late_pairs AS MATERIALIZED (
  SELECT q.id AS query_id, d.id AS point_id, q.term AS qterm, max(list_dot_product(q.v, d.v)) AS m
  FROM q_late q, d_late d GROUP BY q.id, d.id, q.term),
late_scores AS MATERIALIZED (
  SELECT query_id, point_id, (round(sum(m), 6) + 0.0) AS score FROM late_pairs GROUP BY query_id, point_id)"""


def ranked(src: str, k: int | None, where: str = "") -> str:
    lim = f"WHERE rank <= {k}" if k is not None else ""
    return f"""(SELECT * FROM (
  SELECT query_id, point_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id ASC)::BIGINT AS rank
  FROM {src} {where}) {lim})"""


def rrf_sql(branches: list[str], k: int | None) -> str:
    parts = " UNION ALL ".join(
        f"SELECT query_id, point_id, 1.0::DOUBLE / ({RRF_C}::DOUBLE + (rank - 1)) AS c FROM {b}" for b in branches)
    fused = f"(SELECT query_id, point_id, (round(sum(c), 6) + 0.0) AS score FROM ({parts}) GROUP BY query_id, point_id)"
    return ranked(fused, k)


def late_on(cands: str) -> str:
    """MaxSim restricted to a candidate set (query_id, point_id): a pair's
    score does not depend on the other candidates, so look it up."""
    return f"""(SELECT l.query_id, l.point_id, l.score FROM late_scores l
  JOIN (SELECT DISTINCT query_id, point_id FROM {cands}) c USING (query_id, point_id))"""


def with_base(body: str, corpus: str = "documents", before: str = "") -> str:
    """``before``: CTEs that define another corpus than the documents table."""
    return f"WITH {before}{base_ctes(corpus)}\n{body}"


def select_hits(src: str) -> str:
    return f"SELECT query_id, point_id, rank, score FROM {src}"

"""Registered queries (one per operator of the inventory) and their SQL twins.

Query set: the whole ``benchmark`` table (short passages, some of which
recur in the corpus). Corpus: the whole ``documents`` table, every text
processed in full. Parameters are the searched system's defaults (page
size 10, prefetch 1000, dense threshold 0.6) unless a key says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyrank.operators import fuse, retrieve
from hyrank.plans import oracle as O
from hyrank.plans import strategies as S
from hyrank.plans.collection import corpus

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


HITS = ["query_id", "point_id", "rank", "score"]


def _hits(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) for c in HITS])


# ---------------------------------------------------------------------------
# Retrieval strategies
# ---------------------------------------------------------------------------

@register("dense_topk", O.with_base(O.select_hits(O.ranked("dense_scores", S.PAGE_SIZE))))
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    col, qs = corpus(spark, sf)
    return _hits(S.dense(col, qs, S.PAGE_SIZE, threshold=None))


@register("dense_threshold", O.with_base(O.select_hits(
    O.ranked("dense_scores", None, f"WHERE score >= {S.DENSE_THRESHOLD}"))))
def dense_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Every hit scoring at least 0.6, ranked (paging to the end)."""
    col, qs = corpus(spark, sf)
    return _hits(S.dense(col, qs, None, threshold=S.DENSE_THRESHOLD))


@register("sparse_topk", O.with_base(O.select_hits(O.ranked("sparse_scores", S.PAGE_SIZE))))
def sparse_topk(spark: SparkSession, sf: str) -> DataFrame:
    col, qs = corpus(spark, sf)
    return _hits(S.sparse(col, qs, S.PAGE_SIZE))


@register("late_topk", O.with_base(O.select_hits(O.ranked("late_scores", S.PAGE_SIZE))))
def late_topk(spark: SparkSession, sf: str) -> DataFrame:
    col, qs = corpus(spark, sf)
    return _hits(S.late(col, qs, S.PAGE_SIZE))


_D = O.ranked("dense_scores", S.PREFETCH)
_S = O.ranked("sparse_scores", S.PREFETCH)
_L = O.ranked("late_scores", S.PREFETCH)


@register("rrf_dense_sparse", O.with_base(O.select_hits(O.rrf_sql([_D, _S], S.PAGE_SIZE))))
def rrf_dense_sparse(spark: SparkSession, sf: str) -> DataFrame:
    col, qs = corpus(spark, sf)
    return _hits(S.rrf_dense_sparse(col, qs))


@register("rrf_all", O.with_base(O.select_hits(O.rrf_sql([_D, _S, _L], S.PAGE_SIZE))))
def rrf_all(spark: SparkSession, sf: str) -> DataFrame:
    col, qs = corpus(spark, sf)
    return _hits(S.rrf_all(col, qs))


_UNION = f"(SELECT query_id, point_id FROM {_D} UNION SELECT query_id, point_id FROM {_S})"


@register("rerank_late", O.with_base(O.select_hits(O.ranked(O.late_on(_UNION), S.PAGE_SIZE))))
def rerank_late(spark: SparkSession, sf: str) -> DataFrame:
    col, qs = corpus(spark, sf)
    return _hits(S.rerank_late(col, qs))


_CASCADE_S = O.ranked(
    f"(SELECT s.* FROM sparse_scores s JOIN {_D} d USING (query_id, point_id))", S.PREFETCH)


@register("multistep", O.with_base(O.select_hits(O.ranked(O.late_on(_CASCADE_S), S.PAGE_SIZE))))
def multistep(spark: SparkSession, sf: str) -> DataFrame:
    col, qs = corpus(spark, sf)
    return _hits(S.multistep(col, qs))


# ---------------------------------------------------------------------------
# Prefetch, candidate union, paging, payload projection
# ---------------------------------------------------------------------------

@register("prefetch", O.with_base(O.select_hits(O.ranked("sparse_scores", S.PREFETCH))))
def prefetch(spark: SparkSession, sf: str) -> DataFrame:
    """A branch-local top-1000 (the sparse prefetch of the fusions)."""
    col, qs = corpus(spark, sf)
    return _hits(retrieve.prefetch(S.sparse(col, qs, S.PREFETCH), S.PREFETCH))


@register("prefetch_union", O.with_base(f"SELECT query_id, point_id FROM {_UNION}"))
def prefetch_union(spark: SparkSession, sf: str) -> DataFrame:
    """Dense and sparse prefetches merged, each point once per query."""
    col, qs = corpus(spark, sf)
    return fuse.union_candidates([S.dense(col, qs, S.PREFETCH, threshold=None), S.sparse(col, qs, S.PREFETCH)])


# The same fusions with a prefetch that cuts: 25 of the corpus per branch, so what a
# branch drops shows in the result (1000 covers all documents of the small tables).
_N = 25
_D25, _S25, _L25 = (O.ranked(f"{b}_scores", _N) for b in ("dense", "sparse", "late"))
_UNION25 = f"(SELECT query_id, point_id FROM {_D25} UNION SELECT query_id, point_id FROM {_S25})"
_CASCADE25 = O.ranked(f"(SELECT s.* FROM sparse_scores s JOIN {_D25} d USING (query_id, point_id))", 15)


@register("rrf_dense_sparse_n25", O.with_base(O.select_hits(O.rrf_sql([_D25, _S25], S.PAGE_SIZE))))
def rrf_dense_sparse_n25(spark: SparkSession, sf: str) -> DataFrame:
    col, qs = corpus(spark, sf)
    return _hits(S.rrf_dense_sparse(col, qs, prefetch=_N))


@register("rrf_all_n25", O.with_base(O.select_hits(O.rrf_sql([_D25, _S25, _L25], S.PAGE_SIZE))))
def rrf_all_n25(spark: SparkSession, sf: str) -> DataFrame:
    col, qs = corpus(spark, sf)
    return _hits(S.rrf_all(col, qs, prefetch=_N))


@register("rerank_late_n25", O.with_base(O.select_hits(O.ranked(O.late_on(_UNION25), S.PAGE_SIZE))))
def rerank_late_n25(spark: SparkSession, sf: str) -> DataFrame:
    col, qs = corpus(spark, sf)
    return _hits(S.rerank_late(col, qs, prefetch=_N))


@register("multistep_n25", O.with_base(O.select_hits(O.ranked(O.late_on(_CASCADE25), S.PAGE_SIZE))))
def multistep_n25(spark: SparkSession, sf: str) -> DataFrame:
    """dense:25 -> sparse:15 -> MaxSim."""
    col, qs = corpus(spark, sf)
    return _hits(S.multistep(col, qs, prefetch_dense=_N, prefetch_sparse=15))


@register("prefetch_n25", O.with_base(O.select_hits(O.ranked("sparse_scores", _N))))
def prefetch_n25(spark: SparkSession, sf: str) -> DataFrame:
    """The best 25 of a branch ranked deeper."""
    col, qs = corpus(spark, sf)
    return _hits(retrieve.prefetch(S.sparse(col, qs, 100), _N))


@register("prefetch_union_n25", O.with_base(f"SELECT query_id, point_id FROM {_UNION25}"))
def prefetch_union_n25(spark: SparkSession, sf: str) -> DataFrame:
    col, qs = corpus(spark, sf)
    return fuse.union_candidates([S.dense(col, qs, _N, threshold=None), S.sparse(col, qs, _N)])


@register("page_hits", O.with_base(
    "SELECT query_id, point_id, rank, score, ((rank - 1) // 10)::BIGINT AS page FROM "
    f"{O.rrf_sql([_D, _S], None)} WHERE rank > 20 AND rank <= 30"))
def page_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Page 3 (offset 20, limit 10) of the dense+sparse RRF list."""
    col, qs = corpus(spark, sf)
    hits = S.rrf_dense_sparse(col, qs, k=None)
    return retrieve.page_hits(hits, 2, S.PAGE_SIZE).select(*HITS, "page")


@register("cursor_pages", O.with_base(
    "SELECT query_id, point_id, rank, score, ((rank - 1) // 10)::BIGINT AS page FROM "
    f"{O.ranked('dense_scores', 30)}"))
def cursor_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Three dense pages, each asked for behind the last hit of the page before; equal to the ranks 1 to 30."""
    col, qs = corpus(spark, sf)
    pages, cursor = [], None
    for n in range(3):
        page = _hits(retrieve.dense_page(col.points, qs.queries, S.PAGE_SIZE, cursor)).withColumn("page", F.lit(n).cast("long"))
        work_dir(spark)
        page = page.withColumn("rank", F.col("rank") + n * S.PAGE_SIZE).checkpoint()
        cursor = retrieve.cursor_of(page)
        pages.append(page)
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


def _payload_sql(src: str) -> str:
    return (f"SELECT h.query_id, h.point_id, h.rank, h.score, "
            f"split_part(coalesce(d.text, ''), chr(10), 1) AS headline, d.lang, d.source "
            f"FROM {src} h JOIN documents d ON d.doc_id = h.point_id")


@register("project_hits", O.with_base(_payload_sql(O.rrf_sql([_D, _S], S.PAGE_SIZE))))
def project_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with payload, vectors omitted; payload joined after top-k."""
    from hyrank.operators.shape import project_hits as proj
    col, qs = corpus(spark, sf)
    hits = S.rrf_dense_sparse(col, qs)
    return proj(hits, col.points, ["headline", "lang", "source"], hit_bound=qs.n * S.PAGE_SIZE) \
        .select(*HITS, "headline", "lang", "source")


# ---------------------------------------------------------------------------
# P4 payload filter
# ---------------------------------------------------------------------------

_EN = "SELECT doc_id FROM documents WHERE lang = 'en'"
_DF = O.ranked(f"(SELECT * FROM dense_scores WHERE point_id IN ({_EN}))", S.PREFETCH)
_SF = O.ranked(f"(SELECT * FROM sparse_scores WHERE point_id IN ({_EN}))", S.PREFETCH)


@register("filter_points", O.with_base(O.select_hits(O.rrf_sql([_DF, _SF], S.PAGE_SIZE))))
def filter_points(spark: SparkSession, sf: str) -> DataFrame:
    """dense+sparse RRF restricted to English points, filtered before scoring."""
    col, qs = corpus(spark, sf)
    return _hits(S.rrf_dense_sparse(col, qs, where=F.col("lang") == "en"))


# ---------------------------------------------------------------------------
# Sources and sinks (S1-S6), record shaping
# ---------------------------------------------------------------------------

from hyrank.session import scratch_path, work_dir  # noqa: E402
from hyrank.sources import candidates as C  # noqa: E402
from hyrank.sources import collection_ops as CO  # noqa: E402
from hyrank.sources import tables  # noqa: E402
from hyrank.operators import shape  # noqa: E402

_CAND = f"WITH {C.candidates_source_sql()}\n"


@register("load_candidates", _CAND + """SELECT id, (100000 + id)::BIGINT AS user_id, 'ext-' || id AS external_candidate_id,
  language AS prefered_language, 'Candidate ' || id AS name, 'c' || id || '@example.com' AS email,
  source AS country, 'city-' || (id % 7) AS city,
  (CASE WHEN language <> 'english' AND id % 3 <> 0 THEN 2 ELSE 1 END)::BIGINT AS n_bio,
  n_work::BIGINT AS n_work, cv_url FROM cand""")
def load_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Nested records written as JSON, read back with the explicit schema."""
    path = scratch_path(spark, "candidates")
    C.write_candidates(C.build_candidates(spark, sf), path, "json")
    c = C.load_candidates(spark, path, "json")
    return c.select(
        "id", "user_id", "external_candidate_id", F.col("user.prefered_language").alias("prefered_language"),
        F.col("user.name").alias("name"), F.col("user.email").alias("email"),
        F.col("user.country").alias("country"), F.col("user.city").alias("city"),
        F.size("bio").cast("long").alias("n_bio"),
        F.size(F.col("bio")["english"]["work_experience"]).cast("long").alias("n_work"),
        F.get(F.col("uploaded_resumes"), 0)["cv_url"].alias("cv_url"))


@register("map_candidate", _CAND + """SELECT
  upper(substr(language, 1, 1)) || substr(language, 2) AS language, (100000 + id)::BIGINT AS user_id,
  id AS candidate_id, 'ext-' || id AS external_candidate_id, 'Candidate ' || id AS name,
  'c' || id || '@example.com' AS email,
  CASE WHEN language = 'english' THEN headline WHEN id % 3 <> 0 THEN 'L:' || headline ELSE '' END AS headline,
  array_to_string(string_split(headline, ' ')[1:3], ',') AS expertise,
  array_to_string(string_split(headline, ' ')[4:6], ',') AS skill_tags,
  text AS cv_summary, 'quality=' || coalesce(quality::VARCHAR, 'none') AS skill_analysis,
  'XXX,TODO' AS countries, source AS country, 'city-' || (id % 7) AS city,
  false AS email_notifications_enabled, 'never' AS notification_frequency, cv_url,
  (CASE WHEN language <> 'english' AND id % 3 <> 0 THEN 2 ELSE 1 END)::BIGINT AS bio_languages
FROM cand""")
def map_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """The 18-field payload; arrays shown joined, the bio map by its size."""
    p = shape.map_candidate(C.build_candidates(spark, sf))
    return p.select(
        "language", "user_id", "candidate_id", "external_candidate_id", "name", "email", "headline",
        F.concat_ws(",", "expertise").alias("expertise"), F.concat_ws(",", "skill_tags").alias("skill_tags"),
        "cv_summary", "skill_analysis", F.concat_ws(",", "countries").alias("countries"), "country", "city",
        "email_notifications_enabled", "notification_frequency", "cv_url",
        F.size("bio").cast("long").alias("bio_languages"))


@register("candidate_text", _CAND + """SELECT id AS point_id,
  headline || ', ' || coalesce(job_titles, '') || chr(10) || text || chr(10)
  || array_to_string(string_split(headline, ' ')[1:3], ', ') || chr(10)
  || array_to_string(string_split(headline, ' ')[4:6], ', ') || ', ' || source || ', ' || lang
  || 'quality=' || coalesce(quality::VARCHAR, 'none') AS text
FROM cand""")
def candidate_text(spark: SparkSession, sf: str) -> DataFrame:
    """The embedding text of every candidate."""
    return shape.candidate_text(C.build_candidates(spark, sf))


_CAND_DOCS = C.candidates_source_sql() + """,
cand_docs AS (SELECT id AS doc_id,
  headline || ', ' || coalesce(job_titles, '') || chr(10) || text || chr(10)
  || array_to_string(string_split(headline, ' ')[1:3], ', ') || chr(10)
  || array_to_string(string_split(headline, ' ')[4:6], ', ') || ', ' || source || ', ' || lang
  || 'quality=' || coalesce(quality::VARCHAR, 'none') AS text FROM cand),
"""


@register("ingest_candidates", O.with_base(O.select_hits(O.ranked("sparse_scores", S.PAGE_SIZE)), "cand_docs", _CAND_DOCS))
def ingest_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """S1 to E6 in a row: nested records loaded, mapped, embedded and written, then searched (sparse top-10)."""
    from hyrank.plans.collection import ingest_candidates as ingest
    path = scratch_path(spark, "candidates")
    C.write_candidates(C.build_candidates(spark, sf), path, "json")
    col = ingest(spark, C.load_candidates(spark, path, "json"))
    return _hits(S.sparse(col, corpus(spark, sf)[1], S.PAGE_SIZE))


@register("stream_collection", O.with_base(O.select_hits(O.ranked("sparse_scores", S.PAGE_SIZE)), "cand_docs", _CAND_DOCS))
def stream_collection(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate records streamed into a collection: first all, those of labelled documents with an older text, then
    the labelled ones as they are, in several batches; equal to a batch build of the records."""
    from hyrank.streaming.ingest import ingest_candidate_stream
    now = C.build_candidates(spark, sf)
    labelled = tables.load(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct()
    english = F.col("bio")["english"]
    aged = english.withField("cv_summary", F.concat(F.lit("an older text "), F.substring_index(english["cv_summary"], " ", 20)))
    old = now.join(labelled, "id", "left_semi").withColumn("bio", F.create_map(F.lit("english"), aged))
    base = scratch_path(spark, "candidate-stream")
    C.write_candidates(now.join(labelled, "id", "left_anti").unionByName(old), f"{base}/first", "json")
    ingest_candidate_stream(spark, f"{base}/first", f"{base}/versions", f"{base}/checkpoint-1")
    C.write_candidates(now.join(labelled, "id", "left_semi").repartition(2), f"{base}/second", "json")
    col = ingest_candidate_stream(spark, f"{base}/second", f"{base}/versions", f"{base}/checkpoint-2", max_files_per_trigger=1)
    return _hits(S.sparse(col, corpus(spark, sf)[1], S.PAGE_SIZE))


_SHORTENED = """short_docs AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
  THEN split_part(coalesce(text, ''), chr(10), 1) ELSE text END AS text FROM documents),
"""


@register("upsert_collection", O.with_base(O.select_hits(O.rrf_sql(
    [O.ranked("dense_scores", S.PREFETCH), O.ranked("sparse_scores", S.PREFETCH)], S.PAGE_SIZE)), "short_docs", _SHORTENED))
def upsert_collection(spark: SparkSession, sf: str) -> DataFrame:
    """Toxic documents replaced by their first lines in points, postings and IDF; a hybrid search no
    longer meets the terms that went."""
    from hyrank.plans.collection import document_payload, upsert_collection as upsert
    col, qs = corpus(spark, sf)
    toxic = tables.load(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct()
    docs = document_payload(tables.load(spark, sf, "documents").join(toxic, "doc_id", "left_semi"))
    return _hits(S.rrf_dense_sparse(upsert(spark, col, docs.withColumn("text", F.col("headline"))), qs))


_EMB_POINTS = """emb AS (SELECT vec_id AS point_id, embedding FROM embeddings)"""


def _embedding_points(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.load(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("dense"),
                    CO.slice_multivector(F.col("embedding"), 8, 8).alias("late"))


@register("validate_vectors", f"""WITH {_EMB_POINTS}
SELECT point_id, CASE WHEN embedding IS NULL THEN 'ok'
  WHEN len(embedding) <> 64 THEN 'dense_dim'
  WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) <= 0 THEN 'dense_zero'
  ELSE 'ok' END AS status FROM emb""")
def validate_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as points (dense 64, late = 8 slices of 8) checked
    against the declared schema; every row comes back with its status."""
    valid, rejected = CO.validate_vectors(_embedding_points(spark, sf), 64, 8)
    return valid.select("point_id", F.lit("ok").alias("status")).unionByName(
        rejected.select("point_id", F.col("reason").alias("status")))


_UPD_SQL = """upd AS (
  SELECT doc_id AS point_id, 'quality=' || quality AS source, 2::BIGINT AS seq FROM labels
  UNION ALL SELECT doc_id, 'toxic', 3::BIGINT FROM labels WHERE toxic = 1),
latest AS (SELECT point_id, source, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY seq DESC) AS rn FROM upd) WHERE rn = 1)"""
_UPSERT_SQL = f"""WITH {_UPD_SQL}
SELECT point_id, source, seq FROM latest
UNION ALL SELECT doc_id AS point_id, source, 1::BIGINT AS seq FROM documents
WHERE doc_id NOT IN (SELECT point_id FROM latest)"""


def _upsert_inputs(spark: SparkSession, sf: str):
    docs = tables.load(spark, sf, "documents")
    labels = tables.load(spark, sf, "labels")
    target = docs.select(F.col("doc_id").alias("point_id"), "source", F.lit(1).cast("long").alias("seq"))
    a = labels.select(F.col("doc_id").alias("point_id"),
                      F.concat(F.lit("quality="), F.col("quality").cast("string")).alias("source"),
                      F.lit(2).cast("long").alias("seq"))
    b = labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("point_id"),
                                                 F.lit("toxic").alias("source"), F.lit(3).cast("long").alias("seq"))
    return target, a, b


@register("upsert_points", _UPSERT_SQL)
def upsert_points(spark: SparkSession, sf: str) -> DataFrame:
    """S3: label updates (some keys twice in the batch) upserted by id into
    a new version of the documents table."""
    target, a, b = _upsert_inputs(spark, sf)
    tbl = CO.VersionedTable(spark, scratch_path(spark, "upsert"))
    tbl.commit(target)
    tbl.upsert(a.unionByName(b))
    return tbl.read()


@register("ingest_stream", _UPSERT_SQL)
def ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same updates arriving from two sources, each a file stream with a
    checkpoint of its own, upserted batch by batch; equals S3's table."""
    from hyrank.streaming.ingest import ingest_stream as run
    target, a, b = _upsert_inputs(spark, sf)
    base = scratch_path(spark, "ingest")
    tbl = CO.VersionedTable(spark, f"{base}/table")
    tbl.commit(target)
    for n, part in enumerate((a, b)):
        part.write.parquet(f"{base}/incoming-{n}")
        run(spark, f"{base}/incoming-{n}", tbl, f"{base}/checkpoint-{n}", a.schema, max_files_per_trigger=1)
    return tbl.read().select("point_id", "source", "seq")


@register("snapshot_roundtrip", O.with_base("""SELECT d.doc_id AS point_id, d.lang, d.source,
  (SELECT count(*) FROM d_post p WHERE p.id = d.doc_id)::BIGINT AS n_late,
  CASE WHEN (SELECT count(*) FROM d_post p WHERE p.id = d.doc_id) > 0 THEN 32 END::BIGINT AS dense_dim
FROM documents d"""))
def snapshot_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The collection's points written as a snapshot and restored."""
    col, _ = corpus(spark, sf)
    base = scratch_path(spark, "snapshots")
    CO.write_snapshot(col.points, base, "1")
    r = CO.restore_snapshot(spark, base, "1")
    return r.select("point_id", "lang", "source",
                    F.coalesce(F.size("late"), F.lit(0)).cast("long").alias("n_late"),
                    F.when(F.col("dense").isNotNull(), F.size("dense")).cast("long").alias("dense_dim"))


@register("snapshot_search", O.with_base(O.select_hits(O.rrf_sql([_D, _S], S.PAGE_SIZE))))
def snapshot_search(spark: SparkSession, sf: str) -> DataFrame:
    """The whole collection (points, postings, IDF, blocks, manifest) copied, opened from the copy and searched."""
    from hyrank.plans.collection import copy_collection, open_collection
    col, qs = corpus(spark, sf)
    path = copy_collection(spark, col, scratch_path(spark, "snapshot")).path
    return _hits(S.rrf_dense_sparse(open_collection(spark, path), qs))


@register("collection_info", O.with_base("""SELECT
  (SELECT count(*) FROM documents)::BIGINT AS n_points,
  (SELECT count(DISTINCT id) FROM d_post)::BIGINT AS n_dense,
  (SELECT count(DISTINCT id) FROM d_post)::BIGINT AS n_late,
  32::BIGINT AS dense_dim_min, 32::BIGINT AS dense_dim_max,
  (SELECT count(*) FROM d_post)::BIGINT AS late_vectors,
  (SELECT max(c) FROM (SELECT count(*) AS c FROM d_post GROUP BY id))::BIGINT AS late_tokens_max,
  16::BIGINT AS late_dim,
  (SELECT count(*) FROM d_post)::BIGINT AS n_postings,
  (SELECT count(DISTINCT id) FROM d_post)::BIGINT AS n_sparse"""))
def collection_info(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per vector kind and dimension ranges of the collection."""
    col, _ = corpus(spark, sf)
    return CO.collection_info(col.points, col.postings)


# ---------------------------------------------------------------------------
# Representation building
# ---------------------------------------------------------------------------

from hyrank.operators import represent as R  # noqa: E402


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    from hyrank.plans.collection import spread
    return spread(tables.load(spark, sf, "documents").select(F.col("doc_id").alias("point_id"), "text"))


@register("embed_dense", O.with_base(
    "SELECT id AS point_id, i::BIGINT AS i, (round(v, 6) + 0.0) AS value FROM d_dense"))
def embed_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Hashing-embedder dense vectors of whole documents, one row per component."""
    d = R.embed_dense(_docs(spark, sf))
    return d.select("point_id", F.posexplode("dense").alias("i", "v")).select(
        "point_id", F.col("i").cast("long").alias("i"), (F.round(F.col("v").cast("double"), 6) + 0.0).alias("value"))


@register("bm25_weights", O.with_base(
    "SELECT id AS point_id, term, tf, dl, (round(weight, 6) + 0.0) AS weight FROM d_w"))
def bm25_weights(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 postings of every document (whole text)."""
    p = R.bm25_weights(_docs(spark, sf))
    return p.select("point_id", "term", "tf", "dl", (F.round("weight", 6) + 0.0).alias("weight"))


@register("idf_table", O.with_base("SELECT term, n, (round(idf, 6) + 0.0) AS idf FROM idf"))
def idf_table(spark: SparkSession, sf: str) -> DataFrame:
    """Collection IDF per term."""
    docs = _docs(spark, sf)
    return R.idf_table(R.bm25_weights(docs), R.n_with_terms(docs)).select("term", "n", (F.round("idf", 6) + 0.0).alias("idf"))


MODEL_LIMIT = 5000


def _limited_model():
    """A stand-in for a model with an input limit: the hashing embedder, for texts of up to MODEL_LIMIT characters."""
    import re
    from hyrank.functions import kernels
    emb = kernels.embedder(R.DENSE_DIM)

    def embed(texts):
        if any(len(t) > MODEL_LIMIT for t in texts):
            raise ValueError(f"a text of more than {MODEL_LIMIT} characters")
        out = []
        for t in texts:
            words = re.findall(r"\w+", t.lower())
            dense = emb.vectors(words).sum(axis=0) if words else None
            out.append((None if dense is None else dense.tolist(), None))
        return out
    return embed


@register("embed_cached", f"""WITH t AS (SELECT 'd' || doc_id AS id, text, 1 AS go FROM documents UNION ALL SELECT 'b' || item_id, text, 2 FROM benchmark),
f AS (SELECT text, min(go) AS first FROM t GROUP BY text)
SELECT id, CASE WHEN length(t.text) > {MODEL_LIMIT} THEN 'rejected' WHEN first < go THEN 'known' ELSE 'embedded' END AS status
FROM t JOIN f USING (text)""")
def embed_cached(spark: SparkSession, sf: str) -> DataFrame:
    """Documents embedded, then documents and benchmark items behind a cache: only texts that are new to it go
    through the model, texts beyond its limit are set aside."""
    from hyrank.operators import embedding
    docs = tables.load(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    items = tables.load(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text")
    cache = scratch_path(spark, "embedding-cache")
    first, _ = embedding.embed_texts(docs, cache, _limited_model, "id")
    work_dir(spark)
    before = spark.read.parquet(f"{cache}/vectors").select("key").checkpoint()
    vectors, rejects = embedding.embed_texts(docs.unionByName(items), cache, _limited_model, "id")
    known = items.select("id", embedding.text_key().alias("key")).join(before.distinct(), "key", "left_semi").select("id", F.lit(True).alias("was"))
    status = vectors.select("id").join(known, "id", "left").select("id", F.when(F.col("was"), "known").otherwise("embedded").alias("status"))
    return status.unionByName(rejects.select("id", F.lit("rejected").alias("status")))


_LATE_COLS = ", ".join(f"(round(v[{i + 1}], 6) + 0.0) AS v{i}" for i in range(R.LATE_DIM))


@register("embed_late", O.with_base(f"SELECT id AS point_id, term, {_LATE_COLS} FROM d_late"))
def embed_late(spark: SparkSession, sf: str) -> DataFrame:
    """One unit vector per distinct token of every document."""
    return _late_rows(_docs(spark, sf).where("point_id is not null"))


def _late_rows(docs: DataFrame) -> DataFrame:
    """Tokens and vectors come from one pass. Only an id of several documents is joined (all its tokens with all its vectors);
    such ids are few and are counted first."""
    from hyrank.functions.text import tokens
    again = docs.groupBy("point_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("point_id")
    once = docs if again.isEmpty() else docs.join(again, "point_id", "left_anti")
    rows = R.embed_late(once, keep="toks")
    if once is not docs:
        several = docs.join(again, "point_id", "left_semi")
        toks = several.select("point_id", F.array_distinct(tokens("text")).alias("toks"))
        rows = rows.unionByName(toks.join(R.embed_late(several), "point_id"))
    z = rows.select("point_id", F.explode(F.arrays_zip("toks", "late")).alias("z"))
    return z.select("point_id", F.col("z.toks").alias("term"),
                    *[(F.round(F.col("z.late")[i].cast("double"), 6) + 0.0).alias(f"v{i}") for i in range(R.LATE_DIM)])


@register("normalize_vectors", """SELECT vec_id AS point_id, (i - 1)::BIGINT AS i,
  (round(embedding[i] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) + 0.0) AS value
FROM embeddings, range(1, 65) r(i)""")
def normalize_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """E5: the embeddings table L2-normalised (JVM side), one row per component."""
    e = tables.load(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding"))
    n = R.normalize_vectors(e, ["embedding"])
    return n.select("point_id", F.posexplode("embedding").alias("i", "v")).select(
        "point_id", F.col("i").cast("long").alias("i"), (F.round("v", 6) + 0.0).alias("value"))


@register("build_points", O.with_base("""SELECT doc_id AS point_id,
  split_part(coalesce(text, ''), chr(10), 1) AS headline, lang, source,
  (SELECT count(*) FROM d_post p WHERE p.id = doc_id)::BIGINT AS n_terms,
  (SELECT count(*) FROM d_post p WHERE p.id = doc_id) > 0 AS has_dense
FROM documents"""))
def build_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points with payload, dense and late vectors, plus postings."""
    col, _ = corpus(spark, sf)
    nterms = col.postings.groupBy("point_id").agg(F.count(F.lit(1)).cast("long").alias("n_terms"))
    return (col.points.select("point_id", "headline", "lang", "source", F.col("dense").isNotNull().alias("has_dense"))
            .join(nterms, "point_id", "left")
            .select("point_id", "headline", "lang", "source", F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
                    "has_dense"))


@register("build_queries", O.with_base("SELECT id AS query_id, term, (round(weight, 6) + 0.0) AS qweight FROM q_w"))
def build_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Query terms of the benchmark table, document-mode BM25 weights."""
    _, qs = corpus(spark, sf)
    return qs.terms.select("query_id", "term", (F.round("qweight", 6) + 0.0).alias("qweight"))


_EXTERNAL = """WITH en AS (SELECT vec_id AS id, i, (embedding[i] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT::DOUBLE AS v
  FROM embeddings, range(1, 65) r(i)),
pair AS (SELECT q.id AS query_id, p.id AS point_id, (round(sum(q.v * p.v), 6) + 0.0) AS score
  FROM en q JOIN en p USING (i) GROUP BY q.id, p.id)"""


@register("external_vectors", f"{_EXTERNAL}\n" + O.select_hits(O.ranked("pair", S.PAGE_SIZE)))
def external_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Points and queries whose vectors come from outside, neither of unit length: both are normalised
    at write time, their dimensions kept in the manifest."""
    from hyrank import api
    e = _embedding_points(spark, sf)
    scaled = lambda x: e.select("point_id", F.transform("dense", lambda v: v * F.lit(x)).alias("dense"), "late")
    col, _ = api.build_collection_from_vectors(spark, scaled(4.0), 64, 8)
    qs = api.build_query_set_from_vectors(spark, scaled(0.5).withColumnRenamed("point_id", "query_id"))
    return _hits(api.search(col, qs, "dense", S.PAGE_SIZE, threshold=None))


# ---------------------------------------------------------------------------
# R11 approximate dense search, R12 batch search of a whole vector table
# ---------------------------------------------------------------------------

def _norm_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.load(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("dense"))
    return R.normalize_vectors(e, ["dense"]).where(F.col("dense").isNotNull())


_EMB_SCORES = """en AS (SELECT vec_id AS id, i, embedding[i] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS v
  FROM embeddings, range(1, 65) r(i)),
pair AS (SELECT q.id AS query_id, p.id AS point_id, (round(sum(q.v * p.v), 6) + 0.0) AS score
  FROM en q JOIN en p USING (i) GROUP BY q.id, p.id)"""


@register("batch_search", f"WITH {_EMB_SCORES}\n" + O.select_hits(O.ranked("pair", S.PAGE_SIZE)))
def batch_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding queries the embeddings table (k-NN self-join),
    both sides dealt into blocks that meet on the executors."""
    work_dir(spark)
    pts = _norm_embeddings(spark, sf).checkpoint()   # counted, then read for both sides: materialise it
    q = pts.select(F.col("point_id").alias("query_id"), "dense")
    return _hits(retrieve.dense_topk_blocks(pts, q, S.PAGE_SIZE, block_bytes=256 << 10))


_LSH_TABLES, _LSH_BITS, _LSH_SEED = 16, 6, 7
_LSH = f"""{_EMB_SCORES},
planes AS (SELECT t, b, i, {O._comp(f"('plane{_LSH_SEED}:' || t || ':' || b)", '(i - 1)')} AS p
  FROM range({_LSH_TABLES}) x(t), range({_LSH_BITS}) y(b), range(1, 65) z(i)),
sig AS (SELECT id, t, sum(CASE WHEN s > 0 THEN 1 << b ELSE 0 END) AS bucket FROM (
  SELECT id, t, b::INTEGER AS b, sum(v * p) AS s FROM en JOIN planes USING (i) GROUP BY id, t, b) GROUP BY id, t),
cand AS (SELECT DISTINCT q.id AS query_id, p.id AS point_id FROM sig q JOIN sig p USING (t, bucket)),
near AS (SELECT pair.* FROM pair JOIN cand USING (query_id, point_id))"""


@register("dense_lsh_topk", f"WITH {_LSH}\n" + O.select_hits(O.ranked("near", S.PAGE_SIZE)))
def dense_lsh_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Random-hyperplane LSH candidates, exact rescoring; approximate by
    design (``lsh_recall`` compares with R12), but its signatures are SQL too."""
    pts = _norm_embeddings(spark, sf)
    q = pts.select(F.col("point_id").alias("query_id"), "dense")
    return _hits(retrieve.dense_lsh_topk(pts, q, S.PAGE_SIZE, tables=_LSH_TABLES, bits=_LSH_BITS, seed=_LSH_SEED, dim=64))


@register("lsh_recall", f"""WITH {_LSH}
SELECT e.query_id, count(a.point_id)::BIGINT AS found, count(*)::BIGINT AS wanted, count(a.point_id) / count(*) AS recall
FROM {O.ranked("pair", S.PAGE_SIZE)} e LEFT JOIN {O.ranked("near", S.PAGE_SIZE)} a USING (query_id, point_id) GROUP BY e.query_id""")
def lsh_recall(spark: SparkSession, sf: str) -> DataFrame:
    """R11 quality: recall@10 of the LSH search against the exact search."""
    pts = _norm_embeddings(spark, sf)
    q = pts.select(F.col("point_id").alias("query_id"), "dense")
    exact = retrieve.dense_topk_blocks(pts, q, S.PAGE_SIZE)
    approx = retrieve.dense_lsh_topk(pts, q, S.PAGE_SIZE, tables=_LSH_TABLES, bits=_LSH_BITS, seed=_LSH_SEED, dim=64)
    return retrieve.lsh_recall(approx, exact)


@register("ivf_recall")
def ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """recall@10 of the inverted-file index with quantised residuals against the exact search, every embedding asking;
    with the share of vectors that a query's lists hold (no SQL twin: the lists come from k-means)."""
    from hyrank.operators import ivf
    pts = _norm_embeddings(spark, sf)
    q = pts.select(F.col("point_id").alias("query_id"), "dense")
    quantizer = ivf.fit(pts, k=S.PAGE_SIZE)
    index = ivf.build(pts, quantizer)
    got = ivf.search(index, quantizer, pts, q, S.PAGE_SIZE)
    share = min(quantizer.probes, len(quantizer.centroids)) / len(quantizer.centroids)
    return retrieve.lsh_recall(got, retrieve.dense_topk_blocks(pts, q, S.PAGE_SIZE)).withColumn("list_share", F.lit(float(share)))


# ---------------------------------------------------------------------------
# Evaluation (V1-V4)
# ---------------------------------------------------------------------------

from hyrank.operators import evaluate as V  # noqa: E402

_HEAD = "split_part(coalesce(d.text, ''), chr(10), 1)"
_REL = f"(lower({_HEAD}) LIKE '%test%' OR lower({_HEAD}) LIKE '%qa%')"


def _flagged(hits: DataFrame, points: DataFrame, bound: int | None = None) -> DataFrame:
    return V.relevance_flag(shape.project_hits(hits, points, ["headline"], hit_bound=bound))


@register("relevance_flag", O.with_base(
    f"SELECT h.query_id, h.point_id, h.rank, {_REL} AS relevant FROM "
    f"{O.rrf_sql([_D, _S], S.PAGE_SIZE)} h JOIN documents d ON d.doc_id = h.point_id"))
def relevance_flag(spark: SparkSession, sf: str) -> DataFrame:
    """V1: headline contains 'test' or 'qa' (substring), on the RRF top-10."""
    col, qs = corpus(spark, sf)
    return _flagged(S.rrf_dense_sparse(col, qs), col.points, qs.n * S.PAGE_SIZE) \
        .select("query_id", "point_id", "rank", "relevant")


def _cut_sql(src: str, method: str) -> str:
    return f"""SELECT query_id, '{method}' AS method, rank::BIGINT AS cutoff, rel::BIGINT AS relevant,
  (round(rel / rank, 6) + 0.0) AS ratio FROM (
  SELECT h.query_id, h.rank, sum(CASE WHEN {_REL} THEN 1 ELSE 0 END)
         OVER (PARTITION BY h.query_id ORDER BY h.rank ROWS UNBOUNDED PRECEDING) AS rel
  FROM {src} h JOIN documents d ON d.doc_id = h.point_id) WHERE rank % 50 = 0"""


@register("hits_at_cutoffs", O.with_base(_cut_sql(O.rrf_sql([_D, _S], None), "rrf_dense_sparse")))
def hits_at_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    """V2: relevant results among the first 50, 100, ... of the whole RRF list."""
    col, qs = corpus(spark, sf)
    f = _flagged(S.rrf_dense_sparse(col, qs, k=None), col.points, qs.n * 2 * S.PREFETCH) \
        .withColumn("method", F.lit("rrf_dense_sparse"))
    return V.hits_at_cutoffs(f)


_TOTAL_SRC = {
    "dense": O.ranked("dense_scores", None, f"WHERE score >= {S.DENSE_THRESHOLD}"),
    "sparse": O.ranked("sparse_scores", None),
    "rrf_dense_sparse": O.rrf_sql([_D, _S], None),
    "rerank_late": O.ranked(O.late_on(_UNION), None),
    "multistep": O.ranked(O.late_on(_CASCADE_S), None),
}


@register("total_results", O.with_base(" UNION ALL ".join(
    f"SELECT query_id, '{m}' AS method, count(*)::BIGINT AS total FROM {src} GROUP BY query_id"
    for m, src in _TOTAL_SRC.items())))
def total_results(spark: SparkSession, sf: str) -> DataFrame:
    """V3: results seen when paging each strategy to its end (dense with the
    0.6 threshold, sparse to the last matching point, fusions and cascades
    to the end of their prefetches)."""
    col, qs = corpus(spark, sf)
    runs = {"dense": S.dense(col, qs, None, ranked=False), "sparse": S.sparse(col, qs, None, ranked=False),
            "rrf_dense_sparse": S.rrf_dense_sparse(col, qs, None), "rerank_late": S.rerank_late(col, qs, None),
            "multistep": S.multistep(col, qs, None)}
    out = None
    for m, h in runs.items():
        part = V.total_results(h.withColumn("method", F.lit(m)))
        out = part if out is None else out.unionByName(part)
    return out


_DEPTH = 200
_CMP_SRC = {
    "dense": O.ranked("dense_scores", _DEPTH, f"WHERE score >= {S.DENSE_THRESHOLD}"),
    "sparse": O.ranked("sparse_scores", _DEPTH),
    "late": O.ranked("late_scores", _DEPTH),
    "rrf_dense_sparse": O.rrf_sql([_D, _S], _DEPTH),
    "rrf_all": O.rrf_sql([_D, _S, _L], _DEPTH),
    "rerank_late": O.ranked(O.late_on(_UNION), _DEPTH),
    "multistep": O.ranked(O.late_on(_CASCADE_S), _DEPTH),
}


@register("compare_methods", O.with_base(
    "SELECT method, cutoff, count(*)::BIGINT AS queries, sum(relevant)::BIGINT AS relevant, "
    "(round(sum(relevant) / (cutoff * count(*)), 6) + 0.0) AS ratio FROM ("
    + " UNION ALL ".join(_cut_sql(src, m) for m, src in _CMP_SRC.items())
    + ") GROUP BY method, cutoff"))
def compare_methods(spark: SparkSession, sf: str) -> DataFrame:
    """V4: all seven strategies on the same queries, hit rate every 50 results
    down to a depth of 200."""
    col, qs = corpus(spark, sf)
    runs = S.all_strategies(col, qs, _DEPTH)
    return V.compare_methods(runs, points=col.points, hit_bound=len(runs) * qs.n * _DEPTH)

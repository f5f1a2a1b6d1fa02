"""Representation building (E1-E7): corpus and queries use the same code.

* E1 ``embed_dense``  text -> one unit vector (pluggable batch embedder)
* E2 ``bm25_weights`` text -> postings (point_id, term, tf, dl, weight)
* E3 ``idf_table``    postings -> (term, n, idf)
* E4 ``embed_late``   text -> one unit vector per distinct token
* E5 ``normalize_vectors`` L2-normalise vector columns once, at write time
* E6 ``build_points`` all representations of a corpus in one pass over its texts
* E7 ``build_queries`` the same representations for a query table
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyrank.functions import kernels, text
from hyrank.functions.vectors import l2_normalize, normalize_tokens

DENSE_DIM = 32
LATE_DIM = 16

# Stored precision: float32 (computation happens in float64).
VEC = T.ArrayType(T.FloatType())
MULTIVEC = T.ArrayType(T.ArrayType(T.FloatType()))
PACKED = T.ArrayType(T.BinaryType())        # token vectors of a collection: float32 bytes (kernels.packed_tokens)


def embed_dense(df: DataFrame, id_col: str = "point_id", text_col: str = "text",
                dim: int = DENSE_DIM, out_col: str = "dense", kernel=None) -> DataFrame:
    """(id, dense) with the hashing embedder by default, L2-normalised.

    ``kernel(dim, id_col, tok_col, out_col)`` may be any Arrow batch
    embedder (a model loaded once per Python worker); tasks batch rows.
    """
    kernel = kernel or kernels.dense_embed_kernel
    src = df.select(F.col(id_col), text.tokens(text_col).alias("_toks"))
    schema = T.StructType([df.schema[id_col], T.StructField(out_col, VEC, True)])
    return src.mapInArrow(kernel(dim, id_col, "_toks", out_col), schema)


def embed_late(df: DataFrame, id_col: str = "point_id", text_col: str = "text",
               dim: int = LATE_DIM, out_col: str = "late", kernel=None, keep: str | None = None) -> DataFrame:
    """(id, late) -- one unit vector per distinct token of the whole text; with ``keep`` the tokens beside them
    (id, keep, late), so that no join is needed to tell whose vector it is.

    The hashing embedder is context free, so repeated tokens give equal
    vectors and MaxSim is unchanged by keeping each token once.
    """
    kernel = kernel or kernels.late_embed_kernel
    src = df.select(F.col(id_col), F.array_distinct(text.tokens(text_col)).alias("_toks"))
    kept = [T.StructField(keep, src.schema["_toks"].dataType, True)] if keep else []
    schema = T.StructType([df.schema[id_col], *kept, T.StructField(out_col, MULTIVEC, True)])
    return src.mapInArrow(kernel(dim, id_col, "_toks", out_col, **({"keep": keep} if keep else {})), schema)


def term_frequencies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl) per document without a shuffle.

    A document never spans partitions, so term counts are computed per row, in the tasks' Arrow batches. At scale this
    replaces a shuffle of ~0.6x the corpus' token count with row-local work.
    """
    src = df.select(F.col(id_col), text.tokens(text_col).alias("_toks"))

    def run(batches):
        import pyarrow as pa
        for whole in batches:
            for b in kernels.sliced(whole, "_toks"):
                dl, names, _, term, tf, off = kernels.sparse_batch(b.column("_toks"))
                lists = pa.array(off.astype("int32"))
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(dl), pa.ListArray.from_arrays(lists, names.take(pa.array(term))),
                                                  pa.ListArray.from_arrays(lists, pa.array(tf.astype("int32")))], names=[id_col, "dl", "terms", "tf"])

    rows = src.mapInArrow(run, T.StructType([df.schema[id_col], *SPARSE_FIELDS]))
    z = rows.select(id_col, "dl", F.explode(F.arrays_zip("terms", "tf")).alias("_z"))
    return z.select(id_col, F.col("_z.terms").alias("term"), F.col("_z.tf").cast("long").alias("tf"), "dl")


def bm25_weights(df: DataFrame, id_col: str = "point_id", text_col: str = "text",
                 k1: float = text.BM25_K1, b: float = text.BM25_B, avgdl: float = text.BM25_AVGDL,
                 stopwords: list[str] | None = None) -> DataFrame:
    """Postings (id, term, tf, dl, weight) over the whole text.

    Term frequencies and the document length are row-local (no shuffle);
    the weight is plain column arithmetic in double.
    """
    post = term_frequencies(df, id_col, text_col)
    if stopwords:
        post = post.where(~F.col("term").isin(list(stopwords)))
    return post.select(id_col, "term", "tf", "dl",
                       text.bm25_weight(F.col("tf"), F.col("dl"), k1, b, avgdl).alias("weight"))


def n_with_terms(df: DataFrame, id_col: str = "point_id", text_col: str = "text") -> Column:
    """N of ``idf_table`` as a scalar: points whose text has a token. The text is searched for its first one, not tokenised."""
    some = F.lower(F.col(text_col)).rlike(text.TOKEN_PATTERN)
    return df.where(some).select(F.count_distinct(id_col)).scalar()


def idf_table(postings: DataFrame, n_points: Column | int | None = None,
              id_col: str = "point_id") -> DataFrame:
    """(term, n, idf); N is the number of points with a sparse vector.

    N is a scalar subquery, so the plan stays lazy and no driver round trip
    is needed. Document frequencies combine map-side, so hot terms are cheap.
    """
    if n_points is None:
        n_col = postings.select(F.count_distinct(id_col)).scalar()
    elif isinstance(n_points, Column):
        n_col = n_points
    else:
        n_col = F.lit(int(n_points))
    dfreq = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return dfreq.select("term", "n", text.idf(n_col, F.col("n")).alias("idf"))


def idf_of(frequencies: DataFrame, n_points: int) -> DataFrame:
    """(term, n, idf) of known document frequencies (term, n) among ``n_points``."""
    return frequencies.select("term", "n", text.idf(F.lit(int(n_points)), F.col("n")).alias("idf"))


def normalize_vectors(df: DataFrame, cols: list[str], multivector_cols: list[str] = ()) -> DataFrame:
    """E5: unit-length vectors (JVM side); zero/empty vectors become null."""
    out = df
    for c in cols:
        out = out.withColumn(c, l2_normalize(c))
    for c in multivector_cols:
        out = out.withColumn(c, normalize_tokens(c))
        out = out.withColumn(c, F.when(F.size(c) > 0, F.col(c)))
    return out


def embed_all(df: DataFrame, id_col: str = "point_id", text_col: str = "text",
              dense_dim: int = DENSE_DIM, late_dim: int = LATE_DIM,
              keep: list[str] = (), stopwords: list[str] | None = None, embedder=None, packed: bool = False) -> DataFrame:
    """Every representation of a row in one Arrow pass over one token array: (id, keep..., dl, terms, tf, dense, late).

    ``terms`` and ``tf`` are the row's distinct tokens and their counts, ``dl`` its number of tokens;
    stopwords are left out of the terms, not of the vectors or of ``dl``. ``embedder(dense_dim)`` makes the
    token embedder of a worker: ``dim`` and ``vectors(tokens) -> matrix`` (default: the hashing embedder).
    ``packed``: late vectors as bytes, the form points are stored in.
    """
    if late_dim > dense_dim:
        raise ValueError("late_dim must not exceed dense_dim (late vectors reuse the dense token hashes)")
    src = df.select(F.col(id_col), *[F.col(c) for c in keep], text.tokens(text_col).alias("_toks"))
    fields = [df.schema[id_col]] + [df.schema[c] for c in keep]
    schema = T.StructType(fields + SPARSE_FIELDS + [T.StructField("dense", VEC, True), T.StructField("late", PACKED if packed else MULTIVEC, True)])
    names = [id_col, *keep]

    def run(batches):
        import pyarrow as pa
        emb = (embedder or kernels.embedder)(dense_dim)
        for whole in batches:
            for b in kernels.sliced(whole, "_toks"):
                terms, tf, dl, dense, late = kernels.embed_batch(b.column("_toks"), emb, late_dim, packed)
                yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(dl), terms, tf, dense, late],
                                                 names=names + ["dl", "terms", "tf", "dense", "late"])

    out = src.mapInArrow(run, schema)
    if stopwords:
        both = F.filter(F.arrays_zip("terms", "tf"), lambda x: ~x["terms"].isin(list(stopwords)))
        out = out.withColumn("_z", both).withColumn("terms", F.col("_z.terms")).withColumn("tf", F.col("_z.tf")).drop("_z")
    return out


SPARSE_FIELDS = [T.StructField("dl", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType())),
                 T.StructField("tf", T.ArrayType(T.IntegerType()))]


def with_weights(df: DataFrame, k1: float = text.BM25_K1, b: float = text.BM25_B, avgdl: float = text.BM25_AVGDL) -> DataFrame:
    """BM25 ``weights`` beside ``terms`` and ``tf`` (the sparse vector of a row)."""
    return df.withColumn("weights", F.transform("tf", lambda tf: text.bm25_weight(tf, F.col("dl"), k1, b, avgdl)))


def with_sparse(df: DataFrame, id_col: str, text_col: str | None) -> DataFrame:
    """``df`` with dl, terms, tf and weights from a text column, in the row (without one: empty)."""
    if text_col is None:
        none = df.withColumn("dl", F.lit(0).cast("long")).withColumn("terms", F.array().cast("array<string>"))
        return with_weights(none.withColumn("tf", F.array().cast("array<int>")))
    toks = df.withColumn("_t", F.array_sort(F.coalesce(text.tokens(text_col), F.array().cast("array<string>"))))
    terms = toks.withColumn("dl", F.size("_t").cast("long")).withColumn("terms", F.array_distinct("_t"))
    # tokens are sorted: a term's count is the distance between where it and the next term begin
    starts = terms.withColumn("_s", F.transform("terms", lambda t: F.array_position("_t", t).cast("int")))
    ends = F.concat(F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))), F.array((F.col("dl") + 1).cast("int")))
    tf = F.when(F.size("_s") > 0, F.zip_with("_s", ends, lambda a, b: b - a)).otherwise(F.array().cast("array<int>"))
    return with_weights(starts.withColumn("tf", tf)).drop("_t", "_s")


def exploded(points: DataFrame, id_col: str = "point_id", keep: list[str] = ()) -> DataFrame:
    """Postings (id, keep..., term, tf, dl, weight) of rows with sparse vectors; no text is read again."""
    z = points.select(id_col, *keep, "dl", F.explode(F.arrays_zip("terms", "tf", "weights")).alias("_z"))
    return z.select(id_col, *keep, F.col("_z.terms").alias("term"), F.col("_z.tf").cast("long").alias("tf"), "dl",
                    F.col("_z.weights").alias("weight"))


def build_points(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 payload: list[str] = (), dense_dim: int = DENSE_DIM, late_dim: int = LATE_DIM,
                 stopwords: list[str] | None = None, embedder=None):
    """(points, postings) of a corpus table; points: point_id, payload..., dl, terms, tf, weights, dense, late.

    The postings are the points' sparse vectors in long form. Callers write the points and
    take ``exploded`` of what they wrote, so every text is read and tokenised once.
    """
    base = docs.select(F.col(id_col).alias("point_id"), F.col(text_col).alias("text"), *payload)
    points = with_weights(embed_all(base, "point_id", "text", dense_dim, late_dim, keep=list(payload), stopwords=stopwords, embedder=embedder, packed=True))
    return points, exploded(points)


def packed(points: DataFrame, col: str = "late") -> DataFrame:
    """``points`` with their token vectors in the stored form."""
    if points.schema[col].dataType == PACKED:
        return points
    schema = T.StructType([T.StructField(col, PACKED) if f.name == col else f for f in points.schema])
    return points.mapInArrow(kernels.pack_kernel(col), schema)


def build_queries(queries: DataFrame, id_col: str = "item_id", text_col: str = "text",
                  dense_dim: int = DENSE_DIM, late_dim: int = LATE_DIM, query_mode: str = "document",
                  stopwords: list[str] | None = None, embedder=None):
    """(queries, query_terms) with the document-mode embedders; queries: query_id, text, dl, terms, tf, weights,
    dense, late.

    ``query_mode='document'`` keeps BM25-saturated query weights (as the
    searched system does); ``'unit'`` gives every query term weight 1.
    """
    base = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text"))
    q = with_weights(embed_all(base, "query_id", "text", dense_dim, late_dim, keep=["text"], stopwords=stopwords, embedder=embedder))
    if query_mode == "unit":
        q = q.withColumn("weights", F.transform("weights", lambda w: F.lit(1.0)))
    return q, query_terms(q)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qweight) of queries with sparse vectors."""
    return exploded(queries, "query_id").select("query_id", "term", F.col("weight").alias("qweight"))

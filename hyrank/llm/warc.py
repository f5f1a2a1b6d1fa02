"""WARC archives: writing, and reading back by boundary-chain verification.

Writing. One record per row. Of rows with equal payloads of at least
``min_revisit_bytes`` bytes the smallest page_id is a ``response``, the others are ``revisit``
records without payload that refer to it. Records go out through Spark's
text writer (a record ends in a newline, which is the line separator), so any store
Spark can write holds the archives; a file takes at most ``records_per_file`` records.

Reading. Spark's text reader cuts the files, in splits, at the magic
``WARC/1.``. Every piece's byte offset is the sum of the lengths before it in
its file. A piece whose head parses is a candidate record and says where its
successor starts (head + Content-Length + 4). Payloads may contain the magic, even whole fake
records, so candidates prove nothing; only the chain from offset 0 does. A task
shortens the pointers of its split's candidates to where their chains leave the split; pointer
jumping then crosses splits: each round the reached set takes one jump and the jumps double,
so a file of n splits needs about log2(n) rounds of joins on (file, offset). Unreached
pieces are payload bytes of the record before them and are put back there.

Null html: empty payload. Null url: empty target. Null page_id: written
without an id and read back as null; it never becomes the one referred to while a
copy has an id. Rows that repeat a page_id: all rows with the smallest id of
their payload are responses. Only plain (uncompressed) archives can be split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyrank.llm.common import cut, table
from hyrank.session import scratch_path

# Fixed values of the format.
MAGIC = "WARC/1."
DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MIN_REVISIT_BYTES = 0
RECORDS_PER_FILE = 2048
BROADCAST_ROWS = 200_000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: five hex digits are four base32 digits."""
    sha = F.sha1(payload)
    out = []
    for i in range(8):
        bits = F.conv(F.substring(sha, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(DIGITS32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _digested(pages: DataFrame, html_col: str) -> DataFrame:
    payload = F.coalesce(F.col(html_col), F.lit(""))
    return pages.withColumn("_payload", payload).withColumn("_bytes", F.octet_length("_payload").cast("long")) \
        .withColumn("_digest", base32_sha1(F.col("_payload").cast("binary")))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One column ``value``: a whole record, but for its last newline."""
    own = _digested(pages.select(id_col, url_col, html_col), html_col)
    groups = own.where(F.col("_bytes") >= min_revisit_bytes).groupBy("_digest", "_bytes").agg(
        F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    groups = cut(groups)
    # payloads stay where they are if the repeated ones are few (about 60 bytes each); else an ordinary join
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = own.join(F.broadcast(groups) if few else groups, ["_digest", "_bytes"], "left")
    revisit = F.coalesce(F.col("_first") < F.col(id_col), F.col("_first").isNotNull() & F.col(id_col).isNull())
    # a target must stay on its line
    target = F.translate(F.coalesce(F.col(url_col), F.lit("")), "\r\n", "  ")
    body = F.when(revisit, F.lit("")).otherwise(F.col("_payload"))
    head = F.concat(
        F.lit(MAGIC + "0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Target-URI: "), target,
        F.when(F.col(id_col).isNull(), "").otherwise(F.concat(F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col(id_col).cast("string"), F.lit(">"))),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("_first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_digest"), F.lit("\r\nX-Payload-Length: "), F.col("_bytes").cast("string"),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return own.select(F.concat(head, body, F.lit("\r\n\r")).alias("value"))


def write_warc(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, **columns) -> None:
    records(pages, **columns).write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?im)^{name}: *([^\r\n]*)", 1)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, data): the bytes before the first and after every magic, in order."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), F.col("value").cast("binary").alias("data"))
    return raw


def located(spark: SparkSession, path: str) -> DataFrame:
    """Narrow table of all pieces: place, length, and for candidates what their head says."""
    at = F.instr(F.col("text"), "\r\n\r\n")
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), F.col("value").alias("text"))
    parsed = raw.withColumn("size", F.octet_length("text").cast("long")).withColumn(
        "head", F.when(F.col("text").rlike(r"^[0-9]\r\n") & (at > 0), F.substring_index("text", "\r\n\r\n", 1)))
    parsed = parsed.withColumn("head_size", F.octet_length("head").cast("long") + 4) \
        .withColumn("length", F.regexp_extract("head", r"(?im)^Content-Length: *([0-9]{1,18})[ \t]*(?:\r|$)", 1))
    parsed = parsed.withColumn("length", F.when(F.col("length") != "", F.col("length").cast("long")))
    # a record that ends where its piece does carries its own payload
    whole = F.col("head_size") + F.col("length") + 4 == F.col("size")
    payload = F.substring(F.col("text").cast("binary"), F.col("head_size").cast("int") + 1, F.col("length").cast("int"))
    return parsed.select(
        "file", "block", "nth", "size", "head_size", "length",
        F.when(F.col("length").isNotNull(), F.struct(
            _field("WARC-Type").alias("type"), _field("WARC-Target-URI").alias("url"), _field("WARC-Record-ID").alias("id"),
            _field("WARC-Refers-To").alias("refers"), _field("WARC-Payload-Digest").alias("digest"),
            _field("X-Payload-Length").alias("payload_length"))).alias("fields"),
        F.when(whole, base32_sha1(payload)).alias("own_digest"))


def offsets(found: DataFrame) -> DataFrame:
    """Adds ``nth`` within the block, ``lo`` (offset of the magic before the piece) and ``next`` (of its successor).

    Sums run inside a split; the splits of a file are then added up.
    """
    step = len(MAGIC)
    inside = Window.partitionBy("file", "block").orderBy("nth")
    found = found.withColumn("end", F.sum(F.col("size") + step).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = found.withColumn("nth", F.row_number().over(inside))
    splits = found.groupBy("file", "block").agg(F.max("end").alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0).cast("long"))).drop("total")
    # the first piece of a file lies before any magic, so a piece's magic is ``step`` bytes before its bytes
    found = found.join(splits, ["file", "block"]).withColumn("lo", F.col("base") + F.col("end") - F.col("size") - 2 * step)
    jump = F.col("lo") + step + F.col("head_size") + F.col("length") + 4
    return found.withColumn("next", jump).drop("base", "end")


def _by_split(candidates: DataFrame, one_split, schema: str) -> DataFrame:
    """``one_split(lo, next, entry)`` -> (lo, value) lists, for the candidates of each split in order of offset."""
    src = candidates.repartition("file", "block").sortWithinPartitions("file", "block", "lo")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        key, rows = None, []

        def close():
            if rows:
                lo, value = one_split(*zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(lo), pa.string()), pa.array(lo, pa.int64()),
                                                  pa.array(value, pa.int64())], names=names)

        for b in batches:
            for file, block, *row in zip(*(b.column(c).to_pylist() for c in ("file", "block", "lo", "next", "entry"))):
                if (file, block) != key:
                    yield from close()
                    key, rows = (file, block), []
                rows.append(row)
        yield from close()

    return src.mapInArrow(run, schema)


def exits(lo, nxt, entry) -> tuple[list[int], list[int]]:
    """Where the chain from each candidate first leaves the split (or meets no candidate)."""
    place = {x: i for i, x in enumerate(lo)}
    out = list(nxt)
    for i in range(len(lo) - 1, -1, -1):
        j = place.get(nxt[i], -1)
        if j > i:
            out[i] = out[j]
    return list(lo), out


def walked(lo, nxt, entry) -> tuple[list[int], list[int]]:
    """The candidates of the split on a chain from one of its entries."""
    due, kept, after = set(), [], []
    for x, y, e in zip(lo, nxt, entry):
        if e or x in due:
            kept.append(x)
            after.append(y)
            due.add(y)
    return kept, after


def reached(found: DataFrame) -> DataFrame:
    """(file, lo) of the records on the chain from the start of each file.

    Inside a split a candidate's pointer is first shortened to where its chain leaves
    the split. Pointer jumping then only has to cross splits.
    """
    nodes = found.where(F.col("length").isNotNull()).select("file", "block", "lo", "next")
    jumps = cut(_by_split(nodes.withColumn("entry", F.lit(False)), exits, "file string, lo long, next long"))
    real = jumps.select("file", F.col("lo").alias("next"))
    # a jump that ends nowhere (end of file, or a fake) leads no further
    jumps = cut(jumps.join(real, ["file", "next"], "left_semi"))
    got = cut(nodes.where(F.col("lo") == 0).select("file", "lo"))
    count = got.count()
    while count and not jumps.isEmpty():
        more = got.join(jumps, ["file", "lo"]).select("file", F.col("next").alias("lo"))
        got = cut(got.unionAll(more).distinct())
        count, before = got.count(), count
        if count == before:
            break
        second = jumps.select("file", F.col("lo").alias("next"), F.col("next").alias("after"))
        jumps = cut(jumps.join(second, ["file", "next"]).select("file", "lo", F.col("after").alias("next")))
    marked = nodes.join(got.withColumn("hit", F.lit(True)), ["file", "lo"], "left").withColumn("entry", F.col("hit").isNotNull())
    return cut(_by_split(marked.drop("hit"), walked, "file string, lo long, next long").select("file", "lo"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives: file, lo, type, url, id, refers, digest, payload_length, own_digest, own_length."""
    scratch = scratch_path(spark, "warc-pieces")
    offsets(located(spark, path)).write.parquet(scratch)
    found = spark.read.parquet(scratch)
    chain = reached(found)
    kept = found.join(chain, ["file", "lo"])
    # records whose payload spans several pieces are read once more and put together
    spans = cut(kept.where(F.col("own_digest").isNull()).select("file", "lo", "next", "head_size", "length"))
    kept = kept.select("file", "lo", "fields.*", "own_digest", F.col("length").alias("own_length"))
    if spans.isEmpty():
        return kept
    joined = assembled(spark, path, found, spans).select(
        "file", "lo", base32_sha1(F.col("payload")).alias("joined_digest"))
    return kept.join(joined, ["file", "lo"], "left").withColumn("own_digest", F.coalesce("own_digest", "joined_digest")).drop("joined_digest")


def assembled(spark: SparkSession, path: str, found: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, lo, payload) of records whose payload holds the magic.

    Pieces that follow a record inside its payload belong to it: the owner is the
    last such record that starts at or before them.
    """
    step = len(MAGIC)
    starts = spans.select("file", F.col("lo").alias("at"), F.lit(0).alias("kind"), F.struct("lo", "next", "head_size", "length").alias("own"),
                          F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("nth"))
    rows = starts.unionByName(found.select("file", F.col("lo").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["own"].dataType).alias("own"),
                                           "block", F.col("nth").cast("int").alias("nth")))
    last = Window.partitionBy("file").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = rows.withColumn("own", F.last("own", True).over(last)).where((F.col("kind") == 1) & (F.col("at") < F.col("own.next")))
    owned = cut(owned.select("file", "block", "nth", "at", "own"))
    raw = pieces(spark, path)
    raw = raw.withColumn("nth", F.row_number().over(Window.partitionBy("file", "block").orderBy("nth")))
    got = raw.join(owned, ["file", "block", "nth"]).groupBy("file", "own").agg(
        F.array_sort(F.collect_list(F.struct("at", "data"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, F.lit(MAGIC.encode()), p["data"]))
    body = F.substring(whole, step + F.col("own.head_size").cast("int") + 1, F.col("own.length").cast("int"))
    return got.select("file", F.col("own.lo").alias("lo"), body.alias("payload"))


def op10(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    got = read_warc(spark, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)        # noqa: E731
    told = F.regexp_replace("digest", "^sha1:", "")
    revisit = F.col("type") == "revisit"
    return got.select(
        F.when(number("id") != "", number("id")).cast("long").alias("page_id"),
        F.when(revisit, F.col("payload_length").cast("long")).otherwise(F.col("own_length")).alias("payload_bytes"),
        F.when(revisit, told).otherwise(F.col("own_digest")).alias("payload_digest"), F.col("type").alias("record_type"),
        F.when(number("refers") != "", number("refers")).cast("long").alias("refers_to"))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha1(html) AS s, html FROM p),
d AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((CAST('0x' || substr(s, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * CAST(i % 4 AS INTEGER))) & 31), 1)),
        'string_agg', '') AS digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""

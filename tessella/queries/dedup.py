"""Queries of the deduplication side: chunks, duplicates, archives, sizes."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from tessella.operators import archive, chunking, dedup
from tessella.plans.compress import CompressPlan, compress, restore
from tessella.session import materialize

from .common import LINES_SQL, query, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


def _cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.cdc_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_idx"), F.col("text").cast("binary").alias("content"))


@query()
def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks of every text with their digests."""
    return chunking.cdc_layout(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id AS file_idx, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents WHERE octet_length(encode(text)) > 0")
def cdc_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks neither lose nor add bytes."""
    return _cdc(spark, sf_dir).groupBy("file_idx").agg(F.sum("n").alias("bytes"))


@query("""WITH f AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents WHERE octet_length(encode(text)) > 0),
k AS (SELECT doc_id, n, b, unnest(range((n + 4095) // 4096)) AS l2 FROM f)
SELECT doc_id AS file_idx, CAST(l2 AS INTEGER) AS l2, CAST(l2 * 4096 AS BIGINT) AS "offset", CAST(least(4096, n - l2 * 4096) AS BIGINT) AS n FROM k""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 4,096 bytes."""
    return chunking.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 4096).select("file_idx", "l2", "offset", "n")


@query()
def coarse_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels: parts that end at the first anchor after 8,192 bytes, and chunks inside them."""
    params = chunking.ChunkParams(coarse_anchor=8192)
    return chunking.cdc_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", params).select("file_idx", "l1", "l2", "is_last_l2", "offset", "n")


@query("SELECT doc_id AS file_idx, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, true AS joined FROM documents WHERE octet_length(encode(text)) > 0")
def coarse_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of two levels neither lose nor add bytes, and each begins where the one before ends."""
    chunks = coarse_chunks(spark, sf_dir)
    before = F.sum("n").over(Window.partitionBy("file_idx").orderBy("l1", "l2")) - F.col("n")
    return chunks.withColumn("joined", before == F.col("offset")).groupBy("file_idx").agg(F.sum("n").alias("bytes"), F.every("joined").alias("joined"))


@query("SELECT doc_id, sha1(text) AS sha1, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(data).alias("sha1"), F.octet_length(data).cast("long").alias("n"))


_FLAGS = """SELECT file_idx, CAST(l2 AS INTEGER) AS l2, CAST(n AS BIGINT) AS n, sha1, row_number() OVER w > 1 AS is_dup,
first_value(file_idx) OVER w AS first_file, CAST(first_value(l2) OVER w AS INTEGER) AS first_l2 FROM chunks"""


@query(f"WITH {LINES_SQL} {_FLAGS} WINDOW w AS (PARTITION BY file_idx, sha1 ORDER BY l2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def dedup_flag_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.flag_duplicates(_lines(spark, sf_dir), "file").select("file_idx", "l2", "n", "sha1", "is_dup", "first_file", "first_l2")


@query(f"WITH {LINES_SQL} {_FLAGS} WINDOW w AS (PARTITION BY sha1 ORDER BY file_idx, l2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def dedup_flag_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.flag_duplicates(_lines(spark, sf_dir), "global").select("file_idx", "l2", "n", "sha1", "is_dup", "first_file", "first_l2")


@query(f"WITH {LINES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sha1 ORDER BY file_idx, l2) AS k FROM chunks) SELECT file_idx, CAST(l2 AS INTEGER) AS l2, sha1 FROM r WHERE k = 1")
def dedup_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.unique_chunks(dedup.flag_duplicates(_lines(spark, sf_dir), "global")).select("file_idx", "l2", "sha1")


@query(f"WITH {LINES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sha1 ORDER BY file_idx, l2) AS k FROM chunks) SELECT file_idx, CAST(l2 AS INTEGER) AS l2, sha1 FROM r WHERE k > 1")
def dedup_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_chunks(dedup.flag_duplicates(_lines(spark, sf_dir), "global")).select("file_idx", "l2", "sha1")


_STATS = f"""WITH {LINES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sha1 ORDER BY file_idx, l2) AS k FROM chunks),
s AS (SELECT count(*) AS n_chunks, count(*) FILTER (k > 1) AS n_dups, CAST(coalesce(sum(n), 0) AS BIGINT) AS bytes_in, CAST(coalesce(sum(n) FILTER (k = 1), 0) AS BIGINT) AS bytes_unique FROM r)"""


@query(f"{_STATS} SELECT * FROM s")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_stats(dedup.flag_duplicates(_lines(spark, sf_dir), "global"))


@query(f"{_STATS} SELECT round(100.0::DOUBLE * n_dups / n_chunks, 6) AS dup_percent, round(bytes_in::DOUBLE / bytes_unique, 6) AS dedup_factor, bytes_in - bytes_unique AS bytes_saved FROM s")
def dedup_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = dedup.ratios(dedup.dedup_stats(dedup.flag_duplicates(_lines(spark, sf_dir), "global")))
    return r.select(F.round("dup_percent", 6).alias("dup_percent"), F.round("dedup_factor", 6).alias("dedup_factor"), "bytes_saved")


@query(f"WITH {LINES_SQL} SELECT CAST(least(n >> 7, 255) AS INTEGER) AS slot, count(*) AS chunks FROM chunks GROUP BY 1")
def chunk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.size_histogram(_lines(spark, sf_dir))


@query(f"""WITH {LINES_SQL}, h AS (SELECT least(n >> 7, 255) * 128 + 64 AS mid, count(*) AS c FROM chunks GROUP BY 1),
s AS (SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * mid) AS BIGINT) AS s1, CAST(sum(c * mid * mid) AS BIGINT) AS s2 FROM h)
SELECT n AS n_chunks, round(s1::DOUBLE / n, 4) AS mean_size, round(sqrt(greatest(0, s2 - (s1::DOUBLE / n) * s1)), 2) AS spread_sum, round(sqrt(greatest(0, s2 - (s1::DOUBLE / n) * s1) / n), 4) AS stddev_size FROM s""")
def chunk_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dedup.size_stats(dedup.size_histogram(_lines(spark, sf_dir)))
    return s.select("n_chunks", F.round("mean_size", 4).alias("mean_size"), F.round("spread_sum", 2).alias("spread_sum"), F.round("stddev_size", 4).alias("stddev_size"))


@query(f"""WITH {LINES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY file_idx, sha1 ORDER BY l2) AS k FROM chunks)
SELECT file_idx, CAST(5 + sum(CASE WHEN k > 1 THEN 29 ELSE 9 + n END) AS BIGINT) AS archive_bytes FROM r GROUP BY file_idx""")
def archive_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of archives without compression."""
    return dedup.archive_sizes(dedup.flag_duplicates(_lines(spark, sf_dir), "file"), F.col("n"))


@query("SELECT doc_id AS file_idx, sha1(text) AS sha1, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents WHERE octet_length(encode(text)) > 0")
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks to compressed archives and back."""
    made, _ = compress(_files(spark, sf_dir))
    back = restore(made.where("n_records > 0"))
    return back.select("file_idx", F.sha1("content").alias("sha1"), F.octet_length("content").cast("long").alias("n"))


@query("SELECT doc_id AS file_idx, sha1(text) AS sha1, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents WHERE octet_length(encode(text)) > 0")
def archive_roundtrip_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one fingerprint index for all files, decoded by a join."""
    made, _ = compress(_files(spark, sf_dir), CompressPlan(scope="global", codec="bzip2"))
    back = archive.decode_records(materialize(archive.archive_records(made), "records"))
    return back.select("file_idx", F.sha1("content").alias("sha1"), F.octet_length("content").cast("long").alias("n"))


@query(f"""WITH {LINES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY file_idx, sha1 ORDER BY l2) AS k FROM chunks)
SELECT file_idx, CAST(5 + sum(CASE WHEN k > 1 THEN 29 ELSE 9 + n END) AS BIGINT) AS archive_bytes, count(*) AS n_records FROM r WHERE n > 0 GROUP BY file_idx""")
def archive_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of the lines of texts, uncompressed, written record by record: their real sizes."""
    lines = _lines(spark, sf_dir).where("n > 0")
    return archive.write_archives(dedup.flag_duplicates(lines, "file"), "none").select("file_idx", F.octet_length("archive").cast("long").alias("archive_bytes"), "n_records")


@query()
def archive_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and ratios of all archives, zlib."""
    archives, flagged = compress(_files(spark, sf_dir))
    made = archives.agg(F.sum(F.octet_length("archive")).alias("bytes_out"), F.sum("bytes_compressed").alias("bytes_compressed"))
    stats = dedup.dedup_stats(flagged).withColumn("one", F.lit(1)).join(made.withColumn("one", F.lit(1)), "one").drop("one")
    return dedup.ratios(stats).withColumn("size_in", dedup.human_size(F.col("bytes_in"))).withColumn("size_out", dedup.human_size(F.col("bytes_out")))


@query("""WITH b AS (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) * 997 AS n FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, CASE WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS k FROM b)
SELECT doc_id, printf('%.2f', round(n / pow(1024, k), 2)) || ' ' || ['B', 'KB', 'MB', 'GB'][k + 1] AS size FROM p""")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", dedup.human_size(F.octet_length("text").cast("long") * 997).alias("size"))


@query(f"WITH {LINES_SQL} SELECT file_idx, string_agg(line, chr(10) ORDER BY l2) AS text FROM chunks GROUP BY file_idx")
def reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that come in any order, put back in order for each file."""
    mixed = _lines(spark, sf_dir).select("file_idx", "l2", F.col("data").cast("string").alias("line")).repartition("l2")
    parts = mixed.groupBy("file_idx").agg(F.array_sort(F.collect_list(F.struct("l2", "line"))).alias("p"))
    return parts.select("file_idx", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("text"))


@query("""WITH c AS (SELECT conv_id, turn, role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS is_last, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS l2 FROM conversations)
SELECT conv_id, turn, CAST(l2 AS INTEGER) AS l2, is_last FROM c""")
def sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level sequence numbers of conversations, with the last one of each marked."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).alias("l2"), F.lead("turn").over(w).isNull().alias("is_last"))


@query("""WITH p AS (SELECT page_id, string_split(html, chr(10)) AS ls FROM pages WHERE html IS NOT NULL), l AS (SELECT page_id, unnest(ls) AS line FROM p),
c AS (SELECT sha1(line) AS sha1, count(*) AS k, octet_length(encode(any_value(line))) AS n FROM l GROUP BY 1)
SELECT CAST(sum(k) AS BIGINT) AS n_chunks, CAST(sum(k - 1) AS BIGINT) AS n_dups, CAST(sum(k * n) AS BIGINT) AS bytes_in, CAST(sum(n) AS BIGINT) AS bytes_unique FROM c""")
def dedup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over all web pages."""
    return dedup.dedup_stats(dedup.flag_duplicates(chunking.line_chunks(table(spark, sf_dir, "pages"), "page_id", "html"), "global"))

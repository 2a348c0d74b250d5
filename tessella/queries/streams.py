"""Queries that run as streams over all that a table has."""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tessella.operators import chunking
from tessella.session import shared_dir
from tessella.streaming import dedup as streams

from .common import LINES_SQL, query


def _in_parts(spark: SparkSession, lines: DataFrame, parts: int = 3) -> DataFrame:
    """Lines as a stream of several micro-batches: ranges of files, written one after the other and read in that order."""
    folder = f"{shared_dir(spark)}/tessella/stream-parts-{uuid.uuid4().hex}"
    lines = lines.select("file_idx", "l2", "n", "sha1")
    cuts = lines.agg(F.percentile_approx("file_idx", [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        inside = (F.lit(True) if low is None else F.col("file_idx") > low) & (F.lit(True) if high is None else F.col("file_idx") <= high)
        # one file each: a micro-batch takes one file
        lines.where(inside).repartition(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query(f"""WITH {LINES_SQL} SELECT file_idx, CAST(l2 AS INTEGER) AS l2, CAST(n AS BIGINT) AS n, sha1, row_number() OVER w > 1 AS is_dup,
first_value(file_idx) OVER w AS first_file, CAST(first_value(l2) OVER w AS INTEGER) AS first_l2 FROM chunks WINDOW w AS (PARTITION BY sha1 ORDER BY file_idx, l2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a stream of several batches through dedup with a fingerprint index: each line with the first one of its kind."""
    lines = chunking.line_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return streams.flag_to_table(_in_parts(spark, lines))


@query(f"""WITH {LINES_SQL} SELECT file_idx, count(*) AS parts, CAST(sum(n) AS BIGINT) AS bytes, true AS in_order FROM chunks GROUP BY file_idx""")
def stream_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a stream, emitted in sequence for each file; every part leaves, in order."""
    lines = chunking.line_chunks(streams.read_table_stream(spark, sf_dir, "documents"), "doc_id", "text")
    out = streams.emit_to_table(lines)
    return out.groupBy("file_idx").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("bytes"), F.every(F.col("l2") == F.col("emitted")).alias("in_order"))


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_throughput_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows over the events as a stream, complete at the end."""
    out = streams.run_to_table(streams.throughput_windows(streams.read_table_stream(spark, sf_dir, "events"), "value", "ts"), "complete")
    return out.select(F.unix_micros("window_start").alias("window_start"), "n", F.round("total", 4).alias("total"))

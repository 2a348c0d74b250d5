"""Compress and restore folders of files, with a report."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Row

from tessella.operators import archive, chunking, dedup
from tessella.session import materialize


@dataclass(frozen=True)
class CompressPlan:
    """Chunking parameters, scope of the fingerprint index (file or global) and codec."""

    chunks: chunking.ChunkParams = field(default_factory=chunking.ChunkParams)
    scope: str = "file"
    codec: str = "gzip"


def compress(files: DataFrame, plan: CompressPlan = CompressPlan()) -> tuple[DataFrame, DataFrame]:
    """(archives, flagged layout of chunks) of files (file_idx, content); an empty file has an archive without records.

    Files are cut once. Their layout is written, duplicates are found on it, and it comes back to the files to pack them.
    """
    layout = materialize(chunking.cdc_layout(files, "file_idx", "content", plan.chunks), "layout")
    flagged = materialize(dedup.flag_duplicates(layout, plan.scope), "flagged")
    made = archive.pack_files(files, flagged, plan.codec)
    empty = files.where(F.coalesce(F.octet_length(F.col("content").cast("binary")), F.lit(0)) == 0)
    none = empty.select(F.col("file_idx").cast("long"), F.lit(archive.header(plan.codec)).alias("archive"), *[F.lit(0).cast("long").alias(c) for c in ("n_records", "bytes_in", "bytes_compressed")])
    return made.unionByName(none), flagged


def restore(archives: DataFrame, scope: str = "file") -> DataFrame:
    """(file_idx, content) of archives made with the given scope."""
    return archive.decode_archives(archives) if scope == "file" else archive.decode_records(materialize(archive.archive_records(archives), "records"))


def report(archives: DataFrame, flagged: DataFrame) -> str:
    """A readable summary: sizes in and out, chunks, duplicates and ratios."""
    sizes = archives.agg(F.coalesce(F.sum(F.octet_length("archive")), F.lit(0)).alias("bytes_out"), F.coalesce(F.sum("bytes_compressed"), F.lit(0)).alias("bytes_compressed")).first()
    stats = dedup.dedup_stats(flagged).withColumn("bytes_out", F.lit(sizes.bytes_out)).withColumn("bytes_compressed", F.lit(sizes.bytes_compressed))
    row: Row = dedup.ratios(stats).select("*", *[dedup.human_size(F.col(c)).alias(f"h_{c}") for c in ("bytes_in", "bytes_unique", "bytes_compressed", "bytes_out")]).first()
    shape = dedup.size_stats(dedup.size_histogram(flagged)).first()
    number = lambda v, form: "-" if v is None else format(v, form)
    return "\n".join(
        [
            f"Bytes in:            {row.h_bytes_in}",
            f"After dedup:         {row.h_bytes_unique} (factor {number(row.dedup_factor, '.3f')})",
            f"After compression:   {row.h_bytes_compressed} (factor {number(row.local_factor, '.3f')})",
            f"Bytes out:           {row.h_bytes_out} (factor {number(row.compression_factor, '.3f')}, overhead {number(row.overhead_percent, '.2f')} %)",
            f"Chunks:              {row.n_chunks}, {row.n_dups} duplicates ({number(row.dup_percent, '.2f')} %)",
            f"Mean chunk size:     {number(shape.mean_size, '.1f')}, deviation {number(shape.stddev_size, '.1f')}",
        ]
    )

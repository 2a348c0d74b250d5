"""First-occurrence dedup of chunks, and its statistics.

scope ``file``: a chunk repeats an earlier one of its file; ``global``: of any file, in the order (file, l1, l2). The
first occurrence is an aggregate with partial sums before the shuffle, and only fingerprints that occur twice or more
are written and joined back. Fingerprints with over a thousandth of all repeated chunks are fewer than a thousand and are
broadcast within that bound; the others are joined by a shuffle in which none has more than that share.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tessella.session import materialize

from .chunking import size_slot, with_fingerprint

SCOPES = ("file", "global")
#: A hot fingerprint has more than this share of the repeated chunks, and so many copies at least.
HOT_SHARE, HOT_LEAST = 1000, 10_000


def flag_duplicates(chunks: DataFrame, scope: str = "file") -> DataFrame:
    """chunks with is_dup, first_file, first_l1, first_l2 (the occurrence that comes first in output order)."""
    if scope not in SCOPES:
        raise ValueError(f"scope is one of {SCOPES}")
    chunks = with_fingerprint(chunks)
    keys = ["file_idx", "sha1"] if scope == "file" else ["sha1"]
    place = F.struct(F.col("file_idx").alias("f"), F.col("l1").alias("l1"), F.col("l2").alias("l2"))
    firsts = chunks.groupBy(*keys).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    firsts = materialize(firsts.select(*[F.col(k).alias(f"k_{k}") for k in keys], "first", "copies"), "first-chunks")
    limit = max(HOT_LEAST, (firsts.agg(F.sum("copies")).first()[0] or 0) // HOT_SHARE)
    on = F.col("sha1") == F.col("k_sha1")
    if scope == "file":
        on = on & F.col("file_idx").eqNullSafe(F.col("k_file_idx"))
    hot, cold = F.broadcast(firsts.where(F.col("copies") > limit).limit(HOT_SHARE)), firsts.where(F.col("copies") <= limit)
    names = [*chunks.columns, "first"]
    if firsts.where(F.col("copies") > limit).isEmpty():
        joined = chunks.join(cold, on, "left")
    else:
        joined = chunks.join(hot, on, "inner").select(*names).union(chunks.join(hot, on, "left_anti").join(cold, on, "left").select(*names))
    dup = F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first"))
    of = lambda field, own: F.coalesce(F.col(f"first.{field}"), F.col(own))
    return joined.select(*chunks.columns, dup.alias("is_dup"), of("f", "file_idx").alias("first_file"), of("l1", "l1").alias("first_l1"), of("l2", "l2").alias("first_l2"))


def unique_chunks(flagged: DataFrame) -> DataFrame:
    return flagged.where("not is_dup")


def duplicate_chunks(flagged: DataFrame) -> DataFrame:
    return flagged.where("is_dup")


def dedup_stats(flagged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_chunks, n_dups, bytes_in, bytes_unique; one row, or one for each group."""
    flag = F.col("is_dup")
    return flagged.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count(F.when(flag, 1)).alias("n_dups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("bytes_in"), F.coalesce(F.sum(F.when(~flag, F.col("n"))), F.lit(0)).alias("bytes_unique"),
    )


def ratios(stats: DataFrame) -> DataFrame:
    """Share of duplicates in percent, dedup factor and saved bytes; with bytes_compressed and bytes_out also local factor, compression factor and overhead in percent."""
    safe = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    out = stats.withColumn("dup_percent", 100 * safe("n_dups", "n_chunks")).withColumn("dedup_factor", safe("bytes_in", "bytes_unique")).withColumn("bytes_saved", F.col("bytes_in") - F.col("bytes_unique"))
    if {"bytes_compressed", "bytes_out"} <= set(stats.columns):
        out = out.withColumn("local_factor", safe("bytes_unique", "bytes_compressed")).withColumn("compression_factor", safe("bytes_in", "bytes_out")).withColumn("overhead_percent", 100 * (F.col("bytes_out") - F.col("bytes_compressed")) / F.col("bytes_out"))
    return out


def size_histogram(chunks: DataFrame) -> DataFrame:
    """(slot, chunks) of the sizes of chunks."""
    return chunks.groupBy(size_slot(F.col("n")).alias("slot")).agg(F.count(F.lit(1)).alias("chunks"))


def size_stats(histogram: DataFrame) -> DataFrame:
    """From a histogram: mean by slot midpoints, the root of the summed squares (spread_sum) and the true deviation of the midpoints."""
    mid = F.col("slot") * 128 + 64
    sums = histogram.agg(F.sum("chunks").alias("n"), F.sum(F.col("chunks") * mid).alias("s1"), F.sum(F.col("chunks") * mid * mid).alias("s2"))
    mean = F.col("s1") / F.col("n")
    square = F.greatest(F.lit(0.0), F.col("s2") - mean * F.col("s1"))
    return sums.select(F.col("n").alias("n_chunks"), mean.alias("mean_size"), F.sqrt(square).alias("spread_sum"), F.sqrt(square / F.col("n")).alias("stddev_size"))


def archive_sizes(flagged: DataFrame, payload: Column) -> DataFrame:
    """Bytes of each file's archive: a header of 5, 9 and the payload for a unique chunk, 29 for a duplicate."""
    return flagged.groupBy("file_idx").agg((F.lit(5) + F.sum(F.when(F.col("is_dup"), F.lit(29)).otherwise(payload + 9))).cast("long").alias("archive_bytes"))


def human_size(n: Column) -> Column:
    """Bytes in the largest unit below which a number of 1 or more is left: ``1.50 KB``."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    power = F.when(n < 1024, F.lit(0)).otherwise(F.least(F.lit(len(units) - 1), sum(((n >= 1024**k).cast("int") for k in range(1, len(units))), F.lit(0))))
    value = F.round(n / F.pow(F.lit(1024.0), power), 2)
    return F.concat(F.format_string("%.2f", value), F.lit(" "), F.element_at(F.array(*[F.lit(u) for u in units]), power + 1))

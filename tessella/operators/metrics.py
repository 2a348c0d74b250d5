"""Stage latencies and throughput, from time-stamped rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from tessella.session import ship

MICROS = 1_000_000


def stage_latency(rows: DataFrame, key: str, ts: str, order: list[str]) -> DataFrame:
    """rows with latency_us: microseconds since the previous row of the key; null for the first."""
    w = Window.partitionBy(key).orderBy(*order)
    stamp = F.unix_micros(F.col(ts).cast("timestamp"))
    return rows.withColumn("latency_us", stamp - F.lag(stamp).over(w))


def latency_summary(rows: DataFrame, latency: str, is_dup: str) -> DataFrame:
    """Mean latency of all rows, of duplicates and of the others, with the numbers of rows behind each."""
    flag = F.col(is_dup)
    return rows.agg(F.count(latency).alias("n"), F.avg(latency).alias("mean_us"), F.count(F.when(flag, F.col(latency))).alias("n_dup"), F.avg(F.when(flag, F.col(latency))).alias("mean_dup_us"), F.count(F.when(~flag, F.col(latency))).alias("n_unique"), F.avg(F.when(~flag, F.col(latency))).alias("mean_unique_us"))


def throughput(rows: DataFrame, amount: str, ts: str) -> DataFrame:
    """Total amount, seconds from first to last row, and their ratio."""
    stamp = F.unix_micros(F.col(ts).cast("timestamp"))
    s = rows.agg(F.sum(amount).alias("total"), ((F.max(stamp) - F.min(stamp)) / MICROS).alias("seconds"))
    return s.select("total", "seconds", F.when(F.col("seconds") > 0, F.col("total") / F.col("seconds")).alias("per_second"))


def throughput_windows(rows: DataFrame, amount: str, ts: str, width: str = "1 hour") -> DataFrame:
    """Aligned windows: (window_start, n, total)."""
    return rows.groupBy(F.window(F.col(ts).cast("timestamp"), width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total")).select(F.col("w.start").alias("window_start"), "n", "total")


def elapsed_intervals(rows: DataFrame, key: str, ts: str, amount: str, seconds: float) -> DataFrame:
    """Intervals that close with the first time at least ``seconds`` after the last close: (key, interval, t_first, t_last, n, total, mean, per_second); the rest is flushed at the end.

    Rows of one time belong together and are added up before the shuffle. A key's times are then streamed in order
    through one task, which holds a batch of them and steps from close to close.
    """
    ship(rows.sparkSession)
    width = int(seconds * MICROS)
    schema = pa.schema([("key", pa.string()), ("interval", pa.int32()), ("t_first", pa.int64()), ("t_last", pa.int64()), ("n", pa.int64()), ("total", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        key_now, begin, number, held, out = nothing, 0, 0, None, []

        def close() -> None:
            nonlocal held, number
            if held:
                out.append({"key": key_now, "interval": number, "t_first": held[0], "t_last": held[1], "n": held[2], "total": held[3]})
                held, number = None, number + 1

        def add(stamps: np.ndarray, n: np.ndarray, total: np.ndarray) -> None:
            nonlocal held
            if len(stamps):
                first, so_far, amount = (held[0], held[2], held[3]) if held else (int(stamps[0]), 0, 0.0)
                held = first, int(stamps[-1]), so_far + int(n.sum()), amount + float(total.sum())

        for batch in batches:
            keys = batch.column("key").to_pylist()
            stamps, n, total = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("stamp", "n", "total"))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if key_now is nothing or keys[lo] != key_now:
                    close()
                    key_now, begin, number = keys[lo], int(stamps[lo]), 0
                at = lo
                while (end := lo + int(np.searchsorted(stamps[lo:hi], begin + width))) < hi:
                    add(stamps[at : end + 1], n[at : end + 1], total[at : end + 1])
                    close()
                    at, begin = end + 1, int(stamps[end])
                add(stamps[at:hi], n[at:hi], total[at:hi])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    stamp = F.unix_micros(F.col(ts).cast("timestamp"))
    times = rows.groupBy(F.col(key).cast("string").alias("key"), stamp.alias("stamp")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(amount).cast("double")).alias("total")).where("stamp is not null")
    made = times.withColumn("total", F.coalesce("total", F.lit(0.0))).repartition("key").sortWithinPartitions("key", "stamp").mapInArrow(run, "key string, interval int, t_first long, t_last long, n long, total double")
    return made.withColumn("mean", F.col("total") / F.col("n")).withColumn("per_second", F.when(F.col("t_last") > F.col("t_first"), F.col("total") * MICROS / (F.col("t_last") - F.col("t_first"))))

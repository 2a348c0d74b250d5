"""Stateful stream operators: dedup by fingerprint, ordered emission, interval metrics."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.session import shared_dir, ship


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream, a bounded number of files for each micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def flag_duplicates(chunks: DataFrame) -> DataFrame:
    """A stream of chunks (file_idx, l2, n, sha1) with is_dup, first_file and first_l2: duplicates are kept and flagged, the state of a fingerprint is its first place and never ends.

    Inside a micro-batch the first place in output order is the original; later batches refer to it.
    """
    ship(chunks.sparkSession)

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = sorted(row for pdf in frames for row in zip(pdf["file_idx"].tolist(), pdf["l2"].tolist(), pdf["n"].tolist(), strict=True))
        known = state.exists
        first = state.get if known else rows[0][:2]
        if not known:
            state.update(first)
        f, l2, n = zip(*rows, strict=True)
        m = len(rows)
        yield pd.DataFrame({"file_idx": f, "l2": l2, "n": n, "sha1": [key[0]] * m, "is_dup": [known or r[:2] != first for r in rows], "first_file": [first[0]] * m, "first_l2": [first[1]] * m}, copy=False)

    return chunks.select("file_idx", "l2", "n", "sha1").groupBy("sha1").applyInPandasWithState(
        run, "file_idx long, l2 int, n long, sha1 string, is_dup boolean, first_file long, first_l2 int", "first_file long, first_l2 int", "append", GroupStateTimeout.NoTimeout
    )


def _numbered_folders(spark: SparkSession, folder: str) -> list[int]:
    """The numbers that name subfolders, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(path) if x.getPath().getName().isdigit()) if fs.exists(path) else []


def flag_to_table(chunks: DataFrame, base: str | None = None) -> DataFrame:
    """Like flag_duplicates(), over all that is there, with the fingerprint index as a table instead of a state.

    A micro-batch reduces its chunks to the first place of each fingerprint, looks those up in the index, appends the
    new ones and flags its chunks; all in built-in operators. Index and results have a folder for each batch, which a
    repeated batch overwrites, so each batch counts once. All that a batch needs of earlier ones is below ``base``, with
    the checkpoint: called again with the same base, the stream goes on where it ended, in another driver as well.
    """
    spark = chunks.sparkSession
    base = base or f"{shared_dir(spark)}/tessella/stream-{uuid.uuid4().hex}"
    index_schema = "sha1 string, first_file long, first_l2 int, batch long"
    out_schema = "file_idx long, l2 int, n long, sha1 string, is_dup boolean, first_file long, first_l2 int"

    def take(df: DataFrame, batch: int) -> None:
        session = df.sparkSession
        rows = df.select("file_idx", "l2", "n", "sha1")
        own = rows.groupBy("sha1").agg(F.min(F.struct("file_idx", "l2")).alias("place"))
        earlier = [f"{base}/index/{b}" for b in _numbered_folders(session, f"{base}/index") if b < batch]
        known = session.read.schema(index_schema).parquet(*earlier) if earlier else session.createDataFrame([], index_schema)
        found = own.join(known.select(F.col("sha1").alias("k"), "first_file", "first_l2"), F.col("sha1") == F.col("k"), "left")
        new = found.where("k is null").select("sha1", F.col("place.file_idx").alias("first_file"), F.col("place.l2").cast("int").alias("first_l2"), F.lit(batch).cast("long").alias("batch"))
        new.write.mode("overwrite").parquet(f"{base}/index/{batch}")
        index = session.read.schema(index_schema).parquet(*earlier, f"{base}/index/{batch}")
        flagged = rows.join(index.withColumnRenamed("sha1", "k"), F.col("sha1") == F.col("k"))
        dup = (F.col("batch") < batch) | (F.col("file_idx") != F.col("first_file")) | (F.col("l2") != F.col("first_l2"))
        flagged.select("file_idx", "l2", "n", "sha1", dup.alias("is_dup"), "first_file", "first_l2").write.mode("overwrite").parquet(f"{base}/out/{batch}")

    chunks.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(take).start().awaitTermination()
    done = [f"{base}/out/{b}" for b in _numbered_folders(spark, f"{base}/out")]
    return spark.read.schema(out_schema).parquet(*done) if done else spark.createDataFrame([], out_schema)


def drop_duplicates_within(chunks: DataFrame, ts: str, delay: str) -> DataFrame:
    """A stream without repeats of a fingerprint within the delay: bounded state, an extension for endless streams."""
    return chunks.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["sha1"])


def emit_in_order(chunks: DataFrame) -> DataFrame:
    """A stream of (file_idx, l2, n) in any order as rows with ``emitted``: each file's chunks leave in sequence; those that come early wait in its state."""
    ship(chunks.sparkSession)

    def run(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, raw = state.get if state.exists else (0, pickle.dumps({}))
        waiting = pickle.loads(raw)
        for pdf in frames:
            waiting.update(zip(pdf.l2.tolist(), pdf.n.tolist(), strict=True))
        rows = []
        while following in waiting:
            rows.append((key[0], following, waiting.pop(following), following))
            following += 1
        fresh = pickle.dumps(waiting)
        if fresh != raw or rows or not state.exists:
            state.update((following, fresh))
        yield pd.DataFrame(rows, columns=["file_idx", "l2", "n", "emitted"])

    return chunks.select("file_idx", "l2", "n").groupBy("file_idx").applyInPandasWithState(run, "file_idx long, l2 int, n long, emitted int", "following int, waiting binary", "append", GroupStateTimeout.NoTimeout)


def emit_to_table(chunks: DataFrame, base: str | None = None) -> DataFrame:
    """Like emit_in_order(), over all that is there, with tables instead of a state: the chunks that wait, and each file's next number.

    A micro-batch ranks its chunks and those that wait within their files, beginning with the file's next number; a chunk
    leaves if its number is its rank. All in built-in operators: a file is no call of its own, and its chunks are sorted,
    not held. Results, waiting chunks and numbers have a folder for each batch, which a repeated batch overwrites; with the
    same ``base`` the stream goes on where it ended, as in flag_to_table().
    """
    spark = chunks.sparkSession
    base = base or f"{shared_dir(spark)}/tessella/stream-{uuid.uuid4().hex}"
    schema = "file_idx long, l2 int, n long, emitted int"

    def take(df: DataFrame, batch: int) -> None:
        session = df.sparkSession
        earlier = [b for b in _numbered_folders(session, f"{base}/next") if b < batch]
        rows = df.select(F.col("file_idx").cast("long").alias("file_idx"), F.col("l2").cast("int").alias("l2"), F.col("n").cast("long").alias("n"), F.lit(False).alias("waited"))
        begin = F.lit(0)
        if earlier:
            waiting = session.read.schema(schema).parquet(f"{base}/placed/{earlier[-1]}").where("emitted is null")
            rows = rows.unionByName(waiting.select("file_idx", "l2", "n", F.lit(True).alias("waited")))
            following = session.read.schema("file_idx long, following int").parquet(*[f"{base}/next/{b}" for b in earlier]).groupBy(F.col("file_idx").alias("of")).agg(F.max("following").alias("following"))
            rows = rows.join(following, F.col("file_idx").eqNullSafe(F.col("of")), "left").drop("of")
            begin = F.coalesce("following", F.lit(0))
        # of chunks with one number the last to come counts; those that have left don't come back
        place = Window.partitionBy("file_idx").orderBy("l2", "waited", "n")
        ranks = rows.where(F.col("l2") >= begin).withColumn("again", F.coalesce(F.lag("l2").over(place) == F.col("l2"), F.lit(False))).withColumn("due", begin + F.dense_rank().over(place) - 1)
        placed = ranks.where("not again").select("file_idx", "l2", "n", F.when(F.col("l2") == F.col("due"), F.col("due")).cast("int").alias("emitted"))
        placed.write.mode("overwrite").parquet(f"{base}/placed/{batch}")
        left = session.read.schema(schema).parquet(f"{base}/placed/{batch}").where("emitted is not null")
        left.groupBy("file_idx").agg((F.max("emitted") + 1).cast("int").alias("following")).write.mode("overwrite").parquet(f"{base}/next/{batch}")

    chunks.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(take).start().awaitTermination()
    done = [f"{base}/placed/{b}" for b in _numbered_folders(spark, f"{base}/next")]
    return spark.read.schema(schema).parquet(*done).where("emitted is not null") if done else spark.createDataFrame([], schema)


def throughput_windows(events: DataFrame, amount: str, ts: str, width: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Aligned windows over a stream; with a delay, state ends behind the watermark."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    stamped = stamped.withWatermark("_ts", delay) if delay else stamped
    return stamped.groupBy(F.window("_ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total")).select(F.col("w.start").alias("window_start"), "n", "total")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote.

    Append results go to a file sink, which commits each batch once; complete and update ones are replaced or
    overwritten by batch. The sink and the checkpoint are in the shared folder.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/tessella/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    else:
        keep: Callable[[DataFrame, int], None] = lambda df, epoch: df.write.mode("overwrite").parquet(f"{base}/out")
        writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


class ProgressLog(StreamingQueryListener):
    """Collects rows, rates and state sizes of each micro-batch: the stream's own interval metrics."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def onQueryStarted(self, event) -> None:
        """Nothing to note."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append({"batch": p.batchId, "timestamp": p.timestamp, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "state_bytes": sum(s.memoryUsedBytes for s in p.stateOperators)})

    def onQueryIdle(self, event) -> None:
        """Nothing to note."""

    def onQueryTerminated(self, event) -> None:
        """Nothing to note."""

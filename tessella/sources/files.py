"""File sources: folders of files, images, archives, and a generator of synthetic text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tessella.functions import jpeg
from tessella.session import materialize, open_path, ship


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows (with distinct values of a column) with name: the place of each value in their order, from 0.

    The values are sorted by ranges and written; a row's number is its place in its range and the number of rows in the
    ranges before, which is all that is collected.
    """
    sorted_ = materialize(rows.repartitionByRange(column).sortWithinPartitions(column).select("*", F.spark_partition_id().alias("_range"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_place")), "numbered")
    before, total = {}, 0
    for r in sorted_.groupBy("_range").count().orderBy("_range").collect():
        before[r["_range"]] = total
        total += r["count"]
    starts = F.split(F.lit(",".join(str(before.get(i, 0)) for i in range(max(before, default=0) + 1))), ",").cast("array<long>")
    return sorted_.select(*rows.columns, (F.get(starts, F.col("_range")) + F.col("_place")).alias(name))


def scan_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(file_idx, file_name, size, content) of a folder's files but those whose name starts with a dot; file_idx numbers them by path.

    Only paths are sorted to number them. Spark's scan leaves out empty files.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    files = found.where(~F.element_at(F.split("path", "/"), -1).startswith("."))
    places = numbered(files.select("path"), "path", "file_idx").withColumnRenamed("path", "n_path")
    return files.join(places, F.col("path") == F.col("n_path")).select("file_idx", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"), "content")


def scan_paths(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(file_idx, path, size) of the same files without their contents, for reading them block by block."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    files = found.where(~F.element_at(F.split("path", "/"), -1).startswith(".")).select("path", F.col("length").alias("size"))
    return numbered(files, "path", "file_idx").select("file_idx", "path", "size")


def file_totals(files: DataFrame) -> DataFrame:
    """Number and total size of files."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """(name, width, height, bgr) of the images below a folder, decoded in the JVM; name is the path below it, bgr has rows of blue, green, red bytes. Grey images get equal bytes, opacity is left out; hidden files and broken images are left out."""
    found = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder)
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()
    plain = lambda path: F.regexp_replace(path, "^file:/+", "file:/")
    name = F.substring(plain(F.col("image.origin")), F.length(plain(F.lit(root))) + 2, F.length("image.origin"))
    pixels, channels = F.hex("image.data"), F.col("image.nChannels")
    bgr = F.when(channels == 3, F.col("image.data")).when(channels == 1, F.unhex(F.regexp_replace(pixels, "(..)", "$1$1$1"))).when(channels == 4, F.unhex(F.regexp_replace(pixels, "(......)..", "$1")))
    return found.where(~F.element_at(F.split("image.origin", "/"), -1).startswith(".")).select(name.alias("name"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), bgr.alias("bgr"))


def encode_jpegs(images: DataFrame, quality: int = 90) -> DataFrame:
    """(name, content) of images (name, width, height, bgr) as JPEG files. No shuffle."""
    ship(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bgr = np.frombuffer(row["bgr"], np.uint8).reshape(row["height"], row["width"], 3)
                yield pa.RecordBatch.from_arrays([pa.array([row["name"]]), pa.array([jpeg.encode(bgr[:, :, ::-1], quality)], pa.binary())], names=["name", "content"])

    return images.select("name", "width", "height", "bgr").mapInArrow(run, "name string, content binary")


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes rows (name, content) as files of a folder, on any file system that pyarrow opens; each has its name only when it is complete, so a task may run again. The number of files."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_path(folder)
        system.create_dir(path, recursive=True)
        for batch in batches:
            names = batch.column("name").to_pylist()
            for name, content in zip(names, batch.column("content").to_pylist(), strict=True):
                part = f"{path}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(content)
                system.move(part, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return rows.select("name", F.col("content").cast("binary")).mapInArrow(run, "name string").count()


#: Patterns of generated lines: each letter is a block of 20 characters; R is random, F fixed, A, B, C are repeats of themselves.
PATTERNS = ("RAND", "AAR", "ABC", "FFF", "FFR", "RFF")


def synthetic_text(spark: SparkSession, lines: int, pattern: str = "RAND", seed: int = 0) -> DataFrame:
    """(line_no, line): lines of three blocks of 20 letters. R blocks differ in every line, A, B and C blocks are one letter each, drawn for the line, F blocks are the same everywhere."""
    if pattern not in PATTERNS:
        raise ValueError(f"pattern is one of {PATTERNS}")
    letter = lambda salt: F.chr((97 + F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(salt)), F.lit(26))).cast("long"))
    blocks = []
    for i, kind in enumerate("RRR" if pattern == "RAND" else pattern):
        if kind == "R":
            blocks.append(F.concat(*[letter(100 * i + j) for j in range(20)]))
        elif kind == "F":
            blocks.append(F.lit("f" * 20))
        else:
            blocks.append(F.repeat(letter(ord(kind)), F.lit(20)))
    return spark.range(lines).select(F.col("id").alias("line_no"), F.concat_ws(" ", *blocks).alias("line"))

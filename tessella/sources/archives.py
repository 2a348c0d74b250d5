"""Archives as files: reading through Spark's binary source, and a Python data source named ``ddp`` that reads and writes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessella.functions.codecs import codec_by_code
from tessella.operators import archive
from tessella.session import open_path, ship

SUFFIX, PART = ".ddp", ".part"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(file_idx, file_name, archive) of a folder's archives; any store that Spark reads."""
    from .files import scan_files

    files = scan_files(spark, folder)
    return files.where(F.col("file_name").endswith(SUFFIX)).select("file_idx", "file_name", F.col("content").alias("archive"))


def decode_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, content) of all archives of a folder."""
    files = read_archives(spark, folder)
    names = files.select("file_idx", F.regexp_replace("file_name", r"\.ddp$", "").alias("file_name"))
    return archive.decode_archives(files).join(names, "file_idx").select("file_name", "content")


class ArchiveSource(DataSource):
    """format("ddp"): reads records (file_name, rec_no, kind, sha1, data) of the archives at a path; writes rows (file_name, archive) as one file each.

    A path is a URI or a local path that pyarrow's file systems open (file, hdfs, s3, gs) and that all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "ddp"

    def schema(self) -> str:
        return "file_name string, rec_no long, kind int, sha1 string, data binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    """Names of the files that a task wrote beside the old ones."""

    parts: list[str]


def _listed(path: str, suffix: str) -> list[str]:
    """Base names of the files with a suffix right below a folder, in order."""
    from pyarrow import fs

    system, folder = open_path(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(suffix))


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        system, name = open_path(self.path)
        if system.get_file_info(name).is_file:
            return [_File(self.path)]
        return [_File(f"{self.path}/{f}") for f in _listed(self.path, SUFFIX)]

    def read(self, partition: _File) -> Iterator[tuple]:
        system, name = open_path(partition.path)
        with system.open_input_stream(name) as f:
            code, records = archive.parse_archive(f.read())
        expand = codec_by_code(code).decompress
        for i, (kind, payload) in enumerate(records):
            data = expand(payload) if kind == archive.COMPRESSED else None
            yield name.rsplit("/", 1)[-1], i, kind, hashlib.sha1(data).hexdigest() if data is not None else payload.hex(), data


class _Writer(DataSourceWriter):
    """Tasks write under names of their own; the commit gives the files their names, and only then old ones go."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, folder = open_path(self.path)
        system.create_dir(folder, recursive=True)
        parts = []
        for row in rows:
            parts.append(f"{row.file_name}{SUFFIX}.{uuid.uuid4().hex}{PART}")
            with system.open_output_stream(f"{folder}/{parts[-1]}") as f:
                f.write(row.archive)
        return _Written(parts)

    def commit(self, messages: list) -> None:
        system, folder = open_path(self.path)
        old = set(_listed(self.path, SUFFIX)) if self.overwrite else set()
        for part in (p for m in messages if m for p in m.parts):
            name = part[: -len(PART) - 33]
            system.move(f"{folder}/{part}", f"{folder}/{name}")
            old.discard(name)
        for name in old:
            system.delete_file(f"{folder}/{name}")

    def abort(self, messages: list) -> None:
        system, folder = open_path(self.path)
        for part in (p for m in messages if m for p in m.parts):
            system.delete_file(f"{folder}/{part}")


def register(spark: SparkSession) -> None:
    """Makes format("ddp") known to the session."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)

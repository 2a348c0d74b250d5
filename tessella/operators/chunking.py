"""Chunking of files into rows: content-defined, by lines or of fixed size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tessella.functions import rabin
from tessella.session import open_path, ship

CHUNKS = "file_idx long, l1 int, l2 int, is_last_l2 boolean, offset long, n long, data binary"
LAYOUT = "file_idx long, l1 int, l2 int, is_last_l2 boolean, offset long, n long, sha1 string"


@dataclass(frozen=True)
class ChunkParams:
    """window and mask of the rolling fingerprint; coarse_anchor: least distance of first-level anchors (none: a file is one first-level part)."""

    window: int = rabin.WINDOW
    mask: int = rabin.MASK
    coarse_anchor: int | None = None


def split_levels(content: bytes, params: ChunkParams) -> list[tuple[int, list[int]]]:
    """(offset, second-level lengths) of each first-level part."""
    return split_all([content], params)[0]


def split_all(contents: list[bytes], params: ChunkParams) -> list[list[tuple[int, list[int]]]]:
    """(offset, second-level lengths) of each first-level part of each content; the fingerprints are made once for all.

    With a coarse anchor, a part ends at the first content-defined cut at or after that many bytes.
    """
    if not params.coarse_anchor:
        return [[(0, lengths)] for lengths in rabin.cuts(contents, params.window, params.mask)]
    data = np.frombuffer(b"".join(contents), np.uint8)
    cutter = rabin.Cutter(data, params.window, params.mask) if len(data) else None
    out, begin = [], 0
    for content in contents:
        parts, at, stop = [], begin, begin + len(content)
        while at < stop:
            end = stop
            if stop - at > params.coarse_anchor:
                end = cutter.next(at + params.coarse_anchor, stop)
            parts.append((at - begin, cutter.lengths(at, end)))
            at = end
        out.append(parts)
        begin = stop
    return out


def cut_blocks(blocks: Iterator[bytes], params: ChunkParams = ChunkParams()) -> Iterator[bytes]:
    """The content-defined chunks (one level) of a file that comes in blocks: what follows a block's last cut is carried into the next one."""
    carry = b""
    for block in blocks:
        carry += block
        lengths, at = rabin.cuts([carry], params.window, params.mask)[0], 0
        for n in lengths[:-1]:
            yield carry[at : at + n]
            at += n
        carry = carry[at:]
    # a cut at the very end of the data was found as one, an end without cut is a cut too
    at = 0
    for n in rabin.cuts([carry], params.window, params.mask)[0]:
        yield carry[at : at + n]
        at += n


def cdc_layout_of_paths(paths: DataFrame, params: ChunkParams = ChunkParams(), block_bytes: int = 64 << 20) -> DataFrame:
    """Rows of LAYOUT (one level) for files (file_idx, path) that are read block by block, so that no file is ever a value of its own.

    A path is a URI or a local path that pyarrow's file systems open (file, hdfs, s3, gs). A task holds one block and
    the chunk that goes over its border.
    """
    ship(paths.sparkSession)
    schema = pa.schema([("file_idx", pa.int64()), ("l1", pa.int32()), ("l2", pa.int32()), ("is_last_l2", pa.bool_()), ("offset", pa.int64()), ("n", pa.int64()), ("sha1", pa.string())])

    def blocks(path: str) -> Iterator[bytes]:
        system, name = open_path(path)
        with system.open_input_stream(name) as f:
            while block := f.read(block_bytes):
                yield block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, at = [], None, 0
                for l2, chunk in enumerate(cut_blocks(blocks(path), params)):
                    if held:
                        rows.append(held)
                    held = {"file_idx": f, "l1": 0, "l2": l2, "is_last_l2": False, "offset": at, "n": len(chunk), "sha1": hashlib.sha1(chunk).hexdigest()}
                    at += len(chunk)
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if held:
                    yield pa.RecordBatch.from_pylist([*rows, held | {"is_last_l2": True}], schema=schema)

    return paths.select(F.col("file_idx").cast("long"), "path").mapInArrow(run, LAYOUT)


def cdc_chunks(files: DataFrame, id_col: str, content_col: str, params: ChunkParams = ChunkParams()) -> DataFrame:
    """Rows of CHUNKS for each file, cut by content; a null or empty file has none. No shuffle."""
    return _cut_files(files, id_col, content_col, params, ("data", pa.binary(), bytes), CHUNKS)


def cdc_layout(files: DataFrame, id_col: str, content_col: str, params: ChunkParams = ChunkParams()) -> DataFrame:
    """Rows of LAYOUT: the chunks of cdc_chunks() with their digests in place of the data, some fifty bytes for each chunk. No shuffle."""
    return _cut_files(files, id_col, content_col, params, ("sha1", pa.string(), lambda b: hashlib.sha1(b).hexdigest()), LAYOUT)


def _cut_files(files: DataFrame, id_col: str, content_col: str, params: ChunkParams, last: tuple, columns: str) -> DataFrame:
    """The chunks of each file; last: name, type and function of the data of the last column."""
    ship(files.sparkSession)
    name, kind, made = last
    schema = pa.schema([("file_idx", pa.int64()), ("l1", pa.int32()), ("l2", pa.int32()), ("is_last_l2", pa.bool_()), ("offset", pa.int64()), ("n", pa.int64()), (name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files_, held = [], 0
            for f, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files_.append((f, content or b""))
                held += len(content or b"")
                if held > 4 << 20:
                    yield cut(files_)
                    files_, held = [], 0
            if files_:
                yield cut(files_)

    def cut(group: list[tuple[int, bytes]]) -> pa.RecordBatch:
        levels = split_all([c for _, c in group], params)
        rows = []
        for (f, content), parts in zip(group, levels, strict=True):
            for l1, (at, lengths) in enumerate(parts):
                for l2, n in enumerate(lengths):
                    rows.append((f, l1, l2, l2 == len(lengths) - 1, at, n, made(content[at : at + n])))
                    at += n
        columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return files.select(F.col(id_col).cast("long"), F.col(content_col).cast("binary")).mapInArrow(run, columns)


def line_chunks(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of CHUNKS without offset for each line of a text; built-in functions only."""
    lines = files.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("file_idx"), F.split(text_col, "\n", -1).alias("lines"))
    rows = lines.select("file_idx", F.size("lines").alias("total"), F.posexplode("lines").alias("l2", "line"))
    data = F.col("line").cast("binary")
    return rows.select("file_idx", F.lit(0).alias("l1"), "l2", (F.col("l2") == F.col("total") - 1).alias("is_last_l2"), F.octet_length(data).cast("long").alias("n"), F.sha1(data).alias("sha1"), data.alias("data"))


def fixed_chunks(files: DataFrame, id_col: str, content_col: str, size: int) -> DataFrame:
    """Rows of CHUNKS of ``size`` bytes each, the last one shorter; built-in functions only."""
    data = F.col(content_col).cast("binary")
    n = F.octet_length(data)
    rows = files.where(n > 0).select(F.col(id_col).cast("long").alias("file_idx"), data.alias("content"), F.posexplode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("l2", "k"), F.floor((n - 1) / size).cast("int").alias("last"))
    part = F.substring("content", F.col("k") * size + 1, F.lit(size))
    return rows.select("file_idx", F.lit(0).alias("l1"), "l2", (F.col("l2") == F.col("last")).alias("is_last_l2"), (F.col("k").cast("long") * size).alias("offset"), F.octet_length(part).cast("long").alias("n"), part.alias("data"))


def with_fingerprint(chunks: DataFrame, column: str = "data") -> DataFrame:
    """chunks with sha1, the lower-case hex digest of the data."""
    return chunks if "sha1" in chunks.columns else chunks.withColumn("sha1", F.sha1(F.col(column)))


def size_slot(n: Column) -> Column:
    """Slot of the chunk-size histogram: 256 slots of 128 bytes, the last one open."""
    return F.least(F.shiftright(n, 7), F.lit(255)).cast("int")

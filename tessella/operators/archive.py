"""Archives of deduplicated, compressed chunks.

Layout: int32 123456, u8 codec; then records (u8 type, u64 length, payload), little-endian; type 1 is a compressed
chunk, type 0 the 20-byte SHA-1 of a chunk that stands earlier in output order.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tessella.functions.codecs import CODECS, bounded, codec, codec_by_code
from tessella.session import default_partitions, materialize, ship

from .dedup import HOT_LEAST, HOT_SHARE

#: Header number, record types (fixed values of the format).
MAGIC, FINGERPRINT, COMPRESSED = 123456, 0, 1
#: Rows that a task turns to Python objects at once, and bytes of records that it makes at once.
SLICE, HELD_BYTES = 256, 4 << 20
HEAD, RECORD = struct.Struct("<iB"), struct.Struct("<BQ")
ARCHIVES = "file_idx long, archive binary, n_records long, bytes_in long, bytes_compressed long"
_ARROW = pa.schema([("file_idx", pa.int64()), ("archive", pa.binary()), ("n_records", pa.int64()), ("bytes_in", pa.int64()), ("bytes_compressed", pa.int64())])


def header(codec_name: str) -> bytes:
    return HEAD.pack(MAGIC, codec(codec_name).code)


def record(kind: int, payload: bytes) -> bytes:
    return RECORD.pack(kind, len(payload)) + payload


def parse_archive(archive: bytes) -> tuple[int, list[tuple[int, bytes]]]:
    """(codec number, records); a malformed archive is refused."""
    if len(archive) < HEAD.size:
        raise ValueError("an archive is shorter than its header")
    magic, code = HEAD.unpack_from(archive)
    if magic != MAGIC:
        raise ValueError("not an archive")
    at, records = HEAD.size, []
    while at < len(archive):
        if at + RECORD.size > len(archive):
            raise ValueError("an archive ends inside a record")
        kind, n = RECORD.unpack_from(archive, at)
        payload = archive[at + RECORD.size : at + RECORD.size + n]
        if kind not in (FINGERPRINT, COMPRESSED) or n == 0 or len(payload) != n or (kind == FINGERPRINT and n != 20):
            raise ValueError(f"a bad record of type {kind} and length {n}")
        records.append((kind, payload))
        at += RECORD.size + n
    return code, records


def decode_archive(archive: bytes, limit: int | None = None) -> bytes:
    """The bytes of a self-contained archive."""
    code, records = parse_archive(archive)
    expand, seen, out = bounded(codec_by_code(code).decompress, limit), {}, []
    for kind, payload in records:
        if kind == COMPRESSED:
            data = expand(payload)
            seen[hashlib.sha1(data).digest()] = data
        else:
            if payload not in seen:
                raise ValueError("a fingerprint stands before its chunk")
            data = seen[payload]
        out.append(data)
    return b"".join(out)


def compress_chunks(flagged: DataFrame, codec_name: str = "gzip") -> DataFrame:
    """Unique chunks with cdata and cn; duplicates are filtered out before the codec runs, as a function under when() would see them."""
    ship(flagged.sparkSession)
    kept = flagged.where("not is_dup")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = CODECS[codec_name].compress
        for batch in batches:
            made = [compress(b) for b in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary()), pa.array([len(b) for b in made], pa.int64())], names=[*names, "cdata", "cn"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, cdata binary, cn long")


def _stream_files(rows: DataFrame, make: Callable[[], Callable], schema: str, arrow: pa.Schema) -> DataFrame:
    """Runs a fold over each file's rows in output order: one shuffle by file, a sort, and one file at a time in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fold, out = None, None, []
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                for row in batch.slice(at, SLICE).to_pylist():
                    if fold is None or row["file_idx"] != current:
                        if fold is not None:
                            out.append(fold(None))
                        current, fold = row["file_idx"], make()
                    fold(row)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if fold is not None:
            yield pa.RecordBatch.from_pylist([fold(None)], schema=arrow)

    ship(rows.sparkSession)
    return rows.repartition(default_partitions(rows.sparkSession), "file_idx").sortWithinPartitions("file_idx", "l1", "l2").mapInArrow(run, schema)


def write_archives(flagged: DataFrame, codec_name: str = "gzip") -> DataFrame:
    """One row of ARCHIVES for each file: first occurrences as data, the others as fingerprints, in output order."""
    compress = codec(codec_name).compress
    head = header(codec_name)

    def make() -> Callable:
        parts, state = [head], {"file_idx": None, "n_records": 0, "bytes_in": 0, "bytes_compressed": 0}

        def fold(row: dict | None) -> dict | None:
            if row is None:
                return state | {"archive": b"".join(parts)}
            state["file_idx"] = row["file_idx"]
            state["n_records"] += 1
            state["bytes_in"] += len(row["data"])
            if row["is_dup"]:
                parts.append(record(FINGERPRINT, bytes.fromhex(row["sha1"])))
            else:
                made = compress(row["data"])
                state["bytes_compressed"] += len(made)
                parts.append(record(COMPRESSED, made))
            return None

        return fold

    return _stream_files(flagged.select("file_idx", "l1", "l2", "sha1", "is_dup", "data"), make, ARCHIVES, _ARROW)


def pack_files(files: DataFrame, flagged: DataFrame, codec_name: str = "gzip", id_col: str = "file_idx", content_col: str = "content") -> DataFrame:
    """One row of ARCHIVES for each file with chunks, from the files and their flagged layout (chunks without data).

    A file's layout is one narrow row that is joined to it, so contents are shuffled once, cut and compressed in one
    pass, and never travel as chunks.
    """
    ship(files.sparkSession)
    head, compress = header(codec_name), codec(codec_name).compress
    part = F.struct("l1", "l2", F.col("offset").alias("at"), "n", "is_dup", "sha1")
    layout = flagged.groupBy(F.col("file_idx").alias("l_idx")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    rows = files.select(F.col(id_col).cast("long").alias("file_idx"), F.col(content_col).cast("binary").alias("content")).join(layout, F.col("file_idx") == F.col("l_idx"))
    fields = [F.col(f"parts.{f}").alias(f) for f in ("at", "n", "is_dup", "sha1")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                content, out, kept = batch.column("content")[i].as_py(), [head], 0
                lists = (batch.column(c)[i].as_py() for c in ("at", "n", "is_dup", "sha1"))
                total = 0
                for at, n, dup, sha1 in zip(*lists, strict=True):
                    total += n
                    if dup:
                        out.append(record(FINGERPRINT, bytes.fromhex(sha1)))
                    else:
                        made = compress(content[at : at + n])
                        kept += len(made)
                        out.append(record(COMPRESSED, made))
                made = {"file_idx": batch.column("file_idx")[i].as_py(), "archive": b"".join(out), "n_records": len(out) - 1, "bytes_in": total, "bytes_compressed": kept}
                yield pa.RecordBatch.from_pylist([made], schema=_ARROW)

    return rows.select("file_idx", "content", *fields).mapInArrow(run, ARCHIVES)


def archive_records(archives: DataFrame) -> DataFrame:
    """(file_idx, rec_no, kind, sha1, data) of the records; data is uncompressed, null for a fingerprint."""
    ship(archives.sparkSession)
    schema = pa.schema([("file_idx", pa.int64()), ("rec_no", pa.int64()), ("kind", pa.int32()), ("sha1", pa.string()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for f, archive in zip(batch.column("file_idx").to_pylist(), batch.column("archive"), strict=True):
                code, records = parse_archive(archive.as_py())
                expand = codec_by_code(code).decompress
                for i, (kind, payload) in enumerate(records):
                    data = expand(payload) if kind == COMPRESSED else None
                    rows.append({"file_idx": f, "rec_no": i, "kind": kind, "sha1": hashlib.sha1(data).hexdigest() if data is not None else payload.hex(), "data": data})
                    held += len(data or b"")
                    if held > HELD_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("file_idx", "archive").mapInArrow(run, "file_idx long, rec_no long, kind int, sha1 string, data binary")


def decode_archives(archives: DataFrame, limit: int | None = None) -> DataFrame:
    """(file_idx, content) of self-contained archives (scope file). No shuffle."""
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("file_idx"), pa.array([decode_archive(a, limit) for a in batch.column("archive").to_pylist()], pa.binary())], names=["file_idx", "content"])

    return archives.select("file_idx", "archive").mapInArrow(run, "file_idx long, content binary")


def decode_records(records: DataFrame, scope: str = "global") -> DataFrame:
    """(file_idx, content) from records of any scope: fingerprints are joined to their chunk, then each file's parts are put in order.

    Only fingerprints, without bytes, and the chunks that they name are joined. A chunk that over a thousandth of all
    fingerprints name is there several times, one for each thousandth, and its fingerprints are dealt to them. Records are
    read several times, so they should be a table.
    """
    keys = ["sha1"] if scope == "global" else ["file_idx", "sha1"]
    named, chunks = records.where(F.col("kind") == FINGERPRINT).select("file_idx", "rec_no", "sha1"), records.where(F.col("kind") == COMPRESSED)
    counts = materialize(named.groupBy(*[F.col(k).alias(f"n_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("copies")), "named-chunks")
    limit = max(HOT_LEAST, (counts.agg(F.sum("copies")).first()[0] or 0) // HOT_SHARE)
    counts = counts.withColumn("times", F.ceil(F.col("copies") / F.lit(limit)).cast("int"))
    same = lambda prefix: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}_{k}")) for k in keys])
    found = chunks.join(counts, same("n")).select(*[F.col(k).alias(f"k_{k}") for k in keys], "data", "times").groupBy(*[f"k_{k}" for k in keys], "times").agg(F.first("data").alias("found"))
    found = found.withColumn("k_part", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).drop("times")
    hot = F.broadcast(counts.where("times > 1").limit(HOT_SHARE).select(*[F.col(k).alias(f"h_{k}") for k in [f"n_{k}" for k in keys]], F.col("times").alias("h_times")))
    at_hot = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"h_n_{k}")) for k in keys])
    dealt = named.join(hot, at_hot, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("file_idx", "rec_no"), F.col("h_times")).cast("int"), F.lit(0)))
    expanded = dealt.join(found, same("k") & (F.col("part") == F.col("k_part")), "left").select("file_idx", "rec_no", F.col("found").alias("data"))
    parts = chunks.select("file_idx", "rec_no", "data").unionByName(expanded).select("file_idx", F.lit(0).alias("l1"), F.col("rec_no").alias("l2"), "data")

    def make() -> Callable:
        state, found = {"file_idx": None}, []

        def fold(row: dict | None) -> dict | None:
            if row is None:
                return state | {"content": b"".join(found)}
            if row["data"] is None:
                raise ValueError("a fingerprint has no chunk")
            state["file_idx"] = row["file_idx"]
            found.append(row["data"])
            return None

        return fold

    return _stream_files(parts, make, "file_idx long, content binary", pa.schema([("file_idx", pa.int64()), ("content", pa.binary())]))

"""Exact dedup by Grace hashing.

Three steps. (1) Each input partition folds its equal texts through a bounded open-addressing table, so that a text
with many copies leaves a partition once per table filling ("representatives"), while the members only keep a
reference. (2) Representatives are shuffled by a hash of the text; each task partitions its records to spill files by
further hash bits, recursively, until a bucket fits the table, which compares complete content. (3) Members take their
class from their representative by a join on it; no representative has more members than a table filling has rows.

Defined results: a null text equals the empty text; texts are equal when identical after lower-casing A-Z only; the row
with the largest id stays, a null id being the smallest; of repeated rows of that id exactly one is kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import tempfile
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_map, default_partitions, materialize, unclashed

#: Bytes of distinct content and references that a table holds, and bytes of a reference.
TABLE_BYTES, MEMBER = 48 << 20, 16
#: Files that a bucket is split into, as hash bits.
FAN_BITS = 4


class ContentTable:
    """Open addressing with linear probing; slots compare the hash first and then the complete content."""

    def __init__(self) -> None:
        self.mask = 1023
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def put(self, h: int, content: bytes) -> int:
        """The entry of the content, which is new if it is the last one."""
        at = h & self.mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & self.mask
        entry = self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 150
        if 2 * len(self.contents) > self.mask:
            self._grow()
        return entry

    def _grow(self) -> None:
        self.mask = 4 * (self.mask + 1) - 1
        self.slots = [-1] * (self.mask + 1)
        for entry, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = entry


Record = tuple[int, bytes, int, tuple[bool, int], int]  # representative, content, rows, best id, best row
_HEAD = struct.Struct("<QQq?qqI")


#: In place of a content's length: the record has the content of the one before.
SAME = (1 << 32) - 1


def _write(f, h: int, r: Record, same: bool = False) -> int:
    f.write(_HEAD.pack(h, r[0], r[2], r[3][0], r[3][1], r[4], SAME if same else len(r[1])))
    if not same:
        f.write(r[1])
    return _HEAD.size + (0 if same else len(r[1]))


def _read(path: str) -> Iterator[tuple[int, Record]]:
    content = b""
    with open(path, "rb", buffering=1 << 20) as f:
        while head := f.read(_HEAD.size):
            h, rep, n, known, best, row, size = _HEAD.unpack(head)
            if size != SAME:
                content = f.read(size)
            yield h, (rep, content, n, (known, best), row)


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (id, row): the larger id, then the smaller row."""
    return a if (a[0], -a[1]) >= (b[0], -b[1]) else b


def grace_classes(records: Iterable[tuple[int, Record]], folder: str, table_bytes: int = TABLE_BYTES, depth: int = 0) -> Iterator[tuple[int, tuple[bool, int], int, int]]:
    """(representative, id that stays, row that stays, rows of the class) of each record.

    Records go into a table, which holds each content once and of every record a reference of MEMBER bytes. When that
    exceeds table_bytes, all go to spill files by the next hash bits, a content of the table once with its references
    after it, and each file is treated alike. A bucket of one content can't be split and stays in its table; when no
    bits are left, a bucket's records have one hash, and the table holds its distinct contents.
    """
    last = (depth + 1) * FAN_BITS > 60
    table, members, best, total, held = ContentTable(), [], [], [], 0
    records = iter(records)
    for h, r in records:
        if not last and len(table.contents) > 1 and table.bytes + held > table_bytes:
            break
        entry = table.put(h, r[1])
        if entry == len(members):
            members.append(array("Q"))
            best.append((r[3], r[4]))
            total.append(0)
        members[entry].append(r[0])
        held += MEMBER
        best[entry] = _better(best[entry], (r[3], r[4]))
        total[entry] += r[2]
    else:
        for reps, (doc, row), n in zip(members, best, total, strict=True):
            for rep in reps:
                yield rep, doc, row, n
        return
    paths = [os.path.join(folder, f"{depth}-{i}-{os.urandom(6).hex()}") for i in range(1 << FAN_BITS)]
    files = [open(p, "wb", buffering=1 << 16) for p in paths]  # noqa: SIM115
    shift, mask = 60 - FAN_BITS * depth, (1 << FAN_BITS) - 1
    try:
        for x, content, reps, (doc, row), n in zip(table.hashes, table.contents, members, best, total, strict=True):
            # the first reference carries the sums of all so far
            for i, rep in enumerate(reps):
                _write(files[x >> shift & mask], x, (rep, content, 0 if i else n, doc, row), same=i > 0)
        del table, members, best, total
        _write(files[h >> shift & mask], h, r)
        for x in records:
            _write(files[x[0] >> shift & mask], *x)
    finally:
        for f in files:
            f.close()
    for p in paths:
        yield from grace_classes(_read(p), folder, table_bytes, depth + 1)
        os.remove(p)


def _fold(table_bytes: int) -> Callable:
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("rep", pa.int64()), ("sha", pa.string()), ("content", pa.binary()), ("hash", pa.int64()), ("n", pa.int64()), ("best_id", pa.int64()), ("best_row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        row = base
        table, state, shas = ContentTable(), [], []

        def flush() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(state), 500):
                part = range(at, min(at + 500, len(state)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": [None] * len(part), "doc_id": [None] * len(part), "rep": [state[i][0] for i in part], "sha": [None] * len(part), "content": [table.contents[i] for i in part],
                        "hash": [table.hashes[i] - (1 << 64) if table.hashes[i] >> 63 else table.hashes[i] for i in part], "n": [state[i][1] for i in part],
                        "best_id": [state[i][2][0][1] if state[i][2][0][0] else None for i in part], "best_row": [state[i][2][1] for i in part],
                    },
                    schema=schema,
                )

        for batch in batches:
            out: dict[str, list] = {"row": [], "doc_id": [], "rep": [], "sha": []}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                content = (text or b"").lower()
                entry = table.put(xxhash.xxh3_64_intdigest(content), content)
                doc = (doc_id is not None, doc_id or 0)
                if entry == len(state):
                    state.append([row, 0, (doc, row)])
                    shas.append(hashlib.sha256(content).hexdigest())
                s = state[entry]
                s[1] += 1
                s[2] = _better(s[2], (doc, row))
                for k, v in zip(out, (row, doc_id, s[0], shas[entry]), strict=True):
                    out[k].append(v)
                row += 1
                if table.bytes > table_bytes:
                    yield from flush()
                    table, state, shas = ContentTable(), [], []
            n = len(out["row"])
            yield pa.RecordBatch.from_pydict(out | {k: [None] * n for k in ("content", "hash", "n", "best_id", "best_row")}, schema=schema)
        yield from flush()

    return run


def _classes(table_bytes: int) -> Callable:
    schema = pa.schema([("c_rep", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Record]]:
        for batch in batches:
            for rep, content, h, n, best_id, best_row in zip(*(batch.column(c).to_pylist() for c in ("rep", "content", "hash", "n", "best_id", "best_row")), strict=True):
                yield h & (1 << 64) - 1, (rep, content, n, (best_id is not None, best_id or 0), best_row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, rows = tempfile.mkdtemp(prefix="grace-"), []
        try:
            for rep, doc, row, n in grace_classes(records(batches), folder, table_bytes):
                rows.append((rep, doc[1] if doc[0] else None, row, n))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = unclashed(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    folded = arrow_map(rows, _fold(table_bytes), "row long, doc_id long, rep long, sha string, content binary, hash long, n long, best_id long, best_row long")
    # rows are numbered by their place, which a recomputation after a shuffle could change; so the numbered rows are written once
    folded = materialize(folded, "exact-fold")
    reps = folded.where("row is null").select("rep", "content", "hash", "n", "best_id", "best_row")
    classes = reps.repartition(default_partitions(spark), "hash").mapInArrow(_classes(table_bytes), "c_rep long, keep_id long, keep_row long, group_size long")
    members = folded.where("row is not null").select("row", "doc_id", "rep", "sha")
    return members.join(classes, F.col("rep") == F.col("c_rep"), "inner").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


#: DuckDB SQL for op4.
SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""

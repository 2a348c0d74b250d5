"""Packing documents into sequences of fixed length by non-negative least squares.

A document's token ids and one end id are cut into whole windows and a tail. Whole windows are sequences. For the tails
only their histogram by length counts, which has a bounded number of entries at any size of the table: shallow
combinations of lengths that fill a window are enumerated (k tails of one length and one of another; three different
ones), non-negative least squares finds how often to repeat each so that the lengths used come near the histogram, the
repeats are rounded down to what is there, and the residual lengths are packed greedily: the longest tail, then the
longest that still fit, and the rest of the window is cut off one more tail. What is left at the end is less than a window
and is cut at powers of two. So no sequence has padding, and a tail is cut only where nothing fits.

The plan says which ranks of which length go where. It is made on the driver from the histogram, and its size is bounded
by the window, not by the table. A tail's rank among those of its length is its number in its task plus the number of such
tails in the tasks before, which is a prefix sum over tasks.

Plan: one pass makes the ids; tails' ids and digests of whole windows are written, sums by (task, length) are read back from
narrow columns, and the tails are joined with their tasks' sums by (task, length), keys with few rows each.

Defined results: a null text is empty and has the end id only; repeated rows are rows of their own; doc_id is passed on in
its own type, null or not; an empty table gives an empty result; other columns are ignored. Ids are those of the
tokenizers library without special tokens added; special tokens' strings in a text are those tokens. A text's ids are made
in one piece, so memory grows with the longest text, some 30 bytes for each of its bytes.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from tokenizers import Tokenizer

from .bpe import NOT_PLAIN, PLAIN_WORDS, Vocabulary
from .common import arrow_map, materialize, unclashed

WINDOW, END = 2048, 1
#: Chunks that a worker remembers, and characters in them; texts and characters that are encoded at once.
CHUNKS, CHUNK_CHARS = 500_000, 8 << 20
TEXTS, TEXT_CHARS = 250, 4 << 20
#: Lengths of the shortest of three different tails are multiples of WINDOW / GRID; steps of the least-squares descent.
GRID, DESCENT = 32, 300
#: Bits of a rank in a key of (length, rank).
RANK = 48
#: Ends a word. A chunk that has it, characters other than ASCII and Latin letters, or what may be a special token is encoded by the library.
MARK = "\x01"
ODD = re.compile(f"{NOT_PLAIN.pattern}|{MARK}|[|]")
PLAIN_OR_LINE_END = re.compile(PLAIN_WORDS.pattern + r"|\n")
#: First rank of bytes with the mark.
LAST = 256


class ChunkIds(dict):
    """Ids of chunks, the strings between spaces and line ends, by the vocabulary's merges: chunk to number, and each number's ids in one array.

    With a mark after each word, the merges of a vocabulary with word ends are those of a plain byte vocabulary in which
    the last byte and the mark merge first.
    """

    def __init__(self, vocabulary: Vocabulary, file: str) -> None:
        super().__init__()
        self.library = Tokenizer.from_str(file)
        self.library.no_truncation()
        self.library.no_padding()
        byte, mark = {c: bytes([b]) for b, c in vocabulary.letters.items()}, MARK.encode()

        def raw(token: str) -> bytes:
            bare = token.removesuffix(vocabulary.suffix) if token != vocabulary.suffix else token
            return b"".join(map(byte.__getitem__, bare)) + mark * (bare != token)

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + mark: LAST + b for b in range(256) if bytes([b]) != mark}
        for made in vocabulary.made:
            ranks.setdefault(raw(vocabulary.strings[made]), 2 * LAST + len(ranks))
        self.id_of = np.full(max(ranks.values()) + 1, -1, np.int64)
        for token, i in vocabulary.ids.items():
            if (r := ranks.get(raw(token))) is not None:
                self.id_of[r] = i
        self.bpe = tiktoken.Encoding("words", pat_str=f"[^{MARK}]*{MARK}", mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.chars = 0
        self.start, self.size, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.fresh.append(chunk)
        return n

    def _learn(self) -> None:
        chunks, self.fresh = self.fresh, []
        self.chars += sum(map(len, chunks))
        low = [c.lower() for c in chunks]
        at_odd = [i for i, c in enumerate(low) if ODD.search(c)]
        for i in at_odd:
            low[i] = ""
        words = PLAIN_OR_LINE_END.findall("\n".join([*low, ""]))
        got = np.asarray(self.bpe.encode_to_numpy(MARK.join([*words, ""]), allowed_special=set(), disallowed_special=()), np.int64)
        ends = np.flatnonzero(got == LAST + ord("\n"))
        sizes = np.diff(ends, prepend=-1) - 1
        ids = self.id_of[np.delete(got, ends)]
        if at_odd:
            odd = [e.ids for e in self.library.encode_batch_fast([chunks[i] for i in at_odd], add_special_tokens=False)]
            counts = np.fromiter(map(len, odd), np.int64, len(odd))
            ids = np.insert(ids, np.repeat(np.cumsum(sizes)[at_odd], counts), np.fromiter(chain.from_iterable(odd), np.int64))
            sizes[at_odd] = counts
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(sizes) - sizes))
        self.size, self.ids = np.concatenate((self.size, sizes)), np.concatenate((self.ids, ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text ends)."""
        if len(self) > CHUNKS or self.chars > CHUNK_CHARS:
            self._forget()
        # a plain text may be lower-cased first, so that more chunks are known; words never have white space in them
        low = [t.lower() for t in texts]
        chunks = [(t if ODD.search(x) else x).replace("\n", " ").split(" ") for t, x in zip(texts, low, strict=True)]
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(chunks)), np.int64, int(counts.sum()))
        if self.fresh:
            self._learn()
        size = self.size[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = self.ids[np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])]
        return flat, ends[np.cumsum(counts)]


_tables: dict[int, ChunkIds] = {}


def worker_chunks(number: int, vocabulary: Vocabulary, file: str) -> ChunkIds:
    """The Python worker's chunks of a broadcast vocabulary."""
    if number not in _tables:
        _tables.clear()
        _tables[number] = ChunkIds(vocabulary, file)
    return _tables[number]


def spans(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of few texts and few characters; a longer text is a slice of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    at = 0
    while at < len(batch):
        n = max(1, min(TEXTS, int(np.searchsorted(np.cumsum(lengths[at : at + TEXTS]), TEXT_CHARS, "right"))))
        yield batch.slice(at, n)
        at += n


def window_ids(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(part, doc_id, n_ids, tail, tail_rank, full_rank, full_crc32, ids) of each row of docs.

    part is the task; tail the length of the tail, tail_rank its number among the task's tails of that length; full_rank
    the number of the document's first whole window among the task's; ids those of the tail, or all with ``whole``, as
    little-endian unsigned numbers of 16 bits, or 32 for a vocabulary that needs them.
    """
    sc = docs.sparkSession.sparkContext
    with open(path, encoding="utf-8") as f:
        vocabulary = sc.broadcast((Vocabulary(path), f.read()))
    number = vocabulary._jbroadcast.id()
    chosen = unclashed(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part = worker_chunks(number, *vocabulary.value), TaskContext.get().partitionId()
        stored = id_type(vocabulary.value[0])
        tails, fulls = np.zeros(window, np.int64), 0
        for batch in batches:
            for rows in spans(batch, 1):
                flat, ends = chunks.encode(rows.column("text").to_pylist())
                n = np.diff(ends, prepend=0) + 1
                tail, full = n % window, n // window
                order = np.argsort(tail, kind="stable")
                place = np.empty(len(n), np.int64)
                place[order] = np.arange(len(n)) - np.searchsorted(tail[order], tail[order])
                rank = tails[tail] + place
                tails += np.bincount(tail, minlength=window)
                full_rank = fulls + np.cumsum(full) - full
                fulls += int(full.sum())
                crcs, kept = [], []
                for first, last, k in zip((ends - n + 1).tolist(), ends.tolist(), full.tolist(), strict=True):
                    ids = np.append(flat[first:last], end)
                    crcs.append([zlib.crc32(ids[i * window : (i + 1) * window].astype("<u4").tobytes()) for i in range(k)])
                    kept.append(ids[0 if whole else k * window :].astype(stored).tobytes())
                columns = [pa.array(np.full(len(n), part, np.int32)), rows.column("doc_id"), *map(pa.array, (n, tail.astype(np.int32), rank, full_rank)), pa.array(crcs, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "n_ids", "tail", "tail_rank", "full_rank", "full_crc32", "ids"])

    return arrow_map(chosen, run, f"part int, doc_id {kind}, n_ids long, tail int, tail_rank long, full_rank long, full_crc32 array<long>, ids binary")


def id_type(vocabulary: Vocabulary) -> str:
    return "<u2" if vocabulary.size <= 1 << 16 else "<u4"


def combinations(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Combinations of the lengths that fill a window, as (lengths, repeats), each (combinations, 3) with zeros for what isn't used."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    size, times = [], []
    for a in lengths.tolist():
        k = np.arange(1, window // a + 1)
        rest = window - k * a
        ok = ((rest == 0) | (there[rest] & (rest != a))) & ~((k == 1) & (rest > a))
        size.append(np.stack((np.full(ok.sum(), a), rest[ok], np.zeros(ok.sum(), np.int64)), axis=1))
        times.append(np.stack((k[ok], (rest[ok] > 0).astype(np.int64), np.zeros(ok.sum(), np.int64)), axis=1))
        if a % max(1, window // GRID) == 0:
            b = lengths[(lengths > a) & (lengths < window - a - lengths)]
            b = b[there[window - a - b]]
            size.append(np.stack((np.full(len(b), a), b, window - a - b), axis=1))
            times.append(np.ones((len(b), 3), np.int64))
    return (np.concatenate(size), np.concatenate(times)) if size else (np.zeros((0, 3), np.int64),) * 2


def repeats(histogram: np.ndarray, size: np.ndarray, times: np.ndarray, steps: int = DESCENT) -> np.ndarray:
    """Non-negative least squares: how often each combination is repeated so that the lengths used come nearest to the histogram, by accelerated projected gradient."""
    if not len(size):
        return np.zeros(0)
    norm = np.sqrt((times**2).sum(axis=1))
    share = times / norm[:, None]
    top = histogram.max()
    goal = histogram / top

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(size.ravel(), (share * x[:, None]).ravel(), len(histogram))

    def against(r: np.ndarray) -> np.ndarray:
        return (share * r[size]).sum(axis=1)

    v = np.ones(len(size))
    for _ in range(20):  # the largest eigenvalue
        v = against(used(v))
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(len(size))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - against(used(y) - goal) / (1.02 * bound))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x / norm * top


@dataclass
class Plan:
    """Where tails go: for each number of cuts before a piece, sorted keys (length, first rank) and rows (end rank, start, length, first sequence, first number, tails a sequence, offset)."""

    sequences: int
    levels: list[tuple[np.ndarray, np.ndarray]]

    def pieces(self, tail: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start, length, sequence, offset) of the pieces of tails of given lengths and ranks."""
        out = []
        for keys, rows in self.levels:
            at = np.searchsorted(keys, (tail << RANK) + rank, "right") - 1
            hit = np.flatnonzero((at >= 0) & (keys[np.maximum(at, 0)] >> RANK == tail) & (rank < rows[np.maximum(at, 0), 0]))
            end, start, length, sequence, number, times, offset = rows[at[hit]].T
            i = number + rank[hit] - (keys[at[hit]] & ((1 << RANK) - 1))
            out.append(np.stack((hit, start, length, sequence + i // times, offset + i % times * length)))
        return tuple(np.concatenate(out, axis=1)) if out else tuple(np.zeros((5, 0), np.int64))


class _Packer:
    """Queues of what is left of each length, and the rows of the plan so far."""

    def __init__(self, histogram: np.ndarray, window: int) -> None:
        self.window, self.left = window, [int(c) for c in histogram]
        # of each length: (tail's length, first rank, end rank, start of what is left, cuts so far)
        self.queues = {n: deque([(n, 0, int(c), 0, 0)]) for n, c in enumerate(histogram) if c}
        self.rows: list[tuple[int, ...]] = []
        self.sequences = 0

    def take(self, length: int, count: int, piece: int, times: int, offset: int) -> None:
        """Puts the first ``piece`` ids of ``count`` tails of a length at an offset of the next sequences, ``times`` in each; what is left of them waits."""
        self.left[length] -= count
        number, queue = 0, self.queues[length]
        while number < count:
            tail, first, end, start, cuts = queue.popleft()
            stop = min(end, first + count - number)
            if stop < end:
                queue.appendleft((tail, stop, end, start, cuts))
            self.rows.append((cuts, tail, first, stop, start, piece, self.sequences, number, times, offset))
            if piece < length:
                self.queues.setdefault(length - piece, deque()).append((tail, first, stop, start + piece, cuts + 1))
                self.left[length - piece] += stop - first
            number += stop - first

    def fill(self, parts: list[tuple[int, int]], sequences: int, cut: tuple[int, int] | None = None) -> None:
        """``sequences`` more, each with parts (length, tails of it) in that order and, with ``cut`` (length, ids), so many ids of one more tail."""
        offset = 0
        for length, times in parts:
            self.take(length, times * sequences, length, times, offset)
            offset += times * length
        if cut:
            self.take(cut[0], sequences, cut[1], 1, offset)
        self.sequences += sequences

    def greedy(self) -> None:
        """The longest tail, then the longest that fit, then a cut, as often as the lengths last."""
        ids = sum(n * c for n, c in enumerate(self.left))
        while ids:
            there = [n for n in range(len(self.left) - 1, 0, -1) if self.left[n]]
            room = self.window if ids >= self.window else 1 << (ids.bit_length() - 1)
            parts, rest = [], room
            for n in there:
                if n <= rest:
                    parts.append((n, min(rest // n, self.left[n])))
                    rest -= n * parts[-1][1]
            used = dict(parts)
            longer = next((n for n in there if n > rest and self.left[n] > used.get(n, 0)), None) if rest else None
            times = min(self.left[n] // m for n, m in parts) if parts else ids // room
            if longer:
                times = min(times, self.left[longer] // (used.get(longer, 0) + 1))
            times = min(times, ids // room)
            self.fill(parts, times, (longer, rest) if rest else None)
            ids -= times * room


def make_plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """The plan for so many tails of each length (index 0 is not used)."""
    packer = _Packer(histogram, window)
    lengths = np.flatnonzero(histogram)
    size, times = combinations(lengths[lengths > 0], window)
    x = repeats(np.asarray(histogram, float), size, times)
    for j in np.argsort(-x, kind="stable")[: int((x >= 1).sum())].tolist():
        parts = [(n, m) for n, m in zip(size[j].tolist(), times[j].tolist(), strict=True) if m]
        if n := min(int(x[j]), *(packer.left[n] // m for n, m in parts)):
            packer.fill(parts, n)
    packer.greedy()
    rows = np.array(packer.rows, np.int64).reshape(-1, 10)
    levels = []
    for cuts in range(int(rows[:, 0].max(initial=-1)) + 1):
        own = rows[rows[:, 0] == cuts]
        keys = (own[:, 1] << RANK) + own[:, 2]
        order = np.argsort(keys)
        levels.append((keys[order], own[order, 3:]))
    return Plan(packer.sequences, levels)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``with_ids`` the piece's ids array<int> too.

    start counts the document's ids before the piece; sequences are numbered from 0, those of whole windows first.
    """
    rows = materialize(window_ids(docs, path, window, end, id_col, text_col, with_ids), "pack-ids")
    # tails by (task, length), and whole windows by task as length 0
    tails = rows.where("tail > 0").groupBy("part", "tail").agg(F.count(F.lit(1)).alias("n"))
    fulls = rows.groupBy("part").agg(F.sum(F.size("full_crc32")).alias("n")).select("part", F.lit(0).alias("tail"), "n")
    before = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(tails.unionByName(fulls).select("part", "tail", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "pack-sums")
    histogram = np.zeros(window, np.int64)
    for r in sums.groupBy("tail").agg(F.sum("n").alias("n")).collect():  # a row for each length
        histogram[r.tail] = r.n
    whole = int(histogram[0])
    histogram[0] = 0
    plan = docs.sparkSession.sparkContext.broadcast(make_plan(histogram, window))
    stored = id_type(Vocabulary(path))
    by_task = sums.where("tail = 0").select(F.col("part").alias("w_part"), F.col("before").alias("fulls_before"))
    by_length = sums.where("tail > 0").select(F.col("part").alias("s_part"), F.col("tail").alias("s_tail"), F.col("before").alias("tails_before"))
    keys = by_length.join(by_task, F.col("s_part") == F.col("w_part")).select("s_part", "s_tail", "tails_before", "fulls_before")
    keys = keys.unionByName(by_task.select(F.col("w_part").alias("s_part"), F.lit(0).alias("s_tail"), F.lit(0).cast("long").alias("tails_before"), "fulls_before"))
    placed = rows.join(keys, (F.col("part") == F.col("s_part")) & (F.col("tail") == F.col("s_tail")))
    placed = placed.select("doc_id", "n_ids", "tail", (F.col("tail_rank") + F.col("tails_before")).alias("rank"), (F.col("full_rank") + F.col("fulls_before")).alias("first"), "full_crc32", "ids")
    kind = placed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, tail, rank, first = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_ids", "tail", "rank", "first"))
            full = n // window
            row, start, length, sequence, offset = plan.value.pieces(tail, rank)
            ids = batch.column("ids").to_pylist()
            width = int(stored[-1])
            crc = [zlib.crc32(np.frombuffer(piece_of(ids[r], width, n[r] if with_ids else tail[r], tail[r], s, k), stored).astype("<u4").tobytes()) for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            of_full = np.repeat(np.arange(len(n)), full)
            no = np.arange(len(of_full)) - np.repeat(np.cumsum(full) - full, full)
            row, start = np.concatenate((of_full, row)), np.concatenate((no * window, start + (full * window)[row]))
            length, sequence = np.concatenate((np.full(len(no), window), length)), np.concatenate((first[of_full] + no, whole + sequence))
            offset, crc = np.concatenate((np.zeros(len(no), np.int64), offset)), np.concatenate((batch.column("full_crc32").flatten().to_numpy(), np.array(crc, np.int64)))
            columns = [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, length, crc, n[row], sequence, offset))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                pieces = [np.frombuffer(ids[r], stored)[s : s + k].astype(np.int32) for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                columns.append(pa.array(pieces, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return arrow_map(placed, run, schema)


def piece_of(ids: bytes, width: int, held: int, tail: int, start: int, length: int) -> bytes:
    """The bytes of a tail's piece; ``held`` ids are there, the tail's last."""
    at = int(held - tail + start) * width
    return ids[at : at + length * width]

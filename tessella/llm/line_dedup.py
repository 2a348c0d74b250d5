"""Line dedup: fuzzy lines by MinHash.

Lines (cut at ``\\n``) are compared in normal form: A-Z lower-cased, runs of ASCII white space as one space, none at the
ends. A signature has the minimum of the k-byte shingle hashes in each of BANDS * ROWS bins of one permutation, empty
bins taking their next neighbour's value; lines that agree in all rows of a band share a bucket. With 12 bands of 4
rows a pair of Jaccard similarity s meets with probability 1 - (1 - s^4)^12: 0.998 at 0.8 and 0.99999 at 0.9. Buckets
are verified on the exact shingle sets, the verified links go through distributed union-find, and of each component the
line that comes first (smallest doc_id, then part (below), then line number) stays; all its other occurrences go, equal
lines included. A line of under k bytes is one shingle as a whole, so it is similar to its equals only. Lines are equal if
95 bits of hashes of their normal forms are.

Defined results: a null text has no lines and stays null; blank lines (under MIN_BYTES bytes in normal form) are never
compared or dropped, lines of any other length are; rows that repeat a doc_id and its text are treated alike, as one
document; different texts of a doc_id are documents of their own, their parts being hashes of the texts; a null doc_id
names no document, so each row that has one is a document of its own (its part is the row's number) and comes first; an
empty table gives an empty result; other columns pass unchanged, but for ones named like the two new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame, Window

from .common import arrow_map, default_partitions, fresh_name, hash_filter, hot_lookup, kept_of_components, materialize, passes, unclashed
from .components import connected_components
from .verify import char_shingles, mix64, packed_shingles, verified_links

K, BANDS, ROWS, THRESHOLD, MIN_BYTES = 7, 12, 4, 0.8, 1
#: Distinct lines that a task remembers to make their signatures only once, and bytes whose shingles it hashes at once.
SEEN, CHUNK_BYTES = 200_000, 1 << 19
#: Band keys that a task packs at once.
PACKED_KEYS = 1 << 19


_NOT_NORMAL = (b"  ", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c")


def normal_lines(text: bytes, min_bytes: int) -> Iterator[tuple[int, bytes]]:
    """(number, normal form) of the lines that count."""
    text = text.lower()
    # most texts have no white space that the normal form would change
    normal = not (text.startswith(b" ") or text.endswith(b" ") or any(w in text for w in _NOT_NORMAL))
    for number, line in enumerate(text.split(b"\n")):
        form = line if normal else b" ".join(line.split())
        if len(form) >= min_bytes:
            yield number, form


def _hashes(form: bytes) -> tuple[int, int]:
    """A line's id (64 bits, signed) and check (31 bits more): lines are equal if both are."""
    h = xxhash.xxh3_128_intdigest(form)
    low = h & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low, h >> 97


def _id(form: bytes) -> int:
    return _hashes(form)[0]


def band_keys(forms: list[bytes], k: int = K, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys (lines x bands) of lines of at least k bytes."""
    bins = bands * rows
    lengths = np.fromiter(map(len, forms), np.int64, len(forms))
    h = packed_shingles(np.frombuffer(b"".join(forms), np.uint8), k)
    n = len(h)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    slot = (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    slot += np.repeat(np.arange(len(forms), dtype=np.int64) * bins, lengths)[:n]
    # shingles across the border of two lines go to a slot of their own
    across = (np.cumsum(lengths)[:, None] - np.arange(1, k)[None, :]).ravel()
    slot[across[across < n]] = len(forms) * bins
    empty = np.uint64(1 << 32)
    least = np.full(len(forms) * bins + 1, empty, np.uint64)
    np.minimum.at(least, slot, h & np.uint64(0xFFFFFFFF))
    least = least[:-1].reshape(len(forms), bins)
    hole = least == empty
    holed = np.flatnonzero(hole.any(axis=1))
    if len(holed):  # take the next filled bin's value, round the end
        some = hole[holed]
        at = np.where(np.concatenate((some, some), axis=1), 2 * bins, np.arange(2 * bins)[None, :])
        at = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :bins]
        least[holed] = np.take_along_axis(least[holed], at % bins, axis=1) + (at - np.arange(bins)[None, :]).astype(np.uint64) * np.uint64(0x9E3779B1)
    keys = np.zeros((len(forms), bands), np.uint64)
    parts = least.reshape(len(forms), bands, rows)
    for r in range(rows):
        keys = mix64(keys * np.uint64(31) + parts[:, :, r])
    return mix64(keys + np.arange(bands, dtype=np.uint64)[None, :])


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def occurrences(rows: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(place, part, line_no, id, check) of each line of rows (place, part, text) that counts; id and check are hashes of the normal form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, part, number, ids, checks = [], [], [], [], []
            for p, q, text in zip(batch.column("place").to_pylist(), batch.column("part").to_pylist(), _texts(batch), strict=True):
                for i, form in normal_lines(text or b"", min_bytes):
                    place.append(p)
                    part.append(q)
                    number.append(i)
                    h, check = _hashes(form)
                    ids.append(h)
                    checks.append(check)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(part, pa.int64()), pa.array(number, pa.int32()), pa.array(ids, pa.int64()), pa.array(checks, pa.int32())], names=["place", "part", "line_no", "id", "check"])

    return arrow_map(rows.select("place", "part", "text"), run, "place long, part long, line_no int, id long, check int")


def buckets(rows: DataFrame, k: int = K, bands: int = BANDS, n_rows: int = ROWS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Members (group, id) of the buckets with two or more different lines. A group has the smallest id of its members as its name, so the buckets of all bands in which a line comes first are one group.
    Lines of under k bytes have no near copies and no keys.

    Band keys travel packed: a task sends arrays of (key, id) to each partition of the shuffle instead of a row for each
    key, and the receiving task, which holds its share of the keys, sorts them as arrays.
    """
    parts, least = default_partitions(rows.sparkSession), max(min_bytes, k)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        made: list[tuple[np.ndarray, np.ndarray]] = []

        def sign(ids: list[int], forms: list[bytes]) -> None:
            made.append((band_keys(forms, k, bands, n_rows).ravel(), np.repeat(np.array(ids, np.int64), bands)))

        def packed() -> pa.RecordBatch:
            key, own = (np.concatenate([m[i] for m in made]) for i in (0, 1))
            made.clear()
            to = (key % np.uint64(parts)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            key, own, to = key[order], own[order], to[order]
            begins = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            ends = np.append(begins[1:], len(to))
            blobs = [np.stack((key[a:b].view(np.int64), own[a:b])).tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(to[begins]), pa.array(blobs, pa.binary())], names=["part", "packed"])

        ids, forms, held = [], [], 0
        for batch in batches:
            for text in _texts(batch):
                for _, form in normal_lines(text or b"", least):
                    i = _id(form)
                    if i in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(i)
                    ids.append(i)
                    forms.append(form)
                    held += len(form)
                    if held >= CHUNK_BYTES:
                        sign(ids, forms)
                        ids, forms, held = [], [], 0
                        if sum(len(m[0]) for m in made) >= PACKED_KEYS:
                            yield packed()
        if ids:
            sign(ids, forms)
        if made:
            yield packed()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                got.setdefault(part, []).append(np.frombuffer(blob, np.int64).reshape(2, -1))
        for part in list(got):
            key, own = np.concatenate(got.pop(part), axis=1)
            order = np.argsort(key)
            key = key[order]
            same = key[1:] == key[:-1]
            shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
            key, own = key[shared], own[order[shared]]
            order = np.lexsort((own, key))
            key, own = key[order], own[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
            key, own = key[new], own[new]
            begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(begins, len(key)))
            lead = np.repeat(own[begins], size)
            several = np.repeat(size > 1, size)
            pairs = np.unique(np.stack((lead[several], own[several]), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["group", "id"])

    packed_keys = arrow_map(rows.select("text"), keys, "part int, packed binary")
    return arrow_map(packed_keys.repartitionById(parts, F.col("part")), runs, "group long, id long").distinct()


def line_texts(rows: DataFrame, members: DataFrame, least: int = K) -> DataFrame:
    """(id, text) of the members' lines, one row for each; lines that aren't members are stopped in the scan by a filter of bounded size, those of under ``least`` bytes before it."""
    held = rows.sparkSession.sparkContext.broadcast(bytes(hash_filter(members)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.frombuffer(held.value, np.uint64), set()
        for batch in batches:
            ids, forms = [], []
            for text in _texts(batch):
                for _, form in normal_lines(text or b"", least):
                    ids.append(_id(form))
                    forms.append(form)
            ids = np.array(ids, np.int64)
            keep = np.flatnonzero(passes(table, ids.view(np.uint64))).tolist() if len(ids) else []
            if len(seen) > SEEN:
                seen.clear()
            keep = [i for i in keep if ids[i] not in seen and not seen.add(ids[i])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep] if keep else [], pa.int64()), pa.array([forms[i] for i in keep], pa.binary())], names=["id", "text"])

    return arrow_map(rows.select("text"), run, "id long, text binary").groupBy("id").agg(F.first("text").alias("text"))


def dropped_lines(texts: DataFrame, k: int, bands: int, rows: int, threshold: float, min_bytes: int) -> DataFrame:
    """(place, part, dropped array<int>) for the documents of texts (place, part, text) that lose lines."""
    occ = materialize(occurrences(texts, min_bytes), "line-occurrences")
    members = materialize(buckets(texts, k, bands, rows, min_bytes), "line-members")
    comps = connected_components(verified_links(members, line_texts(texts, members, max(min_bytes, k)), char_shingles(k), threshold))
    lines = materialize(occ.groupBy("id", "check").agg(F.min(F.struct("place", "part", "line_no")).alias("first"), F.count(F.lit(1)).alias("n")), "line-distinct")
    # a link was verified on one text of an id: should two lines share an id, neither goes by a link
    linked = comps.join(lines, F.col("node") == F.col("id")).select("node", "check", "root", "first", "n", F.count(F.lit(1)).over(Window.partitionBy("node")).alias("forms")).where("forms = 1")
    named = kept_of_components(linked.select("node", "check", "root", "first", "n"), "first")
    single = lines.where("n > 1").join(comps.select("node"), F.col("id") == F.col("node"), "left_anti").select(F.col("id").alias("node"), "check", "n", F.col("first").alias("keep"))
    table = materialize(named.union(single).withColumnRenamed("check", "node_check"), "line-table")
    found = hot_lookup(occ, ["id", "check"], table, ["node", "node_check"], "n", occ.count())
    gone = found.where("place != keep.place or part != keep.part or line_no != keep.line_no")
    return gone.groupBy("place", "part").agg(F.sort_array(F.array_distinct(F.collect_list("line_no"))).alias("dropped"))


def _place(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))


def _with_places(docs: DataFrame, id_col: str, text_col: str, key: str, part: str) -> DataFrame:
    """docs with columns key (place by doc_id) and part, which tells the documents of one place apart: a hash of the text, or the row's number where doc_id is null.

    Row numbers hold for one evaluation only, so the rows are written once if any needs its number.
    """
    null = F.col(id_col).cast("long").isNull()
    if docs.where(null).limit(1).isEmpty():
        return docs.withColumns({key: _place(id_col), part: F.xxhash64(F.col(text_col))})
    own = F.when(null, F.monotonically_increasing_id()).otherwise(F.xxhash64(F.col(text_col)))
    return materialize(docs.withColumns({key: _place(id_col), part: own}), "line-rows")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs with text_col cleaned, and two more columns: line_count (lines before) and line_dropped (array of the numbers of dropped lines)."""
    passed = [c for c in docs.columns if c not in ("line_count", "line_dropped")]
    plain = unclashed(docs, id_col, text_col, "line_count", "line_dropped").drop("line_count", "line_dropped")
    name = fresh_name(plain, "line")
    key, part, place, of, dropped = (f"{name}_{x}" for x in ("key", "part", "place", "of", "dropped"))
    placed = _with_places(plain, id_col, text_col, key, part)
    texts = placed.select(F.col(key).alias("place"), F.col(part).alias("part"), F.col(text_col).alias("text"))
    gone = dropped_lines(texts, k, bands, rows, threshold, min_bytes)
    gone = gone.select(F.col("place").alias(place), F.col("part").alias(of), F.col("dropped").alias(dropped))
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped))
    text = F.when(F.col(dropped).isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    # the documents' side isn't sorted: the other one, line numbers of the documents that lose some, is hashed; a task's
    # part of it is smaller than the lines that it numbers
    joined = placed.join(gone.hint("shuffle_hash"), (F.col(key) == F.col(place)) & (F.col(part) == F.col(of)), "left")
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in plain.columns],
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).alias("line_count"), F.coalesce(F.col(dropped), F.array().cast("array<int>")).alias("line_dropped"),
    ).toDF(*passed, "line_count", "line_dropped")

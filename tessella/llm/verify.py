"""Exact verification of candidate groups: which members of a group are linked."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import arrow_map, default_partitions, hot_lookup, materialize
from .components import connected_components

#: Members of a group that one task compares at once; larger groups are dealt as blocks of half that size.
BLOCK = 2000


def union_links(ids: list[int], sets: list[np.ndarray], similar: Callable[[np.ndarray, np.ndarray], bool]) -> Iterator[tuple[int, int]]:
    """Links that connect exactly the members that similar pairs connect.

    Each member is compared with the members of every component so far until one is similar, largest component
    first; pairs inside a component need no comparison.
    """
    if len(ids) == 2:
        if similar(sets[0], sets[1]):
            yield ids[0], ids[1]
        return
    components: list[list[int]] = []
    for i in range(len(ids)):
        joined = None
        order = range(len(components))
        for c in order if len(components) < 3 else sorted(order, key=lambda c: -len(components[c])):
            if any(similar(sets[i], sets[j]) for j in components[c]):
                if joined is None:
                    yield ids[components[c][0]], ids[i]
                    joined = c
                else:
                    yield ids[components[joined][0]], ids[components[c][0]]
                    components[joined] += components[c]
                    components[c] = []
        if joined is None:
            components.append([i])
        else:
            components[joined].append(i)
        components = [c for c in components if c]


def jaccard_at_least(threshold: float) -> Callable[[np.ndarray, np.ndarray], bool]:
    """On sorted distinct arrays."""

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        if len(small) < threshold * len(large):
            return False
        if not len(large):
            return True
        at = large.searchsorted(small)
        at[at == len(large)] = 0
        shared = int(np.count_nonzero(large[at] == small))
        return shared >= threshold * (len(small) + len(large) - shared) - 1e-9

    return similar


def _large_groups(members: DataFrame, block: int) -> DataFrame | None:
    """(group, id, blocks, mine, size) of the members of groups of more than ``block``, dealt to blocks of half that size; None if there is no such group."""
    half = block // 2
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block)
    sizes = materialize(sizes.select(F.col("group").alias("g"), "size", F.ceil(F.col("size") / half).cast("int").alias("blocks")), "group-sizes")
    if sizes.isEmpty():
        return None
    rows = hot_lookup(members, ["group"], sizes, ["g"], "size", members.count())
    return materialize(rows.select("group", "id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("mine"), "size"), "large-groups")


def _first_parts(large: DataFrame) -> DataFrame:
    """(group, id, part): each block by itself, and each with the first one."""
    pair = lambda a, b: F.least(a, b) * F.col("blocks") + F.greatest(a, b)
    zero = F.lit(0)
    parts = F.when(F.col("mine") == 0, F.sequence(zero, F.col("blocks") - 1)).otherwise(F.array(pair(F.col("mine"), F.col("mine")), pair(zero, F.col("mine"))))
    return large.select("group", "id", F.explode(parts).alias("part"))


def _open_parts(large: DataFrame, links: DataFrame, block: int) -> DataFrame | None:
    """(group, id, part) in which each member that isn't in the largest component of its group so far meets all members of the group; None if there is no such member."""
    comps = connected_components(links)
    rows = large.join(comps, F.col("id") == F.col("node"), "left").select(*large.columns, F.coalesce("root", "id").alias("root"))
    rows = materialize(rows, "large-components")
    counted = rows.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy(F.col("group").alias("g")).agg(F.max_by("root", F.struct("n", "root")).alias("top"), (F.sum("n") - F.max("n")).alias("open"), F.sum("n").alias("all"))
    top = materialize(top.where("open > 0").withColumn("lefts", F.ceil(F.col("open") / (block // 2)).cast("int")), "large-open")
    if top.isEmpty():
        return None
    rows = hot_lookup(rows, ["group"], top, ["g"], "all", large.count())
    left = rows.where("root != top").select("group", "id", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.pmod(F.xxhash64(F.lit("open"), "id"), F.col("lefts")).cast("int") * F.col("blocks") + j)).alias("part"))
    right = rows.select("group", "id", F.explode(F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: i * F.col("blocks") + F.col("mine"))).alias("part"))
    return left.union(right).distinct()


def verified_links(members: DataFrame, texts: DataFrame, shingles: Callable[[list[bytes]], list[np.ndarray]], threshold: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among the members of each group whose shingle sets have a Jaccard similarity of threshold or more: enough of them to connect what all of them connect.

    members: (group long, id long), texts: (id long, text) with one row for each id. The texts are joined to the
    members, dealt by (group, part) and streamed through tasks that hold one part's shingle sets at a time.

    A group of more than ``block`` members is dealt in two rounds. In the first, each block of its members meets itself
    and the first block, three rows a member. Most members of a group of copies are one component by then; in the
    second, the others meet all members. Members inside the largest component need not meet: no link is lost, and only a
    group whose members are unlike each other costs rows that grow faster than the group.
    """
    similar = jaccard_at_least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, ids, sets, out = None, [], [], []
        for batch in batches:
            made = shingles([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            for group, part, i, have in zip(batch.column("group").to_pylist(), batch.column("part").to_pylist(), batch.column("id").to_pylist(), made, strict=True):
                if key != (group, part):
                    out += union_links(ids, sets, similar)
                    key, ids, sets = (group, part), [], []
                ids.append(i)
                sets.append(have)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                out = []
        out += union_links(ids, sets, similar)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    def checked(parts: DataFrame) -> DataFrame:
        rows = parts.join(texts, "id", "inner").repartition(default_partitions(members.sparkSession), "group", "part").sortWithinPartitions("group", "part", "id")
        return arrow_map(rows.select("group", "part", "id", "text"), run, "a long, b long")

    large = _large_groups(members, block)
    if large is None:
        return checked(members.select("group", "id", F.lit(0).alias("part")))
    names = large.select(F.col("group").alias("g")).distinct()
    small = members.join(names, F.col("group") == F.col("g"), "left_anti").select("group", "id", F.lit(0).alias("part"))
    links = materialize(checked(small.union(_first_parts(large))), "links-first")
    rest = _open_parts(large, links, block)
    return links if rest is None else links.union(checked(rest))


def hash_windows(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k values (uint64); all of them at once if there are fewer."""
    k = max(1, min(k, len(values)))
    n = len(values) - k + 1
    if len(values) == 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + values[j : j + n]
    return mix64(h + np.uint64(k))


def mix64(h: np.ndarray) -> np.ndarray:
    """Spreads the bits (a finalising step of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct_parts(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of each successive part."""
    out, at = [], 0
    for n in counts.tolist():
        part = np.sort(values[at : at + n])
        if n > 1:
            new = np.empty(n, bool)
            new[0] = True
            np.not_equal(part[1:], part[:-1], out=new[1:])
            part = part[new]
        out.append(part)
        at += n
    return out


def packed_shingles(data: np.ndarray, k: int) -> np.ndarray:
    """The k bytes (1 to 8) from each place on as one number, put together by doubling."""
    out, width = data.astype(np.uint64), 1
    while width < k:
        step = min(width, k - width)
        # the last ``step`` bytes of the later window go below; those that overlap are masked away
        out = (out[:-step] << np.uint64(8 * step)) | (out[step:] & np.uint64((1 << 8 * step) - 1))
        width += step
    return out


def char_shingles(k: int) -> Callable[[list[bytes]], list[np.ndarray]]:
    """Sorted distinct k-byte shingles (1 to 8 bytes, exact) of each text; a shorter text is one shingle, filled up with zero bytes in front."""

    def shingles(texts: list[bytes]) -> list[np.ndarray]:
        padded = [t if len(t) >= k else t.rjust(k, b"\0") for t in texts]
        counts = np.fromiter(map(len, padded), np.int64, len(padded)) - k + 1
        if not len(padded):
            return []
        packed = packed_shingles(np.frombuffer(b"".join(padded), np.uint8), k)
        # windows across the border of two texts are left out
        begins = np.concatenate(([0], np.cumsum(counts + k - 1)[:-1]))
        inside = np.repeat(begins - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum()))
        return distinct_parts(packed[inside], counts)

    return shingles


def word_shingles(k: int) -> Callable[[list[bytes]], list[np.ndarray]]:
    """Sorted distinct hashes of the k-word shingles of each text, A-Z lower-cased."""
    import xxhash

    def of(text: bytes) -> np.ndarray:
        words = text.lower().split()
        return np.unique(hash_windows(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), k))

    return lambda texts: [of(t) for t in texts]


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Record batches from tuples."""
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

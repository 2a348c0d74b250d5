"""SimHash near-dedup by segment-popcount embedding.

A fingerprint is embedded as the popcounts of its segments. The Manhattan distance of two such points is at most the
Hamming distance of the fingerprints, also for any choice of segments. A range join on a grid over the points deals out
the work: each distinct fingerprint lies in its own cell and is sent to those of the cells within reach that come later;
large cells are dealt as blocks. The rest is verified on the bits. A task returns only the links that join what it hadn't
joined before, never all pairs.

Grids (see Grid) differ in what they cost, not in what they find: cells over the popcounts of the two halves send few
rows and leave many pairs to compare; with many small segments, dealt to two groups of which one must lie within half the
radius, a point goes to hundreds of cells that leave almost nothing. cheapest() picks by the number of points.

near_dedup() finds candidates for a Jaccard similarity with wider fingerprints and verifies these on the shingle sets;
sizes of the sets are a further dimension of its grid (a Jaccard of t needs sizes within a factor of 1/t).

Defined results: a null text is empty; texts without words have fingerprint zero and are linked like any others; a
text with fewer words than a shingle has its whole sequence as the one shingle; repeated rows are linked like other
equal texts; an empty table gives an empty result; other columns are ignored or passed on.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame, Window

from .common import arrow_map, default_partitions, fresh_name, hash_filter, hot_lookup, kept_of_components, materialize, passes, unclashed
from .components import connected_components
from .verify import batches_of, hash_windows, mix64, verified_links, word_shingles

#: Fingerprints of a cell that one task holds as its own.
CELL_BLOCK = 20_000
#: Seconds that a row sent to a cell and a pair compared there cost, about.
ROW_S, PAIR_S = 2e-6, 1.5e-9
#: Pairs that are compared at once: on arrays that stay in the cache, or gathered from several cells.
PLAIN_CHUNK, CHUNK = 1 << 18, 1 << 21
#: From this radius on segment counts exclude too few pairs of random fingerprints to be worth a look.
PLAIN_RADIUS = 10


def bit_majority(hashes: list[int] | np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    if len(hashes) == 0:
        return 0
    h = np.array(hashes, dtype="<u8")
    if len(h) < 2000:
        count = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    else:
        # bit b of all eight bytes at once, in sums of 255 rows, which a byte holds
        rows = np.concatenate((h, np.zeros(-len(h) % 255, "<u8"))).reshape(-1, 255)
        sums = [((rows >> np.uint64(b)) & np.uint64(0x0101010101010101)).sum(axis=1, dtype="<u8") for b in range(8)]
        count = np.stack([s.view(np.uint8).reshape(len(s), 8).sum(axis=0, dtype=np.int64) for s in sums], axis=1).ravel()
    return int(np.packbits(2 * count.astype(np.int64) > len(h), bitorder="little").view("<u8")[0])


def shingle_hashes(words: list[bytes], k: int, seed: int) -> list[int]:
    """XXH64 of each run of k words joined by spaces; of the whole sequence if there are fewer; of nothing if there is none."""
    if not words:
        return []
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(text, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(text[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, k: int = 4, seed: int = 42) -> int:
    return bit_majority(shingle_hashes(text.lower().split(), k, seed))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, seed: int = 42) -> DataFrame:
    """One row per row of docs: doc_id, fp (the 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t or b"", k, seed)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return arrow_map(unclashed(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


class _Joined:
    """Union-find on points 0 to n - 1, by vectors."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n, dtype=np.int64)

    def merging(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        """Joins a and b; yields the pairs of points that join two components."""
        ra, rb = self.root[a], self.root[b]
        differ = ra != rb
        if not differ.any():
            return
        pairs = np.unique(np.stack((np.minimum(ra, rb)[differ], np.maximum(ra, rb)[differ]), axis=1), axis=0)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        for x, y in pairs.tolist():
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                yield rx, ry
        final = np.arange(len(self.root), dtype=np.int64)
        old = np.fromiter(parent, np.int64, len(parent))
        final[old] = [find(x) for x in parent]
        self.root = final[self.root]


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Popcounts of the four segments of 16 bits."""
    return np.bitwise_count(fp.astype("<u8").view("<u2").reshape(len(fp), 4)).astype(np.int16)


class CellJoin:
    """Links between the points of a cell, which it holds, and those sent to it, which it doesn't keep.

    Points are rows (id, fp, size, further 64 bits ...). A pair is linked if fp is within radius; with further bits, all
    together within radius2; with a ratio, if the sizes are within it.
    """

    def __init__(self, points: np.ndarray, radius: int, radius2: int | None = None, ratio: float | None = None, plain: bool = False) -> None:
        self.radius, self.radius2, self.ratio = radius, radius2, ratio
        self.plain = plain or radius >= PLAIN_RADIUS
        self.own, self.joined = self._sorted(points), _Joined(len(points))
        self.cells, begins = self._cells(self.own)
        self.length = np.diff(begins)

    def _sorted(self, points: np.ndarray) -> np.ndarray:
        """The points by segment counts."""
        return points if self.plain else points[np.lexsort(segment_counts(points[:, 1].view(np.uint64)).T)]

    @staticmethod
    def _cells(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different segment counts of sorted points, and where each begins, with the end."""
        counts = segment_counts(points[:, 1].view(np.uint64))
        new = np.ones(len(points), bool)
        new[1:] = (counts[1:] != counts[:-1]).any(axis=1)
        return counts[new], np.append(np.flatnonzero(new), len(points))

    def inside(self) -> Iterator[tuple[int, int]]:
        """Ids of links among the cell's own points."""
        for a, b in self._matches(self.own, True):
            for x, y in self.joined.merging(a, b):
                yield int(self.own[x, 0]), int(self.own[y, 0])

    def probe(self, points: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ids of links to points sent here: one for each component of own points that such a point reaches, which it joins."""
        points = self._sorted(points)
        for a, b in self._matches(points, False):
            reach = np.unique(np.stack((b, self.joined.root[a]), axis=1), axis=0)
            yield from zip(self.own[reach[:, 1], 0].tolist(), points[reach[:, 0], 0].tolist(), strict=True)
            again = np.flatnonzero(reach[1:, 0] == reach[:-1, 0])
            if len(again):
                for _ in self.joined.merging(reach[again, 1], reach[again + 1, 1]):
                    pass

    def _matches(self, points: np.ndarray, inside: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of an own point and one of points that are to be linked."""
        for a, b in self._plain(points, inside) if self.plain else self._by_cells(points, inside):
            x, y = self.own[a], points[b]
            ok = x[:, 0] != y[:, 0]
            if self.radius2 is not None:
                apart = sum(np.bitwise_count((x[:, c] ^ y[:, c]).view(np.uint64)).astype(np.int64) for c in (1, *range(3, points.shape[1])))
                ok &= apart <= self.radius2
            if self.ratio is not None:
                ok &= np.minimum(x[:, 2], y[:, 2]) >= self.ratio * np.maximum(x[:, 2], y[:, 2]) - 1e-9
            if ok.any():
                yield a[ok], b[ok]

    def _plain(self, points: np.ndarray, inside: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within the radius, all points against all of the cell's own in blocks."""
        fp, some, wide = self.own[:, 1].view(np.uint64), points[:, 1].view(np.uint64), 8192
        for first in range(0, len(some), PLAIN_CHUNK // wide):
            mine = some[first : first + PLAIN_CHUNK // wide]
            for at in range(first // wide * wide if inside else 0, len(fp), wide):
                own = fp[at : at + wide]
                hit = np.flatnonzero(np.bitwise_count(mine[:, None] ^ own[None, :]) <= self.radius)
                if len(hit):
                    yield at + hit % len(own), first + hit // len(own)

    def _by_cells(self, points: np.ndarray, inside: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within the radius, only between cells of segment counts whose Manhattan distance is within it."""
        counts, begins = self._cells(points)
        fp, at_own = self.own[:, 1].view(np.uint64), np.cumsum(self.length) - self.length
        for first in range(0, len(begins) - 1, 256):
            some = begins[first : first + 257]
            apart = sum(np.abs(self.cells[None, :, d] - counts[first : first + 256, d][:, None]) for d in range(4))
            row, cell = np.nonzero(apart <= self.radius)
            ends = np.searchsorted(row, np.arange(len(some)))
            for k in range(len(some) - 1):
                lo, hi = int(some[k]), int(some[k + 1])
                near = cell[ends[k] : ends[k + 1]]
                size = self.length[near]
                at = np.repeat(at_own[near] - np.cumsum(size) + size, size) + np.arange(size.sum())
                if inside:
                    at = at[at >= lo]
                if not len(at):
                    continue
                step, mine = max(1, CHUNK // len(at)), fp[at]
                for here in range(lo, hi, step):
                    hit = np.flatnonzero(np.bitwise_count(points[here : min(here + step, hi), 1].view(np.uint64)[:, None] ^ mine[None, :]) <= self.radius)
                    if len(hit):
                        yield at[hit % len(at)], here + hit // len(at)


@dataclass(frozen=True)
class Grid:
    """How fingerprints are dealt to cells.

    groups = 1: cells over the popcounts of the two halves, exact ones or, for a wide radius, ranges. Else the 64 bits are cut into ``segments`` segments, dealt
    to groups; the Manhattan distance of fingerprints within the radius is at most radius // groups in one of them, and
    a cell is the exact popcounts of a group's segments.
    """

    segments: int
    groups: int

    def reach(self, radius: int) -> int:
        return radius // self.groups

    def offsets(self, radius: int) -> list[tuple[int, ...]]:
        """Steps to the later one of each pair of cells of a group within reach."""
        return sorted(x for x in _steps(self.segments // self.groups, self.reach(radius)) if next((d for d in x if d), 0) > 0)

    def rows(self, radius: int) -> float:
        """Rows that a point is sent as."""
        if self.groups == 1 and radius >= PLAIN_RADIUS:
            return 4.0
        return self.groups * (1 + sum(_shell(self.segments // self.groups, r) for r in range(1, self.reach(radius) + 1)) / 2)

    def share(self, radius: int) -> float:
        """Share of the pairs of random fingerprints that are compared."""
        if self.groups == 1:
            # tasks look at four segments before they compare
            return 1.0 if radius >= PLAIN_RADIUS else _within(16, 4, radius)
        return self.groups * _within(64 // self.segments, self.segments // self.groups, self.reach(radius))

    def cost(self, n: int, radius: int) -> float:
        """Seconds of all tasks for n points."""
        return n * self.rows(radius) * ROW_S + n * n / 2 * self.share(radius) * PAIR_S


def _steps(dims: int, reach: int) -> Iterator[tuple[int, ...]]:
    """All integer vectors with a sum of absolute values of at most reach."""
    if not dims:
        yield ()
        return
    for d in range(-reach, reach + 1):
        for rest in _steps(dims - 1, reach - abs(d)):
            yield (d, *rest)


def _shell(dims: int, r: int) -> int:
    """Number of integer vectors with a sum of absolute values of exactly r > 0."""
    return sum(math.comb(dims, k) * math.comb(r - 1, k - 1) * 2**k for k in range(1, min(dims, r) + 1))


def _within(bits: int, dims: int, reach: int) -> float:
    """P(the popcounts of ``dims`` segments of ``bits`` random bits are within a Manhattan distance)."""
    one = np.zeros(bits + 1)
    for d in range(-bits, bits + 1):
        one[abs(d)] += math.comb(2 * bits, bits + d) / 4**bits
    total = np.ones(1)
    for _ in range(dims):
        total = np.convolve(total, one)
    return float(total[: reach + 1].sum())


HALVES = Grid(2, 1)
GRIDS = (HALVES, Grid(16, 2), Grid(32, 2))


def cheapest(n: int, radius: int) -> Grid:
    """The grid for n points."""
    return min(GRIDS, key=lambda g: g.cost(n, radius))


def _dealt(points: DataFrame, grid: Grid, radius: int, ratio: float | None) -> tuple[DataFrame, DataFrame]:
    """points with the key of their own cell, and with those of the later cells that they are sent to."""
    columns = points.columns
    if grid.groups > 1:
        bits, per = 64 // grid.segments, grid.segments // grid.groups
        # a digit of a key is a count and the reach, so that no step goes below zero
        width = (bits + 2 * grid.reach(radius)).bit_length()
        digit = lambda i: F.bit_count(F.shiftrightunsigned("fp", i * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))) + grid.reach(radius)
        key = lambda g: sum((F.shiftleft(digit(g * per + i).cast("long"), width * i) for i in range(per)), F.lit(g << width * per).cast("long"))
        own = points.select(*columns, F.explode(F.array(*[key(g) for g in range(grid.groups)])).alias("key"))
        steps = F.array(*[F.lit(sum(d << width * i for i, d in enumerate(x))).cast("long") for x in grid.offsets(radius)])
        return own, own.select(*columns, F.explode(F.transform(steps, lambda d: F.col("key") + d)).alias("key"))
    width = radius // 2 + 1 if radius >= PLAIN_RADIUS else 1
    half = lambda i: F.bit_count(F.shiftrightunsigned("fp", 32) if i else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).cast("int")
    size_cell = F.lit(0) if ratio is None else F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / (math.log(1 / ratio) * 1.000001)).cast("int")
    key = lambda z, x, y: (z * 4096 + (x + 16) * 64 + y + 16).cast("long")
    cells = points.select(*columns, half(0).alias("p"), half(1).alias("q"), size_cell.alias("z")).select("*", F.floor(F.col("p") / width).cast("int").alias("x"), F.floor(F.col("q") / width).cast("int").alias("y"))
    reach = math.ceil(radius / width)
    offsets = [o for o in itertools.product((0,) if ratio is None else (0, 1), range(-reach, reach + 1), range(-reach, reach + 1)) if o > (0, 0, 0)]

    def gap(p: Column, cell: Column, d: Column) -> Column:
        return F.when(d > 0, (cell + d) * width - p).when(d < 0, p - ((cell + d) * width + width - 1)).otherwise(F.lit(0))

    table = F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dx"), F.lit(c).alias("dy")) for a, b, c in offsets])
    near = F.filter(table, lambda o: gap(F.col("p"), F.col("x"), o["dx"]) + gap(F.col("q"), F.col("y"), o["dy"]) <= radius)
    sent = F.explode(F.transform(near, lambda o: key(F.col("z") + o["dz"], F.col("x") + o["dx"], F.col("y") + o["dy"])))
    return cells.select(*columns, key(F.col("z"), F.col("x"), F.col("y")).alias("key")), cells.select(*columns, sent.alias("key"))


def hamming_links(points: DataFrame, radius: int, radius2: int | None = None, ratio: float | None = None, grid: Grid | None = None) -> DataFrame:
    """Links (a, b) between ids of points (id, fp, size, further longs ...), enough to connect what all pairs within the bounds connect."""
    spark, columns = points.sparkSession, points.columns
    points = materialize(points, "grid-points")
    grid = grid or (HALVES if ratio is not None else cheapest(points.count(), radius))
    own, sent = _dealt(points, grid, radius, ratio)
    # cells of more than a block: at most one for each CELL_BLOCK rows; Spark broadcasts them only while their measured size is small
    large = own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_BLOCK)
    large = materialize(large.select(F.col("key").alias("c_key"), F.ceil(F.col("n") / CELL_BLOCK).cast("int").alias("blocks")), "grid-cells")
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    to = lambda first, home: F.explode(F.transform(F.sequence(first, blocks - 1), lambda b: F.struct(b.alias("block"), home(b).alias("home")))).alias("b")
    on = F.col("key") == F.col("c_key")
    home = own.join(large, on, "left").select("key", *columns, to(mine, lambda b: b == mine))
    away = sent.join(large, on, "left").select("key", *columns, to(F.lit(0), lambda b: F.lit(False)))
    rows = home.union(away).select("key", *columns, "b.block", "b.home")
    rows = rows.repartition(max(default_partitions(spark), 16), "key", "block").sortWithinPartitions("key", "block", F.col("home").desc())
    make = lambda waiting: CellJoin(np.concatenate(waiting), radius, radius2, ratio, plain=grid.groups > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def links() -> Iterator[tuple[int, int]]:
            key, join, waiting = None, None, []
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "block")], axis=1)
                data = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1)
                at_home = batch.column("home").to_numpy(zero_copy_only=False).astype(bool)
                change = np.ones(len(keys), bool)
                change[1:] = (keys[1:] != keys[:-1]).any(axis=1) | (at_home[1:] != at_home[:-1])
                begins = np.append(np.flatnonzero(change), len(keys)).tolist()
                for lo, hi in zip(begins[:-1], begins[1:], strict=True):
                    k = tuple(keys[lo].tolist())
                    if k != key:
                        if join is None and waiting:
                            yield from make(waiting).inside()
                        key, join, waiting = k, None, []
                    if at_home[lo]:
                        waiting.append(data[lo:hi])
                    else:
                        if join is None and waiting:
                            join = make(waiting)
                            yield from join.inside()
                            waiting = []
                        if join is not None:
                            yield from join.probe(data[lo:hi])
            if join is None and waiting:
                yield from make(waiting).inside()

        yield from batches_of(links(), schema)

    return arrow_map(rows, run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id (smallest doc_id reachable over fingerprints within radius bits), group_size."""
    fps = materialize(fingerprints(docs, id_col, text_col, k), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    edges = hamming_links(classes.select(F.col("fp").alias("id"), "fp"), radius)
    nodes = connected_components(edges)
    linked = nodes.join(classes, F.col("node") == F.col("fp")).select("node", "root", "least", "n")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size"))
    named = linked.select("node", F.col("root").alias("r")).join(roots, F.col("r") == F.col("root")).select(F.col("node").alias("l_fp"), "component_id", "size")
    table = classes.join(named, F.col("fp") == F.col("l_fp"), "left").select(F.col("fp").alias("c_fp"), "n", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("size", "n").alias("group_size"))
    table = materialize(table, "simhash-table")
    out = hot_lookup(fps, ["fp"], table, ["c_fp"], "n", fps.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def near_groups(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, radius: int = 22, radius2: int = 76) -> DataFrame:
    """Rows (row, keep) for the rows that have a near copy: Jaccard of k-word shingle sets at or above threshold, over any chain of such links. row_col identifies a row; keep has the row of the smallest id, nulls last, and of those the smallest row.

    Candidates come from fingerprints of 4 x 64 bits within radius (first 64) and radius2 (all); at the threshold the
    expected distance of all is 256 * acos(2t / (1 + t)) / pi = 39 bits with a deviation of 6, and 52 for texts of a
    dozen shingles. Two unrelated texts are candidates with a probability of 5e-11, so candidates seldom connect groups.
    """
    more = ["fp2", "fp3", "fp4"]

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = (text or b"").lower().split()
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                s = np.unique(hash_windows(h, k))
                seeded = [s, *(mix64(s ^ np.uint64(0xA0761D6478BD642F * i % (1 << 64))) for i in (1, 2, 3))]
                rows.append((_signed(xxhash.xxh3_64_intdigest(b" ".join(words))), *(_signed(bit_majority(x)) for x in seeded), len(s)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]] if rows else [batch.column("doc_id")] * 8, names=["doc_id", "row", "id", "fp", *more, "size"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    every = materialize(arrow_map(rows, points, "doc_id long, row long, id long, fp long, fp2 long, fp3 long, fp4 long, size long"), "near-points")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")
    # texts are equal if the hash and the first fingerprint, another hash of theirs, are
    classes = materialize(every.groupBy("id", "fp").agg(*[F.first(c).alias(c) for c in (*more, "size")], least, F.count(F.lit(1)).alias("n")), "near-classes")
    groups = connected_components(hamming_links(classes.select("id", "fp", "size", *more), radius, radius2, threshold))
    members = materialize(groups.select(F.col("root").alias("group"), F.col("node").alias("id")), "near-members")
    words = hash_filter(members)
    held = docs.sparkSession.sparkContext.broadcast(bytes(words))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(held.value, np.uint64)
        for batch in batches:
            texts = [b" ".join((t or b"").lower().split()) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ids = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)
            keep = np.flatnonzero(passes(table, ids)) if len(ids) else []
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep].view(np.int64) if len(ids) else [], pa.int64()), pa.array([texts[i] for i in keep], pa.binary())], names=["id", "text"])

    texts = arrow_map(rows.select("text"), wanted, "id long, text binary").groupBy("id").agg(F.first("text").alias("text"))
    comps = connected_components(verified_links(members, texts, word_shingles(k), threshold))
    # a link was verified on one text of an id: should two texts share an id, neither goes by a link
    linked = comps.join(classes, F.col("node") == F.col("id")).select("node", F.col("fp").alias("node_fp"), "root", "least", "n", F.count(F.lit(1)).over(Window.partitionBy("node")).alias("forms")).where("forms = 1")
    named = kept_of_components(linked.select("node", "node_fp", "root", "least", "n"), "least")
    single = classes.where("n > 1").join(comps.select("node"), F.col("id") == F.col("node"), "left_anti").select(F.col("id").alias("node"), F.col("fp").alias("node_fp"), "n", F.col("least").alias("keep"))
    table = materialize(named.union(single), "near-table")
    return hot_lookup(every.select("row", "id", "fp"), ["id", "fp"], table, ["node", "node_fp"], "n", every.count()).select("row", F.col("keep.row").alias("keep"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without those that have a near copy with a smaller id; of each group one row stays, that of the smallest id and of rows with equal ids the first."""
    plain = unclashed(docs, id_col, text_col)
    own = fresh_name(plain, "row")
    rows = materialize(plain.withColumn(own, F.monotonically_increasing_id()), "near-rows")
    dropped = near_groups(rows, own, id_col, text_col, **options).where("row != keep").select(F.col("row").alias(f"{own}_gone"))
    return rows.join(dropped, F.col(own) == F.col(f"{own}_gone"), "left_anti").drop(own).toDF(*docs.columns)

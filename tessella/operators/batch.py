"""Batch search by a saved index: rows are dealt to blocks, and each block has its own buckets of every table.

An index of this kind holds a row for each vector, with the vector and its buckets, dealt to blocks by id and saved as a
table that is bucketed by block; a vector is written once, however many tables there are. Queries are broadcast without
their buckets, in passes of at most BROADCAST_VALUES numbers. A block's task makes their buckets some thousand queries at a
time, finds the rows of its own that share one, computes the distances of the pairs and keeps the k nearest rows of each
query; nothing else is shuffled. The index is read once for each pass and never shuffled.

A bucket's rows are in all blocks, so a hot bucket is no task of its own, and a block has block_rows rows on average, so
that what is held in a task doesn't grow with the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tessella.session import materialize, ship

from .lsh import DECIMALS, LshParams, probe_buckets, recall_table
from .search import BROADCAST_VALUES, ranked

#: Rows of a block; the fewest where there are fewer blocks than cores; the most files of the saved table; pairs and buckets that are compared at once; buckets of a table whose rows are found by their number.
BLOCK_ROWS, LEAST_ROWS, FILES, PAIRS, ASKED, DIRECT = 1 << 17, 1 << 12, 4096, 1 << 19, 1 << 19, 1 << 21
#: Rows of the sample that a width is fitted on, and neighbours whose distances are fitted.
SAMPLE, FITTED = 2000, 16
#: An odd factor that deals ids to blocks.
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class BatchIndex:
    """A saved index: its table, its parameters and the number of its blocks."""

    name: str
    params: LshParams
    blocks: int

    @property
    def parts(self) -> int:
        """How many parts a bucket of all rows has beyond one."""
        return self.blocks - 1


def _rows(vecs: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vecs.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.array(batch.column("vec").flatten()).reshape(-1, dim)


def _lists(values: np.ndarray, dim: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * dim), pa.array(values.ravel()))


def save_batch_index(vecs: DataFrame, params: LshParams, name: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> BatchIndex:
    """Writes the index of vecs as a table; drop_index() deletes it. Each vector is shuffled and written once, with a bucket of each table."""
    spark = vecs.sparkSession
    ship(spark)
    name = name or f"tessella_index_{uuid.uuid4().hex}"
    rows = _rows(vecs, id_col, vec_col)
    n = rows.count()
    blocks = max(1, -(-n // block_rows), min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                x = _vectors(part, params.D)
                block = (part.column("id").to_numpy().astype(np.uint64) * MIX >> np.uint64(32)) % np.uint64(blocks)
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), part.column("id"), _lists(x, params.D), _lists(params.buckets(params.hashes(x)).astype(params.kind), params.L)], names=["block", "id", "vec", "buckets"])

    files = min(blocks, FILES)
    made = rows.mapInArrow(placed, f"block long, id long, vec array<double>, buckets array<{'int' if params.kind is np.int32 else 'long'}>")
    # the rows of a file come together first, so that a task writes few files
    made.repartition(files, "block").write.mode("overwrite").bucketBy(files, "block").sortBy("block").saveAsTable(name)
    return BatchIndex(name, params, blocks)


def drop_index(spark: SparkSession, index: BatchIndex) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {index.name}")


class _Block:
    """Rows of a block by their buckets, and the k nearest of those that share a bucket with a query."""

    def __init__(self, rows: pa.Table, params: LshParams, tables: np.ndarray) -> None:
        ids = rows.column("id").combine_chunks().to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.rows = np.array(rows.column("vec").combine_chunks().flatten()).reshape(-1, params.D)[order]
        buckets = np.array(rows.column("buckets").combine_chunks().flatten()).reshape(-1, params.L)[order]
        self.of, self.starts, self.sorted = [], [], []
        for t in tables:
            by_bucket = np.argsort(buckets[:, t], kind="stable").astype(np.int32)
            self.of.append(by_bucket)
            if params.H <= DIRECT:
                self.starts.append(np.concatenate(([0], np.cumsum(np.bincount(buckets[:, t], minlength=params.H)))).astype(np.int32))
            else:
                self.sorted.append(buckets[by_bucket, t])

    def ranges(self, t: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of a table's rows by bucket, and the number of rows, of each bucket asked for; -1 has none."""
        if self.starts:
            low = self.starts[t][asked]
            hits = self.starts[t][asked + 1] - low
        else:
            low = np.searchsorted(self.sorted[t], asked, "left")
            hits = np.searchsorted(self.sorted[t], asked, "right") - low
        return low, np.where(asked < 0, 0, hits)

    def nearest(self, vecs: np.ndarray, asked: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(queries, ids, distances, number of the tables that found them; places of these tables) of queries (n x D) with buckets (n x tables x probes), for a few queries at a time."""
        n, found = len(vecs), [self.ranges(t, asked[:, t]) for t in range(asked.shape[1])]
        made, at = np.cumsum(sum(hits.sum(axis=1, dtype=np.int64) for _, hits in found)), 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(made, (made[at - 1] if at else 0) + PAIRS, "right")))
            codes = []
            for t, (low, hits) in enumerate(found):
                low, hits = low[at:to].ravel().astype(np.int64), hits[at:to].ravel()
                some = np.flatnonzero(hits)
                low, hits, q = low[some], hits[some].astype(np.int64), some // asked.shape[2]
                row = self.of[t][np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())]
                codes.append((np.repeat(q, hits) * len(self.ids) + row) * asked.shape[1] + t)
            codes = np.sort(np.concatenate(codes))  # a row may have several common buckets with a query
            codes = codes[np.concatenate(([True], codes[1:] != codes[:-1]))[: len(codes)]]
            pair = codes // asked.shape[1]
            first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))[: len(pair)])
            q, row = pair[first] // len(self.ids), pair[first] % len(self.ids)
            square = np.zeros(len(q))
            for j in range(vecs.shape[1]):  # in the order of the expression on columns
                square += (vecs[at + q, j] - self.rows[row, j]) ** 2
            d, i = np.round(np.sqrt(square), DECIMALS), self.ids[row]
            # rows are in the order of their ids, and so are equal distances
            order = np.argsort(d, kind="stable")
            order = order[np.argsort(q[order].astype(np.uint16 if to - at < 1 << 16 else np.int64), kind="stable")]
            a, b, c = q[order], i[order], d[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])))[: len(a)]  # a table may have a row twice
            place = np.cumsum(new) - 1
            best = order[(place - place[np.searchsorted(a, a)] < k) & new]
            by = np.diff(np.append(first, len(codes)))[best]
            yield at + q[best], i[best], d[best], by, codes[np.repeat(first[best] - np.cumsum(by) + by, by) + np.arange(by.sum())] % asked.shape[1]
            at = to


def batch_knn(index: BatchIndex, queries: DataFrame, k: int, probes: int = 0, tables: list[int] | None = None, id_col: str = "vec_id", vec_col: str = "embedding", work: bool = False, spans: tuple[str, str] | None = None, by_table: bool = False) -> DataFrame:
    """(query_id, id, dist, rank): the k nearest of each query among the rows that share a bucket with it, by exact L2. With ``work`` (query_id, pairs) instead: the rows of its buckets.

    ``spans`` names two columns, arrays with a number for each table: the first probe that the query makes there and the
    one after its last, in the order of their expected worth; 0 is its own bucket. ``by_table`` adds found_by, an array of
    the tables that have found the row.
    """
    spark, params = queries.sparkSession, index.params
    ship(spark)
    which = np.arange(params.L) if tables is None else np.array(tables)
    asked = _rows(queries, id_col, vec_col) if spans is None else queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), *[F.col(c).cast("array<int>").alias(n) for c, n in zip(spans, ("low", "high"), strict=True)])
    if spans is None:
        n = asked.count()
    else:
        n, last = asked.agg(F.count(F.lit(1)), F.max(F.array_max("high"))).first()
        probes = max(0, (last or 1) - 1)
    passes = max(1, -(-n * (1 + params.D + (0 if spans is None else 2 * params.L)) // BROADCAST_VALUES))
    kinds = {"query_id": pa.int64(), **({"pairs": pa.int64()} if work else {"id": pa.int64(), "dist": pa.float64()})}
    schema = ("query_id long, pairs long" if work else "query_id long, id long, dist double") + ", found_by array<long>" * by_table

    def one(part: DataFrame) -> DataFrame:
        rows = part.toArrow()
        values = {c: np.array(rows.column(c).combine_chunks().flatten()).reshape(len(rows), -1) if len(rows) else np.zeros((0, params.D)) for c in rows.column_names if c != "id"}
        held = spark.sparkContext.broadcast((rows.column("id").to_numpy(), values))

        def meet(rows: pa.Table) -> pa.Table:
            ids, values = held.value
            block, out, size = _Block(rows, params, which), [], max(1, ASKED // (len(which) * (probes + 1)))
            for at in range(0, len(ids), size):
                vecs = values["vec"][at : at + size]
                keys = probe_buckets(params, vecs, params.L, probes)
                if spans is not None:
                    low, high = (values[c][at : at + size, :, None] for c in ("low", "high"))
                    keys = np.where((np.arange(probes + 1) >= low) & (np.arange(probes + 1) < high), keys, -1)
                keys = keys[:, which]
                if work:
                    keys = np.sort(keys, axis=2)
                    keys[:, :, 1:][keys[:, :, 1:] == keys[:, :, :-1]] = -1
                    out.append((ids[at : at + size], sum(block.ranges(t, keys[:, t])[1].sum(axis=1, dtype=np.int64) for t in range(len(which)))))
                else:
                    out += [(ids[at + q], *found) for q, *found in block.nearest(vecs, keys, k)]
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
            found = {c: pa.array(values, kind) for (c, kind), values in zip(kinds.items(), columns, strict=False)}
            if by_table:
                found["found_by"] = pa.ListArray.from_arrays(np.append(0, np.cumsum(columns[3])).astype(np.int32), pa.array(which[columns[4].astype(np.int64)]))
            return pa.table(found)

        found = spark.table(index.name).groupBy("block").applyInArrow(meet, schema)
        return found.groupBy("query_id").agg(F.sum("pairs").alias("pairs")) if work else ranked(found, k)

    if passes == 1:
        return one(asked)
    return reduce(DataFrame.unionByName, [materialize(one(asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i)), "batch-pass") for i in range(passes)])


def search_once(vecs: DataFrame, queries: DataFrame, params: LshParams, k: int, probes: int = 0, tables: list[int] | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """batch_knn() by an index that is saved for it and deleted after it; the result is a table."""
    index = save_batch_index(vecs, params, None, id_col, vec_col)
    try:
        return materialize(batch_knn(index, queries, k, probes, tables, id_col, vec_col), "batch-nearest")
    finally:
        drop_index(vecs.sparkSession, index)


def fitted_width(vecs: DataFrame, params: LshParams, k: int, target: float, probes: int = 0, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> LshParams:
    """params with the least width whose modelled recall at the distance of the k-th neighbour reaches the target.

    That distance falls as the table grows. It is read off a power law, distance = a * neighbours^b, fitted to the
    distances of the first neighbours within a sample of at most ``sample`` rows, those with the least hashes of their
    ids; of n rows the k-th is where a sample of s has its (k * s / n)-th.
    """
    rows = _rows(vecs, id_col, vec_col)
    n = rows.count()
    x = np.array([r.vec for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()])
    if len(x) < 3:
        return params
    near = np.stack([np.sort(np.sqrt(((x - v) ** 2).sum(axis=1)))[1 : FITTED + 1] for v in x[:: max(1, len(x) // 500)]])
    # a neighbour that is as near as a copy has no place in a power law
    typical = np.maximum(np.quantile(near, 0.75, axis=0), 1e-9)
    b, a = np.polyfit(np.log(np.arange(1, near.shape[1] + 1)), np.log(typical), 1) if near.shape[1] > 1 else (0.0, np.log(typical[0]))
    far = float(np.exp(a + max(b, 0.0) * np.log(k * len(x) / n)))
    low, high = far * 1e-3, far * 1e3
    for _ in range(40):  # recall grows with the width
        middle = np.sqrt(low * high)
        low, high = (low, middle) if recall_table(replace(params, W=middle), probes, steps=1, low=far, high=2 * far)[-1, 0] >= target else (middle, high)
    return replace(params, W=float(high))

"""Exact similarity search over vector tables: k nearest, range, candidates, and scoring of results.

A search compares a stated query set with all rows. Queries of at most BROADCAST_VALUES numbers, which are counted first,
are sent to every task, and the table is streamed past them without a shuffle. For more, rows and queries are packed into
blocks of bounded size, and a table block is sent to each query block. Distances are computed on arrays, and only the
best k of each query leave a task. The final ranking is a window whose limit Spark pushes below the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tessella.functions.distances import BLOCK_DISTANCES, distance
from tessella.session import materialize, ship

TABLE_BLOCK, QUERY_BLOCK = 8192, 512
#: Numbers of a query set that is broadcast (32 MB), and found rows that a task holds before it reduces them.
BROADCAST_VALUES, HELD = 1 << 22, 1 << 20
DECIMALS = 6


def ranked(hits: DataFrame, k: int | None, by: list[str] | None = None) -> DataFrame:
    """hits (query_id, id, dist) with rank by (dist, id), the first k of each query if k is given."""
    w = Window.partitionBy(*(by or ["query_id"])).orderBy("dist", "id")
    out = hits.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def _blocks(rows: DataFrame, id_col: str, vec_col: str, size: int, prefix: str) -> tuple[DataFrame, int]:
    """Rows packed into blocks of about ``size`` vectors each."""
    n = max(1, -(-rows.count() // size))
    packed = rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    block = packed.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(f"{prefix}_block")).agg(F.collect_list("id").alias(f"{prefix}_ids"), F.flatten(F.collect_list("vec")).alias(f"{prefix}_vecs"))
    return block, n


def _first_k(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least entries of each row of d, ties by id."""
    k = min(k, d.shape[1])
    kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    r, c = np.nonzero(d <= kth)
    order = np.lexsort((ids[c], d[r, c], r))
    r, c = r[order], c[order]
    begins = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    best = np.arange(len(r)) - np.repeat(begins, np.diff(np.append(begins, len(r)))) < k
    return r[best], c[best]


def _stream_past(table: DataFrame, asked: list, dist: str, k: int | None, limit: float | None, id_col: str, vec_col: str, key: str | None = None) -> DataFrame:
    """The table's batches against a broadcast query set, rows (id, vector), or (id, vector, key) where only rows with a query's key count."""
    ids = np.array([r[0] for r in asked], np.int64)
    sc = table.sparkSession.sparkContext
    held = sc.broadcast((ids, np.array([r[1] for r in asked], np.float64).reshape(len(asked), -1) if asked else np.zeros((0, 1))))
    between = BLOCK_DISTANCES[dist]
    keys: dict = {}
    for place, row in enumerate(asked if key else []):
        keys.setdefault(row[2], []).append(place)
    same = sc.broadcast({v: np.array(places) for v, places in keys.items()})

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
        """Queries and the rows of a batch that they are compared with."""
        if key is None:
            yield np.arange(len(held.value[0])), batch
            return
        found = batch.column(2).dictionary_encode()
        for code, value in enumerate(found.dictionary.to_pylist()):
            if value in same.value:
                yield same.value[value], batch.filter(pc.equal(found.indices, code))

    def least(q: np.ndarray, i: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first k rows of each query."""
        order = np.lexsort((i, d, q))
        q, i, d = q[order], i[order], d[order]
        begins = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        keep = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q)))) < k
        return q[keep], i[keep], d[keep]

    def batch_of(q: np.ndarray, i: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.value[0][q]), pa.array(i), pa.array(d)], names=["query_id", "id", "dist"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qv, best = held.value[1], []
        for whole in batches:
            for asked_here, batch in groups(whole) if len(whole) else ():
                ti, tv = batch.column(0).to_numpy(), np.array(batch.column(1).flatten()).reshape(len(batch), -1)
                step = max(1, (4 << 20) // max(1, tv.size))
                for at in range(0, len(asked_here), step):
                    some = asked_here[at : at + step]
                    d = np.round(between(qv[some], tv), DECIMALS)
                    r, c = _first_k(d, ti, k) if k is not None else np.nonzero(d < limit)
                    if k is None:
                        yield batch_of(some[r], ti[c], d[r, c])
                    else:
                        best.append((some[r], ti[c], d[r, c]))
            if sum(len(b[0]) for b in best) > HELD:
                best = [least(*map(np.concatenate, zip(*best, strict=True)))]
        if best:
            yield batch_of(*least(*map(np.concatenate, zip(*best, strict=True))))

    chosen = table.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>"), *([key] if key else []))
    return chosen.mapInArrow(run, "query_id long, id long, dist double")


def _scan(table: DataFrame, queries: DataFrame, dist: str, k: int | None, limit: float | None, id_col: str, vec_col: str) -> DataFrame:
    ship(table.sparkSession)
    present = queries.where(F.col(vec_col).isNotNull())
    values = present.agg(F.sum(F.size(vec_col))).first()[0] or 0
    if values <= BROADCAST_VALUES:
        return _stream_past(table, present.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).collect(), dist, k, limit, id_col, vec_col)
    q, nq = _blocks(queries, id_col, vec_col, QUERY_BLOCK, "q")
    t, _ = _blocks(table, id_col, vec_col, TABLE_BLOCK, "t")
    pairs = t.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).join(q, F.col("to") == F.col("q_block"))
    between = BLOCK_DISTANCES[dist]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                qi, ti = (np.array(batch.column(c)[i].values) for c in ("q_ids", "t_ids"))
                qv, tv = (np.array(batch.column(c)[i].values).reshape(len(x), -1) for c, x in (("q_vecs", qi), ("t_vecs", ti)))
                step = max(1, (4 << 20) // max(1, tv.size))
                for at in range(0, len(qi), step):
                    d = np.round(between(qv[at : at + step], tv), DECIMALS)
                    if k is not None:
                        r, c = _first_k(d, ti, k)
                    else:
                        r, c = np.nonzero(d < limit)
                    yield pa.RecordBatch.from_arrays([pa.array(qi[at : at + step][r], pa.int64()), pa.array(ti[c], pa.int64()), pa.array(d[r, c], pa.float64())], names=["query_id", "id", "dist"])

    return pairs.select("q_ids", "q_vecs", "t_ids", "t_vecs").mapInArrow(run, "query_id long, id long, dist double")


def knn(table: DataFrame, queries: DataFrame, k: int, dist: str = "L2_float", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, dist, rank): the k nearest rows of each query, by (dist, id)."""
    return ranked(_scan(table, queries, dist, k, None, id_col, vec_col), k)


def range_search(table: DataFrame, queries: DataFrame, limit: float, dist: str = "L2_float", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, dist) of all rows with a distance strictly below the limit."""
    return _scan(table, queries, dist, None, limit, id_col, vec_col)


def candidate_distances(candidates: DataFrame, table: DataFrame, queries: DataFrame, dist: str = "L2_float", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, dist) for given pairs (query_id, id); ids that aren't in the table are dropped. Equi-joins only."""
    pairs = candidates.select("query_id", "id").distinct()
    t = table.select(F.col(id_col).alias("t_id"), F.col(vec_col).alias("t_vec"))
    q = queries.select(F.col(id_col).alias("q_id"), F.col(vec_col).alias("q_vec"))
    joined = pairs.join(t, F.col("id") == F.col("t_id")).join(q, F.col("query_id") == F.col("q_id"))
    return joined.select("query_id", "id", F.round(distance(dist)(F.col("q_vec"), F.col("t_vec")), DECIMALS).alias("dist"))


def rerank(candidates: DataFrame, table: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """The k nearest of each query's candidates."""
    return ranked(candidate_distances(candidates, table, queries, **options), k)


def range_in_candidates(candidates: DataFrame, table: DataFrame, queries: DataFrame, limit: float, **options) -> DataFrame:
    return candidate_distances(candidates, table, queries, **options).where(F.col("dist") < limit)


def _same_key(table: DataFrame, queries: DataFrame, key: str, dist: str, k: int | None, limit: float | None, id_col: str, vec_col: str) -> DataFrame:
    """(query_id, id, dist) where a query's candidates are the rows with its key, in passes of at most BROADCAST_VALUES numbers of queries. No pair leaves its task but a query's results, and a frequent key is no task of its own."""
    ship(table.sparkSession)
    rows, asked = (df.where(F.col(key).isNotNull()) for df in (table, queries))
    asked = asked.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>"), key)
    passes = max(1, -(-(asked.agg(F.sum(F.size(vec_col) + 1)).first()[0] or 0) // BROADCAST_VALUES))
    near = lambda i: _stream_past(rows, asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i).collect(), dist, k, limit, id_col, vec_col, key)
    return near(0) if passes == 1 else reduce(DataFrame.unionByName, [materialize(near(i), "same-key") for i in range(passes)])


def rerank_same(table: DataFrame, queries: DataFrame, key: str, k: int, dist: str = "L2_float", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """rerank() where a query's candidates are the rows with its key."""
    return ranked(_same_key(table, queries, key, dist, k, None, id_col, vec_col), k)


def range_same(table: DataFrame, queries: DataFrame, key: str, limit: float, dist: str = "L2_float", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """range_in_candidates() where a query's candidates are the rows with its key."""
    return _same_key(table, queries, key, dist, None, limit, id_col, vec_col)


def merge_candidates(hits: DataFrame, vecs: DataFrame) -> DataFrame:
    """Hits on regions (query_id, id) to the distinct objects they belong to (query_id, vecset_id)."""
    return hits.select("query_id", "id").join(vecs.select(F.col("vec_id").alias("v"), "vecset_id"), F.col("id") == F.col("v")).select("query_id", "vecset_id").distinct()


def first_candidates(hits: DataFrame, vecs: DataFrame, n: int) -> DataFrame:
    """The n objects (query_id, vecset_id) of each query that most of its hits on regions (query_id, id) belong to, ties by id."""
    counted = hits.select("query_id", "id").join(vecs.select(F.col("vec_id").alias("v"), "vecset_id"), F.col("id") == F.col("v")).groupBy("query_id", "vecset_id").count()
    w = Window.partitionBy("query_id").orderBy(F.col("count").desc(), "vecset_id")
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("query_id", "vecset_id")


def top_k(rows: DataFrame, key: str, k: int, id_col: str, largest: bool = False, unique: bool = False) -> DataFrame:
    """The k rows with the smallest (largest) key, ties by id; with unique one row for each id, the best one. A bounded heap in each task, then one merge."""
    if unique:
        best = (F.max if largest else F.min)(key).alias(key)
        rows = rows.groupBy(id_col).agg(best)
    return rows.orderBy(F.col(key).desc() if largest else F.col(key).asc(), F.col(id_col)).limit(k)


def recall_at_k(truth: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of the k true neighbours that the first k results have."""
    t = truth.where(F.col("rank") <= k).select(F.col("query_id").alias("tq"), F.col("id").alias("ti"))
    r = results.where(F.col("rank") <= k).select("query_id", "id")
    joined = t.join(r, (F.col("tq") == F.col("query_id")) & (F.col("ti") == F.col("id")), "left")
    return joined.groupBy(F.col("tq").alias("query_id")).agg((F.count("id") / F.lit(k)).alias("recall"))


def precision_at_k(truth: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """(query_id, precision): mean over the first k true neighbours of (place in truth) / (place in results), 0 if absent."""
    t = truth.where(F.col("rank") <= k).select(F.col("query_id").alias("tq"), F.col("id").alias("ti"), F.col("rank").alias("tr"))
    r = results.where(F.col("rank") <= k).select("query_id", "id", "rank")
    joined = t.join(r, (F.col("tq") == F.col("query_id")) & (F.col("ti") == F.col("id")), "left")
    return joined.groupBy(F.col("tq").alias("query_id")).agg((F.sum(F.coalesce(F.col("tr") / F.col("rank"), F.lit(0.0))) / F.lit(k)).alias("precision"))


def map_names(hits: DataFrame, objects: DataFrame, id_col: str = "id") -> DataFrame:
    """hits with the name of each id, by equi-join; Spark broadcasts the names only while their measured size is small."""
    return hits.join(objects.select(F.col("vecset_id").alias("o_id"), "name"), F.col(id_col) == F.col("o_id"), "left").drop("o_id")


def ids_of(objects: DataFrame, names: DataFrame) -> DataFrame:
    """(name, vecset_id) for the given names."""
    return names.select("name").distinct().join(objects.select("vecset_id", "name"), "name", "inner")


def result_lines(hits: DataFrame, name_col: str = "name") -> DataFrame:
    """One text line for each query: its results as name:dist in order, then the query."""
    entry = F.concat(F.col(name_col), F.lit(":"), F.format_string("%.6f", F.col("dist")))
    ordered = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))).alias("es"))
    return ordered.select("query_id", F.concat(F.array_join(F.transform("es", lambda e: e["e"]), "\t"), F.lit("\t\t"), F.col("query_id").cast("string")).alias("line"))


def sample_percent(rows: DataFrame, percent: int, id_col: str, seed: int = 0) -> DataFrame:
    """Keeps a row iff a number of 0..99 drawn from its id is at most percent: 100 keeps all, 0 about one in a hundred."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")), 1, 15), 16, 10).cast("long") % 100
    return rows.where(drawn <= percent)


def nearest_parent(vecs: DataFrame, starts: DataFrame) -> DataFrame:
    """(vec_id, vecset_id) by the ranges [start_vecid, start_vecid + num_regions) of the objects, as an equi-join on the ids of the ranges."""
    spread = starts.select("vecset_id", F.explode(F.sequence(F.col("start_vecid"), F.col("start_vecid") + F.col("num_regions") - 1)).alias("vec_id"))
    return vecs.select("vec_id").join(spread, "vec_id")


def bitmap_of(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """A set of ids as bitmaps: (bucket, bitmap) over ranges of the id."""
    return ids.groupBy(F.bitmap_bucket_number(F.col(id_col)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(id_col))).alias("bitmap"))


def bitmap_union(*bitmaps: DataFrame) -> DataFrame:
    """Union of bitmaps."""
    every = bitmaps[0]
    for b in bitmaps[1:]:
        every = every.unionByName(b)
    return every.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_count(bitmap: DataFrame) -> DataFrame:
    """Number of ids, one row."""
    return bitmap.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("ids"))


def bitmap_contains(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows whose id is in the set."""
    return rows.join(ids.select(F.col(id_col).alias("_in")).distinct(), F.col(id_col) == F.col("_in"), "left_semi")


def append_vecs(base: DataFrame, more: DataFrame, base_count: int, transform: Column | None = None) -> DataFrame:
    """Bag union of vector tables with the ids of the second after those of the first; transform, if given, changes its features."""
    moved = more.withColumn("vec_id", F.col("vec_id") + F.lit(base_count)).withColumn("vecset_id", F.col("vecset_id") + F.lit(base_count))
    if transform is not None:
        moved = moved.withColumn("features", transform)
    return base.unionByName(moved)

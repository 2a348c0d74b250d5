"""Distances between weighted sets of vectors (objects of several regions), and ranking by them."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tessella.functions.distances import BLOCK_DISTANCES, distance
from tessella.functions.transport import LAST_ROUNDS, LAST_SOFTNESS, UNCOMPARED, assign, dual, emd, myemd, relaxed
from tessella.session import materialize, ship

from .search import BROADCAST_VALUES, DECIMALS, ranked

#: Set distances that the transport bounds hold for; pairs whose dual prices are found at once, where no limit is known yet and else; fewest that get the finest prices; rounding that bounds allow for.
BOUNDED, FIRST_PAIRS, PAIRS, LEFT, ROUNDING = ("emd", "myemd"), 16, 256, 4, 1e-7
#: Fewest queries of a task that shares them with others, and tasks for each core.
SHARE, TASKS = 64, 4
#: Objects of a block and queries that one-sided transport is bounded for at once; the square of a distance that none is nearest at, and the largest features whose squares are far below it.
OBJECTS, ABREAST, FAR_OFF, LARGE = 1024, 8, 1e30, 1e12
#: A broadcast pair of ids takes the memory of so many numbers.
PAIR_VALUES = 6

SetDistance = Callable[[np.ndarray, np.ndarray, np.ndarray], float]

#: From weights, weights and the matrix of vector distances to a number.
SET_DISTANCES: dict[str, SetDistance] = {
    "trivial": lambda a, b, c: 0.0,
    "single": lambda a, b, c: float(c[0, 0]),
    "emd": emd,
    "myemd": myemd,
    "assign": lambda a, b, c: assign(c)[0] if c.shape[0] == c.shape[1] else UNCOMPARED,
}


def register_set_distance(name: str, function: SetDistance) -> None:
    if name in SET_DISTANCES:
        raise ValueError(f"there is a set distance named {name}")
    SET_DISTANCES[name] = function


def as_sets(vecs: DataFrame, *keys: str) -> DataFrame:
    """(vecset_id, vecs array<struct<vec_id, weight, features>>) from vecs; regions in the order of their ids. A set is one object, of at most a few hundred regions. Keys are columns that vecset_id determines; rows that are dealt by them aren't shuffled again."""
    return vecs.groupBy("vecset_id", *keys).agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("weight").cast("double").alias("weight"), F.col("features").cast("array<double>").alias("features")))).alias("vecs"))


def unpacked(sets: DataFrame) -> DataFrame:
    """The vecs that as_sets() packed. No shuffle."""
    return sets.select("vecset_id", F.explode("vecs").alias("v")).select("v.vec_id", "vecset_id", "v.weight", "v.features")


def normalised(vecs: DataFrame) -> DataFrame:
    """vecs with weights that sum to 1 in each object."""
    sums = vecs.groupBy("vecset_id").agg(F.sum("weight").alias("_sum"))
    return vecs.join(sums, "vecset_id").withColumn("weight", F.col("weight") / F.col("_sum")).drop("_sum")


def single_distance(a: Column, b: Column, dist: str = "L2_float") -> Column:
    """Distance of the first vectors of two sets, inside the JVM."""
    return distance(dist)(F.element_at(a, 1)["features"], F.element_at(b, 1)["features"])


def set_distances(pairs: DataFrame, sets: DataFrame, set_dist: str = "emd", vec_dist: str = "L2_float", queries: DataFrame | None = None, decimals: int = DECIMALS, broadcast: bool = False) -> DataFrame:
    """(query_id, id, dist) for pairs (query_id, id) of objects; both sides are joined by their ids, the distance is computed on arrays. With broadcast, pairs and queries are sent to every task and the sets are streamed past them."""
    ship(pairs.sparkSession)
    left = (queries if queries is not None else sets).select(F.col("vecset_id").alias("q"), F.col("vecs").alias("a"))
    right = sets.select(F.col("vecset_id").alias("t"), F.col("vecs").alias("b"))
    # ids meet their sets first: the queries' sets are few and often broadcast, and then no set is shuffled with a pair
    pairs = pairs.select("query_id", "id").distinct()
    if broadcast:
        pairs, left = F.broadcast(pairs), F.broadcast(left)
    rows = pairs.join(right, F.col("id") == F.col("t")).join(left, F.col("query_id") == F.col("q"))
    rows = rows.select("query_id", "id", *[F.expr(f"transform({s}, x -> x.weight)").alias(f"{s}w") for s in "ab"], *[F.expr(f"flatten(transform({s}, x -> x.features))").alias(f"{s}f") for s in "ab"])
    between, whole = BLOCK_DISTANCES[vec_dist], SET_DISTANCES[set_dist]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                aw, bw, af, bf = (np.array(batch.column(c)[i].values) for c in ("aw", "bw", "af", "bf"))
                out.append(round(float(whole(aw, bw, between(af.reshape(len(aw), -1), bf.reshape(len(bw), -1)))), decimals))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(out, pa.float64())], names=["query_id", "id", "dist"])

    return rows.mapInArrow(run, "query_id long, id long, dist double")


def rank_sets(candidates: DataFrame, sets: DataFrame, k: int, queries: DataFrame | None = None, **options) -> DataFrame:
    """The k nearest objects of each query among its candidates; pairs that a distance refuses to compare come never.

    With the queries' sets given, these and the candidates are broadcast, in passes of at most BROADCAST_VALUES numbers,
    and the sets are streamed past them: no set is shuffled. All three are read for each pass, so they should be tables.
    """

    def near(pairs: DataFrame, asked: DataFrame | None) -> DataFrame:
        return ranked(set_distances(pairs, sets, queries=asked, broadcast=asked is not None, **options).where(F.col("dist") < UNCOMPARED), k)

    if queries is None:
        return near(candidates, None)
    values = queries.agg(F.sum(F.expr("aggregate(vecs, 0L, (n, x) -> n + size(x.features) + 2)"))).first()[0] or 0
    passes = -(-(values + PAIR_VALUES * candidates.count()) // BROADCAST_VALUES)
    if passes <= 1:
        return near(candidates, queries)
    of = lambda df, c, i: df.where(F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(passes)) == i)
    return reduce(DataFrame.unionByName, [materialize(near(of(candidates, "query_id", i), of(queries, "vecset_id", i)), "ranked") for i in range(passes)])


class _Query:
    """A query set, its k nearest objects so far and the distance beyond which none is wanted."""

    def __init__(self, number: int, weights: np.ndarray, features: np.ndarray, limit: float, k: int, decimals: int) -> None:
        self.number, self.weights, self.features, self.reach = number, weights, features, float(np.sqrt((features**2).sum(axis=1).max()))
        self.k, self.decimals, self.limit, self.best, self.seen, self.solved = k, decimals, limit, [], 0, 0

    @property
    def far(self) -> float:
        """A bound above it can't be one of the k nearest."""
        return min(self.limit, self.best[-1][0] if len(self.best) == self.k else np.inf) + 10.0**-self.decimals

    def add(self, distance: float, number: int) -> None:
        self.solved += 1
        distance = round(distance, self.decimals)
        if distance < UNCOMPARED:
            insort(self.best, (distance, number))
            del self.best[self.k :]


class _Batch:
    """Objects of a batch: numbers, numbers of regions, and all regions' weights and features."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.numbers, self.sizes = batch.column("id").to_numpy(), np.diff(np.asarray(batch.column("w").offsets))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.weights, features = (np.array(batch.column(c).flatten()) for c in "wf")
        self.features = features.reshape(len(self.weights), -1)

    def side_by_side(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights (m, objects) and features (m, objects, d) of some objects up to the most regions; padding has no weight."""
        place = np.arange(self.sizes[rows].max())[:, None]
        there = place < self.sizes[rows]
        at = np.where(there, self.begins[rows] + place, self.begins[rows])
        return np.where(there, self.weights[at], 0.0), self.features[at]

    def blocks(self) -> Iterator[np.ndarray]:
        """Rows of some OBJECTS objects of about as many regions."""
        order = np.argsort(self.sizes, kind="stable")
        for at in range(0, len(order), OBJECTS):
            yield order[at : at + OBJECTS]


def _squares(features: np.ndarray, weights: np.ndarray, kind: type) -> np.ndarray:
    """(m, d + 2, objects) of features (m, objects, d): a product with (-2 x, 1, |x|^2) is the square of a distance. Regions without weight are far from all."""
    norms = np.where(weights > 0, (features**2).sum(axis=2), FAR_OFF)
    return np.concatenate((features.transpose(0, 2, 1), norms[:, None], np.ones_like(norms)[:, None]), axis=1).astype(kind)


def _beside(features: np.ndarray, kind: type) -> np.ndarray:
    """The other side of the product."""
    return np.concatenate((-2 * features, np.ones((len(features), 1)), (features**2).sum(axis=1)[:, None]), axis=1).astype(kind)


def nearest_sets(sets: DataFrame, queries: DataFrame, k: int, limits: DataFrame | None = None, set_dist: str = "emd", vec_dist: str = "L2_float", decimals: int = DECIMALS, work: bool = False, likely: bool = False) -> DataFrame:
    """(query_id, id, dist, rank): the k nearest objects of each query among all, without a miss.

    Every object is bounded from below, first by one-sided transport, from the least cost of each region, and where that
    allows it by dual prices, coarse, fine and at last finer ones. Objects of a batch are solved exactly in the order of their bounds until the bound is beyond
    the k-th exact distance of the query, or beyond its limit in ``limits`` (query_id, far), where far is at least the
    k-th distance, say that of k candidates of another search.

    Query sets are broadcast in passes of at most BROADCAST_VALUES numbers and the objects streamed past them; only the k
    nearest of each query leave a task. Where the objects are few tasks, a pass's queries are shared out, too, SHARE or more to a task. With ``work`` the result is (query_id, seen, solved) instead: the pairs of each
    query and those that were solved exactly. With ``likely`` nothing is solved, dist is the dual bound, and these are k
    objects that are likely near: those with the least dual bounds of the k of each batch that come first by one-sided transport.
    """
    if set_dist not in BOUNDED:
        raise ValueError(f"bounds are known for {BOUNDED} only")
    ship(sets.sparkSession)
    asked = queries.select(F.col("vecset_id").cast("long").alias("query_id"), F.expr("transform(vecs, x -> x.weight)").alias("w"), F.expr("flatten(transform(vecs, x -> x.features))").alias("f"))
    asked = asked.withColumn("far", F.lit(float("inf"))) if limits is None else asked.join(limits.select("query_id", F.col("far").cast("double")), "query_id", "left")
    rows = sets.select(F.col("vecset_id").cast("long").alias("id"), F.expr("transform(vecs, x -> x.weight)").alias("w"), F.expr("flatten(transform(vecs, x -> x.features))").alias("f")).where("size(w) > 0")
    values = asked.agg(F.sum(F.size("w") + F.size("f"))).first()[0] or 0
    passes = max(1, -(-values // BROADCAST_VALUES))
    sc = sets.sparkSession.sparkContext
    wanted = -(-TASKS * sc.defaultParallelism // max(1, rows.rdd.getNumPartitions() * passes))
    between, whole = BLOCK_DISTANCES[vec_dist], SET_DISTANCES[set_dist]

    def shared(part: DataFrame) -> list[DataFrame]:
        those = [(r.query_id, np.array(r.w), np.array(r.f).reshape(len(r.w), -1), np.inf if r.far is None else r.far) for r in part.where("size(w) > 0").collect()]
        shares = max(1, min(wanted, len(those) // SHARE))
        return [near(those[i::shares]) for i in range(shares)]

    def near(those: list[tuple[int, np.ndarray, np.ndarray, float]]) -> DataFrame:
        held = sc.broadcast(those)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [_Query(*q, k, decimals) for q in held.value]
            for batch in batches:
                if not len(batch) or not found:
                    continue
                objects = _Batch(batch)
                # distances don't change where all features are moved; about the middle they are rounded least
                middle = objects.features.mean(axis=0) if vec_dist == "L2_float" else 0.0
                reach = float(np.sqrt(((objects.features - middle) ** 2).sum(axis=1).max()))
                blocks = []
                for some in objects.blocks():
                    weights, features = objects.side_by_side(some)
                    blocks.append((some, weights, features - middle))
                for at in range(0, len(found), ABREAST):
                    group = found[at : at + ABREAST]
                    bounds = np.empty((len(group), len(batch)))
                    far = max(reach, *(float(np.sqrt(((q.features - middle) ** 2).sum(axis=1).max())) for q in group))
                    kind = np.float32 if far < LARGE else np.float64
                    if at == 0 or kind != held_kind:
                        held_kind, made = kind, [_squares(f, w, kind) if vec_dist == "L2_float" else None for _, w, f in blocks]
                    for block, squares in zip(blocks, made, strict=True):
                        bounds[:, block[0]] = first_bounds(group, block[1], block[2], squares, middle, far)
                    for q, bound in zip(group, bounds, strict=True):
                        look(q, objects, bound, middle)
            if work:
                out = [(q.number, q.seen, q.solved) for q in found]
            else:
                out = [(q.number, i, d) for q in found for d, i in q.best]
            if out:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True))), names=names)

        return rows.mapInArrow(run, "query_id long, seen long, solved long" if work else "query_id long, id long, dist double")

    def first_bounds(group: list[_Query], weights: np.ndarray, features: np.ndarray, squares: np.ndarray | None, middle: np.ndarray, far: float) -> np.ndarray:
        """One-sided transport of several queries and a block of objects (queries, objects). Regions without weight cost nothing and are no one's nearest."""
        out = np.zeros((len(group), weights.shape[1]))
        own = [q.features[q.weights > 0] for q in group]
        ends = np.cumsum([len(x) for x in own])
        if squares is not None:
            x = _beside(np.concatenate(own) - middle, squares.dtype.type)
            least, cost = np.full((len(x), weights.shape[1]), FAR_OFF, squares.dtype), np.empty((len(x), weights.shape[1]), squares.dtype)
            # what rounding may add to a square
            off, loss = 4 * (features.shape[2] + 8) * np.finfo(squares.dtype).eps * far**2, 1 - 4 * (len(weights) + 8) * np.finfo(squares.dtype).eps
        else:
            x, off, loss = np.concatenate(own), 0.0, 1.0
            least = np.full((len(x), weights.shape[1]), UNCOMPARED)
        back = np.full((len(weights), len(group), weights.shape[1]), UNCOMPARED, least.dtype)
        for j in range(len(weights)):
            if squares is not None:
                np.matmul(x, squares[j], out=cost)
            else:
                cost = np.where(weights[j] > 0, between(x, features[j]), UNCOMPARED)
            np.minimum(least, cost, out=least)
            for i, (part, end) in enumerate(zip(own, ends, strict=True)):
                if len(part):
                    cost[end - len(part) : end].min(axis=0, out=back[j, i])
        if squares is not None:
            least, back = np.sqrt(np.maximum(least - off, 0)), np.sqrt(np.maximum(back - off, 0))
        for i, (q, part, end) in enumerate(zip(group, own, ends, strict=True)):
            if len(part):
                out[i] = loss * relaxed(q.weights[q.weights > 0], weights.T, least[end - len(part) : end].T, back[:, i].T) - ROUNDING * (1 + q.reach + far)
        return out

    def costs(q: _Query, features: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """Costs (n, m, objects) of a query's and objects' regions, for L2 a little below them."""
        flat = features.reshape(-1, features.shape[2])
        if vec_dist == "L2_float":
            x, y = q.features - middle, flat - middle
            a, b = (x**2).sum(axis=1), (y**2).sum(axis=1)
            cost = (-2 * x) @ y.T
            cost += a[:, None]
            cost += b - 4 * (x.shape[1] + 8) * np.finfo(float).eps * (a.max() + b.max())
            cost = np.sqrt(np.maximum(cost, 0, out=cost), out=cost)
        else:
            cost = between(q.features, flat)
        return cost.reshape(len(q.weights), *features.shape[:2])

    def look(q: _Query, objects: _Batch, bound: np.ndarray, middle: np.ndarray) -> None:
        q.seen += len(bound)
        left = np.flatnonzero(bound <= q.far)
        if likely and len(left) > k:
            left = left[np.argpartition(bound[left], k)[:k]]
        left = left[np.argsort(bound[left], kind="stable")]
        at = 0
        while at < len(left) and bound[left[at]] <= q.far:
            block = left[at : at + (PAIRS if at or likely or q.far < np.inf else FIRST_PAIRS)]
            at += len(block)
            weights, features = objects.side_by_side(block)
            weights, cost = weights.T, costs(q, features, middle).transpose(2, 0, 1)
            slack = ROUNDING * (1 + np.abs(cost).max())
            low = dual(q.weights, weights, cost, 0) - slack
            near = np.flatnonzero(low <= q.far)
            if len(near):
                low[near] = np.maximum(low[near], dual(q.weights, weights[near], cost[near]) - slack)
            near = np.flatnonzero(low <= q.far)
            if len(near) >= LEFT and not likely:
                low[near] = np.maximum(low[near], dual(q.weights, weights[near], cost[near], LAST_ROUNDS, LAST_SOFTNESS) - slack)
            for i in np.argsort(low, kind="stable").tolist():
                if low[i] > q.far:
                    break
                if likely:
                    q.add(float(low[i]), int(objects.numbers[block[i]]))
                    continue
                own = slice(objects.begins[block[i]], objects.begins[block[i]] + objects.sizes[block[i]])
                q.add(float(whole(q.weights, objects.weights[own], between(q.features, objects.features[own]))), int(objects.numbers[block[i]]))

    names = ["query_id", "seen", "solved"] if work else ["query_id", "id", "dist"]
    of = lambda i: asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
    parts = reduce(DataFrame.unionByName, [share for i in range(passes) for share in shared(of(i))])
    if work:
        return parts.groupBy("query_id").agg(F.sum("seen").alias("seen"), F.sum("solved").alias("solved"))
    return ranked(parts, k)

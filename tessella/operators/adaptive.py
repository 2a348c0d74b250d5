"""Index searches that look at what they have found: stopping by an estimate of the data's local dimension, and probing the tables that find most.

Both run in rounds over a batch index. A round is a join of the queries that still search with the buckets that they ask
for next; between rounds each query has a row for each of its k best, and its state.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tessella.session import materialize

from .batch import BatchIndex, batch_knn
from .lsh import LshParams, recall_table
from .search import ranked

#: Neighbours that the equations run over at most, and places of the tables of solutions: logarithms of the first neighbour's squared distance in units of the width, and exponents.
MOST, LOG_A, B = 1000, np.linspace(-12.0, 4.0, 33), np.linspace(0.02, 2.0, 23)
#: Logarithms of squared distances that probabilities are known at.
PLACES = np.linspace(-14.0, 14.0, 401)
#: Steps of the root finder, its residual, and the difference that slopes are taken over.
STEPS, RESIDUAL, NUDGE = 30, 1e-6, 1e-4


@lru_cache(maxsize=64)
def _chances(m: int, tables: int, probes: int) -> np.ndarray:
    """The probability that a search finds a vector, at PLACES of the logarithm of its squared distance in units of the width."""
    params = LshParams(D=1, M=m, L=tables, W=1.0)
    return np.array([recall_table(params, probes, steps=1, low=math.exp(p / 2), high=2 * math.exp(p / 2))[-1, 0] for p in PLACES])


def found_law(params: LshParams, k: int, log_alpha: np.ndarray, beta: np.ndarray, probes: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm and exponent of the law that a search sees whose n-th neighbour has the squared distance alpha n^beta, in units of the width.

    A neighbour at a distance is found with a probability, so the n-th is seen as the k(n)-th, the sum of the
    probabilities so far; the law seen is the line of log distance on log k(n), up to the k-th.
    """
    n = np.arange(1, MOST + 1)
    log_d = log_alpha[..., None] + beta[..., None] * np.log(n)
    seen = np.cumsum(np.interp(log_d, PLACES, _chances(params.M, params.L, probes)), axis=-1)
    weight = np.concatenate((np.ones((*seen.shape[:-1], 1), bool), seen[..., :-1] < k), axis=-1)
    x = np.where(weight, np.log(np.maximum(seen, 1e-300)), 0)
    y = np.where(weight, log_d, 0)
    m = weight.sum(axis=-1)
    sx, sy, sxx, sxy = x.sum(axis=-1), y.sum(axis=-1), (x * x).sum(axis=-1), (x * y).sum(axis=-1)
    slope = (m * sxy - sx * sy) / np.maximum(m * sxx - sx * sx, 1e-300)
    return (sy - slope * sx) / m, slope


@np.errstate(over="ignore", invalid="ignore", divide="ignore")
def true_law(params: LshParams, k: int, log_a: np.ndarray, b: np.ndarray, probes: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log alpha, beta, residual): the law whose search is seen as log_a, b, by damped Newton steps on all places at once. All in units of the width."""
    goal = np.stack((log_a.ravel(), b.ravel()))
    at = goal.copy()
    miss = lambda p, i: np.stack(found_law(params, k, p[0], p[1], probes)) - goal[:, i]
    error = miss(at, slice(None))
    left = np.arange(goal.shape[1])
    for _ in range(STEPS):
        left = left[np.abs(error[:, left]).max(axis=0) > RESIDUAL]
        if not len(left):
            break
        old, miss_old = at[:, left], error[:, left]
        by_a, by_b = ((miss(old + np.array(d).reshape(2, 1), left) - miss_old) / NUDGE for d in ((NUDGE, 0.0), (0.0, NUDGE)))
        det = by_a[0] * by_b[1] - by_b[0] * by_a[1]
        det = np.where(np.abs(det) < 1e-9, 1e-9, det)
        step = np.clip(np.stack((by_b[0] * miss_old[1] - by_b[1] * miss_old[0], by_a[1] * miss_old[0] - by_a[0] * miss_old[1])) / det, -1.0, 1.0)
        better = np.zeros(len(left), bool)
        for share in (1.0, 0.5, 0.125):  # shorter where the whole step doesn't help
            new = old + share * step
            new[0], new[1] = np.clip(new[0], -40.0, 40.0), np.clip(new[1], 1e-3, 10.0)
            new_error = miss(new, left)
            now = ~better & (np.abs(new_error).sum(axis=0) < np.abs(miss_old).sum(axis=0))
            at[:, left[now]], error[:, left[now]] = new[:, now], new_error[:, now]
            better |= now
            if better.all():
                break
        left = left[better]
    return at[0].reshape(b.shape), at[1].reshape(b.shape), np.abs(error).max(axis=0).reshape(b.shape)


def law_tables(params: LshParams, k: int, probes: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Tables (log alpha - log a, beta) over LOG_A and B, in units of the width; places that no law is seen at keep what is seen."""
    a, b = np.meshgrid(LOG_A, B, indexing="ij")
    log_alpha, beta, residual = true_law(params, k, a, b, probes)
    solved = residual < 1e-3
    return np.where(solved, log_alpha - a, 0.0), np.where(solved, beta, b)


def local_radius(tables: tuple[np.ndarray, np.ndarray], width: float, log_a: Column, b: Column, k: int, gamma: float) -> Column:
    """gamma times the distance at which the law seen as log_a, b has its k-th neighbour, by the nearest place of the tables."""

    def near(x: Column, places: np.ndarray) -> Column:
        step = places[1] - places[0]
        return F.least(F.lit(len(places) - 1), F.greatest(F.lit(0), F.round((x - F.lit(float(places[0]))) / F.lit(float(step))).cast("int")))

    at = near(log_a - 2 * math.log(width), LOG_A) * len(B) + near(b, B)
    shift, beta = (F.get(F.split(F.lit(",".join(f"{v:.9g}" for v in t.ravel())), ",").cast("array<double>"), at) for t in tables)
    return F.lit(gamma) * F.exp((log_a + shift + beta * math.log(k)) / 2)


def _merged(best: DataFrame | None, more: DataFrame, k: int) -> DataFrame:
    more = more.select("query_id", "id", "dist")
    return ranked((more if best is None else best.select("query_id", "id", "dist").unionByName(more)).distinct(), k)


def local_knn(index: BatchIndex, queries: DataFrame, k: int, gamma: float = 1.0, probes: int = 0, rounds: int = 4, id_col: str = "vec_id", vec_col: str = "embedding", work: bool = False) -> DataFrame:
    """(query_id, id, dist, rank) by rounds over parts of the tables, each of which a query leaves when its k-th distance is within its stop radius.

    The radius is gamma times the distance at which the k-th neighbour is expected. That comes from the power law of the
    distances found so far, one line fitted to each query's logarithms by Spark's regression functions, and from the law
    behind it, which law_tables() has once for all. With ``work`` the result is (query_id, pairs): rows of buckets looked at.
    """
    spread = np.array_split(np.arange(index.params.L), min(rounds, index.params.L))
    # what a part of the tables finds is seen with that part's probability
    best, pairs, open_ = None, [], queries
    for i, part in enumerate(spread):
        tables = [int(t) for t in part]
        pairs.append(materialize(batch_knn(index, open_, k, probes, tables, id_col, vec_col, work=True), "local-pairs") if work else None)
        best = materialize(_merged(best, batch_knn(index, open_, k, probes, tables, id_col, vec_col), k), "local-best")
        if i + 1 == len(spread):
            break
        from_tables = law_tables(_of(index.params, int(spread[i][-1]) + 1), k, probes)
        y, x = F.log(F.col("dist") * F.col("dist")), F.log(F.col("rank").cast("double"))
        kth = F.max(F.when(F.col("rank") == k, F.col("dist")))
        seen = best.groupBy("query_id").agg(kth.alias("kth"), F.regr_intercept(F.when(F.col("dist") > 0, y), x).alias("log_a"), F.regr_slope(F.when(F.col("dist") > 0, y), x).alias("b"))
        stop = local_radius(from_tables, index.params.W, F.col("log_a"), F.col("b"), k, gamma)
        settled = materialize(seen.where(F.col("kth").isNotNull() & (F.col("kth") <= stop)).select("query_id"), "local-settled")
        open_ = open_.join(settled, F.col(id_col) == F.col("query_id"), "left_anti")
    return reduce(DataFrame.unionByName, pairs).groupBy("query_id").agg(F.sum("pairs").alias("pairs")) if work else best


def _of(params: LshParams, tables: int) -> LshParams:
    """params with so many tables."""
    return LshParams(params.D, params.M, tables, params.W, params.H, params.seed)


def boosted_knn(index: BatchIndex, queries: DataFrame, k: int, probes: int, rounds: int = 2, id_col: str = "vec_id", vec_col: str = "embedding", work: bool = False) -> DataFrame:
    """(query_id, id, dist, rank): as many extra probes as ``probes`` for each table, given to the tables by what they have found for the query.

    First each table is asked for the query's own bucket. Then each of the rounds deals its share of the extra probes to
    the tables in proportion to how many of the query's k best so far each has found, and one; no known truth is needed.
    With ``work`` the result is (query_id, pairs) instead.
    """
    tables = index.params.L
    each = lambda v: F.array_repeat(F.lit(v), tables)
    asked, best, pairs = queries.withColumn("_from", each(0)).withColumn("_to", each(1)), None, []
    share = [tables * (probes * (r + 1) // rounds - probes * r // rounds) for r in range(rounds)]
    for r in range(rounds + 1):
        if work:
            pairs.append(materialize(batch_knn(index, asked, k, probes, None, id_col, vec_col, work=True, spans=("_from", "_to")), "boost-pairs"))
        found = batch_knn(index, asked, k, probes, None, id_col, vec_col, spans=("_from", "_to"), by_table=True).drop("rank")
        # of the best k ids, all tables that have found them
        found = found if best is None else found.unionByName(best).groupBy("query_id", "id", "dist").agg(F.array_distinct(F.flatten(F.collect_list("found_by"))).alias("found_by"))
        best = materialize(ranked(found, k).drop("rank"), "boost-best")
        if r == rounds:
            break
        by_table = best.select("query_id", F.explode("found_by").alias("table_no"))
        yields = by_table.groupBy(F.col("query_id").alias("y_id"), "table_no").count().groupBy("y_id").agg(F.map_from_entries(F.collect_list(F.struct("table_no", "count"))).alias("found"), F.sum("count").alias("all"))
        state = asked.join(yields, F.col(id_col) == F.col("y_id"), "left")
        # running floors of the shares, so that they sum to what is dealt
        upto = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.coalesce(F.try_element_at("found", t.cast("int")), F.lit(0).cast("long")) + 1)
        total = F.coalesce(F.col("all"), F.lit(0)) + tables
        sums = F.transform(F.sequence(F.lit(0), F.lit(tables)), lambda t: F.floor(F.aggregate(F.slice("_each", F.lit(1), t.cast("int")), F.lit(0).cast("long"), lambda x, y: x + y) * share[r] / F.col("_all")))
        state = state.withColumn("_each", upto).withColumn("_all", total).withColumn("_sums", sums)
        extra = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: (F.get("_sums", t.cast("int") + 1) - F.get("_sums", t.cast("int"))).cast("int"))
        asked = state.withColumn("_next", F.zip_with("_to", extra, lambda x, y: F.least(x + y, F.lit(probes * tables + 1)))).select(*queries.columns, F.col("_to").alias("_from"), F.col("_next").alias("_to"))
        asked = materialize(asked, "boost-asked")
    if work:
        return reduce(DataFrame.unionByName, pairs).groupBy("query_id").agg(F.sum("pairs").alias("pairs"))
    return ranked(best.select("query_id", "id", "dist"), k)

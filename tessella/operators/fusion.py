"""Results of several searches made one: AND, OR and VOTE over ranked lists, and the exact first k by a weighted sum of distances."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from tessella.functions.distances import distance
from tessella.session import materialize

from .search import DECIMALS, knn

METHODS = ("and", "or", "vote")


def fuse(results: Sequence[DataFrame], method: str, k: int | None = None, least_votes: int = 1) -> DataFrame:
    """(query_id, id, votes, score, rank) from lists (query_id, id, rank), each with an id once for a query.

    ``and`` keeps what all lists have, by the sum of its ranks; ``or`` what any list has, by its best rank; ``vote`` what
    least_votes lists or more have, by their number and then the sum of its ranks. Ties go by id. One shuffle, by query
    and id, with partial sums before it.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    lists = reduce(DataFrame.unionByName, [r.select("query_id", "id", F.col("rank").cast("long").alias("rank")) for r in results])
    score = F.min("rank") if method == "or" else F.sum("rank")
    found = lists.groupBy("query_id", "id").agg(F.count(F.lit(1)).cast("int").alias("votes"), score.alias("score"))
    if method != "or":
        found = found.where(F.col("votes") >= (len(results) if method == "and" else least_votes))
    order = [F.col("votes").desc()] if method == "vote" else []
    placed = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "score", "id")))
    return placed if k is None else placed.where(F.col("rank") <= k)


def threshold_knn(table: DataFrame, queries: DataFrame, k: int, weights: dict[str, float], depth: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k rows with the least weighted sum of distances, of all rows, by the threshold algorithm.

    Each distance gives each query a list of its first ``depth`` rows. All rows of the lists get all their distances. No
    other row has less than the sum of the lists' last distances, so a query whose k-th score is below that is done; the
    others take lists of twice the depth. Distances must not be weighted negatively.
    """
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    depth = depth or 2 * k
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("t_vec"))
    open_, done = queries.where(F.col(vec_col).isNotNull()), []
    left = open_.count()
    while left:
        lists = {d: materialize(knn(table, open_, depth, d, id_col, vec_col), "fusion-list") for d in weights}
        seen = reduce(DataFrame.union, [x.select("query_id", "id") for x in lists.values()]).distinct()
        asked = open_.select(F.col(id_col).cast("long").alias("q_id"), F.col(vec_col).alias("q_vec"))
        score = reduce(lambda a, b: a + b, [F.lit(w) * F.round(distance(d)(F.col("q_vec"), F.col("t_vec")), DECIMALS) for d, w in weights.items()])
        scored = seen.join(rows, "id").join(asked, F.col("query_id") == F.col("q_id")).select("query_id", "id", F.round(score, DECIMALS).alias("score"))
        best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)
        best = materialize(best, "fusion-best")
        # a list that is shorter than asked for has every row
        ends = reduce(DataFrame.unionByName, [x.groupBy("query_id").agg((F.lit(w) * F.max("dist")).alias("last"), F.count(F.lit(1)).alias("n")) for (d, x), w in zip(lists.items(), weights.values(), strict=True)])
        ends = ends.groupBy(F.col("query_id").alias("e_id")).agg(F.round(F.sum("last"), DECIMALS).alias("least"), F.min("n").alias("n"))
        kth = best.groupBy("query_id").agg(F.max("score").alias("kth"), F.count(F.lit(1)).alias("found"))
        settled = kth.join(ends, F.col("query_id") == F.col("e_id")).where((F.col("n") < depth) | ((F.col("found") == k) & (F.col("kth") < F.col("least")))).select(F.col("query_id").alias("s_id"))
        settled = materialize(settled, "fusion-settled")
        done.append(best.join(settled, F.col("query_id") == F.col("s_id"), "left_semi"))
        # queries without any row in a list have no result
        waiting = kth.select("query_id").join(settled, F.col("query_id") == F.col("s_id"), "left_anti")
        open_ = open_.join(waiting, F.col(id_col) == F.col("query_id"), "left_semi")
        left, depth = waiting.count(), 2 * depth
    return reduce(DataFrame.unionByName, done) if done else table.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")

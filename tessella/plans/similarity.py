"""Filter and refine: LSH candidates of each region, their distinct objects, exact set distance, top k; and what no filter may lose, by lower bounds."""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tessella.operators import lsh, search, sets
from tessella.session import materialize


#: Candidates for each result whose distances limit an exact search, those with the most regions in common.
SEEDS = 3


@dataclass(frozen=True)
class SimilarityPlan:
    """k results; the filter takes overfetch * k hits of each region from ``tables`` tables with ``probes`` more buckets each. With ``exact`` every other object is bounded from below and solved if its bound allows it to be nearer than the k-th; with ``by_bounds`` the bounds are the filter, too, and no hashing is done."""

    k: int = 10
    overfetch: int = 2
    tables: int | None = 8
    probes: int = 0
    set_dist: str = "emd"
    vec_dist: str = "L2_float"
    exact: bool = False
    by_bounds: bool = False


def similarity_search(vecs: DataFrame, query_sets: DataFrame, params: lsh.LshParams, plan: SimilarityPlan = SimilarityPlan(), index: DataFrame | None = None, packed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, dist, rank): for each object of query_sets (vecset_id) the nearest objects of vecs (vec_id, vecset_id, weight, features).

    ``packed`` is a table of vecs as as_sets() packs them; without it one is written.
    """
    packed = materialize(sets.as_sets(vecs), "sets") if packed is None else packed
    ids = query_sets.select("vecset_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= search.BROADCAST_VALUES else ids  # else all sets may be shuffled to find the few
    own = materialize(packed.join(ids, "vecset_id", "left_semi"), "asked")
    if plan.exact and plan.by_bounds:
        likely = sets.nearest_sets(packed, own, SEEDS * plan.k, set_dist=plan.set_dist, vec_dist=plan.vec_dist, likely=True)
        return _exact(materialize(likely.select("query_id", "id"), "candidates"), packed, own, plan)
    asked = sets.unpacked(own)
    hits = lsh.lsh_knn(vecs, asked, params, plan.overfetch * plan.k, plan.tables, plan.probes, index, "vec_id", "features")
    of_region = asked.select(F.col("vec_id").alias("region"), F.col("vecset_id").alias("object"))
    by_object = hits.join(of_region, F.col("query_id") == F.col("region")).select(F.col("object").alias("query_id"), "id")
    # candidates are counted and then read; they are written once
    objects = search.merge_candidates(by_object, vecs) if not plan.exact else search.first_candidates(by_object, vecs, SEEDS * plan.k)
    candidates = materialize(objects.select("query_id", F.col("vecset_id").alias("id")), "candidates")
    return _exact(candidates, packed, own, plan) if plan.exact else _near(candidates, packed, own, plan)


def _near(candidates: DataFrame, packed: DataFrame, own: DataFrame, plan: SimilarityPlan) -> DataFrame:
    return sets.rank_sets(candidates, packed, plan.k, queries=own, set_dist=plan.set_dist, vec_dist=plan.vec_dist)


def _exact(candidates: DataFrame, packed: DataFrame, own: DataFrame, plan: SimilarityPlan) -> DataFrame:
    """The k-th of the candidates limits the search of all: no object beyond it can be among the nearest."""
    limits = _near(candidates, packed, own, plan).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far")).where(F.col("n") == plan.k)
    return sets.nearest_sets(packed, own, plan.k, materialize(limits, "limits"), plan.set_dist, plan.vec_dist)

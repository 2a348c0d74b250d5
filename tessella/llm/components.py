"""Connected components by distributed union-find."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import materialize

#: Rounds after which something must be wrong: the depth of the forest at least halves each round.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node of an edge; root is the smallest node of its component.

    Alternating large-star and small-star rounds (union by the smallest label with path shortening): a large-star
    links each node's larger neighbours to its smallest one, a small-star its smaller neighbours. No step holds a
    neighbourhood in memory or collects nodes; each round is written to the shared folder. Hubs: the joins are on the
    node, whose minimum is pre-aggregated, and Spark splits the skewed side. Nulls and self-links are ignored.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} != {b}").distinct()
    links = materialize(links, "cc")
    for _ in range(MOST_ROUNDS):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small-star: every link points from the larger to the smaller node
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        wide = large.join(low.where("n > 1").select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = low.select("u", F.col("m").alias("v")).union(wide).distinct()
        small = materialize(small, "cc")
        # done when all are stars: each node has one root and no root has a root
        split = small.groupBy("u").count().where("count > 1").limit(1)
        chained = small.select(F.col("v").alias("u")).distinct().join(small.select("u"), "u", "left_semi").limit(1)
        links = small
        if split.isEmpty() and chained.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

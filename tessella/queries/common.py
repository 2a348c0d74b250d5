"""Registry and table helpers of the query modules."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as regions: four successive ids make an object, with weights 1, 2, 3 by id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.expr("vec_id div 4").alias("vecset_id"), (1 + F.col("vec_id") % 3).cast("double").alias("weight"), F.col("embedding").alias("features"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: ids divisible by 50."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")


def next_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with its successor: (vec_id, a, b)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("p"), F.col("embedding").alias("b")), F.col("vec_id") == F.col("p")).drop("p")


#: The same pairs in SQL.
PAIRS_SQL = "pairs AS (SELECT x.vec_id, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"
#: Lines of documents in SQL, as chunks.
LINES_SQL = """pieces AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id AS file_idx, unnest(range(len(ls))) AS l2, unnest(ls) AS line FROM pieces),
chunks AS (SELECT file_idx, l2, octet_length(encode(line)) AS n, sha1(line) AS sha1, line FROM lines)"""

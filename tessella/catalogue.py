"""All queries of the engine by name, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.queries import common, dedup, media, search, stats, streams  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(common.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(common.ORACLES)

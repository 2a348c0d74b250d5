"""Mixing sources to target weights.

Each row gets a hash-random key. Within its source the rows are dealt to ranges of that key (the key is uniform, so
the range bounds are known without sampling), sorted inside each range, and prefix sums of their sizes are made from
the sums of the ranges before and a running sum inside the range. The order is then cut at the source's budget; a
budget above the source's size repeats whole epochs first.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; repeated rows are rows
of their own; a source without words gets target 0; an empty table gives an empty result; other columns are ignored
or, if named in ``carry``, passed on unchanged.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .common import materialize, prepare, unclashed, word_count

#: Rows of a source that one range of keys holds on average.
ROWS_PER_RANGE = 2000


def hash_key(doc_id: Column, text: Column, seed: str) -> Column:
    """A uniform key of 60 bits; rows without an id are told apart by their texts."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Adds rank, weight and target to rows (source, source_size).

    The sources, by code point with null last, weigh ``cycle`` in turn and share all words; a target stops at ``most``
    times its source's size and the excess is shared again by weight until none is above. That is the level L with
    sum(min(cap, L * weight)) = all words, found from prefix sums in the order of cap / weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in cycle])
    ranked = (
        sources.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(weights, (F.col("rank") - 1) % len(cycle) + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * F.lit(most).cast("long"))
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    level = (
        ranked.withColumn("cap_before", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("weight_before", F.sum("weight").over(by_ratio) - F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", (F.col("total") - F.col("cap_before")).cast("double") / (F.col("weights") - F.col("weight_before")).cast("double"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight"))
    return level.select("source", "source_size", "n_rows", "rank", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", carry: list[str] | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, copies; with ``carry`` those columns as well, prefixed by ``c_``.

    taken is the number of words that the mix takes from the row, repeats counted; the row at the cut is taken in
    part, so a source's taken words sum to its rounded target. copies is the number of whole copies of a mix that
    doesn't cut rows: the row at the cut counts if at least half of it is before the cut.
    """
    prepare(docs.sparkSession)
    docs = unclashed(docs, id_col, text_col, source_col)

    def row(*more: Column) -> DataFrame:
        return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), hash_key(F.col(id_col), F.col(text_col), seed).alias("key"), word_count(F.col(text_col)).alias("size"), *more)

    narrow = materialize(row(), "mix-sizes")
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")), cycle, most)
    targets = targets.withColumn("ranges", F.ceil(F.col("n_rows") / F.lit(rows_per_range)).cast("long")).withColumnRenamed("source", "s_source").withColumn("budget", F.floor(F.col("target") + F.lit(0.5)).cast("long"))
    # the table of sources has a row for each source; Spark broadcasts it only while its measured size is below the session's threshold
    targets = materialize(targets, "mix-targets")

    def ranged(rows: DataFrame) -> DataFrame:
        joined = rows.join(targets, F.col("source").eqNullSafe(F.col("s_source")), "inner")
        return joined.withColumn("range", F.shiftright(F.shiftright(F.col("key"), 30) * F.col("ranges"), 30))

    sums = ranged(narrow).groupBy("rank", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("rank").alias("r_rank"), F.col("range").alias("r_range"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("ranges_before"))

    rows = narrow if carry is None else row(*[F.col(f"`{c}`").alias(f"c_{c}") for c in carry])
    inside = Window.partitionBy("rank", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged(rows)
        .join(sums, (F.col("rank") == F.col("r_rank")) & (F.col("range") == F.col("r_range")), "inner")
        .withColumn("before", F.col("ranges_before") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before")))
    whole = (2 * F.col("before") + F.col("size") <= 2 * F.col("rest")) & (F.col("rest") > 0)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + part).alias("taken"),
        (F.col("epochs") + whole.cast("long")).alias("copies"),
        *([f"c_{c}" for c in carry] if carry else []),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix has it as a whole."""
    plain = unclashed(docs, *(options.get(k, k[:-4] if k != "id_col" else "doc_id") for k in ("id_col", "text_col", "source_col")))
    copies = mix(plain, carry=plain.columns, **options)
    repeated = copies.withColumn("copy", F.explode(F.expr("sequence(1, greatest(copies, 1))"))).where("copies > 0")
    return repeated.select(*[F.col(f"`c_{c}`") for c in plain.columns]).toDF(*docs.columns)


#: DuckDB SQL for op7.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15))::BIGINT AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM {documents}),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk
  FROM sized GROUP BY source),
capped AS (SELECT *, (rk - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM src),
running AS (
  SELECT *, sum(cap) OVER o - cap AS cap_before, sum(weight) OVER o - weight AS weight_before,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM capped WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), rk ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT *, CAST(total - cap_before AS DOUBLE) / CAST(weights - weight_before AS DOUBLE) AS lev FROM running),
final AS (SELECT *, max(CASE WHEN lev * weight <= cap THEN lev END) OVER () AS top FROM levels),
goal AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), top * weight) AS target FROM final),
cut AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
epoch AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM cut),
placed AS (SELECT *, budget - epochs * source_size AS rest FROM epoch)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM placed
"""

"""Audit of how filters interact: what each order of filters keeps and removes, and what each filter is worth.

Every document gets a mask, a bit for each filter that it fails. Masks are counted for each part (a language) and for
labels (all, good, toxic). A subset-zeta transform over the 2^n cells of a part gives the survivors of every subset of
filters; a step of an order is the difference between two neighbouring subsets, so no order looks at documents.

The conditions are those of one text but for the last: a text fails it if it is identical to the text of a smaller
doc_id anywhere in the table. Texts are told apart by SHA-256. Rows are folded by (text, part, labels, mask) with the
least doc_id and the number of rows that have it, before anything is brought together by text, so a text that a third of
all rows share is a row for each task and then a row for each part and label.

Defined results: a null text is empty; a null lang is the part ''; rows without a doc_id never fail the last filter and
make no other row fail it, and have no labels; rows that share the least doc_id of their text all pass it; labels that
repeat a doc_id count as 1 if one of them does; repeated rows count as often as they come; an empty table has no parts;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .common import WORD, arrow_map, materialize, unclashed

FILTERS = "ABCDE"
#: Limits of the conditions A (words), B (per cent of distinct words), C (per cent of capitals); characters of D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 100, 80, 10, "[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the conditions that a text fails by itself."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    bit = lambda i, fails: F.when(fails, F.lit(1 << i)).otherwise(F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    few, alike = F.size(words) < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words)
    return bit(0, few) + bit(1, alike) + bit(2, 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long")) + bit(3, text.rlike(MARKS))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail exactly the filters of mask."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = unclashed(docs, id_col, text_col, part_col).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("text_hash"), text_mask(text).alias("mask"))
    rows = materialize(rows, "audit-rows")
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    by_id = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(one("quality"), one("toxic"))
    # rows without an id are folded by themselves, so that they are no key of the join
    of = ["text_hash", "part", "mask"]
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    known = rows.where("doc_id is not null").join(by_id, F.col("doc_id") == F.col("l_id"), "left").withColumns({"good": yes("quality"), "bad": yes("toxic")})
    known = known.groupBy("doc_id", *of, "good", "bad").agg(F.count(F.lit(1)).alias("c"))
    known = known.groupBy(*of, "good", "bad").agg(F.sum("c").alias("n"), F.min("doc_id").alias("least"), F.min_by("c", "doc_id").alias("at_least"))
    unknown = rows.where("doc_id is null").groupBy(*of).agg(F.count(F.lit(1)).alias("c"))
    # of rows with one text, those with the least doc_id pass the last filter
    first = F.min("least").over(Window.partitionBy("text_hash"))
    passing = F.when(F.col("least") == first, F.col("at_least")).otherwise(F.lit(0))
    split = known.withColumn("passing", passing.cast("long")).select("part", "good", "bad", F.explode(F.array(F.struct("mask", F.col("passing").alias("c")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("passing")).alias("c")))).alias("x"))
    cells = split.select("part", "x.mask", "x.c", "good", "bad").unionByName(unknown.select("part", "mask", "c", F.lit(False).alias("good"), F.lit(False).alias("bad")))
    counted = lambda when, name: F.sum(F.when(when, F.col("c")).otherwise(F.lit(0))).cast("long").alias(name)
    return cells.groupBy("part", "mask").agg(counted(F.lit(True), "n"), counted(F.col("good"), "good"), counted(F.col("bad"), "toxic"))


def survivors(cells: np.ndarray, filters: int) -> np.ndarray:
    """From counts of masks (..., 2^n) those of the documents that no filter of each subset removes (..., 2^n).

    zeta[s] is the sum of the cells whose mask is a subset of s; what survives the filters of s has a mask inside the
    complement of s.
    """
    zeta = cells.copy().reshape(-1, 1 << filters)
    for b in range(filters):
        halves = zeta.reshape(len(zeta), -1, 2, 1 << b)
        halves[:, :, 1] += halves[:, :, 0]
    return zeta[:, ::-1].reshape(cells.shape)


def order_steps(filters: str) -> list[tuple[str, int, int, int]]:
    """(order, step, place of the step's filter, set of filters before it) of all orders."""
    place = {f: i for i, f in enumerate(filters)}
    orders = ("".join(p) for p in permutations(filters))
    return [(o, i + 1, place[o[i]], sum(1 << place[f] for f in o[:i])) for o in orders for i in range(len(filters))]


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, filter order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    counts is (part, mask, n, good, toxic). A part comes together as its cells, at most 2^filters.
    """
    n = len(filters)
    steps = order_steps(filters)
    names, numbers = [s[0] for s in steps], np.array([s[1] for s in steps])
    at, before = np.array([s[2] for s in steps]), np.array([s[3] for s in steps])
    after = before | (1 << at)
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                flat = batch.column("cells").slice(i, 1).flatten()
                table = np.zeros((len(COUNTS), 1 << n), np.int64)
                for j, c in enumerate(COUNTS):
                    np.add.at(table[j], flat.field("mask").to_numpy(zero_copy_only=False), flat.field(c).to_numpy(zero_copy_only=False))
                left = survivors(table, n)
                removed, good, toxic = left[:, before] - left[:, after]
                fails = left[0, 0] - left[0, 1 << at]
                shapley = np.bincount(at, removed, n).astype(np.int64)[at]
                columns = [numbers, left[0, after], removed, fails - removed, table[0, 1 << at], good, toxic, shapley]
                part = pa.array([batch.column("part")[i].as_py()] * len(steps), pa.string())
                yield pa.RecordBatch.from_arrays([part, pa.array(names), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["part", "filter_order", "step", *RESULTS])

    return arrow_map(cells, run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in RESULTS))


RESULTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

#: DuckDB SQL for op11: every order is applied to every document.
SQL = r"""
WITH worded AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM worded GROUP BY text),
failing AS (
  SELECT w.doc_id, w.part,
         [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
          100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * length(w.text), regexp_matches(w.text, '[#$%&*|]'),
          coalesce(w.doc_id > f.first_id, false)] AS fails
  FROM worded w JOIN firsts f ON w.text = f.text),
labelled AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT f.*, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic FROM failing f LEFT JOIN labelled l ON f.doc_id = l.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
places AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, ascii(filter_order[step]) - 64 AS f,
         list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) AS earlier FROM steps),
applied AS (
  SELECT d.part, p.filter_order, p.step, p.f, d.good, d.toxic, d.fails[p.f] AS failed,
         len(list_filter(p.earlier, lambda i: d.fails[i])) > 0 AS gone,
         len(list_filter(d.fails, lambda b: b)) = 1 AS once FROM docs d, places p),
counted AS (
  SELECT part, filter_order, step, f, count(*) FILTER (NOT gone AND NOT failed) AS kept, count(*) FILTER (failed AND NOT gone) AS removed,
         count(*) FILTER (failed AND gone) AS redundant, count(*) FILTER (failed AND once) AS unique_fails,
         count(*) FILTER (failed AND NOT gone AND good) AS good_lost, count(*) FILTER (failed AND NOT gone AND toxic) AS toxic_lost
  FROM applied GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""

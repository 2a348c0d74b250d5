"""What the operators share: set-up of a session, words, and counts of them."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from tessella.session import default_partitions, materialize, shared_dir, ship

__all__ = ["WORD", "arrow_map", "ascii_lower", "default_partitions", "materialize", "prepare", "shared_dir", "word_count"]

#: A word: a run of anything but ASCII white space; bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch, so that a batch of long documents stays small.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Ships the package's code and keeps Arrow batches of long texts small, unless the session says otherwise."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with the code shipped first."""
    prepare(df.sparkSession)
    return df.mapInArrow(function, schema)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def kept_of_components(linked: DataFrame, first: str) -> DataFrame:
    """linked (root, ..., first) without root and with keep: the least ``first`` of each root's rows."""
    rows = materialize(linked, "linked")
    firsts = rows.groupBy(F.col("root").alias("k_root")).agg(F.min(first).alias("keep"), F.count(F.lit(1)).alias("k_rows"))
    found = hot_lookup(rows, ["root"], materialize(firsts, "firsts"), ["k_root"], "k_rows", rows.count())
    return found.select(*[c for c in linked.columns if c not in ("root", first)], "keep")


def unclashed(df: DataFrame, *needed: str) -> DataFrame:
    """df with other names for columns whose names differ from a needed or an earlier one by case only, which Spark can't tell apart."""
    names, seen = [], {c.lower() for c in needed}
    for i, c in enumerate(df.columns):
        clash = c not in needed and c.lower() in seen
        names.append(f"_{i}_{c}" if clash else c)
        seen.add(c.lower())
    return df if names == df.columns else df.toDF(*names)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of df has or begins with."""
    name = f"_{stem}"
    while any(c.lower().startswith(name) for c in df.columns):
        name = f"_{name}"
    return name


#: Of a key with more than a thousandth of all rows there are fewer than a thousand.
HOT_SHARE = 1000


def hot_lookup(rows: DataFrame, keys: list[str], table: DataFrame, table_keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has one row for each key and the number of its rows.

    Keys with over a thousandth of all rows are at most a thousand, so their part of the table is broadcast within
    that bound; the others are joined by a shuffle in which no key has more than that share.
    """
    limit = max(1000, total // HOT_SHARE)
    hot = F.broadcast(table.where(F.col(count) > limit).limit(HOT_SHARE))
    cold = table.where(F.col(count) <= limit)
    on = [F.col(k) == F.col(t) for k, t in zip(keys, table_keys, strict=True)]
    return rows.join(hot, on, "inner").union(rows.join(hot.select(*table_keys), on, "left_anti").join(cold, on, "inner"))


#: Bits of a filter for each member, and at most: 128 MB. A filter that is fuller lets more through, which a join then stops.
MEMBER_BITS, MOST_BITS = 64, 1 << 30


def hash_filter(ids: DataFrame, column: str = "id") -> bytearray:
    """A filter that has the top bits of each hash: what it lets through may be wanted, what it stops is not.

    Its size, a power of two, is by the number of members, within MOST_BITS. Words of the filter are made on the
    executors; at most bits / 64 of them come to the driver.
    """
    import numpy as np

    bits = min(MOST_BITS, 1 << (MEMBER_BITS * max(ids.count(), 1 << 14) - 1).bit_length())
    shift = 64 - (bits.bit_length() - 1)
    slot = F.shiftrightunsigned(column, shift)
    words = ids.select((slot / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned({column}, {shift}), 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bit").to_numpy()
    return bytearray(out.tobytes())


def passes(filter_words, hashes):
    """Which of the uint64 hashes the filter lets through."""
    import numpy as np

    slot = hashes >> np.uint64(64 - (64 * len(filter_words)).bit_length() + 1)
    return (filter_words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0

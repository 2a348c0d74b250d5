"""Statistics as declarative aggregates: partial sums before every shuffle."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tessella.session import default_partitions, materialize


def stat_summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, least, most, mean and the sample deviation, which is 0 for one value."""
    return rows.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"))


def moments(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """mean, population deviation and the cube root of the third central moment for each group, from power sums."""
    x = F.col(value)
    sums = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(x).alias("m1"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("skew"))
    return sums.select(*by, "n", F.col("m1").alias("mean"), F.col("sd").alias("stddev"), F.when(F.col("sd") > 0, F.col("sd") * F.cbrt("skew")).otherwise(0.0).alias("skew_root"))


def region_weights(rows: DataFrame, size: str, by: str) -> DataFrame:
    """rows with weight = sqrt(size) / sum of sqrt(size) over its object."""
    return rows.withColumn("weight", F.sqrt(size) / F.sum(F.sqrt(size)).over(Window.partitionBy(by)))


def fit_line(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """Least-squares slope, intercept and r2 of y on x."""
    pairs = rows.select(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return pairs.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def fit_loglog(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Power law: the line of log y on log x over positive values."""
    return fit_line(rows.where((F.col(x) > 0) & (F.col(y) > 0)), F.log(F.col(x)), F.log(F.col(y)))


def fit_weighted(rows: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """Weighted least squares: slope and intercept."""
    c = {k: F.col(k).cast("double") for k in (x, y, w)}
    s = rows.agg(F.sum(c[w]).alias("w"), F.sum(c[w] * c[x]).alias("x"), F.sum(c[w] * c[y]).alias("y"), F.sum(c[w] * c[x] * c[x]).alias("xx"), F.sum(c[w] * c[x] * c[y]).alias("xy"))
    slope = (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / (F.col("w") * F.col("xx") - F.col("x") * F.col("x"))
    return s.select(slope.alias("slope"), ((F.col("y") - slope * F.col("x")) / F.col("w")).alias("intercept"))


def fit_origin(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Slope of the line through the origin."""
    return rows.agg((F.sum(F.col(x).cast("double") * F.col(y)) / F.sum(F.col(x).cast("double") * F.col(x))).alias("slope"))


def weighted_stats(rows: DataFrame, value: str, w: str, by: list[str] | None = None) -> DataFrame:
    """Weighted mean and variance (unbiased for reliability weights)."""
    x, k = F.col(value).cast("double"), F.col(w).cast("double")
    s = rows.groupBy(*(by or [])).agg(F.sum(k).alias("s"), F.sum(k * k).alias("s2"), F.sum(k * x).alias("sx"), F.sum(k * x * x).alias("sxx"))
    mean = F.col("sx") / F.col("s")
    spread = F.col("sxx") - F.col("sx") * mean
    return s.select(*(by or []), mean.alias("wmean"), (spread * F.col("s") / (F.col("s") * F.col("s") - F.col("s2"))).alias("wvariance"))


def with_groups(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of their group. Where groups aren't broadcast, each one is there once for each shuffle partition and its rows are dealt to these, so that a frequent group is no task of its own."""
    n = default_partitions(rows.sparkSession)
    dealt = rows.withColumn("_part", F.monotonically_increasing_id() % n)
    return dealt.join(groups.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))), [*by, "_part"]).drop("_part")


def weighted_shape(rows: DataFrame, value: str, w: str, by: list[str]) -> DataFrame:
    """Weighted mean, standard deviation (unbiased for reliability weights), mean absolute deviation, skewness and excess kurtosis of each group."""
    x, k = F.col(value).cast("double"), F.col(w).cast("double")
    first = rows.groupBy(*by).agg((F.sum(k * x) / F.sum(k)).alias("_m"), F.sum(k).alias("_w"), F.sum(k * k).alias("_w2"))
    d = x - F.col("_m")
    spread = with_groups(rows, first, by).groupBy(*by).agg(F.first("_m").alias("_m"), F.sqrt(F.sum(k * d * d) * F.first("_w") / (F.first("_w") * F.first("_w") - F.first("_w2"))).alias("_s"))
    z = d / F.col("_s")
    mean = lambda c: F.sum(k * c) / F.sum(k)
    return with_groups(rows, spread, by).groupBy(*by).agg(F.first("_m").alias("wmean"), F.first("_s").alias("wsd"), mean(F.abs(d)).alias("wabsdev"), mean(z * z * z).alias("wskew"), (mean(z * z * z * z) - 3).alias("wkurtosis"))


def shape_stats(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean absolute deviation, skewness and excess kurtosis (sample deviation in the denominators) for each group."""
    mean = rows.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    joined = with_groups(rows, mean, by)
    z = (F.col(value) - F.col("_m")) / F.col("_s")
    return joined.groupBy(*by).agg(F.avg(F.abs(F.col(value) - F.col("_m"))).alias("absdev"), F.avg(z * z * z).alias("skew"), (F.avg(z * z * z * z) - 3).alias("kurtosis"))


def autocorrelation(rows: DataFrame, value: str, by: str, order: list[str]) -> DataFrame:
    """Lag-1 autocorrelation of each group's series."""
    mean = rows.groupBy(by).agg(F.avg(value).alias("_m"))
    w = Window.partitionBy(by).orderBy(*order)
    d = rows.join(mean, by).withColumn("d", F.col(value) - F.col("_m")).withColumn("p", F.lag("d").over(w))
    return d.groupBy(by).agg((F.sum(F.col("d") * F.col("p")) / F.sum(F.col("d") * F.col("d"))).alias("lag1"))


def covariance(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.covar_samp(x, y).alias("covariance"), F.corr(x, y).alias("correlation"))


def t_test(rows: DataFrame, value: str, group: Column) -> DataFrame:
    """Pooled variance and t statistic of the rows where group is true against the others."""
    s = rows.groupBy(group.alias("g")).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    pick = lambda c, g: F.max(F.when(F.col("g") == F.lit(g), F.col(c)))
    one = s.agg(*[pick(c, g).alias(f"{c}{int(g)}") for c in ("n", "m", "v") for g in (True, False)])
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
    return one.select(pooled.alias("pooled_variance"), ((F.col("m1") - F.col("m0")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n0")))).alias("t"))


def extremes(rows: DataFrame, value: str, id_col: str) -> DataFrame:
    """Least and largest value with their ids (the smallest id of ties)."""
    low, high = F.min(F.struct(F.col(value).alias("v"), F.col(id_col).alias("i"))), F.min(F.struct((-F.col(value)).alias("v"), F.col(id_col).alias("i")))
    return rows.agg(low.alias("a"), high.alias("b")).select(F.col("a.v").alias("least"), F.col("a.i").alias("least_id"), (-F.col("b.v")).alias("most"), F.col("b.i").alias("most_id"))


def quantiles(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """Quantiles, one column for each share: exact ones by linear interpolation, or with an accuracy values whose rank is off by at most 1 / accuracy of the rows.

    Exact ones come from ranks: equal values are folded to one row with their number, those rows are sorted by ranges of
    (group, value), and a value's first rank is the sum of the ranges of its group before its own and a running sum inside
    it. So neither a group nor a value that many rows have is one task's work. Nulls are left out.
    """
    by = by or []
    if accuracy:
        return rows.groupBy(*by).agg(*[F.percentile_approx(value, s, accuracy).alias(f"q{round(100 * s)}") for s in shares])
    keys = [f"_g{i}" for i in range(len(by))]
    groups = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)])
    folded = rows.where(F.col(value).isNotNull()).groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    sorted_ = materialize(folded.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()), "quantile-values")
    in_group = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sorted_.groupBy(*keys, "_range").agg(F.sum("_n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(in_group), F.lit(0)))
    sums = sums.withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    sums = sums.select(*[F.col(k).alias(f"s{k}") for k in keys], F.col("_range").alias("s_range"), "_before", "_all")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in keys], F.col("_range") == F.col("s_range"))
    inside = Window.partitionBy("_range", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = sorted_.join(sums, same).withColumn("_first", F.col("_before") + F.sum("_n").over(inside) - F.col("_n"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_first") <= place) & (place < F.col("_first") + F.col("_n")), F.col("_v")))

    def quantile(share: float) -> Column:
        place = (F.col("_all") - 1) * F.lit(float(share))
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        return (low + (high - low) * part).alias(f"q{round(100 * share)}")

    found = placed.groupBy(*keys).agg(*[quantile(s) for s in shares])
    if not by:
        return found
    # groups that have nulls only stay, with nulls
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"f{k}")) for k in keys])
    named = found.select(*[F.col(k).alias(f"f{k}") for k in keys], *found.columns[len(keys) :])
    return groups.agg(F.lit(1).alias("_one")).join(named, on, "left").select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *found.columns[len(keys) :])


def histogram(rows: DataFrame, value: str, low: float, high: float, slots: int) -> DataFrame:
    """(slot, n) of values in [low, high); values outside are left out."""
    x = F.col(value)
    return rows.where((x >= low) & (x < high)).groupBy(F.floor((x - low) / ((high - low) / slots)).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def combine_histograms(a: DataFrame, b: DataFrame) -> DataFrame:
    """(slot, plus, minus, times, over) of two histograms (slot, n), slot by slot; a missing slot is empty, a quotient by an empty one is null."""
    x, y = F.coalesce("a_n", F.lit(0)), F.coalesce("b_n", F.lit(0))
    both = a.select("slot", F.col("n").alias("a_n")).join(b.select("slot", F.col("n").alias("b_n")), "slot", "full")
    return both.select("slot", (x + y).alias("plus"), (x - y).alias("minus"), (x * y).alias("times"), F.when(y != 0, x / y).alias("over"))


def scale_histogram(h: DataFrame, factor: float = 1.0, shift: float = 0.0) -> DataFrame:
    return h.select("slot", (F.col("n") * factor + shift).alias("n"))


def histogram_cdf(h: DataFrame) -> DataFrame:
    """(slot, n, cdf): shares of all up to each slot. A histogram is a small table; its slots are bounded."""
    total = Window.partitionBy(F.lit(0))
    return h.select("slot", "n", (F.sum("n").over(total.orderBy("slot")) / F.sum("n").over(total)).alias("cdf"))


def sample_histogram(h: DataFrame, rows: DataFrame, uniform: Column, low: float, width: float) -> DataFrame:
    """rows with sample: a value drawn from a histogram (slot, n) by a uniform number of each row; inside a slot evenly. The slots are collected."""
    slots = [(r.slot, r.n, r.cdf) for r in histogram_cdf(h.where("n > 0")).orderBy("slot").collect()]
    if not slots:
        return rows.withColumn("sample", F.lit(None).cast("double"))
    total = sum(n for _, n, _ in slots)
    table = F.array(*[F.struct(F.lit(float(s)).alias("s"), F.lit(c).alias("c"), F.lit(n / total).alias("p")) for s, n, c in slots])
    hit = F.coalesce(F.get(F.filter(table, lambda t: uniform < t["c"]), F.lit(0)), F.element_at(table, -1))
    return rows.withColumn("sample", F.lit(low) + F.lit(width) * (hit["s"] + F.greatest(F.lit(0.0), uniform - (hit["c"] - hit["p"])) / hit["p"]))


def histogram2d(rows: DataFrame, x: str, y: str, xs: tuple[float, float, int], ys: tuple[float, float, int]) -> DataFrame:
    """(slot_x, slot_y, n)."""
    cell = lambda c, r: F.floor((F.col(c) - r[0]) / ((r[1] - r[0]) / r[2])).cast("int")
    inside = rows.where((F.col(x) >= xs[0]) & (F.col(x) < xs[1]) & (F.col(y) >= ys[0]) & (F.col(y) < ys[1]))
    return inside.groupBy(cell(x, xs).alias("slot_x"), cell(y, ys).alias("slot_y")).agg(F.count(F.lit(1)).alias("n"))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function in built-in arithmetic (a rational approximation, error below 1e-7)."""
    # coefficients of the approximation (fixed values)
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + p * F.abs(x))
    tail = F.exp(-x * x / 2) / F.sqrt(2 * F.pi()) * t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)

"""Queries of statistics and metrics."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tessella.operators import distributions, metrics, stats

from .common import query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _rounded(df: DataFrame, keys: list[str], places: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c not in keys])


@query("SELECT l_returnflag, count(l_quantity) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most, round(avg(l_extendedprice), 4) AS mean, round(coalesce(stddev_samp(l_extendedprice), 0), 4) AS stddev FROM lineitem GROUP BY 1")
def stat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.stat_summary(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]), ["l_returnflag"], 4)


@query("""WITH g AS (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY 1)
SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean, round(stddev_pop(p_retailprice), 4) AS stddev,
round(sign(avg(pow(p_retailprice - m, 3))) * pow(abs(avg(pow(p_retailprice - m, 3))), 1 / 3.0::DOUBLE), 3) AS skew_root FROM part JOIN g USING (p_brand) GROUP BY 1""")
def group_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and cube root of the third moment for each group."""
    m = stats.moments(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"])
    return m.select("p_brand", "n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), F.round("skew_root", 3).alias("skew_root"))


@query("SELECT round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept, round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 6) AS r2 FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0")
def regr_loglog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.fit_loglog(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), [])


@query("""WITH s AS (SELECT sum(l_tax) AS w, sum(l_tax * l_quantity) AS x, sum(l_tax * l_extendedprice) AS y, sum(l_tax * l_quantity * l_quantity) AS xx, sum(l_tax * l_quantity * l_extendedprice) AS xy FROM lineitem),
k AS (SELECT *, (w * xy - x * y) / (w * xx - x * x) AS b FROM s) SELECT round(b, 4) AS slope, round((y - b * x) / w, 4) AS intercept FROM k""")
def regr_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.fit_weighted(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_tax"), [], 4)


@query("SELECT round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 6) AS slope FROM lineitem")
def regr_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.fit_origin(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), [])


@query("""WITH p AS (SELECT l_returnflag, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS s2, sum(l_quantity * l_discount) AS sx, sum(l_quantity * l_discount * l_discount) AS sxx FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(sx / s, 8) AS wmean, round((sxx - sx * sx / s) * s / (s * s - s2), 8) AS wvariance FROM p""")
def weighted_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.weighted_stats(table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"]), ["l_returnflag"], 8)


@query("""WITH g AS (SELECT l_returnflag, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(avg(abs(l_extendedprice - m)), 4) AS absdev, round(avg(pow((l_extendedprice - m) / s, 3)), 6) AS skew, round(avg(pow((l_extendedprice - m) / s, 4)) - 3, 6) AS kurtosis FROM lineitem JOIN g USING (l_returnflag) GROUP BY 1""")
def shape_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.shape_stats(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return s.select("l_returnflag", F.round("absdev", 4).alias("absdev"), F.round("skew", 6).alias("skew"), F.round("kurtosis", 6).alias("kurtosis"))


@query("""WITH d AS (SELECT user_id, event_id, ts, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events), p AS (SELECT user_id, d, lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM d)
SELECT user_id, round(sum(d * q) / sum(d * d), 6) AS lag1 FROM p GROUP BY 1 HAVING sum(d * d) > 1e-9""")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    spread = e.groupBy("user_id").agg((F.var_pop("value") * F.count("value")).alias("v")).where("v > 1e-9").select("user_id")
    return _rounded(stats.autocorrelation(e.join(spread, "user_id", "left_semi"), "value", "user_id", ["ts", "event_id"]), ["user_id"])


@query("SELECT round(covar_samp(l_quantity, l_extendedprice), 4) AS covariance, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.covariance(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return c.select(F.round("covariance", 4).alias("covariance"), F.round("correlation", 6).alias("correlation"))


@query("""WITH s AS (SELECT count(l_extendedprice) FILTER (l_returnflag = 'R')::DOUBLE AS n1, count(l_extendedprice) FILTER (l_returnflag <> 'R')::DOUBLE AS n0, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m1, avg(l_extendedprice) FILTER (l_returnflag <> 'R') AS m0,
var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS v1, var_samp(l_extendedprice) FILTER (l_returnflag <> 'R') AS v0 FROM lineitem),
p AS (SELECT *, ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) AS pv FROM s) SELECT round(pv, 2) AS pooled_variance, round((m1 - m0) / sqrt(pv * (1 / n1 + 1 / n0)), 6) AS t FROM p""")
def t_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.t_test(table(spark, sf_dir, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R")
    return t.select(F.round("pooled_variance", 2).alias("pooled_variance"), F.round("t", 6).alias("t"))


@query("""SELECT (SELECT min(o_totalprice) FROM orders) AS least, (SELECT min(o_orderkey) FROM orders WHERE o_totalprice = (SELECT min(o_totalprice) FROM orders)) AS least_id,
(SELECT max(o_totalprice) FROM orders) AS most, (SELECT min(o_orderkey) FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)) AS most_id""")
def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.extremes(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.9), 4) AS q90 FROM orders GROUP BY 1")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.quantiles(table(spark, sf_dir, "orders"), "o_totalprice", [0.25, 0.5, 0.9], ["o_orderpriority"]), ["o_orderpriority"], 4)


@query("SELECT CAST(floor(l_quantity / 2.5) AS INTEGER) AS slot, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 52.5 GROUP BY 1")
def histogram_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 0.0, 52.5, 21)


@query("SELECT CAST(floor(l_quantity / 5.0) AS INTEGER) AS slot_x, CAST(floor(l_extendedprice / 8192.0) AS INTEGER) AS slot_y, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 55 AND l_extendedprice >= 0 AND l_extendedprice < 131072 GROUP BY 1, 2")
def histogram_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", (0.0, 55.0, 11), (0.0, 131072.0, 16))


_STAGES = "s AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS latency_us FROM events)"


@query(f"WITH {_STAGES} SELECT event_id, user_id, latency_us FROM s")
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stage_latency(_events(spark, sf_dir), "user_id", "ts", ["ts", "event_id"]).select("event_id", "user_id", "latency_us")


@query(f"""WITH {_STAGES}, f AS (SELECT *, event_id % 5 = 0 AS dup FROM s)
SELECT count(latency_us) AS n, round(avg(latency_us), 2) AS mean_us, count(latency_us) FILTER (dup) AS n_dup, round(avg(latency_us) FILTER (dup), 2) AS mean_dup_us, count(latency_us) FILTER (NOT dup) AS n_unique, round(avg(latency_us) FILTER (NOT dup), 2) AS mean_unique_us FROM f""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.stage_latency(_events(spark, sf_dir), "user_id", "ts", ["ts", "event_id"]).withColumn("dup", F.col("event_id") % 5 == 0)
    return _rounded(metrics.latency_summary(rows, "latency_us", "dup"), [], 2)


@query("SELECT round(sum(value), 4) AS total, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000, 6) AS seconds, round(sum(value) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000), 8) AS per_second FROM events")
def throughput_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metrics.throughput(_events(spark, sf_dir), "value", "ts")
    return t.select(F.round("total", 4).alias("total"), F.round("seconds", 6).alias("seconds"), F.round("per_second", 8).alias("per_second"))


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def throughput_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = metrics.throughput_windows(_events(spark, sf_dir), "value", "ts")
    return w.select(F.unix_micros("window_start").alias("window_start"), "n", F.round("total", 4).alias("total"))


#: Intervals of at least an hour as a recursion from each close to the next; an interval has the stamps after the last close.
_INTERVALS = """{rows}, s AS (SELECT key, stamp, count(*) AS n, sum(amount) AS total FROM rows GROUP BY key, stamp),
r(key, i, lo, hi) AS (
  SELECT b.key, 0, b.first - 1, (SELECT min(x.stamp) FROM s x WHERE x.key = b.key AND x.stamp >= b.first + 3600000000) FROM (SELECT key, min(stamp) AS first FROM s GROUP BY key) b
  UNION ALL SELECT r.key, r.i + 1, r.hi, (SELECT min(x.stamp) FROM s x WHERE x.key = r.key AND x.stamp >= r.hi + 3600000000) FROM r WHERE r.hi IS NOT NULL),
p AS (SELECT r.key, r.i, min(s.stamp) AS a, max(s.stamp) AS b, CAST(sum(s.n) AS BIGINT) AS n, sum(s.total) AS total FROM r JOIN s ON s.key = r.key AND s.stamp > r.lo AND (r.hi IS NULL OR s.stamp <= r.hi) GROUP BY r.key, r.i)
SELECT key, CAST(i AS INTEGER) AS "interval", a AS t_first, b AS t_last, n, round(total, {places}) AS total, round(total / n, {places}) AS mean, round(CASE WHEN b > a THEN total * 1000000 / (b - a) END, {places}) AS per_second FROM p"""


@query("WITH RECURSIVE rows AS (SELECT event_type AS key, epoch_us(ts) AS stamp, value AS amount FROM events)" + _INTERVALS.format(rows="", places=6))
def interval_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that close with the first event at least an hour after the last close, by type of event."""
    return _rounded(metrics.elapsed_intervals(_events(spark, sf_dir), "event_type", "ts", "value", 3600.0), ["key"])


@query(f"WITH RECURSIVE {_STAGES}, rows AS (SELECT event_type AS key, epoch_us(ts) AS stamp, latency_us::DOUBLE AS amount FROM s WHERE latency_us IS NOT NULL)" + _INTERVALS.format(rows="", places=4).replace(", s AS (", ", s2 AS (").replace("FROM s x", "FROM s2 x").replace("FROM s GROUP", "FROM s2 GROUP").replace("JOIN s ON s.key", "JOIN s2 s ON s.key"))
def interval_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean latencies of such intervals."""
    rows = metrics.stage_latency(_events(spark, sf_dir), "user_id", "ts", ["ts", "event_id"]).where("latency_us is not null")
    return _rounded(metrics.elapsed_intervals(rows, "event_type", "ts", "latency_us", 3600.0), ["key"], 4)


@query("""WITH s AS (SELECT l_returnflag, sum(l_quantity * l_discount) / sum(l_quantity) AS m, sum(l_quantity) AS w, sum(l_quantity * l_quantity) AS w2 FROM lineitem GROUP BY 1),
v AS (SELECT l_returnflag, any_value(m) AS m, any_value(w) AS w, sum(l_quantity * pow(l_discount - m, 2)) * any_value(w) / (any_value(w) * any_value(w) - any_value(w2)) AS var FROM lineitem JOIN s USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, round(any_value(m), 6) AS wmean, round(sqrt(any_value(var)), 6) AS wsd, round(sum(l_quantity * abs(l_discount - m)) / any_value(w), 6) AS wabsdev,
round(sum(l_quantity * pow((l_discount - m) / sqrt(var), 3)) / any_value(w), 6) AS wskew, round(sum(l_quantity * pow((l_discount - m) / sqrt(var), 4)) / any_value(w) - 3, 6) AS wkurtosis FROM lineitem JOIN v USING (l_returnflag) GROUP BY 1""")
def weighted_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean, deviations, skewness and kurtosis."""
    return _rounded(stats.weighted_shape(table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"]), ["l_returnflag"])


_TWO = """a AS (SELECT CAST(floor(l_quantity / 2.5) AS INTEGER) AS slot, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 52.5 GROUP BY 1),
b AS (SELECT CAST(floor(l_quantity / 2.5) AS INTEGER) AS slot, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity < 52.5 GROUP BY 1)"""


@query(f"WITH {_TWO} SELECT slot, coalesce(a.n, 0) + coalesce(b.n, 0) AS plus, coalesce(a.n, 0) - coalesce(b.n, 0) AS minus, coalesce(a.n, 0) * coalesce(b.n, 0) AS times, round(coalesce(a.n, 0)::DOUBLE / nullif(coalesce(b.n, 0), 0), 9) AS over FROM a FULL JOIN b USING (slot)")
def histogram_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of returned and other items, combined slot by slot."""
    items, back = table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R"
    a, b = (stats.histogram(items.where(c), "l_quantity", 0.0, 52.5, 21) for c in (back, ~back))
    return _rounded(stats.combine_histograms(a, b), ["slot"], 9)


@query("""WITH h AS (SELECT CAST(floor(l_quantity / 2.5) AS INTEGER) AS slot, count(*) AS n FROM lineitem WHERE l_quantity < 52.5 GROUP BY 1)
SELECT slot, n, round(sum(n) OVER (ORDER BY slot) / sum(n) OVER (), 9) AS cdf FROM h""")
def histogram_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative shares of a histogram."""
    return _rounded(stats.histogram_cdf(stats.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 0.0, 52.5, 21)), ["slot"], 9)


@query("""SELECT event_id, round(1 - exp(-abs(value) / 20), 9) AS exponential, round(1 / (1 + exp(-(value - 50) / 10)), 9) AS logistic, round(CASE WHEN value < 50 THEN exp((value - 50) / 10) / 2 ELSE 1 - exp(-(value - 50) / 10) / 2 END, 9) AS laplace,
round(0.5 + atan((value - 50) / 10) / pi(), 9) AS cauchy, round(1 - exp(-pow(abs(value) / 30, 2)), 9) AS weibull, round(1 - exp(-value * value / (2 * 30.0 * 30.0)), 9) AS rayleigh, round(CASE WHEN abs(value) < 2 THEN 0 ELSE 1 - pow(2 / abs(value), 1.5) END, 9) AS pareto, round(exp(-exp(-(value - 50) / 10)), 9) AS gumbel FROM events""")
def distribution_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution functions of every event's value."""
    x, z = F.col("value"), (F.col("value") - 50) / 10
    made = {"exponential": ("exponential", F.abs(x), (20.0,)), "logistic": ("logistic", z, ()), "laplace": ("laplace", z, ()), "cauchy": ("cauchy", z, ()), "weibull": ("weibull", F.abs(x), (30.0, 2.0)), "rayleigh": ("rayleigh", F.abs(x), (30.0,)), "pareto": ("pareto", F.abs(x), (1.5, 2.0)), "gumbel": ("gumbel", z, ())}
    return _events(spark, sf_dir).select("event_id", *[F.round(distributions.cdf(kind, v, *args), 9).alias(c) for c, (kind, v, args) in made.items()])


@query("""WITH u AS (SELECT event_id, (abs(value) % 97 + 0.5) / 97.5 AS p FROM events)
SELECT event_id, round(-20 * ln(1 - p), 9) AS exponential, round(10 * ln(p / (1 - p)), 9) + 0 AS logistic, round(CASE WHEN p < 0.5 THEN 10 * ln(2 * p) ELSE -10 * ln(2 * (1 - p)) END, 9) + 0 AS laplace,
round(10 * tan(pi() * (p - 0.5)), 7) + 0 AS cauchy, round(30 * pow(-ln(1 - p), 0.5), 9) AS weibull, round(30 * sqrt(-2 * ln(1 - p)), 9) AS rayleigh, round(2 * pow(1 - p, -1 / 1.5::DOUBLE), 9) AS pareto, round((ln(2.0::DOUBLE) - ln(-ln(p))) / 3, 9) AS gumbel, round(pow(-ln(p) / 2, -1 / 3.0::DOUBLE), 9) AS gumbel2,
greatest(1.0::DOUBLE, ceil(ln(1 - p) / ln(0.75::DOUBLE))) AS geometric FROM u""")
def distribution_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile functions at a probability made of every event's value."""
    p = (F.abs("value") % 97 + 0.5) / 97.5
    made = {"exponential": (20.0,), "logistic": (10.0,), "laplace": (10.0,), "cauchy": (10.0,), "weibull": (30.0, 2.0), "rayleigh": (30.0,), "pareto": (1.5, 2.0), "gumbel": (3.0, 2.0), "gumbel2": (3.0, 2.0), "geometric": (0.25,)}
    digits = {"cauchy": 7}
    # adding 0 makes a zero positive
    return _events(spark, sf_dir).select("event_id", *[(F.round(distributions.quantile(kind, p, *args), digits.get(kind, 9)) + F.lit(0.0)).alias(kind) for kind, args in made.items()])


@query()
def random_variates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variates of several distributions for every customer, drawn from its key."""
    kinds = {"uniform": (2.0, 5.0), "gaussian": (3.0, 2.0), "exponential": (4.0,), "laplace": (0.0, 2.0), "logistic": (1.0, 2.0), "weibull": (3.0, 2.0), "poisson": (4.5,), "binomial": (20.0, 0.3), "geometric": (0.25,)}
    return table(spark, sf_dir, "customer").select("c_custkey", *[distributions.variate(kind, F.col("c_custkey"), 7, *args).alias(kind) for kind, args in kinds.items()])

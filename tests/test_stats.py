import math
import statistics

import numpy as np
import pyspark.sql.functions as F
import pytest

from tessella.operators import distributions, metrics, stats


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.5), ("a", 4.0, 8.0), ("b", 3.0, 1.0), ("c", None, 1.0)], "g string, x double, w double").cache()


def test_normal_cdf(spark):
    got = spark.range(-40, 41).select((F.col("id") / 10).alias("x")).select("x", stats.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(r.p == pytest.approx(0.5 * (1 + math.erf(r.x / math.sqrt(2))), abs=2e-7) for r in got)


def test_summary_of_one_and_no_value(rows):
    got = {r.g: r for r in stats.stat_summary(rows, "x", ["g"]).collect()}
    assert got["a"].stddev == pytest.approx(statistics.stdev([1, 2, 4])) and got["b"].stddev == 0 and got["c"].n == 0


def test_moments(rows):
    got = {r.g: r for r in stats.moments(rows, "x", ["g"]).collect()}
    m = 7 / 3
    third = sum((v - m) ** 3 for v in (1, 2, 4)) / 3
    assert got["a"].skew_root == pytest.approx(math.cbrt(third)) and got["b"].skew_root == 0


def test_fits(rows):
    line = stats.fit_line(rows.where("x is not null and g = 'a'"), F.col("x"), 3 * F.col("x") + 1).first()
    assert (line.slope, line.intercept, line.r2) == (pytest.approx(3), pytest.approx(1), pytest.approx(1))
    power = stats.fit_loglog(rows.where("g = 'a'").withColumn("y", 5 * F.pow("x", 1.5)), "x", "y").first()
    assert power.slope == pytest.approx(1.5) and power.intercept == pytest.approx(math.log(5))
    assert stats.fit_origin(rows.where("g = 'a'"), "x", "w").first().slope == pytest.approx((2 + 9 + 32) / 21)
    even = stats.fit_weighted(rows.where("g = 'a'").withColumn("k", F.lit(2.0)), "x", "w", "k").first()
    assert even.slope == pytest.approx(stats.fit_line(rows.where("g = 'a'"), F.col("x"), F.col("w")).first().slope)


def test_histograms_are_half_open(spark):
    df = spark.createDataFrame([(0.0,), (0.999,), (1.0,), (10.0,), (-0.1,)], "x double")
    assert {r.slot: r.n for r in stats.histogram(df, "x", 0.0, 10.0, 10).collect()} == {0: 2, 1: 1}
    assert stats.histogram2d(df, "x", "x", (0.0, 10.0, 10), (0.0, 10.0, 5)).count() == 2


def test_extremes_and_quantiles(rows):
    low = stats.extremes(rows.withColumn("id", F.monotonically_increasing_id()).where("x is not null"), "x", "id").first()
    assert (low.least, low.most) == (1.0, 4.0)
    assert stats.quantiles(rows.where("g = 'a'"), "x", [0.5, 0.25]).first().q25 == 1.5


def test_latency_and_windows(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.5, 3.0), (2, 4000.0, 1.0)], "k int, t double, v double").select("k", F.timestamp_seconds("t").alias("ts"), "v")
    lat = metrics.stage_latency(df, "k", "ts", ["ts"]).orderBy("ts").collect()
    assert [r.latency_us for r in lat] == [None, 1_500_000, None]
    assert sorted(r.n for r in metrics.throughput_windows(df, "v", "ts").collect()) == [1, 2]
    s = metrics.latency_summary(metrics.stage_latency(df, "k", "ts", ["ts"]).withColumn("dup", F.col("k") == 1), "latency_us", "dup").first()
    assert (s.n, s.n_dup, s.n_unique, s.mean_unique_us) == (1, 1, 0, None)


def test_weighted_shape_of_equal_weights(rows):
    got = stats.weighted_shape(rows.where("g = 'a'").withColumn("k", F.lit(2.0)), "x", "k", ["g"]).first()
    v = (1, 2, 4)
    assert got.wsd == pytest.approx(statistics.stdev(v)) and got.wabsdev == pytest.approx(sum(abs(x - 7 / 3) for x in v) / 3)
    assert got.wskew == pytest.approx(sum(((x - 7 / 3) / statistics.stdev(v)) ** 3 for x in v) / 3)


def test_histogram_operations(spark):
    h = stats.histogram(spark.createDataFrame([(0.5,), (1.5,), (1.6,), (3.2,)], "x double"), "x", 0.0, 4.0, 4)
    assert {r.slot: r.cdf for r in stats.histogram_cdf(h).collect()} == {0: 0.25, 1: 0.75, 3: 1.0}
    assert {r.slot: r.n for r in stats.scale_histogram(h, 2, 1).collect()} == {0: 3, 1: 5, 3: 3}
    u = spark.createDataFrame([(0.0,), (0.125,), (0.25,), (0.5,), (0.75,), (0.99,)], "u double")
    drawn = [r.sample for r in stats.sample_histogram(h, u, F.col("u"), 0.0, 1.0).collect()]
    assert drawn == pytest.approx([0.0, 0.5, 1.0, 1.5, 3.0, 3.96])
    assert stats.sample_histogram(h.where("false"), u, F.col("u"), 0.0, 1.0).where("sample is null").count() == 6


def test_approximate_quantiles(spark):
    got = stats.quantiles(spark.range(1, 1001).select(F.col("id").cast("double").alias("x")), "x", [0.25, 0.9], accuracy=1000).first()
    assert abs(got.q25 - 250) <= 2 and abs(got.q90 - 900) <= 2


def test_families_against_sums_and_integrals():
    f = distributions.FAMILIES
    pois = lambda k, mu: math.exp(k * math.log(mu) - mu - math.lgamma(k + 1))
    for mu in (0.3, 4.0, 60.0):
        for k in (0, 1, 5, 40, 100):
            assert f["poisson"](np.array([float(k)]), mu)[0] == pytest.approx(sum(pois(i, mu) for i in range(k + 1)), abs=1e-12)
    for n, p in ((10, 0.3), (1, 0.5), (200, 0.9)):
        for k in (0, 1, 5, 9, 180):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))
            assert f["binomial"](np.array([float(k)]), n, p)[0] == pytest.approx(want, abs=1e-12)
    integral = lambda g, a, b, n=20_000: sum(g(a + (b - a) * (i + 0.5) / n) for i in range(n)) * (b - a) / n
    density = lambda t, nu: math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi) * (1 + t * t / nu) ** (-(nu + 1) / 2)
    for nu in (1.0, 4.0, 30.0):
        for x in (-2.0, 0.0, 0.7, 3.0):
            assert f["t"](np.array([x]), nu)[0] == pytest.approx(0.5 + integral(lambda t: density(t, nu), 0, x), abs=1e-7)
    assert f["chisq"](np.array([2.0, -1.0]), 2.0) == pytest.approx([1 - math.exp(-1), 0]) and f["gamma"](np.array([3.0]), 1.0, 2.0)[0] == pytest.approx(1 - math.exp(-1.5))
    assert f["beta"](np.array([0.0, 0.3, 1.0]), 2.0, 3.0) == pytest.approx([0, 0.3483, 1]) and f["F"](np.array([1.0, 0.0]), 5.0, 5.0) == pytest.approx([0.5, 0])
    assert f["erlang"](np.array([1.0]), 1.0, 1.0)[0] == pytest.approx(1 - math.exp(-1))


def test_variates_follow_their_distributions(spark):
    ids = spark.range(20_000)
    cases = {"uniform": (2.0, 5.0), "gaussian": (0.0, 2.0), "lognormal": (0.2, 0.5), "exponential": (4.0,), "laplace": (0.0, 2.0), "logistic": (0.0, 2.0), "cauchy": (3.0,), "rayleigh": (2.0,), "weibull": (3.0, 2.0), "pareto": (1.5, 2.0), "gumbel": (0.5, 2.0)}
    for kind, args in cases.items():
        x = ids.select(distributions.variate(kind, F.col("id"), 5, *args).alias("x"))
        shape = args[1:] if kind in ("gaussian", "laplace", "logistic") else args
        p = sorted(r.p for r in x.select(distributions.cdf(kind, F.col("x"), *shape).alias("p")).collect())
        assert max(abs(v - (i + 0.5) / len(p)) for i, v in enumerate(p)) < 0.015, kind  # Kolmogorov's distance
    means = ids.select(*[F.avg(distributions.variate(k, F.col("id"), 5, *a)).alias(k) for k, a in {"poisson": (4.5,), "binomial": (20.0, 0.3), "geometric": (0.25,), "bernoulli": (0.3,)}.items()]).first()
    assert (means.poisson, means.binomial, means.geometric, means.bernoulli) == (pytest.approx(4.5, abs=0.06), pytest.approx(6, abs=0.06), pytest.approx(4, abs=0.1), pytest.approx(0.3, abs=0.015))
    assert ids.select(distributions.cdf("poisson", F.col("id"), 4.0).alias("p")).where("p < 0 or p > 1").count() == 0


def test_exact_quantiles_by_ranks(spark):
    """Groups of one to many rows, a value that most rows have, nulls, a group without values, and a null group."""
    rng = np.random.default_rng(8)
    values = {"a": rng.standard_normal(501).tolist(), "b": [2.5] * 400 + rng.integers(0, 9, 100).astype(float).tolist(), "c": [7.0], None: [1.0, 4.0], "d": []}
    rows = [(g, v) for g, vs in values.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    shares = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {r.g: [r[f"q{round(100 * s)}"] for s in shares] for r in stats.quantiles(df, "v", shares, ["g"]).collect()}
    assert got.keys() == values.keys() and got["d"] == [None] * 5
    for g, vs in values.items():
        if vs:
            assert got[g] == pytest.approx([float(np.quantile(vs, s)) for s in shares], abs=1e-12)
    everything = [v for vs in values.values() for v in vs]
    assert list(stats.quantiles(df, "v", shares).first()) == pytest.approx([float(np.quantile(everything, s)) for s in shares], abs=1e-12)


@pytest.mark.parametrize("kind, args", [("uniform", (2.0, 5.0)), ("exponential", (4.0,)), ("laplace", (2.0,)), ("logistic", (2.0,)), ("cauchy", (2.0,)), ("rayleigh", (2.0,)), ("weibull", (3.0, 2.0)), ("pareto", (1.5, 2.0)), ("gumbel", (3.0, 2.0)), ("gumbel2", (3.0, 2.0)), ("geometric", (0.3,))])
def test_quantile_functions_are_inverses(spark, kind, args):
    rows = spark.range(1, 1000).select((F.col("id") / 1000).alias("p"))
    x = distributions.quantile(kind, F.col("p"), *args)
    got = rows.select("p", distributions.cdf(kind, x, *args).alias("back"), distributions.cdf(kind, x - 1, *args).alias("below")).collect()
    assert all(r.below < r.p + 1e-12 and r.back >= r.p - 1e-12 for r in got) if kind == "geometric" else all(abs(r.back - r.p) < 1e-9 for r in got)
    outside = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,)], "p double").select(distributions.quantile(kind, F.col("p"), *args).alias("x"))
    assert all(r.x is None for r in outside.collect())


def test_a_frequent_group_is_dealt_to_all_tasks(spark):
    """Nearly all rows are of one group; each task of the join has its share of them, and every row meets its group once."""
    rows = spark.range(8000).select("id", F.when(F.col("id") % 1000 == 0, "rare").otherwise("often").alias("g"))
    groups = rows.groupBy("g").agg(F.avg("id").alias("m"))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(kept, ("-1", "false", "16"), strict=True):
            spark.conf.set(c, v)
        found = stats.with_groups(rows, groups, ["g"]).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert sum(r["count"] for r in found) == 8000 and max(r["count"] for r in found) < 4000
    assert sorted(stats.with_groups(rows, groups, ["g"]).collect()) == sorted(rows.join(groups, "g").select("g", "id", "m").collect())

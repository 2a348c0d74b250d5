import numpy as np
import pyspark.sql.functions as F
import pytest

from tessella.functions.distances import BLOCK_DISTANCES
from tessella.functions.transport import UNCOMPARED, dual, emd, myemd, relaxed
from tessella.operators import adaptive, batch, fusion, lsh, search, sets
from tessella.plans.catalog import Environment
from tessella.plans.similarity import SimilarityPlan, similarity_search
from tessella.plans.images import image_regions
from tessella.queries import media
from tessella.queries import search as _search_queries  # noqa: F401 - registers them
from tessella.queries.common import QUERIES, vectors
from tessella.session import materialize
from tessella.sources.features import VecConfig, import_features, parse_features, read_truth, truth_lines


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    x = np.concatenate((base, base + 0.02 * rng.standard_normal(base.shape)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()


def test_knn_equals_brute_force(planted):
    x, table = planted
    got = {}
    for r in search.knn(table, table.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q, hits in got.items():
        d = np.round(np.sqrt(((x - x[q]) ** 2).sum(axis=1)), 6)
        assert [i for _, i in sorted(hits)] == np.lexsort((np.arange(len(x)), d))[:5].tolist()


def test_broadcast_and_blocks_agree(planted, monkeypatch):
    _, table = planted
    queries = table.where("vec_id % 7 = 0")
    near, within = (sorted(map(tuple, f.collect())) for f in (search.knn(table, queries, 4), search.range_search(table, queries, 1.2)))
    monkeypatch.setattr(search, "HELD", 10)
    assert sorted(map(tuple, search.knn(table, queries, 4).collect())) == near
    monkeypatch.setattr(search, "BROADCAST_VALUES", 0)
    assert sorted(map(tuple, search.knn(table, queries, 4).collect())) == near
    assert sorted(map(tuple, search.range_search(table, queries, 1.2).collect())) == within


def test_knn_with_few_rows_and_none(spark, planted):
    _, table = planted
    assert search.knn(table.where("vec_id < 3"), table.where("vec_id = 0"), 10).count() == 3
    assert search.knn(table.where("vec_id < 0"), table.where("vec_id = 0"), 10).count() == 0
    assert search.knn(table, table.where("vec_id < 0"), 10).count() == 0


def test_range_is_strict(spark):
    table = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [2.0]), (3, None)], "vec_id long, embedding array<double>")
    got = search.range_search(table, table.where("vec_id = 0"), 2.0).collect()
    assert sorted(r.id for r in got) == [0, 1]
    some = spark.createDataFrame([(0, 1), (0, 2), (0, 99)], "query_id long, id long")
    assert [r.id for r in search.range_in_candidates(some, table, table, 2.0).collect()] == [1]


def test_recall_and_precision_goldens(spark):
    truth = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "query_id long, rank int, id long")
    results = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 3, 9)], "query_id long, rank int, id long")
    assert search.recall_at_k(truth, results, 3).first().recall == pytest.approx(2 / 3)
    assert search.precision_at_k(truth, results, 3).first().precision == pytest.approx(2.5 / 3)


def test_lsh_finds_planted_and_recall_grows(planted):
    _, table = planted
    params = lsh.LshParams(D=16, M=6, L=8, W=2.0, H=997, seed=5)
    queries = table.where("vec_id < 60")
    found = {r.query_id: r.id for r in lsh.lsh_knn(table, queries, params, 2).where("id != query_id").collect()}
    assert sum(found.get(q) == q + 60 for q in range(60)) >= 57
    sizes = [lsh.probe(lsh.build_index(table, params), queries, params, t, p).count() for t, p in ((2, 0), (8, 0), (8, 10))]
    assert sizes[0] <= sizes[1] <= sizes[2]
    table_ids = {r.vec_id for r in table.collect()}
    assert all(r.id in table_ids for r in lsh.lsh_recall_knn(table, queries, params, 3, 0.9).collect())


@pytest.mark.parametrize("width, dense", [(0.4, 16), (2.0, 16), (2.0, 1 << 20), (2.0, 0), (50.0, 16)])
def test_streamed_lsh_equals_the_index(spark, planted, monkeypatch, width, dense):
    """Few hits, many and all rows; copies of vectors; rows without a vector; lists of tables; several blocks and passes."""
    x, table = planted
    table = table.unionByName(table.where("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 1000)).unionByName(table.where("vec_id < 40").select(F.col("vec_id") + 2000, F.array(*[F.lit(float(v)) for v in x[0]]).alias("embedding")).toDF("vec_id", "embedding"))
    table = table.unionByName(spark.createDataFrame([(5000, None)], table.schema)).coalesce(2)
    queries = table.where("vec_id % 2 = 0")
    params = lsh.LshParams(D=16, M=6, L=8, W=width, H=997, seed=5)
    index = lsh.build_index(table, params)
    for name, value in (("QUERIES", 7), ("FIRST_ROWS", 8), ("MOST_ROWS", 32), ("TESTED", 100), ("DENSE", dense)):
        monkeypatch.setattr(lsh, name, value)
    for tables, probes in ((None, 3), (5, 0), ([6, 2], 4)):
        joined = sorted(map(tuple, lsh.lsh_knn(table, queries, params, 4, tables, probes, index).collect()))
        assert sorted(map(tuple, lsh.lsh_knn(table, queries, params, 4, tables, probes).collect())) == joined and joined
    monkeypatch.setattr(lsh, "BROADCAST_VALUES", 2000)
    assert sorted(map(tuple, lsh.lsh_knn(table, queries, params, 4, [6, 2], 4).collect())) == joined
    assert lsh.lsh_knn(table, queries.where("vec_id < 0"), params, 4).count() == 0 == lsh.lsh_knn(table.where("vec_id < 0"), queries, params, 4).count()


def test_lsh_shuffles_no_pairs(spark, shuffled):
    """All rows share a bucket with all queries: 1.6 million pairs, of which 3 a query leave a task."""
    rng = np.random.default_rng(9)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((4000, 4)))], "vec_id long, embedding array<double>")
    hits = lsh.lsh_knn(table, table.where("vec_id % 10 = 0"), lsh.LshParams(D=4, M=2, L=2, W=1000.0, H=997), 3).collect()
    assert len(hits) == 1200 and shuffled() < 1


def test_many_queries_meet_their_buckets(spark, planted, monkeypatch):
    """More queries than are broadcast, all rows in one bucket: the same result as by broadcast; the index goes."""
    _, table = planted
    params, queries = lsh.LshParams(D=16, M=2, L=2, W=1000.0, H=997), table.where("vec_id % 10 = 0")
    want = sorted(map(tuple, lsh.lsh_knn(table, queries, params, 3).collect()))
    monkeypatch.setattr(lsh, "BROADCAST_VALUES", 50)
    got = lsh.lsh_knn(table.repartition(4), queries, params, 3)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 36
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tessella_index_")]


@pytest.mark.parametrize("block_rows", [60, 1 << 16])
def test_batch_index_equals_the_joined_one(spark, planted, block_rows):
    """Blocks of few rows, with hot buckets in many parts, and one block; tables by number; copies and rows without a vector."""
    x, table = planted
    table = table.unionByName(table.where("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 1000)).unionByName(spark.createDataFrame([(5000, None)], table.schema))
    queries = table.where("vec_id % 5 = 0")
    for width in (0.4, 2.0, 50.0):
        params = lsh.LshParams(D=16, M=6, L=8, W=width, H=997, seed=5)
        index = batch.save_batch_index(table, params, block_rows=block_rows)
        joined = lsh.build_index(table, params)
        for tables, probes in ((None, 0), ([6, 2], 4)):
            want = sorted(map(tuple, lsh.lsh_knn(table, queries, params, 4, tables, probes, joined).collect()))
            assert sorted(map(tuple, batch.batch_knn(index, queries, 4, probes, tables).collect())) == want and want
        assert bool(index.parts) == (width == 50.0 and block_rows < 1 << 16) or width < 50.0
        assert batch.batch_knn(index, queries.where("false"), 4).count() == 0
        batch.drop_index(spark, index)


def test_batch_index_shuffles_a_vector_once(spark, shuffled):
    """However many tables there are, and buckets that queries ask for; a table beyond DIRECT buckets and several passes find the same."""
    rng = np.random.default_rng(9)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((4000, 14)))], "vec_id long, embedding array<double>")
    index = batch.save_batch_index(table, lsh.LshParams(D=14, M=6, L=16, W=4.0, H=1_000_003), block_rows=500)
    assert shuffled() < 2
    hits = sorted(map(tuple, batch.batch_knn(index, table.where("vec_id % 10 = 0"), 3, 30).collect()))
    assert len(hits) == 1200 and shuffled() < 1
    batch.drop_index(spark, index)


def test_batch_passes_and_wide_tables_agree(spark, planted, monkeypatch):
    _, table = planted
    queries, params = table.where("vec_id % 5 = 0"), lsh.LshParams(D=16, M=4, L=3, W=2.0, H=997, seed=5)
    index = batch.save_batch_index(table, params, block_rows=50)
    want = sorted(map(tuple, batch.batch_knn(index, queries, 4, 5).collect()))
    for name, value in (("BROADCAST_VALUES", 200), ("DIRECT", 0), ("PAIRS", 10), ("ASKED", 40)):
        monkeypatch.setattr(batch, name, value)
    assert sorted(map(tuple, batch.batch_knn(index, queries, 4, 5).collect())) == want and want
    batch.drop_index(spark, index)


@pytest.fixture(scope="module")
def regions(spark):
    """(image, vec_id, embedding) of the regions of 2,000 images."""
    rows = image_regions(media._images(spark, "/root/testdata/sf0.1"), side=32)
    made = rows.select(F.col("name").cast("long").alias("image"), (F.col("name").cast("long") * 1000 + F.col("region")).alias("vec_id"), F.col("features").alias("embedding"))
    return materialize(made, "test-regions")


def test_rows_read_grow_slower_than_the_pairs(spark, regions):
    """Three sizes: a query reads ever less of the table, at a recall of 0.9 or more; boosted and stopped searches read less than the plain one for what they find."""
    share = []
    for images in (500, 1000, 2000):
        table = regions.where(f"image < {images}").drop("image")
        queries = table.where("(vec_id div 1000) % 50 = 0")
        params = batch.fitted_width(table, media.REGION_PARAMS, 10, 0.95, 30)
        index = batch.save_batch_index(table, params, block_rows=20_000)
        true = {(r.query_id, r.id) for r in search.knn(table, queries, 10).collect()}
        recall = lambda found: len(true & {(r.query_id, r.id) for r in found.collect()}) / len(true)
        read = lambda found: found.agg(F.sum("pairs")).first()[0] / queries.count()
        assert recall(batch.batch_knn(index, queries, 10, 30)) >= 0.9
        pairs = read(batch.batch_knn(index, queries, 10, 30, work=True))
        share.append(pairs / table.count())
        if images == 1000:
            assert recall(adaptive.local_knn(index, queries, 10, probes=30)) >= 0.9
            assert read(adaptive.local_knn(index, queries, 10, probes=30, work=True)) < 0.8 * pairs
            fixed, boosted = batch.batch_knn(index, queries, 10, 15), adaptive.boosted_knn(index, queries, 10, 15)
            assert recall(boosted) >= max(0.9, recall(fixed)) - 1e-3
            assert read(adaptive.boosted_knn(index, queries, 10, 15, work=True)) < 1.05 * read(batch.batch_knn(index, queries, 10, 15, work=True))
        batch.drop_index(spark, index)
    assert share[1] < 0.8 * share[0] and share[2] < 0.8 * share[1]


def test_local_law_solves_its_equations():
    """What is seen of the law found is the law that was seen; a search that finds everything sees the truth."""
    params = lsh.LshParams(D=14, M=14, L=8, W=0.9)
    a, b = np.meshgrid(np.linspace(-6, -1, 6), np.linspace(0.1, 0.9, 5), indexing="ij")
    log_alpha, beta, residual = adaptive.true_law(params, 10, a, b, 30)
    solved = residual < 1e-6
    assert solved.mean() > 0.7
    seen = adaptive.found_law(params, 10, log_alpha, beta, 30)
    assert np.abs(np.stack(seen) - np.stack((a, b)))[:, solved].max() < 1e-5
    near = adaptive.found_law(params, 10, np.array([-12.0]), np.array([0.3]), 30)
    assert abs(near[0][0] + 12) < 1e-2 and abs(near[1][0] - 0.3) < 1e-2


def test_lsh_tables_and_buckets(spark, planted):
    _, table = planted
    queries = table.where("vec_id % 50 = 0")
    params = lsh.LshParams(D=16, M=6, L=8, W=2.0, H=997, seed=5)
    index = lsh.build_index(table, params)
    bitmaps = lsh.bucket_bitmaps(index)
    counted = {(r.table_no, r.bucket): r.n for r in bitmaps.groupBy("table_no", "bucket").agg(F.sum(F.bitmap_count("bitmap")).alias("n")).collect()}
    assert counted == {(r.table_no, r.bucket): r["count"] for r in index.groupBy("table_no", "bucket").count().collect()}
    truth = search.knn(table, queries, 3)
    best = lsh.best_tables(index, queries, truth, params, 3)
    found = lambda tables: lsh.probe(index, queries, params, tables).join(truth.select("query_id", "id"), ["query_id", "id"]).count()
    assert len(set(best)) == 3 and found(best) >= found([0, 1, 2]) and found(best[:1]) == max(found([t]) for t in range(8))
    assert lsh.tune(params, 0.05, 0.9) < lsh.tune(params, 2.0, 0.9) and lsh.tune(params, 50.0, 0.99, most=7) == 7


def test_lsh_hash_wraps_and_perturbations():
    params = lsh.LshParams(D=2, M=2, L=1, W=1.0, H=1000)
    negative = np.array([[[-1, 5]]])
    w = [int(v) for v in params.weights[0]]
    assert params.buckets(negative)[0, 0] == ((w[0] * 0xFFFFFFFF + w[1] * 5) % 2**32) % 1000
    sets_ = lsh.perturbations(4, 20)
    assert len(sets_) == len(set(sets_)) == 20 and sets_[0] == (0,)
    assert all(7 - p not in s for s in sets_ for p in s)
    buckets = lsh.probe_buckets(params, np.array([[0.3, 0.7]]), 1, 3)
    assert buckets.shape == (1, 1, 4) and buckets[0, 0, 0] == params.buckets(params.hashes(np.array([[0.3, 0.7]])))[0, 0]


def test_recall_model_is_monotone():
    model = lsh.recall_table(lsh.LshParams(D=4, M=5, L=4, W=2.0), 8)
    assert (np.diff(model, axis=0) >= -1e-12).all() and (np.diff(model, axis=1) <= 1e-9).all()
    assert ((model >= 0) & (model <= 1)).all()


def test_set_distances(spark):
    vecs = spark.createDataFrame([(0, 0, 0.4, [0.0]), (1, 0, 0.6, [10.0]), (2, 1, 1.0, [0.0])], "vec_id long, vecset_id long, weight double, features array<double>")
    s = sets.as_sets(vecs)
    pairs = spark.createDataFrame([(0, 1), (1, 0), (0, 0)], "query_id long, id long")
    for name in ("emd", "myemd"):
        got = {(r.query_id, r.id): r.dist for r in sets.set_distances(pairs, s, name).collect()}
        assert got == {(0, 1): 6.0, (1, 0): 6.0, (0, 0): 0.0}
    assert sets.set_distances(pairs.limit(1), s, "single").first().dist == 0.0
    assert sets.normalised(vecs).groupBy("vecset_id").agg(F.sum("weight").alias("w")).where("abs(w - 1) > 1e-9").count() == 0


def test_emd_equals_the_simplex_below_zero():
    rng = np.random.default_rng(4)
    for n, m in rng.integers(1, 9, (200, 2)):
        cost, a, b = rng.random((n, m)) - 0.3, rng.random(n), rng.random(m)
        assert emd(a, b, cost) == pytest.approx(myemd(a, b, cost), abs=1e-9)


@pytest.mark.parametrize("vec_dist, equal", [("L2_float", True), ("L2_float", False), ("L1_float", False), ("cosine", False)])
def test_transport_bounds_are_below_the_distance(vec_dist, equal):
    """Regions without weight, objects of other weights, padding; the dual bound is close."""
    rng, close = np.random.default_rng(4), []
    for _ in range(300):
        n, m, d = (int(x) for x in rng.integers(1, 8, 3))
        a, b = (rng.random(x) * (rng.random(x) > 0.1) for x in (n, m))
        if equal and a.sum() * b.sum() > 0:
            a, b = a / a.sum(), b / b.sum()
        cost = BLOCK_DISTANCES[vec_dist](rng.standard_normal((n, d)), rng.standard_normal((m, d)))
        want = emd(a, b, cost)
        padded, wide = np.append(b, 0.0)[None], np.pad(cost, ((0, 0), (0, 1)))[None]
        near, back = np.where(padded[0] > 0, wide[0], UNCOMPARED).min(axis=1), wide[0][a > 0].min(axis=0, initial=UNCOMPARED)
        low, coarse = dual(a, padded, wide)[0], dual(a, padded, wide, 0)[0]
        assert relaxed(a, padded, near[None], back[None])[0] <= want + 1e-9 and max(low, coarse) <= want + 1e-9
        if equal and want > 0.1:
            close.append(low / want)
    assert not equal or np.mean(close) > 0.95


def test_totals_that_differ_by_rounding_are_equal():
    """Weights of images sum to 1 but for rounding: the bounds are those of equal totals, and still below the distance."""
    rng = np.random.default_rng(6)
    gained = 0
    for _ in range(100):
        a, b = rng.random(6), rng.random(7)
        a, b = a / a.sum(), b / b.sum()
        a *= (1 + 3e-16) / a.sum()
        b *= (1 - 3e-16) / b.sum()
        cost = BLOCK_DISTANCES["L2_float"](rng.standard_normal((6, 3)), rng.standard_normal((7, 3)))
        sided = relaxed(a, b[None], cost.min(axis=1)[None], cost.min(axis=0)[None])[0]
        assert sided == pytest.approx(max(a @ cost.min(axis=1), b @ cost.min(axis=0)), abs=1e-12)
        coarse = dual(a, b[None], cost[None], 0)[0]
        assert sided <= coarse + 1e-9 and coarse <= emd(a, b, cost) + 1e-9
        gained += coarse > sided + 1e-3
    assert gained > 50


@pytest.mark.parametrize("vec_dist, scale, unlike", [("L2_float", 1.0, False), ("L2_float", 1e13, False), ("L1_float", 1.0, True), ("L2_float", 1.0, True)])
def test_likely_sets_and_shared_queries(spark, monkeypatch, vec_dist, scale, unlike):
    """Queries shared out to tasks, large features far from the origin, regions and objects without weight: as brute force; likely objects hold most of the nearest, and no dual bound is above its distance."""
    monkeypatch.setattr(sets, "SHARE", 2)
    rng = np.random.default_rng(12)
    rows, objects = [], {}
    for o in range(120):
        n = int(rng.integers(1, 9))
        w = rng.integers(0, 4, n) + 0.0 if unlike else rng.dirichlet(np.ones(n))
        objects[o] = w, (rng.standard_normal((n, 5)) + 40) * scale
        rows += [(100 * o + i, o, float(w[i]), objects[o][1][i].tolist()) for i in range(n)]
    packed = materialize(sets.as_sets(spark.createDataFrame(rows, "vec_id long, vecset_id long, weight double, features array<double>").repartition(3)), "sets")
    asked = packed.where("vecset_id % 10 = 0")
    dist = {(q, o): round(emd(objects[q][0], w, BLOCK_DISTANCES[vec_dist](objects[q][1], f)), 6) for q in range(0, 120, 10) for o, (w, f) in objects.items()}
    want = {q: sorted((dist[q, o], o) for o in objects)[:4] for q in range(0, 120, 10)}
    got = {(r.query_id, r["rank"]): (r.dist, r.id) for r in sets.nearest_sets(packed, asked, 4, vec_dist=vec_dist).collect()}
    assert {k: v[1] for k, v in got.items()} == {(q, r): o for q in want for r, (_, o) in enumerate(want[q], 1)}
    assert all(d == pytest.approx(dist[q, o], rel=1e-12, abs=1e-6) for (q, _), (d, o) in got.items())
    likely = sets.nearest_sets(packed, asked, 12, vec_dist=vec_dist, likely=True).collect()
    assert len(likely) == 12 * 12 and all(r.dist <= dist[r.query_id, r.id] + 1e-6 for r in likely)
    held = {(r.query_id, r.id) for r in likely}
    assert sum((q, o) in held for q in want for _, o in want[q]) > 36


@pytest.mark.parametrize("vec_dist", ["L2_float", "L1_float"])
def test_exact_search_equals_brute_force(spark, monkeypatch, vec_dist):
    """Objects of one to nine regions of unequal weights, copies, empty features, several passes; limits are at least the k-th distance."""
    rng = np.random.default_rng(11)
    rows, objects = [], {}
    for o in range(150):
        n = int(rng.integers(1, 10))
        w, f = (rng.integers(1, 4, n).astype(float), rng.standard_normal((n, 6))) if o < 140 else objects[o - 100]
        objects[o] = w, f
        rows += [(100 * o + i, o, float(w[i]), f[i].tolist()) for i in range(len(w))]
    packed = materialize(sets.as_sets(spark.createDataFrame(rows, "vec_id long, vecset_id long, weight double, features array<double>").repartition(3)), "sets")
    asked = packed.where("vecset_id % 10 = 0")
    want = set()
    for q in range(0, 150, 10):
        near = sorted((round(emd(objects[q][0], w, BLOCK_DISTANCES[vec_dist](objects[q][1], f)), 6), o) for o, (w, f) in objects.items())[:4]
        want |= {(q, o, d, r) for r, (d, o) in enumerate(near, 1)}
    limits = spark.createDataFrame([(q, max(d for p, _, d, _ in want if p == q)) for q in range(0, 150, 20)], "query_id long, far double")
    search_ = lambda **k: {tuple(r) for r in sets.nearest_sets(packed, asked, 4, vec_dist=vec_dist, **k).collect()}
    assert search_() == search_(limits=limits) == want
    seen = sets.nearest_sets(packed, asked, 4, vec_dist=vec_dist, work=True).agg(F.sum("seen"), F.sum("solved")).first()
    assert seen[0] == 15 * 150 and seen[1] < 1500
    monkeypatch.setattr(sets, "BROADCAST_VALUES", 300)
    assert search_(set_dist="myemd") == want
    with pytest.raises(ValueError):
        sets.nearest_sets(packed, asked, 4, set_dist="assign")


def test_flagship_misses_nothing(spark):
    """The ten nearest objects of each one whose id is divisible by 50, against earth mover's distances of all pairs."""
    path = "/root/testdata/sf0.01"
    objects = {r.vecset_id: (np.array([v.weight for v in r.vecs]), np.array([v.features for v in r.vecs])) for r in sets.as_sets(vectors(spark, path)).collect()}
    want = set()
    for q in (o for o in objects if o % 50 == 0):
        near = sorted((round(emd(objects[q][0], w, BLOCK_DISTANCES["L2_float"](objects[q][1], f)), 6), o) for o, (w, f) in objects.items())[:10]
        want |= {(q, o, d, r) for r, (d, o) in enumerate(near, 1)}
    assert {tuple(r) for r in QUERIES["similarity_search"](spark, path).collect()} == want


@pytest.mark.parametrize("name", ["lsh_knn", "lsh_multiprobe", "lsh_recall"])
def test_index_queries_reach_their_recall(spark, name):
    path = "/root/testdata/sf0.01"
    true = {(r.query_id, r.id) for r in QUERIES["knn_l2"](spark, path).collect()}
    found = {(r.query_id, r.id) for r in QUERIES[name](spark, path).collect()}
    assert len(true & found) >= 0.9 * len(true)


def test_similarity_search_finds_itself(planted, spark):
    _, table = planted
    vecs = table.select("vec_id", F.expr("vec_id div 2").alias("vecset_id"), F.lit(1.0).alias("weight"), F.col("embedding").alias("features"))
    asked = vecs.where("vecset_id < 5").select("vecset_id")
    hits = similarity_search(vecs, asked, lsh.LshParams(D=16, M=6, L=8, W=2.0, H=997), SimilarityPlan(k=3)).collect()
    first = {r.query_id: (r.id, r.dist) for r in hits if r["rank"] == 1}
    assert first == {q: (q, 0.0) for q in range(5)}
    assert {(r.query_id, r.id) for r in hits} >= {(q, q + 30) for q in range(5)}


@pytest.mark.parametrize("values", [1 << 22, 100])
def test_ranking_past_broadcast_candidates_equals_joins(planted, spark, monkeypatch, values):
    _, table = planted
    monkeypatch.setattr(sets, "BROADCAST_VALUES", values)  # 100 numbers: 37 passes
    vecs = table.select("vec_id", F.expr("vec_id div 3").alias("vecset_id"), (1.0 + F.col("vec_id") % 2).alias("weight"), F.col("embedding").alias("features"))
    packed = sets.as_sets(vecs)
    assert sorted(map(str, sets.unpacked(packed).collect())) == sorted(map(str, vecs.collect()))
    asked = packed.where("vecset_id % 4 = 1")
    pairs = asked.select(F.col("vecset_id").alias("query_id")).crossJoin(packed.select(F.col("vecset_id").alias("id")).where("id % 3 > 0"))
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "id", "dist", "rank").collect())
    joined = rows(sets.rank_sets(pairs, packed, 4))
    assert rows(sets.rank_sets(pairs.union(pairs), packed, 4, queries=asked)) == joined and len(joined) == 40


def test_bitmaps_samples_append(spark):
    ids = spark.range(100_000).select("id")
    assert search.bitmap_count(search.bitmap_union(search.bitmap_of(ids), search.bitmap_of(ids.where("id < 10")))).first().ids == 100_000
    assert search.bitmap_count(search.bitmap_of(ids.where("id < 0"))).first().ids == 0
    assert search.sample_percent(ids, 100, "id").count() == 100_000
    assert 500 < search.sample_percent(ids, 0, "id").count() < 1500
    lines = search.result_lines(spark.createDataFrame([(7, 1, 0.5, 1, "a"), (7, 2, 1.0, 2, "b")], "query_id long, id long, dist double, rank int, name string"))
    assert lines.first().line == "a:0.500000\tb:1.000000\t\t7"


FEATURES = "# comment\nobj a\t2\n0.25\t1 2 3\n0.75\t4 5 6\nobj b\t1\n1\t7 8 9\n"


def test_environment(spark, tmp_path):
    (tmp_path / "f.txt").write_text(FEATURES)
    env = Environment(spark, str(tmp_path / "env"))
    env.add_config(VecConfig("c", dim=3))
    env.create_table("t", "c")
    env.import_file("t", str(tmp_path / "f.txt"))
    env.associate("t", "i", "lsh", "-M 2 -L 2 -H 101 -w 4.0")
    env.import_file("t", str(tmp_path / "f.txt"))
    env.checkpoint()
    again = Environment(spark, str(tmp_path / "env"), create=False)
    assert again.vecs("t").count() == 6 and again.vecsets("t").count() == 4
    assert again.vecs("t").select("vec_id").distinct().count() == 6
    q = again.vecs("t").where("vecset_id = 3")
    exact, near = again.query("t", q, 2).collect(), again.query("t", q, 2, "i", "-L 2").collect()
    assert {r.id for r in exact} == {r.id for r in near} and all(r.dist == 0 for r in exact)
    again.register_views()
    assert spark.sql("select count(*) from t_vecs").first()[0] == 6
    assert again.describe().where("kind = 'table'").count() == 1
    tuned = again.tune("t", "i", 1.0, 0.9)
    assert tuned.startswith("-L 2 -T ") and again.query("t", q, 2, "i", tuned).count() == len(near)
    folders = [p for p in (tmp_path / "env").iterdir() if p.name.startswith("t-i-")]
    again.release("t", "i")
    assert len(folders) == 2 and not any(p.exists() for p in folders) and not Environment(spark, str(tmp_path / "env")).tables["t"].indexes
    assert [p.name for p in (tmp_path / "env").iterdir() if p.name.startswith("catalog")] == ["catalog-000000000001.json"]
    again.export_file("t", str(tmp_path / "export"))
    _, back = import_features(spark, str(tmp_path / "export"), VecConfig(dim=3))
    assert sorted(r.name for r in back.collect()) == ["obj a", "obj a", "obj b", "obj b"]
    again.drop_table("t")
    with pytest.raises(FileNotFoundError):
        Environment(spark, str(tmp_path / "nothing"), create=False)


def test_feature_parsing():
    assert parse_features("0\t1\n1\t0101\n", VecConfig(vec_type="bit", dim=4)) == [("0", [(1.0, [0, 1, 0, 1])])]
    for bad in ("a\t2\n1\t1 2 3\n", "a\t1\n1\t1 2\n"):
        with pytest.raises(ValueError):
            parse_features(bad, VecConfig(dim=3))
    with pytest.raises(ValueError):
        parse_features(FEATURES, VecConfig(dim=3, vecset_type="single"))


def test_truth_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(5, 1, 9, 0.5), (5, 2, 8, 1.5)], "query_id long, rank int, id long, dist double")
    truth_lines(rows).select("line").write.text(str(tmp_path / "truth"))
    assert sorted(read_truth(spark, str(tmp_path / "truth")).collect()) == sorted(rows.collect())


def test_fusion(spark):
    lists = [spark.createDataFrame(rows, "query_id long, id long, rank int") for rows in ([(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 9, 1)], [(0, 3, 1), (0, 1, 2), (0, 4, 3)], [(0, 4, 1), (0, 5, 2)])]
    got = lambda *a, **k: sorted(((r.query_id, r["rank"]), r.id, r.votes, r.score) for r in fusion.fuse(*a, **k).collect())
    assert got(lists[:2], "and") == [((0, 1), 1, 2, 3), ((0, 2), 3, 2, 4)] and got(lists, "and") == []
    assert got(lists, "or", 3) == [((0, 1), 1, 2, 1), ((0, 2), 3, 2, 1), ((0, 3), 4, 2, 1), ((1, 1), 9, 1, 1)]
    assert got(lists, "vote", least_votes=2) == [((0, 1), 1, 2, 3), ((0, 2), 3, 2, 4), ((0, 3), 4, 2, 4)]
    with pytest.raises(ValueError):
        fusion.fuse(lists, "xor")


@pytest.mark.parametrize("k, depth", [(3, None), (3, 3), (10, 11), (200, 5)])
def test_threshold_search_equals_brute_force(planted, k, depth):
    """Lists that suffice at once, that must be doubled, and that have fewer rows than asked for; copies are ties."""
    x, table = planted
    weights, queries = {"L2_float": 0.3, "L1_float": 1.0}, table.where("vec_id % 17 = 0")
    got = {tuple(r) for r in fusion.threshold_knn(table, queries, k, weights, depth).collect()}
    want = set()
    for q in range(0, len(x), 17):
        d2, d1 = (np.round(f(x[q : q + 1], x)[0], 6) for f in (BLOCK_DISTANCES["L2_float"], BLOCK_DISTANCES["L1_float"]))
        score = np.round(0.3 * d2 + d1, 6)
        want |= {(q, int(i), float(score[i]), r) for r, i in enumerate(np.lexsort((np.arange(len(x)), score))[:k], 1)}
    assert len(got) == len(want) and {g[:2] for g in got} == {w[:2] for w in want}
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(sorted(got), sorted(want), strict=True))
    assert fusion.threshold_knn(table, queries.where("false"), k, weights).count() == 0


def test_probes_by_recall_shuffle_no_pairs(spark, shuffled, monkeypatch):
    """A bucket of all rows: 1.6 million pairs, of which 3 a query leave a task, in one pass and in several; no index is saved for many queries."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4000, 4))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries, params = table.where("vec_id % 10 = 0"), lsh.LshParams(D=4, M=2, L=2, W=1000.0, H=997)
    whole = sorted(map(tuple, lsh.lsh_recall_knn(table, queries, params, 3, 0.9).collect()))
    assert len(whole) == 1200 and [r[1] for r in whole if r[0] == 50 and r[3] == 1] == [50] and shuffled() < 1
    monkeypatch.setattr(lsh, "BROADCAST_VALUES", 5000)  # four and six passes
    monkeypatch.setattr("tessella.operators.batch.save_batch_index", None)
    assert sorted(map(tuple, lsh.lsh_recall_knn(table, queries, params, 3, 0.9).collect())) == whole
    assert shuffled() < 1


def test_probes_by_recall_are_each_querys_own(spark, planted):
    """Candidates with the probes of a query, by the joined index; half of the queries have nothing near."""
    _, table = planted
    table = table.where("vec_id < 60 or vec_id % 2 = 1")
    params, queries = lsh.LshParams(D=16, M=6, L=4, W=0.6, H=997, seed=5), table.where("vec_id % 3 = 0")
    index, model = lsh.build_index(table, params), lsh.recall_table(params, 9)
    first = {}
    for r in lsh.lsh_knn(table, queries, params, 2, index=index).collect():
        first.setdefault(r.query_id, []).append(r.dist)
    want, used = set(), set()
    for q in (r.vec_id for r in queries.collect()):
        far = max(first[q]) if len(first.get(q, [])) == 2 else 4.0
        n = int(lsh.probes_for_recall(model, np.array([far]), 0.6, 0.01, 4.0)[0])
        used.add(n)
        want |= {tuple(r) for r in lsh.lsh_knn(table, queries.where(f"vec_id = {q}"), params, 2, None, n, index).collect()} if q < 30 else set()
    got = {tuple(r) for r in lsh.lsh_recall_knn(table, queries, params, 2, 0.6, most=9).collect() if r.query_id < 30}
    assert got == want and len(used) > 1


def test_candidates_by_key_shuffle_no_pairs(spark, shuffled, monkeypatch):
    """One key has nearly all rows; 1.6 million pairs, of which the results leave a task. Rows without key or vector are no candidates."""
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((4000, 8)), 3)
    rows = [(i, v.tolist(), "rare" if i % 100 == 50 else "often") for i, v in enumerate(x)] + [(4000, x[0].tolist(), None), (4010, None, "often")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind string").repartition(4).cache()
    queries, want = table.where("vec_id % 10 = 0"), set()
    table.count()
    for q in range(0, 4000, 10):
        near = sorted((round(float(np.sqrt(((x[q] - x[i]) ** 2).sum())), 6), i) for i in range(4000) if (i % 100 == 50) == (q % 100 == 50))[:3] if q < 200 else []
        want |= {(q, i, d, r) for r, (d, i) in enumerate(near, 1)}
    shuffled()
    got = lambda: {tuple(r) for r in search.rerank_same(table, queries, "kind", 3).collect() if r.query_id < 200}
    assert got() == want and shuffled() < 1
    far = {(q, i) for q, i, d, _ in want if d < 1.0}
    within = lambda: {(r.query_id, r.id) for r in search.range_same(table, queries, "kind", 1.0).collect() if r.query_id < 200}
    assert within() >= far
    pairs = queries.select(F.col("vec_id").alias("query_id"), "kind").join(table.select(F.col("vec_id").alias("id"), "kind"), "kind")
    whole = {(r.query_id, r.id) for r in search.range_in_candidates(pairs, table, queries, 1.0).collect() if r.query_id < 200}
    assert within() == whole
    monkeypatch.setattr(search, "BROADCAST_VALUES", 900)
    assert got() == want and within() == whole

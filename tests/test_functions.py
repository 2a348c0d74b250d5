import itertools
import math

import numpy as np
import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions import codecs, distances, images, rabin
from tessella.functions.params import parse_params
from tessella.functions.transport import assign, emd, myemd


def slow_cuts(b: bytes, w: int = 32, mask: int = 0xFFF) -> list[int]:
    """Byte by byte, from the definition."""
    table, out, c, n = [int(v) for v in rabin.reduction_table()], [], 0, len(b)
    while c < n:
        if n - c < w:
            return [*out, n - c]
        h, end = 0, n
        for i in range(c, n):
            h ^= b[i - w] if i - c >= w else 0
            h = ((h << 8 & 0xFFFFFFFF) | b[i]) ^ table[h >> 24]
            if i - c + 1 >= w and h & mask == 0:
                end = i + 1
                break
        out.append(end - c)
        c = end
    return out


def test_rabin_goldens():
    t = rabin.reduction_table()
    assert [int(t[i]) for i in (0, 1, 2, 255)] == [0, 0x45C2B6A1, 0x8B856D42, 0x66AE4CAF]
    fox = 400 * b"The quick brown fox jumps over the lazy dog. "
    assert rabin.cuts([b"", 31 * b"a", 32 * b"a", bytes(100), fox]) == [[], [31], [32], [32, 32, 32, 4], [9707, 8293]]
    ramp = rabin.cuts([bytes(i % 256 for i in range(65536))])[0]
    assert len(ramp) == 78 and ramp[:6] == [2270, 4091, 458, 1996, 768, 768]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=9000), max_size=4), st.sampled_from([32, 64, 1024]))
def test_rabin_equals_definition(buffers, window):
    assert rabin.cuts(buffers, window) == [slow_cuts(b, window) for b in buffers]


def test_rabin_long_chunk_beyond_table():
    data = b"\x01" * 60_000
    assert rabin.cuts([data])[0] == slow_cuts(data)


def test_codecs_round_trip_and_limit():
    for name, c in codecs.CODECS.items():
        assert c.decompress(c.compress(b"abc" * 100)) == b"abc" * 100
        assert codecs.codec_by_code(c.code) is codecs.codec(name)
    with pytest.raises(ValueError):
        codecs.bounded(codecs.codec("none").decompress, 2)(b"abc")


def test_params():
    assert parse_params("-L 8 - T 20 -W 2.5", L=1, T=0, W=1.0) == {"L": 8, "T": 0, "W": 2.5}
    assert parse_params("-w (1,2,3)", w=[0.0])["w"] == [1.0, 2.0, 3.0]


def test_distances(spark):
    row = spark.createDataFrame([([1, 2, 3], [4, 6, 3], [10], [6])], "a array<int>, b array<int>, x array<int>, y array<int>")
    got = row.select(*[f(F.col("a"), F.col("b")).alias(n) for n, f in distances.VECTOR_DISTANCES.items() if n != "hamming"], distances.hamming(F.col("x"), F.col("y")).alias("h")).first()
    assert (got.L1_float, got.L2_float, got.L2_int, got.L1_int, got.cosine, got.trivial, got.h) == (7, 5, 5, 7, 25, 0, 2)
    assert row.select(distances.l2_int(F.array(F.lit(0), F.lit(0)), F.array(F.lit(1), F.lit(1)))).first()[0] == 1
    assert row.select(distances.l2_threshold(F.col("a"), F.col("b"), 4.9)).first()[0] is None


def test_block_distances_equal_expressions(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 255, 8), rng.integers(0, 255, 8)
    row = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<long>, b array<long>")
    for name, block in distances.BLOCK_DISTANCES.items():
        want = row.select(distances.VECTOR_DISTANCES[name](F.col("a"), F.col("b")).cast("double")).first()[0]
        assert block(a[None].astype(float), b[None].astype(float))[0, 0] == pytest.approx(want)


def test_emd_closed_forms():
    one = np.array([1.0])
    for solve in (emd, myemd):
        assert solve(np.array([0.4, 0.6]), one, np.array([[0.0], [10.0]])) == pytest.approx(6)
        assert solve(one, np.array([0.25, 0.25]), np.array([[3.0, 5.0]])) == pytest.approx(4)
        assert solve(np.zeros(1), one, np.ones((1, 1))) == 0
        assert solve(np.ones(257), one, np.ones((257, 1)), most_regions=256) == 1e20 and solve(np.ones(257), one, np.ones((257, 1))) == pytest.approx(1)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.integers(1, 7), st.integers(0, 10_000), st.booleans())
def test_emd_solvers_agree(n, m, seed, ties):
    rng = np.random.default_rng(seed)
    s, d = rng.random(n) + 0.01, rng.random(m) + 0.01
    cost = rng.integers(0, 4, (n, m)).astype(float) if ties else rng.random((n, m))
    assert emd(s, d, cost) == pytest.approx(myemd(s, d, cost), abs=1e-8)
    assert emd(s, d, cost) == pytest.approx(emd(d, s, cost.T), abs=1e-8)


def test_assignment_is_least():
    rng = np.random.default_rng(1)
    for n in range(1, 6):
        cost = rng.random((n, n))
        total, columns = assign(cost)
        assert sorted(columns) == list(range(n))
        assert total == pytest.approx(min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_hsv_goldens():
    rgb = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 0, 255], [128, 128, 128], [0, 0, 0]]], np.uint8)
    assert images.rgb_to_hsv(rgb)[0].tolist() == [[0, 255, 255], [85, 255, 255], [170, 255, 255], [212, 255, 255], [0, 0, 128], [0, 0, 0]]
    assert np.abs(images.hsv_to_rgb(images.rgb_to_hsv(rgb)).astype(int) - rgb).max() <= 3


def test_resize_and_segmentation():
    assert images.resize_matrix(10, 4).sum(axis=1) == pytest.approx(np.ones(4))
    image = np.zeros((64, 64, 3), np.uint8)
    image[:, 32:] = 200
    assert (images.resize(np.full((9, 5, 3), 77, np.uint8), 16) == 77).all()
    labels, n = images.segment(image)
    assert n == 2 and labels[0, 0] == 0 and labels[0, 63] == 1 and (labels[:, :32] == 0).all()
    weights, features = images.region_features(images.rgb_to_hsv(image), labels, n, weighted=False)
    assert weights.sum() == pytest.approx(1) and features.shape == (2, 14)
    assert features[0, 9] == pytest.approx(math.log(2)) and features[0, 10] == pytest.approx(1)
    assert images.edge_overlay(image, labels)[0, 32, 0] == 55


def test_simplex_says_when_it_is_not_done():
    rng = np.random.default_rng(2)
    with pytest.raises(RuntimeError):
        myemd(rng.random(12), rng.random(12), rng.random((12, 12)), most=1)

import os
from types import SimpleNamespace

import numpy as np
import pyspark.sql.functions as F
import pytest

from tessella.operators import lsh, sets
from tessella.plans import similarity
from tessella.plans.images import image_regions, image_search
from tessella.plans.similarity import SimilarityPlan
from tessella.functions import images as kernels
from tessella.functions import jpeg
from tessella.functions.distances import BLOCK_DISTANCES
from tessella.functions.transport import emd
from tessella.queries import media
from tessella.session import shared_dir
from tessella.sources.files import encode_jpegs, scan_images, write_files


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Images of two colours each, written by the JVM; the last is like the first one."""
    top = tmp_path_factory.mktemp("images")
    (top / "deep").mkdir()
    jvm = spark._jvm
    pairs = [(0xE02020, 0x2020E0), (0x20E020, 0xE0E020), (0x101010, 0xF0F0F0), (0xD82828, 0x2828D8)]
    for i, (left, right) in enumerate(pairs):
        image = jvm.java.awt.image.BufferedImage(48, 32, 1)
        g = image.createGraphics()
        for colour, x in ((left, 0), (right, 24)):
            g.setColor(jvm.java.awt.Color(colour))
            g.fillRect(x, 0, 24, 32)
        jvm.javax.imageio.ImageIO.write(image, "png", jvm.java.io.File(str(top / ("deep" if i % 2 else ".") / f"i{i}.png")))
    (top / "broken.png").write_bytes(b"no image")
    return str(top)


def test_scan_and_regions(spark, folder):
    images = scan_images(spark, folder)
    rows = {r.name: r for r in images.collect()}
    assert sorted(rows) == ["deep/i1.png", "deep/i3.png", "i0.png", "i2.png"]
    pixel = np.frombuffer(rows["i0.png"].bgr, np.uint8)[:3]
    assert pixel.tolist() == [0x20, 0x20, 0xE0]
    regions = image_regions(images, side=32).collect()
    assert all(len(r.features) == 14 for r in regions)
    for name in rows:
        assert sum(r.weight for r in regions if r.name == name) == pytest.approx(1)
        assert 2 <= sum(r.name == name for r in regions) <= 4


def test_search(spark, folder):
    names = spark.createDataFrame([("i0.png",)], "name string")
    hits = image_search(scan_images(spark, folder), names, lsh.LshParams(D=14, M=4, L=12, W=8.0, H=19697), SimilarityPlan(k=2)).orderBy("rank").collect()
    assert [(h.name, h["rank"]) for h in hits] == [("i0.png", 1), ("deep/i3.png", 2)] and hits[0].dist == 0


def test_grey_images_and_equal_names(spark, tmp_path):
    """Two folders with a file of the same name; one byte a pixel, and four."""
    jvm, kinds = spark._jvm, {"a": 10, "b": 1, "c": 6}
    for sub, kind in kinds.items():
        (tmp_path / sub).mkdir()
        image = jvm.java.awt.image.BufferedImage(2, 1, kind)
        for x, colour in enumerate((0xFF404040, 0xFF804020 if kind != 10 else 0xFF808080)):
            image.setRGB(x, 0, colour - (1 << 32))
        jvm.javax.imageio.ImageIO.write(image, "png", jvm.java.io.File(str(tmp_path / sub / "x.png")))
    rows = {r.name: bytes(r.bgr) for r in scan_images(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a/x.png", "b/x.png", "c/x.png"]
    assert rows["b/x.png"] == rows["c/x.png"] == bytes([0x40, 0x40, 0x40, 0x20, 0x40, 0x80])
    grey = rows["a/x.png"]
    assert len(grey) == 6 and len(set(grey[:3])) == len(set(grey[3:])) == 1


@pytest.fixture(scope="module")
def brute_force(spark):
    """The five nearest images of each one whose id is divisible by 50, by earth mover's distances of all pairs."""
    regions = image_regions(media._images(spark, "/root/testdata/sf0.01"), side=32).collect()
    objects = {}
    for r in sorted(regions, key=lambda r: r.region):
        objects.setdefault(r.name, []).append(r)
    objects = {k: (np.array([r.weight for r in v]), np.array([r.features for r in v])) for k, v in objects.items()}
    order = {n: i for i, n in enumerate(sorted(objects))}
    want = set()
    for q in objects:
        if int(q) % 50 == 0:
            a, x = objects[q]
            near = sorted((round(emd(a, b, BLOCK_DISTANCES["L2_float"](x, y)), 6), order[n], n) for n, (b, y) in objects.items())[:5]
            want |= {(q, n, d, rank) for rank, (d, _, n) in enumerate(near, 1)}
    return want


def test_image_search_misses_nothing(spark, brute_force):
    got = {tuple(r) for r in media.image_search(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 50 and got == brute_force


def test_bounds_are_the_filter_of_image_search(spark, monkeypatch, brute_force):
    """No region is hashed, and few pairs that pass the bounds are solved."""
    solved = []

    def nearest(*a, **k):
        if not k.get("likely"):
            solved.append(sets.nearest_sets(*a, **k, work=True).agg(F.sum("seen"), F.sum("solved")).first())
        return sets.nearest_sets(*a, **k)

    monkeypatch.setattr(similarity.lsh, "lsh_knn", None)
    monkeypatch.setattr(similarity, "sets", SimpleNamespace(**vars(sets) | {"nearest_sets": nearest}))
    got = {tuple(r) for r in media.image_search(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute_force and solved[0][0] == 10 * 500 and solved[0][1] < 250


def test_search_shuffles_no_pairs(spark, shuffled):
    """7,102 regions and 140 that are asked for: a million pairs with a common bucket stay in their tasks."""
    hits = media.image_search(spark, "/root/testdata/sf0.001").collect()
    assert len(hits) == 50 and {h.query for h in hits if h["rank"] == 1 and h.query == h.name} == {str(i) for i in range(0, 500, 50)}
    assert shuffled() < 3


def test_self_search_shuffles_no_pairs(spark, shuffled):
    found = media.image_search_self(spark, "/root/testdata/sf0.001").collect()
    assert sorted(int(r.name) for r in found) == list(range(0, 500, 50)) and shuffled() < 3


def test_self_search_hashes_nothing(spark, monkeypatch):
    monkeypatch.setattr(similarity.lsh, "lsh_knn", None)
    assert sorted(int(r.name) for r in media.image_search_self(spark, "/root/testdata/sf0.001").collect()) == list(range(0, 500, 50))


def test_self_search_takes_disk_for_features_twice(spark, shuffled):
    """0.8 MB of features go through one shuffle and into one table, also where tables are too large to be broadcast."""
    top = shared_dir(spark).removeprefix("file://")
    written = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")) / 1e6
    before, threshold = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        assert len(media.image_search_self(spark, "/root/testdata/sf0.001").collect()) == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert shuffled() + written() - before < 2.5


def test_jpegs_are_read_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    smooth = np.stack([np.add.outer(np.arange(45) * 3, np.arange(61) * 2), np.add.outer(np.arange(45), 200 - np.arange(61)), np.full((45, 61), 90)], axis=2).clip(0, 255).astype(np.uint8)
    images = {"smooth": smooth, "noise": rng.integers(0, 256, (17, 33, 3), dtype=np.uint8), "flat": np.full((8, 8, 3), 200, np.uint8), "dot": np.full((1, 1, 3), 7, np.uint8), "edges": np.where(np.indices((64, 40)).sum(0)[:, :, None] % 9 < 4, 255, 0).astype(np.uint8).repeat(3, 2)}
    rows = [(k, v.shape[1], v.shape[0], bytearray(v[:, :, ::-1].tobytes())) for k, v in images.items()]
    made = encode_jpegs(spark.createDataFrame(rows, "name string, width int, height int, bgr binary"), quality=100)
    assert write_files(made.selectExpr("concat(name, '.jpg') as name", "content"), str(tmp_path / "out")) == 5
    back = {r.name[:-4]: np.frombuffer(r.bgr, np.uint8).reshape(r.height, r.width, 3)[:, :, ::-1] for r in scan_images(spark, str(tmp_path / "out")).collect()}
    assert back.keys() == images.keys()
    for name, image in images.items():
        assert back[name].shape == image.shape and np.abs(back[name].astype(int) - image).max() <= 8, name
    small, fine = (len(jpeg.encode(smooth, q)) for q in (20, 95))
    assert small < fine < smooth.nbytes / 2


def test_jpeg_codes_have_no_code_of_ones_only():
    for counts in ({0: 1}, {0: 5, 1: 5}, {i: 2**i for i in range(40)}, {i: 1 for i in range(162)}):
        lengths = jpeg.code_lengths(counts)
        _, codes = jpeg.canonical(lengths)
        assert max(lengths.values()) <= 16 and all(c < (1 << n) - 1 for c, n in codes.values())
        words = sorted(f"{c:0{n}b}" for c, n in codes.values())
        assert not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))


def test_images_side_by_side_have_the_same_regions():
    """Noise, one colour, few colours; a region's box that closes. Labels, weights and features equal those of one image at a time, to the bit."""
    rng = np.random.default_rng(2)
    made = [rng.integers(0, 256, (9, 8, 3)) // (1, 90, 256)[i % 3] * (1, 90, 256)[i % 3] for i in range(24)]
    rgb = np.stack([kernels.resize(x.astype(np.uint8), 20) for x in made])
    one = [kernels.segment(x) for x in rgb]
    labels, numbers = kernels.segment_many(rgb)
    assert (labels == np.stack([x[0] for x in one])).all() and numbers.tolist() == [x[1] for x in one] and 1 in numbers and numbers.max() > 9
    weights, features = kernels.region_features_many(kernels.rgb_to_hsv(rgb), labels, numbers)
    want = [kernels.region_features(kernels.rgb_to_hsv(x), *y) for x, y in zip(rgb, one, strict=True)]
    assert (weights == np.concatenate([x[0] for x in want])).all() and (features == np.concatenate([x[1] for x in want])).all()

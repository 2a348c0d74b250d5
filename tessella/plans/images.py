"""Images to region vectors, and image search on top of the similarity plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tessella.functions import images as kernels
from tessella.operators import lsh, sets
from tessella.session import materialize, ship
from tessella.sources.files import numbered

from .similarity import SimilarityPlan, similarity_search


def image_regions(images: DataFrame, side: int = kernels.SIDE) -> DataFrame:
    """(name, region, weight, features) of images (name, width, height, bgr); images are segmented side by side, no shuffle."""
    ship(images.sparkSession)
    schema = pa.schema([("name", pa.string()), ("region", pa.int32()), ("weight", pa.float64()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, kernels.PIXELS // side**2)
        for batch in batches:
            for at in range(0, len(batch), step):
                rows = batch.slice(at, step).to_pylist()
                rgb = np.stack([kernels.resize(np.frombuffer(r["bgr"], np.uint8).reshape(r["height"], r["width"], 3)[:, :, ::-1], side) for r in rows])
                if len(rows) < kernels.FEW:
                    labels, numbers = (np.array(x) for x in zip(*map(kernels.segment, rgb), strict=True))
                else:
                    labels, numbers = kernels.segment_many(rgb)
                weights, features = kernels.region_features_many(kernels.rgb_to_hsv(rgb), labels, numbers)
                names = pa.array([r["name"] for r in rows], pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), numbers)))
                region = np.arange(len(weights)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(weights) + 1, dtype=np.int32) * features.shape[1]), pa.array(features.ravel()))
                yield pa.RecordBatch.from_arrays([names, pa.array(region, pa.int32()), pa.array(weights), lists], schema=schema)

    return images.select("name", "width", "height", "bgr").mapInArrow(run, "name string, region int, weight double, features array<double>")


def numbered_sets(regions: DataFrame, names: DataFrame) -> DataFrame:
    """Regions as sets (vecset_id, vecs), images by their numbers in names (name, vecset_id). The features are shuffled once."""
    vecs = regions.join(names, "name").select("name", (F.col("vecset_id") * F.lit(1 << 16) + F.col("region")).alias("vec_id"), "vecset_id", "weight", "features")
    return sets.as_sets(vecs, "name").drop("name")


def image_search(images: DataFrame, query_names: DataFrame, params: lsh.LshParams | None = None, plan: SimilarityPlan = SimilarityPlan(), side: int = kernels.SIDE) -> DataFrame:
    """(query, name, dist, rank): the images nearest to each named one by their regions."""
    params = params or lsh.LshParams(D=14, M=17, L=12, W=4.0708, H=19697)
    # images are numbered by their names alone, so features are written once: as sets
    names = numbered(images.select("name").distinct(), "name", "vecset_id")
    packed = materialize(numbered_sets(image_regions(images, side), names), "sets")
    asked = names.join(query_names.select("name"), "name", "left_semi")
    hits = similarity_search(sets.unpacked(packed), asked, params, plan, packed=packed)
    a, b = names.select(F.col("vecset_id").alias("qa"), F.col("name").alias("query")), names.select(F.col("vecset_id").alias("tb"), "name")
    return hits.join(a, F.col("query_id") == F.col("qa")).join(b, F.col("id") == F.col("tb")).select("query", "name", "dist", "rank")

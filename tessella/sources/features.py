"""Text formats: feature vectors of objects, ground truth of searches, metric logs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tessella.session import ship

VEC_TYPES = ("int", "float", "bit")


@dataclass(frozen=True)
class VecConfig:
    """Schema of vectors: type of their values, dimension, and one (single) or any number (set) per object."""

    name: str = "default"
    vec_type: str = "float"
    dim: int = 14
    vecset_type: str = "set"

    def __post_init__(self) -> None:
        if self.vec_type not in VEC_TYPES or self.vecset_type not in ("none", "single", "set") or self.dim < 1:
            raise ValueError(f"not a vector configuration: {self}")


def parse_vector(text: str, config: VecConfig) -> list[float]:
    """Values of a vector, separated by white space; bits are one run of 0 and 1."""
    values = [float(c) for c in text.strip()] if config.vec_type == "bit" else [float(v) for v in text.split()]
    if config.vec_type == "bit" and not set(values) <= {0.0, 1.0}:
        raise ValueError("a bit vector has other characters than 0 and 1")
    if len(values) != config.dim:
        raise ValueError(f"a vector has {len(values)} values, not {config.dim}")
    return [float(int(v)) for v in values] if config.vec_type == "int" else values


def parse_features(text: str, config: VecConfig) -> list[tuple[str, list[tuple[float, list[float]]]]]:
    """Objects (name, [(weight, values)]) of a feature file: ``name<TAB>count``, then count lines of ``weight<TAB>values``; # starts a comment line."""
    lines = [x for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]
    objects, at = [], 0
    while at < len(lines):
        name, count = lines[at].rsplit("\t", 1) if "\t" in lines[at] else lines[at].rsplit(None, 1)
        count = int(count)
        if config.vecset_type == "single" and count != 1:
            raise ValueError(f"{name} has {count} vectors, not one")
        if at + 1 + count > len(lines):
            raise ValueError(f"{name} ends early")
        vecs = []
        for line in lines[at + 1 : at + 1 + count]:
            weight, values = line.split(None, 1)
            vecs.append((float(weight), parse_vector(values, config)))
        objects.append((name.strip(), vecs))
        at += 1 + count
    return objects


def import_features(spark: SparkSession, path: str, config: VecConfig, sequential_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vecs, vecsets) of feature files. Files are parsed in parallel; objects are numbered by (file, place).

    With sequential_ids the names are the numbers 0, 1, 2, ... and anything else is refused.
    """
    ship(spark)
    schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("name", pa.string()), ("region", pa.int32()), ("weight", pa.float64()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for place, (name, vecs) in enumerate(parse_features(text, config)):
                    rows += [{"file": file, "place": place, "name": name, "region": r, "weight": w, "features": v} for r, (w, v) in enumerate(vecs)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    parsed = texts.mapInArrow(run, "file string, place long, name string, region int, weight double, features array<double>")
    objects = parsed.groupBy("file", "place", "name").agg(F.count(F.lit(1)).alias("num_regions"))
    counts = {r["file"]: r["n"] for r in objects.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number for each file
    before, total = {}, 0
    for f in sorted(counts):
        before[f], total = total, total + counts[f]
    start = F.create_map(*[F.lit(x) for f in before for x in (f, before[f])]) if before else F.create_map().cast("map<string,int>")
    number = (F.element_at(start, F.col("file")) + F.col("place")).cast("long")
    if sequential_ids:
        number = F.when(F.col("name") == number.cast("string"), number).otherwise(F.raise_error(F.concat(F.lit("not the next id: "), F.col("name"))).cast("long"))
    vecs = parsed.select(number.alias("vecset_id"), "region", "weight", "features")
    vecs = vecs.withColumn("vec_id", F.col("vecset_id") * F.lit(1 << 16) + F.col("region"))
    sets = objects.select(number.alias("vecset_id"), "name", F.col("num_regions").cast("int").alias("num_regions")).withColumn("start_vecid", F.col("vecset_id") * F.lit(1 << 16))
    return vecs.select("vec_id", "vecset_id", "weight", "features"), sets


def feature_lines(vecs: DataFrame, vecsets: DataFrame, config: VecConfig) -> DataFrame:
    """(vecset_id, text) of objects in the import format."""
    show = (lambda v: F.format_string("%.0f", v)) if config.vec_type in ("int", "bit") else (lambda v: v.cast("string"))
    values = F.array_join(F.transform("features", show), "" if config.vec_type == "bit" else " ")
    rows = vecs.select("vecset_id", F.struct("vec_id", F.concat(F.col("weight").cast("string"), F.lit("\t"), values).alias("line")).alias("v"))
    blocks = rows.groupBy("vecset_id").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    head = F.concat(F.col("name"), F.lit("\t"), F.size("vs").cast("string"))
    return blocks.join(vecsets.select("vecset_id", "name"), "vecset_id").select("vecset_id", F.concat_ws("\n", head, F.array_join(F.transform("vs", lambda v: v["line"]), "\n")).alias("text"))


def export_features(vecs: DataFrame, vecsets: DataFrame, config: VecConfig, path: str) -> None:
    """Writes feature files with two comment lines at the head of the first one."""
    spark = vecs.sparkSession
    body = feature_lines(vecs, vecsets, config).repartitionByRange("vecset_id").sortWithinPartitions("vecset_id").select(F.col("text").alias("value"))
    head = spark.createDataFrame([(f"# type {config.vec_type} dimension {config.dim}\n# objects as name, number of vectors",)], "value string")
    head.coalesce(1).write.mode("overwrite").text(path)
    body.write.mode("append").text(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rank, id, dist) of ground-truth lines ``query k id dist id dist ...``."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    k = F.element_at("p", 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(1), k), lambda i: F.struct(i.alias("rank"), F.element_at("p", 2 * i + 1).cast("long").alias("id"), F.element_at("p", 2 * i + 2).cast("double").alias("dist")))
    checked = rows.where(F.when(F.size("p") == 2 + 2 * k, F.lit(True)).otherwise(F.raise_error(F.lit("a truth line has a wrong number of pairs")).cast("boolean")) & (k > 0))
    return checked.select(F.element_at("p", 1).cast("long").alias("query_id"), F.explode(pairs).alias("r")).select("query_id", "r.rank", "r.id", "r.dist")


def truth_lines(results: DataFrame) -> DataFrame:
    """Ranked results as ground-truth lines."""
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "dist"))).alias("r"))
    pairs = F.array_join(F.transform("r", lambda x: F.concat_ws(" ", x["id"].cast("string"), x["dist"].cast("string"))), " ")
    return rows.select("query_id", F.concat_ws(" ", F.col("query_id").cast("string"), F.size("r").cast("string"), pairs).alias("line"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A metrics table as CSV files with a header."""
    metrics.write.mode("overwrite").option("header", "true").csv(path)

"""An environment of named tables, vector configurations, name maps and indexes, kept under one folder.

Payloads are Parquet tables; the catalogue is one JSON document beside them, written through Spark so that any store it
reads will do. Every change of a table goes to a new folder and is seen when the catalogue names it.
"""

from __future__ import annotations

import json
import re
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tessella.functions.distances import VECTOR_DISTANCES
from tessella.functions.params import parse_params
from tessella.operators import lsh, search
from tessella.operators.sets import SET_DISTANCES
from tessella.sources.features import VecConfig, export_features, import_features


class IndexOperator(ABC):
    """An index as two functions from tables to tables."""

    @abstractmethod
    def build(self, vecs: DataFrame) -> DataFrame:
        """The index of vecs."""

    @abstractmethod
    def query(self, index: DataFrame, vecs: DataFrame, queries: DataFrame, k: int, params: str) -> DataFrame:
        """(query_id, id, dist, rank)."""

    def tune(self, distance: float, recall: float) -> str:
        """Query parameters that are expected to reach a recall of neighbours at a distance; none where there is nothing to choose."""
        return ""

    def describe(self) -> str:
        return type(self).__name__


class RawIndex(IndexOperator):
    """The table itself: exact scans."""

    def build(self, vecs: DataFrame) -> DataFrame:
        return vecs.select("vec_id")

    def query(self, index: DataFrame, vecs: DataFrame, queries: DataFrame, k: int, params: str) -> DataFrame:
        return search.knn(vecs, queries, k, "L2_float", "vec_id", "features")


class LshIndex(IndexOperator):
    """LSH with parameters -M, -L, -H, -w at creation and -L, -T, -recall in queries."""

    def __init__(self, dim: int, params: str = "") -> None:
        p = parse_params(params, M=10, L=1, H=1_017_881, w=1.0)
        self.lsh = lsh.LshParams(D=dim, M=int(p["M"]), L=int(p["L"]), W=float(p["w"]), H=int(p["H"]))

    def build(self, vecs: DataFrame) -> DataFrame:
        return lsh.build_index(vecs, self.lsh, "vec_id", "features")

    def tune(self, distance: float, recall: float) -> str:
        return f"-L {self.lsh.L} -T {lsh.tune(self.lsh, distance, recall)}"

    def query(self, index: DataFrame, vecs: DataFrame, queries: DataFrame, k: int, params: str) -> DataFrame:
        p = parse_params(params, L=self.lsh.L, T=0, recall=0.0)
        if p["recall"]:
            return lsh.lsh_recall_knn(vecs, queries, self.lsh, k, float(p["recall"]), id_col="vec_id", vec_col="features")
        return lsh.lsh_knn(vecs, queries, self.lsh, k, min(int(p["L"]), self.lsh.L), int(p["T"]), index, "vec_id", "features")


#: Kinds of index by name: functions of (dimension, parameter string).
INDEXES: dict[str, Callable[[int, str], IndexOperator]] = {"raw": lambda dim, params: RawIndex(), "lsh": LshIndex}


def register_index(name: str, make: Callable[[int, str], IndexOperator]) -> None:
    if name in INDEXES:
        raise ValueError(f"there is an index kind named {name}")
    INDEXES[name] = make


@dataclass
class TableEntry:
    """A table: its configuration, payload folders, map of names and child indexes."""

    config: str
    vecs: list[str] = field(default_factory=list)
    vecsets: list[str] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)
    next_vecset: int = 0


class Environment:
    """Tables, configurations and indexes below a base folder."""

    def __init__(self, spark: SparkSession, base: str, create: bool = True) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        self.configs: dict[str, VecConfig] = {}
        self.tables: dict[str, TableEntry] = {}
        if not self._restore() and not create:
            raise FileNotFoundError(f"no environment at {base}")

    # catalogue

    def _versions(self) -> tuple:
        """(file system, paths of the catalogue's versions, oldest first)."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(self.base)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return fs, sorted((p for p in found if re.fullmatch(r"catalog-\d{12}\.json", p.getName())), key=lambda p: p.getName())

    def _restore(self) -> bool:
        _, versions = self._versions()
        if not versions:
            return False
        text = "\n".join(r.value for r in self.spark.read.text(str(versions[-1].toString())).collect())
        saved = json.loads(text)
        self.configs = {k: VecConfig(**v) for k, v in saved["configs"].items()}
        self.tables = {k: TableEntry(**v) for k, v in saved["tables"].items()}
        return True

    def checkpoint(self) -> None:
        """Writes the catalogue, whole, as a new version: complete before it gets its name, and older ones go after that."""
        fs, versions = self._versions()
        number = int(versions[-1].getName()[8:20]) + 1 if versions else 0
        fresh = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/catalog-{uuid.uuid4().hex}.json")
        out = fs.create(fresh)
        out.write(bytearray(json.dumps({"configs": {k: asdict(v) for k, v in self.configs.items()}, "tables": {k: asdict(v) for k, v in self.tables.items()}}).encode()))
        out.close()
        if not fs.rename(fresh, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/catalog-{number:012d}.json")):
            raise RuntimeError(f"another writer has made version {number} of the catalogue at {self.base}")
        for old in versions:
            fs.delete(old, False)

    def describe(self) -> DataFrame:
        """(kind, name, detail) of everything registered."""
        rows = [("config", k, json.dumps(asdict(v))) for k, v in self.configs.items()]
        rows += [("table", k, json.dumps({"config": v.config, "objects": v.next_vecset, "parts": len(v.vecs), "indexes": sorted(v.indexes)})) for k, v in self.tables.items()]
        rows += [("vec_dist", k, "") for k in VECTOR_DISTANCES] + [("vecset_dist", k, "") for k in SET_DISTANCES] + [("index", k, "") for k in INDEXES]
        return self.spark.createDataFrame(rows, "kind string, name string, detail string")

    # tables

    def add_config(self, config: VecConfig) -> None:
        if config.name in self.configs:
            raise ValueError(f"there is a configuration named {config.name}")
        self.configs[config.name] = config

    def create_table(self, name: str, config: str) -> None:
        if name in self.tables:
            raise ValueError(f"there is a table named {name}")
        if config not in self.configs:
            raise KeyError(f"no configuration named {config}")
        self.tables[name] = TableEntry(config)

    def drop_table(self, name: str) -> None:
        """Forgets a table and its indexes; its folders are left to the store's own cleaning."""
        del self.tables[name]

    def vecs(self, name: str) -> DataFrame:
        return self._read(self.tables[name].vecs, "vec_id long, vecset_id long, weight double, features array<double>")

    def vecsets(self, name: str) -> DataFrame:
        return self._read(self.tables[name].vecsets, "vecset_id long, name string, num_regions int, start_vecid long")

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.base}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def insert(self, name: str, vecs: DataFrame, vecsets: DataFrame) -> None:
        """Appends objects after those that are there; child indexes get the new vectors first."""
        entry = self.tables[name]
        base = F.lit(entry.next_vecset)
        start = (F.col("vecset_id") + base) * F.lit(1 << 16)
        sets = vecsets.select((F.col("vecset_id") + base).alias("vecset_id"), "name", F.col("num_regions").cast("int"), start.alias("start_vecid"))
        moved = vecs.join(vecsets.select("vecset_id", F.col("start_vecid").alias("_s")), "vecset_id")
        rows = moved.select((start + F.col("vec_id") - F.col("_s")).alias("vec_id"), (F.col("vecset_id") + base).alias("vecset_id"), F.col("weight").cast("double").alias("weight"), F.col("features").cast("array<double>").alias("features"))
        vec_path = self._write(rows, f"{name}-vecs")
        added = self._read([vec_path], "vec_id long, vecset_id long, weight double, features array<double>")
        for child, index in entry.indexes.items():
            index["paths"].append(self._write(self._operator(name, child).build(added), f"{name}-{child}"))
        entry.vecs.append(vec_path)
        entry.vecsets.append(self._write(sets, f"{name}-sets"))
        entry.next_vecset += vecsets.agg(F.coalesce(F.max("vecset_id") + 1, F.lit(0))).first()[0]

    def import_file(self, name: str, path: str, sequential_ids: bool = False) -> None:
        self.insert(name, *import_features(self.spark, path, self.configs[self.tables[name].config], sequential_ids))

    def export_file(self, name: str, path: str) -> None:
        export_features(self.vecs(name), self.vecsets(name), self.configs[self.tables[name].config], path)

    # indexes

    def _operator(self, table: str, index: str) -> IndexOperator:
        spec = self.tables[table].indexes[index]
        return INDEXES[spec["kind"]](self.configs[self.tables[table].config].dim, spec["params"])

    def associate(self, table: str, index: str, kind: str, params: str = "") -> None:
        """Builds an index of a table; later inserts go to it as well."""
        entry = self.tables[table]
        if index in entry.indexes:
            raise ValueError(f"{table} has an index named {index}")
        entry.indexes[index] = {"kind": kind, "params": params, "paths": []}
        if entry.vecs:
            entry.indexes[index]["paths"].append(self._write(self._operator(table, index).build(self.vecs(table)), f"{table}-{index}"))

    def tune(self, table: str, index: str, distance: float, recall: float) -> str:
        """Query parameters of an index for a recall of neighbours at a distance."""
        return self._operator(table, index).tune(distance, recall)

    def disassociate(self, table: str, index: str) -> None:
        del self.tables[table].indexes[index]

    def release(self, table: str, index: str) -> None:
        """Forgets an index and deletes its folders, once the catalogue is written without it."""
        paths = self.tables[table].indexes[index]["paths"]
        self.disassociate(table, index)
        self.checkpoint()
        for p in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def query(self, table: str, queries: DataFrame, k: int, index: str | None = None, params: str = "") -> DataFrame:
        """k nearest vectors of queries (vec_id, features), by an index or exactly."""
        if index is None:
            return search.knn(self.vecs(table), queries, k, "L2_float", "vec_id", "features")
        spec = self.tables[table].indexes[index]
        built = self.spark.read.parquet(*spec["paths"])
        return self._operator(table, index).query(built, self.vecs(table), queries, k, params)

    def register_views(self) -> None:
        """Every table as temporary views <name>_vecs and <name>_sets, for SQL."""
        for name in self.tables:
            self.vecs(name).createOrReplaceTempView(f"{name}_vecs")
            self.vecsets(name).createOrReplaceTempView(f"{name}_sets")

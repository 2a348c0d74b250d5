"""Sessions, the shared folder for intermediate tables, and shipping of the package's code."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def get_spark(app: str = "tessella", cores: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings that tests and benchmarks share."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSELLA_DRIVER_MEMORY", "6g"))
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="tessella-")
    archive = os.path.join(folder, "tessella_src.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(PACKAGE.rglob("*.py")):
            out.write(p, str(Path("tessella") / p.relative_to(PACKAGE)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session in one process gets a folder of its own; on a cluster that would lose data, so it is refused."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tessella-shared-")
    return _own_dirs[app]


def open_path(path: str):
    """(pyarrow file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), os.path.abspath(path)) if "://" not in path else fs.FileSystem.from_uri(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a table in the shared folder and rereads it: this cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_shared(spark: SparkSession) -> None:
    """Deletes the intermediate tables of all plans so far; results that still read them must be written first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessella")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def default_partitions(spark: SparkSession) -> int:
    """The number of partitions that shuffles use."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

import os
from types import SimpleNamespace

import pytest

from tessella.session import clean_shared, default_partitions, materialize, shared_dir, ship


def test_materialized_tables(spark):
    ship(spark)
    ship(spark)
    df = materialize(spark.range(10).selectExpr("id", "cast(null as string) as s"), "numbers")
    assert df.count() == 10 and df.dtypes == [("id", "bigint"), ("s", "string")]
    assert materialize(spark.range(0), "nothing").count() == 0
    folder = shared_dir(spark).removeprefix("file://")
    assert folder in df.inputFiles()[0] and os.path.isdir(f"{folder}/tessella")
    clean_shared(spark)
    assert not os.path.isdir(f"{folder}/tessella") and default_partitions(spark) == 4


def test_shared_folder_on_a_cluster():
    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder), sparkContext=SimpleNamespace(master=master, applicationId=master))
    assert shared_dir(session("yarn", "s3a://bucket/x/")) == "s3a://bucket/x"
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master, None))
    assert shared_dir(session("local[4]", None)).startswith("file://")

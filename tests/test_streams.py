import pyspark.sql.functions as F

from tessella.operators import metrics
from tessella.queries import streams as _stream_queries  # noqa: F401 - registers them
from tessella.queries.common import QUERIES
from tessella.streaming import dedup as streams


def _write(spark, path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "file_idx long, l2 int, n long, sha1 string").coalesce(1).write.mode("append").parquet(f"{path}/chunks.parquet/part={i}")


def _stream(spark, path):
    return spark.readStream.schema("file_idx long, l2 int, n long, sha1 string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/chunks.parquet")


def test_stateful_dedup_over_batches(spark, tmp_path):
    _write(spark, str(tmp_path), [[(0, 0, 5, "a"), (0, 1, 5, "a"), (0, 2, 3, "b")], [(1, 0, 5, "a"), (1, 1, 2, "c")]])
    log = streams.ProgressLog()
    spark.streams.addListener(log)
    out = streams.run_to_table(streams.flag_duplicates(_stream(spark, str(tmp_path)))).collect()
    spark.streams.removeListener(log)
    assert len(out) == 5 and sum(not r.is_dup for r in out) == 3
    assert sum(r.is_dup for r in out if r.sha1 == "a") == 2


def test_index_and_state_agree(spark, tmp_path):
    _write(spark, str(tmp_path), [[(0, 0, 5, "a"), (0, 1, 5, "a"), (0, 2, 3, "b")], [(1, 0, 5, "a"), (1, 1, 2, "c"), (1, 2, 2, "c")], [(2, 0, 3, "b")]])
    got = streams.flag_to_table(_stream(spark, str(tmp_path))).collect()
    assert len(got) == 7 and sorted(r.sha1 for r in got if not r.is_dup) == ["a", "b", "c"]
    state = streams.run_to_table(streams.flag_duplicates(_stream(spark, str(tmp_path)))).collect()
    assert sum(r.is_dup for r in state) == sum(r.is_dup for r in got)


def test_index_goes_on_after_a_restart(spark, tmp_path):
    base = f"file://{tmp_path}/base"
    _write(spark, str(tmp_path), [[(0, 0, 5, "a"), (0, 1, 5, "a")], [(1, 0, 5, "a"), (1, 1, 2, "c")]])
    assert streams.flag_to_table(_stream(spark, str(tmp_path)), base).count() == 4
    spark.createDataFrame([(2, 0, 2, "c"), (2, 1, 1, "d")], "file_idx long, l2 int, n long, sha1 string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/chunks.parquet/part=9")
    got = {(r.file_idx, r.l2): (r.is_dup, r.first_file, r.first_l2) for r in streams.flag_to_table(_stream(spark, str(tmp_path)), base).collect()}
    assert got == {(0, 0): (False, 0, 0), (0, 1): (True, 0, 0), (1, 0): (True, 0, 0), (1, 1): (False, 1, 1), (2, 0): (True, 1, 1), (2, 1): (False, 2, 1)}


def test_emission_in_order(spark, tmp_path):
    _write(spark, str(tmp_path), [[(0, 2, 1, ""), (0, 1, 1, "")], [(0, 0, 1, ""), (1, 0, 1, "")], [(0, 4, 1, ""), (0, 3, 1, "")]])
    out = streams.run_to_table(streams.emit_in_order(_stream(spark, str(tmp_path))))
    assert sorted((r.file_idx, r.l2, r.emitted) for r in out.collect()) == [(0, i, i) for i in range(5)] + [(1, 0, 0)]


def test_tables_emit_what_the_state_emits(spark, tmp_path):
    """Early, late, repeated and missing chunks over three batches, then one more after a restart; a file without a number too."""
    base = f"file://{tmp_path}/base"
    _write(spark, str(tmp_path), [[(0, 2, 1, ""), (0, 1, 1, ""), (None, 0, 5, "")], [(0, 0, 1, ""), (1, 0, 1, ""), (0, 2, 7, ""), (2, 3, 1, "")], [(0, 4, 1, ""), (0, 3, 1, ""), (0, 1, 9, ""), (None, 1, 5, "")]])
    first = sorted((r.file_idx is None, r.file_idx or 0, r.l2, r.n, r.emitted) for r in streams.emit_to_table(_stream(spark, str(tmp_path)), base).collect())
    assert first == [(False, 0, 0, 1, 0), (False, 0, 1, 1, 1), (False, 0, 2, 7, 2), (False, 0, 3, 1, 3), (False, 0, 4, 1, 4), (False, 1, 0, 1, 0), (True, 0, 0, 5, 0), (True, 0, 1, 5, 1)]
    state = streams.run_to_table(streams.emit_in_order(_stream(spark, str(tmp_path)).where("file_idx is not null"))).collect()
    assert sorted((False, r.file_idx, r.l2, r.n, r.emitted) for r in state) == [r for r in first if not r[0]]
    spark.createDataFrame([(2, 0, 1, ""), (2, 1, 1, ""), (2, 2, 1, "")], "file_idx long, l2 int, n long, sha1 string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/chunks.parquet/part=9")
    then = streams.emit_to_table(_stream(spark, str(tmp_path)), base)
    assert then.count() == 12 and sorted((r.l2, r.emitted) for r in then.where("file_idx = 2").collect()) == [(i, i) for i in range(4)]


def test_emission_calls_no_function_for_each_file(spark, monkeypatch):
    monkeypatch.setattr(streams, "emit_in_order", None)
    got = {r.file_idx: (r.parts, r.bytes, r.in_order) for r in QUERIES["stream_reorder"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").collect()
    assert got == {r.doc_id: (r.text.count("\n") + 1, len(r.text.replace("\n", "").encode()), True) for r in docs}


def test_intervals(spark):
    rows = spark.createDataFrame([("k", float(t), 1.0) for t in (0, 0.4, 0.9, 1.0, 1.5, 2.5, 2.6)], "key string, t double, v double").select("key", F.timestamp_seconds("t").alias("ts"), "v")
    got = metrics.elapsed_intervals(rows, "key", "ts", "v", 1.0).orderBy("interval").collect()
    assert [r.n for r in got] == [4, 2, 1] and [(r.t_first, r.t_last) for r in got] == [(0, 1_000_000), (1_500_000, 2_500_000), (2_600_000, 2_600_000)]
    assert metrics.elapsed_intervals(rows.where('false'), 'key', 'ts', 'v', 1.0).count() == 0
    total = metrics.throughput(rows, "v", "ts").first()
    assert (total.total, total.seconds) == (7.0, 2.6)

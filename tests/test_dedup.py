import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from tessella.functions import rabin
from tessella.operators import archive, chunking, dedup
from tessella.plans import compress as plans
from tessella.sources import archives as sources
from tessella.sources import files


@pytest.fixture(scope="module")
def docs(spark):
    same = "The quick brown fox jumps over the lazy dog. " * 300
    rows = [(0, same), (1, same), (2, ""), (3, None), (4, "short"), (5, "\0" * 100), (6, same + "tail"), (7, "a\nb\na\n")]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def test_chunks_conserve_bytes(docs):
    chunks = chunking.cdc_chunks(docs, "doc_id", "text")
    got = {r.file_idx: r.n for r in chunks.groupBy("file_idx").agg(F.sum("n").alias("n")).collect()}
    want = {r.doc_id: len(r.text.encode()) for r in docs.collect() if r.text}
    assert got == want
    last = chunks.where("is_last_l2").groupBy("file_idx").count().collect()
    assert {r.file_idx for r in last} == set(want) and all(r["count"] == 1 for r in last)


def test_coarse_anchor(docs):
    coarse = chunking.cdc_chunks(docs, "doc_id", "text", chunking.ChunkParams(coarse_anchor=4096))
    parts = coarse.where("file_idx = 0").orderBy("l1", "l2").collect()
    assert max(p.l1 for p in parts) >= 1 and [p.offset for p in parts] == [sum(q.n for q in parts[:i]) for i in range(len(parts))]


def test_fixed_and_line_chunks(docs):
    fixed = chunking.fixed_chunks(docs, "doc_id", "text", 64).where("file_idx = 5").orderBy("l2").collect()
    assert [(c.offset, c.n, c.is_last_l2) for c in fixed] == [(0, 64, False), (64, 36, True)]
    lines = chunking.line_chunks(docs, "doc_id", "text").where("file_idx = 7").orderBy("l2").collect()
    assert [bytes(c.data) for c in lines] == [b"a", b"b", b"a", b""]


def test_scopes(docs):
    chunks = chunking.cdc_chunks(docs, "doc_id", "text")
    by_file = dedup.flag_duplicates(chunks, "file").where("file_idx in (0, 1)")
    assert by_file.where("file_idx = 0").where("is_dup").count() == by_file.where("file_idx = 1").where("is_dup").count()
    everywhere = dedup.flag_duplicates(chunks, "global")
    assert everywhere.where("file_idx = 1").where("not is_dup").count() == 0
    assert {r.first_file for r in everywhere.where("file_idx = 1").collect()} == {0}
    with pytest.raises(ValueError):
        dedup.flag_duplicates(chunks, "none")


def test_archive_bytes(docs):
    zeros = dedup.flag_duplicates(chunking.cdc_chunks(docs.where("doc_id = 5"), "doc_id", "text"), "file")
    stats = dedup.dedup_stats(zeros).first()
    assert (stats.n_chunks, stats.n_dups, stats.bytes_unique) == (4, 2, 36)
    made = archive.write_archives(zeros, "none").first()
    code, records = archive.parse_archive(bytes(made.archive))
    assert len(made.archive) == 117 and code == 2 and [k for k, _ in records] == [1, 0, 0, 1]
    assert dedup.archive_sizes(zeros, F.col("n")).first().archive_bytes == 117
    histogram = dedup.size_histogram(zeros)
    shape = dedup.size_stats(histogram).first()
    assert [tuple(r) for r in histogram.collect()] == [(0, 4)] and (shape.mean_size, shape.spread_sum) == (64, 0)


@pytest.mark.parametrize(("scope", "codec"), [("file", "gzip"), ("file", "bzip2"), ("global", "none")])
def test_round_trip(docs, scope, codec):
    found = docs.select(F.col("doc_id").alias("file_idx"), F.col("text").alias("content"))
    made, flagged = plans.compress(found, plans.CompressPlan(scope=scope, codec=codec))
    back = {r.file_idx: bytes(r.content) for r in plans.restore(made, scope).collect()}
    want = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert {k: v for k, v in back.items() if v} == {k: v for k, v in want.items() if v}
    assert "duplicates" in plans.report(made, flagged)


@pytest.mark.parametrize("scope", ["file", "global"])
def test_hot_chunks_are_restored(spark, monkeypatch, scope):
    """A chunk that most fingerprints name, in files with and without an id, in several parts."""
    monkeypatch.setattr(archive, "HOT_LEAST", 7)
    rows = [(f, i, 1, None, b"hot") if i else (f, i, 2, None, b"hot") for f in (None, 1, 2, 3) for i in range(40)]
    records = spark.createDataFrame([(f, i, archive.COMPRESSED if i == 0 and (scope == "file" or f == 1) else archive.FINGERPRINT, "aa", d if i == 0 and (scope == "file" or f == 1) else None) for f, i, _, _, d in rows] + [(3, 40 + i, archive.COMPRESSED, f"b{i}", bytes([i])) for i in range(3)] + [(3, 43, archive.FINGERPRINT, "b1", None)], "file_idx long, rec_no long, kind int, sha1 string, data binary")
    got = {r.file_idx: bytes(r.content) for r in archive.decode_records(records.repartition(5), scope).collect()}
    assert got == {None: b"hot" * 40, 1: b"hot" * 40, 2: b"hot" * 40, 3: b"hot" * 40 + bytes([0, 1, 2, 1])}


def test_bad_archives():
    good = archive.header("none") + archive.record(1, b"x")
    assert archive.decode_archive(good) == b"x"
    for bad in (b"", b"\0\0\0\0\0", good[:-1], archive.header("none") + archive.record(0, b"x"), archive.header("none") + archive.record(0, b"x" * 20), archive.header("none") + archive.record(7, b"x")):
        with pytest.raises(ValueError):
            archive.decode_archive(bad)


def test_slots(spark):
    rows = spark.createDataFrame([(127,), (128,), (32_640,), (10**6,)], "n long")
    assert [r[0] for r in rows.select(chunking.size_slot(F.col("n"))).collect()] == [0, 1, 255, 255]


def test_folder_and_data_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"hello " * 5000)
    (tmp_path / "in" / "b.txt").write_bytes(b"")
    (tmp_path / "in" / ".hidden").write_bytes(b"no")
    found = files.scan_files(spark, str(tmp_path / "in"))
    assert [(r.file_idx, r.file_name, r.size) for r in found.orderBy("file_idx").collect()] == [(0, "a.txt", 30_000)]  # Spark's scan leaves out empty files
    made, _ = plans.compress(found)
    sources.register(spark)
    out = str(tmp_path / "out")
    made.join(found.select("file_idx", "file_name"), "file_idx").select("file_name", "archive").write.format("ddp").option("path", out).mode("append").save()
    back = {r.file_name: bytes(r.content) for r in sources.decode_folder(spark, out).collect()}
    assert back == {"a.txt": b"hello " * 5000}
    records = spark.read.format("ddp").option("path", out).load()
    assert records.where("kind = 1").agg(F.sum(F.octet_length("data"))).first()[0] <= 30_000


@pytest.mark.parametrize("size", [1, 33, 1000, 4096, 100_000])
def test_blocks_with_carry(size):
    rng = random.Random(size)
    content = bytes(rng.randrange(256) for _ in range(30_000)) + b"\0" * 500 + b"ab" * 20_000
    if size < 1000:
        content = content[:3000]
    want, at = [], 0
    for n in rabin.cuts([content])[0]:
        want.append(content[at : at + n])
        at += n
    assert list(chunking.cut_blocks(content[i : i + size] for i in range(0, len(content), size))) == want
    assert list(chunking.cut_blocks([])) == []


def test_files_read_in_blocks(spark, tmp_path):
    rng = random.Random(3)
    for i in range(5):
        (tmp_path / f"f{i}").write_bytes(bytes(rng.randrange(256) for _ in range(20_000 * i + 10)))
    whole = chunking.cdc_layout(files.scan_files(spark, str(tmp_path)), "file_idx", "content")
    parts = chunking.cdc_layout_of_paths(files.scan_paths(spark, str(tmp_path)), block_bytes=7000)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_coarse_parts_are_cut_by_themselves():
    rng = random.Random(4)
    content = bytes(rng.randrange(256) for _ in range(60_000))
    parts = chunking.split_levels(content, chunking.ChunkParams(coarse_anchor=8192))
    at = 0
    for begin, lengths in parts:
        assert begin == at
        end = len(content) if len(content) - at <= 8192 else at + 8192 + rabin.cuts([content[at + 8192 :]])[0][0]
        assert lengths == rabin.cuts([content[at:end]])[0]
        at = end
    assert at == len(content) and chunking.split_levels(b"", chunking.ChunkParams(coarse_anchor=8192)) == []


def test_paths_are_numbered_in_order(spark):
    rows = spark.createDataFrame([(f"p{i:04d}",) for i in random.Random(5).sample(range(5000), 1000)], "path string").repartition(7)
    got = [(r.path, r.n) for r in files.numbered(rows, "path", "n").orderBy("path").collect()]
    assert [n for _, n in got] == list(range(1000))
    assert files.numbered(rows.where("false"), "path", "n").count() == 0


def test_data_source_overwrites_at_commit(spark, tmp_path):
    sources.register(spark)
    out = f"file://{tmp_path}/out"
    one = archive.header("none") + archive.record(1, b"one")
    write = lambda rows, mode: spark.createDataFrame(rows, "file_name string, archive binary").write.format("ddp").option("path", out).mode(mode).save()
    write([("a", one), ("b", one)], "overwrite")
    write([("b", one), ("c", one)], "overwrite")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["b.ddp", "c.ddp"]
    assert {(r.file_name, bytes(r.data)) for r in spark.read.format("ddp").option("path", out).load().collect()} == {("b.ddp", b"one"), ("c.ddp", b"one")}


def test_hot_fingerprints_by_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "x\nx\ny" if i % 3 else f"x\nown {i}\nown {i}") for i in range(40)], "doc_id long, text string")
    chunks = chunking.line_chunks(rows, "doc_id", "text")
    plain = {tuple(r) for r in dedup.flag_duplicates(chunks, "global").collect()}
    monkeypatch.setattr(dedup, "HOT_LEAST", 5)
    monkeypatch.setattr(dedup, "HOT_SHARE", 4)
    assert {tuple(r) for r in dedup.flag_duplicates(chunks, "global").collect()} == plain


def test_synthetic_text(spark):
    for pattern in files.PATTERNS:
        lines = [r.line for r in files.synthetic_text(spark, 20, pattern).collect()]
        assert all(len(x) == 62 for x in lines)
        assert (len(set(lines)) == 1) == (pattern == "FFF")
    assert files.synthetic_text(spark, 5, seed=1).collect() == files.synthetic_text(spark, 5, seed=1).collect()


def test_coarse_parts_of_a_batch_take_one_set_of_fingerprints(monkeypatch):
    """Each content is cut as if it were alone, empty and short ones and those of exactly an anchor included."""
    rng = np.random.default_rng(8)
    contents = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 31, 32, 500, 501, 20_000, 0, 3000)] + [b"x" * 5000, b""]
    params, made = chunking.ChunkParams(mask=0x7F, coarse_anchor=500), []
    alone = [chunking.split_levels(c, params) for c in contents]
    cutter = chunking.rabin.Cutter
    monkeypatch.setattr(chunking.rabin, "Cutter", lambda *a: made.append(1) or cutter(*a))
    assert chunking.split_all(contents, params) == alone and len(made) == 1
    assert [sum(sum(lengths) for _, lengths in parts) for parts in alone] == list(map(len, contents)) and len(alone[6]) > 10
    assert chunking.split_all([b""], params) == [[]] == chunking.split_all([b"", b""], params)[1:]


def test_records_in_small_pieces_restore_the_files(spark, monkeypatch):
    """Batches of few rows and few bytes, borders inside files: the same contents."""
    files_ = [(i, bytes([i]) * 40 + b"same" * 30 + bytes([i + 100]) * (7 * i)) for i in range(12)]
    frame = spark.createDataFrame([(i, 0, j, c[j : j + 40]) for i, c in files_ for j in range(0, len(c), 40)], "file_idx long, l1 int, l2 int, data binary").withColumn("n", F.octet_length("data").cast("long"))
    flagged = dedup.flag_duplicates(chunking.with_fingerprint(frame), "global")
    monkeypatch.setattr(archive, "SLICE", 3)
    monkeypatch.setattr(archive, "HELD_BYTES", 50)
    records = archive.archive_records(archive.write_archives(flagged, "none")).cache()
    assert {(r.file_idx, bytes(r.content)) for r in archive.decode_records(records).collect()} == set(files_)

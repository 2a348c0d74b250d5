"""Filter audit, token alignment and packing against plain versions and the libraries."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pyspark.sql.functions as F
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import bpe, filter_audit, packing, queries, token_alignment

DATA = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"
PATH, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
#: Texts that tokenizers treat in their own ways.
ODD = [None, "", "a", "▁x", " ", " \n\t ", "日本 漢字 \U0001f600", "</s> <|endoftext|> <unk> <|startoftext|>A<|", "\x00\x01 a\x01b", "ab" * 3000, " " * 3000, "éé İ K ẞ Σ", "﻿x", "x" * 2000 + " " * 100 + "漢" * 300, "\x1c\x85\xa0!", "don'T 'S", "one\n\ntwo\r\nthree"]


# filter audit


def audited(rows, labels):
    """The audit of [(doc_id, text, lang)] and [(doc_id, quality, toxic)] by applying every order to every document."""
    good, toxic = ({i for i, *x in labels if i is not None and x[j] == 1} for j in (0, 1))
    ids = defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            ids[text or ""].append(i)
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = [w for w in text.encode().split() if w]
        fails = {f for f, x in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text), i is not None and min(ids[text]) < i), strict=True) if x}
        docs.append((lang or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(removed)
                out[part, order, step] = [len(left), len(removed), sum(f in d[1] for d in own) - len(removed), sum(d[1] == {f} for d in own), sum(d[2] for d in removed), sum(d[3] for d in removed)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_of(docs, labels):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(filter_audit.mask_counts(docs, labels)).collect()}


def test_audit_equals_every_order_applied(spark, small):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text, r.lang) for r in small.collect()]
    rows += [(100 + i, "MANY CAPITALS here " * 40 if i % 3 else f"word{i} " * 3 + "50% | *", ("en", "", None)[i % 3]) for i in range(20)]
    rows += [(200 + i, " ".join(f"w{j}" for j in range(100 + i % 2)), "fr") for i in range(6)]
    rows += [(None, "tie", None), (None, "tie", None), (300, "tie", None), (300, "tie", None), (301, "tie", "en"), (302, "tie", None)]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 310, 2)] + [(300, 1, 0), (300, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = audit_of(docs, spark.createDataFrame(labels, LABELS))
    assert got == audited(rows, labels) and len(got) == 600 * 3


def test_audit_equals_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    names = ["part", "filter_order", "step", *filter_audit.RESULTS]
    want = {tuple(r) for r in db.execute(f"SELECT {', '.join(names)} FROM ({filter_audit.SQL})").fetchall()}
    assert {tuple(r) for r in queries.op11_filter_audit(spark, DATA).select(*names).collect()} == want


def test_audit_edges(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 1)], LABELS)
    rows = [(r.doc_id, r.text, r.lang) for r in odd.select("doc_id", "text", "lang").collect()]
    assert audit_of(odd, labels) == audited(rows, [(3, 1, 1)])
    assert audit_of(empty, labels) == {} and audit_of(odd, labels.where("false")).keys() == audit_of(odd, labels).keys()


def test_survivors_are_sums_over_masks():
    cells = np.random.default_rng(0).integers(0, 9, (3, 16))
    want = [[sum(row[m] for m in range(16) if not m & s) for s in range(16)] for row in cells]
    assert filter_audit.survivors(cells, 4).tolist() == want


# token alignment


@pytest.fixture(scope="module")
def both():
    with open(BYTES, encoding="utf-8") as f, open(PIECES, "rb") as g:
        return token_alignment.Tokenizers(f.read(), g.read())


@pytest.fixture(scope="module")
def byte_library():
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    return library


def plain_groups(byte_library, text):
    """(A ids, B ids, groups) of a text, None without tokens."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    if not text:
        return None
    byte = {c: b for b, c in enumerate(bpe.byte_letters())}
    a, b = byte_library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    of_a = [bytes(byte[c] for c in byte_library.id_to_token(i)) for i in a]
    of_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
        return None
    ends = [np.cumsum(list(map(len, x))).tolist() for x in (of_a, of_b)]
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        n, m = sum(e <= cut for e in ends[0][i : i + 4000]), sum(e <= cut for e in ends[1][j : j + 4000])
        groups.append((a[i : i + n], b[j : j + m]))
        i, j = i + n, j + m
    assert i == len(a) and j == len(b)
    return a, b, groups


def plain_alignment(byte_library, texts):
    docs = [plain_groups(byte_library, t) for t in texts]
    count, best = Counter(), defaultdict(int)
    for d in filter(None, docs):
        count.update({(x, y) for p, q in d[2] for x in p for y in q})
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        links = [(x, y) for p, q in d[2] for x in p for y in q] if d else []
        digest = hashlib.sha256(";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in d[2]).encode()).hexdigest() if d else ""
        out.append((*((len(d[0]), len(d[1]), len(d[2])) if d else (0, 0, 0)), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest))
    return out, count, best


@pytest.mark.parametrize("block_pairs", [50, 1 << 21])
def test_alignment_equals_brute_force(spark, small, byte_library, block_pairs):
    texts = [*ODD, *[r.text for r in small.collect()]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found, pairs = token_alignment.align(docs, BYTES, PIECES, block_pairs=block_pairs)
    want, count, best = plain_alignment(byte_library, texts)
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == dict(enumerate(want))
    assert {(r.a, r.b): (r["count"], r.is_best) for r in pairs.collect()} == {p: (n, n == best[p[0]]) for p, n in count.items()}


def test_alignment_of_documents(spark, byte_library):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], plain_alignment(byte_library, [r.text for r in rows])[0], strict=True))
    got = queries.op12_token_alignment(spark, DATA)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want


def test_alignment_edges(spark, odd, empty):
    got = token_alignment.align(odd, BYTES, PIECES)[0].collect()
    assert len(got) == odd.count() and sum(r.doc_id is None for r in got) == 1
    assert all(not any(tuple(r)[1:7]) and r.groups_sha256 == "" for r in got if r.doc_id in (1, 2))
    assert [tuple(r) for r in got if r.doc_id == 3][0] == [tuple(r) for r in got if r.doc_id == 3][1]
    assert token_alignment.align(empty, BYTES, PIECES)[0].count() == 0
    named = token_alignment.align(spark.createDataFrame([("a", "text"), ("b", None)], "doc_id string, text string"), BYTES, PIECES)[0]
    assert {r.doc_id: r.n_groups for r in named.collect()} == {"a": 1, "b": 0}


def test_links_of_long_groups(both):
    """Groups with more tokens than are expanded, in parts and by distinct ids."""
    rng = np.random.default_rng(1)
    n_a, n_b = np.array([3, 700, 1, 40, 5]), np.array([2, 4, 600, 50, 1])
    doc = np.array([0, 0, 1, 1, 4])
    a, b = rng.integers(0, 30, n_a.sum()), rng.integers(0, 30, n_b.sum())
    want, i, j = Counter(), 0, 0
    for n, m, d in zip(n_a, n_b, doc, strict=True):
        want.update((int(d) << 32) + int(x) * 100 + int(y) for x in a[i : i + n] for y in b[j : j + m])
        i, j = i + n, j + m
    for links in (1, 64, 1 << 20):
        keys, counts = token_alignment.linked_pairs(a, b, n_a, n_b, doc, 100, links)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and (np.diff(keys) > 0).all()


def test_fast_byte_ids_equal_the_library(both, byte_library):
    """Every code point within words, numbers, marks and white space."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50_000):
        texts = [f" a{c}b{c} {c}{c}1{c}.{c} " for c in map(chr, points[at : at + 50_000])]
        for text, e in zip(texts, byte_library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert both.byte_ids(text).tolist() == e.ids


# packing


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def chunks():
    with open(PATH, encoding="utf-8") as f:
        return packing.ChunkIds(bpe.Vocabulary(PATH), f.read())


def same_ids(chunks, library, texts):
    flat, ends = chunks.encode(texts)
    return np.split(flat, ends[:-1]) and all(x.tolist() == e.ids for x, e in zip(np.split(flat, ends[:-1]), library.encode_batch_fast(texts, add_special_tokens=False), strict=True))


def test_chunk_ids_equal_the_library(chunks, library):
    assert same_ids(chunks, library, [t or "" for t in ODD])
    with open(PATH, encoding="utf-8") as f:
        words = [w.removesuffix("</w>") for w in json.load(f)["model"]["vocab"]]
    byte = {c: b for b, c in enumerate(bpe.byte_letters())}
    words = [bytes(byte[c] for c in w).decode(errors="ignore") for w in words]
    assert same_ids(chunks, library, words)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50_000):
        assert same_ids(chunks, library, [f"a{c}b{c} {c}{c}1{c}.{c} !{c}" for c in points[at : at + 50_000]])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdezSTABC  \n\t'!<|>.,éÉ1\x01\x1c\x0bİΣ"), max_size=40), min_size=1, max_size=4))
def test_chunk_ids_equal_the_library_on_any_text(chunks, library, texts):
    assert same_ids(chunks, library, texts)


def test_chunks_are_forgotten(chunks, library, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_CHARS", 200)
    texts = [f"some words of {i} documents {'x' * i}" for i in range(80)]
    for i in range(0, 80, 7):
        assert same_ids(chunks, library, texts[i : i + 7])
    assert chunks.chars < 2000


def packed_as_stated(pieces, texts, library, window=2048):
    """Each id in one piece, sequences without gaps and at most a window long; the padding, and sequences that aren't full."""
    ids = {i: [*e.ids, 1] for i, e in zip(texts, library.encode_batch_fast([t or "" for t in texts.values()], add_special_tokens=False), strict=True)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for i, rows in by_doc.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            own = ids[i][at : at + r.length]
            assert r.start == at and len(own) == r.length > 0 and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
            if "ids" in r:
                assert r.ids == own
            at += r.length
        assert at == len(ids[i])
    padding, short = 0, 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
        short += at < window
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return padding, short


def test_packing_of_documents(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op13_packing(spark, DATA)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    padding, short = packed_as_stated(got.collect(), texts, library)
    assert padding == 0 and short <= 11


@pytest.mark.parametrize("window", [16, 50, 2048])
def test_packing_gives_ids_for_any_window(spark, small, library, window):
    texts = {r.doc_id: r.text for r in small.collect()} | {1000 + i: t for i, t in enumerate(ODD)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    padding, short = packed_as_stated(packing.pack(docs, PATH, window, with_ids=True).collect(), texts, library, window)
    assert padding == 0 and short <= window.bit_length()


def test_packing_edges(spark, odd, empty):
    got = packing.pack(odd, PATH).collect()
    assert packing.pack(empty, PATH).count() == 0
    assert sum(r.start == 0 for r in got) == odd.count() and {r.doc_tokens for r in got if r.doc_id in (1, 2)} == {1}
    firsts = [r.ids_crc32 for r in got if r.doc_id == 3 and r.start == 0]
    assert len(firsts) == 2 and len(set(firsts)) == 1
    named = packing.pack(spark.createDataFrame([("a", "some text"), ("b", None)], "doc_id string, text string"), PATH).collect()
    assert {r.doc_id for r in named} == {"a", "b"}


HISTOGRAMS = {
    "one length": lambda n, rng: np.where(n == 1500, 10**9, 0), "flat": lambda n, rng: np.full(len(n), 1000), "falling": lambda n, rng: (1e12 * 0.997**n).astype(np.int64),
    "few": lambda n, rng: rng.integers(0, 2, len(n)), "primes": lambda n, rng: np.where(np.isin(n, [733, 1021, 1499]), 10**6 + 7, 0), "none": lambda n, rng: np.zeros(len(n), np.int64),
    "short": lambda n, rng: np.where(n == 1, 5_000_001, 0),
}


@pytest.mark.parametrize("kind", HISTOGRAMS)
def test_plan_is_bounded_and_complete(kind):
    """The plan's size doesn't follow the number of tails; every id is placed, and only the last sequences aren't full."""
    n = np.arange(2048)
    histogram = HISTOGRAMS[kind](n, np.random.default_rng(0))
    histogram[0] = 0
    plan = packing.make_plan(histogram)
    ids = int((histogram * n).sum())
    placed = sum(int((rows[:, 0] - (keys & ((1 << packing.RANK) - 1))) @ rows[:, 2]) for keys, rows in plan.levels)
    assert placed == ids and sum(len(k) for k, _ in plan.levels) < 60_000
    assert ids // 2048 <= plan.sequences <= ids // 2048 + 11


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    window = 64
    histogram = rng.integers(0, 40, window) * (rng.random(window) < 0.7)
    histogram[0] = 0
    plan = packing.make_plan(histogram, window)
    tail = np.repeat(np.arange(window), histogram)
    rank = np.concatenate([np.arange(c) for c in histogram])
    row, start, length, sequence, offset = plan.pieces(tail, rank)
    ends = Counter()
    for r in range(len(tail)):
        at = 0
        for i in sorted(np.flatnonzero(row == r).tolist(), key=lambda i: start[i]):
            assert start[i] == at
            at += length[i]
        assert at == tail[r]
    used = np.zeros((plan.sequences, window), int)
    for s, o, k in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True):
        used[s, o : o + k] += 1
        ends[s] += k
    assert used.max() <= 1 and all(used[s, : ends[s]].all() for s in ends) and sum(n < window for n in ends.values()) <= 6


def test_least_squares_uses_what_is_there():
    """Lengths that pair up are used up but for rounding."""
    histogram = np.zeros(64, int)
    histogram[[10, 54, 20, 44, 32, 7, 25]] = [30, 30, 50, 50, 9, 12, 12]
    size, times = packing.combinations(np.flatnonzero(histogram), 64)
    assert ((size * times).sum(axis=1) == 64).all()
    x = packing.repeats(histogram.astype(float), size, times)
    used = np.bincount(size.ravel(), (times * x[:, None]).ravel(), 64)
    assert (x >= 0).all() and np.abs(used - histogram)[[10, 54, 20, 44]].max() < 1.5


def test_no_document_is_lost_when_a_task_runs_again(spark, library):
    """Ranks are those of the written table, so a second reading gives the same pieces."""
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 50)) for i in range(300)], "doc_id long, text string").repartition(7)
    found = packing.pack(docs, PATH, window=64)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, found.repartition(3).collect()))
    assert found.agg(F.sum("length")).first()[0] == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())

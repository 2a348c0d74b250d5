"""Alignment of two tokenizers: which tokens of one stand for which of the other, counted over the whole corpus.

The ends of the tokens' byte ranges are running sums of the tokens' byte lengths. Offsets where tokens of both end (their
intersection) cut the bytes into groups, a search of the ends among the cuts labels each token with its group, and each
pair of an A and a B token of one group is a link, made by repeating each A token for the group's B tokens. A pair of
token ids counts once for each document that has it linked.

Plan: one pass over the texts makes, for blocks of documents, each document's distinct linked pairs and the block's
dictionary: its distinct pairs with the number of its documents that have them. Only dictionaries are shuffled for the
counts, in two stages: by pair and a salt of the block, then by pair, so that no pair is more than a row for each task
before the second. Each dictionary then gets its pairs' counts by a join on the pair, comes back to its block, and the
block's documents are looked up in it. Documents are never shuffled as links, and nothing comes to the driver.

Defined results: texts that are null or empty, or whose tokens' bytes aren't those of a space and the text, have no
tokens: zeros and an empty digest; repeated rows are documents of their own; doc_id is passed on in its own type, null or
not; an empty table gives an empty result; other columns are ignored. A text's tokens are held at once, some 200 bytes for
each; a block is closed when its documents have BLOCK_PAIRS pairs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .bpe import byte_letters
from .common import arrow_map, default_partitions, materialize, prepare, unclashed
from .packing import spans

#: Distinct pairs of the documents of a block; links that are expanded at once; tokens of a group beyond which its distinct ids are paired.
BLOCK_PAIRS, LINKS, WIDE = 1 << 21, 1 << 21, 1 << 8
#: Salts of a pair's count, and the bits of a block's number within its task.
SALTS, BLOCK_BITS = 16, 32
#: The word pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizers:
    """Both tokenizers and the bytes of their tokens, made from the files' contents.

    The byte-level vocabulary numbers its tokens in the order of its merges, so that its ids are ranks of tokens; a file
    for which that doesn't hold is refused.
    """

    def __init__(self, byte_file: str, piece_file: bytes) -> None:
        file = json.loads(byte_file)
        byte = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in file.get("added_tokens") or []}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in file["model"]["vocab"].items() if t not in special}
        made = [ranks[bytes(map(byte.__getitem__, "".join(m.split(" ") if isinstance(m, str) else m)))] for m in file["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("the byte-level vocabulary isn't numbered in the order of its merges")
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_str(byte_file)
        self.library.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        own = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            own[i] = token
        n = self.pieces.get_piece_size()
        other = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.pieces.id_to_piece, range(n)))]
        self.tokens = tuple(pa.array(t, pa.binary()) for t in (own, other))
        self.lengths = tuple(np.fromiter(map(len, t), np.int64, len(t)) for t in (own, other))
        # each id as text with what can follow it in a digest
        self.shown = tuple([pa.array([f"{i}{end}" for i in range(len(t))], pa.string()) for end in ends] for t, ends in ((own, ",|"), (other, ",;")))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both tokenizers for each text."""
        return [self.byte_ids(f" {t}") for t in texts], [np.array(x, np.int64) for x in self.pieces.encode(texts, num_threads=1)]

    def byte_ids(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()), np.int64)
        except BaseException as e:  # the fast library gives up on some very long runs of white space
            if type(e).__name__ != "PanicException":
                raise
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)


def joined(tokens: pa.Array, ids: np.ndarray) -> memoryview:
    """The tokens' bytes, one after the other."""
    taken = tokens.take(pa.array(ids))
    return memoryview(taken.buffers()[2]).cast("B")[: np.frombuffer(taken.buffers()[1], np.int32)[len(ids)]] if len(ids) else memoryview(b"")


def common_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets where tokens of both end, number of A tokens, number of B tokens between them)."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    count = lambda ends: np.bincount(np.searchsorted(cuts, ends), minlength=len(cuts))
    return cuts, count(ends_a), count(ends_b)


def linked_pairs(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, doc: np.ndarray, size_b: int, links: int = LINKS) -> tuple[np.ndarray, np.ndarray]:
    """(document << 32 | a * size_b + b, number of links), sorted and distinct, of groups with n_a and n_b tokens of documents doc."""
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    keys, counts = [], []

    def add(key: np.ndarray, n: np.ndarray | None = None) -> None:
        if n is None:
            key, n = np.unique(key, return_counts=True)
        keys.append(key)
        counts.append(n)

    wide = (n_a > WIDE) | (n_b > WIDE)
    for g in np.flatnonzero(wide).tolist():  # long groups repeat few ids
        of_a, times_a = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        of_b, times_b = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        step = max(1, links // len(of_b))
        for i in range(0, len(of_a), step):
            add(((int(doc[g]) << 32) + (of_a[i : i + step, None] * size_b + of_b)).ravel(), (times_a[i : i + step, None] * times_b).ravel())
    narrow = np.flatnonzero(~wide)
    made = np.cumsum(n_a[narrow] * n_b[narrow])
    at = 0
    while at < len(narrow):
        to = max(at + 1, int(np.searchsorted(made, (made[at - 1] if at else 0) + links, "right")))
        g = narrow[at:to]
        # each A token is repeated for the B tokens of its group
        of = np.repeat(g, n_a[g])
        token = a[np.repeat(first_a[g] - np.cumsum(n_a[g]) + n_a[g], n_a[g]) + np.arange(len(of))]
        reps = n_b[of]
        starts = np.cumsum(reps) - reps
        other = b[np.repeat(first_b[of] - starts, reps) + np.arange(int(reps.sum()))]
        add(np.repeat((doc[of] << 32) + token * size_b, reps) + other)
        at = to
    if len(keys) == 1:
        return keys[0], counts[0]
    key, back = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_inverse=True)
    return key, np.bincount(back, np.concatenate(counts) if counts else None, len(key)).astype(np.int64)


def digests(t: Tokenizers, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, groups: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups in writing (a1,a2|b1;a3|b2,b3); groups: number of each document's."""
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    shown = []
    for ids, ends, (inner, last) in ((a, ends_a, t.shown[0]), (b, ends_b, t.shown[1])):
        is_last = np.zeros(len(ids), bool)
        is_last[ends - 1] = True
        shown.append(pa.concat_arrays([inner, last]).take(pa.array(ids + np.where(is_last, len(inner), 0))))
    # the A tokens of a group come before its B tokens
    place_a = np.arange(len(a)) + np.repeat(ends_b - n_b, n_a)
    order = np.empty(len(a) + len(b), np.int64)
    order[place_a] = np.arange(len(a))
    order[np.arange(len(b)) + np.repeat(ends_a, n_b)] = len(a) + np.arange(len(b))
    text = pa.concat_arrays(shown).take(pa.array(order))
    offsets = np.frombuffer(text.buffers()[1], np.int32)[: len(text) + 1]
    data = memoryview(text.buffers()[2])
    token_ends = np.concatenate(([0], (ends_a + ends_b)[np.cumsum(groups) - 1]))
    ends = offsets[token_ends].tolist()
    return [hashlib.sha256(data[i : j - 1]).hexdigest() for i, j in zip(ends, ends[1:], strict=False)]


def aligned(t: Tokenizers, texts: list[str | None]) -> tuple[dict[str, np.ndarray | list[str]], np.ndarray, np.ndarray]:
    """For each text n_a, n_b, n_groups, n_links, groups_sha256; and of all texts the sorted distinct (text << 32 | pair) with their number of links."""
    out = {c: np.zeros(len(texts), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * len(texts)}
    some = [i for i, x in enumerate(texts) if x]
    a, b = t.encode([texts[i] for i in some])
    good, sizes = [], []
    for i, x, y in zip(some, a, b, strict=True):
        want = f" {texts[i]}".encode()
        if joined(t.tokens[0], x) == want and joined(t.tokens[1], y) == want:
            good.append((i, x, y))
            sizes.append(len(want))
    if not good:
        return out, np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, a, b = np.array([g[0] for g in good]), np.concatenate([g[1] for g in good]), np.concatenate([g[2] for g in good])
    cuts, n_a, n_b = common_groups(np.cumsum(t.lengths[0][a]), np.cumsum(t.lengths[1][b]))
    of = np.searchsorted(np.cumsum(sizes), cuts)  # a document ends at a cut
    groups = np.bincount(of, minlength=len(rows))
    for c, n in (("n_a", n_a), ("n_b", n_b), ("n_links", n_a * n_b)):
        out[c][rows] = np.add.reduceat(n, np.cumsum(groups) - groups)
    out["n_groups"][rows] = groups
    for i, x in zip(rows.tolist(), digests(t, a, b, n_a, n_b, groups), strict=True):
        out["groups_sha256"][i] = x
    return out, *linked_pairs(a, b, n_a, n_b, rows[of], len(t.lengths[1]))


_loaded: dict[int, Tokenizers] = {}


def worker_tokenizers(number: int, files: tuple[str, bytes]) -> Tokenizers:
    """The Python worker's tokenizers of a broadcast pair of files."""
    if number not in _loaded:
        _loaded.clear()
        _loaded[number] = Tokenizers(*files)
    return _loaded[number]


def int_lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values.astype(np.int32)))


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def align_blocks(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Documents, with their distinct pairs and the links of each, and dictionaries (is_dictionary), with the documents of each pair, of blocks."""
    sc = docs.sparkSession.sparkContext
    with open(byte_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        files = sc.broadcast((f.read(), g.read()))
    number = files._jbroadcast.id()
    chosen = unclashed(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, block, seen, held = worker_tokenizers(number, files.value), TaskContext.get().partitionId() << BLOCK_BITS, [], 0
        none = None

        def record(ids: pa.Array, dictionary: bool, out: dict, pairs: pa.Array, counts: pa.Array) -> pa.RecordBatch:
            n = len(ids)
            columns = [pa.array(np.full(n, block)), pa.array(np.full(n, dictionary)), ids, *[pa.array(out[c], pa.int64()) for c in COUNTS], pa.array(out["groups_sha256"], pa.string()), pairs, counts]
            return pa.RecordBatch.from_arrays(columns, names=["block", "is_dictionary", "doc_id", *COUNTS, "groups_sha256", "pairs", "counts"])

        def dictionary() -> pa.RecordBatch:
            pairs, docs_ = np.unique(np.concatenate(seen), return_counts=True)
            return record(pa.nulls(1, none), True, {c: [0] for c in COUNTS} | {"groups_sha256": [""]}, int_lists(pairs, np.array([len(pairs)])), int_lists(docs_, np.array([len(pairs)])))

        for batch in batches:
            none = batch.schema.field("doc_id").type
            for rows in spans(batch, 1):
                out, keys, links = aligned(t, rows.column("text").to_pylist())
                ends = np.searchsorted(keys, np.arange(1, len(rows) + 1) << 32)
                pairs = keys & 0xFFFFFFFF
                yield record(rows.column("doc_id"), False, out, int_lists(pairs, ends), int_lists(links, ends))
                seen.append(pairs)
                held += len(pairs)
                if held >= block_pairs:
                    yield dictionary()
                    block, seen, held = block + 1, [], 0
        if seen:
            yield dictionary()

    return arrow_map(chosen, run, f"block long, is_dictionary boolean, doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, pairs array<int>, counts array<int>")


def pair_counts(entries: DataFrame, size_b: int, salts: int = SALTS) -> DataFrame:
    """(c_pair, c_count, is_best) from dictionary entries (block, pair, docs): the documents of each pair, and whether no pair of the same A id has more."""
    salted = entries.groupBy("pair", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt")).agg(F.sum("docs").alias("docs"))
    counts = materialize(salted.groupBy(F.col("pair").alias("c_pair")).agg(F.sum("docs").alias("c_count")), "pair-counts")
    of_a = (F.col("c_pair") / size_b).cast("int")
    # one row for each A id: its number is bounded by the vocabulary
    best = counts.groupBy(of_a.alias("b_id")).agg(F.max("c_count").alias("most"))
    return counts.join(best, of_a == F.col("b_id")).select("c_pair", "c_count", (F.col("c_count") == F.col("most")).alias("is_best"))


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", block_pairs: int = BLOCK_PAIRS, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs; a, b, count, is_best of each linked pair of ids."""
    spark = docs.sparkSession
    prepare(spark)
    size_b = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    rows = materialize(align_blocks(docs, byte_path, piece_path, id_col, text_col, block_pairs), "aligned")
    entries = rows.where("is_dictionary").select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("e")).select("block", F.col("e.pairs").alias("pair"), F.col("e.counts").cast("long").alias("docs"))
    counts = materialize(pair_counts(entries, size_b, salts), "pair-best")
    known = entries.join(counts, F.col("pair") == F.col("c_pair")).select(F.col("block").alias("of_block"), "pair", "c_count", "is_best")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        pair, count, best = (right.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "c_count", "is_best"))
        order = np.argsort(pair)
        pair, count, best = pair[order], count[order], best[order]
        lists = left.column("pairs").combine_chunks()
        n = left.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        at = np.searchsorted(pair, lists.flatten().to_numpy())
        ends = np.asarray(lists.offsets)
        ends = ends - ends[0]
        sums = [np.concatenate(([0], np.cumsum(x))) for x in (n * best[at], n * count[at])]
        n_best, count_sum = (pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)
        return pa.table([left.column("doc_id"), *[left.column(c) for c in COUNTS], n_best, count_sum, left.column("groups_sha256")], names=["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    blocks = rows.where("not is_dictionary").drop("is_dictionary")
    found = blocks.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(look_up, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, n_best long, count_sum long, groups_sha256 string")
    return found, counts.select((F.col("c_pair") / size_b).cast("int").alias("a"), (F.col("c_pair") % size_b).alias("b"), F.col("c_count").alias("count"), "is_best")

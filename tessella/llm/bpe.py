"""BPE encoding and decoding by speculation and verification.

A word's tokens are proposed by greedy longest match. The proposal is the BPE encoding if and only if every adjacent
pair of tokens is compatible, that is, if merging the two tokens' own text by rank would not join anything across their
border. All pairs of all new words of a batch are tested at once on arrays: from the two whole tokens the test walks
down their merge trees in reverse order of creation and looks whether a merge across the border comes earlier than the
next merge on either side. Only words with an incompatible pair are merged exactly.

The vocabulary has word ends: text is brought to NFC and lower case, cut into words by the vocabulary's pattern, white
space is dropped, and a word's last byte carries the end mark. Special tokens are recognised in the raw text. Decoding
joins the tokens' strings with spaces, as the vocabulary file names no decoder.

Defined results: a null text is empty and has no tokens; repeated rows are rows of their own; an empty table gives an
empty result; other columns are ignored or, with ``carry``, passed on.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import arrow_map, unclashed

#: Words whose encoding a task remembers, and characters in them.
CACHE, CACHE_CHARS = 120_000, 8 << 20
#: Unicode White_Space, as the word pattern of the vocabulary file has it (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def character_kinds(path: str) -> np.ndarray:
    """For each code point L, N or another letter, by its general category.

    Python and the regex module know different versions of Unicode; where they differ, the pre-tokenizer of the
    vocabulary file is asked whether the character joins a letter, stands alone or joins a symbol.
    """
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    kinds = np.full(0x110000, "S")
    kinds[points] = [unicodedata.category(chr(c))[0] for c in points]
    newer = np.full(0x110000, "S")
    for kind in "LN":
        newer[[ord(c) for c in regex.findall(rf"\p{{{kind}}}", "".join(map(chr, points)))]] = kind
    known = np.where(np.isin(kinds, ["L", "N"]), kinds, "S")
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    for c in np.flatnonzero(known != newer).tolist():
        pieces = split(f"a{chr(c)}!")
        known[c] = "N" if len(pieces) == 3 else "L" if pieces[0][1][1] > 1 else "S"
    return known


def character_class(kinds: np.ndarray, kind: str) -> str:
    """The characters of a kind as ranges of a character class."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], kinds == kind, [False])).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def words_pattern(path: str) -> re.Pattern:
    """The vocabulary file's word pattern."""
    kinds = character_kinds(path)
    letter, number = character_class(kinds, "L"), character_class(kinds, "N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+")


#: The same pattern for lower-cased text of ASCII and Latin letters only, and what makes a text another one.
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff\u0101-\u017f]+|[0-9]|[!-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]+")
NOT_PLAIN = re.compile(r"[^\x00-\x7f\xdf-\xf6\xf8-\xff\u0101-\u017f]")
NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if it is printable, else the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tables of a BPE vocabulary file: token strings, ids, ranks of merges and halves of tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in file.get("added_tokens") or []}
        size = max(chain(self.ids.values(), self.special.values())) + 1
        self.strings = [""] * size
        for token, i in chain(self.ids.items(), self.special.items()):
            self.strings[i] = token
        self.rank, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges[a, b] = rank, made
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, a, b
        self.made = [m for _, m in self.merges.values()]
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.key_rank = size, keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        # length of the longest token for each beginning of up to four letters, the end mark not counted
        self.longest: dict[str, int] = {}
        for token in self.ids:
            bare = token.removesuffix(self.suffix) if self.suffix and token != self.suffix else token
            for n in range(1, min(4, len(bare)) + 1):
                self.longest[bare[:n]] = max(self.longest.get(bare[:n], 1), len(bare))
        self.rank_of = {a * size + b: r for (a, b), (r, _) in self.merges.items()}
        self.pattern = words_pattern(path)
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """The words of a piece of text without special tokens."""
        if text.isascii():
            return PLAIN_WORDS.findall(text.lower())
        # composition and lower-casing leave plain text plain
        lower = text.lower()
        if not NOT_PLAIN.search(lower):
            return PLAIN_WORDS.findall(lower)
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def greedy(self, letters: str) -> list[int]:
        """Proposal: the longest token at each place."""
        ids, longest, out, at, n = self.ids.get, self.longest.get, [], 0, len(letters)
        marked = letters + self.suffix
        while at < n:
            # if no token begins with the next four letters, three are the most
            end = at + longest(letters[at : at + 4], 3)
            if end >= n:
                got, end = ids(marked[at:]), n
                if got is not None:
                    out.append(got)
                    break
                end -= 1
            while (got := ids(letters[at:end])) is None:
                end -= 1
            out.append(got)
            at = end
        return out

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether nothing merges across their border."""
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.copy(), b.copy()
        up_a, up_b = np.full(len(a), NEVER - 1), np.full(len(a), NEVER - 1)
        while len(at):
            m = self.merge_rank(a, b)
            # of equal ranks the place further left goes first
            joins = (m < up_a) & (m <= up_b)
            ok[at[joins]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~joins & ((ra >= 0) | (rb >= 0))
            at, a, b, up_a, up_b, ra, rb = (x[go] for x in (at, a, b, up_a, up_b, ra, rb))
            down_a = ra > rb
            up_a, up_b = np.where(down_a, ra, up_a), np.where(down_a, up_b, rb)
            a, b = np.where(down_a, self.right[a], a), np.where(down_a, b, self.left[b])
        return ok

    def exact(self, letters: str) -> list[int]:
        """Merges by rank, further left first."""
        token = [self.ids[c] for c in letters[:-1]] + [self.ids[letters[-1] + self.suffix]]
        return self._merge_short(token) if len(token) <= 64 else self._merge_long(token)

    def _merge_short(self, token: list[int]) -> list[int]:
        """The least rank is looked up in a list."""
        get, made, size = self.rank_of.get, self.made, self.size
        rank = [get(a * size + b, NEVER) for a, b in zip(token, token[1:], strict=False)]
        while rank:
            least = min(rank)
            if least == NEVER:
                break
            i = rank.index(least)
            new = token[i] = made[least]
            del token[i + 1], rank[i]
            if i:
                rank[i - 1] = get(token[i - 1] * size + new, NEVER)
            if i < len(rank):
                rank[i] = get(new * size + token[i + 1], NEVER)
        return token

    def _merge_long(self, token: list[int]) -> list[int]:
        """A heap over linked symbols."""
        n = len(token)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self.merges[p][0], i, p) for i in range(n - 1) if (p := (token[i], token[i + 1])) in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j < 0 or token[j] != b:
                continue
            token[i], token[j], after[i] = self.merges[a, b][1], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (p := (token[left], token[after[left]])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], left, p))
        return [t for t in token if t >= 0]

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of each of the words."""
        words = list(words)
        shown = [w if w.isascii() and w.isprintable() else w.encode("utf-8").decode("latin-1").translate(self.letters) for w in words]
        proposals = [self.greedy(s) for s in shown]
        counts = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(counts.sum()))
        of = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(of[1:] == of[:-1]) if len(flat) else np.zeros(0, np.int64)
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        ok = self.compatible(pairs // self.size, pairs % self.size)[back]
        for i in np.unique(of[inner[~ok]]).tolist():
            proposals[i] = self.exact(shown[i])
        return dict(zip(words, proposals, strict=True))

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(special?, piece) of a text."""
        if self.split is None or "<|" not in text:
            yield False, text
            return
        for i, piece in enumerate(self.split.split(text)):
            if piece:
                yield i % 2 == 1, piece

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


class Encoder:
    """Encodes texts with a memory of words that is bounded in words and in their characters: the recent ones and, until that is full, those before."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE, chars: int = CACHE_CHARS) -> None:
        self.v, self.cache, self.chars, self.known, self.old, self.held = vocabulary, cache, chars, {}, {}, 0

    def _learn(self, words: set[str]) -> None:
        """Makes the words known."""
        if len(self.known) > self.cache or self.held > self.chars:
            self.known, self.old, self.held = {}, self.known if self.held <= self.chars else {}, 0
        else:
            words = words.difference(self.known)
        if self.old:
            found = {w: self.old[w] for w in words if w in self.old}
            self.known.update(found)
            self.held += sum(map(len, found))
            words = words.difference(found)
        if words:
            self.known.update(self.v.encode_words(words))
            self.held += sum(map(len, words))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        v = self.v
        docs = [[(special, [p] if special else v.words(p)) for special, p in v.pieces(t)] for t in texts]
        words: set[str] = set()
        for d in docs:
            for special, ws in d:
                if not special:
                    words.update(ws)
        self._learn(words)
        get = self.known.__getitem__
        return [list(chain.from_iterable([v.special[ws[0]]] if special else chain.from_iterable(map(get, ws)) for special, ws in d)) for d in docs]


_encoders: dict[int, Encoder] = {}


def worker_encoder(number: int, vocabulary: Vocabulary) -> Encoder:
    """The Python worker's encoder for a broadcast vocabulary: the words that a task has met are known to the worker's next one."""
    if number not in _encoders:
        _encoders.clear()
        _encoders[number] = Encoder(vocabulary)
    return _encoders[number]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, ids array<int>; with carry those columns too, prefixed by ``c_``; with decoded the text that the ids decode to.

    The vocabulary's tables are read on the driver from path and broadcast; their size is that of the vocabulary.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    number = vocabulary._jbroadcast.id()  # the worker must not hold the words of another vocabulary
    chosen = unclashed(docs, id_col, text_col, *carry or []).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"c_{c}") for c in carry or []])
    kept = [c for c in chosen.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, strings = worker_encoder(number, vocabulary.value), pa.array(vocabulary.value.strings)
        for batch in batches:
            for at in range(0, len(batch), 250):
                part = batch.slice(at, 250)
                ids = pa.array(encoder.encode_batch(part.column("text").to_pylist()), pa.list_(pa.int32()))
                texts = [decode_lists(ids, strings)] if decoded else []
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], ids, *texts], names=[*kept, "ids", *["decoded"] * decoded])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text")
    return arrow_map(chosen, run, f"{schema}, ids array<int>" + ", decoded string" * decoded)


def decode_lists(ids: pa.ListArray, strings: pa.Array) -> pa.Array:
    """The text of each list of ids."""
    return pc.binary_join(pa.ListArray.from_arrays(_offsets(ids), strings.take(ids.flatten())), " ")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded: the text of ids_col, special tokens included."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path).strings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.array(vocabulary.value)
        for batch in batches:
            for at in range(0, len(batch), 250):
                part = batch.slice(at, 250)
                yield pa.RecordBatch.from_arrays([*part.columns, decode_lists(part.column(ids_col), strings)], names=[*part.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return arrow_map(encoded, run, f"{schema}, decoded string")


def _offsets(lists: pa.ListArray) -> pa.Array:
    sizes = np.array([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()], np.int64)
    return pa.array(np.cumsum(sizes), pa.int32())

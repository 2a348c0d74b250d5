"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; one binary classifier for each bit, a logistic regression on hashed letter
trigrams, predicts the bit. The margins are decoded to the codeword of least loss, the logistic losses of the bits
weighted by how well the bit's classifier does on the training rows. The score is the softmax share of the chosen
codeword, and a text whose runner-up is too near is flagged as ambiguous.

The classifiers are fitted on a bounded sample: rows whose hash is below SAMPLE / (rows of their language), so about
SAMPLE whole texts of each language, fewer where that would be over MOST_ROWS in all. Their feature vectors are made on the executors and fitted on the driver.

Defined results: ``und`` with score 0 for a null text, one without a letter, or without anything to learn from; ties go
to the language first in code point order; rows without a language teach nothing; repeated rows count as rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import arrow_map, unclashed

SAMPLE, BITS, AMBIGUOUS = 400, 12, 0.6
#: Rows of all languages together that are fitted on, about.
MOST_ROWS = 20_000
_LETTER = re.compile("[A-Za-z]")
#: Bytes of letters stay (A-Z is lower-cased before), all else is a space.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def trigram_counts(texts: list[str], bits: int = BITS) -> np.ndarray:
    """Counts (texts x 2^bits) of the hashed byte trigrams around a letter; whole texts."""
    size = 1 << bits
    out = np.zeros((len(texts), size), np.float32)
    for row, text in enumerate(texts):
        b = np.frombuffer(b" " + text.lower().encode().translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
        middle = b[1:-1] != 32
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        out[row] = np.bincount((code[middle] * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=size)
    return out


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: rows of length 1."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords (+1/-1): all columns that tell any of the languages apart for up to 5, beyond it the best of random codes by least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        columns = [[1, *(1 if c >> i & 1 else -1 for i in range(n - 1))] for c in range((1 << (n - 1)) - 1)]
        return np.array(columns, np.float64).T
    rng, length = np.random.default_rng(seed), 12 * int(np.ceil(np.log2(n)))
    best, most = None, -1
    for _ in range(60):
        code = rng.choice([-1.0, 1.0], (n, length))
        code[0, np.abs(code.sum(axis=0)) == n] *= -1  # no constant bits
        distance = int(((length - code @ code.T) / 2 + length * np.eye(n)).min())
        if distance > most:
            best, most = code, distance
    return best


def fit_bits(x: np.ndarray, bits: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of all bits at once (accelerated gradient): weights (features x bits) and intercepts."""
    mean = x.mean(axis=0)
    x = x - mean
    scale = float(np.sqrt(max((x * x).sum(axis=1).mean(), 1e-12)))
    x = x / scale
    w, c = np.zeros((x.shape[1], bits.shape[1])), np.zeros(bits.shape[1])
    lw, lc = w, c
    for t in range(steps):
        vw, vc = w + t / (t + 3) * (w - lw), c + t / (t + 3) * (c - lc)
        g = -bits / (1 + np.exp(np.clip(bits * (x @ vw + vc), -50, 50))) / len(x)
        lw, lc = w, c
        w, c = vw - 2 * (x.T @ g + penalty * vw), vc - 2 * g.sum(axis=0)
    w = w / scale
    return w, c - mean @ w


@dataclass
class Model:
    """What predictions need; a few hundred KB."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    bit_weights: np.ndarray

    def losses(self, counts: np.ndarray) -> np.ndarray:
        margins = scaled(counts) @ self.weights + self.intercepts
        return np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.bit_weights

    def decode(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and margins to the runner-up's score."""
        loss = self.losses(counts)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        top = np.sort(share, axis=1)[:, ::-1]
        gap = top[:, 0] - (top[:, 1] if share.shape[1] > 1 else 0)
        return [self.languages[i] for i in best], top[:, 0], gap


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample: int = SAMPLE, bits: int = BITS) -> Model | None:
    """Fits on a hash sample of rows; None if there is nothing to learn from."""
    rows = unclashed(rows, lang_col, text_col, key_col)
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("langid"), F.col(key_col)).alias("h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    each = min(sample, max(1, MOST_ROWS // len(counts)))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    taken = rows.where(F.pmod(F.col("h"), F.lit(1_000_003)) < F.lit(1_000_003) * F.element_at(share, F.col("lang")))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, t in enumerate(batch.column("text").to_pylist()) if has_letter(t)]
            part = batch.take(pa.array(keep, pa.int64()))
            counts = trigram_counts(part.column("text").to_pylist(), bits)
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array([v.tobytes() for v in counts], pa.binary())], names=["lang", "h", "counts"])

    got = sorted(arrow_map(taken, vectors, "lang string, h long, counts binary").collect(), key=lambda r: (r.lang, r.h, bytes(r.counts)))
    if not got:
        return None
    languages = sorted({r.lang for r in got})
    code = codewords(len(languages))
    x = scaled(np.stack([np.frombuffer(bytes(r.counts), np.float32) for r in got]).astype(np.float64))
    y = np.array([languages.index(r.lang) for r in got])
    if len(languages) == 1:
        return Model(languages, code, np.zeros((x.shape[1], 1)), np.full(1, 3.0), np.ones(1))
    weights, intercepts = fit_bits(x, code[y])
    right = ((x @ weights + intercepts) * code[y] > 0).mean(axis=0)
    bit_weights = np.maximum(right - 0.5, 0.01) * 2
    return Model(languages, code, weights, intercepts, bit_weights / bit_weights.mean())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", ambiguous: float = AMBIGUOUS) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, ambiguous."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for at in range(0, len(batch), 250):
                part = batch.slice(at, 250)
                texts = [t or "" for t in part.column("text").to_pylist()]
                known = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
                lang, score, unsure = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if known:
                    for i, name, s, gap in zip(known, *m.decode(trigram_counts([texts[i] for i in known], m.weights.shape[0].bit_length() - 1)), strict=True):
                        lang[i], score[i], unsure[i] = name, float(s), bool(gap < 2 * ambiguous - 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    rows = unclashed(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, "doc_id long, lang_pred string, score double, ambiguous boolean")

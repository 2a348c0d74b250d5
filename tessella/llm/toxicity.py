"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta_k - w . x) with one weight vector for all ordered thresholds theta. Features are sparse:
1 + log(count) of words and of word beginnings of 4 to 6 bytes that mark toxic documents, which are all that pass a
likelihood-ratio test with a bound for the number of features tested. The result is the expected severity, the sum of
P(grade > k).

Labels say toxic or not, so the order of toxic documents is cross-fitted: the labelled rows are cut into FOLDS by a hash
of the id, and each toxic document is scored by a model (features chosen and weights fitted) of the other folds, which
has not seen it. Grade 0 is a document labelled as not toxic, grades 1 to 3 are the terciles of those scores.

Fitting uses a bounded sample of labelled rows, those with a hash below SAMPLE / (number of labels); the number of
features is bounded by the sample's texts alone. Features are counted and tested on the executors, over whole texts.

Defined results: a null or empty text has no features and the severity of the thresholds alone; without any toxic label
all severities are 0; several labels of a document count as the highest; rows that share a labelled id teach by the
greatest of their texts; other columns are ignored or pass unchanged, but for one with the name of the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import arrow_map, materialize, prepare, unclashed

SAMPLE, GRADES, FOLDS = 8000, 4, 3
_NOT_WORD = re.compile(rb"[\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_TABLE = bytes(32 if _NOT_WORD.match(bytes([b])) else b for b in range(256))
STEMS = (4, 5, 6)


def words_of(text: str) -> Counter:
    """Counts of the lower-cased words (UTF-8 bytes)."""
    return Counter(text.lower().encode().translate(_TABLE).split())


def features_of(word: bytes) -> list[bytes]:
    return [b"w:" + word, *(b"%d:" % n + word[:n] for n in STEMS if len(word) > n)]


@dataclass
class Model:
    """Weights of the chosen features, thresholds in order."""

    index: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def vector(self, text: str) -> tuple[dict[int, int], int]:
        """Counts of the chosen features, and the number of marked words."""
        counts: dict[int, int] = {}
        marked = 0
        index = self.index
        for word, n in words_of(text).items():
            hit = False
            for f in features_of(word):
                i = index.get(f)
                if i is not None:
                    counts[i] = counts.get(i, 0) + n
                    hit = True
            marked += n * hit
        return counts, marked

    def grade_probabilities(self, latent: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        above = 1 / (1 + np.exp(-np.clip(latent[:, None] - self.thresholds[None, :], -500, 500)))
        return np.where(np.isinf(self.thresholds)[None, :], 0.0, above)

    def latent(self, counts: dict[int, int]) -> float:
        return float(sum(self.weights[i] * (1 + math.log(n)) for i, n in counts.items()))


@dataclass
class Rows:
    """A sparse matrix: for each entry its row, column and value."""

    n: int
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def transposed(self, g: np.ndarray, d: int) -> np.ndarray:
        return np.bincount(self.column, self.value * g[self.row], d)

    def take(self, keep: np.ndarray) -> Rows:
        """The rows that are marked."""
        at, number = keep[self.row], np.cumsum(keep) - 1
        return Rows(int(keep.sum()), number[self.row[at]], self.column[at], self.value[at])


def fit_ordinal(x: Rows, d: int, y: np.ndarray, grades: int = GRADES, penalty: float = 2e-5, steps: int = 2000, balanced: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Proportional-odds fit of d weights by accelerated gradient; thresholds stay ordered as a first one plus exponentials.

    If balanced, grade 0 and the other grades together weigh alike. Rows without any feature, most of them, count as one row for each
    grade, with its weight.
    """
    share = np.array([np.clip((y <= k).mean(), 0.02, 0.98) for k in range(grades - 1)])
    blank = np.bincount(x.row, minlength=x.n) == 0
    balance = np.where(y == 0, 0.5 / max(1, (y == 0).sum()), 0.5 / max(1, (y > 0).sum())) if balanced else np.ones(len(y))
    weight = np.concatenate((balance[~blank], np.bincount(y[blank], balance[blank], minlength=grades)))
    x, y = x.take(~blank), np.concatenate((y[~blank], np.arange(grades)))
    x = Rows(x.n + grades, x.row, x.column, x.value)
    weight = weight / weight.sum()
    theta = np.log(share / (1 - share))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(grades - 1))
    p = np.concatenate((np.zeros(d), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-2))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        w, gaps = p[:d], np.exp(np.clip(p[d + 1 :], -8, 4))
        theta = p[d] + np.concatenate(([0.0], np.cumsum(gaps)))
        z = x @ w
        upper = np.where(y < grades - 1, sigmoid(theta[np.minimum(y, grades - 2)] - z), 1.0)
        lower = np.where(y > 0, sigmoid(theta[np.maximum(y - 1, 0)] - z), 0.0)
        q = np.maximum(upper - lower, 1e-12)
        du, dl = weight * upper * (1 - upper) / q, weight * lower * (1 - lower) / q
        g_theta = np.zeros(grades - 1)
        np.add.at(g_theta, np.minimum(y, grades - 2), np.where(y < grades - 1, -du, 0))
        np.add.at(g_theta, np.maximum(y - 1, 0), np.where(y > 0, dl, 0))
        g = np.concatenate((x.transposed(du - dl, d) + penalty * w, [g_theta.sum()], g_theta[::-1].cumsum()[::-1][1:] * gaps))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w, gaps = p[:d], np.exp(np.clip(p[d + 1 :], -8, 4))
    return w, p[d] + np.concatenate(([0.0], np.cumsum(gaps)))


def marking(a: Column, b: Column, n1: int, n0: int, bound: float) -> Column:
    """Whether a feature of a of n1 toxic and b of n0 clean documents is commoner in the toxic ones and passes the likelihood-ratio test."""
    if not n1 or not n0:
        return F.lit(False)
    q = (a + b) / F.lit(n1 + n0)
    term = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(F.lit(0.0))
    g2 = 2 * (term(a, n1 * q) + term(b, n0 * q) + F.when(q < 1, term(n1 - a, n1 * (1 - q)) + term(n0 - b, n0 * (1 - q))).otherwise(F.lit(0.0)))
    return (a * n0 > b * n1) & (g2 >= bound)


def cross_fitted(x: Rows, index_of: list[np.ndarray], fold: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """A score of each row by a binary model of the other folds; index_of: the columns that each of those models has."""
    score = np.zeros(len(toxic))
    for f, columns in enumerate(index_of):
        number = np.full(int(x.column.max(initial=0)) + 1, -1)
        number[columns] = np.arange(len(columns))
        has = number[x.column] >= 0
        own = Rows(x.n, x.row[has], number[x.column[has]], x.value[has])
        others = fold != f
        if toxic[others].any() and not toxic[others].all():
            w, _ = fit_ordinal(own.take(others), len(columns), toxic[others], 2, steps=1000)
            score[fold == f] = (own @ w)[fold == f]
    return score


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on a bounded hash sample of the labelled documents."""
    spark = docs.sparkSession
    prepare(spark)
    labels = unclashed(labels, id_col, label_col)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("l_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    total = marks.count()
    # at most about ``sample`` rows of two numbers: a bounded broadcast
    chosen = marks.where(F.pmod(F.xxhash64(F.lit("toxicity"), "l_id"), F.lit(1_000_003)) < F.lit(1_000_003 * min(1.0, sample / max(1, total))))
    texts = unclashed(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("l_id"), "inner").select("id", "toxic", "text")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = materialize(rows.groupBy("id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")).select("id", fold, "toxic", "text"), "toxic-sample")
    n = {(r.toxic, r.fold): r.n for r in rows.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    count = lambda toxic, but=None: sum(c for (t, f), c in n.items() if t == toxic and f != but)
    nothing = Model({}, np.zeros(0), np.full(GRADES - 1, np.inf))
    if not count(1) or not count(0):
        return nothing
    kinds = [(t, f) for t in (0, 1) for f in range(FOLDS)]
    names = [f"n_{t}_{f}" for t, f in kinds]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tallies = {kind: Counter() for kind in kinds}
            for toxic, part, text in zip(batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tallies[toxic, part].update({f for w in words_of(text) for f in features_of(w)})
            for kind, tally in tallies.items():
                columns = [pa.array([c if k == kind else 0 for c in tally.values()], pa.int64()) for k in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), *columns], names=["feature", *names])

    tallied = arrow_map(rows, counted, "feature binary, " + ", ".join(f"{c} long" for c in names)).groupBy("feature").agg(*[F.sum(c).alias(c) for c in names])
    tallied = materialize(tallied, "toxic-features")
    bound = 2 * math.log(max(tallied.count(), 1) / 0.01)
    # one choice of features without each fold, and one of all rows
    cases = [*range(FOLDS), None]
    of = lambda toxic, but: sum((F.col(f"n_{toxic}_{f}") for f in range(FOLDS) if f != but), F.lit(0))
    flags = [marking(of(1, but), of(0, but), count(1, but), count(0, but), bound).alias(f"c_{i}") for i, but in enumerate(cases)]
    passing = sorted((bytes(r.feature), [r[f"c_{i}"] for i in range(len(cases))]) for r in tallied.select("feature", *flags).where(" or ".join(f"c_{i}" for i in range(len(cases)))).collect())
    if not any(c[-1] for _, c in passing):
        return nothing
    every = Model({f: i for i, (f, _) in enumerate(passing)}, np.zeros(len(passing)), np.zeros(GRADES - 1))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [every.vector(t)[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fold"), batch.column("toxic"), pa.array([list(c) for c in got], pa.list_(pa.int32())), pa.array([list(c.values()) for c in got], pa.list_(pa.int64()))], names=["id", "fold", "toxic", "at", "n"])

    got = sorted(arrow_map(rows, vectors, "id long, fold int, toxic int, at array<int>, n array<long>").collect(), key=lambda r: r.id)
    toxic, part = np.array([r.toxic for r in got]), np.array([r.fold for r in got])
    x = Rows(len(got), np.repeat(np.arange(len(got)), [len(r["at"]) for r in got]), np.array([i for r in got for i in r["at"]], np.int64), 1 + np.log(np.array([c for r in got for c in r["n"]], float)))
    chosen_by = [np.flatnonzero([c[i] for _, c in passing]) for i in range(len(cases))]
    score = cross_fitted(x, chosen_by[:-1], part, toxic)
    cuts = np.quantile(score[toxic == 1], [1 / 3, 2 / 3])
    y = np.where(toxic == 1, 1 + (score > cuts[0]) + (score > cuts[1]), 0)
    number = np.full(len(passing), -1)
    number[chosen_by[-1]] = np.arange(len(chosen_by[-1]))
    has = number[x.column] >= 0
    weights, thresholds = fit_ordinal(Rows(x.n, x.row[has], number[x.column[has]], x.value[has]), len(chosen_by[-1]), y)
    return Model({passing[i][0]: k for k, i in enumerate(chosen_by[-1].tolist())}, weights, thresholds)


def severity(model: Model, text: Column) -> Column:
    """struct(severity, grade, p_toxic, marked) of a text: expected severity, the likeliest grade, P(grade > 0), marked words."""

    @F.pandas_udf("severity double, grade int, p_toxic double, marked long")
    def score(texts: pd.Series) -> pd.DataFrame:
        got = [model.vector(t or "") for t in texts]
        above = model.grade_probabilities(np.array([model.latent(c) for c, _ in got])) if got else np.zeros((0, GRADES - 1))
        share = -np.diff(np.concatenate((np.ones((len(got), 1)), above, np.zeros((len(got), 1))), axis=1), axis=1)
        return pd.DataFrame({"severity": above.sum(axis=1), "grade": share.argmax(axis=1).astype("int32"), "p_toxic": above[:, 0], "marked": np.array([m for _, m in got], dtype="int64")})

    return score(text)


def grade_documents(docs: DataFrame, model: Model, text_col: str = "text", column: str = "tox") -> DataFrame:
    """docs with a column tox (see severity()), in place of one of that name."""
    prepare(docs.sparkSession)
    passed = [c for c in docs.columns if c != column]
    plain = unclashed(docs, text_col, column).drop(column)
    return plain.withColumn(column, severity(model, F.col(text_col))).toDF(*passed, column)


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs whose P(grade > 0) is under ``least``."""
    prepare(docs.sparkSession)
    return unclashed(docs, text_col).where(severity(model, F.col(text_col))["p_toxic"] < least).toDF(*docs.columns)

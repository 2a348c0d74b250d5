"""Vector distances as Catalyst expressions, and their registry.

Each entry makes a Column from two array columns; all stay inside the JVM. Names are those users of such tables know:
``cosine`` is the plain inner product used as a distance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column

Expression = Callable[[Column, Column], Column]


def _doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def trivial(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.abs(x - y)))


def squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared(a, b))


def l1_int(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def l2_int(a: Column, b: Column) -> Column:
    """Root of the sum of squares, cut to an integer."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.floor(F.sqrt(total.cast("double"))).cast("long")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of arrays of bytes (values 0 to 255)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.cast("int").bitwiseXOR(y.cast("int")).bitwiseAND(F.lit(255)))), F.lit(0), lambda s, x: s + x).cast("long")


def l1_weighted(a: Column, b: Column, w: Column) -> Column:
    return _sum(F.zip_with(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.abs(x - y)), _doubles(w), lambda d, v: d * v))


def l2_weighted(a: Column, b: Column, w: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), _doubles(w), lambda d, v: d * v)))


def l2_threshold(a: Column, b: Column, limit: float) -> Column:
    """The L2 distance, or null beyond the limit."""
    d = l2(a, b)
    return F.when(d <= limit, d)


VECTOR_DISTANCES: dict[str, Expression] = {"trivial": trivial, "L1_int": l1_int, "L2_int": l2_int, "L1_float": l1, "L2_float": l2, "cosine": dot, "hamming": hamming}

#: The same on NumPy blocks (queries x d, rows x d) for the scans that compare blocks of vectors.
BLOCK_DISTANCES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "trivial": lambda q, x: np.zeros((len(q), len(x))),
    "L1_float": lambda q, x: np.abs(q[:, None, :] - x[None, :, :]).sum(axis=2),
    "L2_float": lambda q, x: np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)),
    "cosine": lambda q, x: (q[:, None, :] * x[None, :, :]).sum(axis=2),
    "L1_int": lambda q, x: np.abs(np.trunc(q)[:, None, :] - np.trunc(x)[None, :, :]).sum(axis=2),
    "L2_int": lambda q, x: np.floor(np.sqrt(((np.trunc(q)[:, None, :] - np.trunc(x)[None, :, :]) ** 2).sum(axis=2))),
    "hamming": lambda q, x: np.bitwise_count(q.astype(np.uint8)[:, None, :] ^ x.astype(np.uint8)[None, :, :]).sum(axis=2).astype(float),
}


def register_distance(name: str, expression: Expression, block: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, replace: bool = False) -> None:
    """Adds a distance under a name of its own."""
    if name in VECTOR_DISTANCES and not replace:
        raise ValueError(f"there is a distance named {name}")
    VECTOR_DISTANCES[name] = expression
    if block is not None:
        BLOCK_DISTANCES[name] = block


def distance(name: str) -> Expression:
    if name not in VECTOR_DISTANCES:
        raise KeyError(f"no distance named {name}; there are {sorted(VECTOR_DISTANCES)}")
    return VECTOR_DISTANCES[name]

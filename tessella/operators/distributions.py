"""Distribution functions and random variates as columns.

Closed forms are built-in expressions. The gamma and beta families need the incomplete gamma and beta functions, which
are series and continued fractions on arrays. Variates are drawn from a row's key and a seed, so they don't change when a
task runs again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column

from .stats import normal_cdf


def _pareto(x: Column, a: float, b: float) -> Column:
    return F.when(x < b, F.lit(0.0)).otherwise(1 - F.pow(F.lit(b) / x, F.lit(a)))


#: From a value and parameters to P(X <= value), by name.
CLOSED: dict[str, Callable[..., Column]] = {
    "uniform": lambda x, a=0.0, b=1.0: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - a) / (b - a))),
    "gaussian": lambda x, sigma=1.0: normal_cdf(x / sigma),
    "lognormal": lambda x, zeta=0.0, sigma=1.0: F.when(x <= 0, F.lit(0.0)).otherwise(normal_cdf((F.log(x) - zeta) / sigma)),
    "exponential": lambda x, mu=1.0: F.when(x <= 0, F.lit(0.0)).otherwise(1 - F.exp(-x / mu)),
    "laplace": lambda x, a=1.0: F.when(x < 0, F.exp(x / a) / 2).otherwise(1 - F.exp(-x / a) / 2),
    "logistic": lambda x, a=1.0: 1 / (1 + F.exp(-x / a)),
    "cauchy": lambda x, a=1.0: F.atan(x / a) / math.pi + 0.5,
    "rayleigh": lambda x, sigma=1.0: F.when(x <= 0, F.lit(0.0)).otherwise(1 - F.exp(-x * x / (2 * sigma * sigma))),
    "weibull": lambda x, a=1.0, b=1.0: F.when(x <= 0, F.lit(0.0)).otherwise(1 - F.exp(-F.pow(x / a, F.lit(b)))),
    "pareto": _pareto,
    "gumbel": lambda x, a=1.0, b=1.0: F.exp(-b * F.exp(-a * x)),
    "gumbel2": lambda x, a=1.0, b=1.0: F.when(x <= 0, F.lit(0.0)).otherwise(F.exp(-b * F.pow(x, F.lit(-a)))),
    "geometric": lambda k, p=0.5: F.when(k < 1, F.lit(0.0)).otherwise(1 - F.pow(F.lit(1 - p), F.floor(k))),
}
_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: its series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.where(x > 0, 0.0, 0.0)
    with np.errstate(all="ignore"):
        scale = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - _log_gamma(a))
        term = total = 1 / a
        for n in range(1, 2000):
            term = term * x / (a + n)
            total = total + term
            if np.all((np.abs(term) < 1e-17 * np.abs(total)) | (x > a + 1)):
                break
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d
        for n in range(1, 2000):
            b = b + 2
            d = 1 / (b + n * (a - n) * d)
            c = b + n * (a - n) / c
            h = h * d * c
            if np.all((np.abs(d * c - 1) < 1e-15) | (x <= a + 1)):
                break
        out = np.where(x <= a + 1, scale * total, 1 - scale * h)
    return np.where(x <= 0, 0.0, np.clip(out, 0, 1))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, on the side where that converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0, 1)
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(np.maximum(y, 1e-300)) + q * np.log(np.maximum(1 - y, 1e-300))) / p
        c, d = np.ones_like(y), 1 / (1 - (p + q) * y / (p + 1))
        h = d
        for m in range(1, 2000):
            for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1 / (1 + top * d), 1 + top / c
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out = np.where(y <= 0, 0.0, front * h)
    return np.clip(np.where(swap, 1 - out, out), 0, 1)


#: Distributions of the gamma and beta families, on arrays.
FAMILIES: dict[str, Callable[..., np.ndarray]] = {
    "gamma": lambda x, a, b=1.0: incomplete_gamma(a, x / b),
    "chisq": lambda x, nu: incomplete_gamma(nu / 2, x / 2),
    "erlang": lambda x, a, n: incomplete_gamma(n, x / a),
    "beta": lambda x, a, b: incomplete_beta(a, b, x),
    "t": lambda x, nu: np.where(x < 0, 1 - 0.5 * (2 - incomplete_beta(nu / 2, 0.5, nu / (nu + x * x))), 1 - 0.5 * incomplete_beta(nu / 2, 0.5, nu / (nu + x * x))),
    "F": lambda x, n, m: incomplete_beta(n / 2, m / 2, np.where(x > 0, n * x / (n * x + m), 0.0)),
    "poisson": lambda k, mu: np.where(k < 0, 0.0, 1 - incomplete_gamma(np.maximum(np.floor(k), 0) + 1, mu)),
    "binomial": lambda k, n, p: np.where(k < 0, 0.0, np.where(k >= n, 1.0, incomplete_beta(np.maximum(n - np.floor(k), 1e-9), np.maximum(np.floor(k), 0) + 1, 1 - p))),
}


def cdf(kind: str, x: Column, *parameters: float) -> Column:
    """P(X <= x) of a distribution by name."""
    if kind in CLOSED:
        return CLOSED[kind](x, *parameters)
    family = FAMILIES[kind]

    @F.pandas_udf("double")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series(family(values.to_numpy(float), *parameters))

    return of(x.cast("double"))


#: From P(X <= x) between 0 and 1 and parameters to x, by name; the distributions whose functions have closed inverses.
QUANTILES: dict[str, Callable[..., Column]] = {
    "uniform": lambda p, a=0.0, b=1.0: a + (b - a) * p,
    "exponential": lambda p, mu=1.0: -mu * F.log(1 - p),
    "laplace": lambda p, a=1.0: a * F.when(p < 0.5, F.log(2 * p)).otherwise(-F.log(2 * (1 - p))),
    "logistic": lambda p, a=1.0: a * F.log(p / (1 - p)),
    "cauchy": lambda p, a=1.0: a * F.tan(math.pi * (p - 0.5)),
    "rayleigh": lambda p, sigma=1.0: sigma * F.sqrt(-2 * F.log(1 - p)),
    "weibull": lambda p, a=1.0, b=1.0: a * F.pow(-F.log(1 - p), F.lit(1 / b)),
    "pareto": lambda p, a=1.0, b=1.0: b * F.pow(1 - p, F.lit(-1 / a)),
    "gumbel": lambda p, a=1.0, b=1.0: (math.log(b) - F.log(-F.log(p))) / a,
    "gumbel2": lambda p, a=1.0, b=1.0: F.pow(-F.log(p) / b, F.lit(-1 / a)),
    "geometric": lambda p, q=0.5: F.greatest(F.lit(1.0), F.ceil(F.log(1 - p) / math.log(1 - q)).cast("double")),
}


def quantile(kind: str, p: Column, *parameters: float) -> Column:
    """The value x with P(X <= x) = p of a distribution by name, or of a discrete one the least with P(X <= x) >= p; null unless 0 < p < 1."""
    return F.when((p > 0) & (p < 1), QUANTILES[kind](p, *parameters))


def uniform(key: Column, seed: int, salt: int = 0) -> Column:
    """A number in (0, 1) from a key, a seed and a salt."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), key), 11) + 0.5) / float(1 << 53)


def _steps(weights: list[float], u: Column) -> Column:
    """The number of the first partial sum of the weights above u."""
    total, sums = 0.0, []
    for w in weights:
        total += w
        sums.append(total)
    return F.size(F.filter(F.array(*[F.lit(s) for s in sums]), lambda s: s <= u)).cast("double")


def _poisson(mu: float) -> list[float]:
    most = int(mu + 12 * math.sqrt(mu) + 30)
    return [math.exp(k * math.log(mu) - mu - math.lgamma(k + 1)) for k in range(most)]


def _binomial(n: int, p: float) -> list[float]:
    if p in (0.0, 1.0):
        return [float(k == n * p) for k in range(n + 1)]
    return [math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)) for k in range(n + 1)]


#: From two uniform numbers and parameters to a variate, by name.
VARIATES: dict[str, Callable[..., Column]] = {
    "uniform": lambda u, v, a=0.0, b=1.0: a + (b - a) * u,
    "gaussian": lambda u, v, mean=0.0, sigma=1.0: mean + sigma * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v),
    "lognormal": lambda u, v, zeta=0.0, sigma=1.0: F.exp(zeta + sigma * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)),
    "exponential": lambda u, v, mu=1.0: -mu * F.log(u),
    "laplace": lambda u, v, mean=0.0, a=1.0: mean + a * F.when(u < 0.5, F.log(2 * u)).otherwise(-F.log(2 * (1 - u))),
    "logistic": lambda u, v, mean=0.0, a=1.0: mean + a * F.log(u / (1 - u)),
    "cauchy": lambda u, v, a=1.0: a * F.tan(math.pi * (u - 0.5)),
    "rayleigh": lambda u, v, sigma=1.0: sigma * F.sqrt(-2 * F.log(u)),
    "weibull": lambda u, v, a=1.0, b=1.0: a * F.pow(-F.log(u), F.lit(1 / b)),
    "pareto": lambda u, v, a=1.0, b=1.0: b * F.pow(u, F.lit(-1 / a)),
    "gumbel": lambda u, v, a=1.0, b=1.0: (math.log(b) - F.log(-F.log(u))) / a,
    "geometric": lambda u, v, p=0.5: F.ceil(F.log(u) / math.log(1 - p)).cast("double"),
    "bernoulli": lambda u, v, p=0.5: (u < p).cast("double"),
    "poisson": lambda u, v, mu=1.0: _steps(_poisson(mu), u),
    "binomial": lambda u, v, n=1.0, p=0.5: _steps(_binomial(int(n), p), u),
}


def variate(kind: str, key: Column, seed: int, *parameters: float) -> Column:
    """A variate of a distribution by name, drawn from a key and a seed."""
    return VARIATES[kind](uniform(key, seed), uniform(key, seed, 1), *parameters)

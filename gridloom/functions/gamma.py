"""Vectorised incomplete gamma function for Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_gamma(a: np.ndarray) -> np.ndarray:
    """ln Gamma(a) for a > 0 by shifting to a + 8 and Stirling's series."""
    z = a + 8.0
    shift = sum(np.log(a + k) for k in range(8))
    inv = 1.0 / z
    series = inv * (1 / 12 - inv**2 * (1 / 360 - inv**2 * (1 / 1260 - inv**2 / 1680)))
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


# Shape beyond which the uniform asymptotic form is exact to about 1e-10.
LARGE_SHAPE = 1e5


def _uniform(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(a, x) for large a: the normal integral of the deviance, and its first correction."""
    mu = (x - a) / a
    deviance = np.where(np.abs(mu) < 1e-3, mu * mu * (1 - mu * (2 / 3 - mu * (1 / 2 - mu * (2 / 5)))), 2 * (mu - np.log1p(np.maximum(mu, -1 + 1e-300))))
    eta = np.sign(mu) * np.sqrt(np.maximum(deviance, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        first = np.where(np.abs(eta) < 1e-2, -1 / 3 + eta * (1 / 12 - eta * (2 / 135 - eta / 864)), 1 / mu - 1 / eta)
    z = eta * np.sqrt(a / 2)
    erfc = np.frompyfunc(math.erfc, 1, 1)
    return 0.5 * erfc(-z).astype(float) - np.exp(-z * z) / np.sqrt(2 * np.pi * a) * first


def _converged(step, done, start, a: np.ndarray):
    """Repeat ``step`` until ``done``; both forms need some ten square roots of the shape at most."""
    for n in range(1, 200 + int(40 * math.sqrt(max(1.0, float(a.max()))))):
        start = step(n, *start)
        if done(*start):
            return start
    raise ArithmeticError("the incomplete gamma function did not converge")


def regularised_lower_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(a, x): power series where x < a + 1, continued fraction (modified Lentz) elsewhere, both until they
    converge; the uniform asymptotic form for large shapes."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    out[x <= 0] = 0.0
    usable = (x > 0) & (a > 0) & np.isfinite(a)
    out[usable & np.isinf(x)] = 1.0
    usable &= np.isfinite(x)
    large = usable & (a > LARGE_SHAPE)
    if large.any():
        out[large] = _uniform(a[large], x[large])
    low = usable & ~large & (x < a + 1)
    if low.any():
        aa, xx = a[low], x[low]

        def term(n, value, total):
            value = value * xx / (aa + n)
            return value, total + value

        _, total = _converged(term, lambda value, total: np.all(value <= total * 1e-16), (1.0 / aa, 1.0 / aa), aa)
        out[low] = total * np.exp(-xx + aa * np.log(xx) - _log_gamma(aa))
    high = usable & ~large & (x >= a + 1)
    if high.any():
        aa, xx = a[high], x[high]
        tiny = 1e-300

        def fraction(n, b, c, d, h, step):
            an = -n * (n - aa)
            b = b + 2.0
            d = an * d + b
            d = np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            d = 1.0 / d
            return b, c, d, h * (d * c), d * c

        b = xx + 1.0 - aa
        first = (b, np.full(aa.shape, 1.0 / tiny), 1.0 / b, 1.0 / b, np.zeros(aa.shape))
        *_, h, _ = _converged(fraction, lambda b, c, d, h, step: np.all(np.abs(step - 1.0) < 1e-14), first, aa)
        out[high] = 1.0 - np.exp(-xx + aa * np.log(xx) - _log_gamma(aa)) * h
    return out


@F.pandas_udf(T.DoubleType())
def gamma_cdf(x: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
    """CDF of the Gamma distribution with shape ``alpha`` and rate ``beta``."""
    p = regularised_lower_gamma(alpha.to_numpy(float), x.to_numpy(float) * beta.to_numpy(float))
    return pd.Series(np.where(x.isna(), np.nan, p)).where(~x.isna())


def register(spark) -> None:
    """Make the vectorised functions callable by name from SQL."""
    spark.udf.register("gamma_cdf", gamma_cdf)

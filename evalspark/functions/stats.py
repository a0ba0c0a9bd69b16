"""Exact test probabilities as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Terms of a binomial tail worked out at a time.
TERMS = 65_536


def _stirling_error(n: float) -> float:
    """``log(n!)`` less Stirling's approximation."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * m)) / m) / m) / n


def _deviance(x: float, mean: float) -> float:
    """``x log(x / mean) + mean - x``, without cancellation where both are close."""
    v = (x - mean) / (x + mean)
    if abs(v) >= 0.1:
        return x * math.log(x / mean) + mean - x
    total, term, j = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def binomial_half(k: int, n: int) -> float:
    """Probability of ``k`` heads of ``n`` throws of a fair coin (Loader 2000)."""
    if k == 0 or k == n:
        return math.exp(-n * math.log(2.0))
    other = n - k
    log = _stirling_error(n) - _stirling_error(k) - _stirling_error(other) - _deviance(k, n / 2) - _deviance(other, n / 2)
    return math.exp(log) * math.sqrt(n / (2 * math.pi * k * other))


def split_probability(b: int, c: int) -> float:
    """Two-sided probability of a split of ``b + c`` as uneven as ``b`` to ``c``.

    Terms fall from the smaller count down; they are summed until they no longer count,
    which takes about the square root of the total.
    """
    low, n = min(b, c), b + c
    if n == 0 or b == c:
        return 1.0
    term = binomial_half(low, n)
    total = term
    at = low
    while at > 0 and term > total * 1e-17:
        i = np.arange(at, max(0, at - TERMS), -1, dtype=np.float64)
        terms = term * np.cumprod(i / (n - i + 1))
        total += float(terms.sum())
        term, at = float(terms[-1]), at - len(i)
    return min(1.0, 2 * total)


@F.pandas_udf(T.DoubleType())
def _split_probability(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(y) else split_probability(int(x), int(y)) for x, y in zip(b, c)], dtype="float64")


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided exact binomial probability of a split as uneven as ``b`` to ``c``.

    One when the raters never disagree, null where a count is. The rows are one per pair
    of raters.
    """
    return _split_probability(b.cast("long"), c.cast("long"))


def chi2_upper(x: float, df: int) -> float:
    """Upper tail of chi-square for a whole number of degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        total, log_term = 0.0, -half
        for i in range(df // 2):
            if i:
                log_term += math.log(half / i)
            total += math.exp(log_term)
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    for i in range(1, (df - 1) // 2 + 1):
        total += math.exp(-half + (i - 0.5) * math.log(half) - math.lgamma(i + 0.5))
    return min(1.0, total)


@F.pandas_udf(T.DoubleType())
def chi2_sf(q: pd.Series, df: pd.Series) -> pd.Series:
    """Upper chi-square tail per row; null where the statistic is null.

    Spark SQL has no error function. The rows are one per test family.
    """
    return pd.Series(
        [None if pd.isna(x) else chi2_upper(float(x), int(k)) for x, k in zip(q, df)],
        dtype="float64",
    )

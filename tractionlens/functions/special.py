"""Tails of distributions to near full precision, as pandas functions for aggregated rows: few values, long series."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _log_beta(a: float, b: float) -> float:
    """ln B(a, b). For a large first argument the gammas cancel, so their difference comes from the asymptotic series."""
    a, b = max(a, b), min(a, b)
    if a < 1e4:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    tail = lambda x: (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x
    if b < 1e4:
        return math.lgamma(b) - b * math.log(a) - (a + b - 0.5) * math.log1p(b / a) + b + tail(a) - tail(a + b)
    return 0.5 * math.log(2 * math.pi) - 0.5 * math.log(b) + (a - 0.5) * -math.log1p(b / a) + b * (math.log(b) - math.log(a + b)) + tail(a) + tail(b) - tail(a + b)


def beta_share(a: float, b: float, x: float, y: float) -> float:
    """The regularised incomplete beta function at x, by its continued fraction on the side of the mean where that runs fast.
    y is 1 - x, given apart because either may be tiny."""
    if x <= 0 or y <= 0:
        return float(y <= 0)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, y, x)
    c, d = 1.0, 1 / (_floor(1 - (a + b) * x / (a + 1)))
    out, m = d, 0
    while m < 10_000_000:
        m += 1
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / _floor(1 + step * d), _floor(1 + step / c)
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    log_x, log_y = (math.log(u) if u < 0.5 else math.log1p(-v) for u, v in ((x, y), (y, x)))
    return math.exp(a * log_x + b * log_y - _log_beta(a, b)) / a * out


def _floor(x: float) -> float:
    return x if abs(x) > _TINY else _TINY


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term, total, k = 1 / a, 1 / a, a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1 - scale * total
    b, c = x + 1 - a, 1 / _TINY
    d, k = 1 / b, 0
    out = d
    while True:
        k += 1
        b += 2
        d, c = 1 / _floor(k * (a - k) * d + b), _floor(b + k * (a - k) / c)
        out *= c * d
        if abs(c * d - 1) < 1e-16 or k > 1_000_000:
            return scale * out


def t_tails(t: float, dof: float) -> float:
    """P(|T| >= |t|) of Student's t; from a million degrees of freedom on by the normal distribution of a transform of t."""
    if dof > 1e6:
        return math.erfc(abs(t) * (1 - 0.25 / dof) / math.sqrt(1 + t * t / (2 * dof)) / math.sqrt(2))
    return beta_share(dof / 2, 0.5, dof / (dof + t * t), t * t / (dof + t * t))


def correlation_tails(r: float, n: float) -> float:
    """Two-sided p of a correlation of n pairs: 1 below ten pairs, or where r is 0; 0 where r is 1 or -1."""
    if n < 10 or r == 0 or r != r:
        return 1.0
    return 0.0 if abs(r) >= 1 else t_tails(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def chi_square_tail(x: float, dof: float) -> float:
    """P of a chi-square value from x on: 1 for x or dof at 0."""
    return 1.0 if x <= 0 or dof <= 0 else math.erfc(math.sqrt(x / 2)) if dof == 1 else gamma_tail(dof / 2, x / 2)


def binomial_quantile(q: float, n: int, p: float) -> int:
    """The smallest k with P(X <= k) >= q, X of n trials with chance p. The search halves an interval around the mean."""
    if p <= 0 or n <= 0:
        return 0
    if p >= 1:
        return n
    below = lambda k: 1.0 if k >= n else beta_share(n - k, k + 1, 1 - p, p)
    half = 40 * math.sqrt(n * p * (1 - p)) + 40
    low, high = max(-1, int(n * p - half)), min(n, int(n * p + half))
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if below(middle) >= q * (1 - 1e-13) else (middle, high)
    return high


def _each(function, *columns: Column) -> Column:
    """`function` of each row's values; null where one is null."""

    @F.pandas_udf("double")
    def run(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([float(function(*row)) if not any(x != x for x in row) else None for row in zip(*(frame[c] for c in frame))], dtype="float64")

    return run(F.struct(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))


def correlation_p(r: Column, n: Column) -> Column:
    return _each(correlation_tails, r, n)


def chi_square_p(x: Column, dof: Column) -> Column:
    return _each(chi_square_tail, x, dof)


def binomial_at(q: float, n: Column, p: Column) -> Column:
    return _each(lambda n, p: binomial_quantile(q, int(n), p), n, p).cast("long")

"""Tests and intervals in closed form over counts."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trialspark.functions.nulls import ratio

# ``two_digits`` travels with the tasks, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Chi-square (df 1) statistics whose upper tail is the given p.
CHI2_AT_P = {0.2: 1.642374415149818, 0.05: 3.841458820694124}


def chi2_critical(p: float) -> float:
    """Statistic with upper tail ``p`` for one degree of freedom."""
    if p in CHI2_AT_P:
        return CHI2_AT_P[p]
    low, high = 0.0, 1500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > p else (low, mid)
    return (low + high) / 2


def chi2_gof(a: Column, b: Column) -> Column:
    """Goodness of fit of two counts to equal shares, no correction; NULL without rows."""
    a, b = a.cast("double"), b.cast("double")
    return ratio((a - b) * (a - b), a + b)


def chi2_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Yates-corrected statistic of the table with columns (a, b) and (c, d).

    NULL when a margin is zero.
    """
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    gap = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2)
    return ratio(n * gap * gap, (a + b) * (c + d) * (a + c) * (b + d))


ERFC_STEPS = 60


def erfc(x: Column) -> Column:
    """Complementary error function of a number that is not negative, by ``ERFC_STEPS`` steps.

    The series of erf in nested form below 3, the continued fraction from there on.
    """
    steps = F.sequence(F.lit(ERFC_STEPS), F.lit(1), F.lit(-1))
    square = x * x
    series = F.aggregate(steps, F.lit(1.0), lambda f, n: 1 + 2 * square / (2 * n + 1) * f)
    fraction = F.aggregate(steps, F.lit(1.0), lambda f, n: 1 + n / (2 * square) / f)
    tail = F.exp(-square) / F.sqrt(F.lit(math.pi))
    return F.when(x < 3, 1 - 2 * tail * x * series).otherwise(tail / x / fraction)


def chi2_p(statistic: Column | str) -> Column:
    """Upper tail of chi-square with one degree of freedom; NULL for no statistic."""
    statistic = F.col(statistic) if isinstance(statistic, str) else statistic
    return erfc(F.sqrt(statistic / 2))


@F.pandas_udf(T.StringType())
def two_digits(value: pd.Series) -> pd.Series:
    """Two decimals as C's ``%.2f`` rounds the exact binary value; for aggregates only."""
    return value.map(lambda v: f"{v:.2f}", na_action="ignore")


# Both parameters beyond this make the density smooth enough to be integrated directly.
LARGE = 3_000
NODES, WEIGHTS = np.polynomial.legendre.leggauss(24)
SPAN, PANELS = 12.0, 12  # standard deviations to either side, and panels over them


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for parameters of any size.

    A continued fraction, or an integral where both parameters are large: the fraction would
    need about the root of the parameters in steps there.
    """
    x, a, b = (np.atleast_1d(np.asarray(v, float)) for v in np.broadcast_arrays(x, a, b))
    large = np.minimum(a, b) > LARGE
    result = np.empty_like(x)
    if large.any():
        result[large] = _beta_integral(x[large], a[large], b[large])
    if not large.all():
        result[~large] = _beta_fraction(x[~large], a[~large], b[~large])
    return result


def _beta_integral(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the density below x, by Gauss-Legendre panels around the mode.

    The density relative to the mode needs no gamma function, so no digits cancel.
    """
    mode = (a - 1) / (a + b - 2)
    sd = np.sqrt(mode * (1 - mode) / (a + b - 2))

    def area(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        total = np.zeros_like(low)
        step = (high - low) / PANELS
        for panel in range(PANELS):
            middle = low + (panel + 0.5) * step
            for node, weight in zip(NODES, WEIGHTS):
                away = (middle + 0.5 * step * node) * sd
                log = (a - 1) * np.log1p(away / mode) + (b - 1) * np.log1p(-away / (1 - mode))
                total += weight * 0.5 * step * np.exp(log)
        return total

    least = np.maximum(-SPAN, -mode / sd * (1 - 1e-12))
    most = np.minimum(SPAN, (1 - mode) / sd * (1 - 1e-12))
    at = np.clip((x - mode) / sd, least, most)
    below, above = area(least, at), area(at, most)
    return below / (below + above)


def _stirling_rest(z: np.ndarray) -> np.ndarray:
    """What Stirling's formula leaves of the log gamma function, for z of 10 or more."""
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / z**2) / z**2) / z**2) / z


def _log_front(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of x^a (1 - x)^b / B(a, b), without the difference of two large log gammas."""
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    small, big = np.minimum(a, b), np.maximum(a, b)
    with np.errstate(divide="ignore"):
        powers = a * np.log(x) + b * np.log1p(-x)
    far = big >= 10
    safe = np.where(far, big, 10.0)
    grown = (
        (safe - 0.5) * np.log1p(small / safe) + small * np.log(small + safe) - small
        + _stirling_rest(small + safe) - _stirling_rest(safe)
    )
    near = log_gamma(small + np.where(far, 1.0, big)) - log_gamma(np.where(far, 1.0, big))
    return np.where(far, grown, near) - log_gamma(small) + powers


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 100_000) -> np.ndarray:
    """The continued fraction; not converging within ``rounds`` is an error."""
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    front = np.exp(_log_front(x, a, b)) / a
    tiny = 1e-300
    d = 1 / _away_from_zero(1 - (a + b) * x / (a + 1), tiny)
    c = np.ones_like(x)
    value = d.copy()
    for m in range(1, rounds):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = np.ones_like(x)
        for coefficient in (even, odd):
            d = 1 / _away_from_zero(1 + coefficient * d, tiny)
            c = _away_from_zero(1 + coefficient / c, tiny)
            step = step * c * d
            value = value * c * d
        if np.all(np.abs(step - 1) < 1e-14):
            break
    else:
        raise ArithmeticError("the incomplete beta function did not converge")
    tail = front * value
    return np.where(flip, 1 - tail, tail)


def _away_from_zero(x: np.ndarray, tiny: float) -> np.ndarray:
    return np.where(np.abs(x) < tiny, tiny, x)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantile of the Beta distribution by bisection."""
    low, high = np.zeros_like(a, dtype=float), np.ones_like(a, dtype=float)
    for _ in range(60):
        mid = (low + high) / 2
        below = beta_cdf(mid, a, b) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def beta_measures(outcome: str) -> list[Column]:
    """Successes, trials and mean of a boolean; NULL where an outcome is missing."""
    whole = F.count(outcome) == F.count(F.lit(1))
    return [
        F.when(whole, F.count_if(F.col(outcome))).alias("k"),
        F.count(F.lit(1)).alias("n"),
        F.when(whole, F.avg(F.col(outcome).cast("int"))).alias("mean"),
    ]


def beta_counts(df: DataFrame, keys: Sequence[str], outcome: str) -> DataFrame:
    """``beta_measures`` per group."""
    return df.groupBy(*keys).agg(*beta_measures(outcome))


# Points and weights over the unit interval: Gauss-Legendre panels side by side.
AREA_PANELS, AREA_NODES, REACH, NEWTON_STEPS = 12, 8, 12.0, 16


def area_points() -> list[tuple[float, float]]:
    nodes, weights = np.polynomial.legendre.leggauss(AREA_NODES)
    return [
        ((panel + 0.5 + 0.5 * float(x)) / AREA_PANELS, 0.5 * float(w) / AREA_PANELS)
        for panel in range(AREA_PANELS) for x, w in zip(nodes, weights)
    ]


def beta_quantile_column(p: float, a: Column, b: Column) -> Column:
    """Quantile of the Beta distribution with parameters of 1 or more, as an expression; NULL for NULL.

    With x = sin(t)^2 the density over the angle t is smooth, has one mode and is about normal, so
    its area is a fixed sum around the mode, and relative to the mode it needs no gamma function.
    Newton's steps begin at the mode, from where they never pass the quantile.
    """
    up, down = 2 * a - 1, 2 * b - 1
    mode = F.atan2(F.sqrt(up), F.sqrt(down))
    width = 0.5 / F.sqrt(a + b - 1)
    least = F.greatest(F.lit(0.0), mode - REACH * width)
    most = F.least(F.lit(math.pi / 2), mode + REACH * width)
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in area_points()))

    def density(t: Column) -> Column:
        return F.exp(up * F.ln(F.sin(t) / F.sin(mode)) + down * F.ln(F.cos(t) / F.cos(mode)))

    def area(t: Column) -> Column:
        added = F.aggregate(
            points, F.lit(0.0), lambda s, n: s + n["w"] * density(least + (t - least) * n["x"])
        )
        return (t - least) * added

    steps = F.sequence(F.lit(1), F.lit(NEWTON_STEPS))
    wanted = p * area(most)
    angle = F.aggregate(
        steps, mode, lambda t, _: F.greatest(least, F.least(most, t - (area(t) - wanted) / density(t)))
    )
    return F.when(a.isNotNull() & b.isNotNull(), F.pow(F.sin(angle), F.lit(2.0)))


def beta_interval(counts: DataFrame, ci: float = 0.95) -> DataFrame:
    """Add ``ymin``/``ymax``, the equal-tailed interval of Beta(k + 1, n - k + 1).

    Runs on the counts, one row per group; NULL where ``k`` is.
    """
    low = (1 - ci) / 2
    a = (F.col("k") + 1).cast("double")
    b = (F.col("n") - F.col("k") + 1).cast("double")
    return counts.withColumns({
        name: beta_quantile_column(p, a, b) for name, p in (("ymin", low), ("ymax", ci + low))
    })

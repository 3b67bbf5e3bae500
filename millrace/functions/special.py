"""Distributions for paired tests, in plain Python; callers vectorise over groups, which are few."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def regularised_beta(x: float, a: float, b: float) -> float:
    """The incomplete beta function ratio by its continued fraction, evaluated forwards as convergents."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - regularised_beta(1 - x, b, a)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    p0, q0, p1, q1, value = 1.0, 0.0, 1.0, 1.0, 1.0
    for n in range(1, 1000):
        m = n // 2
        if n % 2:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        p0, q0, p1, q1 = p1, q1, p1 + d * p0, q1 + d * q0
        if q1:
            p0, q0, p1, q1 = p0 / q1, q0 / q1, p1 / q1, 1.0
            if n > 1 and abs(p1 - value) <= 1e-15 * abs(p1):
                value = p1
                break
            value = p1
    return scale / value


def t_two_tailed(t: float, df: float) -> float:
    """P(|T| > |t|); not a number without degrees of freedom."""
    if df <= 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    return regularised_beta(df / (df + t * t), df / 2, 0.5)


@lru_cache(maxsize=4096)
def t_critical(df: float, alpha: float = 0.05) -> float:
    """The t whose two-tailed probability is ``alpha``, by halving an interval that holds it."""
    low, high = 0.0, 1.0
    while t_two_tailed(high, df) > alpha:
        high *= 2
    while high - low > 1e-12 * max(1.0, high):
        middle = (low + high) / 2
        if t_two_tailed(middle, df) > alpha:
            low = middle
        else:
            high = middle
        if middle in (low, high) and high - low < 1e-13:
            break
    return (low + high) / 2


NEGLIGIBLE = 1e-12
EXACT_UP_TO = 20


def signed_ranks(differences: list[float]) -> tuple[float, float, list[int]]:
    """Rank sums of the positive and the negative differences with mid-ranks, and the sizes of the ties."""
    d = np.asarray(differences, dtype=np.float64)
    d = d[np.abs(d) > NEGLIGIBLE]
    d = d[np.argsort(np.abs(d), kind="stable")]
    starts = np.flatnonzero(np.diff(np.abs(d), prepend=-1.0) >= NEGLIGIBLE)
    ties = np.diff(starts, append=len(d))
    ranks = np.repeat(starts + (ties + 1) / 2, ties)
    return float(ranks[d > 0].sum()), float(ranks[d < 0].sum()), ties.tolist()


def wilcoxon_p(w: float, n: int, levels: int, excess: float) -> tuple[float, str]:
    """Two-sided p and method (exact, asymptotic or degenerate) of a signed-rank statistic.

    ``n`` differences that aren't 0 have ``levels`` sizes; ``excess`` is the sum of t**3 - t over ties of t.
    """
    if n == 0:
        return 1.0, "degenerate"
    if n <= EXACT_UP_TO and levels == n:
        # how many of the 2**n choices of signs give each rank sum
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for rank in range(1, n + 1):
            ways[rank:] += ways[:-rank].copy()
        return min(1.0, 2 * float(ways[: math.floor(w) + 1].sum()) / 2**n), "exact"
    variance = n * (n + 1) * (2 * n + 1) / 24 - excess / 48
    if variance <= 0:
        return 1.0, "asymptotic"
    z = max(0.0, abs(w - n * (n + 1) / 4) - 0.5) / math.sqrt(variance)
    return min(1.0, math.erfc(z / math.sqrt(2))), "asymptotic"


def wilcoxon(differences: list[float]) -> tuple[float, float, str]:
    """Statistic, two-sided p and method of the signed-rank test."""
    plus, minus, ties = signed_ranks(differences)
    w = min(plus, minus)
    return w, *wilcoxon_p(w, sum(ties), len(ties), float(sum(t**3 - t for t in ties)))

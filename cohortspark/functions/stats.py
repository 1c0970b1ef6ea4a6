"""Scalar statistics helpers (pure Python, driver-side scalars of fixed size only).

Used for constants that depend on parameters, not on data volume (Student t quantiles for a
given number of degrees of freedom), and as the exact reference
implementation of the two-sided Fisher p-value that the native column version
(``columns.fisher_two_sided``) is tested against."""

from __future__ import annotations

import math


def t_cdf(t: float, df: int) -> float:
    """Student t distribution for whole degrees of freedom, by its finite trigonometric sum: with
    theta = atan(t / sqrt(df)), the central probability is a sum of cosine powers of theta."""
    theta = math.atan(t / math.sqrt(df))
    c, total, term = math.cos(theta), 0.0, 1.0
    if df % 2:  # (2 / pi) * (theta + sin * (cos + 2/3 cos^3 + (2*4)/(3*5) cos^5 + ...))
        term = c
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= c * c * 2 * k / (2 * k + 1)
        central = 2 / math.pi * (theta + math.sin(theta) * total)
    else:  # sin * (1 + 1/2 cos^2 + (1*3)/(2*4) cos^4 + ...)
        for k in range(1, df // 2 + 1):
            total += term
            term *= c * c * (2 * k - 1) / (2 * k)
        central = math.sin(theta) * total
    return 0.5 + 0.5 * central


def t_ppf(p: float, df: int) -> float:
    """Student t quantile by bisection on the CDF."""
    if not 0 < p < 1 or df < 1:
        raise ValueError("need 0 < p < 1 and df > 0")
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_cdf(mid, df) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


Z975 = 1.959963984540054


def fisher_exact_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p: sum of the hypergeometric probabilities of all tables with
    the same margins that are not more probable than the observed one (relative 1e-7)."""
    r1, r2, c1 = a + b, c + d, a + c
    n = r1 + r2

    def logp(x: int) -> float:
        return (
            math.lgamma(r1 + 1) - math.lgamma(x + 1) - math.lgamma(r1 - x + 1)
            + math.lgamma(r2 + 1) - math.lgamma(c1 - x + 1) - math.lgamma(r2 - c1 + x + 1)
            - (math.lgamma(n + 1) - math.lgamma(c1 + 1) - math.lgamma(n - c1 + 1))
        )

    lo, hi = max(0, c1 - r2), min(r1, c1)
    obs = logp(a)
    total = 0.0
    for x in range(lo, hi + 1):
        lp = logp(x)
        if lp <= obs + math.log1p(1e-7):
            total += math.exp(lp)
    return min(1.0, total)

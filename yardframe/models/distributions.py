"""Tail probabilities of the t, F and chi-squared distributions.

Continued fractions and series for the incomplete beta and gamma functions, after
Abramowitz and Stegun, sections 6.5 and 26.5.
"""

from __future__ import annotations

import math

_TINY = 1e-300
_EPS = 1e-15


def _lentz(terms, start: float) -> float:
    """Value of a continued fraction from its (numerator, denominator) terms."""
    f = c = start if abs(start) > _TINY else _TINY
    d = 0.0
    for a, b in terms:
        d = b + a * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + a / c
        c = c if abs(c) > _TINY else _TINY
        f *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return f


def beta_share(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_share(1.0 - x, b, a)

    def terms():
        for m in range(1, 20_000):
            if m % 2:
                k = (m - 1) // 2
                yield -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)), 1.0
            else:
                k = m // 2
                yield k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), 1.0

    front = math.exp(a * math.log(x) + b * math.log1p(-x)
                     + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    return front / _lentz(terms(), 1.0)


def gamma_tail(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    terms = ((-i * (i - a), x + 2.0 * i + 1.0 - a) for i in range(1, 20_000))
    return front / _lentz(terms, x + 1.0 - a)


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or math.isnan(df):
        return math.nan
    return beta_share(float(df / (df + t * t)), float(df) / 2.0, 0.5)


def f_tail(f: float, df1: float, df2: float) -> float:
    if math.isnan(f) or math.isnan(df2):
        return math.nan
    return beta_share(float(df2 / (df2 + df1 * max(f, 0.0))), float(df2) / 2.0, float(df1) / 2.0)


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(float(df) / 2.0, float(x) / 2.0)

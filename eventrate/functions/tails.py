"""Tail probabilities of a few distributions for single values on the driver."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution function, by bisection on ``erfc``."""
    return _bisect(lambda z: 0.5 * math.erfc(-z / math.sqrt(2.0)), p, -40.0, 40.0)


def chi_square_upper(x: float, df: float) -> float:
    """P(X >= x) for a chi-square variable, through the regularised incomplete gamma."""
    if x <= 0:
        return 1.0
    a, x = df / 2.0, x / 2.0
    scale = math.exp(min(a * math.log(x) - x - math.lgamma(a), 700.0))
    if x < a + 1.0:  # power series of the lower part
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * scale
    # continued fraction of the upper part, evaluated from the front
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2.0
        d = 1.0 / _away_from_zero(step * d + b, tiny)
        c = _away_from_zero(b + step / c, tiny)
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return scale * h


def beta_lower(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_lower(1.0 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 / _away_from_zero(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for step in (even, odd):
            d = 1.0 / _away_from_zero(1.0 + step * d, tiny)
            c = _away_from_zero(1.0 + step / c, tiny)
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h / a


def binomial_interval(successes: int, trials: int, level: float = 0.95) -> tuple[float, float]:
    """Exact (Clopper-Pearson) interval of a proportion."""
    tail = (1.0 - level) / 2.0
    low = 0.0 if successes == 0 else _bisect(
        lambda p: beta_lower(p, successes, trials - successes + 1), tail, 0.0, 1.0
    )
    high = 1.0 if successes == trials else _bisect(
        lambda p: beta_lower(p, successes + 1, trials - successes), 1.0 - tail, 0.0, 1.0
    )
    return low, high


def binomial_upper(successes: int, trials: int, p: float) -> float:
    """P(X >= successes) of a binomial count."""
    return 1.0 if successes == 0 else beta_lower(p, successes, trials - successes + 1)


def _away_from_zero(v: float, tiny: float) -> float:
    return tiny if abs(v) < tiny else v


def _bisect(f, target: float, low: float, high: float) -> float:
    """Point at which an increasing function reaches ``target``."""
    for _ in range(200):
        mid = (low + high) / 2.0
        if f(mid) < target:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0

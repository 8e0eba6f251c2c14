"""Driver-side finishers on aggregated results: k x k algebra and distribution tails.

Inputs are a handful of sums produced by Spark; no rows reach these helpers.
"""

from __future__ import annotations

import math

import numpy as np


def solve(a, b):
    return np.linalg.solve(np.asarray(a, float), np.asarray(b, float))


def inverse(a):
    return np.linalg.inv(np.asarray(a, float))


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    """Inverse normal by Newton steps from a logistic start."""
    if not 0.0 < p < 1.0:
        return math.copysign(math.inf, p - 0.5)
    x = math.log(p / (1 - p)) / 1.702
    for _ in range(50):
        step = (norm_cdf(x) - p) / (math.exp(-x * x / 2) / math.sqrt(2 * math.pi))
        x -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-14:
            break
    return x


def _beta_cf(a: float, b: float, x: float) -> float:
    tiny, cc = 1e-300, 1.0
    dd = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny) if abs(1.0 - (a + b) * x / (a + 1.0)) > tiny else 1 / tiny
    h = dd
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            dd = 1.0 + num * dd
            dd = 1.0 / (dd if abs(dd) > tiny else tiny)
            cc = 1.0 + num / cc
            cc = cc if abs(cc) > tiny else tiny
            h *= dd * cc
        if abs(dd * cc - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def gamma_inc(a: float, x: float) -> float:
    """Regularized lower incomplete gamma."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = s = 1.0 / a
        n = a
        while abs(term) > abs(s) * 1e-16:
            n += 1
            term *= x / n
            s += term
        return s * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    cc, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        cc = b + an / cc
        h *= d * cc
        if abs(d * cc - 1) < 1e-15:
            break
    return 1.0 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_tail(x: float, df: float) -> float:
    return 1.0 - gamma_inc(df / 2.0, x / 2.0) if x > 0 else 1.0


def ks_tail(d: float, n_a: float, n_b: float) -> float:
    """Asymptotic two-sample Kolmogorov p-value."""
    en = math.sqrt(n_a * n_b / (n_a + n_b))
    lam = (en + 0.12 + 0.11 / en) * d
    s = sum(2 * (-1) ** (j - 1) * math.exp(-2 * lam * lam * j * j) for j in range(1, 101))
    return min(max(s, 0.0), 1.0)

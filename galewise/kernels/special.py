"""Tails of the distributions that tests need, by continued fractions and series; and the normality test of Royston's AS R94."""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """z with P(Z < z) = p, by bisection on the tail."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - normal_tail(mid) < p else (low, mid)
    return (low + high) / 2


def beta_part(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function (Lentz's continued fraction)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + term * d) or _TINY)
        c = (1 + term / c) or _TINY
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def gamma_tail(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    f = d
    for i in range(1, 500):
        k = -i * (i - a)
        b += 2
        d = 1 / ((k * d + b) or _TINY)
        c = (b + k / c) or _TINY
        f *= d * c
        if abs(1 - d * c) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return beta_part(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_part(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def t_quantile(p: float, df: float) -> float:
    """t with P(T < t) = p for p over one half."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def shapiro_wilk(values) -> tuple[float, float]:
    """W and p for 3 to 5000 values."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if not 3 <= n <= 5_000:
        raise ValueError(f"normality is tested on 3 to 5000 values, not {n}")
    if x[-1] - x[0] < 1e-300:
        return 1.0, 1.0
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    norm, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(norm)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        # fixed values: the published polynomials
        last = a[-1] + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u)
        if n > 5:
            before = a[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u)
            phi = (norm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
            a = m / math.sqrt(phi)
            a[[0, 1, -2, -1]] = -last, -before, before, last
        else:
            phi = (norm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
            a[[0, -1]] = -last, last
    d = x - x.mean()
    w = min(1.0, float(a @ x) ** 2 / float(d @ d))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 1e-99
        y = -math.log(g - y)
        mean = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        log_n = math.log(n)
        mean = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    return w, normal_tail((y - mean) / sd)

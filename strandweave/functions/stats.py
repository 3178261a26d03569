"""Interval arithmetic for sampled classes: incomplete beta, Clopper-Pearson bounds, region estimates.

Plain Python on a handful of numbers; nothing here grows with the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

HUGE = 1e308


def betai(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b), by the all-positive series of the hypergeometric form."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betai(b, a, 1 - x)
    scale = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a + 1) - math.lgamma(b)
    total, term, n = 1.0, 1.0, 0
    while term > 1e-17 * total:
        term *= (a + b + n) / (a + 1 + n) * x
        total += term
        n += 1
    return min(1.0, math.exp(scale + math.log(total)))


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    if p <= 0 or p >= 1:
        return low if p <= 0 else high
    while high - low > 1e-14 * max(high, 1e-300):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if betai(a, b, mid) < p else (low, mid)
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    if p <= 0 or p >= 1:
        return -HUGE if p <= 0 else HUGE
    return NormalDist().inv_cdf(p)


def clopper_pearson_upper(k: int, m: int, delta: float) -> float:
    """Upper bound of a proportion at confidence 1 - delta after k of m."""
    return 1.0 if m == 0 or k >= m else beta_quantile(1 - delta, k + 1, m - k)


@dataclass(frozen=True)
class AbundanceConfig:
    """Classes of k-mers by count: x < c < y, c >= x, c <= y, from a bottom-``sample`` sample."""

    k: int = 31
    x: int = 1
    y: int = 4
    sample: int = 4096
    cap: int = 0
    f0_rel_err: float = 0.0
    z: float = 1.645

    @property
    def counter_cap(self) -> int:
        return self.cap or self.y + 1

    @property
    def counter_bits(self) -> int:
        return max(1, self.counter_cap.bit_length())


def region(f0: float, inside: int, m: int, cfg: AbundanceConfig) -> dict[str, float]:
    """Point, standard deviation, two-sided bounds and one-sided upper bound for a class that holds ``inside`` of
    m sampled keys, of ``f0`` distinct keys in all."""
    if m == 0:
        return dict.fromkeys(("in_sample", "m", "p_hat", "point", "sigma", "lo", "hi", "upper"), 0.0)
    p = inside / m
    point = f0 * p
    spread = (1 - p) / (p * m) if inside else 0.0
    sigma = point * math.sqrt(cfg.f0_rel_err**2 + spread)
    half = math.erfc(cfg.z / math.sqrt(2)) / 4
    top = f0 * (1 + normal_quantile(1 - half) * cfg.f0_rel_err)
    return {
        "in_sample": inside, "m": m, "p_hat": p, "point": point, "sigma": sigma,
        "lo": max(0.0, point - cfg.z * sigma), "hi": point + cfg.z * sigma,
        "upper": top * clopper_pearson_upper(inside, m, half),
    }


def hll_error(p: int) -> float:
    """Relative standard error of 2**p registers."""
    return 1.04 / math.sqrt(1 << p)


def intersection_tolerance(p: int, union: float, both: float) -> float:
    """Relative error of an inclusion-exclusion intersection, at four standard deviations."""
    return 4 * math.sqrt(3) * hll_error(p) * union / both

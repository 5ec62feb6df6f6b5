"""Predictive distributions as column expressions: loss, quantile and sampler.

``scale`` multiplies location and spread, which adds ``ln scale`` to the loss.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, functions as F

from panelweave.functions.hashing import normal


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class Gaussian:
    """Location and standard deviation."""

    name = "gaussian"

    def nll(self, y, loc, spread, scale=1.0) -> Column:
        y, loc, spread, scale = map(_column, (y, loc, spread, scale))
        z = (y - loc * scale) / (spread * scale)
        return F.lit(0.5 * math.log(2 * math.pi)) + F.log(spread * scale) + z * z / 2.0

    def quantile(self, p: float, loc, spread, scale=1.0) -> Column:
        return (_column(loc) + _column(spread) * NormalDist().inv_cdf(p)) * _column(scale)

    def sample(self, u: Column, v: Column, loc, spread, scale=1.0) -> Column:
        return (_column(loc) + _column(spread) * normal(u, v)) * _column(scale)


@dataclass(frozen=True)
class Laplace:
    """Location and diversity ``b``."""

    name = "laplace"

    def nll(self, y, loc, spread, scale=1.0) -> Column:
        y, loc, spread, scale = map(_column, (y, loc, spread, scale))
        b = spread * scale
        return F.log(2.0 * b) + F.abs(y - loc * scale) / b

    def quantile(self, p: float, loc, spread, scale=1.0) -> Column:
        unit = math.log(2 * p) if p < 0.5 else -math.log(2 * (1 - p))
        return (_column(loc) + _column(spread) * unit) * _column(scale)

    def sample(self, u: Column, v: Column, loc, spread, scale=1.0) -> Column:
        centred = u - 0.5
        unit = -F.signum(centred) * F.log(1.0 - 2.0 * F.abs(centred))
        return (_column(loc) + _column(spread) * unit) * _column(scale)


@dataclass(frozen=True)
class StudentT:
    """Degrees of freedom (a number), location and spread."""

    nu: float = 5.0
    name = "student_t"

    def nll(self, y, loc, spread, scale=1.0) -> Column:
        y, loc, spread, scale = map(_column, (y, loc, spread, scale))
        nu = self.nu
        constant = math.lgamma(nu / 2) - math.lgamma((nu + 1) / 2) + 0.5 * math.log(nu * math.pi)
        z = (y - loc * scale) / (spread * scale)
        return F.lit(constant) + F.log(spread * scale) + (nu + 1) / 2 * F.log(1.0 + z * z / nu)

    def quantile(self, p: float, loc, spread, scale=1.0) -> Column:
        return (_column(loc) + _column(spread) * student_quantile(p, self.nu)) * _column(scale)

    def sample(self, u: Column, v: Column, loc, spread, scale=1.0) -> Column:
        """Polar method of Bailey (1994)."""
        radius = F.sqrt(self.nu * (F.pow(u, F.lit(-2.0 / self.nu)) - 1.0))
        return (_column(loc) + _column(spread) * radius * F.cos(2.0 * math.pi * v)) * _column(scale)


def student_quantile(p: float, nu: float, steps: int = 2000) -> float:
    """Quantile of the standard t: bisection on Simpson's rule after x = tan(angle)."""
    log_norm = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)

    def upper_half(x: float) -> float:
        width = math.atan(x) / steps
        area = 0.0
        for n in range(steps + 1):
            tangent = math.tan(n * width)
            weight = 1 if n in (0, steps) else 4 if n % 2 else 2
            area += weight * math.exp(log_norm - (nu + 1) / 2 * math.log1p(tangent**2 / nu)) * (1 + tangent**2)
        return area * width / 3

    if p == 0.5:
        return 0.0
    goal, low, high = abs(p - 0.5), 0.0, 1.0
    while upper_half(high) < goal and high < 1e12:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if upper_half(middle) < goal else (low, middle)
    return math.copysign((low + high) / 2, p - 0.5)


HEADS = {"gaussian": Gaussian, "laplace": Laplace, "student_t": StudentT}


def head(name: str, **options):
    if name not in HEADS:
        raise ValueError(f"unknown distribution {name!r}; known: {', '.join(HEADS)}")
    return HEADS[name](**options)

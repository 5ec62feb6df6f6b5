"""Least squares over distributed rows.

One aggregate pass yields counts, sums and cross products, combined in each task before a one-row
shuffle. Only these k(k+3)/2 numbers reach the driver, which centres them and solves the k×k
system. Where centring would cancel too many digits, a second pass sums around the means.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from panelweave.functions.scalars import total


CANCELLATION = 1e4


@dataclass
class Fit:
    """Coefficients by column name; ``intercept`` always fitted."""

    intercept: float
    coefficients: dict[str, float]
    n: int
    sse: float
    sst: float
    std_errors: dict[str, float] = field(default_factory=dict)
    intercept_error: float | None = None

    @property
    def r_squared(self) -> float | None:
        return 1.0 - self.sse / self.sst if self.sst > 0 else None

    def predict(self) -> Column:
        return total([F.lit(self.intercept), *(F.lit(b) * F.col(c) for c, b in self.coefficients.items())])


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)))


def number(x: float) -> str:
    """A double as SQL text."""
    return f"({float(x)!r}D)"


def cross_products(df: DataFrame, y: str, xs: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, centred products) of [xs…, y] over the complete rows.

    Plain sums are several times faster than pairwise covariance aggregates. They are accepted
    when no column's mean is so large against its spread that centring loses more than four
    of sixteen digits.
    """
    names = [*xs, y]
    rows = complete_rows(df, names)
    n, means, products = summed_products(rows, names)
    if not n:
        raise ValueError("no complete row to fit on")
    centred = np.diag(products)
    if np.any(n * means**2 > CANCELLATION * centred):
        n, means, products = summed_products(rows, names, means)
        # a constant column leaves rounding dust
        dust = np.diag(products) <= 1e-20 * n * np.maximum(means**2, 1e-300)
        products[dust, :] = products[:, dust] = 0.0
    return int(n), means, products


def summed_products(
    rows: DataFrame,
    names: Sequence[str],
    centre: np.ndarray | None = None,
    weight: str | None = None,
    also: Sequence[str] = (),
) -> tuple[float, np.ndarray, np.ndarray] | tuple[float, np.ndarray, np.ndarray, list[float]]:
    """(sum of weights, means, centred products) of complete ``rows`` from sums around ``centre``; with ``also``,
    further aggregates of the same pass as a fourth item.

    The expressions are SQL text: a pass has dozens of them, and one text each is much cheaper to
    hand over than a tree of calls.
    """
    centre = np.zeros(len(names)) if centre is None else centre
    shifted = [f"(`{c}` - {number(m)})" if m else f"`{c}`" for c, m in zip(names, centre)]
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    factor = "_w * " if weight else ""
    sums = [f"sum({factor}{x}) AS m{k}" for k, x in enumerate(shifted)]
    sums += [f"sum({factor}{shifted[a]} * {shifted[b]}) AS s{a}_{b}" for a, b in pairs]
    if weight:
        rows = rows.selectExpr(*(f"`{c}`" for c in names), f"{weight} AS _w")
    sums += [f"{e} AS e{k}" for k, e in enumerate(also)]
    row = rows.agg(F.expr("sum(_w) AS n" if weight else "count(1) AS n"), *map(F.expr, sums)).first()
    n = row["n"]
    found = [row[f"e{k}"] for k in range(len(also))]
    if not n:
        return (0, centre, np.zeros((len(names), len(names))), *([found] if also else []))
    offset = np.array([row[f"m{k}"] / n for k in range(len(names))])
    products = np.zeros((len(names), len(names)))
    for a, b in pairs:
        products[a, b] = products[b, a] = row[f"s{a}_{b}"] - n * offset[a] * offset[b]
    return (n, centre + offset, products, *([found] if also else []))


def minimum_norm(gram: np.ndarray, moment: np.ndarray, tolerance: float = 1e-11) -> tuple[np.ndarray, np.ndarray, int]:
    """Shortest solution of the normal equations, the inverse used, and the rank.

    The rank is read off the correlation form, where units do not matter; for a deficient
    system the null directions are then removed in the original units.
    """
    scale = np.sqrt(np.clip(np.diag(gram), 0.0, None))
    live = scale > 0
    beta, inverse = np.zeros(len(moment)), np.zeros_like(gram)
    if not live.any():
        return beta, inverse, 0
    s = scale[live]
    values, vectors = np.linalg.eigh(gram[np.ix_(live, live)] / np.outer(s, s))
    kept = values > tolerance * max(1.0, values.max())
    root = (vectors[:, kept] / values[kept]) @ vectors[:, kept].T
    solution = (root @ (moment[live] / s)) / s
    if not kept.all():
        null = vectors[:, ~kept] / s[:, None]
        solution = solution - null @ np.linalg.lstsq(null, solution, rcond=None)[0]
    beta[live] = solution
    inverse[np.ix_(live, live)] = root / np.outer(s, s)
    return beta, inverse, int(kept.sum())


def solve(n: float, means: np.ndarray, products: np.ndarray, xs: Sequence[str]) -> Fit:
    k = len(xs)
    gram, moment, sst = products[:k, :k], products[:k, k], float(products[k, k])
    beta, inverse, rank = minimum_norm(gram, moment)
    sse = max(float(sst - 2 * beta @ moment + beta @ gram @ beta), 0.0)
    freedom = n - rank - 1
    errors, level = {}, None
    if freedom > 0 and rank == k:
        errors = {c: float(np.sqrt(sse / freedom * inverse[a, a])) for a, c in enumerate(xs)}
        level = float(np.sqrt(sse / freedom * (1.0 / n + means[:k] @ inverse @ means[:k])))
    return Fit(float(means[k] - beta @ means[:k]), dict(zip(xs, map(float, beta))), int(n), sse, sst, errors, level)


def least_squares(df: DataFrame, y: str, xs: Sequence[str]) -> Fit:
    return solve(*cross_products(df, y, xs), xs)


def with_fit(df: DataFrame, fit: Fit, y: str = "y") -> DataFrame:
    """``fitted`` and ``residual`` of every row."""
    return df.withColumn("fitted", fit.predict()).withColumn("residual", F.col(y) - F.col("fitted"))


def r_squared(df: DataFrame, y: str = "y") -> DataFrame:
    """1 − SSE/SST from rows that carry ``residual``."""
    sums = df.where(F.col(y).isNotNull() & F.col("residual").isNotNull()).agg(
        F.sum(F.col("residual") * F.col("residual")).alias("sse"),
        (F.var_pop(y) * F.count(y)).alias("sst"),
    )
    return sums.select(F.when(F.col("sst") > 0, 1.0 - F.col("sse") / F.col("sst")).alias("r_squared"))

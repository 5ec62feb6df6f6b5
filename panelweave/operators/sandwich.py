"""Standard errors that hold where residuals of one cluster, or of near regions on one date, go together.

The covariance of the coefficients is A·M·A: A is the inverse Gram matrix of the regressors, M the cross products of the row scores
(regressor times residual), added up inside what goes together. Scores are summed per cluster, or over the weighted neighbours of a
region, before any product is taken, so the pass after that has one row per cluster or cell; k(k+3)/2 numbers reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from panelweave.operators.lag import spatial_lags
from panelweave.operators.regression import Fit, complete_rows, cross_products, minimum_norm, number


def _scored(rows: DataFrame, fit: Fit, y: str, residual: Column | None) -> tuple[DataFrame, list[str], np.ndarray, np.ndarray, int]:
    """(complete rows with scores _s0…, names, means, inverse Gram of [1, regressors from their means], rows)."""
    names = list(fit.coefficients)
    rows = complete_rows(rows, [y, *names])
    n, means, products = cross_products(rows, y, names)
    k = len(names)
    inverse, slopes, rank = np.zeros((k + 1, k + 1)), *minimum_norm(products[:k, :k], products[:k, k])[1:]
    if rank < k:
        raise ValueError("the regressors are linearly dependent: no standard errors")
    inverse[0, 0], inverse[1:, 1:] = 1.0 / n, slopes
    left = residual if residual is not None else F.col(y) - fit.predict()
    shifted = ["1D", *(f"(`{c}` - {number(m)})" for c, m in zip(names, means))]
    scored = rows.withColumn("_e", left).selectExpr("*", *(f"_e * {x} AS _s{j}" for j, x in enumerate(shifted)))
    return scored, names, means[:k], inverse, n


def _products(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    row = df.agg(*(F.expr(f"sum(`{a}` * `{b}`) AS m{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right))).first()
    return np.array([[row[f"m{i}_{j}"] or 0.0 for j in range(len(right))] for i in range(len(left))])


def _errors(fit: Fit, names: list[str], means: np.ndarray, inverse: np.ndarray, meat: np.ndarray) -> dict[str, float | None]:
    """Standard error per coefficient, the intercept under ``(intercept)``; None where the estimated variance is negative."""
    covariance = inverse @ (meat + meat.T) / 2 @ inverse
    back = np.concatenate([[1.0], -means])
    found = {"(intercept)": float(back @ covariance @ back), **{c: float(covariance[j, j]) for j, c in enumerate(names, 1)}}
    return {c: math.sqrt(v) if v >= 0 else None for c, v in found.items()}


def clustered_errors(rows: DataFrame, fit: Fit, by: Sequence[str] = ("region",), y: str = "y", residual: Column | None = None) -> dict[str, float | None]:
    """Errors with clusters ``by``, times the usual G/(G − 1) · (n − 1)/(n − k − 1).

    ``residual`` replaces y less the fit (two-stage fits take it against the actual lag). One cluster is an error; null keys are a cluster.
    """
    scored, names, means, inverse, n = _scored(rows, fit, y, residual)
    scores = [f"_s{j}" for j in range(len(names) + 1)]
    sums = scored.groupBy(*by).agg(*(F.sum(s).alias(s) for s in scores), F.lit(1).alias("_g"))
    groups = sums.agg(F.count(F.lit(1))).first()[0]
    if groups < 2:
        raise ValueError("clustered errors need two clusters or more")
    factor = groups / (groups - 1) * (n - 1) / max(1, n - len(names) - 1)
    return _errors(fit, names, means, inverse, factor * _products(sums, scores, scores))


def _one_way(edges: DataFrame) -> DataFrame:
    """One edge per pair of regions, with the weights of both ways: ``_errors`` adds a product matrix to its transpose, so a pair's
    products count the same from either end, and half the values travel."""
    ends = edges.where("i IS NOT NULL AND j IS NOT NULL").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w")
    return ends.groupBy("i", "j").agg(F.sum("w").alias("w"))


def near_errors(rows: DataFrame, fit: Fit, edges: DataFrame, y: str = "y", residual: Column | None = None) -> dict[str, float | None]:
    """Errors with residuals of near regions on one date: an edge's weight says how much of a pair's product counts, a region with
    itself counts whole. ``edges`` are kernel weights up to a cutoff; a row that is missing counts for nothing."""
    scored, names, means, inverse, _ = _scored(rows, fit, y, residual)
    scores = [f"_s{j}" for j in range(len(names) + 1)]
    cells = scored.select("region", "t", *scores)
    around = spatial_lags(cells, _one_way(edges), {f"_l{j}": s for j, s in enumerate(scores)})
    both = around.select(*scores, *((F.col(s) + F.col(f"_l{j}")).alias(f"_b{j}") for j, s in enumerate(scores)))
    return _errors(fit, names, means, inverse, _products(both, scores, [f"_b{j}" for j in range(len(scores))]))

"""The spatial-lag model by instruments made of lagged covariates, and by maximum likelihood.

Both need one pass over the rows: the cross products of the regressors, their lags, the lag and the target. The likelihood also needs
ln|I − ρS| of the weights, which is read off their eigenvalues where regions are few and off traces of their powers where they are many.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelweave.functions.hashing import uniform
from panelweave.operators.lag import spatial_lag, spatial_lags
from panelweave.operators.panel import design_rows
from panelweave.operators.regression import Fit, cross_products, minimum_norm
from panelweave.session import stage

#: Regions up to which the determinant comes from all eigenvalues.
EXACT_REGIONS = 1_000
POWERS = 24
PROBES = 32
GRID = 400


def _block(products: np.ndarray, names: Sequence[str], a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    place = {c: n for n, c in enumerate(names)}
    return products[np.ix_([place[c] for c in a], [place[c] for c in b])]


def two_stage_lags(panel: DataFrame, edges: DataFrame, covariates: Sequence[str], exogenous: Sequence[str]) -> tuple[Fit, DataFrame]:
    """Two stages with the covariates' lags S·c and S·S·c as instruments of the lag, beside all exogenous regressors.

    ``panel`` is dense; ``exogenous`` names the regressors other than the lag, the covariates among them. Errors are structural: from
    residuals against the lag itself. Without covariates there is no instrument, which is an error, as is a set that does not move the lag.
    """
    if not covariates:
        raise ValueError("instruments of the lag are lagged covariates: name at least one")
    once, twice = [f"_s_{c}" for c in covariates], [f"_ss_{c}" for c in covariates]
    first = stage(spatial_lags(panel, edges, {"lag": "y", **dict(zip(once, covariates))}))
    lagged = spatial_lags(first, edges, dict(zip(twice, once)))
    rows = design_rows(lagged, [*covariates, *once, *twice], "lag")
    own, tools = [*exogenous, "lag"], [*exogenous, *once, *twice]
    names = [*exogenous, *once, *twice, "lag"]
    n, means, products = cross_products(rows, "y", names)
    every = [*names, "y"]
    gram, _, _ = minimum_norm_inverse(_block(products, every, tools, tools))
    reach = _block(products, every, own, tools)
    projected = reach @ gram @ reach.T
    beta, inverse, rank = minimum_norm(projected, (reach @ gram @ _block(products, every, tools, ["y"]))[:, 0])
    if rank < len(own):
        raise ValueError("the lagged covariates do not identify the lag")
    return _fitted(own, beta, inverse, n, means, products, every), rows.select("region", "t", "y", "one", *exogenous, "lag")


def minimum_norm_inverse(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Inverse of a Gram matrix on the space that its rows span, with the rank last."""
    solution, inverse, rank = minimum_norm(gram, np.zeros(len(gram)))
    return inverse, solution, rank


def _fitted(own: Sequence[str], beta: np.ndarray, inverse: np.ndarray, n: int, means: np.ndarray, products: np.ndarray, every: Sequence[str]) -> Fit:
    inner, moment = _block(products, every, own, own), _block(products, every, own, ["y"])[:, 0]
    sst = float(products[-1, -1])
    sse = max(0.0, float(sst - 2 * beta @ moment + beta @ inner @ beta))
    centre = np.array([means[list(every).index(c)] for c in own])
    variance = sse / max(1, n - len(own) - 1)
    errors = {c: float(math.sqrt(variance * inverse[a, a])) for a, c in enumerate(own)}
    level = math.sqrt(variance * (1.0 / n + centre @ inverse @ centre))
    return Fit(float(means[-1] - beta @ centre), dict(zip(own, map(float, beta))), int(n), sse, sst, errors, level)


@dataclass
class LogDeterminant:
    """ln|I − ρS| and how far off it may be (one standard error of the traces and the powers left out)."""

    regions: int
    eigenvalues: np.ndarray | None = None
    traces: np.ndarray | None = None
    spreads: np.ndarray | None = None

    def at(self, rho: float) -> tuple[float, float]:
        if self.eigenvalues is not None:
            return float(np.log(np.abs(1 - rho * self.eigenvalues)).sum()), 0.0
        m = np.arange(1, len(self.traces) + 1)
        value = -(rho**m * self.traces / m).sum()
        noise = math.sqrt((rho ** (2 * m) * self.spreads**2 / m**2).sum())
        last = len(self.traces) + 1
        return float(value), float(noise + self.regions * abs(rho) ** last / (last * max(1e-12, 1 - abs(rho))))


def log_determinant(regions: DataFrame, edges: DataFrame, exact_regions: int = EXACT_REGIONS, powers: int = POWERS, probes: int = PROBES, seed: int = 1) -> LogDeterminant:
    """Of the weights between ``regions``. Up to ``exact_regions`` the edges (at most that many squared) are solved in one place;
    beyond, traces of the powers are estimated by vectors of hashed signs that the edges multiply, one join per power."""
    regions = regions.select("region").distinct()
    count = regions.count()
    if count <= exact_regions:
        keys = {r["region"]: n for n, r in enumerate(regions.collect())}
        dense = np.zeros((count, count))
        for r in edges.groupBy("i", "j").agg(F.sum("w").alias("w")).collect():
            if r["i"] in keys and r["j"] in keys:
                dense[keys[r["i"]], keys[r["j"]]] = r["w"]
        return LogDeterminant(count, eigenvalues=np.linalg.eigvals(dense))
    columns = [f"_v{k}" for k in range(probes)]
    signs = [F.when(uniform(seed, "region", k) < 0.5, -1.0).otherwise(1.0).alias(c) for k, c in enumerate(columns)]
    start = stage(regions.select("region", *signs))
    current, traces, spreads = start, [], []
    for _ in range(powers):
        moved = edges.join(current.withColumnRenamed("region", "j"), "j").groupBy(F.col("i").alias("region")).agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in columns))
        current = stage(moved)
        met = start.join(current.select("region", *(F.col(c).alias(f"_m{c}") for c in columns)), "region")
        row = met.agg(*(F.sum(F.col(c) * F.col(f"_m{c}")).alias(c) for c in columns)).first()
        found = np.array([row[c] or 0.0 for c in columns])
        traces.append(found.mean())
        spreads.append(found.std(ddof=1) / math.sqrt(probes))
    # the first two are known exactly: the diagonal, and pairs of edges there and back
    back = edges.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("b"))
    exact = [edges.where("i = j").agg(F.sum("w")).first()[0] or 0.0, edges.join(back, ["i", "j"]).agg(F.sum(F.col("w") * F.col("b"))).first()[0] or 0.0]
    traces[: len(exact)], spreads[: len(exact)] = exact[:powers], [0.0] * len(exact[:powers])
    return LogDeterminant(count, traces=np.array(traces), spreads=np.array(spreads))


@dataclass
class Likelihood:
    """The likelihood of a spatial-lag model as a function of ρ alone, from cross products."""

    names: list[str]
    n: int
    dates: float
    means: np.ndarray
    products: np.ndarray
    determinant: LogDeterminant

    def coefficients(self, rho: float) -> tuple[np.ndarray, float]:
        """Best coefficients of the exogenous regressors given ρ, and the squared error left."""
        k = len(self.names) - 1
        gram = self.products[:k, :k]
        against = np.array([-rho, 1.0])
        moment = self.products[:k, k:] @ against
        beta, _, _ = minimum_norm(gram, moment)
        return beta, max(float(against @ self.products[k:, k:] @ against - beta @ moment), 1e-300)

    def at(self, rho: float) -> float:
        _, sse = self.coefficients(rho)
        return self.dates * self.determinant.at(rho)[0] - self.n / 2 * (math.log(2 * math.pi * sse / self.n) + 1)


def likelihood(panel: DataFrame, edges: DataFrame, covariates: Sequence[str], exogenous: Sequence[str], **options) -> tuple[Likelihood, DataFrame]:
    """(function of ρ, design rows); ``panel`` is dense, so the rows of a date are all regions."""
    rows = stage(design_rows(spatial_lag(panel, edges), covariates, "lag"))
    n, means, products = cross_products(rows, "y", [*exogenous, "lag"])
    determinant = log_determinant(panel, edges, **options)
    return Likelihood([*exogenous, "lag"], n, n / determinant.regions, means, products, determinant), rows


def maximum_likelihood(panel: DataFrame, edges: DataFrame, covariates: Sequence[str], exogenous: Sequence[str], **options) -> tuple[Fit, DataFrame]:
    """The fit of highest likelihood with |ρ| < 1, which row-normalised weights need. Errors come from the curvature of the likelihood in
    all its parameters."""
    shape, rows = likelihood(panel, edges, covariates, exogenous, **options)
    grid = np.linspace(-0.999, 0.999, GRID)
    best = int(np.argmax([shape.at(r) for r in grid]))
    low, high = grid[max(0, best - 1)], grid[min(GRID - 1, best + 1)]
    # golden sections: the likelihood has one top between two neighbours of the best
    ratio = (math.sqrt(5) - 1) / 2
    while high - low > 1e-12:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if shape.at(a) > shape.at(b) else (a, high)
    rho = (low + high) / 2
    beta, sse = shape.coefficients(rho)
    k, variance, step = len(exogenous), sse / shape.n, 1e-4
    bend = (shape.determinant.at(rho + step)[0] - 2 * shape.determinant.at(rho)[0] + shape.determinant.at(rho - step)[0]) / step**2
    steep = np.zeros((k + 2, k + 2))
    steep[: k + 1, : k + 1] = shape.products[: k + 1, : k + 1] / variance
    steep[k, k] -= shape.dates * bend
    left = shape.products[k, k + 1] - rho * shape.products[k, k] - beta @ shape.products[:k, k]
    steep[k, k + 1] = steep[k + 1, k] = left / variance**2
    steep[k + 1, k + 1] = shape.n / (2 * variance**2)
    covariance = np.linalg.pinv(steep)
    own = [*exogenous, "lag"]
    values = np.array([*beta, rho])
    centre = shape.means[: k + 1]
    errors = {c: float(math.sqrt(max(0.0, covariance[a, a]))) for a, c in enumerate(own)}
    level = math.sqrt(variance / shape.n + centre @ covariance[: k + 1, : k + 1] @ centre)
    fit = Fit(float(shape.means[-1] - values @ centre), dict(zip(own, map(float, values))), shape.n, sse, float(shape.products[-1, -1]), errors, level)
    return fit, rows

"""Regressions with Laplace and Student-t errors over distributed rows, in few passes.

Rows have a target ``x`` and regressors; ``centre`` and ``products`` are the means and centred cross products of [regressors, x] that
least squares has summed already. Regressors are taken from their means, so that the first coefficient is the level at the means.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelweave.operators.regression import minimum_norm, number
from panelweave.session import stage

#: Rows that are solved exactly in one place.
MOST_ROWS = 30_000
SAMPLE_ROWS = 10_000
ROUNDS = 24
NU_RANGE = (2.05, 200.0)
TOLERANCE = 1e-9


# --- least absolute deviations -----------------------------------------------------------


def solve_absolute(x: np.ndarray, y: np.ndarray, weight: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """The b that minimises Σ weight·|y − x·b| − slope·b, exactly up to a relative 1e-10 of the residuals.

    Reweighted least squares lead close to the answer; from the vertex there (as many rows without residual as
    coefficients), descents along edges with a weighted median as their length lead to the vertex where no edge descends.
    Equal rows are one row with their weight, and a tiny shift that depends on the sorted place keeps vertices apart.
    """
    rows, which = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)
    w = np.bincount(which.ravel(), weight)
    x, y, k = rows[:, :-1], rows[:, -1], x.shape[1]
    size = float(np.average(np.abs(y - np.average(y, weights=w)), weights=w)) or 1.0
    y = y + 1e-10 * size * (np.modf(np.arange(1, len(y) + 1) * 0.6180339887498949)[0] - 0.5)
    b, near = np.zeros(k), size
    for _ in range(60):
        pull = w / np.sqrt((y - x @ b) ** 2 + near * near)
        b = minimum_norm((x * pull[:, None]).T @ x, (x * pull[:, None]).T @ y + slope)[0]
        near = max(near * 0.8, 1e-4 * size)
    basis: list[int] = []
    span = np.zeros((0, k))
    for n in np.argsort(np.abs(y - x @ b), kind="stable").tolist():
        rest = x[n] - span.T @ (span @ x[n])
        if np.linalg.norm(rest) > 1e-7 * max(1e-300, np.linalg.norm(x[n])):
            basis.append(n)
            span = np.vstack([span, rest / np.linalg.norm(rest)])
        if len(basis) == k:
            break
    if len(basis) < k:
        return b
    for _ in range(20 * k + len(y)):
        edges = np.linalg.inv(x[basis])
        b = edges @ y[basis]
        r = y - x @ b
        r[basis] = 0.0
        down = -(x.T @ (w * np.sign(r)) + slope) @ edges
        gain = np.abs(down) - w[basis]
        j = int(gain.argmax())
        if gain[j] <= 1e-9 * w[basis[j]]:
            break
        step = -np.sign(down[j]) * edges[:, j]
        speed = x @ step
        with np.errstate(divide="ignore", invalid="ignore"):
            at = r / speed
        ahead = np.flatnonzero((at > 0) & np.isfinite(at) & (np.abs(speed) > 1e-13))
        if not len(ahead):
            break
        order = ahead[np.argsort(at[ahead], kind="stable")]
        stop = int(np.searchsorted(np.cumsum(2 * w[order] * np.abs(speed[order])), gain[j]))
        basis[j] = int(order[min(stop, len(order) - 1)])
    return b


def absolute_fit(rows: DataFrame, names: Sequence[str], centre: np.ndarray, products: np.ndarray, n: int) -> tuple[float, np.ndarray, float]:
    """(intercept, coefficients, mean |residual|) of least absolute deviations over all rows.

    A sample's answer and a trust region around it leave the sign of most residuals certain: such rows count by the sums of
    their signs alone. Only the others are written and looked at again, by a closer sample and a smaller region, until they are few enough
    to be solved exactly. An answer inside all regions is that of all rows, for there nothing else was assumed; one
    outside starts again in a larger region. Two or three passes read all rows, later ones a few hundredths of them each.
    """
    k = len(names)
    gram = products[:k, :k] / n
    _, inverse, _ = minimum_norm(gram, products[:k, k])
    metric = np.zeros((k + 1, k + 1))
    metric[0, 0], metric[1:, 1:] = 1.0, gram
    kept = [*(f"`{c}`" for c in names), "x"]

    def collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        table = df.selectExpr(*kept).toPandas().to_numpy(float).reshape(-1, k + 1)
        return np.column_stack([np.ones(len(table)), table[:, :k] - centre[:k]]), table[:, k]

    def draw(df: DataFrame, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        keys = [*names, "x", *(c for c in ("region", "t") if c in df.columns), F.lit(salt)]
        share = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / size) * (1 << 30))
        return collected(df.where(share).limit(2 * SAMPLE_ROWS))

    def answer(x: np.ndarray, y: np.ndarray, b: np.ndarray, slope: np.ndarray, signed: float) -> tuple[float, np.ndarray, float]:
        error = (float(np.abs(y - x @ b).sum()) + signed - float(slope @ b)) / n
        return float(b[0] - b[1:] @ centre[:k]), b[1:], error or 1e-6

    if n <= MOST_ROWS:
        x, y = collected(rows)
        b = solve_absolute(x, y, np.ones(len(y)), np.zeros(k + 1))
        return answer(x, y, b, np.zeros(k + 1), 0.0)
    x, y = draw(rows, n)
    start = solve_absolute(x, y, np.full(len(y), n / len(y)), np.zeros(k + 1))
    typical = float(np.abs(y - x @ start).mean()) or 1e-12
    reach = np.sqrt(1.0 + np.einsum("ij,jk,ik->i", x[:, 1:], inverse, x[:, 1:]))
    usual = float(np.quantile(np.abs(y - x @ start) / reach, min(1.0, MOST_ROWS / (2 * n))))
    first = max(3 * typical * math.sqrt((k + 1) / len(y)), usual)
    for _ in range(ROUNDS):
        found = _inside(rows, names, centre, inverse, metric, n, start, first, typical, collected, draw)
        if found[0] is not None:
            return answer(*found)
        start, first = found[1], first * 4
    raise ValueError(f"the Laplace fit did not converge in {ROUNDS} rounds")


def _inside(rows, names, centre, inverse, metric, n, start, radius, typical, collected, draw):
    """(x, y, b, slope, signed) of the rows left and the answer; (None, better start) if it leaves a region."""
    k = len(names)
    regions, slope, signed, left, size = [], np.zeros(k + 1), 0.0, rows, n
    for _ in range(ROUNDS):
        regions.append((start, radius))
        shifted = [f"(`{c}` - {number(m)})" for c, m in zip(names, centre)]
        residual = "(x - " + " - ".join([number(start[0]), *(f"{number(b)} * {s}" for b, s in zip(start[1:], shifted))]) + ")"
        # how far a residual can move inside the region, per unit of its radius
        terms = [f"{number((1 if a == b else 2) * inverse[a, b])} * {shifted[a]} * {shifted[b]}" for a in range(k) for b in range(a, k)]
        margin = f"{number(radius)} * sqrt(1D + greatest(0D, {' + '.join(terms)}))"
        marked = left.selectExpr("*", f"{residual} AS _r", f"{margin} AS _m")
        sums = [F.expr(f"sum(IF(abs(_r) > _m, signum(_r) * {e}, 0D)) AS s{j}") for j, e in enumerate(["1D", *shifted, "x"])]
        row = marked.agg(F.expr("count_if(abs(_r) <= _m) AS u"), *sums).first()
        slope, signed, before, size = slope + np.array([row[f"s{j}"] for j in range(k + 1)]), signed + row[f"s{k + 1}"], size, row["u"]
        few = size <= MOST_ROWS
        left = marked.where("abs(_r) <= _m").drop("_r", "_m")
        left = left if few else stage(left)
        x, y = collected(left) if few else draw(left, size, len(regions))
        if not len(y):
            return None, start
        b = solve_absolute(x, y, np.full(len(y), size / len(y)), slope)
        if any((b - c) @ metric @ (b - c) > r * r for c, r in regions):
            return None, b
        if few:
            return x, y, b, slope, signed
        closer = 3 * typical * math.sqrt((k + 1) / len(y)) * size / n
        room = min(r - math.sqrt(max(0.0, (b - c) @ metric @ (b - c))) for c, r in regions)
        start, radius = b, min(closer, room, radius / 2)
    return None, start


# --- Student-t ---------------------------------------------------------------------------------


def _digamma(x: float) -> float:
    total = 0.0
    while x < 10:
        total, x = total - 1 / x, x + 1
    s = 1 / (x * x)
    return total + math.log(x) - 0.5 / x - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))


def _trigamma(x: float) -> float:
    total = 0.0
    while x < 10:
        total, x = total + 1 / (x * x), x + 1
    s = 1 / (x * x)
    return total + 1 / x + s / 2 + s / x * (1 / 6 - s * (1 / 30 - s * (1 / 42 - s / 30)))


def student_sums(rows: DataFrame, names: Sequence[str], centre: np.ndarray, at: np.ndarray, curved: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood, its slopes and its curvature at ``at`` = [level, coefficients, ln spread, ln ν], in one pass with one logarithm a row."""
    k, width, nu = len(names), math.exp(at[-2]), math.exp(at[-1])
    shifted = ["1D", *(f"(`{c}` - {number(m)})" for c, m in zip(names, centre))]
    z = "(x - " + " - ".join(f"{number(b)} * {s}" for b, s in zip(at, shifted)) + f") / {number(width)}"
    rows = rows.selectExpr(*(f"{s} AS _x{j}" for j, s in enumerate(shifted)), f"{z} AS _z").selectExpr("*", "_z * _z AS _u", f"1D / ({number(nu)} + _z * _z) AS _d")
    sums = [f"avg(_z * _d * _x{j}) AS g{j}" for j in range(k + 1)]
    sums += ["avg(_u * _d) AS u", f"avg(ln(1D + _u / {number(nu)})) AS l", "avg(_u * _d * _d) AS uu", "avg(_u * (_u - 1D) * _d * _d) AS un"]
    if curved:
        sums += [f"avg(({number(nu)} - _u) * _d * _d * _x{i} * _x{j}) AS h{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)]
        sums += [f"avg(_z * _d * _d * _x{j}) AS a{j}" for j in range(k + 1)] + [f"avg(_z * (_u - 1D) * _d * _d * _x{j}) AS b{j}" for j in range(k + 1)]
        sums.append(f"avg(_u * _d / {number(nu)} + _u * ({number(nu)} / _d - {number(nu + 1)} * (1D / _d + {number(nu)})) * _d * _d / {number(nu * nu)}) AS nn")
    row = rows.agg(*map(F.expr, sums)).first()
    constant = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
    value = constant - at[-2] - (nu + 1) / 2 * row["l"]
    by_nu = 0.5 * (_digamma((nu + 1) / 2) - _digamma(nu / 2) - 1 / nu - row["l"] + (nu + 1) / nu * row["u"])
    slopes = np.array([*((nu + 1) / width * row[f"g{j}"] for j in range(k + 1)), (nu + 1) * row["u"] - 1, nu * by_nu])
    curve = np.zeros((k + 3, k + 3))
    if curved:
        for i in range(k + 1):
            for j in range(i, k + 1):
                curve[i, j] = curve[j, i] = -(nu + 1) / width**2 * row[f"h{i}_{j}"]
            curve[i, k + 1] = curve[k + 1, i] = -2 * nu * (nu + 1) / width * row[f"a{i}"]
            curve[i, k + 2] = curve[k + 2, i] = nu / width * row[f"b{i}"]
        curve[k + 1, k + 1] = -2 * nu * (nu + 1) * row["uu"]
        curve[k + 1, k + 2] = curve[k + 2, k + 1] = nu * row["un"]
        second = 0.5 * (0.5 * _trigamma((nu + 1) / 2) - 0.5 * _trigamma(nu / 2) + 1 / nu**2 + row["nn"])
        curve[k + 2, k + 2] = nu * nu * second + nu * by_nu
    return value, slopes, curve


def student_fit(rows: DataFrame, names: Sequence[str], centre: np.ndarray, products: np.ndarray, start: np.ndarray, level: float, spread: float, n: int):
    """(intercept, coefficients, spread, ν) of the highest likelihood over all rows, ν within ``NU_RANGE``.

    Newton steps on all parameters at once: a pass yields the likelihood, its slopes and its curvature. Where the curvature does
    not point downhill the expected one takes its place, and a step that lowers the likelihood is halved.
    """
    k, low, high = len(names), math.log(NU_RANGE[0]), math.log(NU_RANGE[1])
    nu = 8.0
    at = np.array([level, *start, math.log((spread or 1e-6) * math.sqrt((nu - 2) / nu)), math.log(nu)])
    held, step = None, np.zeros(k + 3)
    for _ in range(ROUNDS):
        value, slopes, curve = student_sums(rows, names, centre, at)
        if held is not None and not value >= held[0] - 1e-12 * abs(held[0]):
            step = step / 4
            at = held[1] + step
            continue
        held = value, at
        width, nu = math.exp(at[-2]), math.exp(at[-1])
        free = np.ones(k + 3, dtype=bool)
        # at the border of ν a slope outwards is no way on
        free[-1] = not (at[-1] >= high - 1e-12 and slopes[-1] > 0 or at[-1] <= low + 1e-12 and slopes[-1] < 0)
        steep = -curve[np.ix_(free, free)]
        if np.linalg.eigvalsh(steep).min() <= 0:
            expected = np.zeros((k + 3, k + 3))
            expected[0, 0] = (nu + 1) / (nu + 3) / width**2
            expected[1 : k + 1, 1 : k + 1] = (nu + 1) / (nu + 3) / width**2 * products[:k, :k] / n
            expected[k + 1, k + 1] = 2 * nu / (nu + 3)
            expected[k + 1, k + 2] = expected[k + 2, k + 1] = -2 * nu / ((nu + 1) * (nu + 3))
            expected[k + 2, k + 2] = nu * nu * (0.25 * (_trigamma(nu / 2) - _trigamma((nu + 1) / 2)) - (nu + 5) / (2 * nu * (nu + 1) * (nu + 3)))
            steep = expected[np.ix_(free, free)]
        step = np.zeros(k + 3)
        step[free] = minimum_norm(steep, slopes[free])[0]
        # spread and ν are taken in steps of at most a factor of three
        step /= max(1.0, np.abs(step[-2:]).max() / math.log(3))
        gain = float(slopes @ step)
        if gain < TOLERANCE:
            return float(at[0] - at[1 : k + 1] @ centre[:k]), at[1 : k + 1], width, nu
        at = at + step
        at[-1] = min(high, max(low, at[-1]))
        step = at - held[1]
    raise ValueError(f"the Student-t fit did not converge in {ROUNDS} rounds")

"""Lags over a full Gaussian kernel without its N·(N−1) edges, by a fast Gauss transform.

exp(−(x − y)²/2h²) is, around the centre of the cell of y, a series of products of a power of y's offset and a Hermite function of x's. The
values of a cell and date enter by the sums of their powers, its moments; a target adds up, cell by cell, Hermite functions times
moments. With cells no wider than the bandwidth a dozen terms per axis give nine digits. Work and rows grow with the number of regions, not with its square.

The moments are summed in blocks of regions and dates, and blocks of blocks, so no group grows with the panel, and always in one order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelweave.operators.pair_ranks import median_distance
from panelweave.session import stage

#: Regions of a block, and blocks whose moments are added up in one group.
BLOCK_REGIONS = 1_024
FAN_IN = 256
#: Cells over all axes, and terms per axis.
MOST_CELLS, MOST_TERMS = 4_096, 40
#: Numbers of moments, and dates, that one group of dates may have.
MOMENTS, GROUP_DATES = 4_000_000, 256
# Fixed value: Cramér's constant, which bounds Hermite functions.
CRAMER = 1.086435


def error_bound(terms: int, offset: float, dims: int) -> float:
    """Most that one pair's weight can be wrong by: ``offset`` is the half width of a cell in bandwidths."""
    one = CRAMER * offset**terms / math.sqrt(math.factorial(terms)) / (1 - offset / math.sqrt(terms + 1))
    return math.expm1(dims * math.log1p(one))


def _terms(tolerance: float, offset: float, dims: int) -> int:
    for terms in range(1, MOST_TERMS + 1):
        if error_bound(terms, offset, dims) <= tolerance:
            return terms
    raise ValueError(f"no {MOST_TERMS} terms reach a tolerance of {tolerance}")


def _powers(offsets: np.ndarray, terms: int) -> np.ndarray:
    """Rows × terms**axes: products of offset**n / n! over the axes."""
    n = np.arange(terms)
    scale = np.array([1 / math.factorial(k) for k in n])
    return _products([offsets[:, a : a + 1] ** n * scale for a in range(offsets.shape[1])])


def _hermite(t: np.ndarray, terms: int) -> np.ndarray:
    """Rows × terms**axes: products of exp(−t²)·Hₙ(t) over the axes."""
    sides = []
    for a in range(t.shape[1]):
        x = t[:, a]
        made = [np.exp(-x * x), 2 * x * np.exp(-x * x)]
        for n in range(1, terms - 1):
            made.append(2 * x * made[n] - 2 * n * made[n - 1])
        sides.append(np.stack(made[:terms], axis=1))
    return _products(sides)


def _products(sides: list[np.ndarray]) -> np.ndarray:
    made = sides[0]
    for side in sides[1:]:
        made = (made[:, :, None] * side[:, None, :]).reshape(len(made), -1)
    return made


def kernel_lag(
    panel: DataFrame, points: DataFrame, coords: Sequence[str], bandwidth: float | None = None, column: str = "y", out: str = "lag",
    tolerance: float = 1e-10, normalise: bool = True,
) -> DataFrame:
    """Panel rows plus ``out`` = Σ_j w(i, j)·column(j, t) over all j ≠ i, w Gaussian of the distance; rows of w sum to one if ``normalise``.

    The default bandwidth is the median distance. Without ``normalise`` a value is off by at most ``tolerance`` · Σ|column| of its date.
    A NULL of another region makes the lag NULL; a region without coordinates, or an absent cell, counts for nothing. Up to three axes; a
    bandwidth so small that cells would be more than ``MOST_CELLS`` is an error: then edges up to a cutoff are few.
    """
    if not 1 <= len(coords) <= 3:
        raise ValueError("the kernel lag needs one to three coordinates")
    h = bandwidth if bandwidth is not None else median_distance(points, coords)
    if not h:
        raise ValueError("the bandwidth must be positive")
    axes = [f"_p{n}" for n in range(len(coords))]
    placed = points.select("region", *(F.col(c).cast("double").alias(p) for c, p in zip(coords, axes))).dropna()
    box = placed.agg(F.count(F.lit(1)).alias("n"), *(f(p).alias(f"{a}{p}") for p in axes for a, f in (("low", F.min), ("high", F.max)))).first()
    low = np.array([box[f"low{p}"] for p in axes])
    counts = np.maximum(1, np.ceil((np.array([box[f"high{p}"] for p in axes]) - low) / h)).astype(int)
    if counts.prod() > MOST_CELLS:
        raise ValueError(f"{counts.prod()} cells of the bandwidth's width: use edges up to a cutoff")
    side = np.maximum((np.array([box[f"high{p}"] for p in axes]) - low) / counts, 1e-300)
    terms = _terms(tolerance, float((side / h).max()) / 2, len(axes))
    grid = _Grid(low, side, counts, h, terms)
    blocks = max(1, -(-box["n"] // BLOCK_REGIONS))
    home = placed.withColumn("_block", F.pmod(F.xxhash64("region"), F.lit(blocks)).cast("int"))
    dates = panel.agg(F.count_distinct("t")).first()[0]
    parts = max(1, -(-dates * grid.size // MOMENTS), -(-dates // GROUP_DATES))

    values = panel.select("region", "t", F.col(column).cast("double").alias("_y"))
    sums = _sums(values, home, axes, grid, parts, blocks)
    gaps = panel.groupBy("t").agg(F.count_if(F.col(column).isNull()).alias("_gaps"))
    found = panel.join(sums, ["region", "t"], "left").join(gaps, "t")
    total = F.coalesce("_s", F.lit(0.0)) - F.when(F.col("_s").isNotNull(), F.coalesce(F.col(column), F.lit(0.0))).otherwise(0.0)
    if normalise:
        ones = _sums(home.select("region", F.lit(0).alias("t"), F.lit(1.0).alias("_y")), home, axes, grid, 1, blocks)
        found = found.join(ones.select("region", F.col("_s").alias("_w")), "region", "left")
        total = F.when(F.col("_w") - 1.0 > 0, total / (F.col("_w") - 1.0)).otherwise(total)
    known = F.col("_gaps") - F.col(column).isNull().cast("int") == 0
    return found.withColumn(out, F.when(known, total)).select(*panel.columns, out)


class _Grid:
    """Cells of the bandwidth's width at most, and the series around their centres."""

    def __init__(self, low: np.ndarray, side: np.ndarray, counts: np.ndarray, h: float, terms: int):
        self.low, self.side, self.counts, self.terms = low, side, counts, terms
        self.unit = math.sqrt(2) * h
        self.cells = int(counts.prod())
        self.size = self.cells * terms ** len(counts)

    def centre(self, cells: np.ndarray) -> np.ndarray:
        return self.low + (np.stack(np.unravel_index(cells, self.counts), axis=-1) + 0.5) * self.side

    def cells_of(self, x: np.ndarray) -> np.ndarray:
        index = np.clip(np.floor((x - self.low) / self.side).astype(int), 0, self.counts - 1)
        return np.ravel_multi_index(tuple(index.T), self.counts)

    def moments(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Cells × terms × dates, of places x and values y (places × dates)."""
        cells = self.cells_of(x)
        powers = _powers((x - self.centre(cells)) / self.unit, self.terms)
        made = np.zeros((self.cells, powers.shape[1], y.shape[1]))
        for c in np.unique(cells):
            here = cells == c
            made[c] = powers[here].T @ y[here]
        return made

    def sums(self, x: np.ndarray, moments: np.ndarray) -> np.ndarray:
        """Places × dates."""
        made = np.zeros((len(x), moments.shape[2]))
        for c in np.flatnonzero(moments.any(axis=(1, 2))):
            made += _hermite((x - self.centre(np.array(c))) / self.unit, self.terms) @ moments[c]
        return made


def _square(rows: pd.DataFrame, axes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(regions, dates, places, values) of a block; what is absent or null is zero."""
    regions, at = np.unique(rows["region"].to_numpy(), return_inverse=True)
    dates, when = np.unique(rows["t"].to_numpy(), return_inverse=True)
    x, y = np.zeros((len(regions), len(axes))), np.zeros((len(regions), len(dates)))
    x[at] = rows[axes].to_numpy(float)
    y[at, when] = np.nan_to_num(rows["_y"].to_numpy(float))
    return regions, dates, x, y


def _sums(values: DataFrame, home: DataFrame, axes: list[str], grid: _Grid, parts: int, blocks: int) -> DataFrame:
    """(region, t, _s): Σ over all regions, the own one included, of the kernel times the value."""
    spark = values.sparkSession
    rows = values.join(home, "region").withColumn("_part", F.pmod(F.xxhash64("t"), F.lit(parts)).cast("int"))
    when, who = values.schema["t"].dataType.simpleString(), values.schema["region"].dataType.simpleString()

    def moments(group: pd.DataFrame) -> pd.DataFrame:
        _, dates, x, y = _square(group, axes)
        made = grid.moments(x, y)
        return pd.DataFrame({"_part": group["_part"].iloc[0], "_block": group["_block"].iloc[0], "t": dates, "_m": [made[:, :, n].ravel() for n in range(len(dates))]})

    schema = f"_part int, _block int, t {when}, _m array<double>"
    found = stage(rows.groupBy("_part", "_block").applyInPandas(moments, schema))
    left = blocks
    while left > 1:

        def added(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["t", "_block"])
            dates, first = np.unique(group["t"].to_numpy(), return_index=True)
            made = np.add.reduceat(np.stack(group["_m"].to_numpy()), first, axis=0)
            return pd.DataFrame({"_part": group["_part"].iloc[0], "_block": group["_up"].iloc[0], "t": dates, "_m": list(made)})

        up = found.withColumn("_up", F.floor(F.col("_block") / FAN_IN).cast("int"))
        found = stage(up.groupBy("_part", "_up").applyInPandas(added, schema))
        left = -(-left // FAN_IN)

    def summed(group: pd.DataFrame, all_moments: pd.DataFrame) -> pd.DataFrame:
        if group.empty or all_moments.empty:
            return pd.DataFrame({"region": [], "t": [], "_s": []})
        regions, dates, x, _ = _square(group, axes)
        all_moments = all_moments.sort_values("t")
        held = np.searchsorted(all_moments["t"].to_numpy(), dates)
        m = np.stack(all_moments["_m"].to_numpy())[held].reshape(len(dates), grid.cells, -1).transpose(1, 2, 0)
        s = grid.sums(x, m)
        return pd.DataFrame({"region": np.repeat(regions, len(dates)), "t": np.tile(dates, len(regions)), "_s": s.ravel()})

    every = spark.range(blocks).select(F.col("id").cast("int").alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    copies = every.join(found.select("_part", "t", "_m"), "_part")
    return rows.groupBy("_part", "_block").cogroup(copies.groupBy("_part", "_block")).applyInPandas(summed, f"region {who}, t {when}, _s double")

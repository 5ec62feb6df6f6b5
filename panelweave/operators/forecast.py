"""Pooled probabilistic autoregression and its sample paths.

One global model over all regions: the value of a region, divided by its recent mean absolute
value, given its own lags (and optional covariates of the target step). Each fitting pass is one
distributed cross-product aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelweave.functions.hashing import uniform
from panelweave.functions.heads import head
from panelweave.functions.scalars import total
from panelweave.operators.ordered import is_calendar, over_neighbourhood, tail
from panelweave.operators.regression import complete_rows, cross_products, minimum_norm
from panelweave.operators.robust import absolute_fit, student_fit
from panelweave.session import wide_partitions

DEFAULT_LAGS = (1, 2, 3, 7)
PART_SAMPLES = 16


@dataclass(frozen=True)
class Autoregression:
    """Fitted model in scaled units."""

    distribution: str
    lags: tuple[int, ...]
    intercept: float
    phi: tuple[float, ...]
    spread: float
    nu: float | None = None
    covariates: tuple[str, ...] = ()
    gamma: tuple[float, ...] = ()

    @property
    def head(self):
        return head(self.distribution, **({"nu": self.nu} if self.nu is not None else {}))

    def location(self) -> Column:
        """Expected scaled value of a row of ``lag_rows``."""
        terms = [F.lit(b) * F.col(f"lag{k}") for k, b in zip(self.lags, self.phi)]
        terms += [F.lit(b) * F.col(c) for c, b in zip(self.covariates, self.gamma)]
        return total([F.lit(self.intercept), *terms])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [("intercept", 0, self.intercept), ("spread", 0, self.spread)]
        rows += [("phi", k, b) for k, b in zip(self.lags, self.phi)]
        rows += [("gamma", n, b) for n, b in enumerate(self.gamma)]
        if self.nu is not None:
            rows.append(("nu", 0, self.nu))
        return spark.createDataFrame(rows, "param string, idx int, value double")

    def as_dict(self) -> dict:
        return asdict(self)


def region_scale(df: DataFrame, context_length: int, column: str = "y", scaling: bool = True) -> DataFrame:
    """(region, scale): mean |value| over the observed among the last ``context_length`` rows."""
    if not scaling:
        return df.select("region").distinct().withColumn("scale", F.lit(1.0))
    means = tail(df, ["region"], context_length).groupBy("region").agg(F.avg(F.abs(column)).alias("_mean"))
    return means.select("region", F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(1.0).alias("scale"))


def lag_rows(
    df: DataFrame, scales: DataFrame, lags: Sequence[int], column: str = "y", covariates: Sequence[str] = (), freq: str = "D"
) -> DataFrame:
    """(region, t, x, lag<k>…, covariates…) with x = value / scale."""
    scaled = df.join(scales, "region").select("region", "t", (F.col(column) / F.col("scale")).alias("x"), *covariates)
    return over_neighbourhood(
        scaled, ["region"], freq, max(lags), 0, lambda w: {f"lag{k}": F.lag("x", k).over(w) for k in lags}
    )


def fit(
    df: DataFrame,
    context_length: int,
    distribution: str = "laplace",
    lags: Sequence[int] = DEFAULT_LAGS,
    column: str = "y",
    scaling: bool = True,
    covariates: Sequence[str] = (),
    freq: str = "D",
) -> Autoregression:
    """Gaussian by least squares, Laplace by least absolute deviations, Student-t by Newton steps on the likelihood; all over every row."""
    head(distribution)
    lags = tuple(k for k in lags if k <= context_length)
    if not lags:
        raise ValueError("no lag fits into the context")
    names = [*(f"lag{k}" for k in lags), *covariates]
    rows = lag_rows(df, region_scale(df, context_length, column, scaling), lags, column, covariates, freq)
    rows = complete_rows(rows, ["x", *names])
    repeated = distribution != "gaussian"
    if repeated:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, means, products = cross_products(rows, "x", names)
        beta, intercept, sse = _solution(means, products)
        spread, nu = math.sqrt(max(sse, 0.0) / n), None
        if distribution == "laplace":
            intercept, beta, spread = absolute_fit(rows, names, means, products, n)
        elif distribution == "student_t":
            intercept, beta, spread, nu = student_fit(rows, names, means, products, beta, float(means[-1]), spread, n)
    finally:
        if repeated:
            rows.unpersist()
    split = len(lags)
    return Autoregression(
        distribution, lags, float(intercept), tuple(map(float, beta[:split])), float(spread), nu,
        tuple(covariates), tuple(map(float, beta[split:])),
    )


def _solution(means: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, float, float]:
    k = len(means) - 1
    gram, moment = products[:k, :k], products[:k, k]
    beta, _, _ = minimum_norm(gram, moment)
    sse = products[k, k] - 2 * beta @ moment + beta @ gram @ beta
    return beta, float(means[k] - beta @ means[:k]), float(sse)


def loss(df: DataFrame, model: Autoregression, scales: DataFrame, column: str = "y", freq: str = "D") -> DataFrame:
    """Mean negative log-likelihood of the observed values given their past, in original units."""
    rows = lag_rows(df, scales, model.lags, column, model.covariates, freq)
    rows = complete_rows(rows, ["x", *(f"lag{k}" for k in model.lags), *model.covariates]).join(scales, "region")
    nll = model.head.nll(F.col("x") * F.col("scale"), model.location(), model.spread, F.col("scale"))
    return rows.agg(F.avg(nll).alias("nll"), F.count(F.lit(1)).alias("n"))


def advance(t: Column, steps: Column, freq: str) -> Column:
    """The date ``steps`` steps after ``t``."""
    if freq in ("D", "W"):
        return F.date_add(t, steps * (7 if freq == "W" else 1))
    if is_calendar(freq):
        return F.add_months(t, steps * {"M": 1, "Q": 3, "Y": 12}[freq])
    unit = {"h": "HOUR", "min": "MINUTE", "s": "SECOND"}[freq]
    return F.timestamp_add(unit, steps, t)


def reach(model: Autoregression, context_length: int) -> int:
    """How many of a region's last rows its paths are drawn from."""
    return max(*model.lags, context_length)


def _part_samples(num_samples: int) -> Column:
    first = F.col("_part") * PART_SAMPLES + 1
    return F.sequence(first, F.least(first + PART_SAMPLES - 1, F.lit(num_samples)))


def known_ahead(
    ends: DataFrame, future: DataFrame, covariates: Sequence[str], gamma: Sequence[float], prediction_length: int, freq: str = "D"
) -> DataFrame:
    """(region, _drift): what the covariates add to each step, one array of ``prediction_length`` numbers per region.

    ``ends`` has a region's last date as ``_last``. Rows of ``future`` on other dates or regions do not matter; a step without a
    row, with a null covariate or with two rows raises when the array is read.
    """
    steps = ends.select("region", "_last", F.explode(F.sequence(F.lit(1), F.lit(prediction_length))).alias("_step"))
    wanted = steps.select("region", "_step", advance(F.col("_last"), F.col("_step"), freq).cast(future.schema["t"].dataType).alias("t"))
    given = future.select("region", "t", total([F.lit(float(g)) * F.col(c).cast("double") for c, g in zip(covariates, gamma)]).alias("_term"))
    where = F.concat(F.lit("region "), F.col("region").cast("string"))
    absent = F.raise_error(F.concat(where, F.lit(" has no covariates for "), F.col("t").cast("string")))
    cells = wanted.join(given, ["region", "t"], "left").select(
        "region", F.struct("_step", F.when(F.col("_term").isNotNull(), F.col("_term")).otherwise(absent).alias("v")).alias("_cell")
    )
    arrays = cells.groupBy("region").agg(F.array_sort(F.collect_list("_cell")).alias("_cells"))
    twice = F.raise_error(F.concat(where, F.lit(" has several rows of covariates for one date")))
    return arrays.select("region", F.when(F.size("_cells") == prediction_length, F.col("_cells")["v"]).otherwise(twice).alias("_drift"))


def sample_paths(
    df: DataFrame,
    model: Autoregression,
    context_length: int,
    prediction_length: int,
    num_samples: int = 100,
    seed: int = 0,
    column: str = "y",
    scaling: bool = True,
    freq: str = "D",
    non_negative: bool = False,
    future: DataFrame | None = None,
) -> DataFrame:
    """Forecast rows (region, step, t, sample_id, value): every draw feeds the next step.

    Each region sends its last values once per part of ``PART_SAMPLES`` samples; these few rows
    are spread over all cores, because the draws cost far more than the rows. The paths then
    unfold inside one expression per (region, sample). Unobserved past values count as 0.

    A model with covariates needs ``future``: rows (region, t, covariates) for every step ahead of each region; they travel
    with the last values as one array, see ``known_ahead``.
    """
    if model.covariates and future is None:
        raise ValueError(f"the model reads {', '.join(model.covariates)}: pass their future rows")
    depth = max(model.lags)
    recent = tail(df, ["region"], reach(model, context_length))
    cells = F.col("_cells")
    newest = F.reverse(cells)
    window = F.slice(newest, 1, context_length)
    observed = F.filter(window, lambda c: c["v"].isNotNull())
    magnitude = F.aggregate(observed, F.lit(0.0), lambda s, c: s + F.abs(c["v"]))
    average = F.when(F.size(observed) > 0, magnitude / F.size(observed))
    scale = F.when(average > 0, average).otherwise(1.0) if scaling else F.lit(1.0)
    values = F.transform(cells, lambda c: F.coalesce(c["v"], F.lit(0.0)) / F.col("scale"))
    padded = F.slice(F.concat(F.array_repeat(F.lit(0.0), depth), values), -depth, depth)
    state = (
        recent.groupBy("region")
        .agg(F.array_sort(F.collect_list(F.struct("t", F.col(column).alias("v")))).alias("_cells"))
        .withColumn("scale", scale)
        .select("region", F.element_at("_cells", -1)["t"].alias("_last"), "scale", padded.alias("_past"))
    )
    if model.covariates:
        state = state.join(known_ahead(state.select("region", "_last"), future, model.covariates, model.gamma, prediction_length, freq), "region")
    state = (
        state.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit((num_samples - 1) // PART_SAMPLES))))
        .repartition(wide_partitions(df.sparkSession), "region", "_part")
        .withColumn("sample_id", F.explode(_part_samples(num_samples)))
    )

    def draw(path: Column, step: Column) -> Column:
        u = uniform(seed, "region", "sample_id", step, F.lit("u"))
        v = uniform(seed, "region", "sample_id", step, F.lit("v"))
        location = total(
            [
                F.lit(model.intercept),
                *(F.lit(b) * F.element_at(path, -k) for k, b in zip(model.lags, model.phi)),
                *([F.element_at("_drift", step)] if model.covariates else []),
            ]
        )
        return F.concat(path, F.array(model.head.sample(u, v, location, model.spread)))

    paths = F.aggregate(F.sequence(F.lit(1), F.lit(prediction_length)), F.col("_past"), draw)
    drawn = state.select(
        "region", "_last", "scale", "sample_id", F.posexplode(F.slice(paths, depth + 1, prediction_length)).alias("_at", "_value")
    )
    value = F.col("_value") * F.col("scale")
    step = F.col("_at") + 1
    return drawn.select(
        "region",
        step.alias("step"),
        advance(F.col("_last"), step, freq).alias("t"),
        "sample_id",
        (F.greatest(F.lit(0.0), value) if non_negative else value).alias("value"),
    )


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    """Per region and step: mean, median, std, 10 % and 90 % quantiles, number of samples."""
    marks = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    grouped = forecasts.groupBy("region", "step", "t").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        marks.alias("_q"),
        F.count(F.lit(1)).alias("num_samples"),
    )
    return grouped.select(
        "region", "step", "t", "mean", F.col("_q")[1].alias("median"), "std",
        F.col("_q")[0].alias("quantile_10"), F.col("_q")[2].alias("quantile_90"), "num_samples",
    )


def fan_table(
    forecasts: DataFrame,
    history: DataFrame,
    plot_length: int = 50,
    intervals: Sequence[float] = (50.0, 90.0),
    truth: DataFrame | None = None,
    column: str = "y",
) -> DataFrame:
    """Rows (region, t, series, value): the last ``plot_length`` values of the history, the median,
    the bounds of the central intervals, and the truth when given."""
    marks = [("median", 0.5)]
    for width in intervals:
        marks += [(f"lower_{width:g}", (1 - width / 100) / 2), (f"upper_{width:g}", (1 + width / 100) / 2)]
    grouped = forecasts.groupBy("region", "t").agg(
        F.percentile("value", F.array(*(F.lit(p) for _, p in marks))).alias("_q")
    )
    bands = grouped.select(
        "region",
        "t",
        F.inline(F.array(*(F.struct(F.lit(name).alias("series"), F.col("_q")[n].alias("value")) for n, (name, _) in enumerate(marks)))),
    )

    def line(df: DataFrame, name: str) -> DataFrame:
        return df.select("region", "t", F.lit(name).alias("series"), F.col(column).alias("value"))

    table = line(tail(history, ["region"], plot_length), "history").unionByName(bands)
    return table if truth is None else table.unionByName(line(truth, "truth"))

"""Scores of sample forecasts against truth, and of estimated parameters.

Metric tables are tidy: (section, metric, value, label), where a row carries a number or a label.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelweave.functions.scalars import ratio
from panelweave.operators.lag import spatial_lags
from panelweave.operators.ordered import over_neighbourhood

QUANTILES = (0.1, 0.5, 0.9)

# Thresholds and labels of the causal evaluation, and name patterns of the metric families.
EFFECT, SPILLOVER = 0.1, 0.3
SIGNIFICANT, NOT_SIGNIFICANT = "Significant", "Not significant"
STRONG_CORRELATION, WEAK_CORRELATION = "Strong spatial correlation", "Weak spatial correlation"
NEGATIVE_EFFECT, POSITIVE_EFFECT, WEAK_EFFECT = "Strong negative effect", "Strong positive effect", "Weak effect"
STRONG_SPILLOVERS, WEAK_SPILLOVERS = "Strong spatial spillovers", "Weak spatial spillovers"
COMPLEXITY = ((100, "High"), (50, "Medium"), (-1, "Low"))
FORECAST_NAMES, CAUSAL_NAMES = "mse|mae|rmse|mape|smape", "delta|rho|gamma|treatment|spatial"
MSIS_ALPHA = 0.05


def forecast_cells(forecasts: DataFrame, truth: DataFrame, probabilities: Sequence[float] = ()) -> DataFrame:
    """One row per forecast cell with its truth ``y``: mean, median, std and ``q_<p>`` columns.

    One aggregate reads each sample once; a group holds the samples of one cell.
    """
    marks = list(dict.fromkeys([0.5, *probabilities]))
    grouped = forecasts.groupBy("region", "t").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.percentile("value", F.array(*map(F.lit, marks))).alias("_q"),
    )
    named = [F.col("_q")[n].alias(quantile_name(p)) for n, p in enumerate(marks)]
    return grouped.select("region", "t", "mean", "std", F.col("_q")[0].alias("median"), *named).join(
        truth.select("region", "t", "y"), ["region", "t"]
    )


def quantile_name(p: float) -> str:
    return f"q_{p:.6g}".replace(".", "_")


def _bounds(q: float) -> tuple[float, float]:
    return round((1 - q) / 2, 12), round((1 + q) / 2, 12)


def coverage_probabilities(quantiles: Sequence[float] = QUANTILES) -> list[float]:
    return [p for q in quantiles if q != 0.5 for p in _bounds(q)]


def absolute_percentage(y: Column, forecast: Column, zero: str = "inf") -> Column:
    """|y − f| / |y|. A zero truth gives infinity (NaN when the forecast is zero too), or NULL with
    ``zero='skip'``."""
    limit = F.when(forecast == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return ratio(F.abs(y - forecast), F.abs(y), None if zero == "skip" else limit)


def tidy(row: DataFrame, section: str, names: Sequence[str] | None = None) -> DataFrame:
    """A one-row table of numbers as metric rows."""
    names = list(names or row.columns)
    entries = [
        F.struct(F.lit(section).alias("section"), F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"),
                 F.lit(None).cast("string").alias("label"))
        for n in names
    ]
    return row.select(F.inline(F.array(*entries)))


def point_metrics(cells: DataFrame, zero: str = "inf") -> DataFrame:
    """mse, mae, rmse, mape of the mean."""
    error = F.col("mean") - F.col("y")
    sums = cells.agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.avg(absolute_percentage(F.col("y"), F.col("mean"), zero)) * 100).alias("mape"),
    )
    return sums.select("mse", "mae", F.sqrt("mse").alias("rmse"), "mape")


def median_metrics(cells: DataFrame) -> DataFrame:
    error = F.col("median") - F.col("y")
    return cells.agg(F.avg(error * error).alias("median_mse"), F.avg(F.abs(error)).alias("median_mae"))


def uncertainty_metrics(cells: DataFrame) -> DataFrame:
    return cells.agg(F.avg("std").alias("mean_std"), F.stddev_pop("std").alias("std_std"))


def coverage_metrics(cells: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Share of truths inside the central interval of each q ≠ 0.5, bounds included."""
    return cells.agg(*_coverage_columns(quantiles))


def _coverage_columns(quantiles: Sequence[float]) -> list[Column]:
    columns = []
    for q in quantiles:
        if q != 0.5:
            low, high = map(quantile_name, _bounds(q))
            columns.append(F.avg(F.col("y").between(F.col(low), F.col(high)).cast("double")).alias(f"coverage_{int(q * 100)}"))
    return columns


def forecast_metrics(
    forecasts: DataFrame, truth: DataFrame, quantiles: Sequence[float] = QUANTILES, zero: str = "inf"
) -> DataFrame:
    """The whole bundle from one aggregate over the cells, as metric rows."""
    cells = forecast_cells(forecasts, truth, coverage_probabilities(quantiles))
    e, m = F.col("mean") - F.col("y"), F.col("median") - F.col("y")
    sums = cells.agg(
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(absolute_percentage(F.col("y"), F.col("mean"), zero)) * 100).alias("mape"),
        F.avg(m * m).alias("median_mse"),
        F.avg(F.abs(m)).alias("median_mae"),
        F.avg("std").alias("mean_std"),
        F.stddev_pop("std").alias("std_std"),
        *_coverage_columns(quantiles),
    )
    return tidy(sums, "forecast_metrics")


def spatial_metrics(forecasts: DataFrame, truth: DataFrame, edges: DataFrame) -> DataFrame:
    """Correlations of error, forecast mean and truth with their own spatial lags.

    The lag is linear, so that of the error is the difference of the other two.
    """
    means = forecasts.groupBy("region", "t").agg(F.avg("value").alias("mean"))
    cells = means.join(truth.select("region", "t", "y"), ["region", "t"]).withColumn("error", F.col("mean") - F.col("y"))
    lagged = spatial_lags(cells, edges, {"lag_mean": "mean", "lag_y": "y"})
    lagged = lagged.withColumn("lag_error", F.col("lag_mean") - F.col("lag_y"))
    pairs = (
        ("spatial_error_correlation", "error", "lag_error"),
        ("forecast_spatial_autocorr", "mean", "lag_mean"),
        ("true_spatial_autocorr", "y", "lag_y"),
    )
    return tidy(lagged.agg(*(correlation(a, b).alias(name) for name, a, b in pairs)), "spatial_metrics")


def correlation(a: str, b: str) -> Column:
    """Pearson correlation, NULL when a side is constant."""
    return F.when((F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.corr(a, b))


def _labels(section: str, df: DataFrame, metric: Column, label: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), metric.alias("metric"), F.lit(None).cast("double").alias("value"), label.alias("label")
    ).where("metric IS NOT NULL")


def causal_evaluation(params: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Significance labels of δ and ρ and, given true parameters, errors: absolute for δ and ρ,
    mse and mae for γ."""
    name, value = F.col("param"), F.col("value")
    metric = F.when(name == "delta", "treatment_significance").when(name == "rho", "spatial_significance")
    label = F.when(
        name == "delta", F.when(F.abs(value) > EFFECT, SIGNIFICANT).otherwise(NOT_SIGNIFICANT)
    ).otherwise(F.when(F.abs(value) > SPILLOVER, STRONG_CORRELATION).otherwise(WEAK_CORRELATION))
    table = _labels("causal_evaluation", params, metric, label)
    if truth is None:
        return table
    both = (
        params.where(name.isin("delta", "rho", "gamma"))
        .join(truth.where(name.isin("delta", "rho", "gamma")).withColumnRenamed("value", "_true"), ["param", "idx"], "full")
        .where((name == "gamma") | (value.isNotNull() & F.col("_true").isNotNull()))
        .withColumn("_error", F.coalesce(F.abs(value - F.col("_true")), F.raise_error(F.lit("the lists of gamma differ in length"))))
        .groupBy("param")
        .agg(F.avg("_error").alias("mae"), F.avg(F.col("_error") * F.col("_error")).alias("mse"))
    )
    vector = F.array(
        F.struct(F.lit("_mse").alias("suffix"), F.col("mse").alias("value")),
        F.struct(F.lit("_mae").alias("suffix"), F.col("mae").alias("value")),
    )
    scalar = F.array(F.struct(F.lit("_error").alias("suffix"), F.col("mae").alias("value")))
    errors = both.select("param", F.inline(F.when(name == "gamma", vector).otherwise(scalar))).select(
        F.lit("causal_evaluation").alias("section"),
        F.concat("param", "suffix").alias("metric"),
        "value",
        F.lit(None).cast("string").alias("label"),
    )
    return table.unionByName(errors)


def interpretability(params: DataFrame, num_cells: int | None = None) -> DataFrame:
    """Labels of δ, ρ and, from the size of the forecaster, the complexity."""
    name, value = F.col("param"), F.col("value")
    metric = F.when(name == "delta", "treatment_interpretation").when(name == "rho", "spatial_interpretation")
    label = F.when(
        name == "delta",
        F.when(value < -EFFECT, NEGATIVE_EFFECT).when(value > EFFECT, POSITIVE_EFFECT).otherwise(WEAK_EFFECT),
    ).otherwise(F.when(F.abs(value) > SPILLOVER, STRONG_SPILLOVERS).otherwise(WEAK_SPILLOVERS))
    table = _labels("interpretability", params, metric, label)
    if num_cells is None:
        return table
    complexity = next(word for least, word in COMPLEXITY if num_cells > least)
    row = params.sparkSession.range(1)
    return table.unionByName(_labels("interpretability", row, F.lit("model_complexity"), F.lit(complexity)))


def report(*sections: DataFrame | None) -> DataFrame:
    """Union of the sections that exist."""
    given = [s for s in sections if s is not None]
    if not given:
        raise ValueError("a report needs at least one section")
    return reduce(lambda a, b: a.unionByName(b), given)


def seasonal_errors(history: DataFrame, seasonal_period: int = 1, freq: str = "D") -> DataFrame:
    """(region, seasonal_error): mean |y[t] − y[t−m]| over the history."""
    lagged = over_neighbourhood(
        history, ["region"], freq, seasonal_period, 0, lambda w: {"_before": F.lag("y", seasonal_period).over(w)}
    )
    return lagged.groupBy("region").agg(F.avg(F.abs(F.col("y") - F.col("_before"))).alias("seasonal_error"))


def item_metrics(
    forecasts: DataFrame,
    truth: DataFrame,
    history: DataFrame,
    quantiles: Sequence[float] = QUANTILES,
    seasonal_period: int = 1,
    freq: str = "D",
) -> DataFrame:
    """One row per region. Ratios with a zero denominator are NULL."""
    low, high = MSIS_ALPHA / 2, 1 - MSIS_ALPHA / 2
    cells = forecast_cells(forecasts, truth, [*quantiles, low, high])
    y, f = F.col("y"), F.col("median")
    error = F.abs(y - f)
    lower, upper = F.col(quantile_name(low)), F.col(quantile_name(high))
    outside = F.greatest(lower - y, F.lit(0.0)) + F.greatest(y - upper, F.lit(0.0))
    columns = [
        F.avg((y - F.col("mean")) * (y - F.col("mean"))).alias("MSE"),
        F.sum(error).alias("abs_error"),
        F.sum(F.abs(y)).alias("abs_target_sum"),
        F.avg(F.abs(y)).alias("abs_target_mean"),
        F.avg(ratio(error, F.abs(y))).alias("MAPE"),
        F.avg(ratio(2.0 * error, F.abs(y) + F.abs(f))).alias("sMAPE"),
        F.avg(error).alias("_mean_error"),
        F.avg(upper - lower + outside * (2.0 / MSIS_ALPHA)).alias("_interval"),
    ]
    for q in quantiles:
        at = F.col(quantile_name(q))
        under = F.when(y <= at, 1.0).otherwise(0.0)
        columns.append((2.0 * F.sum(F.abs((y - at) * (under - q)))).alias(f"QuantileLoss_{_tag(q)}"))
        columns.append(F.avg(under).alias(f"Coverage_{_tag(q)}"))
    scored = cells.groupBy("region").agg(*columns)
    joined = scored.join(seasonal_errors(history, seasonal_period, freq), "region", "left")
    kept = ["region", "MSE", "abs_error", "abs_target_sum", "abs_target_mean", "seasonal_error", "MAPE", "sMAPE"]
    return joined.select(
        *kept,
        ratio(F.col("_mean_error"), F.col("seasonal_error")).alias("MASE"),
        ratio(F.col("_interval"), F.col("seasonal_error")).alias("MSIS"),
        *(f"{kind}_{_tag(q)}" for q in quantiles for kind in ("QuantileLoss", "Coverage")),
    )


def _tag(q: float) -> str:
    return f"{q:.6g}".replace(".", "_")


def aggregate_metrics(items: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Metric rows over all regions: sums of losses, means of the rest, and their ratios."""
    summed = ["abs_error", "abs_target_sum", *(f"QuantileLoss_{_tag(q)}" for q in quantiles)]
    averaged = ["MSE", "abs_target_mean", "seasonal_error", "MASE", "MAPE", "sMAPE", "MSIS", *(f"Coverage_{_tag(q)}" for q in quantiles)]
    row = items.agg(*(F.sum(c).alias(c) for c in summed), *(F.avg(c).alias(c) for c in averaged))
    target = F.col("abs_target_sum")
    row = row.withColumns(
        {
            "RMSE": F.sqrt("MSE"),
            "NRMSE": ratio(F.sqrt("MSE"), F.col("abs_target_mean")),
            "ND": ratio(F.col("abs_error"), target),
            **{f"wQuantileLoss_{_tag(q)}": ratio(F.col(f"QuantileLoss_{_tag(q)}"), target) for q in quantiles},
        }
    )
    n = len(quantiles)
    row = row.withColumns(
        {
            "mean_absolute_QuantileLoss": reduce(lambda a, b: a + b, (F.col(f"QuantileLoss_{_tag(q)}") for q in quantiles)) / n,
            "mean_wQuantileLoss": reduce(lambda a, b: a + b, (F.col(f"wQuantileLoss_{_tag(q)}") for q in quantiles)) / n,
            "MAE_Coverage": reduce(lambda a, b: a + b, (F.abs(F.col(f"Coverage_{_tag(q)}") - q) for q in quantiles)) / n,
        }
    )
    return tidy(row, "aggregate_metrics")


def metric_family(table: DataFrame) -> DataFrame:
    """``family`` of each metric by its name: forecast, then causal, else spatial."""
    name = F.lower("metric")
    return table.withColumn(
        "family",
        F.when(name.rlike(FORECAST_NAMES), "forecast").when(name.rlike(CAUSAL_NAMES), "causal").otherwise("spatial"),
    )

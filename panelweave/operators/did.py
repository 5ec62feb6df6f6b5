"""Spatial difference-in-differences.

    y = ρ·Σ_j S(i,j)·y(j,t) + β0 + β1·treated + β2·post + δ·treated·post + γ'c + ε
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelweave.operators.lag import spatial_lag
from panelweave.operators.panel import design_rows
from panelweave.operators.regression import Fit, complete_rows, least_squares, with_fit
from panelweave.operators.spatial_models import maximum_likelihood, two_stage_lags
from panelweave.session import stage

#: Methods of ``fit_spatial_did``.
METHODS = ("2sls", "ols", "2sls_lags", "ml")

PARAMETER_SCHEMA = "param string, idx int, value double"

# What each estimated parameter is called and the regressor it belongs to.
PARAMETER_OF = {"treated": "beta_1", "post": "beta_2", "treated_post": "delta", "lag": "rho"}
COVARIATE_LABELS = ["reproduction_rate", "stringency_index", "vaccination_share", "icu_patients"]

# Wording of the insights.
STRONG_REDUCTION = "Strong negative effect - interventions effectively reduce cases"
INCREASE = "Positive effect - interventions may increase cases"
LIMITED = "Limited intervention effectiveness"
STRONG_SPATIAL = "Strong spatial correlation - neighboring regions significantly influence local outcomes"
WEAK_SPATIAL = "Weak spatial correlation - limited cross-regional influence"
COVARIATE_UP = "Positive effect - higher values increase cases"
COVARIATE_DOWN = "Negative effect - higher values decrease cases"


def regressors(df: DataFrame, covariates: Sequence[str], lag: str | None) -> list[str]:
    names = [c for c in ("treated", "post") if c in df.columns]
    if len(names) == 2:
        names.append("treated_post")
    return [*names, *covariates, *([lag] if lag else [])]


def fit_ols(panel: DataFrame, edges: DataFrame | None, covariates: Sequence[str] = ()) -> tuple[Fit, DataFrame]:
    """Fit and design rows. ``panel`` carries ``treated`` and ``post``; no edges: no lag term."""
    lagged = spatial_lag(panel, edges) if edges is not None else panel
    lag = "lag" if edges is not None else None
    rows = design_rows(lagged, covariates, lag)
    return least_squares(rows, "y", regressors(panel, covariates, lag)), rows


def fit_2sls(panel: DataFrame, edges: DataFrame, covariates: Sequence[str] = ()) -> tuple[Fit, DataFrame]:
    """Stage 1 projects the lag on [1, S(i,·)]; stage 2 uses the projection in place of the lag.

    Standard errors come from the residuals against the lag itself, as two stages need it. The
    lagged panel is written once, because both stages read it.
    """
    lagged = stage(spatial_lag(panel, edges))
    projected = lagged.withColumnRenamed("lag", "actual_lag").join(project_on_weights(lagged), "region")
    rows = design_rows(projected, [*covariates, "actual_lag"], "lag")
    fit = least_squares(rows, "y", regressors(panel, covariates, "lag"))
    if fit.std_errors and fit.sse > 0:
        named = complete_rows(rows, ["y", *fit.coefficients])
        against = F.col("y") - fit.predict() + F.lit(fit.coefficients["lag"]) * (F.col("lag") - F.col("actual_lag"))
        structural = named.agg(F.sum(against * against)).first()[0]
        grown = math.sqrt(structural / fit.sse)
        fit.std_errors = {c: e * grown for c, e in fit.std_errors.items()}
        fit.intercept_error *= grown
    return fit, rows.drop("actual_lag")


def project_on_weights(lagged: DataFrame) -> DataFrame:
    """(region, lag): least-squares projection of the lag on [1, S], the instruments of the first stage.

    Over the same dates for every region the mean lag is S times the mean values, which lies in the span
    of S whatever its rank, and nothing in that span varies over time: so the region mean is the
    projection. One aggregate per date checks that a lag is known for all regions or for none.
    """
    regions = lagged.select("region").distinct().count()
    known = lagged.where("lag IS NOT NULL").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    uneven = known.where(F.col("n") != regions).take(1)
    if uneven:
        raise ValueError(f"on {uneven[0]['t']} the lag is known for {uneven[0]['n']} of {regions} regions: repair the panel first")
    return lagged.groupBy("region").agg(F.avg("lag").alias("lag"))


def fit_spatial_did(
    panel: DataFrame, edges: DataFrame, covariates: Sequence[str] = (), method: str = "2sls"
) -> tuple[Fit, DataFrame]:
    """Fit and its design rows. Parameters follow column names, never positions.

    ``2sls`` takes the weights themselves as instruments, ``2sls_lags`` lagged covariates; ``ml`` is maximum likelihood.
    """
    if method == "2sls":
        return fit_2sls(panel, edges, covariates)
    if method == "ols":
        return fit_ols(panel, edges, covariates)
    if method in ("2sls_lags", "ml"):
        found = two_stage_lags if method == "2sls_lags" else maximum_likelihood
        return found(panel, edges, covariates, regressors(panel, covariates, None))
    raise ValueError(f"unsupported method {method!r}")


def parameters(spark: SparkSession, fit: Fit, covariates: Sequence[str] = ()) -> DataFrame:
    """Tidy table of the estimated parameters only."""
    rows = [("beta_0", 0, fit.intercept)]
    rows += [(name, 0, fit.coefficients[c]) for c, name in PARAMETER_OF.items() if c in fit.coefficients]
    rows += [("gamma", n, fit.coefficients[c]) for n, c in enumerate(covariates)]
    return spark.createDataFrame(rows, PARAMETER_SCHEMA)


def standard_errors(
    spark: SparkSession, fit: Fit, covariates: Sequence[str] = (), errors: Mapping[str, float | None] | None = None
) -> DataFrame:
    """Standard errors and t statistics of all parameters: classical ones (no row when the design is rank deficient), or ``errors`` by
    column name, as ``clustered_errors`` and ``near_errors`` give them."""
    if errors is None:
        errors = {"(intercept)": fit.intercept_error, **fit.std_errors} if fit.std_errors else {}
    named = [("beta_0", 0, "(intercept)"), *((PARAMETER_OF[c], 0, c) for c in PARAMETER_OF), *(("gamma", n, c) for n, c in enumerate(covariates))]
    values = {"(intercept)": fit.intercept, **fit.coefficients}
    rows = [(name, idx, errors[c], values[c] / errors[c] if errors[c] else None) for name, idx, c in named if c in errors]
    return spark.createDataFrame(rows, "param string, idx int, std_error double, t_stat double")


def parameter(params: DataFrame, name: str) -> float | None:
    row = params.where(F.col("param") == name).select("value").first()
    return None if row is None else row[0]


def causal_adjustment(panel: DataFrame, delta: float | None, column: str = "y", out: str = "y_adjusted") -> DataFrame:
    """Remove δ where treated and post; unchanged (with a warning) when δ was not estimated."""
    if delta is None:
        warnings.warn("treatment effect not estimated; data returned unchanged", stacklevel=2)
        return panel.withColumn(out, F.col(column))
    if not {"treated", "post"} <= set(panel.columns):
        return panel.withColumn(out, F.col(column))
    hit = (F.col("treated") == 1) & (F.col("post") == 1)
    return panel.withColumn(out, F.when(hit, F.col(column) - F.lit(delta)).otherwise(F.col(column)))


def spatial_adjustment(
    panel: DataFrame, edges: DataFrame, rho: float | None, column: str = "y_adjusted", out: str = "z"
) -> DataFrame:
    """z = y + ρ·S·y of the adjusted series; unchanged (with a warning) when ρ was not estimated."""
    if rho is None:
        warnings.warn("spatial coefficient not estimated; data returned unchanged", stacklevel=2)
        return panel.withColumn(out, F.col(column))
    lagged = spatial_lag(panel, edges, column, "_lag")
    return lagged.withColumn(out, F.col(column) + F.lit(rho) * F.col("_lag")).drop("_lag")


def interpretation(params: DataFrame) -> DataFrame:
    """(insight, meaning) for δ, ρ and the first four covariates."""
    value, idx = F.col("value"), F.col("idx")
    label = F.array(*map(F.lit, COVARIATE_LABELS))
    insight = (
        F.when(F.col("param") == "delta", "treatment_effect")
        .when(F.col("param") == "rho", "spatial_spillover")
        .when(
            (F.col("param") == "gamma") & (idx < len(COVARIATE_LABELS)), F.concat(F.try_element_at(label, idx + 1), F.lit("_effect"))
        )
    )
    meaning = (
        F.when(F.col("param") == "delta", F.when(value < -0.1, STRONG_REDUCTION).when(value > 0.1, INCREASE).otherwise(LIMITED))
        .when(F.col("param") == "rho", F.when(F.abs(value) > 0.3, STRONG_SPATIAL).otherwise(WEAK_SPATIAL))
        .when(value > 0, COVARIATE_UP)
        .otherwise(COVARIATE_DOWN)
    )
    return params.select(insight.alias("insight"), meaning.alias("meaning")).where("insight IS NOT NULL")


def fitted_cells(rows: DataFrame, fit: Fit) -> DataFrame:
    return with_fit(rows, fit).select("region", "t", "y", "fitted", "residual")

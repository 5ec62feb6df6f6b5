"""Global and windowed scaling of targets and covariates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelweave.functions.scalars import ratio, total
from panelweave.operators.ordered import BLOCK_STEPS, over_neighbourhood

METHODS = ("minmax", "standard")


def scaler_of(df: DataFrame, columns: Sequence[str], method: str) -> DataFrame:
    """One row (shift, spread) pooled over all values of ``columns``; scaled = (x − shift)/spread.

    A constant gets spread 1. Variance comes from per-column moments, combined around the
    pooled mean, so no column is stacked.
    """
    if method not in METHODS:
        raise ValueError(f"unsupported scaling {method!r}")
    if method == "minmax":
        ends = df.agg(
            *(F.min(c).alias(f"low{n}") for n, c in enumerate(columns)),
            *(F.max(c).alias(f"high{n}") for n, c in enumerate(columns)),
        )
        low = [F.col(f"low{n}") for n in range(len(columns))]
        high = [F.col(f"high{n}") for n in range(len(columns))]
        shift = F.least(*low) if len(columns) > 1 else low[0]
        top = F.greatest(*high) if len(columns) > 1 else high[0]
        return ends.select(shift.alias("shift"), (top - shift).alias("spread")).select("shift", _nonzero("spread"))
    moments = df.agg(
        *(F.count(c).alias(f"n{k}") for k, c in enumerate(columns)),
        *(F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)),
        *(F.var_pop(c).alias(f"v{k}") for k, c in enumerate(columns)),
    )
    parts = [(F.col(f"n{k}"), F.coalesce(f"m{k}", F.lit(0.0)), F.coalesce(f"v{k}", F.lit(0.0))) for k in range(len(columns))]
    n = total([p[0] for p in parts])
    mean = ratio(total([p[0] * p[1] for p in parts]), n)
    around = moments.withColumns({"_n": n, "shift": mean})
    spread = F.sqrt(ratio(total([p[0] * (p[2] + (p[1] - F.col("shift")) * (p[1] - F.col("shift"))) for p in parts]), F.col("_n")))
    return around.select("shift", spread.alias("spread")).select("shift", _nonzero("spread"))


def _nonzero(name: str):
    return F.when(F.col(name) == 0, 1.0).otherwise(F.col(name)).alias(name)


def apply_scaler(df: DataFrame, columns: Sequence[str], scaler: DataFrame) -> DataFrame:
    """The one-row scaler enters as scalar subqueries: no join, no driver round trip."""
    shift, spread = scaler.select("shift").scalar(), scaler.select("spread").scalar()
    return df.withColumns({c: (F.col(c) - shift) / spread for c in columns})


def invert_scaler(df: DataFrame, columns: Sequence[str], scaler: DataFrame | None) -> DataFrame:
    """Back to the original units; unscaled data pass through."""
    if scaler is None:
        return df
    shift, spread = scaler.select("shift").scalar(), scaler.select("spread").scalar()
    return df.withColumns({c: F.col(c) * spread + shift for c in columns})


def scale(
    df: DataFrame, method: str, covariates: Sequence[str] = (), pooled: bool = True, source: DataFrame | None = None
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Scaled panel and its scalers by name: ``y``, and ``covariates`` (one for all) or each name.

    ``none`` and unknown names change nothing and keep no scaler. The constants come from
    ``source`` when given: any table with the same values that is cheaper to read.
    """
    source = df if source is None else source
    if method not in METHODS:
        return df, {}
    scalers = {}
    groups = {"y": ["y"]}
    if covariates and pooled:
        groups["covariates"] = list(covariates)
    else:
        groups.update({c: [c] for c in covariates})
    scaled = df
    for name, columns in groups.items():
        scalers[name] = scaler_of(source, columns, method)
        scaled = apply_scaler(scaled, columns, scalers[name])
    return scaled, scalers


def window_mean_scale(
    df: DataFrame,
    context_length: int,
    column: str = "y",
    scaling: bool = True,
    freq: str = "D",
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """``scale`` of each row = mean |value| over the observed among the last ``context_length``
    rows, 1 where nothing was observed, the mean is zero, or scaling is off."""
    if not scaling:
        return df.withColumn("scale", F.lit(1.0))
    scaled = over_neighbourhood(
        df,
        ["region"],
        freq,
        context_length - 1,
        0,
        lambda w: {"scale": F.avg(F.abs(column)).over(w.rowsBetween(1 - context_length, 0))},
        block_steps,
    )
    return scaled.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))

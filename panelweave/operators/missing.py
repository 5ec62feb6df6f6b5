"""Repair of gaps in ordered series, per region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from panelweave.operators.ordered import BLOCK_STEPS, nearest_known, number_rows

KEYS = ("region", "t")


def numeric_columns(df: DataFrame, skip: Sequence[str] = KEYS) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def interpolate_linear(
    df: DataFrame, columns: Sequence[str] | None = None, freq: str = "D", block_steps: int = BLOCK_STEPS
) -> DataFrame:
    """Linear in row position, not in elapsed time. A leading gap stays NULL, a trailing gap
    repeats the last value."""
    columns = list(columns or numeric_columns(df))
    numbered = number_rows(df, ["region"], freq, "_pos", block_steps)
    known = nearest_known(numbered, ["region"], columns, freq, True, True, "_pos", block_steps)
    repaired = {}
    for c in columns:
        left, right = F.col("_prev_" + c), F.col("_next_" + c)
        share = (F.col("_pos") - left["pos"]) / (right["pos"] - left["pos"])
        repaired[c] = (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(right.isNotNull(), left["val"] + (right["val"] - left["val"]) * share)
            .otherwise(left["val"])
        )
    return known.withColumns(repaired).select(*df.columns)


def forward_fill(
    df: DataFrame, columns: Sequence[str] | None = None, freq: str = "D", block_steps: int = BLOCK_STEPS
) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    known = nearest_known(df, ["region"], columns, freq, block_steps=block_steps)
    return known.withColumns({c: F.col("_prev_" + c)["val"] for c in columns}).select(*df.columns)


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def zero_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(0, subset=list(columns or numeric_columns(df)))


def public_health_fill(df: DataFrame, covariates: Sequence[str], freq: str = "D") -> DataFrame:
    """Target gaps become 0; covariate gaps repeat the region's last value, else 0."""
    if covariates:
        df = forward_fill(df, covariates, freq)
    return zero_fill(df, ["y", *covariates])


def observed_mask(df: DataFrame) -> DataFrame:
    """Indicator of an observed target; the masked value itself becomes 0."""
    return df.withColumns(
        {"observed": F.col("y").isNotNull().cast("int"), "y": F.coalesce(F.col("y"), F.lit(0.0))}
    )


def repair(df: DataFrame, method: str = "interpolate", freq: str = "D") -> DataFrame:
    """``interpolate`` (its trailing fill makes a further forward fill a no-op), ``drop`` or
    ``fill``; any other name leaves the rows as they are."""
    if method == "interpolate":
        return interpolate_linear(df, freq=freq)
    if method == "drop":
        return drop_incomplete(df)
    if method == "fill":
        return zero_fill(df)
    return df

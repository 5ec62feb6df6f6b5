"""Training and prediction windows over ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelweave.functions.hashing import uniform
from panelweave.operators.ordered import BLOCK_STEPS, over_neighbourhood, tail


def _values(cells: Column, field: str) -> Column:
    return F.transform(cells, lambda c: c[field])


def _left_pad(values: Column, length: int, filler: Column) -> Column:
    return F.concat(F.array_repeat(filler, F.lit(length) - F.size(values)), values)


def training_windows(
    df: DataFrame,
    context_length: int,
    prediction_length: int,
    freq: str = "D",
    seed: int | None = None,
    block_steps: int = BLOCK_STEPS,
    covariates: Sequence[str] = (),
) -> DataFrame:
    """One row per cut point with a full future: ``forecast_start``, past (context + 1 values),
    future, their observed masks and ``is_pad`` for the left padding; ``past_<c>`` and ``future_<c>`` of each covariate.

    With a ``seed`` a cut point is kept with probability one over the number of eligible cuts of
    its series, by hash: one expected window per series, the same on every run.
    """
    past_length = context_length + 1

    def build(w):
        cell = F.struct("t", "y", *covariates)
        return {
            "_past": F.collect_list(cell).over(w.rowsBetween(-past_length, -1)),
            "_future": F.collect_list(cell).over(w.rowsBetween(0, prediction_length - 1)),
        }

    cut = over_neighbourhood(df, ["region"], freq, past_length, prediction_length, build, block_steps)
    cut = cut.where((F.size("_future") == prediction_length) & (F.size("_past") > 0))
    if seed is not None:
        eligible = cut.groupBy("region").agg(F.count(F.lit(1)).alias("_eligible"))
        cut = cut.join(eligible, "region").where(uniform(seed, "region", "t") * F.col("_eligible") < 1.0)
    return cut.select(F.col("region"), F.col("t").alias("forecast_start"), *_window_arrays(past_length, "_past", "_future", covariates))


def prediction_window(
    df: DataFrame,
    context_length: int,
    prediction_length: int,
    hold_out: bool = False,
    covariates: Sequence[str] = (),
    future: DataFrame | None = None,
) -> DataFrame:
    """The last context + 1 values of each series; with ``hold_out`` the cut lies
    ``prediction_length`` values before the end and the future is filled from there.

    Covariates add ``past_<c>`` and ``future_<c>``; without ``hold_out`` the latter are the next ``prediction_length`` rows of
    ``future`` (region, t, covariates), and a series that has fewer raises.
    """
    past_length = context_length + 1
    kept = past_length + (prediction_length if hold_out else 0)
    cell = F.array_sort(F.collect_list(F.struct("t", "y", *covariates)))
    rows = tail(df, ["region"], kept).groupBy("region").agg(cell.alias("_all"))
    ahead = prediction_length if hold_out else 0
    known = F.greatest(F.size("_all") - ahead, F.lit(0))
    cut = rows.withColumns(
        {
            "_past": F.slice("_all", F.lit(1), known),
            "_future": F.slice("_all", known + 1, F.lit(max(ahead, 1))) if ahead else F.slice("_all", 1, 0),
        }
    )
    last_known = F.try_element_at("_past", F.lit(-1))["t"]
    cut = cut.where(F.size("_past") > 0).withColumn("last_known", last_known)
    known_ahead = None
    if covariates and not hold_out:
        if future is None:
            raise ValueError(f"pass the future rows of {', '.join(covariates)}")
        later = future.join(cut.select("region", "last_known"), "region").where(F.col("t") > F.col("last_known"))
        place = F.row_number().over(Window.partitionBy("region").orderBy("t"))
        next_rows = later.withColumn("_place", place).where(F.col("_place") <= prediction_length)
        ahead = next_rows.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("t", *covariates))).alias("_ahead"))
        cut = cut.join(ahead, "region", "left")
        short = F.raise_error(F.concat(F.lit("too few future rows for region "), F.col("region").cast("string")))
        known_ahead = F.when(F.size("_ahead") == prediction_length, F.col("_ahead")).otherwise(short)
    return cut.select("region", "last_known", *_window_arrays(past_length, "_past", "_future", covariates, known_ahead))


def _window_arrays(past_length: int, past: str, future: str, covariates: Sequence[str] = (), ahead: Column | None = None) -> list[Column]:
    zero, none = F.lit(0.0), F.lit(0)
    def mask(c):
        return F.transform(F.col(c), lambda x: x["y"].isNotNull().cast("int"))

    def filled(c):
        return F.transform(F.col(c), lambda x: F.coalesce(x["y"], zero))

    def numbers(cells: Column, c: str) -> Column:
        return F.transform(cells, lambda x: F.coalesce(x[c].cast("double"), zero))

    pad = F.lit(past_length) - F.size(past)
    later = F.col(future) if ahead is None else ahead
    return [
        _left_pad(filled(past), past_length, zero).alias("past"),
        _left_pad(mask(past), past_length, none).alias("past_observed"),
        filled(future).alias("future"),
        mask(future).alias("future_observed"),
        F.concat(F.array_repeat(F.lit(1), pad), F.array_repeat(none, F.size(past))).alias("is_pad"),
        *(_left_pad(numbers(F.col(past), c), past_length, zero).alias(f"past_{c}") for c in covariates),
        *(numbers(later, c).alias(f"future_{c}") for c in covariates),
    ]


def aligned_training(windows: DataFrame, context_length: int, prediction_length: int) -> DataFrame:
    """Input = last context + horizon + 1 values without the final one; target = the last
    context + horizon values: each input value faces the value one step later."""
    length = context_length + prediction_length
    every, seen = F.concat("past", "future"), F.concat("past_observed", "future_observed")
    return windows.select(
        "region",
        "forecast_start",
        F.slice(every, -(length + 1), length).alias("inputs"),
        F.slice(seen, -(length + 1), length).alias("inputs_observed"),
        F.slice(every, -length, length).alias("targets"),
    )


def aligned_prediction(windows: DataFrame, context_length: int) -> DataFrame:
    """Encoder input = last context + 1 values without the final one, which starts the decoder."""
    return windows.select(
        "region",
        F.slice("past", -(context_length + 1), context_length).alias("inputs"),
        F.slice("past_observed", -(context_length + 1), context_length).alias("inputs_observed"),
        F.element_at("past", -1).alias("first_decoder_input"),
    )

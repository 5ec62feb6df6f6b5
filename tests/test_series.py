"""Gaps, order, windows and scaling of series."""

import datetime as dt

import pytest
from helpers import by_key, day, panel, same_rows, series
from pyspark.sql import Window, functions as F

from panelweave.operators import missing, panel as panels, scaling, windows
from panelweave.operators.ordered import number_rows, tail

N = None


def hourly(spark, hot_share=3):
    """One region holds a third of all rows or more, with gaps; steps of one hour."""
    rows = []
    for region, length in (("hot", 60 * hot_share), ("a", 40), ("b", 17), ("empty", 9)):
        for n in range(length):
            value = None if region == "empty" or n % 5 in (0, 3, 4) else float((n * 7) % 11)
            rows.append((region, dt.datetime(2024, 1, 1) + dt.timedelta(hours=n), value, float(n % 4)))
    return spark.createDataFrame(rows, "region string, t timestamp_ntz, y double, c1 double")


def test_interpolation_positions(spark):
    df = panel(spark, {"a": [N, 1, N, N, 4, N], "b": [N, N, N, N, N, N], "c": [5, N, 7, N, N, 1]})
    got = series(missing.interpolate_linear(df))
    assert got["a"] == [None, 1, 2, 3, 4, 4]
    assert got["b"] == [None] * 6
    assert got["c"] == [5, 6, 7, 5, 3, 1]


def test_interpolation_counts_rows_not_days(spark):
    df = panel(spark, {"a": [0, N, 4, 9]}).where(F.col("t") != F.lit(day(3)))
    late = panel(spark, {"a": [9]}, start=30)
    assert series(missing.interpolate_linear(df.unionByName(late)))["a"] == [0, 2, 4, 9]


def test_forward_fill_drop_zero_and_rule(spark):
    df = panel(spark, {"a": [(N, 1), (2, N), (N, 3)]}, ("y", "c1"))
    assert series(missing.forward_fill(df))["a"] == [None, 2, 2]
    assert missing.drop_incomplete(df).count() == 0
    assert series(missing.zero_fill(df))["a"] == [0, 2, 0]
    filled = missing.public_health_fill(df, ["c1"])
    assert series(filled)["a"] == [0, 2, 0] and series(filled, "c1")["a"] == [1, 1, 3]
    masked = missing.observed_mask(df)
    assert series(masked, "observed")["a"] == [0, 1, 0] and series(masked)["a"] == [0, 2, 0]
    assert same_rows(missing.repair(df, "unknown"), df)


@pytest.mark.parametrize("steps", [3, 8, 1000])
def test_results_do_not_depend_on_blocks(spark, steps):
    df = hourly(spark)
    plain = Window.partitionBy("region").orderBy("t")
    numbered = number_rows(df, ["region"], "h", block_steps=steps)
    assert same_rows(numbered, df.withColumn("rn", F.row_number().over(plain).cast("bigint")))
    filled = missing.forward_fill(df, freq="h", block_steps=steps)
    assert same_rows(filled, df.withColumns({c: F.last(c, True).over(plain) for c in ("y", "c1")}))
    reference = missing.interpolate_linear(df, freq="h", block_steps=10_000)
    assert same_rows(missing.interpolate_linear(df, freq="h", block_steps=steps), reference)
    mean = F.avg(F.abs("y")).over(plain.rowsBetween(-6, 0))
    expected = df.withColumn("scale", F.when(mean > 0, mean).otherwise(1.0))
    assert same_rows(scaling.window_mean_scale(df, 7, freq="h", block_steps=steps), expected)
    cuts = windows.training_windows(df, 4, 2, "h", block_steps=steps)
    assert same_rows(cuts, windows.training_windows(df, 4, 2, "h", block_steps=10_000))


def test_unknown_frequency(spark):
    with pytest.raises(ValueError):
        missing.forward_fill(panel(spark, {"a": [1]}), freq="fortnight")


def test_tail(spark):
    df = panel(spark, {"a": range(10), "b": [1, 2]})
    assert series(tail(df, ["region"], 3)) == {"a": [7, 8, 9], "b": [1, 2]}


def test_scaling_round_trip(spark):
    df = panel(spark, {"a": [(2, 1), (4, 5)], "b": [(6, N), (10, 3)]}, ("y", "c1"))
    for method in scaling.METHODS:
        for pooled in (True, False):
            scaled, scalers = scaling.scale(df, method, ["c1"], pooled)
            back = scaling.invert_scaler(scaled, ["y"], scalers["y"])
            back = scaling.invert_scaler(back, ["c1"], scalers["covariates" if pooled else "c1"])
            assert same_rows(back, df)
    assert series(scaling.scale(df, "minmax")[0]) == {"a": [0, 0.25], "b": [0.5, 1]}
    constant = panel(spark, {"a": [3, 3]})
    for method in scaling.METHODS:
        assert series(scaling.scale(constant, method)[0])["a"] == [0, 0]
    assert scaling.scale(df, "none") == (df, {})


def test_pooled_scaler_matches_stacked_values(spark):
    df = panel(spark, {"a": [(1, 10), (2, 20)], "b": [(3, 60), (N, 5)]}, ("y", "c1"))
    row = scaling.scaler_of(df, ["y", "c1"], "standard").first()
    values = [1, 2, 3, 10, 20, 60, 5]
    mean = sum(values) / len(values)
    spread = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
    assert row["shift"] == pytest.approx(mean) and row["spread"] == pytest.approx(spread)


@pytest.mark.parametrize("size,tests", [(0.2, 2), (0.25, 2), (0.0, 0), (0.99, 9)])
def test_split_lengths(spark, size, tests):
    df = panel(spark, {"a": range(10), "b": range(10)})
    train, test = panels.temporal_split(df, size)
    assert test.count() == 2 * tests and train.count() == 20 - 2 * tests
    if tests:
        assert train.agg(F.max("t")).first()[0] < test.agg(F.min("t")).first()[0]


def test_windows_shapes_and_padding(spark):
    df = panel(spark, {"a": [1, N, 3, 4, 5]})
    rows = by_key(windows.training_windows(df, 3, 2), "forecast_start")
    assert set(rows) == {(day(1),), (day(2),), (day(3),)}
    first = rows[(day(2),)]
    assert first["past"] == [0, 0, 1, 0] and first["past_observed"] == [0, 0, 1, 0] and first["is_pad"] == [1, 1, 0, 0]
    assert first["future"] == [3, 4]
    aligned = by_key(windows.aligned_training(windows.training_windows(df, 3, 2), 3, 2), "forecast_start")[(day(2),)]
    assert aligned["inputs"] == [0, 0, 1, 0, 3] and aligned["targets"] == [0, 1, 0, 3, 4]
    last = windows.prediction_window(df, 3, 2)
    assert last.first()["past"] == [0, 3, 4, 5] and last.first()["future"] == []
    held = windows.prediction_window(df, 3, 2, True).first()
    assert held["past"] == [0, 1, 0, 3] and held["future"] == [4, 5] and held["last_known"] == day(2)
    ready = windows.aligned_prediction(last, 3).first()
    assert ready["inputs"] == [0, 3, 4] and ready["first_decoder_input"] == 5


def test_sampled_windows_are_few_and_repeatable(spark):
    df = panel(spark, {f"r{n}": range(30) for n in range(60)})
    once = windows.training_windows(df, 3, 2, seed=5)
    again = windows.training_windows(df.repartition(7), 3, 2, seed=5)
    assert same_rows(once, again)
    assert 30 <= once.count() <= 95


def test_windows_with_covariates(spark):
    df = panel(spark, {"a": [(k, 10 * k) for k in range(1, 6)]}, ("y", "c1"))
    rows = by_key(windows.training_windows(df, 3, 2, covariates=["c1"]), "forecast_start")
    assert rows[(day(2),)]["past_c1"] == [0, 0, 10, 20] and rows[(day(2),)]["future_c1"] == [30, 40]
    ahead = panel(spark, {"a": [(0, 10 * k) for k in range(1, 9)], "b": [(0, 1)]}, ("y", "c1")).drop("y")
    last = windows.prediction_window(df, 3, 2, covariates=["c1"], future=ahead).first()
    assert last["past_c1"] == [20, 30, 40, 50] and last["future_c1"] == [60, 70] and last["future"] == []
    held = windows.prediction_window(df, 3, 2, True, covariates=["c1"]).first()
    assert held["past_c1"] == [0, 10, 20, 30] and held["future_c1"] == [40, 50]
    with pytest.raises(ValueError, match="c1"):
        windows.prediction_window(df, 3, 2, covariates=["c1"])
    with pytest.raises(Exception, match="too few future rows"):
        windows.prediction_window(df, 3, 4, covariates=["c1"], future=ahead).collect()

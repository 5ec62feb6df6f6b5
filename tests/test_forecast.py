"""Heads, the pooled autoregression, its paths and the scores."""

import datetime as dt
import itertools
import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from helpers import by_key, day, panel, same_rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panelweave.functions.hashing import normal, uniform
from panelweave.functions.heads import HEADS, Gaussian, Laplace, StudentT, head, student_quantile
from panelweave.operators import forecast, metrics, robust
from panelweave.operators.ordered import over_neighbourhood


def test_uniforms_and_normals(spark):
    draws = spark.range(20_000).select(uniform(7, "id", 1).alias("u"), uniform(7, "id", 2).alias("v"))
    row = draws.agg(F.avg("u"), F.stddev_pop("u"), F.min("u"), F.max("u"), F.corr("u", "v"), F.avg(normal(F.col("u"), F.col("v"))), F.stddev_pop(normal(F.col("u"), F.col("v")))).first()
    assert abs(row[0] - 0.5) < 0.01 and abs(row[1] - 12**-0.5) < 0.01 and 0 < row[2] and row[3] < 1
    assert abs(row[4]) < 0.02 and abs(row[5]) < 0.02 and abs(row[6] - 1) < 0.02
    assert spark.range(1).select(uniform(7, F.lit(1), F.lit(2))).first()[0] == pytest.approx((2308375421 + 0.5) / 2**32)


def test_registry():
    assert isinstance(head("gaussian"), Gaussian) and isinstance(head("laplace"), Laplace) and isinstance(head("student_t"), StudentT)
    with pytest.raises(ValueError):
        head("poisson")


def test_losses(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column).first()[0]

    y, m, s, k = 3.0, 1.0, 0.5, 2.0
    z = (y - m * k) / (s * k)
    assert value(Gaussian().nll(y, m, s, k)) == pytest.approx(0.5 * math.log(2 * math.pi) + math.log(s * k) + z * z / 2)
    assert value(Laplace().nll(y, m, s, k)) == pytest.approx(math.log(2 * s * k) + abs(z))
    nu = 4.0
    density = math.gamma(2.5) / math.gamma(2) / math.sqrt(nu * math.pi) / (s * k) * (1 + z * z / nu) ** -2.5
    assert value(StudentT(nu).nll(y, m, s, k)) == pytest.approx(-math.log(density))


@settings(max_examples=20, deadline=None)
@given(st.floats(0.001, 0.999))
def test_student_quantile(p):
    """Closed forms for one and two degrees of freedom, and the normal limit."""
    assert student_quantile(p, 1.0, 4000) == pytest.approx(math.tan(math.pi * (p - 0.5)), rel=1e-4, abs=1e-6)
    assert student_quantile(p, 2.0) == pytest.approx((2 * p - 1) / math.sqrt(2 * p * (1 - p)), rel=1e-5, abs=1e-6)


@pytest.mark.parametrize("name", HEADS)
def test_samples_follow_the_quantiles(spark, name):
    chosen = head(name)
    draws = spark.range(20_000).select(chosen.sample(uniform(3, "id", 1), uniform(3, "id", 2), 1.0, 2.0, 3.0).alias("x"))
    found = draws.select(F.percentile("x", F.array(*map(F.lit, (0.1, 0.5, 0.8))))).first()[0]
    expected = spark.range(1).select(*(chosen.quantile(p, 1.0, 2.0, 3.0) for p in (0.1, 0.5, 0.8))).first()
    np.testing.assert_allclose(found, list(expected), atol=0.25)


def autoregressive(spark, distribution, n=30, steps=120):
    """x[t] = 0.5 + 0.6·x[t−1] + noise, times a scale per region."""
    rng = np.random.default_rng(11)
    noise = {"gaussian": rng.normal(0, 0.3, (n, steps)), "laplace": rng.laplace(0, 0.3, (n, steps)), "student_t": 0.3 * rng.standard_t(3, (n, steps))}[distribution]
    x = np.ones((n, steps))
    for t in range(1, steps):
        x[:, t] = 0.5 + 0.6 * x[:, t - 1] + noise[:, t]
    return panel(spark, {i: list(x[i] * (1 + i)) for i in range(n)})


@pytest.mark.parametrize("distribution", HEADS)
def test_fit_recovers_the_model(spark, distribution):
    model = forecast.fit(autoregressive(spark, distribution), 60, distribution, lags=(1,))
    assert model.phi[0] == pytest.approx(0.6, abs=0.05)
    assert model.intercept == pytest.approx(0.5 / 1.25, abs=0.08)
    if distribution == "student_t":
        assert 2.3 < model.nu < 4.2


def test_student_fit_is_the_highest_likelihood_and_ignores_partitions(spark):
    df = autoregressive(spark, "student_t", 10, 60)
    model = forecast.fit(df, 60, "student_t", (1,))
    scales = forecast.region_scale(df, 60)

    def loss(**changed):
        return forecast.loss(df, replace(model, **changed), scales).first()["nll"]

    best = loss()
    for changed in ({"nu": model.nu * 1.05}, {"nu": model.nu / 1.05}, {"spread": model.spread * 1.02}, {"spread": model.spread / 1.02}):
        assert loss(**changed) > best
    for d in (0.01, -0.01):
        assert loss(intercept=model.intercept + d) > best and loss(phi=(model.phi[0] + d,)) > best
    other = forecast.fit(df.repartition(7, "t"), 60, "student_t", (1,))
    assert other.nu == pytest.approx(model.nu, rel=1e-6) and other.phi[0] == pytest.approx(model.phi[0], abs=1e-9)


def test_no_convergence_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(robust, "ROUNDS", 1)
    monkeypatch.setattr(robust, "MOST_ROWS", 10)
    monkeypatch.setattr(robust, "SAMPLE_ROWS", 40)
    for distribution in ("laplace", "student_t"):
        with pytest.raises(ValueError, match="did not converge"):
            forecast.fit(autoregressive(spark, distribution, 4, 30), 20, distribution, (1,))


def test_absolute_fit_reaches_the_least_absolute_deviation(spark):
    df = autoregressive(spark, "laplace", 8, 60)
    scales = forecast.region_scale(df, 60)
    rows = forecast.lag_rows(df, scales, (1, 2)).dropna().toPandas()
    x = np.column_stack([np.ones(len(rows)), rows["lag1"], rows["lag2"]])
    y, b = rows["x"].to_numpy(), np.zeros(3)
    for _ in range(3000):
        w = 1 / np.sqrt(np.maximum(np.abs(y - x @ b), 1e-9))
        b = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]
    best = np.abs(y - x @ b).mean()
    found = forecast.fit(df, 60, "laplace", (1, 2))
    assert found.spread <= best * (1 + 1e-9)
    assert forecast.fit(df.repartition(7, "t"), 60, "laplace", (1, 2)).spread == pytest.approx(found.spread, rel=1e-9)


def least_absolute(x, y):
    """Best of all fits through as many rows as there are coefficients."""
    found = []
    for some in itertools.combinations(range(len(y)), x.shape[1]):
        part = x[list(some)]
        if abs(np.linalg.det(part)) > 1e-9:
            found.append(np.abs(y - x @ np.linalg.solve(part, y[list(some)])).sum())
    return min(found)


@pytest.mark.parametrize("seed", range(6))
def test_exact_solution_of_few_rows(seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.ones(24), rng.normal(size=(24, 2))])
    y = x @ [1, 2, -1] + rng.standard_t(2, 24)
    if seed > 3:
        # ties, copies and rows without residual
        x[:, 1:], y = np.round(x[:, 1:]), np.round(y)
        x[5:9], y[5:9] = x[4], y[4]
    b = robust.solve_absolute(x, y, np.ones(24), np.zeros(3))
    assert np.abs(y - x @ b).sum() == pytest.approx(least_absolute(x, y), rel=1e-7)
    w = rng.integers(1, 4, 24)
    both = robust.solve_absolute(x, y, w.astype(float), np.zeros(3)), robust.solve_absolute(np.repeat(x, w, axis=0), np.repeat(y, w), np.ones(w.sum()), np.zeros(3))
    assert (w * np.abs(y - x @ both[0])).sum() == pytest.approx((w * np.abs(y - x @ both[1])).sum(), rel=1e-7)


def test_rows_of_certain_sign_are_left_out_without_change(spark, monkeypatch):
    df = autoregressive(spark, "laplace", 40, 120)
    whole = forecast.fit(df, 60, "laplace", (1, 2))
    monkeypatch.setattr(robust, "MOST_ROWS", 300)
    monkeypatch.setattr(robust, "SAMPLE_ROWS", 400)
    seen = []
    solve = robust.solve_absolute
    monkeypatch.setattr(robust, "solve_absolute", lambda x, y, w, g: (seen.append(len(y)), solve(x, y, w, g))[1])
    found = forecast.fit(df, 60, "laplace", (1, 2))
    assert max(seen) < 900 and len(seen) >= 3
    assert found.spread == pytest.approx(whole.spread, rel=1e-9)
    assert (found.intercept, *found.phi) == pytest.approx((whole.intercept, *whole.phi), abs=1e-6)


def test_student_slopes_and_curvature_are_those_of_the_likelihood(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame(pd.DataFrame({"x": rng.standard_t(3, 60), "a": rng.normal(size=60)}))
    at, centre = np.array([0.1, 0.3, math.log(0.8), math.log(4.0)]), np.array([0.05, 0.0])

    def value(p):
        return robust.student_sums(rows, ["a"], centre, p, False)[0]

    data = rows.toPandas()
    z = (data["x"] - 0.1 - 0.3 * (data["a"] - 0.05)) / 0.8
    plain = (math.lgamma(2.5) - math.lgamma(2.0) - 0.5 * math.log(4 * math.pi) - math.log(0.8) - 2.5 * np.log1p(z**2 / 4)).mean()
    base, slopes, curve = robust.student_sums(rows, ["a"], centre, at)
    assert base == pytest.approx(plain)
    for j, h in enumerate(1e-5 * np.eye(4)):
        assert slopes[j] == pytest.approx((value(at + h) - value(at - h)) / 2e-5, abs=1e-7)
        np.testing.assert_allclose(curve[j], (robust.student_sums(rows, ["a"], centre, at + h)[1] - robust.student_sums(rows, ["a"], centre, at - h)[1]) / 2e-5, atol=1e-6)


def test_student_fit_takes_few_passes(spark, monkeypatch):
    calls = []
    sums = robust.student_sums
    monkeypatch.setattr(robust, "student_sums", lambda *a: (calls.append(1), sums(*a))[1])
    forecast.fit(autoregressive(spark, "student_t", 20, 80), 60, "student_t", (1, 2))
    assert len(calls) <= 8
    calls.clear()
    assert forecast.fit(autoregressive(spark, "gaussian", 20, 80), 60, "student_t", (1,)).nu > 15
    assert len(calls) <= 12


def test_covariates_of_the_target_step(spark):
    rng = np.random.default_rng(2)
    values = {}
    for i in range(10):
        c, x = rng.normal(size=80), [1.0]
        for t in range(1, 80):
            x.append(1 + 0.4 * x[-1] + 0.7 * c[t] + 0.05 * rng.normal())
        values[i] = list(zip(x, c))
    df = panel(spark, values, ("y", "c1"))
    model = forecast.fit(df, 80, "gaussian", (1,), scaling=False, covariates=["c1"])
    assert model.phi[0] == pytest.approx(0.4, abs=0.02) and model.gamma[0] == pytest.approx(0.7, abs=0.02)
    scales = forecast.region_scale(df, 80, scaling=False)
    assert forecast.loss(df, model, scales).first()["n"] == 790
    with pytest.raises(ValueError, match="c1"):
        forecast.sample_paths(df, model, 80, 2)


def test_covariates_known_ahead_enter_each_step(spark):
    df = panel(spark, {"a": [(2, 0), (4, 0)], "b": [(6, 0), (2, 0)]}, ("y", "c1"))
    model = forecast.Autoregression("gaussian", (1,), 0.1, (0.5,), 0.0, covariates=("c1", "c2"), gamma=(2.0, -1.0))
    ahead = [("a", day(1), 9.0, 9.0), ("a", day(2), 1.0, 0.0), ("a", day(3), 0.0, 3.0), ("b", day(2), 0.5, 0.5), ("b", day(3), 2.0, 1.0), ("c", day(2), 7.0, 7.0)]
    schema = "region string, t date, c1 double, c2 double"
    paths = forecast.sample_paths(df, model, 2, 2, 3, future=spark.createDataFrame(ahead, schema))
    got = by_key(paths, "region", "sample_id", "step")
    assert len(got) == 2 * 3 * 2
    for region, scale, last, terms in (("a", 3, 4, (2.0, -3.0)), ("b", 4, 2, (0.5, 3.0))):
        x = last / scale
        for step, term in enumerate(terms, 1):
            x = 0.1 + 0.5 * x + term
            assert all(got[(region, s, step)]["value"] == pytest.approx(scale * x) for s in (1, 2, 3))
    for broken, message in ((ahead[:2] + ahead[3:], "a has no covariates for 2020-01-04"), ([(*ahead[1][:3], None), *ahead[2:]], "no covariates"), ([*ahead, ahead[2]], "several rows")):
        with pytest.raises(Exception, match=message):
            forecast.sample_paths(df, model, 2, 2, 3, future=spark.createDataFrame(broken, schema)).collect()


def test_hourly_paths_with_covariates(spark):
    start = dt.datetime(2020, 1, 1, 22)
    rows = [("a", start + dt.timedelta(hours=n), 1.0, float(n)) for n in range(6)]
    whole = spark.createDataFrame(rows, "region string, t timestamp_ntz, y double, c1 double")
    model = forecast.Autoregression("gaussian", (1,), 0.0, (0.0,), 0.0, covariates=("c1",), gamma=(1.0,))
    paths = forecast.sample_paths(whole.where("c1 < 3"), model, 3, 3, 1, freq="h", future=whole)
    assert [(r["step"], r["t"], r["value"]) for r in paths.orderBy("step").collect()] == [(k + 1, start + dt.timedelta(hours=3 + k), 3.0 + k) for k in range(3)]


def test_paths_unfold_the_recursion(spark):
    df = panel(spark, {"a": [2, 4, 2, 4], "b": [1, None, 3]})
    model = forecast.Autoregression("gaussian", (1, 2), 0.1, (0.5, 0.25), 0.0)
    got = by_key(forecast.sample_paths(df, model, 4, 3, 2), "region", "sample_id", "step")
    assert len(got) == 12
    x = [2 / 3, 4 / 3]
    for step in (1, 2, 3):
        x.append(0.1 + 0.5 * x[-1] + 0.25 * x[-2])
        row = got[("a", 2, step)]
        assert row["value"] == pytest.approx(3 * x[-1]) and row["t"] == day(3 + step)
    # the unobserved value counts as zero, the scale ignores it
    assert got[("b", 1, 1)]["value"] == pytest.approx(2 * (0.1 + 0.5 * 1.5 + 0.25 * 0))


def test_paths_do_not_depend_on_partitions(spark):
    df = autoregressive(spark, "laplace", 6, 30)
    model = forecast.fit(df, 20, "laplace", (1, 2))
    once = forecast.sample_paths(df.coalesce(1), model, 20, 4, 5, seed=9)
    assert same_rows(once, forecast.sample_paths(df.repartition(13), model, 20, 4, 5, seed=9))
    floor = forecast.sample_paths(df, model, 20, 4, 5, seed=9, non_negative=True)
    assert floor.where("value < 0").count() == 0


@pytest.mark.parametrize("freq,expected", [("D", dt.date(2020, 2, 2)), ("W", dt.date(2020, 2, 14)), ("M", dt.date(2020, 3, 31)), ("Q", dt.date(2020, 7, 31)), ("Y", dt.date(2022, 1, 31))])
def test_advance(spark, freq, expected):
    df = spark.range(1).select(F.lit("2020-01-31").cast("date").alias("t"))
    assert df.select(forecast.advance(F.col("t"), F.lit(2), freq)).first()[0] == expected


def test_advance_hours(spark):
    df = spark.range(1).select(F.lit("2020-01-31 23:00:00").cast("timestamp_ntz").alias("t"))
    assert df.select(forecast.advance(F.col("t"), F.lit(2), "h")).first()[0] == dt.datetime(2020, 2, 1, 1)


def mock(spark, samples: np.ndarray, truth: np.ndarray, history=None):
    n, s, h = samples.shape
    rows = [(i, day(100 + t), t + 1, k, float(samples[i, k, t])) for i in range(n) for k in range(s) for t in range(h)]
    forecasts = spark.createDataFrame(rows, "region bigint, t date, step int, sample_id int, value double")
    return forecasts, panel(spark, {i: list(truth[i]) for i in range(n)}, start=100)


def test_summary_and_fan(spark):
    samples = np.random.default_rng(3).normal(size=(2, 25, 4))
    forecasts, truth = mock(spark, samples, np.zeros((2, 4)))
    got = by_key(forecast.forecast_summary(forecasts), "region", "step")
    cell = samples[1, :, 2]
    expected = [cell.mean(), np.median(cell), cell.std(), np.quantile(cell, 0.1), np.quantile(cell, 0.9), 25]
    row = got[(1, 3)]
    np.testing.assert_allclose([row[c] for c in ("mean", "median", "std", "quantile_10", "quantile_90", "num_samples")], expected)
    history = panel(spark, {0: range(100), 1: range(100)})
    fan = by_key(forecast.fan_table(forecasts, history, 7, truth=truth), "region", "t", "series")
    assert len(fan) == 2 * (7 + 4 * 5 + 4)
    assert fan[(1, day(102), "upper_90")]["value"] == pytest.approx(np.quantile(cell, 0.95))
    assert fan[(0, day(99), "history")]["value"] == 99


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(4)
    samples, truth = rng.normal(size=(3, 100, 10)), rng.normal(size=(3, 10)) + 3
    forecasts, actual = mock(spark, samples, truth)
    got = {r["metric"]: r["value"] for r in metrics.forecast_metrics(forecasts, actual).collect()}
    mean, median, std = samples.mean(1), np.median(samples, 1), samples.std(1)
    expected = {
        "mse": ((mean - truth) ** 2).mean(),
        "mae": np.abs(mean - truth).mean(),
        "rmse": ((mean - truth) ** 2).mean() ** 0.5,
        "mape": np.abs((truth - mean) / truth).mean() * 100,
        "median_mse": ((median - truth) ** 2).mean(),
        "median_mae": np.abs(median - truth).mean(),
        "mean_std": std.mean(),
        "std_std": std.std(),
    }
    for q in (0.1, 0.9):
        low, high = np.quantile(samples, (1 - q) / 2, axis=1), np.quantile(samples, (1 + q) / 2, axis=1)
        expected[f"coverage_{int(q * 100)}"] = ((truth >= low) & (truth <= high)).mean()
    assert got == pytest.approx(expected)


def test_zero_truth(spark):
    samples = np.ones((1, 3, 2))
    forecasts, truth = mock(spark, samples, np.array([[0.0, 2.0]]))
    cells = metrics.forecast_cells(forecasts, truth)
    assert metrics.point_metrics(cells).first()["mape"] == math.inf
    assert metrics.point_metrics(cells, "skip").first()["mape"] == pytest.approx(50)
    still, truth = mock(spark, samples * 0, np.array([[0.0, 2.0]]))
    assert math.isnan(metrics.point_metrics(metrics.forecast_cells(still, truth)).first()["mape"])


def test_spatial_metrics(spark):
    rng = np.random.default_rng(8)
    samples, truth = rng.normal(size=(4, 20, 5)), rng.normal(size=(4, 5))
    s = rng.random((4, 4))
    np.fill_diagonal(s, 0)
    forecasts, actual = mock(spark, samples, truth)
    edges = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(4) for j in range(4) if i != j], "i bigint, j bigint, w double")
    got = {r["metric"]: r["value"] for r in metrics.spatial_metrics(forecasts, actual, edges).collect()}
    mean = samples.mean(1)

    def corr(x):
        return np.corrcoef(x.ravel(), (s @ x).ravel())[0, 1]

    assert got == pytest.approx(
        {"spatial_error_correlation": corr(mean - truth), "forecast_spatial_autocorr": corr(mean), "true_spatial_autocorr": corr(truth)}
    )


def test_item_and_aggregate_metrics(spark):
    rng = np.random.default_rng(9)
    samples, truth = rng.normal(size=(3, 40, 6)) + 5, rng.normal(size=(3, 6)) + 5
    forecasts, actual = mock(spark, samples, truth)
    past = rng.normal(size=(3, 30)) + 5
    history = panel(spark, {i: list(past[i]) for i in range(3)})
    items = metrics.item_metrics(forecasts, actual, history, seasonal_period=7)
    got = by_key(items, "region")
    median = np.median(samples, 1)
    for i in range(3):
        e, seasonal = np.abs(truth[i] - median[i]), np.abs(past[i, 7:] - past[i, :-7]).mean()
        low, high = np.quantile(samples[i], [0.025, 0.975], axis=0)
        q = np.quantile(samples[i], 0.9, axis=0)
        width = (high - low + 40 * np.maximum(low - truth[i], 0) + 40 * np.maximum(truth[i] - high, 0)).mean()
        row = got[(i,)]
        assert row["seasonal_error"] == pytest.approx(seasonal) and row["MASE"] == pytest.approx(e.mean() / seasonal)
        assert row["MSIS"] == pytest.approx(width / seasonal)
        assert row["QuantileLoss_0_9"] == pytest.approx(2 * np.abs((truth[i] - q) * ((truth[i] <= q) - 0.9)).sum())
        assert row["Coverage_0_9"] == pytest.approx((truth[i] <= q).mean())
        assert row["sMAPE"] == pytest.approx((2 * e / (truth[i] + median[i])).mean())
    table = {r["metric"]: r["value"] for r in metrics.aggregate_metrics(items).collect()}
    assert table["RMSE"] == pytest.approx(((samples.mean(1) - truth) ** 2).mean() ** 0.5)
    assert table["ND"] == pytest.approx(np.abs(truth - median).sum() / truth.sum())
    families = {r["metric"]: r["family"] for r in metrics.metric_family(metrics.aggregate_metrics(items)).collect()}
    assert families["RMSE"] == "forecast" and families["MASE"] == "spatial"


def params(spark, **values):
    rows = [(k, n, float(v)) for k, vs in values.items() for n, v in enumerate(vs if isinstance(vs, list) else [vs])]
    return spark.createDataFrame(rows, "param string, idx int, value double")


def test_causal_evaluation_and_labels(spark):
    estimated = params(spark, delta=-0.15, rho=0.4, gamma=[0.5, -0.3, 0.2])
    table = by_key(metrics.causal_evaluation(estimated, params(spark, delta=-0.1, rho=0.1, gamma=[0.5, -0.2, 0.4])), "metric")
    assert table[("treatment_significance",)]["label"] == "Significant"
    assert table[("spatial_significance",)]["label"] == "Strong spatial correlation"
    assert table[("delta_error",)]["value"] == pytest.approx(0.05) and table[("rho_error",)]["value"] == pytest.approx(0.3)
    assert table[("gamma_mse",)]["value"] == pytest.approx(0.05 / 3) and table[("gamma_mae",)]["value"] == pytest.approx(0.1)
    assert metrics.causal_evaluation(params(spark, rho=0.1)).count() == 1
    with pytest.raises(Exception, match="gamma differ in length"):
        metrics.causal_evaluation(estimated, params(spark, delta=-0.1, rho=0.1, gamma=[0.5, -0.2])).collect()
    for cells, word in ((101, "High"), (64, "Medium"), (50, "Low")):
        shown = by_key(metrics.interpretability(params(spark, delta=0.2, rho=0.5), cells), "metric")
        assert shown[("model_complexity",)]["label"] == word
        assert shown[("treatment_interpretation",)]["label"] == "Strong positive effect"
    with pytest.raises(ValueError):
        metrics.report(None)


def test_members_of_an_ensemble_look_back(spark):
    df = panel(spark, {"a": range(10)})
    lagged = over_neighbourhood(df, ["region"], "D", 3, 0, lambda w: {"before": F.lag("y", 3).over(w)})
    assert by_key(lagged, "t")[(day(9),)]["before"] == 6

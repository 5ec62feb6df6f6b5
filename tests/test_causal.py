"""Least squares and difference-in-differences against dense algebra."""

import numpy as np
import pytest
from helpers import by_key, day, panel, series
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panelweave import SpatialDiD
from panelweave.operators import did, panel as panels, regression, sandwich, spatial_models
from panelweave.operators.lag import spatial_lags
from panelweave.plans.catalogue import QUERIES

RHO, DELTA, GAMMA = 0.4, -1.5, 0.8


def world(spark, n=12, steps=40, noise=0.01, seed=3, gamma=GAMMA):
    """A panel that obeys the model exactly up to noise, with its ring weights."""
    rng = np.random.default_rng(seed)
    s = np.zeros((n, n))
    for i in range(n):
        s[i, (i + 1) % n] = 0.7
        s[i, (i + 5) % n] = 0.3
    treated, post = (np.arange(n) % 3 == 0).astype(float), (np.arange(steps) >= steps // 2).astype(float)
    c = rng.normal(size=(n, steps))
    right = 2 + 0.5 * treated[:, None] + 0.25 * post + DELTA * np.outer(treated, post) + gamma * c + noise * rng.normal(size=(n, steps))
    y = np.linalg.solve(np.eye(n) - RHO * s, right)
    df = panel(spark, {i: list(zip(y[i], c[i])) for i in range(n)}, ("y", "c1"))
    edges = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(n) for j in range(n) if s[i, j]], "i bigint, j bigint, w double")
    dimension = spark.createDataFrame([(i, int(treated[i])) for i in range(n)], "region bigint, treated int")
    return df, edges, dimension, (s, treated, post, c, y)


def rows_of(df, dimension, steps=40):
    return panels.with_post(panels.attach_regions(df, dimension), str(day(steps // 2)))


def dense_design(treated, post, c, extra):
    n, steps = c.shape
    columns = [np.ones((n, steps)), np.repeat(treated[:, None], steps, 1), np.tile(post, (n, 1)), np.outer(treated, post), c, extra]
    return np.column_stack([x.reshape(-1) for x in columns])


def test_ols_matches_dense_least_squares(spark):
    df, edges, dimension, (s, treated, post, c, y) = world(spark)
    fit, rows = did.fit_ols(rows_of(df, dimension), edges, ["c1"])
    b = np.linalg.lstsq(dense_design(treated, post, c, s @ y), y.reshape(-1), rcond=None)[0]
    got = [fit.intercept, *(fit.coefficients[k] for k in ("treated", "post", "treated_post", "c1", "lag"))]
    np.testing.assert_allclose(got, b, atol=1e-8)
    assert fit.coefficients["treated_post"] == pytest.approx(DELTA, abs=0.05)
    assert fit.coefficients["c1"] == pytest.approx(GAMMA, abs=0.01)
    assert regression.r_squared(did.fitted_cells(rows, fit)).first()[0] == pytest.approx(fit.r_squared, abs=1e-9)


@pytest.mark.parametrize("deficient", [False, True])
def test_2sls_matches_dense_projection(spark, deficient):
    df, edges, dimension, (s, treated, post, c, y) = world(spark)
    if deficient:
        edges = edges.where("i < 4")
        s = s * (np.arange(len(s)) < 4)[:, None]
    fit, _ = did.fit_2sls(rows_of(df, dimension), edges, ["c1"])
    n, steps = y.shape
    lag = (s @ y).reshape(-1)
    z = np.repeat(np.column_stack([np.ones(n), s]), steps, axis=0)
    projected = z @ np.linalg.lstsq(z, lag, rcond=None)[0]
    b = np.linalg.lstsq(dense_design(treated, post, c, projected.reshape(n, steps)), y.reshape(-1), rcond=None)[0]
    got = [fit.intercept, *(fit.coefficients[k] for k in ("treated", "post", "treated_post", "c1", "lag"))]
    np.testing.assert_allclose(got, b, atol=1e-6)


@pytest.mark.parametrize("deficient", [False, True])
def test_projection_is_the_region_mean(spark, deficient):
    df, edges, _, (s, *_rest, y) = world(spark, n=6, steps=8)
    if deficient:
        edges = edges.where("i < 3")
        s = s * (np.arange(len(s)) < 3)[:, None]
    z = np.repeat(np.column_stack([np.ones(6), s]), 8, axis=0)
    dense = (z @ np.linalg.lstsq(z, (s @ y).reshape(-1), rcond=None)[0]).reshape(6, 8)[:, 0]
    found = by_key(did.project_on_weights(did.spatial_lag(df, edges)), "region")
    np.testing.assert_allclose([found[(i,)]["lag"] for i in range(6)], dense, atol=1e-9)


def test_a_partly_unknown_date_is_an_error(spark):
    df, edges, dimension, _ = world(spark, n=6, steps=8)
    gap = df.withColumn("y", F.when((F.col("region") != 2) | (F.col("t") != F.lit(day(3))), F.col("y")))
    with pytest.raises(ValueError, match="repair the panel"):
        did.fit_2sls(rows_of(gap, dimension, 8), edges)
    nothing = df.withColumn("y", F.when(F.col("t") != F.lit(day(3)), F.col("y")))
    did.fit_2sls(rows_of(nothing, dimension, 8), edges)


def test_2sls_standard_errors_use_the_actual_lag(spark):
    df, edges, dimension, (s, treated, post, c, y) = world(spark, noise=0.3)
    fit, _ = did.fit_2sls(rows_of(df, dimension), edges, ["c1"])
    actual = s @ y
    projected = np.repeat(actual.mean(axis=1)[:, None], y.shape[1], 1)
    x = dense_design(treated, post, c, projected)
    b = np.linalg.lstsq(x, y.reshape(-1), rcond=None)[0]
    e = y.reshape(-1) - dense_design(treated, post, c, actual) @ b
    errors = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / (len(e) - 6))
    names = ("treated", "post", "treated_post", "c1", "lag")
    np.testing.assert_allclose([fit.std_errors[k] for k in names], errors[1:], rtol=1e-6)


def test_unknown_keys_are_errors_and_no_row_is_lost(spark):
    df, edges, dimension, _ = world(spark, n=6, steps=8)
    model = SpatialDiD(edges, dimension.where("region < 5"), str(day(4)))
    with pytest.raises(Exception, match="absent from the region dimension"):
        model.with_indicators(df).collect()
    calendar = df.select("t").distinct().where(F.col("t") < F.lit(day(6))).withColumn("post", F.lit(1))
    with pytest.raises(Exception, match="absent from the calendar"):
        panels.attach_calendar(df, calendar).collect()
    assert panels.attach_calendar(df, calendar).select("region", "t").count() == df.count()


def test_collinear_designs_have_the_shortest_answer(spark):
    df, edges, dimension, (s, treated, post, c, y) = world(spark)
    everyone = dimension.withColumn("treated", F.lit(1))
    fit, _ = did.fit_ols(rows_of(df, everyone), edges, ["c1"])
    x = dense_design(np.ones(len(s)), post, c, s @ y)[:, 1:]
    centred = x - x.mean(0)
    b = np.linalg.lstsq(centred, y.reshape(-1) - y.mean(), rcond=1e-10)[0]
    got = [fit.coefficients[k] for k in ("treated", "post", "treated_post", "c1", "lag")]
    np.testing.assert_allclose(got, b, atol=1e-7)
    assert not fit.std_errors


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6), st.booleans())
def test_minimum_norm(seed, k, deficient):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, k)) * 10.0 ** rng.integers(-3, 4, k)
    if deficient and k > 1:
        x[:, -1] = 2 * x[:, 0]
    x -= x.mean(0)
    target = rng.normal(size=40)
    beta, _, rank = regression.minimum_norm(x.T @ x, x.T @ target)
    assert rank == (k - 1 if deficient and k > 1 else k)
    expected = np.linalg.pinv(x, rcond=1e-12) @ target
    np.testing.assert_allclose(x @ beta, x @ expected, atol=1e-6)
    np.testing.assert_allclose(beta, expected, rtol=1e-4, atol=1e-7 * max(1, np.abs(expected).max()))


def test_large_offsets_keep_their_digits(spark):
    rng = np.random.default_rng(5)
    x, e = rng.normal(size=500), rng.normal(size=500)
    rows = [(float(a + 1e7), float(3 * a + b + 1e8)) for a, b in zip(x, e)]
    fit = regression.least_squares(spark.createDataFrame(rows, "x double, y double"), "y", ["x"])
    assert fit.coefficients["x"] == pytest.approx(np.polyfit(x, 3 * x + e, 1)[0], abs=1e-7)


def test_standard_errors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=200)
    fit = regression.least_squares(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double"), "y", ["a", "b"])
    full = np.column_stack([np.ones(200), x])
    residual = y - full @ np.linalg.lstsq(full, y, rcond=None)[0]
    expected = np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * (residual @ residual) / 197)[1:]
    np.testing.assert_allclose([fit.std_errors["a"], fit.std_errors["b"]], expected, rtol=1e-8)


def test_missing_rows_are_left_out(spark):
    df, edges, dimension, _ = world(spark)
    holes = df.withColumn("y", F.when(F.col("t") != F.lit(day(5)), F.col("y")))
    fit, _ = did.fit_ols(rows_of(holes, dimension), edges, ["c1"])
    assert fit.n == 12 * 39 and fit.coefficients["c1"] == pytest.approx(GAMMA, abs=0.01)


def test_class_adjusts_and_explains(spark):
    df, edges, dimension, (s, treated, post, c, y) = world(spark)
    model = SpatialDiD(edges, dimension, str(day(20)), ["c1"], "ols").fit(df)
    assert model.delta == pytest.approx(DELTA, abs=0.05)
    got = by_key(model.adjust(df), "region", "t")
    hit = got[(0, day(30))]
    assert hit["y"] - hit["y_adjusted"] == pytest.approx(model.delta)
    free = got[(1, day(30))]
    assert free["y_adjusted"] == free["y"]
    adjusted = y - model.delta * np.outer(treated, post)
    assert hit["z"] == pytest.approx((adjusted + model.rho * s @ adjusted)[0, 30])
    told = {r["insight"]: r["meaning"] for r in model.interpretation().collect()}
    assert told["treatment_effect"].startswith("Strong negative") and told["reproduction_rate_effect"].startswith("Positive")
    assert {r["param"] for r in model.parameters.collect()} == {"beta_0", "beta_1", "beta_2", "delta", "rho", "gamma"}
    calendar = panels.with_post(panels.calendar_of(df), str(day(20)))
    same = SpatialDiD(edges, dimension, calendar, ["c1"], "ols").fit(df)
    assert same.delta == pytest.approx(model.delta) and same.r_squared().first()[0] == pytest.approx(model.result.r_squared)


def test_without_indicators(spark):
    df, edges, _, _ = world(spark)
    model = SpatialDiD(edges, method="ols").fit(df)
    assert {r["param"] for r in model.parameters.collect()} == {"beta_0", "rho"}
    with pytest.warns(UserWarning, match="treatment effect not estimated"):
        assert series(model.adjust(df), "y_adjusted") == series(df)
    with pytest.warns(UserWarning, match="spatial coefficient not estimated"):
        did.spatial_adjustment(df, edges, None, "y")
    with pytest.raises(ValueError, match="unsupported method"):
        did.fit_spatial_did(df, edges, method="ml")


def test_known_values_of_the_nation_panel(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    ols = {r["param"]: r["value"] for r in QUERIES["did_spatial_ols"](spark, folder).collect()}
    two = {r["param"]: r["value"] for r in QUERIES["did_spatial_2sls"](spark, folder).collect()}
    assert ols["rho"] == pytest.approx(0.211688480260, abs=1e-6) and ols["delta"] == pytest.approx(-0.017080082928, abs=1e-6)
    assert two["rho"] == pytest.approx(-2.948329765592, abs=1e-6) and two["delta"] == pytest.approx(-0.021666666667, abs=1e-6)


def dense_sandwich(x, e, together):
    scores = x * e[:, None]
    a = np.linalg.inv(x.T @ x)
    return np.sqrt(np.diag(a @ scores.T @ together @ scores @ a))


def test_near_errors_take_a_pair_of_regions_once(spark, monkeypatch):
    """Both ways of an edge give the same products: one of them travels, with both weights, whether they are equal or not."""
    df, edges, dimension, (s, treated, post, c, y) = world(spark, noise=0.5)
    fit, rows = did.fit_ols(rows_of(df, dimension), edges, ["c1"])
    x = dense_design(treated, post, c, s @ y)
    e = y.reshape(-1) - x @ np.linalg.lstsq(x, y.reshape(-1), rcond=None)[0]
    n, steps = c.shape
    own, date = np.repeat(np.arange(n), steps), np.tile(np.arange(steps), n)
    near = [(i, j, 0.2 if i < j else 0.4) for i in range(n) for j in range(n) if abs(i - j) == 1] + [(0, 0, 0.5), (None, 1, 9.0)]
    taken = []

    def lags(cells, edges, columns):
        taken.extend((r["i"], r["j"], r["w"]) for r in edges.collect())
        return spatial_lags(cells, edges, columns)

    monkeypatch.setattr(sandwich, "spatial_lags", lags)
    got = sandwich.near_errors(rows, fit, spark.createDataFrame(near, "i bigint, j bigint, w double"))
    assert sorted((i, j, round(w, 9)) for i, j, w in taken) == [(0, 0, 0.5), *((i, i + 1, 0.6) for i in range(n - 1))]
    kernel = np.eye(n)
    for i, j, w in near[:-1]:
        kernel[i, j] += w
    kernel = (kernel + kernel.T) / 2
    expected = dense_sandwich(x, e, kernel[own][:, own] * (date[:, None] == date))
    np.testing.assert_allclose([got[k] for k in ("(intercept)", "treated", "post", "treated_post", "c1", "lag")], expected, rtol=1e-7)


def test_clustered_and_near_errors_match_dense_sandwiches(spark):
    df, edges, dimension, (s, treated, post, c, y) = world(spark, noise=0.5)
    fit, rows = did.fit_ols(rows_of(df, dimension), edges, ["c1"])
    x = dense_design(treated, post, c, s @ y)
    e = y.reshape(-1) - x @ np.linalg.lstsq(x, y.reshape(-1), rcond=None)[0]
    n, steps = c.shape
    own, date = np.repeat(np.arange(n), steps), np.tile(np.arange(steps), n)
    names = ["(intercept)", "treated", "post", "treated_post", "c1", "lag"]
    factor = np.sqrt(n / (n - 1) * (n * steps - 1) / (n * steps - 6))
    got = sandwich.clustered_errors(rows, fit)
    np.testing.assert_allclose([got[k] for k in names], factor * dense_sandwich(x, e, (own[:, None] == own) * 1.0), rtol=1e-7)
    near = [(i, j, 0.5) for i in range(n) for j in range(n) if abs(i - j) == 1]
    kernel = np.eye(n)
    for i, j, w in near:
        kernel[i, j] = w
    got = sandwich.near_errors(rows, fit, spark.createDataFrame(near, "i bigint, j bigint, w double"))
    np.testing.assert_allclose([got[k] for k in names], dense_sandwich(x, e, kernel[own][:, own] * (date[:, None] == date)), rtol=1e-7)
    alone = sandwich.near_errors(rows, fit, spark.createDataFrame([], "i bigint, j bigint, w double"))
    np.testing.assert_allclose([alone[k] for k in names], dense_sandwich(x, e, np.eye(len(e))), rtol=1e-7)
    table = by_key(did.standard_errors(spark, fit, ["c1"], got), "param")
    assert set(table) == {(p,) for p in ("beta_0", "beta_1", "beta_2", "delta", "rho", "gamma")}
    assert table[("delta",)]["t_stat"] == pytest.approx(fit.coefficients["treated_post"] / got["treated_post"])
    with pytest.raises(ValueError, match="two clusters"):
        sandwich.clustered_errors(rows.where("region = 0"), regression.least_squares(rows.where("region = 0"), "y", ["c1", "lag"]))


def test_classical_error_of_the_intercept(spark):
    df, edges, dimension, (s, treated, post, c, y) = world(spark, noise=0.5)
    fit, _ = did.fit_ols(rows_of(df, dimension), edges, ["c1"])
    x = dense_design(treated, post, c, s @ y)
    e = y.reshape(-1) - x @ np.linalg.lstsq(x, y.reshape(-1), rcond=None)[0]
    assert fit.intercept_error == pytest.approx(np.sqrt(np.linalg.inv(x.T @ x)[0, 0] * (e @ e) / (len(e) - 6)))


def test_lagged_covariates_as_instruments(spark):
    df, edges, dimension, (s, treated, post, c, y) = world(spark, noise=0.3)
    fit, rows = did.fit_spatial_did(rows_of(df, dimension), edges, ["c1"], "2sls_lags")
    x = dense_design(treated, post, c, s @ y)
    h = np.column_stack([x[:, :5], (s @ c).reshape(-1), (s @ s @ c).reshape(-1)])
    projected = h @ np.linalg.lstsq(h, x, rcond=None)[0]
    b = np.linalg.solve(projected.T @ x, projected.T @ y.reshape(-1))
    names = ("treated", "post", "treated_post", "c1", "lag")
    np.testing.assert_allclose([fit.intercept, *(fit.coefficients[k] for k in names)], b, atol=1e-7)
    assert fit.coefficients["lag"] == pytest.approx(RHO, abs=0.1)
    e = y.reshape(-1) - x @ b
    expected = np.sqrt(np.diag(np.linalg.inv(projected.T @ projected)) * (e @ e) / (len(e) - 6))
    np.testing.assert_allclose([fit.intercept_error, *(fit.std_errors[k] for k in names)], expected, rtol=1e-6)
    assert did.fitted_cells(rows, fit).count() == 480
    with pytest.raises(ValueError, match="at least one"):
        did.fit_spatial_did(rows_of(df, dimension), edges, [], "2sls_lags")
    with pytest.raises(ValueError, match="identify"):
        did.fit_spatial_did(rows_of(df, dimension), edges.where("i < 0"), ["c1"], "2sls_lags")


def test_maximum_likelihood_matches_the_dense_one(spark):
    df, edges, dimension, (s, treated, post, c, y) = world(spark, noise=0.5)
    panel_rows = rows_of(df, dimension)
    fit, _ = did.fit_spatial_did(panel_rows, edges, ["c1"], "ml")
    x = dense_design(treated, post, c, s @ y)
    z, l, v = x[:, :5], x[:, 5], y.reshape(-1)

    def value(rho):
        b = np.linalg.lstsq(z, v - rho * l, rcond=None)[0]
        sse = ((v - rho * l - z @ b) ** 2).sum()
        return 40 * np.linalg.slogdet(np.eye(12) - rho * s)[1] - 240 * (np.log(2 * np.pi * sse / 480) + 1), b

    rho = fit.coefficients["lag"]
    assert all(value(rho)[0] > value(rho + d)[0] for d in (-1e-4, 1e-4)) and rho == pytest.approx(RHO, abs=0.1)
    np.testing.assert_allclose([fit.intercept, *(fit.coefficients[k] for k in ("treated", "post", "treated_post", "c1"))], value(rho)[1], atol=1e-7)
    shape, _ = spatial_models.likelihood(panel_rows, edges, ["c1"], did.regressors(panel_rows, ["c1"], None))
    assert shape.at(0.2) == pytest.approx(value(0.2)[0])
    # spread of the estimate over repeated worlds is what the curvature says
    found = [did.fit_spatial_did(rows_of(*(lambda w: (w[0], w[2]))(world(spark, noise=0.5, seed=k))), edges, ["c1"], "ml")[0].coefficients["lag"] for k in range(6)]
    assert 0.2 * fit.std_errors["lag"] < np.std(found) < 3 * fit.std_errors["lag"]


def test_determinant_from_traces(spark):
    n = 60
    edges = spark.createDataFrame([(i, j % n, w) for i in range(n) for j, w in ((i + 1, 0.6), (i + 7, 0.3), (i + n - 1, 0.1))], "i bigint, j bigint, w double")
    regions = spark.range(n).withColumnRenamed("id", "region")
    exact = spatial_models.log_determinant(regions, edges)
    traced = spatial_models.log_determinant(regions, edges, exact_regions=10, powers=12, probes=24)
    for rho in (-0.4, 0.3, 0.5):
        value, error = traced.at(rho)
        assert exact.at(rho)[1] == 0 < error and abs(value - exact.at(rho)[0]) < 4 * error

"""Registered queries: every operator over whole test tables.

Results are rounded and dates printed, so that two engines can be compared by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelweave.functions.heads import HEADS, head
from panelweave.functions.scalars import rounded
from panelweave.operators import did, forecast, gap_runs, metrics, missing, panel as panels, sandwich, scaling, spatial_models, weights, windows
from panelweave.operators.far_field import kernel_lag
from panelweave.operators.lag import spatial_lag
from panelweave.operators.neighbours import all_pairs
from panelweave.operators.regression import Fit, r_squared
from panelweave.plans import fixtures as fx
from panelweave.plans.model import ModelConfig, PanelProcessor, PooledForecaster, SpatialCausalForecaster
from panelweave.session import stage, staging_dir
from panelweave.sources.readers import load_wide_country_data, long_country_panel, wide_country_panel
from panelweave.sources.synthetic import synthetic_values

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CONTEXT, AHEAD, SAMPLES, SEED = 12, 3, 10, 7


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded; negative zero becomes zero."""
    column = F.col(c) if isinstance(c, str) else c
    rounded = F.round(column.cast("double"), digits) + F.lit(0.0)
    return rounded.alias(name or c) if name or isinstance(c, str) else rounded


def shown(df: DataFrame, rounded: Sequence[str], digits: int = 6, keys: Sequence[str] = ("region", "t")) -> DataFrame:
    """Keys (dates as text) and rounded numbers."""
    return df.select(*(F.col(k).cast("string").alias(k) if k == "t" else F.col(k) for k in keys), *(r(c, digits) for c in rounded))


def packed(c: str) -> Column:
    """An array of numbers as text, in millionths."""
    return F.concat_ws(",", F.transform(c, lambda x: F.round(x * 1_000_000).cast("bigint").cast("string"))).alias(c)


def plain(c: str) -> Column:
    return F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c)


# --- sources and reshaping -----------------------------------------------------------------


@query
def panel_long(spark, d):
    months = ("1995-06-01", "2000-12-01")
    panel = panels.between_dates(fx.nation_panel(spark, d, months), *months)
    return shown(panel, ["y", "c1", "c2"], 7)


@query
def panel_wide_unpivot(spark, d):
    orders = fx.table(spark, d, "orders")
    statuses = ["F", "O", "P"]
    wide = orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        *(F.count_if(F.col("o_orderstatus") == s).alias(s) for s in statuses)
    )
    return shown(panels.unpivot_wide(wide, "date", statuses), ["y"])


@query
def panel_densify(spark, d):
    return shown(fx.dense(fx.user_panel(spark, d)), ["y", "c1"])


@query
def panel_densify_hourly(spark, d):
    return shown(fx.dense(fx.type_panel(spark, d), "h"), ["y"])


@query
def panel_duplicates(spark, d):
    raw = panels.long_panel(fx.table(spark, d, "events"), "user_id", "ts", "value")
    return shown(panels.duplicate_cells(raw), [], keys=("region", "t", "copies"))


@query
def panel_regions(spark, d):
    return panels.regions_of(panels.only_regions(fx.supplier_panel(spark, d), fx.supplier_points(spark, d).where("treated = 1")))


@query
def region_attributes(spark, d):
    panel = fx.supplier_panel(spark, d)
    dimension = panels.treatment_indicator(panels.regions_of(panel), [0, 1, 2, 3, 5, 8, 13, 21])
    return shown(panels.attach_regions(panel, dimension), ["y"], keys=("region", "t", "treated"))


@query
def calendar_post(spark, d):
    panel = fx.supplier_panel(spark, d)
    calendar = panels.with_post(panels.calendar_of(panel), fx.POST_START)
    return shown(panels.attach_calendar(panel, calendar), ["y"], keys=("region", "t", "post"))


@query
def design_rows(spark, d):
    lagged = spatial_lag(fx.nation_rows(spark, d), fx.nation_edges(spark, d))
    rows = panels.design_rows(lagged, ["c2"], "lag")
    return shown(rows, ["y", "one", "treated", "post", "treated_post", "c2", "lag"])


def _wide_segments(spark, d):
    measures = ["new_cases", "reproduction_rate", "stringency_index"]
    return fx.segment_table(spark, d).groupBy("date").pivot("location", SEGMENTS).agg(*(F.max(m).alias(m) for m in measures))


@query
def wide_country_loaded(spark, d):
    """A wide file read, its gaps interpolated per region, targets and covariates scaled to 0–1."""
    path = f"{staging_dir(spark)}/{uuid.uuid4().hex}.parquet"
    _wide_segments(spark, d).write.parquet(path)
    panel, _ = load_wide_country_data(spark, path, [*SEGMENTS, "NOWHERE"], "1996-01-01", "1999-12-31")
    return shown(panel, ["y", "reproduction_rate", "stringency_index"])


@query
def guard_absent_regions(spark, d):
    """Suppliers of the panel that a dimension of other keys lacks, and keys of it that the panel lacks."""
    dimension = fx.supplier_points(spark, d).where("region % 3 > 0").select((F.col("region") + F.when(F.col("region") % 7 == 0, 1_000_000).otherwise(0)).alias("region"))
    return panels.absent_regions(fx.supplier_panel(spark, d), dimension)


@query
def wide_country_source(spark, d):
    wide = _wide_segments(spark, d)
    panel = wide_country_panel(wide, [*SEGMENTS, "NOWHERE"], "1996-01-01", "1999-12-31")
    return shown(panel, ["y", "reproduction_rate", "stringency_index"], 7)


@query
def long_country_source(spark, d):
    panel = long_country_panel(fx.segment_table(spark, d), SEGMENTS[:3], "1996-01-01", "1999-12-31")
    return shown(panel, ["y", "reproduction_rate", "stringency_index"], 7)


@query
def synthetic_panel(spark, d):
    """Synthetic values for the regions and dates of the user panel."""
    panel = stage(fx.user_panel(spark, d))
    dates = panels.calendar_of(panel)
    first = dates.agg(F.min("t").alias("first")).scalar()
    cells = panels.densify(panel).select("region", "t", F.date_diff("t", first).alias("step"))
    return shown(synthetic_values(cells, seed=SEED), ["y", "c1", "c2", "c3", "c4"], 5)


# --- gaps ----------------------------------------------------------------------------------


@query
def interpolate_linear(spark, d):
    return shown(missing.interpolate_linear(fx.dense(fx.user_panel(spark, d)), ["y", "c1"]), ["y", "c1"])


@query
def interpolate_hourly(spark, d):
    """The same over few long series: windows stay inside calendar blocks."""
    dense = fx.dense(fx.type_panel(spark, d), "h")
    return shown(missing.interpolate_linear(dense, ["y"], "h", block_steps=168), ["y"])


@query
def interpolate_gap_runs(spark, d):
    """The same from one row per gap; cells appear at the end only."""
    sparse = stage(fx.type_panel(spark, d))
    runs = gap_runs.coded(sparse, ["y"], "h", block_steps=168)
    return shown(gap_runs.unfold(runs, gap_runs.numbered_calendar(sparse, "h", 168), block_steps=168), ["y"])


@query
def filled_means_gap_runs(spark, d):
    """Means of interpolated daily series over the whole calendar, without a row per cell."""
    return shown(gap_runs.filled_means(gap_runs.coded(stage(fx.user_panel(spark, d)), ["y", "c1"])), ["y_mean", "c1_mean"], keys=("region", "y_n", "c1_n"))


@query
def ffill(spark, d):
    return shown(missing.forward_fill(fx.dense(fx.user_panel(spark, d)), ["y", "c1"]), ["y", "c1"])


@query
def dropna(spark, d):
    return shown(missing.drop_incomplete(fx.dense(fx.user_panel(spark, d))), ["y", "c1"])


@query
def zero_fill(spark, d):
    return shown(missing.zero_fill(fx.dense(fx.user_panel(spark, d))), ["y", "c1"])


@query
def ph_fill_rule(spark, d):
    return shown(missing.public_health_fill(fx.dense(fx.user_panel(spark, d)), ["c1"]), ["y", "c1"])


@query
def observed_mask(spark, d):
    masked = missing.observed_mask(fx.dense(fx.user_panel(spark, d)))
    return shown(masked, ["y"], keys=("region", "t", "observed"))


# --- scaling, splitting, records -------------------------------------------------------------


def _user_filled(spark, d):
    return fx.filled(fx.user_panel(spark, d), "D")


@query
def minmax(spark, d):
    return shown(scaling.scale(_user_filled(spark, d), "minmax")[0], ["y"])


@query
def standard(spark, d):
    return shown(scaling.scale(_user_filled(spark, d), "standard")[0], ["y"])


@query
def pooled_covariate_scale(spark, d):
    return shown(scaling.scale(fx.filled(fx.supplier_panel(spark, d)), "standard", ["c1", "c2"])[0], ["y", "c1", "c2"])


@query
def separate_covariate_scale(spark, d):
    panel = fx.filled(fx.supplier_panel(spark, d))
    return shown(scaling.scale(panel, "minmax", ["c1", "c2"], pooled=False)[0], ["y", "c1", "c2"])


@query
def load_pipeline(spark, d):
    """A CSV file read, repaired by interpolation and scaled to 0–1."""
    path = f"{staging_dir(spark)}/{uuid.uuid4().hex}.csv"
    fx.dense(fx.user_panel(spark, d)).select("region", F.col("t").alias("date"), "y", "c1").write.option("header", True).csv(path)
    processor = PanelProcessor(["y"], ["c1"], "region", scaling_method="minmax", handle_missing="interpolate")
    return shown(processor.load(spark, path, schema="region bigint, date string, y double, c1 double"), ["y", "c1"])


@query
def unscaled(spark, d):
    return shown(scaling.scale(_user_filled(spark, d), "none")[0], ["y"])


@query
def inverse_roundtrip(spark, d):
    processor = PanelProcessor(covariates=["c1"], handle_missing="fill")
    scaled = processor.finish(fx.dense(fx.user_panel(spark, d)))
    return shown(processor.inverse_covariates(processor.inverse_targets(scaled)), ["y", "c1"])


@query
def window_mean_scale(spark, d):
    return shown(scaling.window_mean_scale(fx.dense(fx.user_panel(spark, d)), 7), ["scale"])


@query
def window_mean_scale_hourly(spark, d):
    dense = fx.dense(fx.type_panel(spark, d), "h")
    return shown(scaling.window_mean_scale(dense, 24, freq="h", block_steps=168), ["scale"])


@query
def window_scale_gap_runs(spark, d):
    """Scales of hourly windows in runs of equal scale, unfolded for the comparison."""
    sparse = stage(fx.type_panel(spark, d))
    cells = gap_runs.positions(gap_runs.window_scales(sparse, 24, freq="h", block_steps=168), 168)
    return shown(cells.join(gap_runs.numbered_calendar(sparse, "h", 168), "pos"), ["scale"])


@query
def temporal_split(spark, d):
    train, test = panels.temporal_split(_user_filled(spark, d), 0.2)
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return shown(parts, ["y"], keys=("region", "t", "part"))


@query
def data_info(spark, d):
    return panels.data_info(fx.user_panel(spark, d), "y", ["c1"], "minmax", "interpolate")


@query
def series_records(spark, d):
    records = panels.series_records(_user_filled(spark, d), ["c1"])
    return records.select(
        "region",
        F.col("start").cast("string").alias("start"),
        packed("target"),
        plain("feat_static_cat"),
        F.concat_ws(",", F.transform(F.col("feat_dynamic_real")[0], lambda x: x.cast("bigint").cast("string"))).alias("feat_dynamic_real"),
    )


@query
def series_records_ahead(spark, d):
    """Records of the dates to learn from, with covariates over all dates."""
    panel = stage(_user_filled(spark, d))
    known, _ = panels.temporal_split(panel, 0.2)
    records = panels.series_records(known, ["c1"], future=panel.select("region", "t", "c1"))
    return records.select(
        "region", packed("target"), F.concat_ws(",", F.transform(F.col("feat_dynamic_real")[0], lambda x: x.cast("bigint").cast("string"))).alias("feat_dynamic_real")
    )


# --- spatial weights ---------------------------------------------------------------------------


def _rounded(c: str, digits: int = 6) -> Column:
    """As ``r``, for as many rows as there are pairs."""
    return (rounded(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c)


def _edges(edges: DataFrame, digits: int = 6) -> DataFrame:
    return edges.select("i", "j", _rounded("w", digits))


@query
def dist_pairs(spark, d):
    return all_pairs(fx.supplier_points(spark, d), ["x", "y"]).select("i", "j", _rounded("d"))


@query
def w_binary(spark, d):
    return _edges(weights.binary_weights(fx.customer_points(spark, d), ["x", "y"], fx.NEAR))


@query
def w_distance(spark, d):
    return _edges(weights.distance_weights(fx.customer_points(spark, d), ["x", "y"], fx.NEAR))


@query
def w_distance_power(spark, d):
    return _edges(weights.distance_weights(fx.customer_points(spark, d), ["x", "y"], fx.NEAR, 2.0, False))


@query
def w_distance_full(spark, d):
    return _edges(weights.distance_weights(fx.supplier_points(spark, d), ["x", "y"]))


@query
def w_knn(spark, d):
    return _edges(weights.knn_weights(fx.customer_points(spark, d), ["x", "y"], 4))


@query
def w_knn_embedding(spark, d):
    return _edges(weights.knn_weights(fx.embedding_points(spark, d), "embedding", 5))


@query
def w_custom(spark, d):
    """Order value between customer nation and supplier nation as weights."""
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = fx.table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("w"))
    customers = fx.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("i"))
    suppliers = fx.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("j"))
    sold = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    given = sold.where("i <> j").groupBy("i", "j").agg(F.sum("w").alias("w"))
    return _edges(weights.spatial_weights(fx.nation_points(spark, d), "custom", weights=given))


@query
def w_contiguity(spark, d):
    points, adjacency = fx.supplier_points(spark, d), fx.supplier_adjacency(spark, d)
    return _edges(weights.contiguity_weights(points, adjacency))


@query
def w_gaussian(spark, d):
    return _edges(weights.kernel_weights(fx.supplier_points(spark, d), ["x", "y"], "gaussian"))


@query
def w_exponential(spark, d):
    return _edges(weights.kernel_weights(fx.supplier_points(spark, d), ["x", "y"], "exponential"))


@query
def default_bandwidths(spark, d):
    """Median and largest distance of all customers, and the number of edges within a hundredth of the median."""
    points = fx.customer_points(spark, d)
    median, largest = (weights.default_bandwidth(points, ["x", "y"], k) for k in ("gaussian", "linear"))
    near = weights.kernel_weights(points, ["x", "y"], "gaussian", cutoff=median / 100)
    return near.agg(F.count(F.lit(1)).alias("edges"), r(F.sum("w"), 4, "weight")).select(r(F.lit(median), 6, "median"), r(F.lit(largest), 6, "largest"), "edges", "weight")


@query
def w_gaussian_near(spark, d):
    return _edges(weights.kernel_weights(fx.customer_points(spark, d), ["x", "y"], "gaussian", fx.NEAR, 2 * fx.NEAR))


@query
def w_exponential_near(spark, d):
    return _edges(weights.kernel_weights(fx.customer_points(spark, d), ["x", "y"], "exponential", fx.NEAR, 2 * fx.NEAR))


@query
def w_linear(spark, d):
    return _edges(weights.kernel_weights(fx.supplier_points(spark, d), ["x", "y"], "linear"))


@query
def w_linear_near(spark, d):
    return _edges(weights.kernel_weights(fx.customer_points(spark, d), ["x", "y"], "linear", 2 * fx.NEAR))


@query
def w_normalised(spark, d):
    points = fx.customer_points(spark, d)
    return _edges(weights.spatial_weights(points, "distance", coords=["x", "y"], threshold=fx.NEAR))


def _near_edges(spark, d):
    """The checks read the edges several times: written once."""
    return stage(weights.spatial_weights(fx.customer_points(spark, d), "binary", coords=["x", "y"], threshold=fx.NEAR))


@query
def w_validate(spark, d):
    checked = weights.validation(_near_edges(spark, d), fx.customer_points(spark, d))
    return checked.select(*(F.col(c).cast("int").alias(c) for c in checked.columns))


@query
def w_statistics(spark, d):
    found = weights.statistics(_near_edges(spark, d), fx.customer_points(spark, d))
    return found.select(
        F.col("n_regions").cast("bigint").alias("n_regions"),
        *(r(c, 8) for c in ("density", "mean_weight", "max_weight", "min_weight")),
        *(F.col(c).cast("int").alias(c) for c in ("is_symmetric", "is_normalised")),
    )


@query
def w_row_col_sums(spark, d):
    return shown(weights.row_col_sums(_near_edges(spark, d), fx.customer_points(spark, d)), ["row_sum", "col_sum"], keys=["region"])


@query
def lag(spark, d):
    return shown(fx.supplier_lagged(spark, d), ["y", "lag"])


@query
def lag_full_kernel(spark, d):
    """Over all suppliers, weighted by a Gaussian of their distance, rows summing to one."""
    panel = stage(fx.filled(fx.supplier_panel(spark, d)))
    return shown(kernel_lag(panel, fx.supplier_points(spark, d), ["x", "y"], tolerance=1e-12), ["y", "lag"], 4)


@query
def lag_full_kernel_sums(spark, d):
    """Not normalised, with a bandwidth of its own, over users; a gap of another user makes a lag unknown."""
    panel = fx.dense(fx.user_panel(spark, d))
    points = panels.regions_of(panel).select("region", (F.col("region") % 37).alias("x"), (F.col("region") % 11).alias("y"))
    known = panel.withColumn("y", F.when(F.dayofmonth("t") > 2, F.coalesce("y", F.lit(0.0))).otherwise(F.col("y")))
    return shown(kernel_lag(known, points, ["x", "y"], 6.0, tolerance=1e-12, normalise=False), ["lag"], 4)


@query
def lag_isolated(spark, d):
    """Half of the suppliers have no neighbour; gaps of a neighbour make a lag unknown."""
    dense = fx.dense(fx.user_panel(spark, d))
    key = F.col("region")
    links = panels.regions_of(dense).where(key % 2 == 0).select(key.alias("i"), (key + 1).alias("j"), F.lit(1.0).alias("w"))
    known = links.join(panels.regions_of(dense).withColumnRenamed("region", "j"), "j", "left_semi")
    return shown(spatial_lag(dense, known), ["y", "lag"])


# --- spatial difference-in-differences ------------------------------------------------------------


def _tidy_fit(spark, fit: Fit, covariates=()) -> DataFrame:
    return did.parameters(spark, fit, covariates).select("param", "idx", r("value"))


@query
def did_plain(spark, d):
    fit, _ = did.fit_ols(fx.supplier_rows(spark, d), None)
    return _tidy_fit(spark, fit)


@query
def did_spatial_ols(spark, d):
    fit, _ = did.fit_ols(fx.nation_rows(spark, d), fx.nation_edges(spark, d))
    return _tidy_fit(spark, fit)


@query
def did_spatial_ols_supplier(spark, d):
    fit, _ = did.fit_ols(fx.supplier_rows(spark, d), fx.supplier_edges(spark, d))
    return _tidy_fit(spark, fit)


@query
def did_spatial_2sls(spark, d):
    fit, _ = did.fit_2sls(fx.nation_rows(spark, d), fx.nation_edges(spark, d))
    return _tidy_fit(spark, fit)


@query
def did_spatial_2sls_supplier(spark, d):
    fit, _ = did.fit_2sls(fx.supplier_rows(spark, d), fx.supplier_edges(spark, d))
    return _tidy_fit(spark, fit)


@query
def did_spatial_cov1(spark, d):
    fit, _ = did.fit_ols(fx.nation_rows(spark, d), fx.nation_edges(spark, d), ["c2"])
    return _tidy_fit(spark, fit, ["c2"])


@query
def did_fitted(spark, d):
    fit, rows = did.fit_ols(fx.supplier_rows(spark, d), fx.supplier_edges(spark, d))
    return shown(did.fitted_cells(rows, fit), ["y", "fitted", "residual"], 5)


@query
def did_r_squared(spark, d):
    fit, rows = did.fit_ols(fx.supplier_rows(spark, d), fx.supplier_edges(spark, d))
    return r_squared(did.fitted_cells(rows, fit)).select(r("r_squared"))


def _nation_fit(spark, d):
    rows, edges = stage(fx.nation_rows(spark, d)), fx.nation_edges(spark, d)
    fit, _ = did.fit_ols(rows, edges)
    return rows, edges, fit


@query
def causal_adjust(spark, d):
    rows, _, fit = _nation_fit(spark, d)
    return shown(did.causal_adjustment(rows, fit.coefficients["treated_post"]), ["y", "y_adjusted"])


@query
def spatial_adjust(spark, d):
    rows, edges, fit = _nation_fit(spark, d)
    adjusted = did.causal_adjustment(rows, fit.coefficients["treated_post"])
    return shown(did.spatial_adjustment(adjusted, edges, fit.coefficients["lag"]), ["y_adjusted", "z"])


@query
def interpretation(spark, d):
    fit, _ = did.fit_ols(fx.nation_rows(spark, d), fx.nation_edges(spark, d), ["c2"])
    return did.interpretation(did.parameters(spark, fit, ["c2"]))


@query
def did_2sls_lags(spark, d):
    fit, _ = did.fit_spatial_did(fx.supplier_rows(spark, d), fx.supplier_edges(spark, d), ["c1"], "2sls_lags")
    return _tidy_fit(spark, fit, ["c1"])


@query
def did_ml_likelihood(spark, d):
    """Log-likelihood of the nation panel at fixed ρ, and its squared error left."""
    rows, edges = fx.nation_rows(spark, d), fx.nation_edges(spark, d)
    shape, _ = spatial_models.likelihood(rows, edges, [], did.regressors(rows, [], None))
    found = [(rho, shape.at(rho), shape.coefficients(rho)[1]) for rho in (-0.5, 0.0, 0.3, 0.6)]
    return spark.createDataFrame(found, "rho double, likelihood double, sse double").select("rho", r("likelihood", 4), r("sse", 4))


@query
def did_ml_optimum(spark, d):
    """The likelihood falls to both sides of the fitted ρ, which lies where its slope is zero."""
    rows, edges = fx.nation_rows(spark, d), fx.nation_edges(spark, d)
    names = did.regressors(rows, [], None)
    shape, _ = spatial_models.likelihood(rows, edges, [], names)
    fit, _ = did.fit_spatial_did(rows, edges, [], "ml")
    rho = fit.coefficients["lag"]
    found = [(s, shape.at(rho + s * 1e-3) < shape.at(rho), fit.n) for s in (-1, 1)]
    return spark.createDataFrame(found, "side int, lower boolean, n bigint")


def _supplier_errors(spark, d, errors=None):
    fit, rows = did.fit_ols(fx.supplier_rows(spark, d), fx.supplier_edges(spark, d), ["c1"])
    found = did.standard_errors(spark, fit, ["c1"], errors and errors(rows, fit))
    return found.select("param", "idx", r("std_error"), r("t_stat", 4))


@query
def did_standard_errors(spark, d):
    return _supplier_errors(spark, d)


@query
def did_clustered_errors(spark, d):
    return _supplier_errors(spark, d, sandwich.clustered_errors)


@query
def did_near_errors(spark, d):
    """Residuals of suppliers closer than twice NEAR go together, the less the farther they are apart."""
    near = weights.kernel_weights(fx.supplier_points(spark, d), ["x", "y"], "linear", 2 * fx.NEAR)
    return _supplier_errors(spark, d, lambda rows, fit: sandwich.near_errors(rows, fit, near))


# --- windows and forecasts ------------------------------------------------------------------------


def _windows_out(df: DataFrame, date: str | None) -> DataFrame:
    arrays = ["past", "future", "past_observed", "future_observed", "is_pad"]
    pack = [packed(c) if c in ("past", "future") else plain(c) for c in arrays]
    when = [F.col(date).cast("string").alias(date)] if date else []
    return df.select("region", *when, *pack)


@query
def train_windows(spark, d):
    return _windows_out(windows.training_windows(fx.dense(fx.user_panel(spark, d)), 7, 3), "forecast_start")


@query
def train_windows_sampled(spark, d):
    picked = windows.training_windows(fx.dense(fx.user_panel(spark, d)), 7, 3, seed=SEED)
    return picked.select("region", F.col("forecast_start").cast("string").alias("forecast_start"), packed("future"))


@query
def train_windows_hourly(spark, d):
    cut = windows.training_windows(fx.dense(fx.type_panel(spark, d), "h"), 4, 2, "h", block_steps=168)
    return cut.select("region", F.col("forecast_start").cast("string").alias("forecast_start"), packed("past"), packed("future"))


@query
def train_windows_covariate(spark, d):
    cut = windows.training_windows(fx.dense(fx.user_panel(spark, d)), 7, 3, covariates=["c1"])
    return cut.select("region", F.col("forecast_start").cast("string").alias("forecast_start"), packed("past_c1"), packed("future_c1"))


@query
def predict_window_covariate(spark, d):
    panel = fx.dense(fx.user_panel(spark, d))
    known, _ = panels.temporal_split(panel, 0.2)
    cut = windows.prediction_window(known, 7, 3, covariates=["c1"], future=panel.select("region", "t", "c1"))
    return cut.select("region", F.col("last_known").cast("string").alias("last_known"), packed("past"), packed("past_c1"), packed("future_c1"))


@query
def predict_window(spark, d):
    return _windows_out(windows.prediction_window(fx.dense(fx.user_panel(spark, d)), 7, 3), "last_known")


@query
def predict_window_holdout(spark, d):
    return _windows_out(windows.prediction_window(fx.dense(fx.user_panel(spark, d)), 7, 3, True), "last_known")


@query
def aligned_windows(spark, d):
    cut = windows.training_windows(fx.dense(fx.user_panel(spark, d)), 7, 3)
    aligned = windows.aligned_training(cut, 7, 3)
    return aligned.select(
        "region", F.col("forecast_start").cast("string").alias("forecast_start"), packed("inputs"), plain("inputs_observed"), packed("targets")
    )


def _nll(spark, d, name):
    """Loss of each user's values under their mean and spread, scaled by 2."""
    panel = _user_filled(spark, d)
    moments = panel.groupBy("region").agg(F.avg("y").alias("loc"), (F.stddev_pop("y") + 1.0).alias("spread"))
    loss = head(name).nll(F.col("y"), F.col("loc") / 2.0, F.col("spread") / 2.0, F.lit(2.0))
    return panel.join(moments, "region").groupBy("region").agg(F.avg(loss).alias("nll")).select("region", r("nll"))


@query
def nll_gaussian(spark, d):
    return _nll(spark, d, "gaussian")


@query
def nll_laplace(spark, d):
    return _nll(spark, d, "laplace")


@query
def nll_student_t(spark, d):
    return _nll(spark, d, "student_t")


@query
def head_quantiles(spark, d):
    """5 % and 90 % quantiles of the three heads at each user's mean and spread."""
    moments = _user_filled(spark, d).groupBy("region").agg(F.avg("y").alias("loc"), F.stddev_pop("y").alias("spread"))
    columns = [
        r(head(name).quantile(p, F.col("loc"), F.col("spread")), 5, f"{name}_{int(p * 100)}") for name in HEADS for p in (0.05, 0.9)
    ]
    return moments.select("region", *columns)


def _ar(spark, d, distribution="gaussian", lags=(1,)):
    panel = stage(fx.filled(fx.supplier_panel(spark, d)))
    return panel, forecast.fit(panel, CONTEXT, distribution, lags, freq="M")


def _ar_table(spark, model, digits=6):
    return model.table(spark).select("param", "idx", r("value", digits))


@query
def ar1_fit(spark, d):
    return _ar_table(spark, _ar(spark, d)[1])


@query
def ar2_fit(spark, d):
    return _ar_table(spark, _ar(spark, d, lags=(1, 2))[1])


@query
def ar_laplace_fit(spark, d):
    return _ar_table(spark, _ar(spark, d, "laplace", (1, 2, 3))[1])


@query
def ar_student_fit(spark, d):
    return _ar_table(spark, _ar(spark, d, "student_t", (1, 2, 3))[1])


def _fitted_rows(spark, d, distribution):
    """(model, complete rows with x, lag1…lag3 and the residual in spreads)."""
    panel, model = _ar(spark, d, distribution, (1, 2, 3))
    rows = forecast.lag_rows(panel, forecast.region_scale(panel, CONTEXT), model.lags, freq="M").dropna()
    return model, stage(rows.withColumn("one", F.lit(1.0)).withColumn("z", (F.col("x") - model.location()) / model.spread))


@query
def ar_laplace_optimality(spark, d):
    """Per regressor: the signs of the residuals balance, as far as rows without residual can settle what is left. That is
    the condition of least absolute deviations. ``spread`` is balanced by the mean |residual|."""
    model, rows = _fitted_rows(spark, d, "laplace")
    flat = F.abs("z") <= 1e-7
    names = ["one", "lag1", "lag2", "lag3"]
    parts = [
        F.struct(
            F.lit(c).alias("term"),
            (F.abs(F.sum(F.when(flat, 0.0).otherwise(F.signum("z") * F.col(c)))) <= F.sum(F.when(flat, F.abs(c)).otherwise(0.0)) + 1e-6).alias("balanced"),
            F.count(F.lit(1)).alias("n"),
        )
        for c in names
    ]
    parts.append(F.struct(F.lit("spread").alias("term"), (F.abs(F.avg(F.abs("z")) - 1.0) < 1e-7).alias("balanced"), F.count(F.lit(1)).alias("n")))
    return rows.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))


@query
def ar_student_scores(spark, d):
    """Slopes of the mean log-likelihood at the fitted parameters; all are zero at its maximum, or lead out of the range of ν."""
    model, rows = _fitted_rows(spark, d, "student_t")
    nu = model.nu
    w = (nu + 1) / (nu + F.col("z") * F.col("z"))
    parts = [F.struct(F.lit(c).alias("term"), F.avg(w * F.col("z") * F.col(c)).alias("score"), F.count(F.lit(1)).alias("n")) for c in ("one", "lag1", "lag2", "lag3")]
    parts.append(F.struct(F.lit("spread").alias("term"), F.avg(w * F.col("z") * F.col("z") - 1.0).alias("score"), F.count(F.lit(1)).alias("n")))
    return rows.agg(F.array(*parts).alias("parts")).select(F.inline("parts")).select("term", r("score", 5), "n")


@query
def ar_loss(spark, d):
    panel, model = _ar(spark, d)
    scales = forecast.region_scale(panel, CONTEXT)
    return forecast.loss(panel, model, scales, freq="M").select(r("nll"), "n")


def _paths(spark, d, distribution="gaussian", lags=(1,)):
    panel, model = _ar(spark, d, distribution, lags)
    return panel, forecast.sample_paths(panel, model, CONTEXT, AHEAD, SAMPLES, SEED, freq="M")


@query
def forecast_paths(spark, d):
    return shown(_paths(spark, d)[1], ["value"], 4, ("region", "step", "t", "sample_id"))


@query
def forecast_paths_laplace(spark, d):
    return shown(_paths(spark, d, "laplace", (1, 2, 3))[1], ["value"], 4, ("region", "step", "t", "sample_id"))


@query
def forecast_paths_student(spark, d):
    return shown(_paths(spark, d, "student_t", (1, 2, 3))[1], ["value"], 4, ("region", "step", "t", "sample_id"))


#: Parameters that are stated, so that paths of all heads can be drawn anew elsewhere.
STATED = {"intercept": 0.2, "phi": 0.6, "spread": 0.25, "nu": 4.0}


def _stated_paths(spark, d, distribution):
    panel = fx.filled(fx.supplier_panel(spark, d))
    nu = STATED["nu"] if distribution == "student_t" else None
    model = forecast.Autoregression(distribution, (1,), STATED["intercept"], (STATED["phi"],), STATED["spread"], nu)
    paths = forecast.sample_paths(panel, model, CONTEXT, AHEAD, SAMPLES, SEED, freq="M", non_negative=True)
    return shown(paths, ["value"], 4, ("region", "step", "t", "sample_id"))


@query
def stated_paths_laplace(spark, d):
    return _stated_paths(spark, d, "laplace")


@query
def stated_paths_student(spark, d):
    return _stated_paths(spark, d, "student_t")


def _with_covariate(spark, d):
    """(dates to learn from, whole panel, model of one lag and one covariate)."""
    panel = stage(fx.filled(fx.supplier_panel(spark, d)))
    train, _ = panels.temporal_split(panel, AHEAD / 80, "M")
    return train, panel, forecast.fit(train, CONTEXT, "gaussian", (1,), covariates=("c1",), freq="M")


@query
def ar_covariate_fit(spark, d):
    return _ar_table(spark, _with_covariate(spark, d)[2])


@query
def forecast_paths_covariate(spark, d):
    train, panel, model = _with_covariate(spark, d)
    paths = forecast.sample_paths(train, model, CONTEXT, AHEAD, SAMPLES, SEED, freq="M", future=panel.select("region", "t", "c1"))
    return shown(paths, ["value"], 4, ("region", "step", "t", "sample_id"))


def _ensemble(spark, d):
    panel = stage(fx.filled(fx.supplier_panel(spark, d)))
    return panel, *fx.ensemble(panel)


@query
def forecast_summary(spark, d):
    _, forecasts, _ = _ensemble(spark, d)
    summary = forecast.forecast_summary(forecasts.withColumn("step", F.lit(1)))
    return shown(summary, ["mean", "median", "std", "quantile_10", "quantile_90"], keys=("region", "t", "num_samples"))


@query
def fan_table(spark, d):
    panel, forecasts, truth = _ensemble(spark, d)
    return shown(forecast.fan_table(forecasts, panel, 24, truth=truth), ["value"], keys=("region", "t", "series"))


# --- scores --------------------------------------------------------------------------------------


def _scored(spark, d):
    _, forecasts, truth = _ensemble(spark, d)
    return metrics.forecast_cells(forecasts, truth, metrics.coverage_probabilities())


@query
def point_metrics(spark, d):
    found = metrics.point_metrics(_scored(spark, d), "skip")
    return found.select(*(r(c, 5) for c in found.columns))


@query
def median_metrics(spark, d):
    found = metrics.median_metrics(_scored(spark, d))
    return found.select(*(r(c, 5) for c in found.columns))


@query
def uncertainty(spark, d):
    found = metrics.uncertainty_metrics(_scored(spark, d))
    return found.select(*(r(c) for c in found.columns))


@query
def coverage(spark, d):
    found = metrics.coverage_metrics(_scored(spark, d))
    return found.select(*(r(c) for c in found.columns))


def _metric_rows(table: DataFrame, digits: int = 5) -> DataFrame:
    return table.select("section", "metric", r("value", digits), "label")


@query
def metric_bundle(spark, d):
    _, forecasts, truth = _ensemble(spark, d)
    return _metric_rows(metrics.forecast_metrics(forecasts, truth, zero="skip"))


@query
def spatial_metrics(spark, d):
    _, forecasts, truth = _ensemble(spark, d)
    return _metric_rows(metrics.spatial_metrics(forecasts, truth, fx.supplier_edges(spark, d)))


def _items(spark, d):
    panel, forecasts, truth = _ensemble(spark, d)
    history = panel.join(truth.select("region", "t"), ["region", "t"], "left_anti")
    return metrics.item_metrics(forecasts, truth, history, seasonal_period=12, freq="M")


@query
def item_metrics(spark, d):
    items = _items(spark, d)
    return shown(items, [c for c in items.columns if c != "region"], 5, ["region"])


@query
def agg_metrics(spark, d):
    return _metric_rows(metrics.aggregate_metrics(_items(spark, d)))


@query
def metric_family(spark, d):
    rows = metrics.report(metrics.aggregate_metrics(_items(spark, d)), did_parameters_as_metrics(spark, d))
    return metrics.metric_family(rows).select("metric", "family")


def did_parameters_as_metrics(spark, d):
    fit, _ = did.fit_ols(fx.nation_rows(spark, d), fx.nation_edges(spark, d))
    params = did.parameters(spark, fit)
    return params.select(
        F.lit("parameters").alias("section"), F.col("param").alias("metric"), "value", F.lit(None).cast("string").alias("label")
    )


def _true_parameters(spark) -> DataFrame:
    rows = [("delta", 0, -0.15), ("rho", 0, 0.4), ("gamma", 0, 0.5)]
    return spark.createDataFrame(rows, did.PARAMETER_SCHEMA)


@query
def causal_evaluation(spark, d):
    fit, _ = did.fit_ols(fx.nation_rows(spark, d), fx.nation_edges(spark, d), ["c2"])
    params = did.parameters(spark, fit, ["c2"])
    return _metric_rows(metrics.causal_evaluation(params, _true_parameters(spark)))


@query
def interpretability(spark, d):
    fit, _ = did.fit_ols(fx.nation_rows(spark, d), fx.nation_edges(spark, d))
    return _metric_rows(metrics.interpretability(did.parameters(spark, fit), 64))


@query
def report(spark, d):
    _, forecasts, truth = _ensemble(spark, d)
    edges = fx.supplier_edges(spark, d)
    fit, _ = did.fit_ols(fx.supplier_rows(spark, d), edges)
    params = did.parameters(spark, fit)
    return _metric_rows(
        metrics.report(
            metrics.forecast_metrics(forecasts, truth, zero="skip"),
            metrics.causal_evaluation(params),
            metrics.spatial_metrics(forecasts, truth, edges),
            metrics.interpretability(params, 64),
        )
    )


# --- whole model ---------------------------------------------------------------------------------


def _config(distribution: str = "gaussian") -> ModelConfig:
    lags = (1,) if distribution == "gaussian" else forecast.DEFAULT_LAGS
    return ModelConfig(AHEAD, CONTEXT, "M", distribution, num_sample_paths=SAMPLES, lags=lags, seed=SEED)


def model_settings() -> list[tuple[str, str]]:
    """Name and text of each setting that a summary of the fitted model begins with."""
    return [("is_fitted", "True"), *((k, str(v)) for k, v in asdict(_config()).items())]


def _model(spark, d, distribution="gaussian"):
    config = _config(distribution)
    panel = stage(fx.filled(fx.supplier_panel(spark, d)))
    train, test = panels.temporal_split(panel, AHEAD / 80, "M")
    model = SpatialCausalForecaster(config, fx.supplier_edges(spark, d), fx.supplier_points(spark, d), fx.POST_START)
    return model.fit(train), train, test


@query
def end_to_end_forecast(spark, d):
    model, train, _ = _model(spark, d)
    summary = model.forecast_summary(model.predict(train))
    return shown(summary, ["mean", "median", "std", "quantile_10", "quantile_90"], 3, ("region", "step", "t", "num_samples"))


@query
def end_to_end_laplace(spark, d):
    model, train, _ = _model(spark, d, "laplace")
    summary = model.forecast_summary(model.predict(train))
    return shown(summary, ["mean", "median", "std", "quantile_10", "quantile_90"], 4, ("region", "step", "t", "num_samples"))


@query
def model_roundtrip(spark, d):
    """Saved to the shared folder, loaded and saved over itself, loaded again: the same paths."""
    model, train, _ = _model(spark, d)
    path = f"{staging_dir(spark)}/model-{uuid.uuid4().hex}"
    model.save(path)
    SpatialCausalForecaster.load(spark, path).save(path)
    paths = SpatialCausalForecaster.load(spark, path).predict(train)
    return shown(paths, ["value"], 4, ("region", "step", "t", "sample_id"))


@query
def end_to_end_scores(spark, d):
    model, train, test = _model(spark, d)
    found, _ = model.evaluate(model.predict(train), test, train)
    return _metric_rows(found, 4)


@query
def forecaster_info(spark, d):
    """Settings of a forecaster that was fitted to the supplier panel."""
    panel = stage(fx.filled(fx.supplier_panel(spark, d)))
    return PooledForecaster(_config()).fit(panel).info(spark)


@query
def model_summary(spark, d):
    model, _, _ = _model(spark, d)
    number = F.round(F.col("setting").try_cast("double") * 1_000_000).cast("bigint").cast("string")
    estimated = F.col("name").isin("beta_0", "beta_1", "beta_2", "delta", "rho")
    return model.summary(spark).select("name", F.when(estimated, number).otherwise(F.col("setting")).alias("setting"))

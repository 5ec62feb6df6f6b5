"""The combined model, its storage, and the registered queries against SQL."""

import datetime as dt
import os

import duckdb
import helpers
import numpy as np
import pytest
from helpers import panel, plan_of, same_rows
from pyspark.sql import functions as F

import __spark_entry__ as driver
from panelweave import ForecastEvaluator, ModelConfig, PooledForecaster, SpatialCausalForecaster
from panelweave import session
from panelweave.operators import forecast, panel as panels
from panelweave.operators.lag import spatial_lag
from panelweave.operators.ordered import since_tail
from panelweave.plans.catalogue import QUERIES
from panelweave.sources.store import save_tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(21)
    n, steps = 6, 60
    base = 5 + rng.normal(size=(n, steps)).cumsum(axis=1) * 0.2 + rng.normal(size=(n, steps)) * 0.3
    df = panel(spark, {i: list(zip(base[i], rng.normal(size=steps))) for i in range(n)}, ("y", "c1"))
    edges = spark.createDataFrame([(i, (i + 1) % n, 1.0) for i in range(n)], "i bigint, j bigint, w double")
    regions = panels.treatment_indicator(panels.regions_of(df), [0, 1])
    config = ModelConfig(4, 20, num_sample_paths=15, causal_method="ols", covariates=("c1",))
    model = SpatialCausalForecaster(config, edges, regions, "2020-02-01")
    return model.fit(df), df


def test_predictions(spark, fitted):
    model, df = fitted
    paths = model.predict(df)
    assert paths.count() == 6 * 4 * 15 and model.predict(df, 3).count() == 6 * 4 * 3
    assert paths.where("value IS NULL").count() == 0
    raw = model.predict(df, adjust=False)
    assert not same_rows(raw, paths)
    truth = panels.between_dates(df, "2020-02-26")
    table, items = model.evaluate(paths.withColumn("t", F.date_sub("t", 4)), truth, df)
    assert items.count() == 6 and {"RMSE", "ND", "MASE"} <= {r["metric"] for r in table.collect()}
    report = ForecastEvaluator().report(paths.withColumn("t", F.date_sub("t", 4)), truth, model.causal.parameters, 64, model.edges)
    assert {r["section"] for r in report.collect()} == {"forecast_metrics", "causal_evaluation", "spatial_metrics", "interpretability"}


def test_storage_restores_everything(spark, fitted, folder):
    model, df = fitted
    model.save(f"{folder}/model")
    again = SpatialCausalForecaster.load(spark, f"{folder}/model")
    assert again.is_fitted and again.config == model.config
    assert same_rows(again.predict(df), model.predict(df))
    assert same_rows(again.interpretation(spark), model.interpretation(spark))
    assert same_rows(again.summary(spark), model.summary(spark))
    names = {r["name"] for r in again.summary(spark).collect()}
    assert {"is_fitted", "n_regions", "rho", "delta", "gamma_0", "distribution", "treatment_effect"} <= names


def test_saving_over_a_loaded_model_and_broken_saves(spark, fitted, folder):
    model, df = fitted
    path = f"{folder}/model"
    with pytest.raises(ValueError, match="no saved model"):
        SpatialCausalForecaster.load(spark, path)
    model.save(path)
    again = SpatialCausalForecaster.load(spark, path)
    again.save(path)
    third = SpatialCausalForecaster.load(spark, path)
    with pytest.raises(Exception, match="absent"):
        save_tables(path, {"edges": panels.attach_regions(df, model.regions.limit(0))}, {})
    assert same_rows(SpatialCausalForecaster.load(spark, path).predict(df), model.predict(df))
    assert same_rows(third.predict(df), model.predict(df))


def test_staged_tables_can_be_cleared(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(session.staging_dir(spark))
    staged = session.stage(spark.range(5))
    assert staged.count() == 5 and staged.inputFiles()[0].split("/")[-3] == spark.sparkContext.applicationId
    there = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert there.exists(path)
    assert callable(session.clear)


def test_forecasts_with_covariates(spark, fitted, folder):
    model, df = fitted
    config = ModelConfig(4, 20, num_sample_paths=5, distribution="gaussian", lags=(1,), causal_method="ols", forecast_covariates=("c1",))
    train, test = panels.temporal_split(df, 4 / 60)
    other = SpatialCausalForecaster(config, model.edges, model.regions, "2020-02-01").fit(train)
    assert other.forecaster.model.covariates == ("c1",)
    with pytest.raises(ValueError, match="c1"):
        other.predict(train)
    paths = other.predict(train, future=df.select("region", "t", "c1"))
    assert paths.count() == 6 * 4 * 5
    shifted = other.predict(train, future=test.select("region", "t", (F.col("c1") + 1).alias("c1")))
    change = shifted.withColumnRenamed("value", "other").join(paths, ["region", "step", "t", "sample_id"]).where("step = 1")
    gamma = other.forecaster.model.gamma[0]
    scales = {r["region"]: r["scale"] for r in forecast.region_scale(other.causal.adjust(train), 20, "z").collect()}
    for r in change.collect():
        assert r["other"] - r["value"] == pytest.approx(gamma * scales[r["region"]], rel=1e-6)
    other.save(f"{folder}/ahead")
    again = SpatialCausalForecaster.load(spark, f"{folder}/ahead")
    assert same_rows(again.predict(train, future=df), paths)


def test_calendar_storage(spark, fitted, folder):
    model, df = fitted
    calendar = panels.with_post(panels.calendar_of(df), "2020-02-01")
    other = SpatialCausalForecaster(model.config, model.edges, model.regions, calendar).fit(df)
    assert other.causal.delta == pytest.approx(model.causal.delta)
    with pytest.raises(Exception, match="absent from the calendar"):
        other.predict(df.unionByName(df.withColumn("t", F.date_add("t", 60)))).collect()
    other.save(f"{folder}/model")
    assert same_rows(SpatialCausalForecaster.load(spark, f"{folder}/model").predict(df), model.predict(df))


def test_prediction_adjusts_only_the_dates_it_starts_from(spark, fitted, monkeypatch):
    model, df = fitted
    adjust, seen = model.causal.adjust, []
    monkeypatch.setattr(model.causal, "adjust", lambda rows: seen.append(rows) or adjust(rows))
    paths = model.predict(df)
    last = df.agg(F.max("t")).first()[0]
    assert seen[0].agg(F.min("t")).first()[0] == last - dt.timedelta(days=19) and seen[0].count() == 6 * 20
    assert same_rows(paths, model.forecaster.predict(adjust(df), "z"))


def test_edges_are_made_once_by_a_fit(fitted):
    model, _ = fitted
    assert model.causal.edges.inputFiles() and same_rows(model.causal.edges, model.edges)


def test_since_tail_reaches_back_to_the_most_delayed_group(spark):
    rows = [("a", n, float(n)) for n in range(10)] + [("b", n, float(n)) for n in (2, 3, 3, 8)] + [("c", None, 0.0), (None, 9, 1.0)]
    df = spark.createDataFrame(rows, "region string, n int, y double").select("region", F.date_add(F.lit(helpers.DAY), "n").alias("t"), "y")
    for n, first in ((1, 8), (3, 3), (4, 2), (100, 0)):
        expected = df.where((F.col("t") >= F.lit(helpers.day(first))) | F.col("t").isNull())
        assert same_rows(since_tail(df, ["region"], n), expected)


def test_stored_edges_are_not_broadcast_once_per_slice(spark):
    df = panel(spark, {i: [i, i + 1.0, i * i] for i in range(6)})
    edges = session.stage(spark.createDataFrame([(i, (i + 1) % 6, 1.0) for i in range(6)], "i bigint, j bigint, w double"))
    lagged = spatial_lag(df, edges)
    meeting = [line for line in plan_of(lagged).splitlines() if "Join" in line and "_s#" in line]
    assert meeting and all("SortMergeJoin" in line for line in meeting)
    assert sorted(r["lag"] for r in lagged.where("region = 5").collect()) == [0.0, 0.0, 1.0]


def test_states_and_guards(spark, fitted):
    model, df = fitted
    fresh = SpatialCausalForecaster(model.config, model.edges, model.regions, "2020-02-01")
    with pytest.raises(ValueError, match="fit the model"):
        fresh.predict(df)
    with pytest.raises(ValueError, match="fit the model"):
        fresh.save("nowhere")
    with pytest.warns(UserWarning, match="not fitted"):
        assert fresh.interpretation(spark).count() == 0
    with pytest.warns(UserWarning, match="skipped"):
        fresh.fit(df, fit_causal=False)
    assert fresh.is_fitted and not fresh.causal_fitted and fresh.predict(df).count() == 360
    with pytest.raises(ValueError, match="absent"):
        SpatialCausalForecaster(model.config, model.edges, model.regions.limit(3)).fit(df)
    with pytest.raises(ValueError, match="fit the forecaster"):
        PooledForecaster(model.config).predict(df)
    assert {r["name"]: r["setting"] for r in model.forecaster.info(spark).collect()}["is_fitted"] == "True"
    for wrong in ({"distribution": "poisson"}, {"causal_method": "lasso"}):
        with pytest.raises(ValueError):
            ModelConfig(2, 5, **wrong)
    with pytest.raises(ValueError):
        forecast.fit(df, 3, lags=(7,))


def clean(frame):
    columns = sorted(frame.columns)
    rows = []
    for row in frame[columns].itertuples(index=False, name=None):
        values = [v.item() if hasattr(v, "item") else v for v in row]
        rows.append(tuple(None if v is None or v != v else v for v in values))
    return columns, sorted(rows, key=repr)


ORACLES = driver.oracle_sql()


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(driver.queries())


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, small, name):
    got = driver.queries()[name](spark, small).toPandas()
    assert len(got) > 0
    if name in ORACLES:
        assert clean(got) == clean(duck.sql(ORACLES[name]).df())


def test_entry(spark, small):
    assert {r["param"] for r in driver.entry(spark).collect()} == {"beta_0", "beta_1", "beta_2", "delta", "rho"}


@pytest.mark.parametrize("name", ["lag", "w_binary", "w_knn", "w_linear_near", "w_normalised", "panel_densify", "panel_densify_hourly", "design_rows"])
def test_plans_have_no_cross_join(spark, small, name):
    plan = plan_of(driver.queries()[name](spark, small))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from panelweave import session

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Context:
        master = "spark://somewhere"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    assert os.path.isabs(session.shared_dir(spark).removeprefix("file:"))

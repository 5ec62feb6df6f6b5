"""The user-facing classes: processing, causal fit, forecast, evaluation and their combination."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelweave.functions.heads import head
from panelweave.operators import did, forecast, metrics, panel as panels, scaling
from panelweave.operators.missing import repair
from panelweave.operators.ordered import since_tail
from panelweave.operators.regression import Fit, r_squared
from panelweave.operators.weights import require_endpoints
from panelweave.session import stage
from panelweave.sources.readers import generic_panel, read_table
from panelweave.sources.store import load_tables, save_tables


class PanelProcessor:
    """Read, repair and scale a panel; keeps the scalers for the way back."""

    def __init__(
        self,
        targets: Sequence[str] = ("y",),
        covariates: Sequence[str] = (),
        region: str | None = None,
        date: str = "date",
        scaling_method: str = "minmax",
        handle_missing: str = "interpolate",
        freq: str = "D",
        pooled: bool = True,
    ):
        self.targets, self.covariates = list(targets), list(covariates)
        self.region, self.date, self.freq, self.pooled = region, date, freq, pooled
        self.scaling_method, self.handle_missing = scaling_method, handle_missing
        self.scalers: dict[str, DataFrame] = {}
        self.panel: DataFrame | None = None

    def load(self, spark: SparkSession, path: str, **options) -> DataFrame:
        return self.process(read_table(spark, path, **options))

    def process(self, table: DataFrame) -> DataFrame:
        return self.finish(generic_panel(table, self.targets, self.covariates, self.region, self.date, self.freq))

    def finish(self, panel: DataFrame) -> DataFrame:
        """Repair gaps, densify and scale canonical panel rows.

        The repaired panel is written once: the grid reads it three times, and it also gives the
        scalers, since cells absent from it hold no value.
        """
        repaired = stage(repair(panel, self.handle_missing, self.freq))
        dense = panels.densify(repaired, self.freq)
        self.panel, self.scalers = scaling.scale(
            dense, self.scaling_method, self.covariates, self.pooled, repaired
        )
        return self.panel

    def inverse_targets(self, df: DataFrame, columns: Sequence[str] = ("y",)) -> DataFrame:
        return scaling.invert_scaler(df, columns, self.scalers.get("y"))

    def inverse_covariates(self, df: DataFrame) -> DataFrame:
        if "covariates" in self.scalers:
            return scaling.invert_scaler(df, self.covariates, self.scalers["covariates"])
        for c in self.covariates:
            df = scaling.invert_scaler(df, [c], self.scalers.get(c))
        return df

    def split(self, df: DataFrame, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
        return panels.temporal_split(df, test_size, self.freq)

    def info(self) -> DataFrame:
        if self.panel is None:
            raise ValueError("process a table first")
        return panels.data_info(
            self.panel, self.targets[0], self.covariates, self.scaling_method, self.handle_missing
        )


class SpatialDiD:
    """Spatial difference-in-differences on a dense panel.

    ``treatment`` is (region, treated); ``post`` is (t, post) or the first treated date.
    """

    def __init__(
        self,
        edges: DataFrame,
        treatment: DataFrame | None = None,
        post: DataFrame | str | None = None,
        covariates: Sequence[str] = (),
        method: str = "2sls",
    ):
        self.edges, self.treatment, self.post = edges, treatment, post
        self.covariates, self.method = list(covariates), method
        self.result: Fit | None = None
        self.rows: DataFrame | None = None
        self.parameters: DataFrame | None = None

    def with_indicators(self, panel: DataFrame) -> DataFrame:
        if self.treatment is not None:
            panel = panels.attach_regions(panel, self.treatment.select("region", "treated"))
        if isinstance(self.post, str):
            return panels.with_post(panel, self.post)
        return panel if self.post is None else panels.attach_calendar(panel, self.post)

    def fit(self, panel: DataFrame) -> SpatialDiD:
        self.result, self.rows = did.fit_spatial_did(
            self.with_indicators(panel), self.edges, self.covariates, self.method
        )
        self.parameters = did.parameters(panel.sparkSession, self.result, self.covariates)
        return self

    def _value(self, name: str) -> float | None:
        return None if self.result is None else self.result.coefficients.get(name)

    @property
    def delta(self) -> float | None:
        return self._value("treated_post")

    @property
    def rho(self) -> float | None:
        return self._value("lag")

    def adjust(self, panel: DataFrame) -> DataFrame:
        """Panel rows with ``y_adjusted`` (effect removed) and ``z`` (spill-over added)."""
        adjusted = did.causal_adjustment(self.with_indicators(panel), self.delta)
        return did.spatial_adjustment(adjusted, self.edges, self.rho)

    def fitted(self) -> DataFrame:
        return did.fitted_cells(self.rows, self.result)

    def r_squared(self) -> DataFrame:
        return r_squared(self.fitted())

    def interpretation(self) -> DataFrame:
        return did.interpretation(self.parameters)


@dataclass
class ModelConfig:
    """Configuration of the combined model. ``batch_size``, ``epochs``, ``learning_rate`` and
    ``num_cells`` describe a gradient-trained network; this engine fits by least squares and
    keeps them as information only."""

    prediction_length: int
    context_length: int
    freq: str = "D"
    distribution: str = "laplace"
    num_cells: int = 64
    num_sample_paths: int = 100
    scaling: bool = True
    batch_size: int = 32
    epochs: int = 100
    learning_rate: float = 0.001
    causal_method: str = "2sls"
    lags: tuple[int, ...] = forecast.DEFAULT_LAGS
    seed: int = 0
    covariates: tuple[str, ...] = field(default_factory=tuple)
    #: Covariates of the forecaster, known ahead; ``covariates`` are those of the causal fit.
    forecast_covariates: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        head(self.distribution)
        if self.causal_method not in did.METHODS:
            raise ValueError(f"unsupported method {self.causal_method!r}")
        self.lags, self.covariates = tuple(self.lags), tuple(self.covariates)
        self.forecast_covariates = tuple(self.forecast_covariates)


class PooledForecaster:
    """Probabilistic forecaster of one target column."""

    def __init__(self, config: ModelConfig):
        self.config = config
        self.model: forecast.Autoregression | None = None

    def fit(self, panel: DataFrame, column: str = "y") -> PooledForecaster:
        c = self.config
        self.model = forecast.fit(
            panel, c.context_length, c.distribution, c.lags, column, c.scaling, c.forecast_covariates, c.freq
        )
        return self

    def predict(
        self, panel: DataFrame, column: str = "y", num_samples: int | None = None, future: DataFrame | None = None
    ) -> DataFrame:
        """Sample paths; ``future`` has the covariates of the steps ahead, where the model reads any."""
        if self.model is None:
            raise ValueError("fit the forecaster before predicting")
        c = self.config
        return forecast.sample_paths(
            panel, self.model, c.context_length, c.prediction_length, num_samples or c.num_sample_paths,
            c.seed, column, c.scaling, c.freq, future=future,
        )

    def info(self, spark: SparkSession) -> DataFrame:
        rows = [(k, str(v)) for k, v in asdict(self.config).items()] + [("is_fitted", str(self.model is not None))]
        return spark.createDataFrame(rows, "name string, setting string")


class ForecastEvaluator:
    """Scores; ``seasonal_period`` feeds the seasonal error of the item metrics."""

    def __init__(self, quantiles: Sequence[float] = metrics.QUANTILES, seasonal_period: int = 1, freq: str = "D"):
        self.quantiles, self.seasonal_period, self.freq = list(quantiles), seasonal_period, freq

    def evaluate(self, forecasts: DataFrame, truth: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(aggregate metric rows, one row per region)."""
        items = metrics.item_metrics(forecasts, truth, history, self.quantiles, self.seasonal_period, self.freq)
        return metrics.aggregate_metrics(items, self.quantiles), items

    def forecast_metrics(self, forecasts: DataFrame, truth: DataFrame) -> DataFrame:
        return metrics.forecast_metrics(forecasts, truth, self.quantiles)

    def report(
        self,
        forecasts: DataFrame,
        truth: DataFrame,
        parameters: DataFrame | None = None,
        num_cells: int | None = None,
        edges: DataFrame | None = None,
        true_parameters: DataFrame | None = None,
    ) -> DataFrame:
        """Sections whose inputs are given."""
        return metrics.report(
            self.forecast_metrics(forecasts, truth),
            None if parameters is None else metrics.causal_evaluation(parameters, true_parameters),
            None if edges is None else metrics.spatial_metrics(forecasts, truth, edges),
            None if parameters is None or num_cells is None else metrics.interpretability(parameters, num_cells),
        )


class SpatialCausalForecaster:
    """Causal adjustment followed by probabilistic forecasting.

    ``regions`` is the region dimension (``region`` and, for treatment, ``treated``).
    """

    def __init__(
        self, config: ModelConfig, edges: DataFrame, regions: DataFrame | None = None, post: DataFrame | str | None = None
    ):
        treatment = regions if regions is not None and "treated" in regions.columns else None
        self.config, self.edges, self.regions = config, edges, regions
        self.causal = SpatialDiD(edges, treatment, post, config.covariates, config.causal_method)
        self.forecaster = PooledForecaster(config)
        self.causal_fitted = False

    @property
    def is_fitted(self) -> bool:
        return self.forecaster.model is not None

    def fit(self, panel: DataFrame, fit_causal: bool = True) -> SpatialCausalForecaster:
        """The panel, the edges and the adjusted series are written once each; guards and passes read those
        tables instead of repeating the joins."""
        panel = stage(panel)
        panels.require_unique(panel)
        if fit_causal or self.regions is not None:
            self.causal.edges = stage(self.edges)
        if self.regions is not None:
            panels.require_regions(panel, self.regions)
            require_endpoints(self.causal.edges, self.regions)
        if fit_causal:
            self.causal.fit(panel)
            self.causal_fitted = True
            self.forecaster.fit(stage(self.causal.adjust(panel)), "z")
        else:
            warnings.warn("causal inference skipped; using the original targets", stacklevel=2)
            self.forecaster.fit(panel, "y")
        return self

    def predict(
        self, panel: DataFrame, num_samples: int | None = None, adjust: bool = True, future: DataFrame | None = None
    ) -> DataFrame:
        """Only the dates that paths start from are adjusted: a lag needs no other date than its own."""
        if not self.is_fitted:
            raise ValueError("fit the model before predicting")
        if adjust and self.causal_fitted:
            recent = since_tail(panel, ["region"], forecast.reach(self.forecaster.model, self.config.context_length))
            return self.forecaster.predict(self.causal.adjust(recent), "z", num_samples, future)
        return self.forecaster.predict(panel, "y", num_samples, future)

    def evaluate(self, forecasts: DataFrame, truth: DataFrame, history: DataFrame, quantiles=metrics.QUANTILES):
        return ForecastEvaluator(quantiles, freq=self.config.freq).evaluate(forecasts, truth, history)

    def interpretation(self, spark: SparkSession) -> DataFrame:
        if not self.causal_fitted:
            warnings.warn("causal inference was not fitted", stacklevel=2)
            return spark.createDataFrame([], "insight string, meaning string")
        return self.causal.interpretation()

    forecast_summary = staticmethod(forecast.forecast_summary)
    fan_table = staticmethod(forecast.fan_table)

    def summary(self, spark: SparkSession) -> DataFrame:
        """(name, setting): configuration, number of regions, parameters and insights."""
        rows = [("is_fitted", str(self.is_fitted)), *((k, str(v)) for k, v in asdict(self.config).items())]
        table = spark.createDataFrame(rows, "name string, setting string")
        ends = self.regions if self.regions is not None else self.edges.select(F.explode(F.array("i", "j")).alias("region"))
        size = ends.select("region").distinct().agg(F.count(F.lit(1)).cast("string").alias("setting"))
        table = table.unionByName(size.select(F.lit("n_regions").alias("name"), "setting"))
        if not self.causal_fitted:
            return table
        named = self.causal.parameters.select(
            F.when(F.col("param") == "gamma", F.concat_ws("_", "param", "idx")).otherwise(F.col("param")).alias("name"),
            F.col("value").cast("string").alias("setting"),
        )
        insights = self.causal.interpretation().select(F.col("insight").alias("name"), F.col("meaning").alias("setting"))
        return table.unionByName(named).unionByName(insights)

    def save(self, path: str) -> None:
        """Everything that ``load`` needs to predict and interpret."""
        if not self.is_fitted:
            raise ValueError("fit the model before saving it")
        spark, post, fitted = self.edges.sparkSession, self.causal.post, self.causal.result
        save_tables(
            path,
            {
                "parameters": self.causal.parameters,
                "forecaster": self.forecaster.model.table(spark),
                "edges": self.edges,
                "regions": self.regions,
                "post": post if isinstance(post, DataFrame) else None,
            },
            {
                "model": asdict(self.config),
                "autoregression": self.forecaster.model.as_dict(),
                "causal": asdict(fitted) if fitted else None,
                "post_start": post if isinstance(post, str) else None,
            },
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SpatialCausalForecaster:
        tables, config = load_tables(spark, path)
        model = cls(
            ModelConfig(**config["model"]),
            tables["edges"],
            tables.get("regions"),
            tables.get("post", config["post_start"]),
        )
        shape = {k: tuple(v) if isinstance(v, list) else v for k, v in config["autoregression"].items()}
        model.forecaster.model = forecast.Autoregression(**shape)
        if config["causal"]:
            model.causal.result = Fit(**config["causal"])
            model.causal.parameters = tables["parameters"]
            model.causal_fitted = True
        return model

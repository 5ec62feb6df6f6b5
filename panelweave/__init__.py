"""Region-by-time panel analytics as Spark DataFrame programs.

Canonical column names used by every operator:

* panel rows: ``region``, ``t``, ``y`` and any covariate columns, keyed by (region, t)
* spatial edges: ``i``, ``j``, ``w`` (absent edge = weight zero)
* region dimension: ``region`` and attributes such as ``treated``
* forecasts: ``region``, ``step``, ``t``, ``sample_id``, ``value``
* parameters and metrics: tidy rows, one value per row
"""

from panelweave.session import build_session, stage
from panelweave.plans.model import (
    ForecastEvaluator,
    ModelConfig,
    PanelProcessor,
    PooledForecaster,
    SpatialCausalForecaster,
    SpatialDiD,
)

__version__ = "0.1.0"

__all__ = [
    "ForecastEvaluator",
    "ModelConfig",
    "PanelProcessor",
    "PooledForecaster",
    "SpatialCausalForecaster",
    "SpatialDiD",
    "build_session",
    "stage",
]

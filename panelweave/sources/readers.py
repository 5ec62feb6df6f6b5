"""File sources of panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from panelweave.operators.missing import public_health_fill
from panelweave.operators.panel import (
    between_dates,
    chosen_columns,
    densify,
    inline_wide,
    long_panel,
    only_regions,
    parse_time,
    unpivot_wide,
)

# Names of the wide country table and of the long public-health table.
WIDE_COUNTRIES = ["Canada", "France", "Italy", "Spain", "UK", "US"]
WIDE_TARGET = "new_cases"
WIDE_COVARIATES = ["reproduction_rate", "stringency_index", "total_boosters_per_hundred"]
LONG_COUNTRIES = ["United States", "United Kingdom", "France", "Germany", "Italy", "Spain"]
LONG_TARGET = "new_cases"
LONG_COVARIATES = [
    "reproduction_rate",
    "stringency_index",
    "people_vaccinated_per_hundred",
    "icu_patients_per_million",
]


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """CSV (with header) or parquet by suffix. Give CSV a schema to spare the inference scan."""
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if path.endswith(".csv"):
        if schema is None:
            reader = reader.option("inferSchema", True)
        return reader.option("header", True).csv(path)
    if path.endswith(".parquet"):
        return reader.parquet(path)
    raise ValueError(f"unsupported file format: {path}")


def wide_country_panel(
    df: DataFrame, countries: Sequence[str] | None = None, start: str | None = None, end: str | None = None, freq: str = "D"
) -> DataFrame:
    """Panel (region, t, y, covariates) from columns ``<country>_<measure>``.

    Countries without a target column are skipped, absent covariates are NULL; one pass, no
    shuffle. The date window reaches the scan when the column is already a date.
    """
    available = set(df.columns)
    wanted = [c for c in (countries or WIDE_COUNTRIES) if f"{c}_{WIDE_TARGET}" in available]
    if not wanted:
        raise ValueError("no target column of the wanted countries")
    measures = [WIDE_TARGET] + [m for m in WIDE_COVARIATES if any(f"{c}_{m}" in available for c in wanted)]
    columns = {c: {m: f"{c}_{m}" if f"{c}_{m}" in available else None for m in measures} for c in wanted}
    windowed = between_dates(df.withColumn("date", parse_time(F.col("date"), freq)), start, end, "date")
    return inline_wide(windowed, "date", columns, measures, freq).withColumnRenamed(WIDE_TARGET, "y")


def load_wide_country_data(
    spark: SparkSession,
    path: str,
    countries: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    **read_options,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Wide country file → panel, gaps interpolated per region, min-max scaled; with its scalers."""
    from panelweave.plans.model import PanelProcessor

    panel = wide_country_panel(read_table(spark, path, **read_options), countries, start, end)
    covariates = [c for c in panel.columns if c not in ("region", "t", "y")]
    processor = PanelProcessor(covariates=covariates)
    return processor.finish(panel), processor.scalers


def long_country_panel(
    df: DataFrame,
    countries: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    freq: str = "D",
) -> DataFrame:
    """Dense panel from the long public-health table: target gaps 0, covariate gaps repeat the
    region's last value, else 0."""
    covariates = chosen_columns(df, LONG_COVARIATES)
    rows = only_regions(df, countries or LONG_COUNTRIES, "location")
    panel = long_panel(rows, "location", "date", LONG_TARGET, covariates, freq)
    dense = densify(between_dates(panel, start, end), freq)
    return public_health_fill(dense, covariates, freq)


def load_long_country_data(
    spark: SparkSession,
    path: str,
    countries: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    **read_options,
) -> DataFrame:
    return long_country_panel(read_table(spark, path, **read_options), countries, start, end)


def generic_panel(
    df: DataFrame,
    targets: Sequence[str],
    covariates: Sequence[str] = (),
    region: str | None = None,
    date: str = "date",
    freq: str = "D",
) -> DataFrame:
    """Panel from a long table (``region`` given and present; the first target counts) or a wide one
    (each target column is a region; covariates are columns ``<region>_<covariate>``)."""
    if region and region in df.columns:
        return long_panel(df, region, date, targets[0], covariates, freq)
    if not covariates:
        return unpivot_wide(df, date, targets, freq)
    available = set(df.columns)
    columns = {
        r: {"y": r, **{c: f"{r}_{c}" if f"{r}_{c}" in available else None for c in covariates}} for r in targets
    }
    return inline_wide(df, date, columns, ["y", *covariates], freq)

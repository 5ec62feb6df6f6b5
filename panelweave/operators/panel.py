"""Reshaping, alignment and selection of region-by-time panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelweave.functions.scalars import nan_to_null
from panelweave.operators.missing import numeric_columns
from panelweave.operators.ordered import BLOCK_STEPS, block_of, is_calendar, number_rows, tail
from panelweave.operators.tiling import product, tiles_for

__all__ = [
    "attach_calendar",
    "attach_regions",
    "between_dates",
    "calendar_of",
    "chosen_columns",
    "data_info",
    "densify",
    "design_rows",
    "duplicate_cells",
    "inline_wide",
    "long_panel",
    "numeric_columns",
    "only_regions",
    "parse_time",
    "regions_of",
    "require_regions",
    "require_unique",
    "series_records",
    "split_time",
    "tail",
    "temporal_split",
    "treatment_indicator",
    "unpivot_wide",
    "with_post",
]


def parse_time(column: Column, freq: str = "D") -> Column:
    """DATE for daily or coarser steps, zone-less timestamp otherwise."""
    return column.cast("date") if is_calendar(freq) else column.cast("timestamp_ntz")


def between_dates(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "t") -> DataFrame:
    """Inclusive at both ends, each end optional."""
    kind = df.schema[column].dataType
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast(kind))
    return df


def only_regions(df: DataFrame, regions: Sequence[str] | DataFrame, column: str = "region") -> DataFrame:
    """Membership in a short literal list or in a table with the same column."""
    if isinstance(regions, DataFrame):
        return df.join(regions.select(column).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(list(regions)))


def chosen_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that exist."""
    return [c for c in wanted if c in df.columns]


def long_panel(
    df: DataFrame, region: str, date: str, target: str, covariates: Sequence[str] = (), freq: str = "D"
) -> DataFrame:
    """Canonical panel rows from a long table; NaN becomes NULL."""

    def number(c: str) -> Column:
        value = F.col(c).cast("double")
        return nan_to_null(value) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else value

    return df.select(
        F.col(region).alias("region"),
        parse_time(F.col(date), freq).alias("t"),
        number(target).alias("y"),
        *(number(c).alias(c) for c in covariates),
    )


def unpivot_wide(df: DataFrame, date: str, targets: Sequence[str], freq: str = "D") -> DataFrame:
    """Panel rows from a table with one target column per region; the name becomes the region."""
    wide = df.select(parse_time(F.col(date), freq).alias("t"), *(F.col(c).cast("double") for c in targets))
    return wide.unpivot("t", list(targets), "region", "y").select("region", "t", nan_to_null(F.col("y")).alias("y"))


def inline_wide(
    df: DataFrame, date: str, columns: Mapping[str, Mapping[str, str | None]], measures: Sequence[str], freq: str = "D"
) -> DataFrame:
    """Panel rows with several measures from a wide table, in one pass and without a shuffle.

    ``columns[region][measure]`` names the source column; a missing one gives NULL.
    """

    def cell(region: str, measure: str) -> Column:
        name = columns[region].get(measure)
        return (F.lit(None).cast("double") if name is None else nan_to_null(F.col(name).cast("double"))).alias(measure)

    rows = [F.struct(F.lit(r).alias("region"), *(cell(r, m) for m in measures)) for r in columns]
    return df.select(parse_time(F.col(date), freq).alias("t"), F.inline(F.array(*rows))).select("region", "t", *measures)


def regions_of(df: DataFrame) -> DataFrame:
    return df.select("region").distinct()


def calendar_of(df: DataFrame) -> DataFrame:
    return df.select("t").distinct()


def duplicate_cells(df: DataFrame) -> DataFrame:
    """Cells that occur more than once, with their number of rows."""
    return df.groupBy("region", "t").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def require_unique(df: DataFrame) -> DataFrame:
    sample = duplicate_cells(df).take(1)
    if sample:
        raise ValueError(f"duplicate cell in panel: {sample[0].asDict()}")
    return df


def absent_regions(panel: DataFrame, dimension: DataFrame) -> DataFrame:
    """(region, absent_from): regions that only one of the panel and the region dimension names."""
    have, want = regions_of(panel), regions_of(dimension)
    return have.join(want, "region", "left_anti").withColumn("absent_from", F.lit("region dimension")).unionByName(
        want.join(have, "region", "left_anti").withColumn("absent_from", F.lit("panel"))
    )


def require_regions(panel: DataFrame, dimension: DataFrame) -> None:
    """The panel and the region dimension must name the same regions."""
    missing = absent_regions(panel, dimension).take(1)
    if missing:
        raise ValueError(f"region {missing[0]['region']!r} is absent from the {missing[0]['absent_from']}")


def densify(df: DataFrame, freq: str = "D", tiles: int | None = None) -> DataFrame:
    """One row for every (distinct region, distinct date); cells that were absent hold NULL.

    A bounded calendar travels as one array of dates that each region row explodes. Finer
    timelines are matched with the regions tile by tile, in as many tiles as the counts of both ask for.
    """
    regions, dates = regions_of(df), calendar_of(df)
    if is_calendar(freq):
        every_date = dates.agg(F.collect_list("t").alias("dates")).scalar()
        grid = regions.select("region", F.explode(every_date).alias("t"))
    else:
        sides = (tiles, tiles) if tiles else (tiles_for(regions.count()), tiles_for(dates.count()))
        grid = product(regions, dates, ["region"], ["t"], *sides).select("region", "t")
    return grid.join(df, ["region", "t"], "left").select(*df.columns)


def treatment_indicator(regions: DataFrame, treated: Sequence) -> DataFrame:
    """Region dimension with ``treated`` = 1 for the listed regions."""
    return regions.withColumn("treated", F.col("region").isin(list(treated)).cast("int"))


def with_post(df: DataFrame, start: str) -> DataFrame:
    """``post`` = 1 from the start date on, inclusive; needs no join."""
    return df.withColumn("post", (F.col("t") >= F.lit(start).cast(df.schema["t"].dataType)).cast("int"))


def attach_regions(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Region attributes on every cell; a region that the dimension lacks is an error when the attribute is read.
    Spark broadcasts the dimension only below its size threshold."""
    return _attached(df, dimension, "region", "region dimension")


def attach_calendar(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar attributes (such as a ``post`` of any shape) on every cell; a date that the calendar lacks is an
    error when the attribute is read."""
    return _attached(df, calendar, "t", "calendar")


def _attached(df: DataFrame, dimension: DataFrame, key: str, name: str) -> DataFrame:
    """Left join that keeps every row, and raises where a key is unknown."""
    absent = F.raise_error(F.concat(F.lit(f"{key} "), F.col(key).cast("string"), F.lit(f" is absent from the {name}")))
    added = [c for c in dimension.columns if c != key]
    joined = df.join(dimension.withColumn("_known", F.lit(True)), key, "left")
    return joined.select(
        *(F.when(F.col("_known"), F.col(c)).otherwise(absent).alias(c) if c in added else F.col(c) for c in joined.columns if c != "_known")
    )


def design_rows(df: DataFrame, covariates: Sequence[str] = (), lag: str | None = None) -> DataFrame:
    """Regression rows [1, treated, post, treated·post, covariates, lag], whichever exist."""
    terms = [F.lit(1.0).alias("one")]
    terms += [F.col(c).cast("double").alias(c) for c in ("treated", "post") if c in df.columns]
    if {"treated", "post"} <= set(df.columns):
        terms.append((F.col("treated") * F.col("post")).cast("double").alias("treated_post"))
    terms += [F.col(c) for c in covariates]
    if lag:
        terms.append(F.col(lag))
    return df.select("region", "t", "y", *terms)


def split_time(df: DataFrame, test_size: float = 0.2, freq: str = "D"):
    """First test date, read once so that both halves filter by a literal; None without a test date.
    The last int(T·test_size) dates are for testing."""
    dates = number_rows(calendar_of(df), [], freq)
    steps = dates.agg(F.count(F.lit(1)).alias("n")).scalar()
    first_test = steps - F.floor(steps * F.lit(test_size)) + 1
    return dates.where(F.col("rn") >= first_test).agg(F.min("t").alias("cut")).first()["cut"]


def temporal_split(df: DataFrame, test_size: float = 0.2, freq: str = "D") -> tuple[DataFrame, DataFrame]:
    """(train, test) by date; every region is cut at the same date."""
    cut = split_time(df, test_size, freq)
    if cut is None:
        return df, df.limit(0)
    return df.where(F.col("t") < F.lit(cut)), df.where(F.col("t") >= F.lit(cut))


def data_info(df: DataFrame, target: str, covariates: Sequence[str], scaling: str, missing: str) -> DataFrame:
    """One row about a processed panel. Two distinct counts, each combined before its shuffle."""
    regions = regions_of(df).agg(F.count(F.lit(1)).alias("n_regions"))
    return regions.select(
        "n_regions",
        calendar_of(df).agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_timepoints"),
        F.lit(target).alias("target_column"),
        F.lit(",".join(covariates)).alias("covariate_columns"),
        F.lit(scaling).alias("scaling_method"),
        F.lit(missing).alias("handle_missing"),
    )


def series_records(
    df: DataFrame,
    covariates: Sequence[str] = (),
    freq: str = "D",
    static_category: DataFrame | None = None,
    default_start: str | None = None,
    block_steps: int = BLOCK_STEPS,
    future: DataFrame | None = None,
) -> DataFrame:
    """One record per series: start, target array, static category, covariates as K arrays.

    A series of a fine frequency gives one record per calendar block, so that no array grows
    without bound. The default category is the rank of the region (0 first). Covariates known ahead are rows of ``future``
    (region, t, covariates): those after the target's last date lengthen the covariate arrays, not the target.
    """
    keys = ["region"]
    regions = regions_of(df)
    if future is not None:
        cells = df.select("region", "t", "y", *covariates, F.lit(True).alias("_own"))
        last = df.groupBy("region").agg(F.max("t").alias("_last"))
        later = future.join(last, "region").where(F.col("t") > F.col("_last")).select("region", "t", *covariates)
        df = cells.unionByName(later.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    if not is_calendar(freq):
        df = df.withColumn("_block", block_of(F.col("t"), freq, block_steps))
        keys.append("_block")
    rows = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("t", "y", *covariates, *(["_own"] if future is not None else [])))).alias("_cells")
    )
    if static_category is None:
        static_category = ordinal_regions(regions)
    cells = F.col("_cells")
    own = cells if future is None else F.filter(cells, lambda c: c["_own"])
    start = cells[0]["t"] if default_start is None else F.lit(default_start).cast(df.schema["t"].dataType)
    return rows.join(static_category, "region").select(
        "region",
        start.alias("start"),
        own["y"].alias("target"),
        F.array("category").alias("feat_static_cat"),
        F.array(*(cells[c] for c in covariates)).cast("array<array<double>>").alias("feat_dynamic_real"),
    )


def ordinal_regions(regions: DataFrame, slices: int = 128) -> DataFrame:
    """``category`` = rank of each region, 0 first, without a global sort in one task.

    A hash-ordered draw of region names cuts the order into slices of similar size; ranks are
    taken inside a slice and shifted by the sizes of the slices before it.
    """
    bounds = (
        regions.orderBy(F.xxhash64("region"), "region")
        .limit(slices - 1)
        .agg(F.collect_list("region").alias("bounds"))
        .scalar()
    )
    sliced = regions.withColumn("_bounds", bounds).select(
        "region", F.size(F.filter("_bounds", lambda bound: bound <= F.col("region"))).alias("_slice")
    )
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy("region"))
    return (
        sliced.withColumn("_inside", inside)
        .join(offsets, "_slice")
        .select("region", (F.col("_offset") + F.col("_inside") - 1).cast("int").alias("category"))
    )

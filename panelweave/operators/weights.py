"""Spatial weights as edge tables (i, j, w); an absent edge weighs zero."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelweave.functions.scalars import close, ratio
from panelweave.operators.neighbours import Coords, all_pairs, nearest, pairs_within
from panelweave.operators.pair_ranks import largest_distance, median_distance
from panelweave.operators.salting import split_join


def binary_weights(points: DataFrame, coords: Coords, threshold: float) -> DataFrame:
    """1 for every pair at most ``threshold`` apart."""
    if threshold is None:
        raise ValueError("binary weights need a threshold")
    return pairs_within(points, coords, threshold).select("i", "j", F.lit(1.0).alias("w"))


def distance_weights(
    points: DataFrame, coords: Coords, threshold: float | None = None, power: float = 1.0, inverse: bool = True
) -> DataFrame:
    """``1/d^power`` (0 for coincident regions) or ``d^power``, up to an optional threshold.

    Without a threshold every pair has a weight, so the table has N·(N−1) rows.
    """
    pairs = all_pairs(points, coords) if threshold is None else pairs_within(points, coords, threshold)
    grown = F.pow("d", F.lit(float(power)))
    weight = F.when(F.col("d") > 0, 1.0 / grown) if inverse else F.when((F.col("d") > 0) | (F.lit(power) >= 0), grown)
    return pairs.select("i", "j", weight.alias("w")).where("w <> 0")


def knn_weights(points: DataFrame, coords: Coords, k: int) -> DataFrame:
    """1 for the k nearest of each region; directed."""
    return nearest(points, coords, k).select("i", "j", F.lit(1.0).alias("w"))


def custom_weights(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j", F.col("w").cast("double").alias("w")).where("w <> 0")


def contiguity_weights(regions: DataFrame, adjacency: DataFrame | Mapping[str, Sequence[str]] | None) -> DataFrame:
    """1 for each listed (region, neighbour) when both are known; directed, copies collapse."""
    kind = regions.schema["region"].dataType.simpleString()
    spark = regions.sparkSession
    if adjacency is None:
        warnings.warn("no adjacency given; every weight is zero", stacklevel=2)
        return spark.createDataFrame([], f"i {kind}, j {kind}, w double")
    if not isinstance(adjacency, DataFrame):
        rows = [(region, list(neighbours)) for region, neighbours in adjacency.items()]
        adjacency = spark.createDataFrame(rows, f"region {kind}, neighbours array<{kind}>")
    listed = adjacency.select(F.col("region").alias("i"), F.explode("neighbours").alias("j")).distinct()
    known = regions.select("region").distinct()
    return (
        listed.join(known.withColumnRenamed("region", "i"), "i", "left_semi")
        .join(known.withColumnRenamed("region", "j"), "j", "left_semi")
        .select("i", "j", F.lit(1.0).alias("w"))
    )


def kernel_weights(
    points: DataFrame, coords: Coords, kernel: str = "gaussian", bandwidth: float | None = None, cutoff: float | None = None
) -> DataFrame:
    """Gaussian, exponential or linear kernel of the distance; not normalised.

    The default bandwidth is the median distance over i < j (the maximum for the linear kernel), found without a row per
    pair; a bandwidth of zero gives weight 1 to points in the same place. Only the linear kernel is zero far away, so it visits pairs
    within a bandwidth that is given; the other two give all N·(N−1) rows unless a ``cutoff`` is given: pairs
    farther apart have no weight and are not visited. Many points need one.
    """
    if kernel not in ("gaussian", "exponential", "linear"):
        raise ValueError(f"unsupported kernel {kernel!r}")
    found = bandwidth is None
    if found:
        bandwidth = default_bandwidth(points, coords, kernel)
        if bandwidth is None:
            return all_pairs(points, coords, 1).select("i", "j", F.lit(0.0).alias("w")).limit(0)
    reach = [x for x in (cutoff, bandwidth if kernel == "linear" else None) if x is not None]
    if kernel == "linear" and found and cutoff is None:
        # all pairs are within the largest distance: cells would leave out none
        pairs = all_pairs(points, coords).where(F.col("d") <= bandwidth)
    else:
        pairs = pairs_within(points, coords, min(reach)) if reach else all_pairs(points, coords)
    d, h = F.col("d"), F.lit(float(bandwidth))
    if not bandwidth:
        # a point's own place is all that a kernel without width reaches
        return pairs.where(d == 0).select("i", "j", F.lit(1.0).alias("w"))
    weight = {
        "gaussian": F.exp(-(d * d) / (2.0 * h * h)),
        "exponential": F.exp(-d / h),
        "linear": F.greatest(F.lit(0.0), 1.0 - d / h),
    }[kernel]
    return pairs.select("i", "j", weight.alias("w")).where("w <> 0")


def default_bandwidth(points: DataFrame, coords: Coords, kernel: str = "gaussian") -> float | None:
    """Median distance over i < j, the maximum for the linear kernel; None for fewer than two points."""
    return largest_distance(points, coords) if kernel == "linear" else median_distance(points, coords)


def row_normalise(edges: DataFrame, piece_edges: int | None = None) -> DataFrame:
    """Each weight over the sum of its row; rows that sum to zero stay as they are.

    The sums are combined before their shuffle and joined back; the row of a hub is joined in pieces.
    """
    sums = edges.groupBy("i").agg(F.sum("w").alias("_sum"))
    weight = F.when(F.col("_sum") == 0, F.col("w")).otherwise(ratio(F.col("w"), F.col("_sum")))
    return split_join(edges, sums, ["i"], ["j"], piece_edges).select("i", "j", weight.alias("w"))


def spatial_weights(
    regions: DataFrame,
    method: str = "distance",
    *,
    coords: Coords | None = None,
    threshold: float | None = None,
    k: int | None = None,
    weights: DataFrame | None = None,
    adjacency: DataFrame | Mapping[str, Sequence[str]] | None = None,
    normalise: bool = True,
    **options,
) -> DataFrame:
    """Weight factory: ``binary``, ``distance``, ``knn``, ``custom`` or ``contiguity``.

    ``regions`` is the region dimension; for the first three it also holds the coordinates.
    """
    if method in ("binary", "distance", "knn") and coords is None:
        raise ValueError(f"{method!r} weights are made from places: name the coordinate columns")
    if method == "custom":
        if weights is None:
            raise ValueError("custom weights need their edge table")
        edges = custom_weights(weights)
        require_endpoints(edges, regions)
    elif method == "binary":
        edges = binary_weights(regions, coords, threshold)
    elif method == "distance":
        edges = distance_weights(regions, coords, threshold, **options)
    elif method == "knn":
        if k is None:
            raise ValueError("nearest-neighbour weights need the number of neighbours k")
        edges = knn_weights(regions, coords, k)
    elif method == "contiguity":
        edges = contiguity_weights(regions, adjacency)
    else:
        raise ValueError(f"unsupported method {method!r}")
    return row_normalise(edges) if normalise else edges


def strangers(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Endpoints of edges that the region dimension does not know."""
    ends = edges.select(F.explode(F.array("i", "j")).alias("region")).distinct()
    return ends.join(regions.select("region"), "region", "left_anti")


def require_endpoints(edges: DataFrame, regions: DataFrame) -> None:
    unknown = strangers(edges, regions).take(1)
    if unknown:
        raise ValueError(f"edge endpoint {unknown[0]['region']!r} is not a known region")


def asymmetric_edges(edges: DataFrame) -> DataFrame:
    """Edges that differ from their reverse by more than rounding."""
    reverse = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("_back"))
    both = edges.join(reverse, ["i", "j"], "full")
    w, back = F.coalesce("w", F.lit(0.0)), F.coalesce("_back", F.lit(0.0))
    return both.where(~close(w, back))


def validation(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: square, non_negative, zero_diagonal, symmetric and the verdict ``valid``.

    Asymmetry does not make the weights invalid.
    """

    def number(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    checks = edges.agg(
        F.count_if(F.col("w") < 0).alias("negative"),
        F.count_if((F.col("i") == F.col("j")) & (F.abs("w") > 1e-8)).alias("loops"),
    )
    return checks.select(
        (number(strangers(edges, regions)) == 0).alias("square"),
        (F.col("negative") == 0).alias("non_negative"),
        (F.col("loops") == 0).alias("zero_diagonal"),
        (number(asymmetric_edges(edges)) == 0).alias("symmetric"),
    ).withColumn("valid", F.expr("square AND non_negative AND zero_diagonal"))


def is_valid(edges: DataFrame, regions: DataFrame) -> bool:
    row = validation(edges, regions).first()
    for check in ("square", "non_negative", "zero_diagonal"):
        if not row[check]:
            warnings.warn(f"spatial weights fail the check {check!r}", stacklevel=2)
            return False
    if not row["symmetric"]:
        warnings.warn("spatial weights are not symmetric", stacklevel=2)
    return True


def row_col_sums(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Row and column sum of every region, zero where it has no edge; one shuffle."""
    entries = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("i").alias("region"), F.col("w").alias("row_sum"), F.lit(0.0).alias("col_sum")),
                F.struct(F.col("j").alias("region"), F.lit(0.0).alias("row_sum"), F.col("w").alias("col_sum")),
            )
        )
    )
    nothing = regions.select("region", F.lit(0.0).alias("row_sum"), F.lit(0.0).alias("col_sum"))
    return (
        entries.unionByName(nothing)
        .groupBy("region")
        .agg(F.sum("row_sum").alias("row_sum"), F.sum("col_sum").alias("col_sum"))
    )


def statistics(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: n_regions, density, mean/min/max weight, is_symmetric, is_normalised."""
    n = regions.agg(F.count(F.lit(1)).alias("n")).scalar()
    not_one = (
        row_col_sums(edges, regions)
        .agg(F.count_if(~close(F.col("row_sum"), F.lit(1.0))).alias("n"))
        .scalar()
    )
    uneven = asymmetric_edges(edges).agg(F.count(F.lit(1)).alias("n")).scalar()
    positive = F.when(F.col("w") > 0, F.col("w"))
    found = edges.agg(
        F.count_if(F.col("w") != 0).alias("nonzero"),
        F.coalesce(F.avg(positive), F.lit(0.0)).alias("mean_weight"),
        F.coalesce(F.min(positive), F.lit(0.0)).alias("min_weight"),
        F.max("w").alias("top"),
        F.count(F.lit(1)).alias("stored"),
    )
    cells = n.cast("double") * n.cast("double")
    return found.select(
        n.alias("n_regions"),
        ratio(F.col("nonzero").cast("double"), cells).alias("density"),
        "mean_weight",
        F.when(F.col("stored") >= cells, F.col("top"))
        .otherwise(F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.0)))
        .alias("max_weight"),
        "min_weight",
        (uneven == 0).alias("is_symmetric"),
        (not_one == 0).alias("is_normalised"),
    )

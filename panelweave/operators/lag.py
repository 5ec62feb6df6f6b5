"""Spatial lag: the weighted sum over the neighbours of a region, date by date."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from panelweave.operators.salting import hot_keys, in_pieces, repeated

TIME_SLICES = 8


def spatial_lag(
    panel: DataFrame, edges: DataFrame, column: str = "y", out: str = "lag", slices: int = TIME_SLICES, piece_edges: int | None = None
) -> DataFrame:
    """Panel rows plus ``out`` = Σ_j w(i, j)·column(j, t)."""
    return spatial_lags(panel, edges, {out: column}, slices, piece_edges)


def spatial_lags(
    panel: DataFrame, edges: DataFrame, columns: Mapping[str, str], slices: int = TIME_SLICES, piece_edges: int | None = None
) -> DataFrame:
    """Panel rows plus, per entry (name: column), the lag of that column, all summed in one pass.

    Regions without neighbours get 0; one NULL neighbour value makes the lag NULL. The panel must
    be dense (see ``densify``). Each region's dates are spread over ``slices`` join keys, so a long series is shared by
    several tasks. A hub's edges are cut into as many pieces as their number asks for, and only its values are repeated per piece.
    Edges are merged, not broadcast: the size of a stored edge table does not tell that each edge is there once per slice.
    """
    values = panel.select(
        F.col("region").alias("j"), "t", *(F.col(c).alias(f"_x{n}") for n, c in enumerate(columns.values())), F.pmod(F.xxhash64("t"), F.lit(slices)).cast("int").alias("_s")
    )
    hubs = hot_keys(edges, ["j"], piece_edges)
    spread = in_pieces(edges, hubs, ["j"], ["i"]).select("i", "j", "w", "_piece", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_s"))
    sums = (
        repeated(values, hubs, ["j"])
        .join(spread.hint("merge"), ["j", "_s", "_piece"])
        .groupBy(F.col("i").alias("region"), "t")
        .agg(
            *(F.when(F.count(f"_x{n}") == F.count(F.lit(1)), F.sum(F.col("w") * F.col(f"_x{n}"))).alias(f"_sum{n}") for n in range(len(columns))),
            F.lit(True).alias("_has"),
        )
    )
    lagged = {out: F.when(F.col("_has"), F.col(f"_sum{n}")).otherwise(0.0) for n, out in enumerate(columns)}
    return panel.join(sums, ["region", "t"], "left").withColumns(lagged).drop("_has", *(f"_sum{n}" for n in range(len(columns))))

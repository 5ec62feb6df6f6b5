"""Synthetic panels with known seasonality, spill-over and covariate effects."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelweave.functions.hashing import normal, uniform
from panelweave.functions.scalars import total
from panelweave.session import stage

# Slope and season of the trend, spread of the regional draw.
SLOPE, SEASON, REGION = 0.1, 10.0, 2.0
# Covariate effects; a fifth covariate and later ones have none.
EFFECTS = [0.5, -0.3, 0.2, 0.1]
#: Steps that one group chains.
CHAIN_BLOCK = 4_096


def synthetic_panel(
    spark: SparkSession,
    n_regions: int = 6,
    n_timepoints: int = 200,
    n_covariates: int = 4,
    noise_level: float = 0.1,
    seasonal_period: int = 7,
    spatial_correlation: float = 0.3,
    seed: int = 0,
    start: str = "2020-01-01",
) -> DataFrame:
    """(region, t, y, c1 … cK) for regions ``Region_1 …`` and daily dates."""
    cells = spark.range(n_regions * n_timepoints).select(
        F.concat(F.lit("Region_"), (F.floor(F.col("id") / n_timepoints) + 1).cast("string")).alias("region"),
        F.date_add(F.lit(start).cast("date"), (F.col("id") % n_timepoints).cast("int")).alias("t"),
        (F.col("id") % n_timepoints).cast("int").alias("step"),
    )
    return synthetic_values(
        cells, n_covariates, noise_level, seasonal_period, spatial_correlation, seed
    ).drop("step")


def synthetic_values(
    cells: DataFrame,
    n_covariates: int = 4,
    noise_level: float = 0.1,
    seasonal_period: int = 7,
    spatial_correlation: float = 0.3,
    seed: int = 0,
) -> DataFrame:
    """Values for given cells (region, t, step), with step = 0, 1, … along the calendar.

    The spill-over uses the previous mean over regions before clipping. That mean obeys
    m[t] = b[t] + ρ·m[t−1] with b[t] the mean of the rest, so only one number per date is chained, in blocks of dates.
    A missing step breaks the chain.
    """

    def draw(slot: str):
        return normal(uniform(seed, "region", "step", F.lit(slot + "u")), uniform(seed, "region", "step", F.lit(slot + "v")))

    names = [f"c{k + 1}" for k in range(n_covariates)]
    step = F.col("step").cast("double")
    trend = SLOPE * step + SEASON * F.sin(2 * math.pi * step / seasonal_period)
    effects = [F.lit(b) * F.col(c) for b, c in zip(EFFECTS, names)]
    own = total([trend, REGION * draw("r"), noise_level * draw("e"), *effects])
    base = cells.withColumns({c: draw(c) for c in names}).withColumn("_own", own)
    means = base.groupBy(F.col("step").cast("bigint").alias("k")).agg(F.avg("_own").alias("e")).withColumn("f", F.lit(float(spatial_correlation)))
    chain = chained(means).select((F.col("k") + 1).cast(cells.schema["step"].dataType).alias("step"), F.col("m"))
    y = F.greatest(F.lit(0.0), F.col("_own") + spatial_correlation * F.coalesce("m", F.lit(0.0)))
    return base.join(chain, "step", "left").select("region", "t", "step", y.alias("y"), *names)


def chained(rows: DataFrame, block: int = CHAIN_BLOCK) -> DataFrame:
    """(k, m) with m[k] = e[k] + f[k]·m[k−1] for rows (k, e, f); the row after a missing k starts anew.

    A block of consecutive k is chained as if nothing came before it, together with the factor by which what came before enters each of its
    rows. The ends of the blocks are rows of the same kind, so they are chained in the same way until one block is left.
    """
    blocked = rows.withColumn("b", F.floor(F.col("k") / block))

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        first, k = int(group["b"].iloc[0]) * block, group["k"].tolist()
        made, reach = [], []
        for n, (at, e, f) in enumerate(zip(k, group["e"], group["f"])):
            follows = n > 0 and k[n - 1] == at - 1
            made.append(e + f * made[-1] if follows else e)
            reach.append(f * reach[-1] if follows else f if at == first else 0.0)
        return pd.DataFrame({"b": group["b"], "k": group["k"], "m": made, "r": reach})

    local = stage(blocked.groupBy("b").applyInPandas(inside, "b bigint, k bigint, m double, r double"))
    blocks = local.agg(F.count_distinct("b")).first()[0]
    if blocks <= 1:
        return local.select("k", "m")
    # a block that does not reach its last step hands nothing on
    ends = local.where(F.col("k") == (F.col("b") + 1) * block - 1).select(F.col("b").alias("k"), F.col("m").alias("e"), F.col("r").alias("f"))
    before = chained(ends, block).select((F.col("k") + 1).alias("b"), F.col("m").alias("carried"))
    return local.join(before, "b", "left").select("k", (F.col("m") + F.col("r") * F.coalesce("carried", F.lit(0.0))).alias("m"))

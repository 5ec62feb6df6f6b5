"""Queries whose result is every pair take them over all suppliers, not over the fixed nations."""

import math

import numpy as np
import pytest
from helpers import plan_of, points
from pyspark.sql import functions as F

import __spark_entry__ as driver
from panelweave.functions.scalars import rounded
from panelweave.operators import neighbours, tiling, weights
from panelweave.plans import fixtures as fx


@pytest.fixture
def tables(spark, folder):
    """40 suppliers of which two sit at one place, and 5 nations."""
    keys = [*range(1, 40), 4_000]
    spark.createDataFrame([(k, k % 5) for k in keys], "s_suppkey bigint, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(n, n % 2) for n in range(5)], "n_nationkey int, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    return folder


def places(spark, tables):
    return {r["region"]: (r["x"], r["y"]) for r in fx.supplier_points(spark, tables).collect()}


@pytest.mark.parametrize("name", ["dist_pairs", "w_distance_full", "w_gaussian", "w_exponential", "w_linear"])
def test_every_pair_of_suppliers(spark, tables, name):
    at = places(spark, tables)
    apart = {(i, j): math.dist(at[i], at[j]) for i in at for j in at if i != j}
    got = [(r["i"], r["j"]) for r in driver.queries()[name](spark, tables).collect()]
    # an inverse distance of zero has no weight, a kernel that ends at the largest distance none there
    kept = {"w_distance_full": lambda d: d > 0, "w_linear": lambda d: d < max(apart.values())}.get(name, lambda d: True)
    assert len(got) == len(set(got)) and set(got) == {p for p, d in apart.items() if kept(d)}


def test_default_linear_kernel_is_spread_over_tasks(spark):
    """The cells of the largest distance put all pairs into one task."""
    df, coords = points(spark, np.random.default_rng(5).random((700, 2)))
    edges = weights.kernel_weights(df, coords, "linear")
    assert edges.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_pairs_are_rounded_like_spark(spark):
    rng = np.random.default_rng(6)
    values = [*rng.normal(0, 1, 3_000), *rng.normal(0, 1e4, 3_000), *(rng.integers(-10**7, 10**7, 3_000) / 2e6 + 5e-7), *(10.0 ** rng.uniform(-12, 18, 1_000))]
    values += [0.0, -0.0, -4e-7, 5e-7, -5e-7, 1.0000005, 2.5e-6, 1e300, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    for digits in (6, 3):
        got = df.select(F.col("v"), rounded(F.col("v"), digits).alias("a"), F.round("v", digits).alias("b"))
        assert got.where("NOT a <=> b").count() == 0


def test_chunks_repeat_few_rows(spark):
    """Tiles of 256 points sent each of 360 000 points 2 800 times."""
    chunks = neighbours._chunk_count(360_000)
    assert chunks < 400 and max(neighbours._chunk_count(n) for n in (10, 255)) == 1
    df = spark.range(2_000).select("id")
    a, b = tiling.chunk_sides(df, df.withColumnRenamed("id", "other"), ["id"], 3, 8)
    assert a.count() == 2_000 * 8 and b.count() == 3 * 8
    assert b.agg(F.max(F.size("_rows"))).first()[0] <= 2_000 / 8 + 8


def test_all_pairs_keep_copies_and_drop_unknown_keys(spark):
    rows = [(1, 0.0), (1, 3.0), (2, 4.0), (2, 4.0), (3, None), (None, 1.0)]
    df = spark.createDataFrame(rows, "region bigint, x double")
    expected = sorted(((i, j, None if x is None or y is None else abs(x - y)) for i, x in rows for j, y in rows if None not in (i, j) and i != j), key=repr)
    for tiles in (None, 3):
        pairs = neighbours.all_pairs(df, ["x"], tiles)
        assert sorted((tuple(r) for r in pairs.select("i", "j", "d").collect()), key=repr) == expected
    assert "Broadcast" not in plan_of(pairs) and "SortMergeJoin" not in plan_of(pairs)

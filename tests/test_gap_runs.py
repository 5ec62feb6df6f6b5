"""One row per gap against the dense grid."""

import datetime as dt

import pytest
from helpers import panel, same_rows
from pyspark.sql import functions as F

from panelweave.operators import gap_runs, missing, panel as panels, scaling

N = None
START = dt.datetime(2024, 1, 1)


def sparse(spark, regions=(("hot", 90, 1), ("a", 60, 7), ("b", 61, 20), ("empty", 60, 9), ("one", 34, 33))):
    """Hours with gaps: the first region has every third hour unseen, others few hours; values may be NULL in observed rows."""
    rows = []
    for region, length, step in regions:
        for n in range(0, length, step):
            if step == 1 and n % 3 == 1 or region == "one" and n == 0:
                continue
            value = None if region == "empty" or n % 5 == 4 else float((n * 7) % 11) - 3
            rows.append((region, START + dt.timedelta(hours=n), value, float(n % 4)))
    return spark.createDataFrame(rows, "region string, t timestamp_ntz, y double, c1 double").repartition(3)


def agree(df, freq, steps):
    dense = panels.densify(df, freq)
    runs, dates = gap_runs.coded(df, freq=freq, block_steps=steps), gap_runs.numbered_calendar(df, freq, steps)
    assert same_rows(gap_runs.unfold(runs, dates, "interpolate", 5), missing.interpolate_linear(dense, freq=freq, block_steps=10_000))
    assert same_rows(gap_runs.unfold(runs, dates, "ffill", 1000), missing.forward_fill(dense, freq=freq, block_steps=10_000))
    assert same_rows(gap_runs.unfold(runs, dates, "none"), dense)
    for fill, filled in (("interpolate", missing.interpolate_linear(dense, freq=freq)), ("ffill", missing.forward_fill(dense, freq=freq)), ("none", dense)):
        means = [m for c in ("y", "c1") for m in (F.count(c).alias(c + "_n"), F.avg(c).alias(c + "_mean"))]
        assert same_rows(gap_runs.filled_means(runs, fill), filled.groupBy("region").agg(*means))
    for width in (1, 6, 70):
        cells = gap_runs.positions(gap_runs.window_scales(df, width, freq=freq, block_steps=steps), 7).join(dates, "pos").select("region", "t", "scale")
        assert same_rows(cells, scaling.window_mean_scale(dense, width, freq=freq, block_steps=10_000).select("region", "t", "scale"))


@pytest.mark.parametrize("steps", [3, 1000])
def test_hours_equal_the_dense_grid(spark, steps):
    agree(sparse(spark), "h", steps)


def test_days_equal_the_dense_grid(spark):
    values = {"a": [(N, 1), (2, N), (N, N), (5, 3)], "b": [(1, N)], "c": [(N, N)] * 2}
    late = panel(spark, {"b": [(7, 7)], "d": [(N, 2)]}, ("y", "c1"), start=20)
    agree(panel(spark, values, ("y", "c1")).unionByName(late), "D", 1000)


def test_rows_follow_observed_cells(spark):
    """One region fills the calendar of 5 000 hours, fifty see one hour in a hundred."""
    hours = spark.range(5000).select(F.lit("all").alias("region"), F.col("id").alias("n"))
    few = spark.range(50).select(F.concat(F.lit("r"), F.col("id")).alias("region"), F.explode(F.sequence(F.col("id"), F.lit(4999), F.lit(100))).alias("n"))
    df = hours.unionByName(few).select("region", F.timestamp_add("HOUR", "n", F.lit(START).cast("timestamp_ntz")).alias("t"), F.col("n").cast("double").alias("y"))
    observed = df.count()
    runs = gap_runs.coded(df, ["y"], "h", block_steps=512)
    assert runs.count() <= 2 * observed + 51 < 51 * 5000 / 10
    assert runs.agg(F.sum("length")).first()[0] == 51 * 5000
    scales = gap_runs.window_scales(df, 24, freq="h", block_steps=512)
    assert scales.count() <= 2 * observed + 51
    assert scales.agg(F.sum("length")).first()[0] == 51 * 5000


def test_odd_tables(spark):
    empty = sparse(spark).limit(0)
    assert gap_runs.coded(empty, freq="h").count() == 0
    assert gap_runs.window_scales(empty, 3, freq="h").count() == 0
    df = sparse(spark)
    nameless = df.unionByName(df.limit(1).withColumn("region", F.lit(None).cast("string"))).unionByName(df.limit(1).withColumn("t", F.lit(None).cast("timestamp_ntz")))
    assert same_rows(gap_runs.coded(nameless, freq="h"), gap_runs.coded(df, freq="h"))
    with pytest.raises(ValueError):
        gap_runs.unfold(gap_runs.coded(df, freq="h"), gap_runs.numbered_calendar(df, "h"), "guess")
    with pytest.raises(ValueError):
        gap_runs.window_scales(df, 0, freq="h")

"""Sources, reshaping and guards."""

import datetime as dt

import pandas as pd
import pytest
from helpers import by_key, day, panel, plan_of, same_rows, series
from pyspark.sql import functions as F

from panelweave import PanelProcessor
from panelweave.operators import panel as panels
from panelweave.sources import readers
from panelweave.sources.synthetic import chained, synthetic_panel

N = None


def test_formats(spark, folder):
    pd.DataFrame({"date": ["2020-01-01"], "v": [1.5]}).to_csv(f"{folder}/a.csv", index=False)
    pd.DataFrame({"v": [2.5]}).to_parquet(f"{folder}/a.parquet")
    assert readers.read_table(spark, f"{folder}/a.csv").first()["v"] == 1.5
    assert readers.read_table(spark, f"{folder}/a.csv", "date date, v double").first()["date"] == dt.date(2020, 1, 1)
    assert readers.read_table(spark, f"{folder}/a.parquet").first()["v"] == 2.5
    with pytest.raises(ValueError, match="unsupported file format"):
        readers.read_table(spark, f"{folder}/a.xlsx")


def test_wide_country_file(spark, folder):
    pd.DataFrame(
        {
            "date": ["2020-01-03", "2020-01-01", "2020-01-02", "2020-01-04"],
            "Canada_new_cases": [3, 1, N, 8],
            "Canada_reproduction_rate": [1.0, 2.0, 3.0, 9.0],
            "Italy_new_cases": [10, 20, 30, 80],
            "Italy_stringency_index": [5.0, 5.0, 6.0, 9.0],
        }
    ).to_csv(f"{folder}/wide.csv", index=False)
    raw = readers.wide_country_panel(readers.read_table(spark, f"{folder}/wide.csv"), end="2020-01-03")
    assert raw.columns == ["region", "t", "y", "reproduction_rate", "stringency_index"]
    assert series(raw) == {"Canada": [1, None, 3], "Italy": [20, 30, 10]}
    assert series(raw, "stringency_index")["Canada"] == [None] * 3
    assert "Exchange" not in plan_of(raw)
    scaled, scalers = readers.load_wide_country_data(spark, f"{folder}/wide.csv", end="2020-01-03")
    assert series(scaled)["Canada"] == pytest.approx([0, 1 / 29, 2 / 29])
    assert scalers["y"].first()["shift"] == 1
    with pytest.raises(ValueError):
        readers.wide_country_panel(spark.range(1).withColumn("date", F.lit("2020-01-01")))


def test_long_country_file(spark, folder):
    pd.DataFrame(
        {
            "date": ["2020-01-02", "2020-01-01", "2020-01-02", "2020-01-03", "2020-01-03"],
            "location": ["France", "France", "Spain", "Spain", "Peru"],
            "new_cases": [N, 4, 7, 9, 1],
            "reproduction_rate": [N, 1.5, N, 2.5, 1],
        }
    ).to_csv(f"{folder}/long.csv", index=False)
    got = readers.load_long_country_data(spark, f"{folder}/long.csv")
    assert series(got) == {"France": [4, 0, 0], "Spain": [0, 7, 9]}
    assert series(got, "reproduction_rate") == {"France": [1.5, 1.5, 1.5], "Spain": [0, 0, 2.5]}


def test_generic_layouts(spark):
    long = spark.createDataFrame(
        [("2020-01-01", "a", 1.0, 2.0), ("2020-01-02", "a", float("nan"), 3.0)], "date string, place string, v double, c double"
    )
    assert series(readers.generic_panel(long, ["v"], ["c"], "place"))["a"] == [1, None]
    wide = spark.createDataFrame([("2020-01-01", 1.0, 2.0, 5.0)], "date string, p double, q double, p_c double")
    assert series(readers.generic_panel(wide, ["p", "q"])) == {"p": [1], "q": [2]}
    assert series(readers.generic_panel(wide, ["p", "q"], ["c"]), "c") == {"p": [5], "q": [None]}


def test_processor(spark, folder):
    pd.DataFrame({"date": ["2020-01-01", "2020-01-02", "2020-01-03"] * 2, "place": ["a"] * 3 + ["b"] * 3, "v": [1, N, 3, 5, 6, 7], "c": range(6)}).to_parquet(
        f"{folder}/p.parquet"
    )
    processor = PanelProcessor(["v"], ["c"], "place")
    scaled = processor.load(spark, f"{folder}/p.parquet")
    assert series(scaled)["a"] == pytest.approx([0, 1 / 6, 1 / 3])
    assert series(processor.inverse_targets(scaled))["a"] == pytest.approx([1, 2, 3])
    assert series(processor.inverse_covariates(scaled), "c")["b"] == pytest.approx([3, 4, 5])
    info = processor.info().first()
    assert (info["n_regions"], info["n_timepoints"], info["scaling_method"]) == (2, 3, "minmax")


def test_densify_gives_every_cell(spark):
    df = panel(spark, {"a": [1, 2], "b": [5]}).unionByName(panel(spark, {"c": [9]}, start=4))
    got = by_key(panels.densify(df), "region", "t")
    assert len(got) == 9 and got[("c", day(0))]["y"] is None and got[("c", day(4))]["y"] == 9
    hourly = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    fine = panels.densify(hourly, "h").withColumn("t", F.col("t").cast("date"))
    assert same_rows(fine, panels.densify(df))
    for plan in (plan_of(panels.densify(df)), plan_of(panels.densify(hourly, "h"))):
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_duplicates_and_region_guards(spark):
    df = panel(spark, {"a": [1, 2]})
    doubled = df.unionByName(df.limit(1))
    assert panels.duplicate_cells(doubled).count() == 1
    with pytest.raises(ValueError, match="duplicate"):
        panels.require_unique(doubled)
    panels.require_regions(df, spark.createDataFrame([("a",)], "region string"))
    for names in (["a", "b"], ["b"]):
        with pytest.raises(ValueError, match="absent"):
            panels.require_regions(df, spark.createDataFrame([(n,) for n in names], "region string"))


def test_indicators(spark):
    df = panels.with_post(panel(spark, {"a": [1, 2, 3], "b": [4, 5, 6]}), "2020-01-02")
    dimension = panels.treatment_indicator(panels.regions_of(df), ["b"])
    rows = panels.design_rows(panels.attach_regions(df, dimension))
    got = by_key(rows, "region", "t")
    assert got[("b", day(1))]["treated_post"] == 1 and got[("b", day(0))]["treated_post"] == 0
    assert got[("a", day(2))]["post"] == 1 and got[("a", day(2))]["treated"] == 0


def test_filter_reaches_the_scan(spark, folder):
    panel(spark, {"a": range(5)}).write.parquet(f"{folder}/p")
    read = spark.read.parquet(f"{folder}/p")
    plan = plan_of(panels.between_dates(read, "2020-01-02", "2020-01-03").select("y"))
    assert "GreaterThanOrEqual(t,2020-01-02)" in plan and "ReadSchema: struct<t:date,y:double>" in plan
    assert panels.between_dates(read, "2020-01-02", "2020-01-03").count() == 2


def test_series_records(spark):
    df = panel(spark, {"b": [(1, 5), (2, 6)], "a": [(3, 7), (N, 8)]}, ("y", "c1"))
    got = by_key(panels.series_records(df, ["c1"]), "region")
    assert got[("a",)] == {"start": day(0), "target": [3, None], "feat_static_cat": [0], "feat_dynamic_real": [[7, 8]]}
    assert got[("b",)]["feat_static_cat"] == [1]
    assert panels.series_records(df, default_start="2020-01-01").first()["feat_dynamic_real"] == []


def test_region_ranks_over_many_slices(spark):
    regions = spark.range(1000).select(F.concat(F.lit("r"), F.col("id")).alias("region"))
    ranks = {r["region"]: r["category"] for r in panels.ordinal_regions(regions, 16).collect()}
    assert ranks == {name: n for n, name in enumerate(sorted(ranks))} and len(ranks) == 1000


def test_synthetic(spark):
    df = synthetic_panel(spark, 3, 50, 2, seed=42)
    assert df.count() == 150 and df.columns == ["region", "t", "y", "c1", "c2"]
    assert df.where("y < 0").count() == 0
    assert same_rows(df, synthetic_panel(spark, 3, 50, 2, seed=42).repartition(5))
    assert df.agg(F.avg("y")).first()[0] > 1


def test_synthetic_chain_follows_the_definition(spark):
    import math

    quiet = by_key(synthetic_panel(spark, 2, 12, 0, noise_level=0.0, spatial_correlation=0.0, seed=3), "region", "t")
    chained = by_key(synthetic_panel(spark, 2, 12, 0, noise_level=0.0, spatial_correlation=0.5, seed=3), "region", "t")
    # early dates stay positive, so clipping does not hide the recursion
    mean = {n: sum(quiet[(f"Region_{i}", day(n))]["y"] for i in (1, 2)) / 2 for n in (1, 2)}
    first = sum(chained[(f"Region_{i}", day(1))]["y"] for i in (1, 2)) / 2
    second = sum(chained[(f"Region_{i}", day(2))]["y"] for i in (1, 2)) / 2
    assert second == pytest.approx(mean[2] + 0.5 * first)
    assert math.isfinite(first)


@pytest.mark.parametrize("block", [1, 3, 4, 1000])
def test_chain_over_blocks_and_gaps(spark, block):
    rows = [(k, 1.0 + k % 5, 0.5 if k % 7 else -1.5) for k in range(40) if k not in (4, 11, 12, 27)]
    expected, before = {}, None
    for k, e, f in rows:
        expected[k] = e + (f * expected[before] if before == k - 1 else 0.0)
        before = k
    if block == 1:
        block = 2
    got = {r["k"]: r["m"] for r in chained(spark.createDataFrame(rows, "k bigint, e double, f double"), block).collect()}
    assert got == pytest.approx(expected)


def test_absent_regions(spark):
    df = panel(spark, {"a": [1], "b": [2]})
    other = panels.absent_regions(df, spark.createDataFrame([("b",), ("c",), ("c",)], "region string"))
    assert {tuple(r) for r in other.collect()} == {("a", "region dimension"), ("c", "panel")} and other.count() == 2


def test_records_with_covariates_ahead(spark):
    df = panel(spark, {"a": [(1, 10), (2, 20)], "b": [(3, 30), (None, 40)]}, ("y", "c1"))
    ahead = spark.createDataFrame([("a", dt.date(2020, 1, 1), 0.0), ("a", dt.date(2020, 1, 3), 30.0), ("a", dt.date(2020, 1, 4), None), ("z", dt.date(2020, 1, 9), 1.0)], "region string, t date, c1 double")
    got = by_key(panels.series_records(df, ["c1"], future=ahead), "region")
    assert got[("a",)]["target"] == [1, 2] and got[("a",)]["feat_dynamic_real"] == [[10, 20, 30, None]]
    assert got[("b",)]["target"] == [3, None] and got[("b",)]["feat_dynamic_real"] == [[30, 40]]
    assert len(got) == 2

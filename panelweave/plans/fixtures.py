"""Panels, region dimensions, weights and ensembles over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelweave.operators import panel as panels, weights
from panelweave.operators.lag import spatial_lag
from panelweave.operators.missing import zero_fill
from panelweave.operators.ordered import over_neighbourhood, tail
from panelweave.session import stage
from panelweave.sources.readers import read_table

POST_START = "1998-05-01"
NEAR = 6.0
HORIZON = 6
MEMBERS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def month(c: str) -> Column:
    return F.trunc(F.col(c).cast("date"), "month")


def hour(c: str) -> Column:
    """Start of the hour of a zone-less timestamp."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("HOUR", F.timestamp_diff("HOUR", epoch, F.col(c)), epoch)


def nation_panel(spark: SparkSession, sf_dir: str, months: tuple[str, str] | None = None) -> DataFrame:
    """Orders per customer nation and month, of the whole table or of the months from the first to the last given,
    which the scan then skips by date. Orders are combined per customer and month before they
    meet the customers, so a customer with very many orders costs 80 rows, not all of them."""
    orders = table(spark, sf_dir, "orders")
    if months:
        after = F.add_months(F.lit(months[1]).cast("date"), 1).cast("timestamp_ntz")
        orders = orders.where((F.col("o_orderdate") >= F.lit(months[0]).cast("timestamp_ntz")) & (F.col("o_orderdate") < after))
    urgent = F.col("o_orderpriority").startswith("1").cast("int")
    per_customer = orders.groupBy("o_custkey", month("o_orderdate").alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor("o_totalprice")).alias("price"), F.sum(urgent).alias("urgent")
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region"))
    return (
        per_customer.join(customers, "o_custkey")
        .groupBy("region", "t")
        .agg(F.sum("n").alias("n"), F.sum("price").alias("price"), F.sum("urgent").alias("urgent"))
        .select(
            "region",
            "t",
            F.col("n").cast("double").alias("y"),
            (F.col("price") / F.col("n")).alias("c1"),
            (F.col("urgent") / F.col("n")).alias("c2"),
        )
    )


def segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table by market segment and order day, named like the public-health source."""
    orders = table(spark, sf_dir, "orders")
    per_customer = orders.groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor("o_totalprice")).alias("price")
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("location"))
    return (
        per_customer.join(customers, "o_custkey")
        .groupBy("location", "date")
        .agg(F.sum("n").alias("n"), F.sum("price").alias("price"))
        .select(
            "location",
            "date",
            F.col("n").cast("double").alias("new_cases"),
            (F.col("price") / F.col("n")).alias("reproduction_rate"),
            (F.col("n") * 2.0).alias("stringency_index"),
        )
    )


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped per supplier and month."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("region"), month("l_shipdate").alias("t")).agg(
        F.sum("l_quantity").alias("y"), F.avg("l_discount").alias("c1"), F.avg("l_tax").alias("c2")
    )


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value per user and day."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("region"), F.col("ts").cast("date").alias("t")).agg(
        F.sum("value").alias("y"), F.count(F.lit(1)).cast("double").alias("c1")
    )


def type_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value per type and hour: few long series of a fine frequency."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("region"), hour("ts").alias("t")).agg(
        F.sum("value").alias("y"), F.count(F.lit(1)).cast("double").alias("c1")
    )


def dense(panel: DataFrame, freq: str = "D") -> DataFrame:
    """The dense grid reads its panel three times (regions, dates, values), so the aggregate over
    the raw table is written once first."""
    return panels.densify(stage(panel), freq)


def filled(panel: DataFrame, freq: str = "M") -> DataFrame:
    return zero_fill(dense(panel, freq))


def on_strip(key: Column) -> tuple[Column, Column]:
    """Whole-number coordinates of constant density, whatever the number of keys, with ties."""
    x = F.floor(key / 100) * 3 + (key * 37) % 7
    y = (key % 100) * 3 + (key * 53) % 5
    return x.cast("double"), y.cast("double")


def nation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        key.alias("region"),
        ((key * 37) % 101).cast("double").alias("x"),
        ((key * 53) % 97).cast("double").alias("y"),
        F.col("n_regionkey"),
        F.col("n_regionkey").isin(0, 1).cast("int").alias("treated"),
    )


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of the same world region touch: row-normalised contiguity."""
    nations = nation_points(spark, sf_dir)
    members = nations.groupBy("n_regionkey").agg(F.collect_list("region").alias("members"))
    adjacency = nations.join(members, "n_regionkey").select(
        "region", F.filter("members", lambda m: m != F.col("region")).alias("neighbours")
    )
    return weights.spatial_weights(nations, "contiguity", adjacency=adjacency)


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    x, y = on_strip(key)
    return table(spark, sf_dir, "supplier").select(
        key.alias("region"), x.alias("x"), y.alias("y"), (key % 5 <= 1).cast("int").alias("treated")
    )


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    x, y = on_strip(key)
    return table(spark, sf_dir, "customer").select(key.alias("region"), x.alias("x"), y.alias("y"))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("region"), "embedding")


def supplier_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier lists the keys next to it and ten on; the ends list unknown keys."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("region"), F.array(key - 1, key + 1, key + 10).alias("neighbours")
    )


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.spatial_weights(
        supplier_points(spark, sf_dir), "contiguity", adjacency=supplier_adjacency(spark, sf_dir)
    )


def nation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense nation panel with treatment and post."""
    panel = filled(nation_panel(spark, sf_dir))
    dimension = nation_points(spark, sf_dir).select("region", "treated")
    return panels.with_post(panels.attach_regions(panel, dimension), POST_START)


def supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = filled(supplier_panel(spark, sf_dir))
    dimension = supplier_points(spark, sf_dir).select("region", "treated")
    return panels.with_post(panels.attach_regions(panel, dimension), POST_START)


def supplier_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial_lag(filled(supplier_panel(spark, sf_dir)), supplier_edges(spark, sf_dir))


def ensemble(panel: DataFrame, freq: str = "M") -> tuple[DataFrame, DataFrame]:
    """(forecasts, truth) of the last ``HORIZON`` dates: member k repeats the value k dates earlier."""
    members = over_neighbourhood(
        panel,
        ["region"],
        freq,
        MEMBERS,
        0,
        lambda w: {"_members": F.array(*(F.lag("y", k).over(w) for k in range(1, MEMBERS + 1)))},
    )
    last = tail(members, ["region"], HORIZON)
    forecasts = last.select("region", "t", F.posexplode("_members").alias("_at", "value")).select(
        "region", "t", (F.col("_at") + 1).alias("sample_id"), "value"
    )
    return forecasts, tail(panel.select("region", "t", "y"), ["region"], HORIZON)

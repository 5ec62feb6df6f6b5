"""Sparse series on a dense calendar, with one row per gap instead of one per absent cell.

The calendar holds every date of the panel, numbered from 1. A *run* is a stretch of cells of one region that are filled by one
rule: (region, start, length) and per column the closest known value on either side, ``<c>_left`` and ``<c>_right``, as structs
of (pos, val). An observed row is a run of length 1 and the absent cells between two rows are one run, so there are at most two
runs per row and one per region, however fine the calendar is. Fills, their sums and window scales read runs only; cells
appear where ``unfold`` is asked for them. Results equal those of the dense grid.

A column without a value left and right is NULL there. An empty panel has no runs; each cell must occur once, and rows
without a region or date are left out. Read panels several times over, so stage expensive ones first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelweave.operators.missing import numeric_columns
from panelweave.operators.ordered import BLOCK_STEPS, is_calendar, nearest_known, number_rows
from panelweave.operators.panel import calendar_of, regions_of

FILLS = ("interpolate", "ffill", "none")


def numbered_calendar(df: DataFrame, freq: str = "D", block_steps: int = BLOCK_STEPS) -> DataFrame:
    """(t, pos): every date of the panel in order, from 1."""
    return number_rows(calendar_of(df.where("t IS NOT NULL")), [], freq, "pos", block_steps)


def _part(pos: Column, block_steps: int) -> Column:
    return F.floor((pos - 1) / block_steps).cast("bigint")


def _following(df: DataFrame, columns: Sequence[str], freq: str, block_steps: int) -> DataFrame:
    """``_after``: position and ``columns`` of the region's next row; what lies beyond a block comes from the first row of the next one."""
    row = F.struct("pos", *columns)
    if is_calendar(freq):
        return df.withColumn("_after", F.lead(row).over(Window.partitionBy("region").orderBy("pos")))
    parts = df.withColumn("_part", _part(F.col("pos"), block_steps))
    firsts = parts.groupBy("region", "_part").agg(F.min_by(row, "pos").alias("_first"))
    beyond = firsts.select("region", "_part", F.lead("_first").over(Window.partitionBy("region").orderBy("_part")).alias("_beyond"))
    inside = parts.withColumn("_after", F.lead(row).over(Window.partitionBy("region", "_part").orderBy("pos")))
    return inside.join(beyond, ["region", "_part"]).withColumn("_after", F.coalesce("_after", "_beyond")).drop("_part", "_beyond")


def coded(df: DataFrame, columns: Sequence[str] | None = None, freq: str = "D", block_steps: int = BLOCK_STEPS) -> DataFrame:
    """The runs of a panel whose absent cells have no rows."""
    columns = list(columns or numeric_columns(df))
    dates = numbered_calendar(df, freq, block_steps)
    last = dates.agg(F.max("pos")).scalar()
    rows = df.where("region IS NOT NULL").select("region", "t", *columns).join(dates, "t")
    known = nearest_known(rows, ["region"], columns, freq, True, True, "pos", block_steps)
    ahead = ["_next_" + c for c in columns]
    placed = _following(known, ahead, freq, block_steps).withColumn("_end", F.coalesce(F.col("_after")["pos"], last + 1))

    def run(start: Column, length: Column, left, right) -> Column:
        sides = [side for c in columns for side in (left(c).alias(c + "_left"), right(c).alias(c + "_right"))]
        return F.struct(start.alias("start"), length.cast("bigint").alias("length"), *sides)

    pos = F.col("pos")
    cell = run(pos, F.lit(1), lambda c: F.col("_prev_" + c), lambda c: F.col("_next_" + c))
    gap = run(pos + 1, F.col("_end") - pos - 1, lambda c: F.col("_prev_" + c), lambda c: F.col("_after")["_next_" + c])
    runs = placed.select("region", F.inline(F.array(cell, gap)))
    first = known.groupBy("region").agg(F.min_by(F.struct("pos", *ahead), "pos").alias("_first"))
    nothing = {c: F.lit(None).cast(known.schema["_prev_" + c].dataType) for c in columns}
    lead = run(F.lit(1).cast("bigint"), F.col("_first")["pos"] - 1, nothing.get, lambda c: F.col("_first")["_next_" + c])
    return runs.unionByName(first.select("region", F.inline(F.array(lead)))).where("length > 0")


def _columns(runs: DataFrame) -> list[str]:
    return [c[: -len("_left")] for c in runs.columns if c.endswith("_left")]


def _slope(c: str) -> Column:
    left, right = F.col(c + "_left"), F.col(c + "_right")
    return F.when(right["pos"] > left["pos"], (right["val"] - left["val"]) / (right["pos"] - left["pos"])).otherwise(0.0)


def value_at(c: str, pos: Column, fill: str = "interpolate") -> Column:
    """The value of column ``c`` at a position inside a run; a leading gap is NULL, a trailing one repeats the last value."""
    if fill not in FILLS:
        raise ValueError(f"unknown fill {fill!r}; known: {', '.join(FILLS)}")
    left = F.col(c + "_left")
    if fill == "none":
        return F.when(left["pos"] == pos, left["val"])
    if fill == "ffill":
        return left["val"]
    return F.when(left["pos"] == pos, left["val"]).otherwise(left["val"] + _slope(c) * (pos - left["pos"]))


def positions(runs: DataFrame, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """One row per cell with its ``pos``; a long run is cut in pieces first, so that no array is longer than a block."""
    end = F.col("start") + F.col("length") - 1
    step = F.lit(block_steps).cast("bigint")
    pieces = runs.withColumn("_from", F.explode(F.sequence(F.col("start"), end, step)))
    return pieces.withColumn("pos", F.explode(F.sequence(F.col("_from"), F.least(end, F.col("_from") + step - 1)))).drop("_from")


def unfold(runs: DataFrame, dates: DataFrame, fill: str = "interpolate", block_steps: int = BLOCK_STEPS) -> DataFrame:
    """(region, t, columns) of every cell; ``dates`` is the numbered calendar that the runs were made with."""
    cells = positions(runs, block_steps)
    return cells.join(dates, "pos").select("region", "t", *(value_at(c, F.col("pos"), fill).alias(c) for c in _columns(runs)))


def filled_means(runs: DataFrame, fill: str = "interpolate") -> DataFrame:
    """region and per column ``<c>_n`` and ``<c>_mean`` over the filled cells of the calendar, without a row per cell.

    Along a run the filled values are an arithmetic series. A column without any filled cell has 0 and NULL.
    """
    start, length = F.col("start"), F.col("length")
    found = []
    for c in _columns(runs):
        left = F.col(c + "_left")
        filled = left["val"].isNotNull()
        if fill == "none":
            filled = filled & (left["pos"] == start)
        share = F.when(filled, length).otherwise(0)
        # the mean of an arithmetic series is its value in the middle; a run with an observed value has one cell
        middle = value_at(c, start + (length - 1) / 2, fill)
        total = F.sum(F.when(filled, middle * length))
        found += [F.sum(share).alias(c + "_n"), (total / F.nullif(F.sum(share), F.lit(0))).alias(c + "_mean")]
    return runs.groupBy("region").agg(*found)


def window_scales(df: DataFrame, context_length: int, column: str = "y", freq: str = "D", block_steps: int = BLOCK_STEPS) -> DataFrame:
    """(region, start, length, scale): mean |value| over the observed among the last ``context_length`` cells of the calendar, 1
    where nothing was observed or the mean is zero, in runs of equal scale.

    A scale changes only where a value enters the window or leaves it, so there are at most two runs per observed value and one per region.
    """
    if context_length < 1:
        raise ValueError("a window has a cell at least")
    dates = numbered_calendar(df, freq, block_steps)
    last = dates.agg(F.max("pos")).scalar()
    values = df.where("region IS NOT NULL").select("region", "t", F.abs(column).cast("double").alias("value")).join(dates, "t").select("region", "pos", "value")
    seen = values.where("value IS NOT NULL")
    gone = seen.select("region", (F.col("pos") + context_length).alias("pos"), F.lit(None).cast("double").alias("value")).where(F.col("pos") <= last)
    begins = regions_of(values).select("region", F.lit(1).cast("bigint").alias("pos"), F.lit(None).cast("double").alias("value"))
    events = seen.unionByName(gone).unionByName(begins).groupBy("region", "pos").agg(F.max("value").alias("value"))
    reach = F.avg("value")
    if is_calendar(freq):
        scaled = events.withColumn("scale", reach.over(Window.partitionBy("region").orderBy("pos").rangeBetween(1 - context_length, 0)))
    else:
        home = _part(F.col("pos"), block_steps)
        # values also go to the later blocks that their window reaches
        blocks = F.sequence(home, F.when(F.col("value").isNull(), home).otherwise(_part(F.col("pos") + context_length - 1, block_steps)))
        copies = events.withColumn("_home", home).withColumn("_block", F.explode(blocks))
        inside = Window.partitionBy("region", "_block").orderBy("pos").rangeBetween(1 - context_length, 0)
        scaled = copies.withColumn("scale", reach.over(inside)).where("_block = _home").drop("_home", "_block")
    ends = _following(scaled, [], freq, block_steps).withColumn("_end", F.coalesce(F.col("_after")["pos"], last + 1))
    scale = F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    return ends.select("region", F.col("pos").alias("start"), (F.col("_end") - F.col("pos")).alias("length"), scale.alias("scale"))

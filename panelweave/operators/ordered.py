"""Ordered-series building blocks that never put an unbounded series into one task.

A calendar of daily or coarser steps is bounded by history (65,536 days are 179 years), and
panels of such a frequency hold ``t`` as DATE, so a window per region is bounded too. For
finer steps a series is cut into calendar blocks: windows run inside (region, block) and what
has to cross a block border travels as one summary row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

# Seconds per step of the supported frequencies.
STEP_SECONDS = {
    "Y": 31_536_000,
    "Q": 7_776_000,
    "M": 2_592_000,
    "W": 604_800,
    "D": 86_400,
    "h": 3_600,
    "min": 60,
    "s": 1,
}
BLOCK_STEPS = 65_536


def is_calendar(freq: str) -> bool:
    """True for daily or coarser steps, whose series length is bounded by history."""
    if freq not in STEP_SECONDS:
        raise ValueError(f"unknown frequency {freq!r}; known: {', '.join(STEP_SECONDS)}")
    return STEP_SECONDS[freq] >= STEP_SECONDS["D"]


def block_of(t: Column, freq: str, block_steps: int = BLOCK_STEPS) -> Column:
    """Number of the calendar block that holds the zone-less timestamp ``t``."""
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t)
    return F.floor(seconds / F.lit(STEP_SECONDS[freq] * block_steps)).cast("bigint")


def number_rows(
    df: DataFrame, by: Sequence[str], freq: str, out: str = "rn", block_steps: int = BLOCK_STEPS
) -> DataFrame:
    """Position 1, 2, … of each row in the ``t`` order of its group."""
    by = list(by)
    if is_calendar(freq):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy("t")).cast("bigint"))
    blocked = df.withColumn("_block", block_of(F.col("t"), freq, block_steps))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*by, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = Window.partitionBy(*by, "_block").orderBy("t")
    return (
        blocked.withColumn(out, F.row_number().over(local).cast("bigint"))
        .join(offsets, [*by, "_block"])
        .withColumn(out, F.col(out) + F.col("_offset"))
        .drop("_block", "_offset")
    )


def nearest_known(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    freq: str,
    backward: bool = True,
    forward: bool = False,
    position: str = "t",
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """For each row and column the closest non-NULL value at or before (``_prev_<c>``) and at or
    after (``_next_<c>``) it, as structs of (pos, val) where pos is column ``position``.

    The search for later values runs over the descending order, because a frame that ends at
    UNBOUNDED FOLLOWING costs quadratic time per series.
    """
    by = list(by)
    sides = [side for side, wanted in (("_prev_", backward), ("_next_", forward)) if wanted]
    blocks = [] if is_calendar(freq) else ["_block"]
    if blocks:
        df = df.withColumn("_block", block_of(F.col("t"), freq, block_steps))

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(position).alias("pos"), F.col(c).alias("val")))

    def running(side: str, partition: list[str], order: str, last: int) -> WindowSpec:
        key = F.col(order).asc() if side == "_prev_" else F.col(order).desc()
        return Window.partitionBy(*partition).orderBy(key).rowsBetween(Window.unboundedPreceding, last)

    found = df.withColumns(
        {side + c: F.last(known(c), True).over(running(side, by + blocks, "t", 0)) for side in sides for c in columns}
    )
    if not blocks:
        return found
    pick = {"_prev_": F.max, "_next_": F.min}
    summary = df.groupBy(*by, "_block").agg(
        *(pick[side](known(c)).alias("_edge" + side + c) for side in sides for c in columns)
    )
    carried = summary.select(
        *by,
        "_block",
        *(
            F.last("_edge" + side + c, True).over(running(side, by, "_block", -1)).alias("_carry" + side + c)
            for side in sides
            for c in columns
        ),
    )
    joined = found.join(carried, [*by, "_block"])
    return joined.withColumns(
        {side + c: F.coalesce(side + c, "_carry" + side + c) for side in sides for c in columns}
    ).drop("_block", *("_carry" + side + c for side in sides for c in columns))


def over_neighbourhood(
    df: DataFrame,
    by: Sequence[str],
    freq: str,
    before: int,
    after: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``build`` receives a window ordered by ``t`` and returns the new columns. For fine
    frequencies each block of rows also gets a copy of the rows just outside it.
    """
    by = list(by)
    if is_calendar(freq):
        return df.withColumns(build(Window.partitionBy(*by).orderBy("t")))
    numbered = number_rows(df, by, freq, "_rn", block_steps)
    at = F.col("_rn") - 1
    copies = numbered.withColumn("_home", F.floor(at / block_steps).cast("bigint")).withColumn(
        "_block",
        F.explode(
            F.sequence(
                F.greatest(F.lit(0), F.floor((at - after) / block_steps)).cast("bigint"),
                F.floor((at + before) / block_steps).cast("bigint"),
            )
        ),
    )
    return (
        copies.withColumns(build(Window.partitionBy(*by, "_block").orderBy("_rn")))
        .where(F.col("_block") == F.col("_home"))
        .drop("_rn", "_home", "_block")
    )


def tail(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group; Spark limits the groups before it shuffles them."""
    latest = Window.partitionBy(*by).orderBy(F.col("t").desc())
    return df.withColumn("_back", F.row_number().over(latest)).where(F.col("_back") <= n).drop("_back")


def since_tail(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The rows of all groups from the earliest date on that the last ``n`` rows of any group reach; rows without a date stay."""
    first = tail(df.select(*by, "t"), by, n).agg(F.min("t")).scalar()
    return df.where((F.col("t") >= first) | F.col("t").isNull())

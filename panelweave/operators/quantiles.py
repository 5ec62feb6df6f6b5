"""Exact order statistics of a whole column without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BINS = 4_096
FEW_ROWS = 50_000


def exact_median(df: DataFrame, column: str, few_rows: int = FEW_ROWS) -> float | None:
    """Mean of the two middle values.

    Counts equal-width bins, keeps the bin that holds the lower middle value, and repeats. Each
    pass aggregates to at most ``BINS`` rows; once few rows remain, or a single value does, the
    bin is read exactly.
    """
    x = F.col(column)
    span = df.agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).first()
    n, low, high = span["n"], span["low"], span["high"]
    if not n:
        return None
    rank, pair = (n - 1) // 2, n % 2 == 0
    while low < high and n > few_rows:
        width = (high - low) / BINS
        number = F.least(F.floor((x - low) / width), F.lit(BINS - 1))
        bins = df.where(x.between(low, high)).groupBy(number.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")
        )
        for row in sorted(bins.collect(), key=lambda r: r["b"]):
            if rank < row["n"]:
                low, high, n = row["low"], row["high"], row["n"]
                break
            rank -= row["n"]
    if low < high:
        values = df.where(x.between(low, high)).agg(F.sort_array(F.collect_list(x)).alias("v")).select(
            F.col("v")[rank].alias("here"), F.try_element_at("v", F.lit(rank + 2)).alias("after")
        ).first()
        here, after = values["here"], values["after"]
    else:
        here, after = low, low if rank + 1 < n else None
    if not pair:
        return here
    if after is None:
        after = df.where(x > high).agg(F.min(x)).first()[0]
    return (here + after) / 2

"""Connected components of a link table, without gathering any group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelweave.llm.common import discard, staged


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _lowered(links: DataFrame) -> DataFrame:
    """One round: every node hangs its greater neighbours, then itself and its smaller ones, on the least node it sees."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    # now every link goes from the greater node a to the smaller node b
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.where("a <> b").union(lowest.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: not null), root being the least node that it reaches.

    Each round is two aggregates with partial sums and two equi-joins, which adaptive execution can
    split at hubs; rounds go on until nothing changes, their tables are written and the old ones deleted.
    """
    links = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(links)
    while mark[0]:
        after = staged(_lowered(links))
        discard(links)
        links, before = after, mark
        mark = _mark(links)
        if mark == before:
            break
    found = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

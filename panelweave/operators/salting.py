"""Joins whose hot keys are split by measured counts.

Counting is an aggregate that combines in each task. Keys with more rows than a piece may have are few, by their counts, so the table
of pieces is small whatever the data; all other keys keep one piece and are not repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelweave.session import wide_partitions

#: Rows of a key that one task takes, at least.
PIECE_ROWS = 100_000


def hot_keys(rows: DataFrame, keys: Sequence[str], piece_rows: int | None = None) -> DataFrame:
    """(keys, _pieces) of the keys with more rows than ``piece_rows``, which is by default what a task would have if all rows were dealt evenly."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if piece_rows is None:
        share = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).scalar() / wide_partitions(rows.sparkSession)
        limit: Column = F.greatest(F.lit(PIECE_ROWS), F.ceil(share))
    else:
        limit = F.lit(piece_rows)
    return counts.where(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_pieces"))


def in_pieces(rows: DataFrame, hot: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The rows with ``_piece``: those of a hot key are dealt by the columns ``by``."""
    piece = F.pmod(F.xxhash64(*by), F.coalesce("_pieces", F.lit(1))).cast("int")
    return rows.join(hot, list(keys), "left").withColumn("_piece", piece).drop("_pieces")


def repeated(rows: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows with ``_piece``: those of a hot key once per piece."""
    pieces = F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))
    return rows.join(hot, list(keys), "left").withColumn("_piece", pieces).drop("_pieces")


def split_join(many: DataFrame, few: DataFrame, keys: Sequence[str], by: Sequence[str], piece_rows: int | None = None) -> DataFrame:
    """Inner join on ``keys`` of a side that may hold very many rows of one key with a side that holds few of each."""
    hot = hot_keys(many, keys, piece_rows)
    return in_pieces(many, hot, keys, by).join(repeated(few, hot, keys), [*keys, "_piece"]).drop("_piece")

"""Products of two tables without a cross join.

Rows are hashed to tiles, each side is repeated once per tile of the other side, and the two
meet in an equi-join on the tile pair. Every tile pair holds about ``TILE_ROWS`` squared pairs,
whatever the sizes of the tables, so no task and no broadcast grows with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelweave.session import wide_partitions

TILE_ROWS = 256


def tiles_for(rows: int, tile_rows: int = TILE_ROWS) -> int:
    return max(1, -(-rows // tile_rows))


def tile_sides(
    left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str], left_tiles: int, right_tiles: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides with their tile pair (``_a``, ``_b``), spread over the pairs."""
    a = left.withColumn("_a", F.pmod(F.xxhash64(*left_key), F.lit(left_tiles)).cast("int")).withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.lit(right_tiles - 1)))
    )
    b = right.withColumn("_b", F.pmod(F.xxhash64(*right_key), F.lit(right_tiles)).cast("int")).withColumn(
        "_a", F.explode(F.sequence(F.lit(0), F.lit(left_tiles - 1)))
    )
    if left_tiles * right_tiles > 1:
        n = wide_partitions(left.sparkSession)
        a, b = a.repartition(n, "_a", "_b"), b.repartition(n, "_a", "_b")
    return a, b


def product(
    left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str], left_tiles: int, right_tiles: int
) -> DataFrame:
    a, b = tile_sides(left, right, left_key, right_key, left_tiles, right_tiles)
    return a.join(b, ["_a", "_b"])


def chunk_sides(left: DataFrame, right: DataFrame, left_key: Sequence[str], left_tiles: int, chunks: int) -> tuple[DataFrame, DataFrame]:
    """The left side, repeated once per chunk, and the right side as ``chunks`` rows of equal size, repeated once per tile of the left."""
    n = wide_partitions(left.sparkSession)
    # spread before it is repeated: few points come out of one task
    a = left.repartition(n).withColumn("_a", F.pmod(F.xxhash64(*left_key), F.lit(left_tiles)).cast("int")).withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    )
    dealt = right.repartition(chunks).select(F.struct(*right.columns).alias("_row"), F.spark_partition_id().alias("_b"))
    b = dealt.groupBy("_b").agg(F.collect_list("_row").alias("_rows")).withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(left_tiles - 1))))
    return a.repartition(n, "_a", "_b"), b.repartition(n, "_a", "_b")


def chunk_product(left: DataFrame, right: DataFrame, left_key: Sequence[str], left_tiles: int, chunks: int) -> DataFrame:
    """The product of both; a chunk is unfolded where a row of the left meets it."""
    a, b = chunk_sides(left, right, left_key, left_tiles, chunks)
    # the hint keeps repeated chunks out of a broadcast, as Spark's estimate of their size leaves out the repeats, and the left side unsorted
    return a.join(b.hint("shuffle_hash"), ["_a", "_b"]).select(*left.columns, F.inline("_rows"))

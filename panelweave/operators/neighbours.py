"""Exact neighbour search: pairs within a distance, and the k nearest.

Coordinates are either scalar columns (``coords=["x", "y"]``), searched with spatial cells and
JVM expressions, or one array column (``coords="embedding"``), searched with pivots and
vectorised arithmetic (``operators/pivots.py``), as are four and more axes. Results are (i, j, d) with i ≠ j.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product as steps

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelweave.functions.scalars import total
from panelweave.operators import pivots
from panelweave.operators.tiling import TILE_ROWS, chunk_product, product, tile_sides, tiles_for
from panelweave.session import stage

CELL_POINTS = 2_048
ONE_CELL_POINTS = 512
MAX_LEVEL = 50
#: Of all pairs: chunks of points, and the most points of one. A point's pairs with a chunk are buffered, more points in chunks than these slow them.
CHUNKS, MOST_CHUNK = 64, 1_024
#: Points that one task of the nearest-neighbour search takes. Their rows shrink so well that tasks dealt by bytes would hold millions.
TASK_POINTS = 8_192
# absorbs rounding at the borders of boxes; it only adds candidates
SLACK = 1.000001

Coords = Sequence[str] | str


def _named(points: DataFrame, key: str, coords: Sequence[str], prefix: str) -> DataFrame:
    return points.select(
        F.col("region").alias(key), *(F.col(c).cast("double").alias(f"{prefix}{n}") for n, c in enumerate(coords))
    )


def _squared(dims: int) -> Column:
    return total([(F.col(f"p{n}") - F.col(f"q{n}")) * (F.col(f"p{n}") - F.col(f"q{n}")) for n in range(dims)])


def all_pairs(points: DataFrame, coords: Coords, tiles: int | None = None) -> DataFrame:
    """Distance of every ordered pair: the result itself has N·(N−1) rows.

    Of scalar coordinates one side travels in ``tiles`` chunks, one row each, so the other is repeated once per chunk, not once per few
    points. Where a point meets a chunk, the chunk is unfolded.
    """
    if isinstance(coords, str):
        return _tile_pairs(points, coords, tiles or tiles_for(points.count()))
    tiles = tiles or _chunk_count(points.count())
    left_tiles = min(tiles, max(1, CHUNKS * CHUNKS // tiles))
    met = chunk_product(_named(points, "i", coords, "p"), _named(points, "j", coords, "q"), ["i"], left_tiles, tiles).where("i <> j")
    return met.select("i", "j", F.sqrt(_squared(len(coords))).alias("d"))


def _chunk_count(rows: int) -> int:
    return tiles_for(rows, min(MOST_CHUNK, max(TILE_ROWS, rows // CHUNKS)))


def pairs_within(points: DataFrame, coords: Coords, threshold: float, cell_points: int = CELL_POINTS) -> DataFrame:
    """Pairs at most ``threshold`` apart (inclusive), without visiting the other pairs.

    Points fall into cells as wide as the threshold, so partners sit in adjacent cells. At most
    three coordinates make the cell (distance in fewer dimensions is never larger). A cell that
    holds more than ``cell_points`` points is cut into pieces, and its points and visitors meet
    piece by piece.
    """
    if isinstance(coords, str):
        return pivots.search(points, coords, threshold=threshold)
    if threshold < 0:
        return all_pairs(points, coords, 1).limit(0)
    width, axes = threshold if threshold > 0 else 1.0, range(min(3, len(coords)))
    cells = [f"c{n}" for n in axes]
    held = _named(points, "j", coords, "q").withColumns(
        {f"c{n}": F.floor(F.col(f"q{n}") / width) for n in axes}
    )
    visits = _named(points, "i", coords, "p").withColumn(
        "_shift", F.explode(F.array(*(F.array(*map(F.lit, s)) for s in steps((-1, 0, 1), repeat=len(cells)))))
    )
    visits = visits.withColumns(
        {f"c{n}": F.floor(F.col(f"p{n}") / width) + F.col("_shift")[n] for n in axes}
    ).drop("_shift")
    crowded = (
        held.groupBy(*cells)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > cell_points)
        .select(*cells, F.ceil(F.col("_n") / cell_points).cast("int").alias("_pieces"))
    )

    def in_pieces(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
        pieces = F.coalesce("_pieces", F.lit(1))
        return (
            side.join(crowded, cells, "left")
            .withColumn(own, F.pmod(F.xxhash64(key), pieces).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), pieces - 1)))
            .drop("_pieces")
        )

    met = in_pieces(visits, "i", "_a", "_b").join(in_pieces(held, "j", "_b", "_a"), [*cells, "_a", "_b"])
    near = met.where("i <> j").select("i", "j", F.sqrt(_squared(len(coords))).alias("d"))
    return near.where(F.col("d") <= threshold)


def nearest(points: DataFrame, coords: Coords, k: int) -> DataFrame:
    """The k nearest others of every point; equal distances are ordered by key."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if isinstance(coords, str) or len(coords) > 3:
        vectors = points if isinstance(coords, str) else points.select("region", F.array(*(F.col(c).cast("double") for c in coords)).alias("_v"))
        found = pivots.search(vectors, coords if isinstance(coords, str) else "_v", k)
        return _closest(found.withColumn("_d2", F.col("d")), k)
    return _nearest_by_cells(points, coords, k)


def _closest(candidates: DataFrame, k: int) -> DataFrame:
    """Rank by squared distance, then key; Spark limits each group before its shuffle."""
    order = Window.partitionBy("i").orderBy("_d2", "j")
    return candidates.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).select("i", "j", "d")


def _nearest_by_cells(points: DataFrame, coords: Sequence[str], k: int) -> DataFrame:
    """Exact search over cells that halve until they hold few points.

    A leaf is a cell of at most ``full`` ≥ k+2 points whose parent holds more, so the parent's
    diagonal bounds the distance to the k-th neighbour; the leaves next to it under the same
    parent usually give a much closer bound. The leaves within that bound of a point hold its
    candidates. Points that share one location are searched through its k+1 smallest keys
    only, so copies never multiply.
    """
    dims, axes = len(coords), range(len(coords))
    named = _named(points, "i", coords, "p")
    place = [f"p{n}" for n in axes]
    box = named.agg(
        F.count(F.lit(1)).alias("n"),
        *(f(f"p{n}").alias(f"{a}{n}") for n in axes for a, f in (("low", F.min), ("high", F.max))),
    ).first()
    if not box["n"]:
        return all_pairs(points, coords, 1)
    low = [box[f"low{n}"] for n in axes]
    extent = max(box[f"high{n}"] - box[f"low{n}"] for n in axes) or 1.0
    full = max(2 * (k + 1), 8)
    small = box["n"] <= max(ONE_CELL_POINTS, full)
    tasks = math.ceil(box["n"] / TASK_POINTS)

    copy = F.row_number().over(Window.partitionBy(*place).orderBy("i"))
    located = named.repartition(tasks, *place).withColumn("_copy", copy).where(F.col("_copy") <= k + 1)
    point = ["i", *place]
    held = [F.col("i").alias("j"), *(F.col(f"p{n}").alias(f"q{n}") for n in axes)]
    if small:
        candidates = product(located.select(*point), located.select(*held), ["i"], ["j"], 1, 1)
    else:
        depth = _depth(located, low, extent, math.ceil(math.log2(box["n"] / full) / dims) + 6, full, dims)
        # read by four branches below: written once
        leaved = stage(_with_bound(_assign_leaves(located, low, extent, depth, full, dims), k, extent, dims, tasks))
        leaves = leaved.repartition(tasks, "leaf").groupBy("leaf").agg(F.max("bound").alias("reach"))
        hops = _reachable_leaves(leaves, extent, dims, tasks)
        gaps = []
        for n in axes:
            start = low[n] + F.col("to_leaf")[f"c{n}"] * _side(F.col("to_leaf"), extent)
            gaps.append(F.greatest(F.lit(0.0), start - F.col(f"p{n}"), F.col(f"p{n}") - start - _side(F.col("to_leaf"), extent)))
        visits = (
            leaved.select(*point, "bound", F.col("leaf").alias("from_leaf"))
            .repartition(tasks, "from_leaf")
            .join(hops.repartition(tasks, "from_leaf"), "from_leaf")
            .where(F.sqrt(total([g * g for g in gaps])) <= F.col("bound") * SLACK)
        )
        candidates = visits.select(*point, "bound", "to_leaf").repartition(tasks, "to_leaf").join(
            leaved.select(*held, F.col("leaf").alias("to_leaf")).repartition(tasks, "to_leaf"), "to_leaf"
        ).where(F.sqrt(_squared(dims)) <= F.col("bound") * SLACK)
    searched = _closest(
        candidates.where("i <> j").select("i", "j", _squared(dims).alias("_d2")).withColumn("d", F.sqrt("_d2")), k
    )
    # the k smallest keys at the same place are the neighbours of every later copy
    spread = 32
    later = named.join(located.select("i"), "i", "left_anti").withColumn(
        "_salt", F.pmod(F.xxhash64("i"), F.lit(spread)).cast("int")
    )
    kept = located.where(F.col("_copy") <= k).select(
        F.col("i").alias("j"), *place, F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_salt")
    )
    crowd = later.join(kept, [*place, "_salt"]).select("i", "j", F.lit(0.0).alias("d"))
    return searched.unionByName(crowd)


def _cell(n: int, low: float, extent: float, level: Column) -> Column:
    """Index of the cell along one axis; the upper border belongs to the last cell."""
    per_side = F.pow(F.lit(2.0), level)
    index = F.floor((F.col(f"p{n}") - low) / extent * per_side)
    return F.least(index, per_side.cast("bigint") - 1)


def _fine_cells(located: DataFrame, low: list[float], extent: float, depth: int, dims: int) -> DataFrame:
    return located.withColumns({f"_f{n}": _cell(n, low[n], extent, F.lit(float(depth))) for n in range(dims)})


def _depth(located: DataFrame, low: list[float], extent: float, depth: int, full: int, dims: int) -> int:
    """A depth at which no cell is crowded, so that far-off points cannot squeeze the others into
    one leaf. One combined count per attempt; the first one nearly always holds."""
    while depth < MAX_LEVEL:
        cells = _fine_cells(located, low, extent, depth, dims).groupBy(*(f"_f{n}" for n in range(dims)))
        if not cells.count().where(F.col("count") > full).take(1):
            break
        depth += 8
    return min(depth, MAX_LEVEL)


def _assign_leaves(located: DataFrame, low: list[float], extent: float, depth: int, full: int, dims: int) -> DataFrame:
    """Leaf of each point = number of its cells, from the root down, that hold more than ``full``."""
    axes, salts = range(dims), 16
    cell = [f"c{n}" for n in axes]
    finest = _fine_cells(located, low, extent, depth, dims)
    fine_counts = finest.groupBy(*(f"_f{n}" for n in axes)).agg(F.count(F.lit(1)).alias("_n"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    split = (
        fine_counts.withColumn("level", levels)
        .withColumns({f"c{n}": _ancestor(f"_f{n}", depth, F.col("level")) for n in axes})
        .groupBy("level", *cell)
        .agg(F.sum("_n").alias("_n"))
        .where(F.col("_n") > full)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .select("level", *cell, "_salt")
    )
    path = (
        finest.withColumn("level", levels)
        .withColumns({f"c{n}": _ancestor(f"_f{n}", depth, F.col("level")) for n in axes})
        .withColumn("_salt", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int"))
    )
    depth_of = (
        path.select("i", "level", *cell, "_salt")
        .join(split, ["level", *cell, "_salt"])
        .groupBy("i")
        .agg(F.least(F.count(F.lit(1)), F.lit(depth)).cast("int").alias("_leaf_level"))
    )
    leaf_level = F.coalesce("_leaf_level", F.lit(0))
    return finest.join(depth_of, "i", "left").select(
        "i",
        *(f"p{n}" for n in axes),
        F.struct(
            leaf_level.alias("level"), *(_ancestor(f"_f{n}", depth, leaf_level).alias(f"c{n}") for n in axes)
        ).alias("leaf"),
    )


def _ancestor(index: Column | str, depth: int | Column, level: Column) -> Column:
    """Cell index at ``level`` of a cell given at level ``depth``."""
    index = F.col(index) if isinstance(index, str) else index
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.floor(index / F.pow(F.lit(2.0), depth - level)).cast("bigint")


def _side(leaf: Column, extent: float) -> Column:
    """Width of a leaf."""
    return F.lit(extent) / F.pow(F.lit(2.0), leaf["level"])


def _with_bound(leaved: DataFrame, k: int, extent: float, dims: int, tasks: int) -> DataFrame:
    """``bound`` of each point: no smaller than the distance to its k-th neighbour.

    Leaves under one parent hold at most 2^dims·full points together; among these the k-th
    distance is taken where they suffice.
    """
    axes, level = range(dims), F.col("leaf")["level"]
    parent = F.struct(
        (level - 1).alias("level"), *(_ancestor(F.col("leaf")[f"c{n}"], level, level - 1).alias(f"c{n}") for n in axes)
    )
    place = [f"p{n}" for n in axes]
    families = leaved.withColumn("_parent", parent).repartition(tasks, "_parent").groupBy("_parent").agg(
        F.collect_list(F.struct("i", *place, "leaf")).alias("_family")
    )

    def apart(a: Column, b: Column) -> Column:
        return total([(a[c] - b[c]) * (a[c] - b[c]) for c in place])

    members = families.select("_family", F.inline("_family"))
    squares = F.array_sort(F.transform("_family", lambda m: apart(F.struct(*place), m)))
    near = F.when(F.size("_family").between(k + 1, 512), F.sqrt(F.try_element_at(squares, F.lit(k + 1))))
    diagonal = 2.0 * math.sqrt(dims) * _side(F.col("leaf"), extent)
    return members.select("i", *place, "leaf", F.coalesce(F.least(near, diagonal), diagonal).alias("bound"))


def _reachable_leaves(leaves: DataFrame, extent: float, dims: int, tasks: int) -> DataFrame:
    """Pairs (from_leaf, to_leaf) whose boxes are at most ``reach`` of ``from_leaf`` apart, which is
    no more than its parent's diagonal.

    With cells four times as wide as the leaf, the ball stays inside the 3^dims cells around it.
    Finer leaves meet there through their ancestor at that level, coarser ones through an
    ancestor of those cells.
    """
    axes = range(dims)
    level = F.col("leaf")["level"]
    base = F.greatest(level - 2, F.lit(0))
    shifts = F.array(*(F.array(*map(F.lit, s)) for s in steps((-1, 0, 1), repeat=dims)))
    around = (
        leaves.withColumn("base", base)
        .withColumn("_shift", F.explode(shifts))
        .withColumns(
            {f"b{n}": _ancestor(F.col("leaf")[f"c{n}"], level, F.col("base")) + F.col("_shift")[n] for n in axes}
        )
    )
    key = ["key_level", *(f"k{n}" for n in axes)]
    finer_side = around.select(
        F.col("leaf").alias("from_leaf"), "reach", F.col("base").alias("key_level"), *(F.col(f"b{n}").alias(f"k{n}") for n in axes)
    )
    coarser_side = (
        around.where("base > 0")
        .withColumn("key_level", F.explode(F.sequence(F.lit(0), F.col("base") - 1)))
        .select(
            F.col("leaf").alias("from_leaf"),
            "reach",
            "key_level",
            *(_ancestor(f"b{n}", F.col("base"), F.col("key_level")).alias(f"k{n}") for n in axes),
        )
        .distinct()
    )
    with_ancestors = leaves.withColumn("key_level", F.explode(F.sequence(F.lit(0), level))).select(
        F.col("leaf").alias("to_leaf"),
        "key_level",
        *(_ancestor(F.col("leaf")[f"c{n}"], level, F.col("key_level")).alias(f"k{n}") for n in axes),
    )
    own = leaves.select(
        F.col("leaf").alias("to_leaf"), level.alias("key_level"), *(F.col("leaf")[f"c{n}"].alias(f"k{n}") for n in axes)
    )
    finer, coarser = (
        a.repartition(tasks, *key).join(b.repartition(tasks, *key), key) for a, b in ((finer_side, with_ancestors), (coarser_side, own))
    )
    met = finer.unionByName(coarser)
    a, b = F.col("from_leaf"), F.col("to_leaf")
    gaps = []
    for n in axes:
        a_low, b_low = a[f"c{n}"] * _side(a, extent), b[f"c{n}"] * _side(b, extent)
        gap = F.greatest(F.lit(0.0), b_low - a_low - _side(a, extent), a_low - b_low - _side(b, extent))
        gaps.append(gap * gap)
    return met.where((a["level"] == 0) | (F.sqrt(total(gaps)) <= F.col("reach") * SLACK)).select("from_leaf", "to_leaf")


def _tile_pairs(points: DataFrame, coord: str, tiles: int) -> DataFrame:
    """Distances of all pairs of array coordinates, tile against tile."""
    import numpy as np
    import pandas as pd

    left = points.select(F.col("region").alias("i"), F.col(coord).cast("array<double>").alias("p"))
    right = points.select(F.col("region").alias("j"), F.col(coord).cast("array<double>").alias("q"))
    a, b = tile_sides(left, right, ["i"], ["j"], tiles, tiles)

    def compare(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        out = {"i": [], "j": [], "d": []}
        if len(own) and len(other):
            names, keys = own["i"].to_numpy(), other["j"].to_numpy()
            mine, values = np.stack(own["p"].to_numpy()), np.stack(other["q"].to_numpy())
            for at in range(0, len(mine), 32):
                d = np.sqrt(((mine[at : at + 32, None, :] - values[None, :, :]) ** 2).sum(axis=2))
                row, place = np.nonzero(names[at : at + 32, None] != keys[None, :])
                out["i"].append(names[at + row])
                out["j"].append(keys[place])
                out["d"].append(d[row, place])
        return pd.DataFrame({c: np.concatenate(v) if v else v for c, v in out.items()})

    kind = points.schema["region"].dataType.simpleString()
    return (
        a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInPandas(compare, f"i {kind}, j {kind}, d double")
    )

"""Exact neighbour search between vectors of any length, by a pivot index.

Every vector belongs to the cell of its nearest pivot and knows its radius, the distance to it. A cell's members are cut into
rings of equal count by radius, and a ring of equal radii into pieces by hash, so no group grows with the data. For a query at
distance d from a pivot and a bound b on what it seeks, the triangle inequality leaves out every ring outside [d − b, d + b], and
every cell whose bisector with the query's own pivot is farther than b. Only what is left is compared, so the answer is exact; how much is
left depends on the data: little between clusters, everything between unstructured vectors of many dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from panelweave.session import stage, wide_partitions

#: Vectors of a group that is compared at once.
CELL_ROWS = 2_048
#: Pivots, which every task holds.
MOST_PIVOTS = 1_024
RADIUS_BINS = 4_096
#: Members that are sent together, in the blocks of which their groups are part: a query is sent once per block, not once per group.
BLOCK_ROWS = 65_536
#: Queries that one block of members meets at a time; more are spread over further tasks.
QUERY_ROWS = 65_536
#: Vectors that a Python worker compares with all pivots, or hands back, at a time: its memory does not grow with their number.
BATCH_ROWS = 1_024
# absorbs rounding of distances; it only adds candidates
SLACK = 1e-9


@dataclass
class PivotIndex:
    """``members``: (i, v, cell, ring, piece, radius); ``rings``: (cell, ring, pieces, near, far, n); ``reach``: largest radius per cell."""

    pivots: np.ndarray
    reach: np.ndarray
    members: DataFrame
    rings: DataFrame


def _vectors(kind: str) -> str:
    """Single numbers stay single on their way, and are compared as doubles."""
    return "array<float>" if kind == "array<float>" else "array<double>"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and how far off they may be, per row of ``a``."""
    own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
    return own[:, None] + other[None, :] - 2 * a @ b.T, 1e-13 * a.shape[1] ** 0.5 * (own + other.max(initial=0.0)) + 1e-300


def _far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows of the sample, each the farthest from those before it."""
    chosen, nearest = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def build(named: DataFrame, rows: int, cell_rows: int = CELL_ROWS) -> PivotIndex:
    """Index over (i, v) rows. Pivots are picked from a sample of at most four times their number."""
    spark, key, kind = named.sparkSession, named.schema["i"].dataType.simpleString(), named.schema["v"].dataType.simpleString()
    count = max(1, min(MOST_PIVOTS, 2 * rows // cell_rows))
    sample = named.orderBy(F.xxhash64("i"), "i").limit(4 * count).select("v").toPandas()
    pivots = _far_apart(_matrix(sample["v"]), count)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for frame in frames:
            for at in range(0, len(frame), BATCH_ROWS):
                part = frame.iloc[at : at + BATCH_ROWS]
                x = _matrix(part["v"])
                squares, margin = _squares(x, centres)
                # exact distances settle which of the pivots that may be nearest is
                row, cell = np.nonzero(squares <= (squares.min(axis=1) + 2 * margin)[:, None])
                radius = np.sqrt(((x[row] - centres[cell]) ** 2).sum(axis=1))
                order = np.lexsort((cell, radius, row))
                first = order[np.searchsorted(row[order], np.arange(len(x)))]
                yield part.assign(cell=cell[first].astype(np.int32), radius=radius[first])

    located = stage(named.mapInPandas(assign, f"i {key}, v {kind}, cell int, radius double"))
    cells = located.groupBy("cell").agg(F.max("radius").alias("reach"))
    reach = np.full(len(pivots), -1.0)
    for row in cells.collect():
        reach[row["cell"]] = row["reach"]
    binned = located.join(cells, "cell").withColumn("bin", F.when(F.col("reach") > 0, F.floor(F.col("radius") / F.col("reach") * RADIUS_BINS)).otherwise(0))
    bins = binned.groupBy("cell", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far"))
    # a ring ends where another CELL_ROWS members begin; a cell has at most RADIUS_BINS + 1 bins
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("bin")) - F.col("n")
    ringed = stage(bins.withColumn("ring", F.floor(before / cell_rows).cast("int")))
    rings = ringed.groupBy("cell", "ring").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far"))
    rings = rings.withColumn("pieces", F.ceil(F.col("n") / (2 * cell_rows)).cast("int"))
    place = ringed.select("cell", "bin", "ring").join(rings.select("cell", "ring", "pieces"), ["cell", "ring"])
    members = binned.join(place, ["cell", "bin"]).select(
        "i", "v", "cell", "ring", F.pmod(F.xxhash64("i"), F.col("pieces")).cast("int").alias("piece"), "radius"
    )
    return PivotIndex(pivots, reach, stage(members), stage(rings))


def _pairs(own: pd.DataFrame, other: pd.DataFrame, k: int | None) -> pd.DataFrame:
    """(i, j, d) between queries (i, v, bound) and members (i, v): all within the bound, or of these the k closest."""
    return _block_pairs(own.assign(groups=[np.zeros(1, int)] * len(own)), other.assign(group=0), k)


def _block_pairs(own: pd.DataFrame, other: pd.DataFrame, k: int | None) -> pd.DataFrame:
    """The same between queries (i, v, bound, groups) and members (i, v, group): a query meets the groups that it names."""
    out = {"i": [], "j": [], "d": []}
    if len(own) and len(other):
        other = other.sort_values("i", kind="stable")
        # members by group; their rank is the order of their keys
        rank = np.argsort(other["group"].to_numpy(), kind="stable")
        number, start = np.unique(other["group"].to_numpy()[rank], return_index=True)
        end = [*start[1:], len(rank)]
        names, keys = own["i"].to_numpy(), other["i"].to_numpy()[rank]
        mine, theirs = _matrix(own["v"]), _matrix(other["v"].iloc[rank])
        bounds = own["bound"].to_numpy(dtype=float, copy=True)
        for at in range(0, len(mine), 256):
            groups = own["groups"].iloc[at : at + 256].to_list()
            query, asked = np.repeat(np.arange(len(groups)), [len(g) for g in groups]) + at, np.concatenate(groups)
            met = []
            for n in np.flatnonzero(np.isin(number, asked)):
                some, span = query[asked == number[n]], slice(start[n], end[n])
                row, place, d = _met_group(mine[some], theirs[span], names[some][:, None] == keys[span][None, :], bounds[some], rank[span], k)
                met.append((some[row], place + start[n], d))
                if k is not None:
                    # the k-th of a group bounds what the next ones may add
                    first = np.searchsorted(row, np.arange(len(some)))
                    last = first + k - 1
                    full = np.flatnonzero((last < len(row)) & (np.append(row, -1)[np.minimum(last, len(row))] == np.arange(len(some))))
                    bounds[some[full]] = np.minimum(bounds[some[full]], d[last[full]])
            if met:
                row, place, d = (np.concatenate(x) for x in zip(*met))
                if k is not None:
                    row, place, d = _first(row, place, d, rank[place], k)
                out["i"].append(names[row])
                out["j"].append(keys[place])
                out["d"].append(d)
    return pd.DataFrame({c: np.concatenate(v) if v else v for c, v in out.items()})


def _met_group(x: np.ndarray, theirs: np.ndarray, itself: np.ndarray, bounds: np.ndarray, rank: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, d) between queries and the members of one group, where k are sought in order of row, d and rank."""
    squares, margin = _squares(x, theirs)
    squares[itself] = np.inf
    most = (bounds * (1 + SLACK)) ** 2
    near = squares <= (most + margin)[:, None]
    if k is not None and k < len(theirs) and np.count_nonzero(near) > 4 * k * len(x):
        most = np.minimum(most, np.partition(squares, k - 1, axis=1)[:, k - 1] + margin)
        near = squares <= (most + margin)[:, None]
    row, place = np.nonzero(near & ~itself)
    d = np.sqrt(((x[row] - theirs[place]) ** 2).sum(axis=1))
    if k is not None:
        return _first(row, place, d, rank[place], k)
    good = d <= bounds[row]
    return row[good], place[good], d[good]


def _first(row: np.ndarray, place: np.ndarray, d: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k closest of each row, equal distances by rank."""
    order = np.lexsort((rank, d, row))
    row, place, d = row[order], place[order], d[order]
    good = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[good], place[good], d[good]


def _bounded(index: PivotIndex, k: int) -> DataFrame:
    """Members with ``bound``, no less than the distance to the k-th neighbour: that inside the own group, or the k-th pivot's."""
    shared = index.members.sparkSession.sparkContext.broadcast(index.pivots)
    key, kind = (index.members.schema[c].dataType.simpleString() for c in ("i", "v"))

    def bound(group: pd.DataFrame) -> pd.DataFrame:
        x, centres = _matrix(group["v"]), shared.value
        found = np.full(len(x), np.inf)
        for at in range(0, len(x), 256):
            for others in (x, centres):
                # one more than k: a vector may be among the others itself
                if len(others) > k:
                    squares, margin = _squares(x[at : at + 256], others)
                    near = np.maximum(np.partition(squares, k, axis=1)[:, k], 0) + margin
                    found[at : at + 256] = np.minimum(found[at : at + 256], np.sqrt(near))
        return group.assign(bound=found)

    schema = f"i {key}, v {kind}, cell int, ring int, piece int, radius double, bound double"
    return stage(index.members.groupBy("cell", "ring", "piece").applyInPandas(bound, schema))


def _reached(frame: pd.DataFrame, centres: np.ndarray, reach: np.ndarray) -> Iterator[pd.DataFrame]:
    """Queries (i, v, radius, bound) with the cells and radii that they may reach, at most ``BATCH_ROWS`` rows at a time: a query that
    reaches every cell comes back once for each."""
    for at in range(0, len(frame), BATCH_ROWS):
        part = frame.iloc[at : at + BATCH_ROWS]
        x, b = _matrix(part["v"]), part["bound"].to_numpy()[:, None]
        squares, margin = _squares(x, centres)
        far = np.sqrt(np.maximum(squares - margin[:, None], 0)), np.sqrt(np.maximum(squares, 0) + margin[:, None])
        own = part["radius"].to_numpy()[:, None]
        slack = SLACK * (far[1] + own)
        keep = (reach >= 0) & (far[0] - b <= reach + slack) & (far[0] - own <= 2 * b + slack)
        rows, cells = np.nonzero(keep)
        for start in range(0, len(rows), BATCH_ROWS):
            row, cell = rows[start : start + BATCH_ROWS], cells[start : start + BATCH_ROWS]
            yield pd.DataFrame({
                "at": at + row, "i": part["i"].to_numpy()[row], "v": part["v"].to_numpy()[row], "bound": b[row, 0], "cell": cell.astype(np.int32),
                "low": far[0][row, cell] - b[row, 0] - slack[row, cell], "high": far[1][row, cell] + b[row, 0] + slack[row, cell],
            })


def _grouped(index: PivotIndex, block_rows: int) -> pd.DataFrame:
    """(cell, ring, piece, near, far, group, block): groups by number, and blocks of groups that hold about ``block_rows`` members."""
    rings = index.rings.toPandas().sort_values(["cell", "ring"]).reset_index(drop=True)
    groups = rings.loc[rings.index.repeat(rings["pieces"])].reset_index(drop=True)
    groups["piece"] = groups.groupby(["cell", "ring"]).cumcount().astype(np.int32)
    groups["group"] = np.arange(len(groups), dtype=np.int32)
    size = groups["n"] / groups["pieces"]
    groups["block"] = ((size.cumsum() - size) // block_rows).astype(np.int32)
    return groups[["cell", "ring", "piece", "near", "far", "group", "block"]]


def _named_groups(reached: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Queries (i, v, bound) of ``_reached`` once per block, with the groups there that they may reach."""
    first = np.searchsorted(groups["cell"], reached["cell"])
    count = np.searchsorted(groups["cell"], reached["cell"], side="right") - first
    row = np.arange(len(reached)).repeat(count)
    group = np.arange(len(row)) - (np.cumsum(count) - count).repeat(count) + first.repeat(count)
    meets = (groups["far"].to_numpy()[group] >= reached["low"].to_numpy()[row]) & (groups["near"].to_numpy()[group] <= reached["high"].to_numpy()[row])
    row, group = row[meets], group[meets]
    block, at = groups["block"].to_numpy()[group], reached["at"].to_numpy()[row]
    # rows come query by query and cells in order: where either changes, a list begins
    start = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (at[1:] != at[:-1]))) if len(row) else np.empty(0, int)
    found = reached[["i", "v", "bound"]].iloc[row[start]].reset_index(drop=True)
    return found.assign(block=block[start], groups=np.split(group.astype(np.int32), start[1:]) if len(row) else [])


def _block_visits(index: PivotIndex, bounded: DataFrame, groups: pd.DataFrame) -> DataFrame:
    """(i, v, bound, block, groups): blocks, and their groups that may hold what a query within its bound seeks."""
    shared = bounded.sparkSession.sparkContext.broadcast((index.pivots, index.reach, groups))
    key, kind = (bounded.schema[c].dataType.simpleString() for c in ("i", "v"))

    def reachable(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, reach, known = shared.value
        for frame in frames:
            for reached in _reached(frame, centres, reach):
                yield _named_groups(reached, known)

    return bounded.mapInPandas(reachable, f"i {key}, v {kind}, bound double, block int, groups array<int>")


def visits(index: PivotIndex, bounded: DataFrame) -> DataFrame:
    """(i, v, bound, cell, ring, piece): groups that may hold what a query within its bound seeks."""
    groups = _grouped(index, BLOCK_ROWS)
    named = bounded.sparkSession.createDataFrame(groups[["cell", "ring", "piece", "group"]], "cell int, ring int, piece int, group int")
    each = _block_visits(index, bounded, groups).select("i", "v", "bound", F.explode("groups").alias("group"))
    return each.join(named, "group").select("i", "v", "bound", "cell", "ring", "piece")


def _met(index: PivotIndex, bounded: DataFrame, rows: int, cell_rows: int, k: int | None) -> DataFrame:
    """Visits against members. Both are sent in large blocks, so that every vector is sent once per block of the others; a block that many queries
    visit is repeated, one copy per ``QUERY_ROWS`` of them. Few rows are cut finer, so that all cores have some."""
    spark = bounded.sparkSession
    n = wide_partitions(spark)
    fine = max(cell_rows, rows // (2 * math.isqrt(spark.sparkContext.defaultParallelism)))
    groups = _grouped(index, min(BLOCK_ROWS, fine))
    asked = _block_visits(index, bounded, groups)
    crowds = stage(asked.groupBy("block").agg(F.count(F.lit(1)).alias("asked")).withColumn("parts", F.ceil(F.col("asked") / min(QUERY_ROWS, fine)).cast("int")))
    parts = crowds.select("block", "parts")
    queries = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("i"), F.col("parts")).cast("int"))
    # whole types: both sides are dealt by the hash of an int
    places = spark.createDataFrame(groups[["cell", "ring", "piece", "group", "block"]], "cell int, ring int, piece int, group int, block int")
    held = index.members.select("i", "v", "cell", "ring", "piece").join(places, ["cell", "ring", "piece"]).join(parts, "block")
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key, by = index.members.schema["i"].dataType.simpleString(), ["block", "part"]
    return (
        queries.select("i", "v", "bound", "groups", *by).repartition(n, *by).groupBy(*by)
        .cogroup(held.select("i", "v", "group", *by).repartition(n, *by).groupBy(*by))
        .applyInPandas(lambda a, b: _block_pairs(a, b, k), f"i {key}, j {key}, d double")
    )


def search(points: DataFrame, coord: str, k: int | None = None, threshold: float | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(i, j, d) of pairs within ``threshold``, or a superset of each point's k nearest with those among them.

    ``coord`` is an array column of one length; regions are distinct. Where k are sought, vectors that share one place are searched through the k + 1 smallest
    keys there, and those are the neighbours of every later copy.
    """
    kind = _vectors(points.schema[coord].dataType.simpleString())
    named = points.select(F.col("region").alias("i"), F.col(coord).cast(kind).alias("v"))
    rows = named.count()
    if rows <= cell_rows:
        alone = named.withColumn("bound", F.lit(math.inf if threshold is None else float(threshold))).withColumn("one", F.lit(0))
        key = named.schema["i"].dataType.simpleString()
        return alone.groupBy("one").applyInPandas(lambda a: _pairs(a, a, k), f"i {key}, j {key}, d double")
    if k is None:
        index = build(named, rows, cell_rows)
        return _met(index, index.members.withColumn("bound", F.lit(float(threshold))), rows, cell_rows, None)
    numbered = stage(named.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("i"))))
    distinct = numbered.where(F.col("copy") <= k + 1).select("i", "v")
    index = build(distinct, rows, cell_rows)
    searched = _met(index, _bounded(index, k), rows, cell_rows, k)
    spread = 32
    later = numbered.where(F.col("copy") > k + 1).select("i", "v", F.pmod(F.xxhash64("i"), F.lit(spread)).cast("int").alias("salt"))
    first = numbered.where(F.col("copy") <= k).select(F.col("i").alias("j"), "v", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt"))
    return searched.unionByName(later.join(first, ["v", "salt"]).select("i", "j", F.lit(0.0).alias("d")))

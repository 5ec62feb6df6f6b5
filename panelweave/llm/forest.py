"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

A tree halves its rows at the median of their projection on the difference of two random rows, down to leaves of
about ``leaf_rows``. The trees are fitted on a bounded sample; every row is then routed to its leaf in
every tree. A query walks all trees through one shared priority queue, whose priority is the smallest margin
on the path so far, and takes leaves in that order; the rows of these leaves are scored exactly.

How many leaves a query takes is measured, not guessed: for a bounded sample of queries the true neighbours
are found against all rows in blocks, and the smallest number that finds the share ``recall`` of
them is used for all. (In data without structure that is a large part of the table.)

Rows meet queries per *block*, a subtree of about ``block_rows`` rows: in a task a block's rows are held and the
queries stream past in batches, each sending its best few onward. Equal vectors are one row that carries its smallest ids, as
many as a result can need, so copies neither fill a leaf nor get lost.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelweave.llm.common import col, staged

TREES = 8
NEAREST = 20
LEAF_ROWS = 128
BLOCK_ROWS = 16_384
#: Rows that the trees are fitted on, at most about this many.
SAMPLE_ROWS = 32_768
#: Rows of the sample that a leaf keeps at least.
LEAF_SAMPLE = 8
#: Queries whose true neighbours are found to set the search, at most about this many.
TRIAL_QUERIES = 200
RECALL = 0.95
SEED = 11


@dataclass
class Forest:
    """All trees in one set of arrays. Children below zero are leaves: ~leaf."""

    normals: np.ndarray
    offsets: np.ndarray
    low: np.ndarray
    high: np.ndarray
    roots: list[int]
    block: np.ndarray
    tree: np.ndarray
    held: np.ndarray
    probes: int = field(default=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        made = np.empty((len(x), len(self.roots)), dtype=np.int32)
        for n, root in enumerate(self.roots):
            at = np.full(len(x), root, dtype=np.int64)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                side = np.einsum("ij,ij->i", x[inner], self.normals[node]) > self.offsets[node]
                at[inner] = np.where(side, self.high[node], self.low[node])
            made[:, n] = ~at
        return made

    def order(self, x: np.ndarray, limit: int | None = None) -> list[list[int]]:
        """Per query the leaves in the order in which the shared queue yields them, at least ``probes`` of them (all, if ``limit`` is negative)."""
        margins = (x @ self.normals.T - self.offsets).tolist() if len(self.offsets) else [[]] * len(x)
        low, high, tree, held = self.low.tolist(), self.high.tolist(), self.tree.tolist(), self.held.tolist()
        wanted = len(self.block) if limit == -1 else self.probes
        enough = min(NEAREST + 5, sum(held) // max(1, len(self.roots)))
        made = []
        for margin in margins:
            queue = [(-np.inf, root) for root in self.roots]
            found, seen, most = [], [0] * len(self.roots), 0
            while queue and (len(found) < wanted or most < enough):
                bound, at = heapq.heappop(queue)
                while at >= 0:
                    m = margin[at]
                    near, far = (high[at], low[at]) if m > 0 else (low[at], high[at])
                    heapq.heappush(queue, (max(bound, abs(m)), far))
                    at = near
                    # the nearer side is at least as good as its parent, so the walk goes straight on
                found.append(~at)
                seen[tree[~at]] += held[~at]
                most = max(most, seen[tree[~at]])
            made.append(found)
        return made


def grow(sample: np.ndarray, leaf: int, block: int, trees: int, seed: int = SEED) -> Forest:
    """A forest over ``sample``; a leaf has at most ``leaf`` of its rows, a block's subtree at most ``block``."""
    normals, offsets, low, high, roots, blocks, owner, held = [], [], [], [], [], [], [], []
    rng = np.random.default_rng(seed)
    n_blocks = 0

    def below(rows: np.ndarray, tree: int, inside: int | None) -> int:
        nonlocal n_blocks
        if inside is None and len(rows) <= block:
            inside, n_blocks = n_blocks, n_blocks + 1
        if len(rows) <= leaf:
            if inside is None:
                inside, n_blocks = n_blocks, n_blocks + 1
            blocks.append(inside)
            owner.append(tree)
            held.append(len(rows))
            return ~(len(blocks) - 1)
        a, b = sample[rng.choice(rows, 2, replace=False)]
        normal = (a - b) / (np.linalg.norm(a - b) or 1.0)
        # the projection is taken as routing takes it, so that a row goes the same way later
        along = np.einsum("ij,ij->i", sample[rows], np.broadcast_to(normal, (len(rows), len(normal))))
        cut = np.sort(along)[(len(rows) - 1) // 2]
        up = along > cut
        if not up.any():
            # more than half of the rows share the largest projection
            cut = along[along < cut].max(initial=-np.inf)
            up = along > cut
        if up.all():
            normal = np.zeros_like(normal)
            blocks.append(inside if inside is not None else n_blocks)
            n_blocks += inside is None
            owner.append(tree)
            held.append(len(rows))
            return ~(len(blocks) - 1)
        at = len(normals)
        normals.append(normal)
        offsets.append(cut)
        low.append(0)
        high.append(0)
        low[at] = below(rows[~up], tree, inside)
        high[at] = below(rows[up], tree, inside)
        return at

    for tree in range(trees):
        roots.append(below(np.arange(len(sample)), tree, None))
    width = sample.shape[1]
    return Forest(
        np.array(normals, dtype=np.float64).reshape(-1, width), np.array(offsets, dtype=np.float64), np.array(low, dtype=np.int64), np.array(high, dtype=np.int64),
        roots, np.array(blocks, dtype=np.int32), np.array(owner, dtype=np.int32), np.array(held, dtype=np.int64),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of an Arrow list column of equal lengths, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): one row per id (the smallest of several vectors), of the usual length; null, zero or non-finite vectors are out."""
    v = col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = rows.where(col(key).isNotNull() & v.isNotNull()).where(fine).groupBy(col(key).cast("bigint").alias("id")).agg(F.min(v).alias("v"))
    good = staged(good)
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (lengths["n"] if lengths else 0))


def _exact(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (q * m).sum(axis=1)


def _best(query: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int, tie: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query: largest score first, then the smaller ``tie`` (the id itself, if not given)."""
    order = np.lexsort((ident if tie is None else tie, -score, query))
    query, score, ident = query[order], score[order], ident[order]
    start = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
    place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    return query[place < k], score[place < k], ident[place < k]


def _trial(classes: DataFrame, forest, trial: np.ndarray, k: int) -> np.ndarray:
    """Leaves, one row per true neighbour of the trial queries, as (query, leaf in each tree)."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast((forest, trial))

    def run(batches):
        forest, q = shared.value
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x, ids = _matrix(part.column("v")), part.column("least").to_numpy()
                scores = q @ x.T
                # the query's own row is not a neighbour
                scores[(x[None, :, 0] == q[:, :1]) & np.isclose(scores, _exact(q, q)[:, None], rtol=1e-12)] = -np.inf
                few = min(k, len(ids))
                top = np.argpartition(-scores, few - 1, axis=1)[:, :few]
                leaves = forest.leaves(x)
                made = [np.repeat(np.arange(len(q)), few), np.take_along_axis(scores, top, 1).ravel(), leaves[top.ravel()]]
                held = made if held is None else [np.concatenate(p) for p in zip(held, made)]
                order = np.lexsort((-held[1], held[0]))
                held = [h[order] for h in held]
                start = np.searchsorted(held[0], held[0])
                keep = np.arange(len(held[0])) - start < k
                held = [h[keep] for h in held]
        if held is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(held[0].astype(np.int32)), pa.array(held[1]), pa.array(held[2].tolist(), pa.list_(pa.int32()))], names=["q", "score", "leaves"]
            )

    found = classes.mapInArrow(run, "q int, score double, leaves array<int>")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    rows = found.withColumn("place", place).where(F.col("place") <= k).where("score > double('-inf')").select("q", "leaves").collect()
    return np.array([[r["q"], *r["leaves"]] for r in rows], dtype=np.int64).reshape(-1, 1 + len(forest.roots))


def _fit(classes: DataFrame, queries: DataFrame, trees: int, leaf_rows: int, block_rows: int, sample_rows: int, trial_queries: int, recall: float, k: int) -> Forest | None:
    count, asked = classes.count(), queries.count()
    if not count or not asked:
        return None

    def drawn(df: DataFrame, key: str, wanted: int, of: int) -> np.ndarray:
        share = F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 30)) < int(min(1.0, wanted / of) * (1 << 30))
        table = df.where(share).select(key, "v").orderBy(F.xxhash64(key, F.lit(SEED)), key).limit(2 * wanted).toArrow()
        return _matrix(table.column("v").combine_chunks()) if table.num_rows else np.empty((0, 1))

    sample = drawn(classes, "least", sample_rows, count)
    if not len(sample):
        sample = _matrix(classes.select("v").limit(sample_rows).toArrow().column("v").combine_chunks())
    per_row = len(sample) / count
    forest = grow(sample, max(LEAF_SAMPLE, round(leaf_rows * per_row)), max(LEAF_SAMPLE, round(block_rows * per_row)), trees)
    trial = drawn(queries, "q", trial_queries, asked)
    if len(trial):
        truth = _trial(classes, forest, trial, k)
        ranks = []
        places = np.empty(len(forest.block), dtype=np.int64)
        orders = forest.order(trial, -1)
        for q in range(len(trial)):
            places[orders[q]] = np.arange(len(orders[q]))
            mine = truth[truth[:, 0] == q, 1:]
            ranks += places[mine].min(axis=1).tolist() if len(mine) else []
        forest.probes = 1 + int(np.quantile(ranks, recall, method="higher")) if ranks else 1
    return forest


def _routed(classes: DataFrame, shared) -> DataFrame:
    """Each row once per tree: (block, kind 0, leaves: the one leaf, id: null, ids, v)."""

    def run(batches):
        forest = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                leaves = forest.leaves(_matrix(part.column("v")))
                trees = leaves.shape[1]
                take = pa.array(np.repeat(np.arange(part.num_rows), trees))
                flat = leaves.ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(forest.block[flat]), pa.array(np.zeros(len(flat), np.int32)), lists, pa.nulls(len(flat), pa.int64()), part.column("ids").take(take), part.column("v").take(take)],
                    names=["block", "kind", "leaves", "q", "ids", "v"],
                )

    return classes.mapInArrow(run, f"block int, kind int, leaves array<int>, q bigint, ids array<bigint>, v {classes.schema['v'].dataType.simpleString()}")


def _asked(queries: DataFrame, shared) -> DataFrame:
    """Each query once per block that it looks into: (block, kind 1, leaves, q, ids: null, v)."""

    def run(batches):
        forest = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                blocks, lists, take = [], [], []
                for n, found in enumerate(forest.order(_matrix(part.column("v")))):
                    found = np.array(found, dtype=np.int32)
                    of = forest.block[found]
                    for b in np.unique(of).tolist():
                        blocks.append(b)
                        lists.append(found[of == b])
                        take.append(n)
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                leaves = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists or [np.empty(0, np.int32)])))
                some = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.int32()), pa.array([1] * len(take), pa.int32()), leaves, part.column("q").take(some), pa.nulls(len(take), pa.list_(pa.int64())), part.column("v").take(some)],
                    names=["block", "kind", "leaves", "q", "ids", "v"],
                )

    return queries.mapInArrow(run, f"block int, kind int, leaves array<int>, q bigint, ids array<bigint>, v {queries.schema['v'].dataType.simpleString()}")


class _Block:
    """Rows of one block by leaf; scores batches of queries."""

    def __init__(self, parts: list[pa.RecordBatch]):
        leaf = np.concatenate([p.column("leaves").flatten().to_numpy() for p in parts])
        order = np.argsort(leaf, kind="stable")
        self.x = np.concatenate([_matrix(p.column("v")) for p in parts])[order]
        leaf = leaf[order]
        ids = pa.concat_arrays([p.column("ids") for p in parts]).take(pa.array(order))
        self.ids, self.counts = ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())
        self.first = np.cumsum(self.counts) - self.counts
        self.longest = float(np.sqrt((self.x * self.x).sum(axis=1).max(initial=0.0)))
        start = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
        self.span = {int(leaf[a]): (int(a), int(b)) for a, b in zip(start, np.append(start[1:], len(leaf)))}

    def answer(self, part: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
        x, leaves = _matrix(part.column("v")), part.column("leaves")
        which = np.repeat(np.arange(part.num_rows), np.diff(leaves.offsets.to_numpy()))
        flat = leaves.flatten().to_numpy()
        order = np.argsort(flat, kind="stable")
        flat, which = flat[order], which[order]
        start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        queries, rows = [], []
        for a, b in zip(start, np.append(start[1:], len(flat))):
            if (span := self.span.get(int(flat[a]))) is None:
                continue
            q = which[a:b]
            scores = x[q] @ self.x[span[0] : span[1]].T
            # all rows that reach the k-th best score, as far as rounding may move it: ties must not lose smaller ids
            few = min(k, scores.shape[1])
            margin = 1e-12 * self.longest * np.sqrt((x[q] * x[q]).sum(axis=1)) + 1e-300
            least = np.partition(scores, scores.shape[1] - few, axis=1)[:, scores.shape[1] - few] - margin
            own, top = np.nonzero(scores >= least[:, None])
            queries.append(q[own])
            rows.append(span[0] + top)
        if not queries:
            return None
        query, row = np.concatenate(queries), np.concatenate(rows)
        query, score, row = _best(query, _exact(x[query], self.x[row]), row, k, self.ids[self.first[row]])
        # ties between rows are settled by id below: all ids of the rows chosen, and copies share a row
        n = self.counts[row]
        at = np.repeat(self.first[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        query, score, ident = _best(np.repeat(query, n), np.repeat(score, n), self.ids[at], k)
        start = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        found = pa.StructArray.from_arrays([pa.array(-score), pa.array(ident)], names=["minus", "id"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(query)).astype(np.int32)), found)
        return pa.RecordBatch.from_arrays([part.column("q").take(pa.array(query[start])), lists], names=["q", "found"])


def _searched(rows: DataFrame, k: int) -> DataFrame:
    """(q, found): per query and block the best ids."""
    ordered = rows.repartition("block").sortWithinPartitions("block", "kind")

    def run(batches):
        current, parts, block = None, [], None
        for batch in batches:
            ids, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            change = np.flatnonzero((ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip(np.concatenate(([0], change)).tolist(), np.append(change, len(ids)).tolist()):
                if a == b:
                    continue
                if ids[a] != current:
                    current, parts, block = ids[a], [], None
                if kinds[a] == 0:
                    parts.append(batch.slice(a, b - a))
                elif parts or block:
                    block = block or _Block(parts)
                    parts = []
                    for at in range(a, b, 256):
                        made = block.answer(batch.slice(at, min(256, b - at)), k)
                        if made is not None:
                            yield made

    return ordered.mapInArrow(run, "q bigint, found array<struct<minus:double,id:bigint>>")


def nearest(
    rows: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = NEAREST,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    block_rows: int = BLOCK_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    trial_queries: int = TRIAL_QUERIES,
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of each row where ``is_query`` (a condition on the column ``id``).

    Score is the inner product in double precision; equal scores are ordered by id; a row is not its own
    neighbour. Rows without id, and vectors that are null, empty, zero, of another than the usual length or with a
    null or non-finite component, take no part; of several vectors with one id the smallest counts.
    Fewer candidates than ``k`` give fewer rows, an empty table none.
    """
    spark = rows.sparkSession
    good = usable(rows, key, vector)
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = good.withColumn("place", place).where(F.col("place") <= k + 1)
    classes = staged(few.groupBy("v").agg(F.min("id").alias("least"), F.array_sort(F.collect_list("id")).alias("ids")))
    asking = good.where(is_query)
    queries = staged(asking.groupBy("v").agg(F.min("id").alias("q")))
    forest = _fit(classes, queries, trees, leaf_rows, block_rows, sample_rows, trial_queries, recall, k)
    if forest is None:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    shared = spark.sparkContext.broadcast(forest)
    searched = _searched(_routed(classes, shared).unionByName(_asked(queries, shared)), k + 1)
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k + 1)
    found = searched.groupBy("q").agg(best.alias("found"))
    members = asking.join(queries, "v").select("id", "q").withColumnRenamed("id", "query_id")
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return (
        members.join(found, "q")
        .select("query_id", F.posexplode(own).alias("place", "x"))
        .select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.minus")).alias("score"))
    )


def report(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by 20. Odd rows, ties and copies are treated as ``nearest`` says."""
    return nearest(embeddings, F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")

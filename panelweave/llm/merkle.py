"""Merkle manifest of a table, with a version of the tree per changed row.

Rows are leaves, ordered by key inside their group (a language, say); every two consecutive nodes have a parent until one is left,
the group's subroot; the subroots, ordered by group, likewise give the root. A digest is the lowercase hex SHA-256 of its concatenated inputs.

The tree is cut into aligned blocks of ``2 ** BLOCK_BITS`` leaves. A block is one small task: it yields its top node, and the tops
are the leaves of the next round of blocks, until each group has one node. Only tops (one row per block) meet in
later rounds; their paths to the root are composed downwards and come back to each block as one row. A block's tree is a
persistent one: a changed leaf makes a version that shares all nodes but the copied ancestors of the leaf inside the block, and the
version goes on through the upper levels along the path of its block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelweave.llm.common import col, staged
from panelweave.session import wide_partitions

BLOCK_BITS = 12


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class PersistentTree:
    """Nodes of one aligned block, stored once and never changed; a version is the number of its top node.

    ``height`` is how many levels the block takes part in: one of a larger tree has all its levels, whatever its leaves.
    """

    def __init__(self, leaves: Sequence[str], height: int):
        self.digests = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        level = list(range(len(leaves)))
        for _ in range(height):
            level = [self._node(tuple(level[at : at + 2])) for at in range(0, len(level), 2)]
        self.first = level[0]
        self.height = height

    def _node(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest(*(self.digests[c] for c in children)))
        self.children.append(children)
        return len(self.digests) - 1

    def path(self, place: int) -> list[tuple[int, tuple[int, ...]]]:
        """From the leaf upwards: (position of the child among its parent's children, those children)."""
        node, found = self.first, []
        for level in range(self.height - 1, -1, -1):
            side = place >> level & 1
            found.append((side, self.children[node]))
            node = self.children[node][side]
        return found[::-1]

    def siblings(self, place: int) -> list[str]:
        """From the leaf upwards, as ``folded`` reads them: L or R and the other child's digest; empty for an only child."""
        return [("RL"[side] + self.digests[children[1 - side]] if len(children) == 2 else "") for side, children in self.path(place)]

    def version(self, place: int, leaf: str) -> int:
        """A version with another leaf: its ancestors are copied, all other nodes shared."""
        path = self.path(place)
        self.digests.append(leaf)
        self.children.append(())
        node = len(self.digests) - 1
        for side, children in path:
            node = self._node((*children[:side], node, *children[side + 1 :]))
        return node

    def forget(self, size: int) -> None:
        """Drops the nodes that versions added behind the first ``size`` ones."""
        del self.digests[size:], self.children[size:]


def folded(node: str, siblings: Sequence[str]) -> str:
    """The top digest above ``node``, from its siblings."""
    for s in siblings:
        node = digest(node) if not s else digest(s[1:], node) if s[0] == "L" else digest(node, s[1:])
    return node


def height_of(nodes: int) -> int:
    return max(0, nodes - 1).bit_length()


def leaf_digest(*fields: Column) -> Column:
    """Digest of the fields' values: `-` if null, else UTF-8 bytes, a colon and the value."""

    def shown(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.encode(F.concat(*map(shown, fields)), "UTF-8"), 256)


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The rows with ``pos`` (from 0, by ``order`` inside ``group``) and ``n`` (rows of the group), written to the shared folder.

    Sorted by ranges over all partitions, so that a group of any size is spread; a partition's rows are counted per group and the counts
    summed up. No task holds more than its range; rows that agree in group and order take the places of one another.
    """
    spark = rows.sparkSession
    keys = [F.col(group), *(F.col(c) for c in order)]
    ordered = staged(rows.repartitionByRange(wide_partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("at"), 33)
    counts = ordered.groupBy(F.col(group).alias("same"), part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("same")
    starts = counts.select("same", "part", "first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), F.sum("size").over(whole).alias("n"))
    joined = ordered.join(starts, F.col(group).eqNullSafe(F.col("same")) & (part == F.col("part")))
    return joined.select(*(col(c) for c in rows.columns), (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n")


def _levels(n: int, bits: int) -> int:
    """Levels that a block takes part in, in a tree of ``n`` nodes."""
    return min(bits, height_of(n))


def _upper(nodes: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Paths (g, pos, siblings) and tops (g, top) of trees given as (g, pos, n, digest).

    Each round halves the number of nodes that remain ``bits`` times; paths are composed from the last round down.
    """
    rounds = []
    current = nodes
    kept = nodes.schema["g"].dataType.simpleString()
    while True:
        block = current.withColumn("block", F.shiftright("pos", bits))

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("pos")
            leaves, n = table.column("digest").to_pylist(), table.column("n")[0].as_py()
            tree = PersistentTree(leaves, _levels(n, bits))
            size = len(leaves)
            return pa.table({
                "g": table.column("g"), "pos": table.column("pos"), "block": table.column("block"),
                "n": pa.array([-(-n // (1 << bits))] * size, pa.int64()), "siblings": pa.array([tree.siblings(k) for k in range(size)], pa.list_(pa.string())),
                "top": pa.array([tree.digests[tree.first]] * size, pa.string()),
            })

        made = staged(block.groupBy("g", "block").applyInArrow(run, f"g {kept}, pos bigint, block bigint, n bigint, siblings array<string>, top string"))
        rounds.append(made)
        tops = made.where(F.col("pos") == F.shiftleft("block", bits)).select("g", F.col("block").alias("pos"), "n", F.col("top").alias("digest"))
        if (most := tops.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        current = tops
    paths = rounds[-1].select("g", "pos", "siblings")
    for made in rounds[-2::-1]:
        above = paths.select(F.col("g").alias("h"), F.col("pos").alias("parent"), F.col("siblings").alias("more"))
        joined = made.join(above, F.col("g").eqNullSafe(F.col("h")) & (F.col("block") == F.col("parent")))
        paths = joined.select("g", "pos", F.concat("siblings", "more").alias("siblings"))
    return paths, tops.select("g", F.col("digest").alias("top"))


@dataclass
class Manifest:
    """``leaves``: the given rows with leaf, changed, pos, n and block; ``blocks``: (g, block, siblings above the block, subroot, root) per block."""

    leaves: DataFrame
    blocks: DataFrame
    group: str
    bits: int


def manifest(rows: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf", bits: int = BLOCK_BITS) -> Manifest:
    """The tree over the digests in the column ``leaf``, rows by ``order`` inside ``group`` (a string; null is a group, the first one).

    Null keys come first; rows that agree in group, order and leaf are leaves of their own, next to each other.
    """
    leaves = placed(rows, group, [*order, leaf]).withColumn("block", F.shiftright("pos", bits))

    def top(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        tree = PersistentTree(table.column("leaf").to_pylist(), _levels(n, bits))
        return pa.table({"g": table.column("g").slice(0, 1), "pos": table.column("block").slice(0, 1), "n": pa.array([-(-n // (1 << bits))], pa.int64()), "digest": pa.array([tree.digests[tree.first]])})

    some = leaves.select(F.col(group).alias("g"), "pos", "n", "block", F.col(leaf).alias("leaf"))
    tops = staged(some.groupBy("g", "block").applyInArrow(top, "g string, pos bigint, n bigint, digest string"))
    paths, subroots = _upper(tops, bits)
    # the subroots are one more tree, of one group, ordered by the bytes of the group's name
    ordered = staged(placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("digest")), "g", ["name"]))
    over, roots = _upper(ordered, bits)
    more = over.join(roots, "g").select("pos", F.col("siblings").alias("more"), F.col("top").alias("root"))
    named = ordered.join(more, "pos").select("name", F.col("digest").alias("subroot"), "more", "root")
    blocks = paths.join(named, F.col("g").eqNullSafe(F.col("name"))).select(
        "g", F.col("pos").alias("block"), F.concat("siblings", "more").alias("siblings"), "subroot", "root"
    )
    return Manifest(leaves, blocks, group, bits)


def versions(tree: Manifest, key: str, leaf: str = "leaf", changed: str = "changed") -> DataFrame:
    """Per row: key, leaf, subroot, root, ``siblings`` (its proof), and ``folded_root``: of its version if ``changed`` is a digest, else of its own leaf.

    A block and the path above it are one small task: of at most ``2 ** bits`` rows, whatever the size of the group.
    """
    bits, kind = tree.bits, tree.leaves.schema[key].dataType.simpleString()

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        leaves, others, n = rows.column("leaf").to_pylist(), rows.column("changed").to_pylist(), rows.column("n")[0].as_py() if rows.num_rows else 0
        subroot, root = above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
        upper = above.column("siblings")[0].as_py()
        block = PersistentTree(leaves, _levels(n, bits))
        size = len(block.digests)
        proofs, ends = [], []
        for place, (own, other) in enumerate(zip(leaves, others)):
            inner = block.siblings(place)
            proofs.append(inner + upper)
            if other is None:
                ends.append(folded(own, proofs[-1]))
            else:
                ends.append(folded(block.digests[block.version(place, other)], upper))
                block.forget(size)
        count = rows.num_rows
        return pa.table({
            "key": rows.column("key"), "leaf": rows.column("leaf"), "subroot": pa.array([subroot] * count, pa.string()), "root": pa.array([root] * count, pa.string()),
            "siblings": pa.array(proofs, pa.list_(pa.string())), "folded_root": pa.array(ends, pa.string()),
        })

    some = tree.leaves.select(F.col(tree.group).alias("g"), "block", "pos", "n", col(key).alias("key"), col(leaf).alias("leaf"), col(changed).alias("changed"))
    made = some.groupBy("g", "block").cogroup(tree.blocks.groupBy("g", "block")).applyInArrow(
        run, f"key {kind}, leaf string, subroot string, root string, siblings array<string>, folded_root string"
    )
    return made.withColumnRenamed("key", key)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, for leaves of doc_id, source, lang, n_chars and text by doc_id inside lang.

    Tampering adds 1 to n_chars where 7 divides the checksum of doc_id; a null doc_id or n_chars is not tampered with. Null columns, empty and long
    texts are leaves like any other; of rows with one doc_id the smaller leaf comes first, equal rows have proofs of their own. An empty
    table has no rows.
    """
    names = ("doc_id", "source", "lang", "n_chars", "text")
    own = leaf_digest(*map(col, names))
    other = leaf_digest(*(F.try_add(col(c), F.lit(1).cast(docs.schema[c].dataType)) if c == "n_chars" else col(c) for c in names))
    tampered = (F.crc32(col("doc_id").cast("string")) % 7 == 0) & col("n_chars").isNotNull()
    rows = docs.select(col("doc_id"), col("lang").cast("string").alias("lang"), own.alias("leaf"), F.when(tampered, other).alias("changed"))
    proof = F.sha2(F.encode(F.array_join(F.transform("siblings", lambda s: F.substring(s, 2, 64)), ""), "UTF-8"), 256)
    return versions(manifest(rows, "lang", ["doc_id"]), "doc_id").select(
        "doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )

"""Near-duplicates by SimHash, found with covering locality-sensitive hashing.

Every bit position gets a nonzero vector of r+1 bits, r being the radius. A table belongs to each
nonzero vector v and keeps the bits whose vector has an odd product with v. Any r positions leave some
v orthogonal to all of them, so two fingerprints that differ in at most r bits agree on all kept
bits of at least one of the 2^(r+1)-1 tables: no close pair is missed.

Equal fingerprints are one row. In a bucket, a search from row to row yields a spanning set of links, at most one
per member, never all pairs. A bucket of more than ``BUCKET_ROWS`` fingerprints is not held: its rows are
dealt again by a second, differently arranged family of masks; with a radius of 3, at least 45 bits are then
fixed, so at most 2^19 different fingerprints can share a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField

from panelweave.llm.common import col, fresh, map_texts, staged
from panelweave.llm.components import components

BITS = 64
SHINGLE = 3
RADIUS = 3
SEED = 42
#: Different fingerprints of one bucket that a task holds in the first pass.
BUCKET_ROWS = 20_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles' XXH64, repeats included; 0 without words."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], dtype="<u8"
    )
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """``keep`` columns (all by default) and the fingerprint as a bigint of the same bits. A text without words, null included, has 0; ``name`` gets
    underscores in front where a kept column has it."""
    keep = docs.columns if keep is None else keep
    (name,) = fresh(docs.select(*map(col, keep)), name)

    def start():
        return lambda texts: (np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64),)

    return map_texts(docs, text, keep, [StructField(name, LongType())], start)


def masks(radius: int = RADIUS, arrangement: int = 1) -> list[int]:
    """The bit masks of the tables, as signed 64-bit numbers. ``arrangement`` deals the vectors over the positions in another order."""
    count = (1 << radius + 1) - 1
    # any nonzero vectors guarantee the collision; these two arrangements leave few bits free in common
    vectors = [1 + (p if arrangement == 1 else p % count * 5 + p // count * 6) % count for p in range(BITS)]
    made = [sum(1 << p for p, vector in enumerate(vectors) if (vector & v).bit_count() % 2) for v in range(1, count + 1)]
    return [m - (1 << BITS) if m >> BITS - 1 else m for m in made]


def _dealt(rows: DataFrame, fp: str, radius: int, arrangement: int, before: list[str]) -> DataFrame:
    """One row per table: ``before`` columns, table number, kept bits, fingerprint."""
    tables = F.array(*(F.struct(F.lit(n).alias("t"), col(fp).bitwiseAND(F.lit(m)).alias("k")) for n, m in enumerate(masks(radius, arrangement))))
    return rows.select(*before, F.col(fp).alias("fp"), F.explode(tables).alias("x")).select(
        *before, F.col("x.t").alias(f"t{arrangement}"), F.col("x.k").alias(f"k{arrangement}"), "fp"
    )


def bucket_links(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of distance ``radius`` or less that connect what such links connect among ``members`` (distinct, uint64)."""
    links = []
    waiting = members
    while len(waiting) > 1:
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            here = front.pop()
            near = np.bitwise_count(waiting ^ here) <= radius
            if near.any():
                found = waiting[near]
                links += [(int(here), int(x)) for x in found]
                front += list(found)
                waiting = waiting[~near]
    return links


def _rows(a, b, table: int | None) -> pa.RecordBatch:
    """Output rows: links (a, b), or with ``table`` the members a of a bucket that is too large."""
    a = pa.array(np.asarray(a, dtype=np.uint64).view(np.int64))
    b = pa.array(np.asarray(b, dtype=np.uint64).view(np.int64)) if table is None else pa.nulls(len(a), pa.int64())
    t = pa.nulls(len(a), pa.int32()) if table is None else pa.array(np.full(len(a), table, dtype=np.int32))
    return pa.RecordBatch.from_arrays([a, b, t], names=["a", "b", "t"])


class _Buckets:
    """Reads fingerprints in bucket order; at most ``limit`` of one bucket are held."""

    def __init__(self, keys: list[str], radius: int, limit: int | None):
        self.keys, self.radius, self.limit = keys, radius, limit
        self.key, self.held, self.size, self.over = None, [], 0, False

    def _add(self, key: tuple, fps: np.ndarray):
        if key != self.key:
            yield from self._close()
            self.key = key
        self.held.append(fps)
        self.size += len(fps)
        self.over |= self.limit is not None and self.size > self.limit
        if self.over:
            yield _rows(np.concatenate(self.held), None, int(key[0]))
            self.held = []

    def _close(self):
        if self.size > 1 and not self.over and (found := bucket_links(np.concatenate(self.held), self.radius)):
            yield _rows(*zip(*found), None)
        self.key, self.held, self.size, self.over = None, [], 0, False

    def run(self, batches):
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in self.keys]
            fps = batch.column("fp").to_numpy().view(np.uint64)
            if not len(fps):
                continue
            new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            starts = np.concatenate(([0], np.flatnonzero(new) + 1))
            ends = np.append(starts[1:], len(fps))
            sizes = ends - starts
            # the first and last bucket may go on in other batches; lone rows between need nothing
            # and pairs, the usual case, are compared at once
            inner = np.arange(1, len(starts) - 1)
            pairs = starts[inner[sizes[inner] == 2]]
            near = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= self.radius]
            if len(near):
                yield _rows(fps[near], fps[near + 1], None)
            more = inner[sizes[inner] > 2].tolist()
            for n in [0, *more, *([len(starts) - 1] if len(starts) > 1 else [])]:
                yield from self._add(tuple(int(c[starts[n]]) for c in columns), fps[starts[n] : ends[n]])
        yield from self._close()


def _linked(dealt: DataFrame, keys: list[str], radius: int, limit: int | None) -> DataFrame:
    """(a, b, t): links found in the buckets, and the members a of table t's buckets beyond ``limit`` (b null)."""
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return ordered.mapInArrow(lambda batches: _Buckets(keys, radius, limit).run(batches), "a bigint, b bigint, t int")


def links(fps: DataFrame, fp: str = "fp", radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links among the distinct, non-null fingerprints ``fp`` that connect all that distance ``radius`` or less connects."""
    rows = fps.select(col(fp).alias("fp")).where("fp IS NOT NULL").distinct()
    first = staged(_linked(_dealt(rows, "fp", radius, 1, []), ["t1", "k1"], radius, bucket_rows))
    found = first.where("t IS NULL").select("a", "b")
    large = first.where("t IS NOT NULL")
    if large.isEmpty():
        return found
    kept = F.element_at(F.array(*(F.lit(m) for m in masks(radius, 1))), F.col("t") + 1)
    again = large.select(F.col("t").alias("t1"), F.col("a").bitwiseAND(kept).alias("k1"), F.col("a").alias("fp"))
    second = _dealt(again, "fp", radius, 2, ["t1", "k1"])
    return found.union(_linked(second, ["t1", "k1", "t2", "k2"], radius, None).select("a", "b"))


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, root, component_id) of every fingerprint in ``docs``; component_id is the smallest ``key`` of the group.

    Null keys are never the smallest; a group with null keys only has a null component_id. Texts without words
    share the fingerprint zero and are linked like any other.
    """
    return _grouped(fingerprints(docs, text, [key], shingle), key, radius, bucket_rows)


def _grouped(marked: DataFrame, key: str, radius: int, bucket_rows: int) -> DataFrame:
    least = marked.groupBy("fp").agg(F.min(col(key)).alias("least"))
    roots = components(links(least, "fp", radius, bucket_rows))
    rooted = staged(least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def hexadecimal(fp: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def report(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id, nulls aside). Repeated rows are in one component, texts without
    words have fingerprint zero and are linked like others, an empty table has no rows."""
    marked = staged(fingerprints(docs, "text", ["doc_id"], shingle))
    found = _grouped(marked, "doc_id", radius, BUCKET_ROWS)
    return marked.join(found, "fp").select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest key, then the smallest text among equal keys.

    Same columns. Repeated rows are copies, so one of them stays; null keys come last, so a group of
    them keeps one row too.
    """
    fp, root, wanted, rank = fresh(docs, "fp", "root", "component_id", "rank")
    marked = staged(fingerprints(docs, text, docs.columns, shingle, fp))
    found = _grouped(marked.select(col(key).alias("key"), F.col(fp).alias("fp")), "key", radius, BUCKET_ROWS)
    found = found.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(wanted))
    chosen = marked.join(found, fp).where(F.coalesce(col(key) == col(wanted), col(wanted).isNull()))
    order = Window.partitionBy(root).orderBy(col(key).asc_nulls_last(), col(text).asc_nulls_last())
    return chosen.withColumn(rank, F.row_number().over(order)).where(col(rank) == 1).select(*(col(c) for c in docs.columns))

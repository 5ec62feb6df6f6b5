"""Substring dedup with fixed-block anchors.

Words are runs of non-space characters; a *window* is ``WINDOW`` consecutive words of one document. A word goes
if it lies in a window that also starts in a document with a smaller key. Windows are judged on the
input.

Every document is cut into non-overlapping blocks of half a window; any window contains a whole block of its
own document. The blocks are the index, kept for the smallest document that has them. Every rolling block-long
window of every document probes it; a hit in a smaller document is an anchor. Around each anchor, on both sides of it, the
windows that contain it are compared exactly (128-bit digests), which extends the hit to the maximal
repeats. A repeat is found because the first document that holds a window either owns the block in it or
is itself anchored there, and so is each later one.

Index and probes travel packed: per batch of texts and bucket one row of 40-bit keys (the bucket adds
further bits), documents and positions. A false match only adds windows to compare. Whole copies of a
text are settled by its digest before, so they take no part in the exact comparison.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField

from panelweave.llm.common import col, discard, map_texts, pieces, staged

WINDOW = 50
#: Bytes of text whose probes are packed together.
BATCH_BYTES = 4 << 20
#: Blocks of the index in one bucket, on average.
BUCKET_BLOCKS = 1_000_000
LEAST_BUCKETS = 64
#: Words whose hashes a worker remembers.
REMEMBERED = 300_000

_EMPTY = hashlib.sha256(b"").hexdigest()
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


class WordHashes(dict):
    """64-bit hash per word, remembered up to a bound."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Mixed polynomial hash of every ``size`` consecutive entries, put together from runs of 1, 2, 4, … entries."""
    count = len(hashes) - size + 1
    if count < 1:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(count, dtype=np.uint64)
        run, power, length, done = hashes, base, 1, 0
        while True:
            if size & length:
                total = total * power + run[done : done + count]
                done += length
            if 2 * length > size:
                break
            run = run[:-length] * power + run[length:]
            power = power * power
            length *= 2
        total ^= total >> np.uint64(31)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(29)
    return total


def _packed(bucket: int, kind: int, keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple:
    """One row: keys of 5 bytes, the documents in use, and per entry its document's number and place, by byte planes."""
    used, which = np.unique(docs, return_inverse=True)

    def planes(x: np.ndarray, width: int) -> bytes:
        return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()

    return bucket, kind, len(keys), planes(keys, 5), used.astype("<i8").tobytes(), planes(which, 3), planes(places, 4)


def _unpacked(n: int, keys: bytes, docs: bytes, which: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def number(raw: bytes, width: int) -> np.ndarray:
        out = np.zeros((n, 8), dtype=np.uint8)
        out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T
        return out.view("<u8")[:, 0]

    return number(keys, 5), np.frombuffer(docs, dtype="<i8")[number(which, 3).astype(np.int64)], number(places, 4).astype(np.int64)


_PACKED = "bucket int, kind int, n int, keys binary, docs binary, which binary, places binary"
_PACKED_NAMES = [c.split()[0] for c in _PACKED.split(", ")]


def _entries(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """Packed index blocks (kind 0) and probes (kind 1) of the texts."""
    block = window // 2

    def run(batches):
        known = WordHashes(0)
        for batch in batches:
            for part in pieces(batch, "text", BATCH_BYTES):
                hashes, keys, sizes = [], [], []
                for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                    found = known.of(words_of(text))
                    if len(found) >= window:
                        hashes.append(found)
                        keys.append(key)
                        sizes.append(len(found))
                if not hashes:
                    continue
                mixed = rolling(np.concatenate(hashes), block, _BASES[0])
                ends = np.cumsum(sizes)
                doc = np.repeat(np.arange(len(sizes)), sizes)[: len(mixed)]
                at = np.arange(len(mixed)) - (ends - sizes)[doc]
                inside = at <= np.asarray(sizes)[doc] - block
                mixed, doc, at = mixed[inside], np.asarray(keys, dtype=np.int64)[doc[inside]], at[inside]
                bucket = (mixed % np.uint64(buckets)).astype(np.int64)
                short = mixed >> np.uint64(24)
                own = at % block == 0
                out = []
                for kind, chosen in ((0, np.flatnonzero(own)), (1, np.arange(len(at)))):
                    chosen = chosen[np.argsort(bucket[chosen], kind="stable")]
                    bounds = np.searchsorted(bucket[chosen], np.arange(buckets + 1))
                    for n in np.flatnonzero(np.diff(bounds)).tolist():
                        some = chosen[bounds[n] : bounds[n + 1]]
                        out.append(_packed(n, kind, short[some], doc[some], at[some]))
                columns = [list(x) for x in zip(*out)]
                types = [pa.int32()] * 3 + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_PACKED_NAMES)

    return rows.mapInArrow(run, _PACKED)


class _Bucket:
    """Index of one bucket: its keys, the smallest document of each and the places there."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.keys = None

    def add(self, entry: tuple) -> None:
        self.parts.append(entry)

    def close(self) -> None:
        if not self.parts:
            self.keys = np.empty(0, dtype=np.uint64)
            return
        keys, docs, places = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((places, docs, keys))
        keys, docs, places = keys[order], docs[order], places[order]
        start = np.concatenate(([True], keys[1:] != keys[:-1]))
        of = np.cumsum(start) - 1
        self.keys, self.least = keys[start], docs[start]
        kept = docs == self.least[of]
        self.of, self.places = of[kept], places[kept]
        self.used = np.zeros(len(self.keys), dtype=bool)
        self.parts = []

    def probe(self, keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and places of the entries that hit a smaller document."""
        if not len(self.keys):
            return docs[:0], places[:0]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = (self.keys[at] == keys) & (self.least[at] < docs)
        self.used[at[hit]] = True
        return docs[hit], places[hit]

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        if self.keys is None or not len(self.keys):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        chosen = self.used[self.of]
        return self.least[self.of[chosen]], self.places[chosen]


def _grouped(docs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(docs, kind="stable")
    docs, places = docs[order], places[order]
    start = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    offsets = np.append(start, len(docs)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(docs[start]), lists], names=["key", "at"])


def _anchors(entries: DataFrame) -> DataFrame:
    """(key, at): places of block-long windows that hit a smaller document, and of the index blocks they hit."""
    ordered = entries.repartition("bucket").sortWithinPartitions("bucket", "kind")

    def run(batches):
        current, held = None, _Bucket()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for bucket, kind, *rest in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    if bucket != current:
                        if current is not None and len((found := held.owners())[0]):
                            yield _grouped(*found)
                        current, held = bucket, _Bucket()
                    if kind == 0:
                        held.add(_unpacked(*rest))
                        continue
                    if held.keys is None:
                        held.close()
                    docs, places = held.probe(*_unpacked(*rest))
                    if len(docs):
                        yield _grouped(docs, places)
        if current is not None and len((found := held.owners())[0]):
            yield _grouped(*found)

    return ordered.mapInArrow(run, "key bigint, at array<int>")


def _near(places: list[int], count: int, reach: int) -> np.ndarray:
    """Starts, among ``count``, of the windows that contain a block at one of ``places``."""
    edge = np.zeros(count + 1, dtype=np.int64)
    at = np.unique(places)
    np.add.at(edge, np.maximum(at - reach, 0), 1)
    np.add.at(edge, np.minimum(at, count - 1) + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def _windows(held: DataFrame, window: int) -> DataFrame:
    """(w1, w2, key, version, at): digests of the windows around the anchors."""
    names = ["w1", "w2", "key", "version", "at"]

    def run(batches):
        known = WordHashes(0), WordHashes(1)
        for batch in batches:
            for part in pieces(batch, "text"):
                columns: list[list] = [[], [], [], [], []]
                for key, version, text, places in zip(*(part.column(c).to_pylist() for c in ("key", "version", "text", "places"))):
                    words = words_of(text)
                    count = len(words) - window + 1
                    # a key may have several texts, and the places of all of them
                    places = [p for p in places if p + window // 2 <= len(words)]
                    if count < 1 or not places:
                        continue
                    starts = _near(places, count, window - window // 2)
                    for n in (0, 1):
                        columns[n].append(rolling(known[n].of(words), window, _BASES[n])[starts].view(np.int64))
                    columns[2].append(np.full(len(starts), key))
                    columns[3].append(np.full(len(starts), version))
                    columns[4].append(starts.astype(np.int32))
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)

    return held.mapInArrow(run, "w1 bigint, w2 bigint, key bigint, version bigint, at int")


def _summary(rows: DataFrame) -> DataFrame:
    """key, number of words and digest of the words joined by spaces, per row."""

    def start():
        def work(texts):
            made = [words_of(t) for t in texts]
            return [len(w) for w in made], [hashlib.sha256(b" ".join(w)).hexdigest() for w in made]

        return work

    return map_texts(rows, "text", ["key"], [StructField("n_words", LongType()), StructField("digest", StringType())], start)


def repeated_words(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW):
    """Two tables: a summary (key, n_words, digest, copied) of every row, and (key, version, text, starts) of the texts
    with repeats that are no whole copies: starts are those of the windows to remove.

    Keys are integers. ``copied`` tells that the whole word sequence, of a window or more, is that of a smaller key:
    then every word goes. A row with a null key has no place in the order: it loses nothing and causes
    nothing. Equal keys are one document; rows that repeat get equal results.
    """
    rows = docs.select(col(key).cast("bigint").alias("key"), col(text).alias("text"))
    summary = staged(_summary(rows))
    first = summary.groupBy("digest").agg(F.min("key").alias("first"))
    copied = (F.col("n_words") >= window) & F.coalesce(F.col("key") > F.col("first"), F.lit(False))
    settled = staged(summary.join(first, "digest").select("key", "n_words", "digest", copied.alias("copied")))
    discard(summary)
    blocks = settled.agg(F.sum(F.col("n_words"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 + blocks // (window // 2) // BUCKET_BLOCKS)
    usable = rows.where("key IS NOT NULL AND text IS NOT NULL")
    anchors = staged(_anchors(_entries(usable, window, buckets)))
    places = (
        anchors.join(settled.where("NOT copied").select("key").distinct(), "key", "left_semi")
        .groupBy("key")
        .agg(F.flatten(F.collect_list("at")).alias("places"))
    )
    held = staged(usable.join(places, "key").select("key", F.xxhash64("text").alias("version"), "text", "places"))
    windows = staged(_windows(held, window))
    least = windows.groupBy("w1", "w2").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("most > least")
    later = windows.join(least, ["w1", "w2"]).where("key > least")
    starts = later.groupBy("key", "version").agg(F.collect_set("at").alias("starts"))
    return settled, held.select("key", "version", "text").join(starts, ["key", "version"])


def without_windows(words: list[bytes], starts: list[int], window: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The words that are left, and the maximal repeats [start, end) that went."""
    spans: list[tuple[int, int]] = []
    for s in sorted(starts):
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], s + window)
        else:
            spans.append((s, s + window))
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    return kept + words[at:], spans


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, repeats (maximal removed spans of words; null for none and for whole copies). Odd rows are treated as ``repeated_words`` says; a
    null text has no words."""
    settled, repeats = repeated_words(docs, window=window)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                made: list[list] = [[], [], [], [], []]
                for key, text, starts in zip(*(part.column(c).to_pylist() for c in ("key", "text", "starts"))):
                    words = words_of(text)
                    kept, spans = without_windows(words, starts, window)
                    for column, value in zip(
                        made,
                        (key, hashlib.sha256(b" ".join(words)).hexdigest(), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [list(s) for s in spans]),
                    ):
                        column.append(value)
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types)], names=["key", "digest", "gone", "kept", "repeats"])

    # equal keys with equal words have equal windows, so one row of them is enough
    cut = repeats.mapInArrow(run, "key bigint, digest string, gone bigint, kept string, repeats array<array<int>>").dropDuplicates(["key", "digest"])
    return settled.join(cut, ["key", "digest"], "left").select(
        F.col("key").alias("doc_id"),
        "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), F.lit(_EMPTY)).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
        F.when(~F.col("copied"), F.col("repeats")).alias("repeats"),
    )

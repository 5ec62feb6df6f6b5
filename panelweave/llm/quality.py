"""Quality of texts: random-indexing word vectors, pooled per text, under a two-layer network.

A text is a stream of words (lower case, digits included) and runs of other signs; a word all in capitals and a word said
again are followed by a mark. Every token has one of ``BUCKETS`` numbers by its hash and a fixed sparse index vector of +1 and -1.
A token's context vector is the sum of the index vectors of its neighbours over all texts of the table: whole numbers, summed up
in tasks and between them, so order and retries do not change them. Less what its frequency alone would give, and scaled
to length one, it is the token's word vector.

A text is pooled into the mean of its vectors and a mean that weighs frequent tokens down. A hidden layer and a logistic output
are fitted in numpy on a bounded sample of labelled rows; rows kept back from the fit choose how long it lasts and the temperature that
calibrates the probabilities.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField

from panelweave.llm.common import PIECE_BYTES, col, fresh, map_texts, pieces

BUCKETS = 1 << 14
DIMENSIONS = 32
#: Signs of an index vector that are not zero.
SIGNS = 4
#: Neighbours to each side.
WINDOW = 2
#: Labelled rows in the fit, at most; each label gets half of them.
SAMPLE_ROWS = 12_000
HIDDEN = 24
EPOCHS = 40
RATE = 0.003
DECAY = 1e-4
BATCH = 64
#: Share of tokens at which the second mean halves a token's weight.
COMMON = 0.001
THRESHOLD = 0.7
#: Tokens that a worker remembers, and tokens whose contexts are added up together.
REMEMBERED = 400_000
LOT = 200_000

_TOKENS = re.compile(r"\w+|[^\w\s]+")
#: Buckets of the marks; tokens have the others.
_CAPITALS, _AGAIN = 0, 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and values of each bucket's index vector; places that meet add up."""
    rng = np.random.default_rng(11)
    return rng.integers(0, DIMENSIONS, (BUCKETS, SIGNS)), rng.integers(0, 2, (BUCKETS, SIGNS)) * 2 - 1


class Tokens:
    """Bucket streams of texts; a worker remembers what it has met."""

    def __init__(self):
        self._forget()

    def _forget(self):
        self.place: dict[str, int] = {}
        #: Per remembered token: bucket, hash of the word (-1 for other tokens), whether it is in capitals.
        self.known = np.zeros((1024, 3), dtype=np.int64)

    def _learn(self, new: list[str]) -> None:
        base = len(self.place)
        if base + len(new) > len(self.known):
            grown = np.zeros((2 * (base + len(new)), 3), dtype=np.int64)
            grown[:base] = self.known[:base]
            self.known = grown
        low = [t.lower() for t in new]
        hashed = np.fromiter((zlib.crc32(t.encode()) for t in low), np.int64, len(low))
        words = np.fromiter(map(str.isalpha, low), bool, len(low))
        capitals = np.fromiter((len(t) > 1 and t.isupper() for t in new), bool, len(new))
        self.known[base : base + len(new)] = np.stack([2 + hashed % (BUCKETS - 2), np.where(words, hashed, -1), capitals], axis=1)
        self.place.update(zip(new, range(base, base + len(new))))

    def __call__(self, texts: list) -> list[np.ndarray]:
        """The stream of each text; null is empty."""
        if len(self.place) > REMEMBERED:
            self._forget()
        cut = [_TOKENS.findall(t) if t else [] for t in texts]
        place = self.place
        if new := list(dict.fromkeys(t for tokens in cut for t in tokens if t not in place)):
            self._learn(new)
        bucket, word, capital = self.known[:, 0], self.known[:, 1], self.known[:, 2]
        made = []
        for tokens in cut:
            at = np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))
            words, big = word[at], capital[at] > 0
            again = np.zeros(len(at), dtype=bool)
            again[1:] = (words[1:] == words[:-1]) & (words[1:] >= 0)
            ends = np.cumsum(1 + big + again)
            stream = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
            stream[ends - 1 - again - big] = bucket[at]
            stream[(ends - 1 - again)[big]] = _CAPITALS
            stream[(ends - 1)[again]] = _AGAIN
            made.append(stream)
        return made


class _Contexts:
    """Sums of index vectors around each bucket, and how often it was met."""

    def __init__(self):
        self.places, self.values = index_vectors()
        self.sums = np.zeros(BUCKETS * DIMENSIONS, dtype=np.int64)
        self.met = np.zeros(BUCKETS, dtype=np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, streams: list[np.ndarray]) -> None:
        for s in streams:
            if len(s):
                self.waiting += [s, np.full(WINDOW, -1, dtype=np.int64)]
                self.size += len(s)
        if self.size >= LOT:
            self.flush()

    def flush(self) -> None:
        line = np.concatenate(self.waiting) if self.waiting else np.empty(0, dtype=np.int64)
        self.waiting, self.size = [], 0
        for at in range(0, len(line), LOT):
            part = line[at : at + LOT + WINDOW]
            self.met += np.bincount(part[:LOT][part[:LOT] >= 0], minlength=BUCKETS)
            for d in range(1, WINDOW + 1):
                a, b = part[:-d][:LOT], part[d:][:LOT]
                good = (a >= 0) & (b >= 0)
                a, b = a[good], b[good]
                for own, other in ((a, b), (b, a)):
                    to = own[:, None] * DIMENSIONS + self.places[other]
                    self.sums += np.bincount(to.ravel(), self.values[other].ravel(), minlength=len(self.sums)).astype(np.int64)


def contexts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, met, v0, v1, …): whole-number sums over all texts, at most ``BUCKETS`` rows."""
    sums = [f"v{n}" for n in range(DIMENSIONS)]

    def run(batches):
        tokens, found = Tokens(), _Contexts()
        for batch in batches:
            for part in pieces(batch, text, PIECE_BYTES):
                found.add(tokens(part.column(text).to_pylist()))
        found.flush()
        some = np.flatnonzero(found.met)
        table = found.sums.reshape(BUCKETS, DIMENSIONS)[some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found.met[some]), *(pa.array(table[:, n]) for n in range(DIMENSIONS))], names=["bucket", "met", *sums])

    made = docs.select(col(text)).mapInArrow(run, "bucket int, met bigint, " + ", ".join(f"{s} bigint" for s in sums))
    return made.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("met", *sums)))


def word_vectors(bucket: np.ndarray, met: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all buckets and their weights in the second mean, from the rows of ``contexts``."""
    vectors, weights = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32), np.ones(BUCKETS, dtype=np.float32)
    if len(bucket):
        degree = met / met.sum()
        own = sums - (met / met.sum())[:, None] * sums.sum(axis=0)
        length = np.sqrt((own**2).sum(axis=1, keepdims=True))
        # contexts of a rare token are mostly chance: its vector is shorter
        vectors[bucket] = own / np.maximum(length, 1e-12) * (met / (met + 10))[:, None]
        weights[bucket] = COMMON / (COMMON + degree)
    return vectors, weights


class Pool:
    """Features of texts: both means and the length."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray):
        self.tokens, self.vectors, self.weights = Tokens(), vectors, weights

    def __call__(self, texts: list) -> np.ndarray:
        made = np.zeros((len(texts), 2 * DIMENSIONS + 1), dtype=np.float32)
        for row, stream in zip(made, self.tokens(texts)):
            if len(stream):
                # once per bucket, so that a long text needs no table of its length
                count = np.bincount(stream, minlength=BUCKETS) if len(stream) > BUCKETS else None
                some, n = np.unique(stream, return_counts=True) if count is None else (np.flatnonzero(count), count[np.flatnonzero(count)])
                v, w = self.vectors[some], n * self.weights[some]
                row[:DIMENSIONS] = n @ v / len(stream)
                row[DIMENSIONS:-1] = w @ v / w.sum()
                row[-1] = np.log1p(len(stream))
        return made


@dataclass
class Network:
    """Standardised features, a hidden layer of tanh, a logistic output, a temperature."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    return float((w * (np.logaddexp(0, z) - y * z)).sum() / w.sum())


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int = 5) -> Network:
    """Adam over small batches of rows (features, labels 0 or 1, weights); every fifth row is kept back."""
    x, y, w = x.astype(float), y.astype(float), w.astype(float)
    kept = np.arange(len(x)) % 5 == 4 if len(x) >= 10 else np.zeros(len(x), dtype=bool)
    xt, yt, wt = x[~kept], y[~kept], w[~kept] / w[~kept].mean()
    xb, yb, wb = (x[kept], y[kept], w[kept]) if kept.any() else (xt, yt, wt)
    rng = np.random.default_rng(seed)
    spread = xt.std(axis=0)
    share = np.clip((wt * yt).sum() / wt.sum(), 1e-3, 1 - 1e-3)
    net = Network(xt.mean(axis=0), np.where(spread > 1e-9, spread, 1.0), rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), float(np.log(share / (1 - share))))
    given = (xt - net.mean) / net.spread
    values = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    best, chosen, step = np.inf, [v.copy() for v in values], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(given))
        for at in range(0, len(order), BATCH):
            k = order[at : at + BATCH]
            hidden = np.tanh(given[k] @ values[0] + values[1])
            z = hidden @ values[2] + values[3]
            slope = wt[k] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - yt[k]) / len(k)
            inner = np.outer(slope, values[2]) * (1 - hidden**2)
            slopes = [given[k].T @ inner + DECAY * values[0], inner.sum(axis=0), hidden.T @ slope + DECAY * values[2], np.array([slope.sum()])]
            step += 1
            for v, g, m, s in zip(values, slopes, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
        if (loss := _loss(net.logits(xb), yb, wb)) < best:
            best, chosen = loss, [v.copy() for v in values]
    net.w1, net.b1, net.w2, net.b2 = chosen[0], chosen[1], chosen[2], float(chosen[3][0])
    z = net.logits(xb)
    net.temperature = min(np.geomspace(0.2, 5, 81).tolist(), key=lambda t: _loss(z / t, yb, wb))
    return net


@dataclass
class QualityModel:
    """Word vectors, their weights and the network; without a labelled row there is none and every score is one half."""

    vectors: np.ndarray
    weights: np.ndarray
    network: Network | None


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, text: str = "text", label: str = "quality", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """A model whose vectors come from all texts and whose network is fitted on at most ``sample_rows`` labelled ones.

    Labels are 0 or 1, others and those without key do not count; ``usable`` is a condition on the column ``id``. Each label gets half of
    the bound, drawn by a hash of the key, and its rows the weight that makes up for it. A key with both labels counts with each; a
    label without document does not.
    """
    found = contexts(docs, text).toPandas().sort_values("bucket")
    vectors, weights = word_vectors(found["bucket"].to_numpy(), found["met"].to_numpy(float), found.iloc[:, 2:].to_numpy(float))
    given = labels.select(col(key).alias("id"), col(label).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    given = given if usable is None else given.where(usable)
    counts = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    quota = max(1, sample_rows // 2)
    draw = F.xxhash64(F.col("id"), F.lit("quality sample"))
    parts = [given.where(F.col("label") == n).withColumn("draw", draw).orderBy("draw", "id").limit(quota) for n in (0, 1)]
    # at most sample_rows rows of three numbers
    picked = docs.select(col(key).alias("id"), col(text).alias("text")).join(F.broadcast(parts[0].unionByName(parts[1])), "id")
    shared = docs.sparkSession.sparkContext.broadcast((vectors, weights))

    def start():
        pool = Pool(*shared.value)
        return lambda texts: (list(pool(texts)),)

    made = map_texts(picked, "text", ["id", "label", "draw"], [StructField("x", ArrayType(FloatType()))], start)
    rows = made.orderBy("draw", "id", "label", F.xxhash64("x")).limit(sample_rows).toPandas()
    if rows.empty:
        return QualityModel(vectors, weights, None)
    y = rows["label"].to_numpy()
    w = np.array([counts[n] / min(quota, counts[n]) for n in y.tolist()])
    return QualityModel(vectors, weights, fit(np.stack(rows["x"].to_numpy()), y, w))


def scored(docs: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns (all by default) and the calibrated probability of label 1.

    A null or empty text has the features of no token, and a score from them; rows are treated one by one and whole. The score
    is named ``name``, with underscores in front where a kept column has that name.
    """
    keep = docs.columns if keep is None else keep
    (name,) = fresh(docs.select(*map(col, keep)), name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value
        pool = Pool(model.vectors, model.weights)
        return lambda texts: (model.network.scores(pool(texts)) if model.network else np.full(len(texts), 0.5),)

    return map_texts(docs, text, keep, [StructField(name, DoubleType())], start)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.7 on). Labels of rows whose crc32(doc_id) mod 4 is 2 are not learned from; a null doc_id is
    not held out. Null, empty and long texts, repeated rows and tables without rows are treated as ``train`` and ``scored`` say."""
    usable = F.crc32(F.col("id").cast("string")) % 4 != 2
    model = train(docs, labels, usable)
    held = F.coalesce(F.crc32(col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    rows = scored(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

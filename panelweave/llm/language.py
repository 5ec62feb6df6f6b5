"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word's subwords are the character n-grams (up to 4) of ``<word>``, hashed into ``BUCKETS`` rows of an
embedding table; a text is the mean embedding of all its subwords. The table and the softmax are
fitted by stochastic gradient descent in numpy on a bounded sample of labelled rows; each row trains
twice, by its whole text and by a few words of it, so that short texts are in the fit. Because mean
and softmax input are linear, a fitted model is one number per bucket and language, and a text's
scores are sums over its words.

Rows kept back from the fit give the temperature that calibrates the probabilities and, by text length, two
bars of rejection: a prediction is rejected below a probability, a text above a share of subwords whose
bucket the fit never met.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, StringType, StructField

from panelweave.llm.common import col, fresh, map_texts

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
GRAMS = 4
DIMENSIONS = 16
#: Labelled rows in the fit, shared equally by the languages.
SAMPLE_ROWS = 1_200
#: Languages that are learned, the most frequent ones first.
MOST_LABELS = 400
SHORT_WORDS = 6
EPOCHS = 6
RATE = 0.5
#: Share of rightly predicted texts of a length that each bar may lose.
LOSS = 0.001
#: Most words of the texts of each length but the last; bars are set for each.
LENGTHS = (SHORT_WORDS, 48)
#: Kept-back texts that a length needs for bars of its own; with fewer only texts half as new as random ones are rejected.
FEWEST = 50
#: Least bar of new subwords, as a share of what a text has whose buckets are random.
LEAST_NEW = 0.25
UNKNOWN = "und"
#: Words whose scores a worker remembers.
REMEMBERED = 80_000

#: Letters only: fractions, raised digits, Roman numerals and the like are none.
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def subwords(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and how many each word has; grams of one word stand together."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    letters = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(letters))
    found, owners = [], []
    with np.errstate(over="ignore"):
        hashed = np.zeros(len(letters), dtype=np.uint64)
        for n in range(1, GRAMS + 1):
            # position i has the hash of the n letters from i on; those that leave their word do not count
            hashed = hashed[: len(letters) - n + 1] * np.uint64(0x100000001B3) + letters[n - 1 :] + np.uint64(n)
            inside = np.flatnonzero(left[: len(hashed)] >= n)
            mixed = hashed[inside] * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
            owners.append(owner[inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order], np.bincount(owners, minlength=len(words))


def features(words: list[str]) -> tuple[list[int], list[float]]:
    """Buckets of a text and their shares."""
    if not words:
        return [], []
    distinct = Counter(words)
    buckets, sizes = subwords(list(distinct))
    total = np.bincount(buckets, np.repeat(np.fromiter(distinct.values(), float), sizes))
    found = np.flatnonzero(total)
    return found.tolist(), (total[found] / total.sum()).tolist()


@dataclass
class LanguageModel:
    """Scores per bucket and language, bias, temperature and the bar of rejection."""

    labels: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    #: One per length: least probability, largest share of new subwords.
    bars: tuple[float, ...] = (0.0,) * (len(LENGTHS) + 1)
    new_bars: tuple[float, ...] = (1.0,) * (len(LENGTHS) + 1)
    met: np.ndarray | None = None

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        z = (means + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def length_of(words: int) -> int:
    return int(np.searchsorted(LENGTHS, words))


def tail(values: np.ndarray, loss: float = LOSS) -> float:
    """The value below which a share ``loss`` lies, by a Pareto tail of the distances under the median (Hill's estimate
    from the lowest tenth, ten values at least).

    The lowest of a few hundred values would lose more than that, and so would a light tail.
    """
    if len(values) < 2:
        return -np.inf
    middle = np.median(values)
    far = np.sort(middle - values)[::-1]
    count = min(len(far) // 2, max(10, len(far) // 10))
    if far[count] <= 0:
        return float(values.min())
    power = np.log(far[:count] / far[count]).mean()
    return float(middle - far[count] * max(1.0, count / (len(far) * loss)) ** power)


def fit(rows: list[tuple], seed: int = 7) -> LanguageModel | None:
    """The model of (label, buckets, shares) rows; None without a usable row.

    Rows come as (whole, short) pairs of a document; those of every fifth document are kept back. A row may have
    further entries: its words, and (words, buckets, shares) of a piece of middle length that is looked at if the row is kept back.
    """
    rows = [r for r in rows if len(r[1])]
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    code = {label: n for n, label in enumerate(labels)}
    data = [(code[label], np.asarray(buckets, dtype=np.int32), np.asarray(shares, dtype=np.float32)) for label, buckets, shares, *_ in rows]
    # rows come as (whole, short) pairs of a document: both sides of a pair stay together
    train = [x for n, x in enumerate(data) if n // 2 % 5 != 4]
    back = [x for n, x in enumerate(data) if n // 2 % 5 == 4] or train
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (BUCKETS, DIMENSIONS)).astype(np.float32)
    met = np.zeros(BUCKETS, dtype=bool)
    for _, buckets, _ in train:
        met[buckets] = True
    table[~met] = 0
    out = rng.normal(0, 0.5, (DIMENSIONS, len(labels))).astype(np.float32)
    bias = np.zeros(len(labels), dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for n in rng.permutation(len(train)):
            y, buckets, shares = train[n]
            hidden = shares @ table[buckets]
            z = hidden @ out + bias
            slope = np.exp(z - z.max())
            slope /= slope.sum()
            slope[y] -= 1
            back_slope = out @ slope
            out -= rate * np.outer(hidden, slope)
            bias -= rate * np.float32(0.1) * slope
            # shares are small, so the step on the table is scaled by the number of buckets of the text
            table[buckets] -= rate * min(50, len(buckets)) * np.outer(shares, back_slope)
    model = LanguageModel(labels, table @ out, bias)
    means = np.stack([shares @ model.scores[buckets] for _, buckets, shares in back])
    truth = np.array([y for y, _, _ in back])

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return float(-np.log(np.maximum(model.probabilities(means)[np.arange(len(truth)), truth], 1e-12)).mean())

    model.temperature = min(np.geomspace(0.1, 10, 81).tolist(), key=loss)
    model.met = met
    chosen = [r for n, r in enumerate(rows) if n // 2 % 5 == 4] or rows
    judged = [(code[r[0]], *r[3:4], r[1], r[2]) for r in chosen if len(r) > 3]
    judged += [(code[r[0]], *r[4]) for r in chosen if len(r) > 4 and r[4] and len(r[4][1])]
    if judged:
        p = model.probabilities(np.stack([np.asarray(shares) @ model.scores[np.asarray(buckets)] for _, _, buckets, shares in judged]))
        right = p.argmax(axis=1) == [y for y, *_ in judged]
        best = np.clip(p.max(axis=1), 1e-12, 1 - 1e-12)
        odds = np.log(best / (1 - best))
        new = np.array([np.asarray(shares)[~met[np.asarray(buckets)]].sum() for _, _, buckets, shares in judged])
        length = np.array([length_of(n) for _, n, _, _ in judged])
        least = LEAST_NEW * (1 - met.mean())
        of = [right & (length == n) for n in range(len(LENGTHS) + 1)]
        model.bars = tuple(float(1 / (1 + np.exp(-tail(odds[x])))) - 1e-6 if x.sum() >= FEWEST else 0.0 for x in of)
        model.new_bars = tuple(float(max(-tail(-new[x]), least)) if x.sum() >= FEWEST else float(1 - met.mean()) / 2 for x in of)
    return model


def train(docs: DataFrame, usable: Column | None = None, text: str = "text", label: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """A model fitted on at most about ``sample_rows`` rows with text, label and key where ``usable`` holds.

    The count per label covers all rows; each of the ``MOST_LABELS`` most frequent labels gets an equal number of rows, drawn by a
    hash of the key, so a rare label keeps its share. Only features leave the executors.
    """
    given = col(text).isNotNull() & col(label).isNotNull() & col(key).isNotNull()
    labelled = docs.where(given if usable is None else given & usable)
    counts = labelled.groupBy(col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    learned = {r["label"]: r["n"] for r in counts.orderBy(F.desc("n"), "label").limit(MOST_LABELS).collect()}
    if not learned:
        return None
    quota = max(1, sample_rows // len(learned))
    # the wished rows of each label, with a margin so that no label is missed by chance
    wished = {k: min(n, max(16.0, quota + 3 * quota**0.5)) for k, n in learned.items()}
    shares = F.create_map(*(F.lit(x) for k, n in learned.items() for x in (k, wished[k] / n)))
    draw = F.pmod(F.xxhash64(col(key), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = labelled.select(
        col(label).cast("string").alias("label"), draw.alias("draw"), F.crc32(col(key).cast("string")).alias("pick"), col(text).alias("text")
    ).where(F.col("draw") < shares[F.col("label")])

    def start():
        def work(texts):
            made: list[list] = [[] for _ in range(8)]
            for text in texts:
                words = words_of(text)
                at = zlib.crc32(text.encode()) % max(1, len(words) - SHORT_WORDS)
                size = 1 + zlib.crc32(text[:99].encode()) % SHORT_WORDS
                middle = words[at : at + (SHORT_WORDS + 1) * (1 << zlib.crc32(text[:99].encode()) // SHORT_WORDS % 3)]
                for n, found in enumerate((features(words), features(words[at : at + size]), features(middle))):
                    made[2 * n].append(found[0])
                    made[2 * n + 1].append(found[1])
                made[6].append(len(words))
                made[7].append(min(size, len(words)))
            return made

        return work

    fields = [StructField(n, ArrayType(t)) for n, t in (("b", IntegerType()), ("s", FloatType()), ("b2", IntegerType()), ("s2", FloatType()), ("b3", IntegerType()), ("s3", FloatType()))]
    fields += [StructField(n, IntegerType()) for n in ("n", "n2")]
    made = map_texts(picked, "text", ["label", "draw", "pick"], fields, start)
    # twice what is wished of all labels together is a bound that the draws stay under, so it cuts no label
    rows = made.orderBy("draw", "pick", "label", F.xxhash64("b")).limit(2 * round(sum(wished.values())) + 100).toPandas()
    middle = SHORT_WORDS + 1
    return fit(
        [x for r in rows.itertuples() for x in ((r.label, r.b, r.s, r.n, (middle, r.b3, r.s3) if r.n >= middle else None), (r.label, r.b2, r.s2, r.n2))]
    )


class Scorer:
    """Scores texts in a worker; remembers the sums of words it has met."""

    def __init__(self, model: LanguageModel | None):
        self.model = model
        self._forget()

    def _forget(self):
        self.place: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.model.labels) + 2 if self.model else 2))

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            buckets, sizes = subwords(some)
            starts = np.cumsum(sizes) - sizes
            base = len(self.place)
            if base + len(some) > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros((max(len(self.sums), len(some)), self.sums.shape[1]))])
            self.sums[base : base + len(some), :-2] = np.add.reduceat(self.model.scores[buckets], starts, axis=0)
            if self.model.met is not None:
                self.sums[base : base + len(some), -2] = np.add.reduceat(~self.model.met[buckets], starts, dtype=float)
            self.sums[base : base + len(some), -1] = sizes
            self.place.update(zip(some, range(base, base + len(some))))

    def __call__(self, texts: list) -> tuple[list, list, list]:
        found, scores, rejected = [], [], []
        cut = [words_of(t) for t in texts] if self.model else [[]] * len(texts)
        if len(self.place) > REMEMBERED:
            self._forget()
        place = self.place
        self._learn(list(dict.fromkeys(w for words in cut for w in words if w not in place)))
        for words in cut:
            if not words:
                found.append(UNKNOWN)
                scores.append(0.0)
                rejected.append(True)
                continue
            total = self.sums[np.fromiter(map(place.__getitem__, words), np.int64, len(words))].sum(axis=0)
            p = self.model.probabilities(total[None, :-2] / total[-1])[0]
            best = int(p.argmax())
            found.append(self.model.labels[best])
            scores.append(float(p[best]))
            n = length_of(len(words))
            rejected.append(bool(p[best] < self.model.bars[n] or total[-2] / total[-1] > self.model.new_bars[n]))
        return found, scores, rejected


def identified(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: list[str] | None = None, names=("lang_pred", "score", "rejected")) -> DataFrame:
    """Per row: ``keep`` columns (all by default), predicted language, calibrated probability, whether it is rejected.

    A null, empty or letterless text is ``und`` with score 0 and is rejected; so is every text when there
    was no labelled row to learn from. Ties go to the alphabetically first label. Names get underscores in front where a kept column has them.
    """
    keep = docs.columns if keep is None else keep
    names = fresh(docs.select(*map(col, keep)), *names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), BooleanType()))]
    return map_texts(docs, text, keep, fields, lambda: Scorer(shared.value))


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that a model fitted on ``docs`` does not reject, with their columns."""
    names = fresh(docs, "lang_pred", "score", "rejected")
    marked = identified(docs, train(docs, text=text), text, names=tuple(names))
    return marked.where(~col(names[2])).select(*(col(c) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected. Rows whose crc32(doc_id) mod 4 is 2 are held out of the fit; a null doc_id is not, nor is it learned from."""
    held = F.coalesce(F.crc32(col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs, ~held)
    return identified(docs.select("doc_id", "text"), model, keep=["doc_id"]).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "rejected"
    )

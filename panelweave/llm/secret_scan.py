"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds to them.

A text is a sequence of words and single marks; each is tagged as beginning a secret, inside one, or outside.
A tag's score comes from the token's shape (length, letters, digits, case, disorder), from the shapes of its
neighbours and from features of the whole file; tag pairs have scores too. The weights are fitted by maximum likelihood in
numpy (forward-backward over padded windows) on a bounded sample of windows, labelled by the fixed patterns.

Decoding is Viterbi, exact: a token whose best secret score lies under the outside score by twice
the spread of the pair scores is outside in every best tagging, so only the stretches between such tokens
need the recursion. Scanning is one narrow pass.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from panelweave.llm.common import col, fresh, map_texts

#: Kinds in order, their patterns, the group whose length counts, and the least length.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
KINDS = [*PATTERNS, "crf"]
#: The hex pattern with its least length, which has the same matches as filtering all runs.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = {"password", "passwd", "secret", "token", "api", "key", "apikey", "api_key", "pwd", "auth", "credential", "credentials"}
_TOKEN = re.compile(r"\w+|[^\w\s]")

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Documents in which windows for the fit are sought, windows of either sort in the fit, and their length.
SAMPLE_DOCS = 8_000
SAMPLE_WINDOWS = 600
LENGTH = 48
STEPS = 100
#: Shapes and words that a worker remembers.
REMEMBERED = 200_000
FILE_FEATURES = 4


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost matches without overlap per kind; those too short are dropped."""
    found = []
    for kind, (pattern, group, least) in PATTERNS.items():
        if kind == "access" and "AKIA" not in text:
            continue
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if len(m.group(group)) >= least:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(token: str) -> tuple[str, ...]:
    """What is seen of a token."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return ("mark", f"mark {token}" if token in "\"'`:=-_./+#,;()[]{}<>@&%$!?*|\\" else "mark other")
    size = next(f"size {k}" for k in (1, 3, 5, 8, 12, 16, 20, 24, 32, 48, 1 << 60) if n <= k)
    seen = ["word", size]
    if token.isalpha():
        seen.append("upper" if token.isupper() else "lower" if token.islower() else "title" if token.istitle() else "mixed case")
    elif token.isdigit():
        seen.append("digits")
    else:
        letters = sum(c.isalpha() for c in token)
        seen += ["letters and digits", "half digits" if 2 * letters <= n else "few digits"]
        seen.append("upper" if token.isupper() else "lower" if token.islower() else "mixed case")
    if n >= 16 or n >= 8 and not token.isalpha():
        if all(c in "0123456789abcdef" for c in token):
            seen.append("hexadecimal")
        counts = Counter(token[:256])
        disorder = -sum(c / min(n, 256) * math.log2(c / min(n, 256)) for c in counts.values())
        seen.append(f"disorder {min(5, int(disorder * 2) // 2)}")
    if token.startswith("AKIA"):
        seen.append("access prefix")
    if token.lower() in _KEYWORDS:
        seen.append("keyword")
    return tuple(seen)


def file_features(marks: int, digits: int, keyword: bool, n: int) -> np.ndarray:
    return np.array([1.0, float(keyword), float(5 * marks > n), float(10 * digits > n)])


@dataclass
class Field:
    """Weights: per class and place (own, one before, two before, one after) three tag scores; file; tag pairs."""

    classes: dict[str, int]
    places: np.ndarray
    file: np.ndarray
    pairs: np.ndarray

    def row(self, seen: tuple[str, ...]) -> np.ndarray:
        """Scores that a token of this shape gives: (place, tag)."""
        at = [self.classes[c] for c in seen if c in self.classes]
        return self.places[:, at].sum(axis=1)


def viterbi(scores: np.ndarray, pairs: np.ndarray) -> list[int]:
    """Best tags of a stretch between outside tokens."""
    best = scores[0] + pairs[OUTSIDE]
    back = []
    for e in scores[1:]:
        step = best[:, None] + pairs
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + e
    tags = [int((best + pairs[:, OUTSIDE]).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def decode(scores: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and tags of the tokens that are not outside."""
    margin = np.maximum(scores[:, BEGIN], scores[:, INSIDE]) - scores[:, OUTSIDE]
    open_ = np.flatnonzero(margin > -2 * (pairs.max() - pairs.min()))
    if not len(open_):
        return open_, open_
    cuts = np.flatnonzero(np.diff(open_) > 1) + 1
    tags = np.concatenate([viterbi(scores[run], pairs) for run in np.split(open_, cuts)])
    kept = tags != OUTSIDE
    return open_[kept], tags[kept]


def _emissions(shapes: np.ndarray, rows: np.ndarray, file: np.ndarray) -> np.ndarray:
    """Tag scores of each token; ``rows``: per shape (place, tag)."""
    scores = rows[shapes, 0] + file
    scores[1:] += rows[shapes[:-1], 1]
    scores[2:] += rows[shapes[:-2], 2]
    scores[:-1] += rows[shapes[1:], 3]
    return scores


def fit(windows: list[tuple[list[str], list[int], list[float]]]) -> Field:
    """The field of (shapes, tags, file features) windows; a shape is its classes joined by tabs."""
    classes = {c: n for n, c in enumerate(sorted({c for shapes, _, _ in windows for s in shapes for c in s.split("\t")}))}
    width = len(classes)
    field = Field(classes, np.zeros((4, width, 3)), np.zeros((FILE_FEATURES, 3)), np.zeros((3, 3)))
    if not any(t for _, tags, _ in windows for t in tags):
        return field
    kinds = {s: n + 1 for n, s in enumerate(sorted({s for shapes, _, _ in windows for s in shapes}))}
    holds = np.zeros((len(kinds) + 1, width))
    for s, n in kinds.items():
        holds[n, [classes[c] for c in s.split("\t")]] = 1
    count = len(windows)
    seen = np.zeros((count, LENGTH + 3), dtype=np.int64)
    gold = np.zeros((count, LENGTH), dtype=np.int64)
    real = np.zeros((count, LENGTH), dtype=bool)
    files = np.zeros((count, FILE_FEATURES))
    for n, (shapes, tags, file) in enumerate(windows):
        seen[n, 2 : 2 + len(shapes)] = [kinds[s] for s in shapes]
        gold[n, : len(tags)] = tags
        real[n, : len(tags)] = True
        files[n] = file
    near = [seen[:, 2 - shift : 2 - shift + LENGTH] if shift >= 0 else seen[:, 3 : 3 + LENGTH] for shift in (0, 1, 2, -1)]
    given = np.eye(3)[gold] * real[..., None]
    pair_gold = np.einsum("nli,nlj->ij", given[:, :-1], given[:, 1:])
    names = ("places", "file", "pairs")
    moments = {k: [np.zeros_like(getattr(field, k)), np.zeros_like(getattr(field, k))] for k in names}
    for step in range(1, STEPS + 1):
        rows = np.einsum("sc,pct->spt", holds, field.places)
        scores = sum(rows[near[p], p] for p in range(4)) + (files @ field.file)[:, None, :]
        scores = np.where(real[..., None], scores, np.array([0.0, -50.0, -50.0]))
        ahead = np.empty_like(scores)
        ahead[:, 0] = scores[:, 0]
        for i in range(1, LENGTH):
            ahead[:, i] = np.logaddexp.reduce(ahead[:, i - 1, :, None] + field.pairs, axis=1) + scores[:, i]
        behind = np.zeros_like(scores)
        for i in range(LENGTH - 2, -1, -1):
            behind[:, i] = np.logaddexp.reduce(field.pairs + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        chance = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
        joint = np.exp(ahead[:, :-1, :, None] + field.pairs + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None])
        joint = (joint * (real[:, 1:])[..., None, None]).sum(axis=(0, 1))
        slope = (chance - given) / count
        places = np.empty_like(field.places)
        for p in range(4):
            by_kind = np.zeros((len(holds), 3))
            np.add.at(by_kind, near[p].ravel(), slope.reshape(-1, 3))
            by_kind[0] = 0
            places[p] = holds.T @ by_kind
        slopes = {"places": places, "file": files.T @ slope.sum(axis=1), "pairs": (joint - pair_gold) / count}
        for k in names:
            value = getattr(field, k)
            g = slopes[k] + 1e-4 * value
            first, second = moments[k]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            value -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return field


def _labelled(text: str) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    """Tokens, tags by the fixed patterns (the secret's own characters), and token places."""
    secrets = []
    for kind, (pattern, group, least) in PATTERNS.items():
        secrets += [m.span(group) for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text) if len(m.group(group)) >= least]
    tokens, places = [], []
    for m in _TOKEN.finditer(text):
        tokens.append(m.group())
        places.append(m.span())
    starts = np.array([p[0] for p in places])
    tags = [OUTSIDE] * len(tokens)
    for a, b in sorted(secrets, reverse=True):
        inside = range(int(np.searchsorted(starts, a)), int(np.searchsorted(starts, b)))
        for i in inside:
            tags[i] = INSIDE
        if inside:
            tags[inside[0]] = BEGIN
    return tokens, tags, places


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> Field:
    """A field fitted on at most ``sample_windows`` windows with secrets and as many without, from about ``sample_docs`` documents drawn by a hash of key and text."""
    rows = docs.where(col(text).isNotNull())
    count = rows.count()
    draw = F.xxhash64(col(key), col(text))
    share = int(min(1.0, sample_docs / max(count, 1)) * (1 << 30))
    picked = rows.where(F.pmod(draw, F.lit(1 << 30)) < share).select(draw.alias("draw"), col(text).alias("text"))

    def start():
        def work(texts):
            made = []
            for text in texts:
                tokens, tags, _ = _labelled(text)
                windows = []
                if tokens:
                    marked = [i for i, t in enumerate(tags) if t == BEGIN]
                    stops = -1
                    for i in marked:
                        if i > stops:
                            windows.append(max(0, i - LENGTH // 2))
                            stops = windows[-1] + LENGTH
                    windows.append(hashlib.blake2b(text.encode(), digest_size=4).digest()[0] * max(0, len(tokens) - LENGTH) // 256)
                    counted = Counter("keyword" if t.lower() in _KEYWORDS else "mark" if len(t) == 1 and not t.isalnum() else "digits" if t.isdigit() else "" for t in tokens)
                    file = file_features(counted["mark"], counted["digits"], counted["keyword"] > 0, len(tokens)).tolist()
                made.append([{"shapes": ["\t".join(shape(t)) for t in tokens[a : a + LENGTH]], "tags": tags[a : a + LENGTH], "file": file} for a in windows])
            return (made,)

        return work

    window = StructType([StructField("shapes", ArrayType(StringType())), StructField("tags", ArrayType(IntegerType())), StructField("file", ArrayType(DoubleType()))])
    found = map_texts(picked, "text", ["draw"], [StructField("windows", ArrayType(window))], start)
    each = found.select("draw", F.posexplode("windows").alias("n", "w"), F.exists("w.tags", lambda t: t > 0).alias("secret"))
    chosen = [each.where(c).orderBy("draw", "n", F.xxhash64("w")).limit(sample_windows).select("w").collect() for c in (F.col("secret"), ~F.col("secret"))]
    return fit([(r["w"]["shapes"], r["w"]["tags"], r["w"]["file"]) for rows_ in chosen for r in rows_])


class Scanner:
    """Finds all spans of texts in a worker."""

    def __init__(self, field: Field):
        self.field = field
        self._forget()

    def _forget(self):
        self.place: dict[str, int] = {}
        self.kinds: dict[tuple[str, ...], int] = {}
        self.rows = np.zeros((256, 4, 3))
        self.sort = np.zeros((256, 3), dtype=bool)

    def _learn(self, token: str) -> int:
        seen = shape(token)
        at = self.kinds.get(seen)
        if at is None:
            at = self.kinds[seen] = len(self.kinds)
            if at == len(self.rows):
                self.rows, self.sort = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.sort))
            self.rows[at] = self.field.row(seen)
            self.sort[at] = ["mark" in seen, "digits" in seen, "keyword" in seen]
        self.place[token] = at
        return at

    def added(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Spans that the field finds where no base span is; a span ends at a gap between characters."""
        tokens = _TOKEN.findall(text)
        if not tokens:
            return []
        if len(self.place) > REMEMBERED:
            self._forget()
        place = self.place
        shapes = np.array([place[t] if t in place else self._learn(t) for t in tokens])
        marks, digits, keywords = self.sort[shapes].sum(axis=0)
        file = file_features(marks, digits, keywords > 0, len(tokens)) @ self.field.file
        at, tags = decode(_emissions(shapes, self.rows, file), self.field.pairs)
        if not len(at):
            return []
        spans: list[list[int]] = []
        wanted = dict(zip(at.tolist(), tags.tolist()))
        for n, m in enumerate(_TOKEN.finditer(text)):
            if (tag := wanted.get(n)) is not None:
                if tag == INSIDE and spans and spans[-1][1] == m.start():
                    spans[-1][1] = m.end()
                else:
                    spans.append([m.start(), m.end()])
        return [(a, b, "crf") for a, b in spans if not any(a < y and x < b for x, y, _ in base)]

    def __call__(self, texts: list) -> tuple[list]:
        base = [base_spans(t) if t else [] for t in texts]
        every = [sorted(b + self.added(t, b), key=lambda s: (s[0], KINDS.index(s[2]))) if t else [] for t, b in zip(texts, base)]
        return ([[{"start": a, "end": z, "kind": k} for a, z, k in spans] for spans in every],)


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType())]))


def scanned(docs: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None, name: str = "secrets") -> DataFrame:
    """Per row: ``keep`` columns (all by default) and the spans (start, end, kind) in code points, by start, then kind.

    Kinds are ``assign``, ``access``, ``hex`` of the fixed patterns and ``crf`` for those that only the field
    finds. A null or empty text has no span. Rows are treated one by one, whole whatever their length, repeated ones alike. ``name`` gets
    underscores in front where a kept column has it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    keep = docs.columns if keep is None else keep
    (name,) = fresh(docs.select(*map(col, keep)), name)
    return map_texts(docs, text, keep, [StructField(name, SPANS)], lambda: Scanner(shared.value))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans. Odd rows are treated as ``scanned`` says."""
    found = scanned(docs.select("doc_id", "text"), train(docs), keep=["doc_id"])
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    counted = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(counted(kind) for kind in PATTERNS),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("secrets")).alias("spans"),
    )

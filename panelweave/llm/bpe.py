"""Byte-level BPE by speculation and verification.

A pre-token is first cut by greedy longest match into tokens. A sequence of tokens is what the merges
would give exactly if every two neighbours together encode to themselves. Whether they do is read off how the two were made: undoing
their merges from the last to the first, no pair that faces the other side may have a merge that comes before the one just undone. All
distinct pairs of many words walk back at once, in arrays. Only words with a failing pair are merged exactly, many at a time too.

Encoding and decoding are narrow passes. A vocabulary file is read on the driver and broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from panelweave.llm.common import col, fresh, map_texts

#: The pattern that cuts texts before the merges (fixed value of the byte-level tokenizers).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose tokens a worker remembers.
REMEMBERED = 300_000
#: Bytes up to which a word is merged by scanning rather than with a queue.
SHORT = 64
#: Words from which on arrays are cheaper than one word after the other.
MANY = 24
_NEVER = 1 << 40

_PRETOKENS = regex.compile(PATTERN)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if visible in Latin-1, else the next free letter from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class BytePairs:
    """A byte-level BPE vocabulary: pre-tokens, encoding, decoding."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = _byte_letters()
        self.ids = {bytes(letters[c] for c in token): n for token, n in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes = [b""] * self.size
        for token, n in self.ids.items():
            self.bytes[n] = token
        for token, n in self.special.items():
            self.bytes[n] = token.encode()
        self._split = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        # rank of a pair (first * size + second), and the token that each rank makes
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for pair in spec["model"]["merges"]:
            a, b = (bytes(letters[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.ranks[self.ids[a] * self.size + self.ids[b]] = len(self.made)
            self.made.append(self.ids[a + b])
        self.longest = max(map(len, self.ids))
        self._split_tokens()
        self._forget_words()

    def _split_tokens(self) -> None:
        """How each token is made: its two parts and the rank of their merge (-1 for bytes), and which tokens encode to themselves.

        ``odd`` tokens do not come from one merge of earlier ones; what they meet is settled by real merging.
        """
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(self.ranks.values(), np.int64, len(self.ranks))[order], _NEVER)
        self.left, self.right = np.zeros((2, self.size), dtype=np.int64)
        self.rank = np.full(self.size, -1, dtype=np.int64)
        self.odd = np.array([len(b) != 1 for b in self.bytes])
        self.byte = np.array([self.ids.get(bytes([b]), 0) for b in range(256)], dtype=np.int64)
        rank, odd = self.rank.tolist(), self.odd.tolist()
        for pair, k in self.ranks.items():
            (a, b), t = divmod(pair, self.size), self.made[k]
            odd[t] = rank[t] >= 0 or odd[a] or odd[b] or rank[a] >= k or rank[b] >= k
            self.left[t], self.right[t], rank[t] = a, b, k
        self.rank, self.odd = np.array(rank, dtype=np.int64), np.array(odd)
        made = np.flatnonzero(~self.odd & (self.rank >= 0))
        self.alone = ~self.odd
        self.alone[made] = self._fit(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])].tolist():
            self.alone[t] &= self.alone[self.left[t]] and self.alone[self.right[t]]
        for t in np.flatnonzero(self.odd).tolist():
            self.alone[t] = bool(self.bytes[t]) and self.merged(self.bytes[t]) == [t]

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NEVER)

    def _fit(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether neighbours ``a`` and ``b``, made by merges in the order of their ranks, come to stand next to each other.

        Walking back in time, the part made last is undone. The pair that then faces the border had until that merge (among equals the
        left one is first) to merge across it. ``limit`` is the time at which they must stand there, the end if it is not given.
        """
        a, b, fits = a.copy(), b.copy(), np.ones(len(a), dtype=bool)
        limit = np.full(len(a), _NEVER) if limit is None else limit.copy()
        live = np.arange(len(a))
        while len(live):
            bad = self._rank_of(a[live], b[live]) < limit[live]
            fits[live[bad]] = False
            live = live[~bad]
            ra, rb = self.rank[a[live]], self.rank[b[live]]
            more = (ra >= 0) | (rb >= 0)
            live, ra, rb = live[more], ra[more], rb[more]
            later = ra > rb
            x, y = live[later], live[~later]
            limit[x], a[x] = ra[later], self.right[a[x]]
            limit[y], b[y] = rb[~later] + 1, self.left[b[y]]
        return fits

    def _forget_words(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.int32)
        self.ends = np.zeros(1 << 12, dtype=np.int64)

    # --- one word ---

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, the left one among equals."""
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        return self._merged_short(parts) if len(parts) <= SHORT else self._merged_long(parts)

    def _merged_short(self, parts: list[int]) -> list[int]:
        size, none, rank = self.size, len(self.made), self.ranks.get
        ranks = [rank(a * size + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [self.made[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] * size + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] * size + parts[i], none)
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same with a queue: the cost grows as n log n."""
        size, rank = self.size, self.ranks.get
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        queue = [(r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] * size + parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            best, i = heapq.heappop(queue)
            j = after[i]
            if parts[i] < 0 or j < 0 or rank(parts[i] * size + parts[j]) != best:
                continue
            parts[i], parts[j] = self.made[best], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := rank(parts[i] * size + parts[after[i]])) is not None:
                    heapq.heappush(queue, (r, i))
            if before[i] >= 0 and (r := rank(parts[before[i]] * size + parts[i])) is not None:
                heapq.heappush(queue, (r, before[i]))
        return [p for p in parts if p >= 0]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match; each single byte is a token."""
        found, at, size, ids = [], 0, len(word), self.ids
        while at < size:
            stop = min(size, at + self.longest)
            while (token := ids.get(word[at:stop])) is None:
                stop -= 1
            found.append(token)
            at = stop
        return found

    # --- many words ---

    def _pairs_fit(self, pairs: np.ndarray) -> np.ndarray:
        """For each neighbour pair (first * size + second), whether the two encode to themselves."""
        wanted, which = np.unique(pairs, return_inverse=True)
        a, b = wanted // self.size, wanted % self.size
        fits = self.alone[a] & self.alone[b]
        tested = np.flatnonzero(fits)
        fits[tested] = self._fit(a[tested], b[tested])
        for n in np.flatnonzero(self.odd[a] | self.odd[b]).tolist():
            fits[n] = self.merged(self.bytes[a[n]] + self.bytes[b[n]]) == [a[n], b[n]]
        return fits[which]

    def _merged_many(self, words: list[bytes]) -> list[list[int]]:
        """``merged`` of many short words at once: every round makes the next merge of each word."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        line = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)

        def ranked(at: np.ndarray) -> np.ndarray:
            """Rank of the pair that begins at each place; none at the end of a word."""
            after = np.minimum(at + 1, len(line) - 1)
            return np.where((after > at) & (owner[after] == owner[at]), self._rank_of(line[at], line[after]), _NEVER)

        made = np.array(self.made, dtype=np.int64)
        ranks, parts = ranked(np.arange(len(line))), []
        while len(line):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(ranks, starts)
            each = np.repeat(best, np.diff(np.append(starts, len(line))))
            over = each == _NEVER
            if over.any():
                parts.append((owner[over], line[over]))
                line, owner, ranks, each = line[~over], owner[~over], ranks[~over], each[~over]
                if not len(line):
                    break
            least = np.flatnonzero(ranks == each)
            at = least[np.concatenate(([True], owner[least[1:]] != owner[least[:-1]]))]
            line[at] = made[ranks[at]]
            stay = np.ones(len(line), dtype=bool)
            stay[at + 1] = False
            line, owner, ranks = line[stay], owner[stay], ranks[stay]
            # as many places have gone before each of these as there are words before it
            at = at - np.arange(len(at))
            touched = np.concatenate([at, at[at > 0] - 1])
            ranks[touched] = ranked(touched)
        owners, tokens = np.concatenate([o for o, _ in parts]), np.concatenate([t for _, t in parts])
        order = np.argsort(owners, kind="stable")
        ends = np.cumsum(np.bincount(owners, minlength=len(words))).tolist()
        tokens = tokens[order].tolist()
        return [tokens[x:y] for x, y in zip([0, *ends], ends)]

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of each word: proposals where they hold, exact merging elsewhere."""
        if len(words) < MANY:
            return [self.merged(w) for w in words]
        found = [self.proposed(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for f in found for t in f), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        wrong = np.zeros(len(found), dtype=bool)
        wrong[owner[~self.alone[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inner):
            wrong[owner[inner[~self._pairs_fit(flat[inner] * self.size + flat[inner + 1])]]] = True
        short = [n for n in np.flatnonzero(wrong).tolist() if len(words[n]) <= SHORT]
        for n, tokens in zip(short, self._merged_many([words[n] for n in short])):
            found[n] = tokens
        for n in np.flatnonzero(wrong).tolist():
            if len(words[n]) > SHORT:
                found[n] = self.merged(words[n])
        return found

    def pretokens(self, text: str) -> list[str]:
        """Pieces of the text, special tokens as pieces of their own."""
        if self._split is None or not any(t in text for t in self.special):
            return _PRETOKENS.findall(text)
        made, at = [], 0
        for m in self._split.finditer(text):
            made += _PRETOKENS.findall(text[at : m.start()])
            made.append(m.group())
            at = m.end()
        return made + _PRETOKENS.findall(text[at:])

    def _learn(self, new: Iterable[str]) -> None:
        new = list(new)
        tokens = self.words([w.encode() for w in new])
        for n, w in enumerate(new):
            if w in self.special:
                tokens[n] = [self.special[w]]
        flat = np.fromiter((t for f in tokens for t in f), np.int32)
        count = len(self.place)
        base = int(self.ends[count])
        if base + len(flat) > len(self.flat):
            grown = np.empty(2 * (base + len(flat)), dtype=np.int32)
            grown[:base] = self.flat[:base]
            self.flat = grown
        if count + len(new) >= len(self.ends):
            grown = np.zeros(2 * (count + len(new)) + 1, dtype=np.int64)
            grown[: count + 1] = self.ends[: count + 1]
            self.ends = grown
        self.flat[base : base + len(flat)] = flat
        self.ends[count + 1 : count + 1 + len(new)] = base + np.cumsum([len(f) for f in tokens])
        for w in new:
            self.place[w] = len(self.place)

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        cut = [self.pretokens(t) if t else [] for t in texts]
        if len(self.place) > REMEMBERED:
            self._forget_words()
        place = self.place
        new = dict.fromkeys(w for words in cut for w in words if w not in place)
        if new:
            self._learn(new)
        made = []
        for words in cut:
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            starts, ends = self.ends[at], self.ends[at + 1]
            sizes = ends - starts
            shift = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) if len(at) else np.empty(0, np.int64)
            made.append(self.flat[np.arange(len(shift)) + shift])
        return made

    def remember(self, words: Iterable[str]) -> None:
        """Encodes the pre-tokens that are not known yet, all at once. Callers that count texts one by one remember many texts' words first."""
        if len(self.place) > 2 * REMEMBERED:
            self._forget_words()
        if new := dict.fromkeys(w for w in words if w not in self.place):
            self._learn(new)

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        self.remember(words)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return (self.ends[at + 1] - self.ends[at]).tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


_LOADED: dict[str, BytePairs] = {}


class Vocabulary:
    """A broadcast vocabulary file; a worker parses it once."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            text = file.read()
        self.key = hashlib.sha256(text.encode()).hexdigest()
        self.text = spark.sparkContext.broadcast(text)

    def load(self) -> BytePairs:
        if self.key not in _LOADED:
            _LOADED.clear()
            _LOADED[self.key] = BytePairs(self.text.value)
        return _LOADED[self.key]


def encoded(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, name: str = "token_ids") -> DataFrame:
    """``keep`` columns (all by default) and the token ids of each text.

    A null or empty text has no ids; strings of special tokens in a text become those tokens. Rows are
    treated one by one, whole whatever their length. Here and below a new name gets underscores in front where a kept column has it.
    """
    vocabulary = Vocabulary(docs.sparkSession, path)
    keep = docs.columns if keep is None else keep
    (name,) = fresh(docs.select(*map(col, keep)), name)

    def start():
        pairs = vocabulary.load()
        return lambda texts: (pairs.encode(texts),)

    return map_texts(docs, text, keep, [StructField(name, ArrayType(IntegerType()))], start)


def decoded(docs: DataFrame, path: str, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """All columns and the text of each row's ids; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    vocabulary = Vocabulary(docs.sparkSession, path)
    columns = docs.columns
    (name,) = fresh(docs, name)

    def run(batches):
        pairs = vocabulary.load()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [pairs.decode(i or []) for i in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(texts, pa.string())], names=[*columns, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType())]))


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``encoded`` and ``decoded`` in one pass: ``keep`` columns, ``token_ids``, ``decoded``."""
    vocabulary = Vocabulary(docs.sparkSession, path)
    keep = docs.columns if keep is None else keep
    names = fresh(docs.select(*map(col, keep)), "token_ids", "decoded")
    fields = [StructField(names[0], ArrayType(IntegerType())), StructField(names[1], StringType())]
    return map_texts(docs, text, keep, fields, lambda: partial(_both_ways, vocabulary.load()))


def _both_ways(pairs: BytePairs, texts: list) -> tuple[list[np.ndarray], list[str]]:
    ids = pairs.encode(texts)
    return ids, [pairs.decode(i.tolist()) for i in ids]


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids (little-endian, 32 bits each) and of the decoded text.

    What ``round_trip`` yields is digested in the same worker, so ids and texts need not travel.
    """
    vocabulary = Vocabulary(docs.sparkSession, path)

    def start():
        pairs = vocabulary.load()

        def work(texts):
            ids, decoded = _both_ways(pairs, texts)
            digests = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]
            return list(map(len, ids)), digests, [hashlib.sha256(t.encode()).hexdigest() for t in decoded]

        return work

    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return map_texts(docs, "text", ["doc_id"], fields, start)

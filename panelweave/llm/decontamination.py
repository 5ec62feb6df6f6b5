"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are the runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case. The
automaton holds every substring of words of every item; a document streams through it and knows
after each word the longest match that ends there. A match of ``window`` words or more, or of a whole
item shorter than that, marks its words as hit. With a coverage limit, shorter matches count as well, of ``LEAST`` words or more: where
those of one document cover that share of an item's words, they are hit too, so an item with a word changed here and there is found.

Items are cut into shards of at most ``shard_words`` words (an item is never cut), and each shard's
automaton is a broadcast of that bounded size; documents pass through one shard after the other,
each time in a narrow stage without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from panelweave.llm.common import col, fresh, pieces, small_batches, staged, with_length

WINDOW = 10
#: Words of test items in one automaton: some 300 MB in a worker, 20 MB broadcast; a third more with a coverage limit.
SHARD_WORDS = 500_000
#: Words of a match that counts towards the coverage of an item, and the share of an item from which it is covered.
LEAST, COVERAGE = 4, 0.8

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the items that own each window, and with ``coverage`` where each short match stands in them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, coverage: float | None = None, least: int = LEAST):
        self.window, self.coverage, self.least = window, coverage, least
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, self.words.setdefault(word, len(self.words)))
        self.owners: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for name, words in items:
            state = 0
            for at, word in enumerate(words):
                state = self.next[state][self.words[word]]
                if at + 1 >= window:
                    self.owners.setdefault(self._holder(state, window), set()).add(name)
            if 0 < len(words) < window:
                whole.setdefault(self._holder(state, len(words)), []).append((len(words), name))
        self.places: dict[int, list[tuple[int, int]]] = {}
        self.items = [(name, len(words)) for name, words in items]
        if coverage is not None:
            for n, (_, words) in enumerate(items):
                state = 0
                for at, word in enumerate(words):
                    state = self.next[state][self.words[word]]
                    if at + 1 >= least:
                        self.places.setdefault(self._holder(state, least), []).append((n, at + 1 - least))
        self.shortest = min([window, *(k for found in whole.values() for k, _ in found), *([least] if coverage is not None else [])])
        self.short = self._inherited(whole)

    def _new(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for the string of p followed by c, cut off from a longer one if need be."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        made = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, c)
        return made

    def _holder(self, state: int, size: int) -> int:
        """The state that holds the last ``size`` words of ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _inherited(self, whole: dict[int, list[tuple[int, str]]]) -> list[tuple[tuple[int, str], ...]]:
        """Per state, the whole short items that end its strings."""
        found: list[tuple[tuple[int, str], ...]] = [()] * len(self.link)
        if whole:
            for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                found[state] = found[self.link[state]] + tuple(whole.get(state, ()))
        return found

    def matches(self, words: list[bytes], items: set[str]) -> list[tuple[int, int]]:
        """Merged word spans [start, end) that are hit; adds the items found to ``items``."""
        known = list(map(self.words.get, words))
        if len(known) < self.shortest or self.shortest > _longest_run(known):
            return []
        spans: list[list[int]] = []
        partly: dict[int, tuple[set[int], list[tuple[int, int]]]] = {}
        state = size = 0
        for at, c in enumerate(known):
            if c is None:
                state = size = 0
                continue
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c not in self.next[state]:
                continue
            state = self.next[state][c]
            size += 1
            reach = 0
            if size >= self.least and self.places:
                for n, place in self.places.get(self._holder(state, self.least), ()):
                    seen, here = partly.setdefault(n, (set(), []))
                    seen.update(range(place, place + self.least))
                    here.append((at + 1 - self.least, at + 1))
            if size >= self.window:
                reach = self.window
                items |= self.owners[self._holder(state, self.window)]
            for k, name in self.short[state]:
                if k <= size:
                    reach = max(reach, k)
                    items.add(name)
            if reach:
                start = at + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, at + 1])
        covered = []
        for n, (seen, here) in partly.items():
            name, words = self.items[n]
            if len(seen) >= self.coverage * words:
                items.add(name)
                covered += here
        return merged([*((a, b) for a, b in spans), *covered]) if covered else [(a, b) for a, b in spans]


def _longest_run(known: list) -> int:
    gaps = np.flatnonzero(np.fromiter((c is None for c in known), bool, len(known)))
    return int(np.diff(np.concatenate(([-1], gaps, [len(known)]))).max()) - 1


def automata(
    benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, coverage: float | None = None
):
    """One automaton per shard of the items; each shard is fetched by itself, so the driver holds a bounded number of words."""
    rows = benchmark.select(F.coalesce(col(item).cast("string"), F.lit("null")).alias("item"), col(text).alias("text"))
    shard: list[tuple[str, list[bytes]]] = []
    held = 0
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        if shard and held + len(words) > shard_words:
            yield Automaton(shard, window, coverage)
            shard, held = [], 0
        if words:
            shard.append((row["item"], words))
            held += len(words)
    if shard:
        yield Automaton(shard, window, coverage)


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    names: tuple[str, str, str] = ("n_words", "spans", "items"),
    coverage: float | None = None,
) -> DataFrame:
    """Per row of ``docs``: ``keep`` columns (all by default), number of words, hit word spans [start, end), items found (as text, sorted).

    Null and empty texts have no words and no hits. An item without words has no window; items that
    repeat an id count once; a null id is shown as ``null``. An empty benchmark hits nothing. Rows of
    ``docs`` are treated one by one, so repeated rows get equal results. ``coverage`` is the share of an item's words from which short
    matches count (none by default). Columns of ``docs`` keep their names: new ones get underscores in front where they clash.
    """
    kept = docs.columns if keep is None else keep
    names = tuple(fresh(docs.select(*map(col, kept)), *names))
    frame = docs.select(*(col(c) for c in dict.fromkeys([text, *kept])))
    found = None
    for automaton in automata(benchmark, window=window, shard_words=shard_words, coverage=coverage):
        # a further shard starts from a staged table, so that a worker holds one automaton at a time
        found = _pass(frame if found is None else staged(found), automaton, text, names, found is not None)
    if found is None:
        found = _pass(frame, Automaton([], window), text, names, False)
    return found.select(*(col(c) for c in (*kept, *names)))


def _pass(df: DataFrame, automaton: Automaton, text: str, names: tuple[str, str, str], again: bool) -> DataFrame:
    small_batches(df.sparkSession)
    part = df.sparkSession.sparkContext.broadcast(automaton)
    fields = [StructField(names[0], LongType()), StructField(names[1], SPANS), StructField(names[2], ArrayType(StringType()))]
    plain = [c for c in df.columns if c not in names]

    def run(batches):
        held = part.value
        for batch in batches:
            for piece in pieces(batch, text):
                texts = piece.column(text).to_pylist()
                before = [piece.column(c).to_pylist() for c in names[1:]] if again else [[[]] * len(texts)] * 2
                counts, spans, items = [], [], []
                for words, old, owners in zip(map(words_of, texts), *before):
                    owners = set(owners)
                    hit = merged([*((s["start"], s["end"]) for s in old), *held.matches(words, owners)])
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in hit])
                    items.append(sorted(owners))
                made = [pa.array(v, to_arrow_type(f.dataType)) for v, f in zip((counts, spans, items), fields)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in plain), *made], names=[*plain, *names])

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in plain), *fields]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if found and found[-1][1] >= a:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the bytes from the first to the last word of each span of words."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, coverage: float | None = COVERAGE) -> DataFrame:
    """``docs`` with every hit span cut out of the text, by length and by coverage, same columns; clean rows stay as they are.

    A document left without text stays, with what surrounds its words. ``n_chars`` follows the text.
    """
    n, spans, items = fresh(docs, "n_words", "spans", "items")
    marked = contamination(docs, benchmark, text, window=window, names=(n, spans, items), coverage=coverage)
    columns = docs.columns

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text):
                cut = [
                    without_words(t, [(s["start"], s["end"]) for s in found]) if found else t
                    for t, found in zip(part.column(text).to_pylist(), part.column(spans).to_pylist())
                ]
                yield part.select(columns).set_column(columns.index(text), text, pa.array(cut, part.column(text).type))

    return with_length(marked.mapInArrow(run, docs.schema), text).select(*(col(c) for c in columns))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, by the length limit alone. Odd rows are treated as
    ``contamination`` says."""
    found = contamination(docs, benchmark, keep=["doc_id"])
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("bigint")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )

"""Periodic runs of words, by recompression.

A batch of texts becomes one sequence of word numbers with a separator of its own before, between and behind
the texts. Block compression (a maximal repetition of one symbol becomes a symbol) and pair compression
(symbols are dealt into left and right ones; every left-right pair becomes a symbol) alternate until one symbol
is left: a run-length grammar of logarithmic height. Equal stretches are parsed alike but for a symbol or so at
their ends, so the common extension of two positions climbs the levels while the symbols agree and comes down
again to the first that differ, for all candidates at once.

A run of period q and four periods or more has 3 q consecutive positions whose word recurs q words later, so one of
them is a multiple of 3 q: the candidates are that harmonic grid, n log n positions in all, and two extensions
of a candidate, to the right and to the left, give its run exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from panelweave.llm.common import col, map_texts

SHORTEST = 6
PERIODS = 4
#: Candidates looked at together.
LOT = 1 << 19


@dataclass
class _Level:
    """A sequence of symbols and how it is parsed into the next one.

    ``up`` has, per boundary between symbols, its number in the next level, or -1 inside a phrase; ``down`` is the way back;
    ``phrase`` (of blocks only) has the phrase of each symbol.
    """

    symbols: np.ndarray
    up: np.ndarray
    down: np.ndarray
    phrase: np.ndarray | None

    def steps(self, at: np.ndarray, back: bool) -> np.ndarray:
        """Symbols from the boundary ``at`` to the end of its phrase, in the direction looked at."""
        return at - self.down[self.phrase[at - 1]] if back else self.down[self.phrase[at] + 1] - at


class Grammar:
    """Run-length grammar of a sequence of non-negative numbers; answers common extensions."""

    def __init__(self, sequence: np.ndarray):
        symbols = np.asarray(sequence, dtype=np.int64)
        self.levels: list[_Level] = []
        fresh = int(symbols.max(initial=-1)) + 1
        turn = 0
        while len(symbols) > 1:
            starts = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
            if len(starts) < len(symbols):
                counts = np.diff(np.append(starts, len(symbols)))
                symbols, fresh = self._parsed(symbols, starts, counts > 1, counts, fresh, True)
            if len(symbols) > 1:
                starts, turn = self._pairs(symbols, turn)
                sizes = np.diff(np.append(starts, len(symbols)))
                second = symbols[np.minimum(starts + 1, len(symbols) - 1)]
                symbols, fresh = self._parsed(symbols, starts, sizes > 1, second, fresh, False)
        self.top = np.append(symbols, -1)

    def _parsed(self, symbols, starts, joined, other, fresh: int, blocks: bool) -> tuple[np.ndarray, int]:
        """The next sequence: phrases of one symbol keep it, (symbol, other) phrases get a symbol per distinct pair."""
        size, short = len(symbols), len(starts)
        down = np.append(starts, size)
        up = np.full(size + 1, -1, dtype=np.int64)
        up[down] = np.arange(short + 1)
        phrase = np.repeat(np.arange(short), np.diff(down)) if blocks else None
        self.levels.append(_Level(np.append(symbols, -1), up, down, phrase))
        made = symbols[starts]
        names, which = np.unique((made[joined] << 32) | other[joined], return_inverse=True)
        made[joined] = fresh + which
        return made, fresh + len(names)

    @staticmethod
    def _pairs(symbols: np.ndarray, turn: int) -> tuple[np.ndarray, int]:
        """Starts of the phrases when left-right pairs are joined; sides by a hash of symbol and turn."""
        while True:
            turn += 1
            with np.errstate(over="ignore"):
                mixed = (symbols.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            right = (mixed >> np.uint64(63)).astype(bool)
            ways = [~right[:-1] & right[1:], right[:-1] & ~right[1:]]
            seconds = max(ways, key=np.count_nonzero)
            if seconds.any():
                return np.flatnonzero(np.concatenate(([True], ~seconds))), turn

    def common(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols from the boundaries ``i`` and ``j`` (i < j) on, or before them, are equal one by one.

        The sequence must begin and end with symbols that occur once.
        """
        a, b = i.astype(np.int64), j.astype(np.int64)
        shift, sign = (1, -1) if back else (0, 1)
        last = np.full(len(a), len(self.levels))
        live = np.arange(len(a))
        for n, level in enumerate(self.levels):
            if not len(live):
                break
            u, v = a[live], b[live]
            same = level.symbols[u - shift] == level.symbols[v - shift]
            inside = same & ((level.up[u] < 0) | (level.up[v] < 0))
            k = np.flatnonzero(inside)
            if len(k):
                move = 1 if level.phrase is None else np.minimum(level.steps(u[k], back), level.steps(v[k], back))
                u[k] += sign * move
                v[k] += sign * move
                same[k] = (level.up[u[k]] >= 0) & (level.up[v[k]] >= 0)
            last[live[~same]] = n
            up = same.nonzero()[0]
            a[live], b[live] = u, v
            live = live[up]
            a[live], b[live] = level.up[u[up]], level.up[v[up]]
        for n in range(len(self.levels) - 1, -1, -1):
            k = np.flatnonzero(last > n)
            if not len(k):
                continue
            level = self.levels[n]
            u, v = level.down[a[k]], level.down[b[k]]
            same = np.flatnonzero(level.symbols[u - shift] == level.symbols[v - shift])
            move = 1 if level.phrase is None else np.minimum(level.steps(u[same], back), level.steps(v[same], back))
            u[same] += sign * move
            v[same] += sign * move
            a[k], b[k] = u, v
        return np.abs(a - i)


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position, period) of all candidates, in lots."""
    most = np.where(sizes >= SHORTEST, np.maximum(sizes // PERIODS, 1), 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    counts = (sizes[text] - 1 - period) // ((PERIODS - 1) * period) + 1
    ends = np.cumsum(counts)
    start = 0
    while start < len(text):
        base = ends[start] - counts[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + LOT, side="right")))
        n = counts[start:stop]
        owner = np.repeat(np.arange(start, stop), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        yield text[owner], place * (PERIODS - 1) * period[owner], period[owner]
        start = stop


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Per sequence of word numbers the (start, length, period) rows of its runs, by start, then period.

    A run has ``SHORTEST`` words and ``PERIODS`` periods or more, its period is the smallest, and no neighbouring word extends it.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    empty = np.empty((0, 3), dtype=np.int64)
    if not (sizes >= SHORTEST).any():
        return [empty] * len(texts)
    fresh = max(int(t.max(initial=0)) for t in texts) + 1
    offsets = np.cumsum(sizes + 1) - sizes
    line = np.empty(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    line[offsets - 1] = fresh + np.arange(len(texts))
    line[-1] = fresh + len(texts)
    for t, at in zip(texts, offsets.tolist()):
        line[at : at + len(t)] = t
    grammar = None
    found = []
    for text, place, period in _grid(sizes):
        i = offsets[text] + place
        some = np.flatnonzero(line[i] == line[i + period])
        if not len(some):
            continue
        grammar = grammar or Grammar(line)
        i, period, text = i[some], period[some], text[some]
        right, left = grammar.common(i, i + period), grammar.common(i, i + period, back=True)
        length = left + right + period
        good = length >= np.maximum(SHORTEST, PERIODS * period)
        found.append(np.unique(np.stack([text, i - left - offsets[text], length, period], axis=1)[good], axis=0))
    rows = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 4), dtype=np.int64)
    # multiples of a period span the same words: the first row of each (text, start, length) has the smallest
    rows = rows[np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))[: len(rows)]]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    bounds = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[a:b, 1:] for a, b in zip(bounds[:-1], bounds[1:])]


def _numbered(texts: list) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Words of each text and their numbers."""
    words = [t.encode().split() if t else [] for t in texts]
    numbers = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum([len(w) for w in words])
    return words, np.split(numbers.astype(np.int64), ends[:-1]) if texts else []


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    gone = np.zeros(len(words), dtype=bool)
    for start, length, period in runs.tolist():
        gone[start + period : start + length] = True
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else b" ".join(words)


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """``keep`` columns (all by default), the runs of each text, and its words without what repeats a run's first period.

    Words are maximal stretches without space, tab, line feed, vertical tab, form feed and carriage return; the kept ones are joined by one
    space. A null, empty or blank text has no run and an empty collapsed text; equal rows give equal rows; a column of the table that
    has one of ``names`` is an error. Texts are treated one by one and whole: a task holds about a megabyte of texts, or one longer text.
    """
    keep = docs.columns if keep is None else keep
    if clash := {n.lower() for n in names} & {c.lower() for c in keep}:
        raise ValueError(f"columns exist: {sorted(clash)}")
    run = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])

    def start():
        def work(texts):
            words, numbers = _numbered(texts)
            runs = runs_of(numbers)
            rows = [[dict(zip(("start", "length", "period"), r)) for r in found.tolist()] for found in runs]
            return rows, [_collapsed(w, r).decode() for w, r in zip(words, runs)]

        return work

    return map_texts(docs, text, keep, [StructField(names[0], ArrayType(run)), StructField(names[1], StringType())], start)


def planted(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows, with a repetition made of the words of every text whose key's checksum h is divisible by ten.

    With g = h // 10 and n words, word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). Texts without words and
    rows without key stay as they are.
    """
    checksum = F.crc32(col(key).cast("string"))
    words = F.regexp_extract_all(col(text), F.lit("[^ \\t-\\r]+"), 0)

    def repeated(ws: Column) -> Column:
        g, n = F.floor(checksum / 10), F.size(ws)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(at, " "))

    # the words are bound once, as the element of an array
    made = F.get(F.transform(F.array(words), repeated), 0)
    return docs.withColumn(text, F.when(checksum % 10 == 0, F.coalesce(made, col(text))).otherwise(col(text)))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of most periods (first start, then smallest period among equals; nulls without a run), and digests of all
    runs and of the collapsed text. Odd rows are treated as ``periodic_runs`` says; the digests are made in the same worker."""

    def start():
        def work(texts):
            words, numbers = _numbered(texts)
            made: list[list] = [[] for _ in range(7)]
            for ws, runs in zip(words, runs_of(numbers)):
                rows = runs.tolist()
                best = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                values = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
                digests = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(_collapsed(ws, runs)).hexdigest()
                for column, value in zip(made, (len(rows), *values, *digests)):
                    column.append(value)
            return made

        return work

    numbers = ("n_runs", "start", "length", "period", "exponent_milli")
    fields = [*(StructField(n, LongType()) for n in numbers), *(StructField(n, StringType()) for n in ("runs_sha256", "collapsed_sha256"))]
    return map_texts(docs, "text", ["doc_id"], fields, start)

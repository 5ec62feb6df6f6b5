import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panelweave.llm import periods
from tests.llm.helpers import corpus, docs, with_clashes


def brute(words):
    """Runs as (start, length, period), by comparing all words at every distance."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    digests = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


def repetitive(seed, count=60):
    rng = random.Random(seed)
    made = []
    for n in range(count):
        words = [f"w{rng.randrange(rng.choice([1, 2, 3, 40]))}" for _ in range(rng.choice([0, 1, 5, 6, 7, 40, 160]))]
        if n % 2 and words:
            part, at = words[: rng.randint(1, 12)], rng.randrange(len(words))
            words[at:at] = part * rng.randint(3, 9) + part[: rng.randrange(len(part) + 1)]
        made.append((n, rng.choice([" ", "\n", " \t"]).join(words)))
    return made


def test_report_is_the_brute_force(spark):
    rows = [*repetitive(1), *((1000 + i if i is not None else None, t) for i, t in corpus(4))]
    rows += [(5000, "é é é é é é é é é é é é"), (5001, "a\x1cb " * 7), (5002, "a\x0bb\x0ca b a b a b")]
    found = periods.report(periods.planted(with_clashes(docs(spark, rows))))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert found.where("n_runs > 0").count() > 30


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=6))
def test_runs_of_any_sequences(texts):
    found = periods.runs_of([np.array(t, dtype=np.int64) for t in texts])
    assert [sorted(map(tuple, f.tolist())) for f in found] == [brute(t) for t in texts]


def test_grammar_extensions_are_exact():
    rng = random.Random(9)
    body = [rng.randrange(2) for _ in range(40)] * 4 + [1] * 70 + [rng.randrange(3) for _ in range(200)]
    line = [7, *body, 8]
    grammar = periods.Grammar(np.array(line))
    assert len(grammar.top) == 2
    pairs = [(i, j) for i in range(1, len(line), 3) for j in range(i + 1, len(line), 5)]
    i, j = (np.array(x) for x in zip(*pairs))
    right, left = grammar.common(i, j), grammar.common(i, j, back=True)
    for n, (a, b) in enumerate(pairs):
        k = next(k for k in range(len(line)) if b + k == len(line) or line[a + k] != line[b + k])
        assert right[n] == k
        k = next(k for k in range(len(line)) if a == k or line[a - 1 - k] != line[b - 1 - k])
        assert left[n] == k


def test_long_repetition_and_height():
    n = 60_000
    assert periods.runs_of([np.zeros(n, dtype=np.int64)])[0].tolist() == [[0, n, 1]]
    half = np.random.default_rng(2).integers(0, 50, 7_000)
    assert [0, 28_000, 7_000] in periods.runs_of([np.tile(half, 4)])[0].tolist()
    assert len(periods.Grammar(np.random.default_rng(3).integers(0, 4, 1 << 15)).levels) < 120


def test_texts_and_columns(spark):
    df = docs(spark, [(1, "x a b a b a b a b y"), (2, None), (3, ""), (3, "")])
    found = periods.periodic_runs(df)
    assert found.columns == [*df.columns, "runs", "collapsed"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert [tuple(x) for x in rows[1]["runs"]] == [(1, 8, 2)] and rows[1]["collapsed"] == "x a b y"
    assert rows[2]["runs"] == [] and rows[3]["collapsed"] == ""
    with pytest.raises(ValueError):
        periods.periodic_runs(df.withColumn("Runs", F.lit(1)))
    assert periods.report(df.limit(0)).count() == 0

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from panelweave.llm import substrings
from tests.llm.helpers import corpus, docs


def expected(rows, window=50):
    cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), ws in zip(rows, cut):
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i : i + window])
            if doc is not None:
                first[w] = min(first.get(w, doc), doc)
    made = []
    for (doc, _), ws in zip(rows, cut):
        gone = set()
        for i in range(len(ws) - window + 1):
            if doc is not None and first[tuple(ws[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        made.append((doc, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(made, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    rows = corpus()
    assert any(n for _, _, n, _ in expected(rows))
    assert result(substrings.report(docs(spark, rows).withColumn("key", F.lit("x")))) == expected(rows)


def test_other_windows_and_several_texts_of_a_key(spark):
    rows = [(1, "a b c d e f g h"), (2, "x c d e f y"), (2, "c d e f"), (3, "q b c d e z b c d e"), (0, "d e f g"), (3, "q b c d e z b c d e"), (None, "a b c d e")]
    for window in (2, 3, 4):
        assert result(substrings.report(docs(spark, rows), window)) == expected(rows, window)


def test_repeats_are_maximal(spark):
    text = " ".join(f"v{n}" for n in range(200))
    rows = [(1, text), (2, "start " + " ".join(text.split()[20:120]) + " end")]
    found = {r["doc_id"]: r["repeats"] for r in substrings.report(docs(spark, rows)).collect()}
    assert found == {1: None, 2: [[1, 101]]}


def test_a_window_that_its_block_owner_lacks(spark):
    # the first document has the block but not the window, which the second and third share
    block = [f"b{n}" for n in range(25)]
    rest = [f"r{n}" for n in range(25)]
    rows = [(1, " ".join(["z"] * 25 + block + ["y"] * 30)), (2, " ".join(["q"] * 25 + block + rest)), (3, " ".join(["p"] * 7 + block + rest))]
    assert result(substrings.report(docs(spark, rows))) == expected(rows)
    assert [n for _, _, n, _ in expected(rows)] == [0, 0, 50]


def test_rolling_hash_depends_on_all_words_and_order():
    x = np.random.default_rng(0).integers(0, 1 << 63, 200).astype(np.uint64)
    for size in (1, 2, 3, 25, 50, 200, 201):
        r = substrings.rolling(x, size, substrings._BASES[0])
        assert len(r) == max(0, 201 - size)
        if 1 < size <= 50:
            assert substrings.rolling(x[10 : 10 + size], size, substrings._BASES[0])[0] == r[10]
            assert substrings.rolling(x[10 : 10 + size][::-1].copy(), size, substrings._BASES[0])[0] != r[10]


def test_empty_table(spark):
    assert substrings.report(docs(spark, [])).count() == 0
    assert result(substrings.report(docs(spark, [(1, None)]))) == [(1, 0, 0, hashlib.sha256(b"").hexdigest())]

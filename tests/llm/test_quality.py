import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import quality
from tests.llm.helpers import docs, with_clashes

LABELS = "doc_id bigint, quality int, toxic int"


def rows(n=500, seed=3):
    """Clean prose, and junk in four ways."""
    rng = random.Random(seed)
    made, marks = [], []
    for k in range(n):
        words = [rng.choice("the of and to in a is".split()) if rng.random() < 0.4 else "".join(rng.choice(["ba", "de", "ki", "lo"]) for _ in range(3)) for _ in range(rng.choice([8, 30, 120]))]
        bad = k % 3 == 0
        if bad:
            junk = k // 3 % 4
            words = [[f"{w}***" for w in words], [w.upper() + "!!" for w in words], [x for w in words for x in (w, "|")], [x for w in words for x in [w] * 5]][junk]
        made.append((k, " ".join(words)))
        marks.append((k, 0 if bad else 1, 0))
    return made, marks


def test_held_out_accuracy_and_odd_rows(spark):
    given, marks = rows()
    odd = [(9000, None), (9001, ""), (None, given[1][1]), (7, given[7][1]), (9002, "the of " * 40_000), (9003, "*** " * 30_000)]
    labels = spark.createDataFrame([*marks, (9000, 1, 0), (9001, 0, 0), (9999, 1, 0), (None, 1, 0), (1, None, 0), (2, 7, 0), (4, 1, 0)], LABELS)
    df = with_clashes(docs(spark, given + odd)).withColumn("quality", F.lit("x")).withColumn("held_out", F.lit("x"))
    found = quality.report(df, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    found = found.collect()
    assert len(found) == len(given) + len(odd)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    by_id = {r["doc_id"]: r for r in found}
    held = [m for m in marks if zlib.crc32(str(m[0]).encode()) % 4 == 2]
    assert all(by_id[m[0]]["held_out"] for m in held) and not by_id[None]["held_out"]
    assert sum(by_id[m[0]]["predicted"] == m[1] for m in held) >= 0.95 * len(held)
    assert by_id[9003]["predicted"] == 0
    assert by_id[None]["score"] == by_id[1]["score"]


def test_contexts_are_the_plain_sums(spark):
    texts = ["Aa bb AA aa aa, bb!", None, "", "cc", "bb cc " * 20]
    found = {r["bucket"]: r for r in quality.contexts(docs(spark, list(enumerate(texts)))).collect()}
    places, values = quality.index_vectors()
    sums, met = {}, {}
    for stream in quality.Tokens()(texts):
        stream = stream.tolist()
        for i, b in enumerate(stream):
            met[b] = met.get(b, 0) + 1
            own = sums.setdefault(b, np.zeros(quality.DIMENSIONS, dtype=int))
            for j in range(max(0, i - quality.WINDOW), min(len(stream), i + quality.WINDOW + 1)):
                if j != i:
                    np.add.at(own, places[stream[j]], values[stream[j]])
    assert {b: r["met"] for b, r in found.items()} == met
    for b, r in found.items():
        assert [r[f"v{n}"] for n in range(quality.DIMENSIONS)] == sums[b].tolist()


def test_streams_mark_capitals_and_repeats():
    first, = quality.Tokens()(["Go GO go. A"])
    tokens = quality.Tokens()
    go, dot, a = (tokens([t])[0][0] for t in ("go", ".", "a"))
    assert first.tolist() == [go, go, quality._CAPITALS, quality._AGAIN, go, quality._AGAIN, dot, a]
    many = [f"w{n} W{n}" for n in range(3000)]
    together = tokens(many)
    assert all((x == quality.Tokens()([t])[0]).all() for x, t in zip(together, many[:50]))


def test_score_depends_on_the_text_only(spark):
    given, marks = rows(150)
    labels = spark.createDataFrame(marks, LABELS)
    model = quality.train(docs(spark, given), labels)
    a = {r["doc_id"]: r["score"] for r in quality.scored(docs(spark, given), model).collect()}
    b = {900 - r["doc_id"]: r["score"] for r in quality.scored(docs(spark, [(900 - d, t, "xx") for d, t in given]), model).collect()}
    assert a == b
    named = quality.scored(docs(spark, given[:2]).withColumn("score", F.lit("own")), model)
    assert named.columns[-1] == "_score" and named.first()["score"] == "own"


def test_held_out_labels_are_not_read(spark):
    given, marks = rows(200)
    held = {d for d, _ in given if zlib.crc32(str(d).encode()) % 4 == 2}
    flipped = [(d, 1 - q if d in held else q, 1) for d, q, _ in marks]
    df = docs(spark, given)
    a, b = ({r["doc_id"]: r["score"] for r in quality.report(df, spark.createDataFrame(m, LABELS)).collect()} for m in (marks, flipped))
    assert a == b


def test_fit_against_plain_gradient():
    """The network separates what a line cannot, and its temperature does not worsen the kept-back loss."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    net = quality.fit(x, y, np.ones(800))
    assert ((net.scores(x) >= 0.5) == y).mean() > 0.93
    kept = np.arange(800) % 5 == 4
    z = net.logits(x[kept])
    assert quality._loss(z / net.temperature, y[kept], np.ones(kept.sum())) <= quality._loss(z, y[kept], np.ones(kept.sum())) + 1e-9


@pytest.mark.parametrize("marks", [[], [(1, 1, 0)]])
def test_little_to_learn_from(spark, marks):
    labels = spark.createDataFrame(marks, LABELS)
    found = quality.report(docs(spark, [(1, "a b c"), (2, None)]), labels).collect()
    assert len(found) == 2 and all(0 <= r["score"] <= 1 for r in found)
    assert quality.report(docs(spark, [(1, "a")]).limit(0), labels).count() == 0

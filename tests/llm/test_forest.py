import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import forest


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def brute(vectors, queries, k):
    found = {}
    for q in queries:
        scored = sorted((-float((np.asarray(vectors[q], dtype=float) * np.asarray(v, dtype=float)).sum()), i) for i, v in vectors.items() if i != q)
        found[q] = [i for _, i in scored[:k]]
    return found


def result(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found.setdefault(r["query_id"], [])) + 1
        found[r["query_id"]].append(r["vec_id"])
    return found


def test_recall_on_clusters_and_noise(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16)), rng.normal(size=(500, 16))]).astype(np.float32)
    vectors = {n: v.tolist() for n, v in enumerate(x)}
    df = table(spark, [(n, v, 0) for n, v in vectors.items()])
    made = forest.nearest(df, F.col("id") % 20 == 0, leaf_rows=32, block_rows=256, sample_rows=1000).withColumnRenamed("id", "vec_id")
    found = result(made)
    want = brute(vectors, [n for n in vectors if n % 20 == 0], 20)
    assert found.keys() == want.keys()
    assert all(len(v) == 20 for v in found.values())
    assert np.mean([len(set(found[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(n, [1.0, 0.0], 0) for n in range(50)] + [(60, [0.5, 0.5], 0), (80, [-1.0, 0.0], 0), (80, [-1.0, 0.0], 0)]
    bad = [(100, None, 0), (120, [0.0, 0.0], 0), (140, [nan, 1.0], 0), (160, [inf, 1.0], 0), (180, [None, 1.0], 0), (200, [1.0], 0), (None, [1.0, 1.0], 0), (220, [], 0)]
    found = result(forest.report(table(spark, rows + bad)))
    assert set(found) == {0, 20, 40, 60, 80}
    assert found[0] == list(range(1, 21))
    assert found[20] == list(range(20))
    assert found[60] == list(range(20))
    assert found[80][0] == 60 and found[80][1:] == list(range(19))


def test_ties_of_different_vectors_go_to_smaller_ids(spark):
    """Sixty different vectors with one product; their ids fall along the table."""
    rng = np.random.default_rng(8)
    rows = [(0, [1.0, 0.0, 0.0], 0)] + [(100 - n, [0.5, *map(float, rng.integers(-9, 9, 2)), ], 0) for n in range(60)]
    found = result(forest.nearest(table(spark, rows), F.col("id") == 0).withColumnRenamed("id", "vec_id"))
    distinct = {}
    for i, v, _ in rows[1:]:
        distinct.setdefault(tuple(v), []).append(i)
    assert len(distinct) > 30
    assert found[0] == list(range(41, 61))


def test_few_and_no_rows(spark):
    found = result(forest.report(table(spark, [(0, [1.0, 2.0], 0), (1, [2.0, 1.0], 0), (20, [1.0, 1.0], 0)])))
    assert found == {0: [1, 20], 20: [0, 1]}
    assert forest.report(table(spark, [])).count() == 0
    assert forest.report(table(spark, [(1, [1.0], 0)])).count() == 0
    assert forest.report(table(spark, [(0, [1.0], 0)])).count() == 0


def test_extra_columns_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(64, 8))
    df = table(spark, [(n, v.tolist(), 0) for n, v in enumerate(x)]).withColumns({c: F.lit("x") for c in ("q", "v", "id", "score", "block", "ids")})
    x = x.astype(np.float32).astype(float)
    for r in forest.report(df).collect():
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-12)


def test_tree_routes_its_sample(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 4)), np.ones((100, 4))])
    grown = forest.grow(x, 16, 64, 3)
    leaves = grown.leaves(x)
    for t in range(3):
        counts = np.bincount(leaves[:, t], minlength=len(grown.block))
        mine = grown.tree == t
        assert (counts[mine] == grown.held[mine]).all()
    order = grown.order(x[:5], -1)
    assert all(sorted(o) == list(range(len(grown.block))) for o in order)

"""Spatial weights and lags against dense arithmetic."""

import re
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from helpers import brute_nearest, brute_within, by_key, day, panel, plan_of, points, same_rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panelweave.operators import far_field, neighbours, pair_ranks, pivots, salting, weights
from panelweave.operators.lag import spatial_lag
from panelweave.operators.quantiles import exact_median

RNG = np.random.default_rng(1)
CLOUDS = {
    "uniform": RNG.random((700, 2)),
    "a third at one place": np.vstack([np.full((250, 2), 0.3), RNG.random((450, 2))]),
    "dense cluster": np.vstack([RNG.normal(0.5, 1e-5, (350, 2)), RNG.random((300, 2))]),
    "lattice": np.array([(a, b) for a in range(26) for b in range(26)], float),
    "space": RNG.random((600, 3)),
    "line": RNG.random((600, 1)),
    "far outliers": np.vstack([RNG.normal(0, 1e-7, (600, 2)), [[1e4, 1e4], [-1e4, 5.0], [3.0, 3.0]]]),
    "few": RNG.random((4, 2)),
}


def edge_set(df):
    rows = df.select("i", "j").collect()
    found = {(r["i"], r["j"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("cloud", CLOUDS)
def test_nearest_is_exact(spark, cloud):
    df, coords = points(spark, CLOUDS[cloud])
    assert edge_set(neighbours.nearest(df, coords, 4)) == brute_nearest(CLOUDS[cloud], 4)


def test_nearest_in_many_dimensions(spark):
    xy = RNG.random((300, 12))
    df, coords = points(spark, xy)
    expected = brute_nearest(xy, 3)
    packed = df.select("region", F.array(*coords).alias("v"))
    assert edge_set(neighbours.nearest(packed, "v", 3)) == expected
    assert edge_set(neighbours.nearest(df, coords, 3)) == expected
    near = brute_within(xy, 1.0)
    assert edge_set(neighbours.pairs_within(packed, "v", 1.0)) == near
    assert edge_set(neighbours.pairs_within(df, coords, 1.0)) == near


def test_more_neighbours_than_regions(spark):
    df, coords = points(spark, CLOUDS["few"])
    assert len(edge_set(weights.knn_weights(df, coords, 9))) == 12
    with pytest.raises(ValueError):
        weights.knn_weights(df, coords, 0)


@pytest.mark.parametrize("cloud,threshold", [("uniform", 0.07), ("a third at one place", 0.05), ("lattice", 1.0), ("space", 0.2), ("line", 0.01), ("lattice", 0.0)])
@pytest.mark.parametrize("cell_points", [40, 100_000])
def test_pairs_within_is_exact(spark, cloud, threshold, cell_points):
    df, coords = points(spark, CLOUDS[cloud])
    got = neighbours.pairs_within(df, coords, threshold, cell_points)
    assert edge_set(got) == brute_within(CLOUDS[cloud], threshold)
    assert "CartesianProduct" not in plan_of(got) and "NestedLoop" not in plan_of(got)


def test_all_pairs_do_not_need_a_cross_join(spark):
    df, coords = points(spark, CLOUDS["uniform"])
    pairs = neighbours.all_pairs(df, coords, tiles=3)
    assert pairs.count() == 700 * 699
    assert "CartesianProduct" not in plan_of(pairs) and "NestedLoop" not in plan_of(pairs)


def test_weight_values(spark):
    xy = np.array([[0.0, 0], [3, 4], [0, 0], [30, 40]])
    df, coords = points(spark, xy)
    inverse = by_key(weights.distance_weights(df, coords), "i", "j")
    assert inverse[(0, 1)]["w"] == pytest.approx(0.2) and (0, 2) not in inverse and len(inverse) == 10
    squared = by_key(weights.distance_weights(df, coords, 10, 2, False), "i", "j")
    assert squared[(1, 2)]["w"] == pytest.approx(25) and (0, 3) not in squared
    binary = edge_set(weights.binary_weights(df, coords, 5.0))
    assert binary == {(0, 1), (1, 0), (1, 2), (2, 1), (0, 2), (2, 0)}
    with pytest.raises(ValueError):
        weights.binary_weights(df, coords, None)


def test_kernels_and_default_bandwidths(spark):
    xy = RNG.random((30, 2))
    df, coords = points(spark, xy)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    pairs = d[np.triu_indices(30, 1)]
    for kernel, h, f in (
        ("gaussian", np.median(pairs), lambda h: np.exp(-(d**2) / (2 * h * h))),
        ("exponential", np.median(pairs), lambda h: np.exp(-d / h)),
        ("linear", pairs.max(), lambda h: np.maximum(0, 1 - d / h)),
    ):
        for bandwidth in (None, 0.4):
            expected = f(h if bandwidth is None else bandwidth)
            np.fill_diagonal(expected, 0)
            got = np.zeros((30, 30))
            for r in weights.kernel_weights(df, coords, kernel, bandwidth).collect():
                got[r["i"], r["j"]] = r["w"]
            np.testing.assert_allclose(got, expected, atol=1e-12)
    with pytest.raises(ValueError):
        weights.kernel_weights(df, coords, "cubic")


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 9 + [1.0], list(RNG.lognormal(0, 4, 501)), list(RNG.normal(size=500))])
def test_exact_median_in_passes(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert exact_median(df, "v", few_rows=4) == pytest.approx(np.median(values), rel=1e-12)
    assert exact_median(df, "v") == pytest.approx(np.median(values), rel=1e-12)


def test_contiguity_rules(spark):
    regions = spark.createDataFrame([("a",), ("b",), ("c",)], "region string")
    edges = weights.contiguity_weights(regions, {"a": ["b", "b", "x"], "x": ["a"], "c": ["c"]})
    assert edge_set(edges) == {("a", "b"), ("c", "c")}
    with pytest.warns(UserWarning):
        assert weights.contiguity_weights(regions, None).count() == 0


def test_factory(spark):
    df, coords = points(spark, RNG.random((40, 2)))
    for method, options in (("binary", {"threshold": 0.3}), ("distance", {}), ("knn", {"k": 3}), ("distance", {"threshold": 0.2, "power": 2})):
        edges = weights.spatial_weights(df, method, coords=coords, **options)
        sums = [r["row_sum"] for r in weights.row_col_sums(edges, df).collect()]
        assert all(abs(s - 1) < 1e-9 or s == 0 for s in sums) and len(sums) == 40
        assert edges.where("i = j OR w < 0").count() == 0
    raw = spark.createDataFrame([(0, 1, 2.0), (0, 2, 6.0), (1, 2, 0.0)], "i bigint, j bigint, w double")
    kept = weights.spatial_weights(df, "custom", weights=raw, normalise=False)
    assert {(r["i"], r["j"]): r["w"] for r in kept.collect()} == {(0, 1): 2.0, (0, 2): 6.0}
    assert weights.spatial_weights(df, "custom", weights=raw).agg(F.max("w")).first()[0] == 0.75
    stranger = spark.createDataFrame([(0, 99, 1.0)], "i bigint, j bigint, w double")
    for arguments in (
        {"method": "custom"}, {"method": "knn", "coords": coords}, {"method": "distance"}, {"method": "nothing"},
        {"method": "custom", "weights": stranger},
    ):
        with pytest.raises(ValueError):
            weights.spatial_weights(df, **arguments)


def test_validation_and_statistics(spark):
    df, _ = points(spark, RNG.random((3, 2)))

    def edges(*rows):
        return spark.createDataFrame(list(rows), "i bigint, j bigint, w double")

    good = edges((0, 1, 0.5), (1, 0, 0.5), (1, 2, 0.5))
    row = weights.validation(good, df).first()
    assert row["valid"] and not row["symmetric"]
    with pytest.warns(UserWarning, match="not symmetric"):
        assert weights.is_valid(good, df)
    for bad, check in ((edges((0, 1, -1.0)), "non_negative"), (edges((0, 0, 1.0)), "zero_diagonal"), (edges((0, 7, 1.0)), "square")):
        assert not weights.validation(bad, df).first()[check]
        with pytest.warns(UserWarning, match=check):
            assert not weights.is_valid(bad, df)
    stats = weights.statistics(good, df).first()
    assert stats["density"] == pytest.approx(3 / 9) and stats["mean_weight"] == 0.5 and stats["max_weight"] == 0.5
    assert stats["n_regions"] == 3 and not stats["is_normalised"] and not stats["is_symmetric"]
    empty = weights.statistics(edges().limit(0), df).first()
    assert empty["density"] == 0 and empty["max_weight"] == 0 and empty["min_weight"] == 0 and empty["is_symmetric"]


@settings(max_examples=4, deadline=None)
@given(st.integers(2, 7), st.integers(1, 6), st.integers(1, 5))
def test_lag_is_the_matrix_product(spark, n, steps, slices):
    rng = np.random.default_rng(n * 100 + steps)
    s = rng.random((n, n)) * (rng.random((n, n)) < 0.5)
    np.fill_diagonal(s, 0)
    y = rng.random((n, steps))
    df = panel(spark, {i: list(y[i]) for i in range(n)})
    edges = spark.createDataFrame(
        [(i, j, float(s[i, j])) for i in range(n) for j in range(n) if s[i, j]] or [(0, 0, 0.0)], "i bigint, j bigint, w double"
    )
    got = by_key(spatial_lag(df, edges, slices=slices), "region", "t")
    for i in range(n):
        for t in range(steps):
            assert got[(i, day(t))]["lag"] == pytest.approx((s @ y)[i, t])


def test_lag_of_hubs_gaps_and_islands(spark):
    df = panel(spark, {0: [1, None], 1: [2, 3], 2: [4, 5], 3: [7, 7]})
    edges = spark.createDataFrame([(1, 0, 1.0), (2, 0, 0.5), (2, 1, 0.5)], "i bigint, j bigint, w double")
    got = by_key(spatial_lag(df, edges), "region", "t")
    assert got[(1, day(0))]["lag"] == 1 and got[(1, day(1))]["lag"] is None
    assert got[(2, day(0))]["lag"] == 1.5 and got[(2, day(1))]["lag"] is None
    assert got[(3, day(0))]["lag"] == 0 and got[(0, day(1))]["lag"] == 0


def test_results_do_not_depend_on_partitions(spark):
    df, coords = points(spark, CLOUDS["lattice"])
    few = weights.spatial_weights(df.coalesce(1), "knn", coords=coords, k=3)
    many = weights.spatial_weights(df.repartition(17), "knn", coords=coords, k=3)
    assert same_rows(few, many)


VECTORS = {
    "uniform": RNG.random((700, 8)),
    "clusters": (RNG.normal(size=(30, 1, 6)) * 100 + RNG.normal(size=(30, 40, 6))).reshape(-1, 6),
    "a third at one place": np.concatenate([np.ones((300, 5)), RNG.random((600, 5))]),
    "one far off": np.concatenate([RNG.random((500, 4)), np.full((1, 4), 1e7)]),
    "on a sphere": (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(RNG.normal(size=(600, 5))),
    "lattice": np.stack(np.meshgrid(*[np.arange(5.0)] * 4), axis=-1).reshape(-1, 4),
}


def vectors(spark, xy):
    df, coords = points(spark, xy)
    return df.select("region", F.array(*coords).alias("v")).repartition(3)


@pytest.mark.parametrize("cloud", VECTORS)
def test_pivot_search_is_exact(spark, cloud):
    xy = VECTORS[cloud]
    df = vectors(spark, xy)
    found = pivots.search(df, "v", 4, cell_rows=60)
    assert edge_set(neighbours._closest(found.withColumn("_d2", F.col("d")), 4)) == brute_nearest(xy, 4)
    within = float(np.median(np.linalg.norm(xy[:40, None] - xy[None, :40], axis=2))) / 3
    assert edge_set(pivots.search(df, "v", threshold=within, cell_rows=60)) == brute_within(xy, within)


def test_pivots_leave_out_most_pairs_between_clusters(spark, monkeypatch):
    xy = VECTORS["clusters"]
    named = vectors(spark, xy).withColumnRenamed("region", "i")
    index = pivots.build(named, len(xy), 60)
    sizes = index.members.groupBy("cell", "ring", "piece").count()
    seen = pivots.visits(index, pivots._bounded(index, 4)).join(sizes, ["cell", "ring", "piece"])
    assert seen.agg(F.sum("count")).first()[0] < 0.12 * len(xy) ** 2
    assert sizes.agg(F.max("count")).first()[0] <= 2 * 60


def test_crowded_groups_are_spread(spark, monkeypatch):
    """One place holds half of all vectors: its group has a bound, and so have the queries that one task meets."""
    monkeypatch.setattr(pivots, "QUERY_ROWS", 50)
    xy = np.concatenate([np.zeros((400, 4)), RNG.random((400, 4)) * 1e-3])
    df = vectors(spark, xy)
    assert edge_set(pivots.search(df, "v", threshold=5e-4, cell_rows=60)) == brute_within(xy, 5e-4)
    index = pivots.build(df.withColumnRenamed("region", "i"), len(xy), 60)
    assert index.members.groupBy("cell", "ring", "piece").count().agg(F.max("count")).first()[0] <= 160


def test_queries_are_sent_once_per_block(spark):
    """Unstructured vectors reach every group: a row per group would be a query's vector for each of them."""
    xy = RNG.normal(size=(900, 24))
    df = vectors(spark, xy / np.linalg.norm(xy, axis=1)[:, None])
    single = df.select("region", F.col("v").cast("array<float>").alias("v"))
    index = pivots.build(single.withColumnRenamed("region", "i"), 900, 30)
    bounded = pivots._bounded(index, 3)
    groups = pivots._grouped(index, 300)
    sent = pivots._block_visits(index, bounded, groups)
    assert groups["block"].nunique() <= 4 and sent.count() <= 2 * 900 * groups["block"].nunique() < pivots.visits(index, bounded).count() / 3
    assert sent.select(F.explode("groups")).count() == pivots.visits(index, bounded).count()
    # single numbers are sent as such, and compared as doubles
    assert sent.schema["v"].dataType.simpleString() == "array<float>"
    found = pivots.search(single, "v", 3, cell_rows=30)
    exact = np.stack([r["v"] for r in single.orderBy("region").collect()])
    assert edge_set(neighbours._closest(found.withColumn("_d2", F.col("d")), 3)) == brute_nearest(exact, 3)


@pytest.mark.parametrize("cloud", ["uniform", "dense cluster", "space", "line", "far outliers", "few", "array", "two copies", "one"])
def test_ranks_of_all_distances(spark, cloud):
    xy = {"array": VECTORS["clusters"][:500], "two copies": np.ones((2, 2)), "one": np.ones((1, 2))}.get(cloud)
    xy = CLOUDS[cloud] if xy is None else xy
    df, coords = points(spark, xy)
    if cloud == "array":
        df, coords = df.select("region", F.array(*coords).alias("v")), "v"
    d = np.sqrt(sum((xy[:, None, x] - xy[None, :, x]) ** 2 for x in range(xy.shape[1])))[np.triu_indices(len(xy), 1)]
    assert pair_ranks.median_distance(df, coords) == (np.median(d) if len(d) else None)
    assert pair_ranks.largest_distance(df, coords) == (d.max() if len(d) else None)


def test_few_distances_are_looked_at(spark, monkeypatch):
    """Between the levels no row per pair is written, and at the last one a fraction of the pairs is left."""
    monkeypatch.setattr(pair_ranks, "LEAF_PLACES", 8)
    xy = RNG.random((3000, 2))
    df, coords = points(spark, xy)
    pairs = len(xy) * (len(xy) - 1) // 2
    places = df.select(F.array(*coords).alias("v"), F.lit(1).cast("bigint").alias("m"))
    met, below, low, high = pair_ranks._straddling(places, 2, len(xy), [pairs // 2])
    left = met.agg(F.sum(F.size("a_v") * F.size("b_v"))).first()[0]
    assert left < 0.25 * pairs and 0 < below < pairs // 2
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)[np.triu_indices(len(xy), 1)]
    assert low <= np.sort(d)[pairs // 2] <= high and high - low < 0.2


def test_kernel_cutoff_with_the_default_bandwidth(spark):
    xy = CLOUDS["uniform"][:120]
    df, coords = points(spark, xy)
    whole = weights.kernel_weights(df, coords, "gaussian")
    h = pair_ranks.median_distance(df, coords)
    near = weights.kernel_weights(df, coords, "gaussian", cutoff=0.2)
    assert edge_set(near) == brute_within(xy, 0.2)
    assert same_rows(near, whole.join(near.select("i", "j"), ["i", "j"])) and h == weights.default_bandwidth(df, coords)


@pytest.mark.parametrize("dims,h,tolerance", [(2, 0.4, 1e-9), (2, 0.15, 1e-6), (1, 0.3, 1e-12), (3, 0.5, 1e-4), (2, None, 1e-8)])
def test_kernel_lag_is_within_its_bound(spark, monkeypatch, dims, h, tolerance):
    """Blocks of a few regions, added up in several rounds."""
    monkeypatch.setattr(far_field, "BLOCK_REGIONS", 16)
    monkeypatch.setattr(far_field, "FAN_IN", 3)
    monkeypatch.setattr(far_field, "GROUP_DATES", 2)
    rng = np.random.default_rng(dims)
    n, steps = 150, 5
    xy, y = rng.random((n, dims)), rng.normal(size=(n, steps))
    places, coords = points(spark, xy)
    df = panel(spark, {i: list(y[i]) for i in range(n)})
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    h_used = h or np.median(d[np.triu_indices(n, 1)])
    w = np.exp(-(d**2) / (2 * h_used**2))
    np.fill_diagonal(w, 0)
    for normalise, expected in ((False, w @ y), (True, w @ y / w.sum(axis=1, keepdims=True))):
        found = by_key(far_field.kernel_lag(df, places, coords, h, tolerance=tolerance, normalise=normalise), "region", "t")
        got = np.array([[found[(i, day(t))]["lag"] for t in range(steps)] for i in range(n)])
        allowed = (tolerance * np.abs(y).sum(axis=0) + 1e-12) * (1 if not normalise else 3 / w.sum(axis=1, keepdims=True))
        assert (np.abs(got - expected) <= allowed).all()


def test_kernel_lag_of_gaps_and_odd_regions(spark):
    xy = RNG.random((6, 2))
    places, coords = points(spark, xy)
    values = {i: [1.0 * i, 2.0, 3.0] for i in range(6)}
    values[2][1] = None
    values[9] = [5.0, 5.0, 5.0]
    found = by_key(far_field.kernel_lag(panel(spark, values), places, coords, 0.5, normalise=False), "region", "t")
    assert len(found) == 21
    # only the region with the gap knows all others on that day
    assert [k for k, r in found.items() if r["lag"] is None] == [k for k in found if k[1] == day(1) and k[0] != 2]
    assert found[(9, day(0))]["lag"] == 0
    with pytest.raises(ValueError, match="cells"):
        far_field.kernel_lag(panel(spark, values), places, coords, 1e-3)
    one = far_field.kernel_lag(panel(spark, {0: [1.0, 2.0]}), places, coords, 0.5)
    assert [r["lag"] for r in one.collect()] == pytest.approx([0.0, 0.0], abs=1e-9)


def test_terms_follow_the_bound():
    assert far_field.error_bound(12, 0.5, 2) < 1e-7 < far_field.error_bound(8, 0.5, 2)
    assert far_field._terms(1e-9, 0.5, 2) > far_field._terms(1e-9, 0.2, 2)
    with pytest.raises(ValueError):
        far_field._terms(0.0, 0.5, 2)


def largest_share(df, keys):
    """Rows of the largest key over the median one, of those that a join deals by ``keys``."""
    sizes = sorted(r["count"] for r in df.groupBy(*keys).count().collect())
    return sizes[-1] / sizes[len(sizes) // 2]


def test_hubs_are_split_by_their_degree(spark):
    """One region has half of all edges, as neighbour of all others."""
    n, rng = 400, np.random.default_rng(3)
    rows = [(i, 0, 0.5) for i in range(1, n)] + [(i, int(j), 0.25) for i in range(n) for j in {(i + 1) % n} - {0, i}]
    edges = spark.createDataFrame(rows, "i bigint, j bigint, w double").repartition(5)
    hot = salting.hot_keys(edges, ["j"], 20)
    assert [(r["j"], r["_pieces"]) for r in hot.collect()] == [(0, 20)]
    cut = salting.in_pieces(edges, hot, ["j"], ["i"])
    assert cut.where("j = 0").groupBy("_piece").count().agg(F.max("count")).first()[0] < 45
    assert cut.where("j > 0").agg(F.max("_piece")).first()[0] == 0
    dealt = cut.withColumn("task", F.pmod(F.hash("j", "_piece"), F.lit(8)))
    assert largest_share(dealt, ["task"]) < 4 < largest_share(edges.withColumn("task", F.pmod(F.hash("j"), F.lit(8))), ["task"])
    y = rng.normal(size=(n, 3))
    df = panel(spark, {i: list(y[i]) for i in range(n)})
    dense = np.zeros((n, n))
    for i, j, w in rows:
        dense[i, j] = w
    found = by_key(spatial_lag(df, edges, piece_edges=20), "region", "t")
    got = np.array([[found[(i, day(t))]["lag"] for t in range(3)] for i in range(n)])
    np.testing.assert_allclose(got, dense @ y, atol=1e-9)
    turned = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")
    assert same_rows(weights.row_normalise(turned, piece_edges=20), weights.row_normalise(turned))
    assert same_rows(spatial_lag(df, edges), spatial_lag(df, edges, piece_edges=20))


def test_visits_of_vectors_come_back_in_batches():
    """Vectors that reach every cell do not fill a worker with one copy per cell at once."""
    x, centres = RNG.normal(size=(1_500, 8)), RNG.normal(size=(40, 8))
    radius = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(axis=2)).min(axis=1)
    frame = pd.DataFrame({"i": np.arange(len(x)), "v": list(x), "radius": radius, "bound": 100.0})
    found = list(pivots._reached(frame, centres, np.full(40, 10.0)))
    assert max(map(len, found)) <= pivots.BATCH_ROWS < 40 * 1_024
    whole = pd.concat(found)
    assert len(whole) == 1_500 * 40 == len(whole[["i", "cell"]].drop_duplicates())


def test_nearest_is_dealt_by_points(spark, monkeypatch):
    """The rows of the search shrink so well that adaptive execution, which goes by bytes, would put millions into one task."""
    monkeypatch.setattr(neighbours, "TASK_POINTS", 100)
    df, coords = points(spark, CLOUDS["uniform"])
    found = neighbours.nearest(df, coords, 4)
    plan = plan_of(found)
    for key in ("from_leaf", "to_leaf", "key_level"):
        assert re.search(rf"hashpartitioning\({key}#\d+[^()]*, 7\), REPARTITION_BY_NUM", plan)
    assert edge_set(found) == brute_nearest(CLOUDS["uniform"], 4)


def test_distances_are_counted_together(spark, monkeypatch):
    """Lists of places reach Python as one array of numbers each; many lists go into one table of bins, in any number of turns."""
    xy = CLOUDS["dense cluster"]
    row = SimpleNamespace(a_v=xy[:5].ravel(), a_m=np.ones(5, int), b_v=xy[5:9].ravel(), b_m=np.full(4, 2), half=False)
    d, w = pair_ranks._distances(row)
    np.testing.assert_allclose(d.reshape(5, 4), np.sqrt(((xy[:5, None] - xy[None, 5:9]) ** 2).sum(axis=2)))
    assert w.tolist() == [2] * 20
    monkeypatch.setattr(pair_ranks, "COUNTED_TOGETHER", 256)
    monkeypatch.setattr(pair_ranks, "FEW_ROWS", 50)
    df, coords = points(spark, xy)
    every = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))[np.triu_indices(len(xy), 1)])
    ranks = [0, 1_000, len(every) // 2, len(every) - 1]
    assert [pair_ranks.distances_at(df, coords, [r])[0] for r in ranks] == pytest.approx(every[ranks])

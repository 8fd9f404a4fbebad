"""Nearest neighbours, k-means, prefix tree and spectral clustering against plain Python and hand-computed cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import kmeans, knn, metrics, prefix_tree, spectral, topk


def vectors(spark, rows, label=None):
    data = [(i, int(label[i]) if label is not None else 0, [float(x) for x in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "id bigint, label int, vector array<double>")


@pytest.mark.parametrize("parts", [1, 2, 7])
@pytest.mark.parametrize("block", [3, 2048])
def test_nearest_is_exact(spark, parts, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    x[50:] = x[:10]  # equal vectors: ties by id
    df = vectors(spark, x).repartition(parts)
    got = {(r["qid"], r["rank"]): r["id"] for r in topk.nearest(df, df, 4, skip_self=True, block=block).collect()}
    for i in range(60):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = sorted((j for j in range(60) if j != i), key=lambda j: (d[j], j))[:4]
        assert [got[i, k + 1] for k in range(4)] == order


def test_nearest_in_chunks(spark):
    x = np.round(np.random.default_rng(2).normal(size=(50, 3)), 1)  # ties
    df = vectors(spark, x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(i, j) for i in range(50) for j in sorted(set(range(50)) - {i}, key=lambda j: (d[i, j], j))[:4]}
    got = topk.nearest(df, df, 4, skip_self=True, block=8, sent=2)
    assert {(r["qid"], r["id"]) for r in got.collect()} == want and got.count() == 200


def test_nearest_edges(spark):
    x = vectors(spark, [[0.0], [1.0]])
    assert topk.nearest(x, x, 5).count() == 4  # fewer rows than k: all of them
    assert topk.nearest(x, x, 0).count() == 0
    assert topk.nearest(x.limit(0), x, 3).count() == 0
    assert topk.nearest(x, x.limit(0), 3).count() == 0


@pytest.mark.parametrize("far_to_near,fold,majority", [([3, 1, 1], 3, 1), ([1, 1, 3], 1, 1), ([1, -1, -1], -1, -1), ([9, 0, 0, 0], 9, 0), ([0, 0, 0, 9], 9, 0), ([], 0, None)])
def test_votes(spark, far_to_near, fold, majority):
    df = spark.createDataFrame([(far_to_near,)], "c array<int>")
    got = df.select(knn.fold_vote(F.col("c")).alias("f"), knn.majority_vote(F.col("c")).alias("m")).first()
    assert (got["f"], got["m"]) == (fold, majority)


def test_knn_small(spark):
    train = vectors(spark, [[0, 0], [0, 1], [5, 5], [5, 6]], [0, 0, 1, 1])
    test = vectors(spark, [[0.1, 0.2], [5.1, 5.2], [4, 4]], [0, 1, 0])
    got = metrics.accuracy(knn.classify(test, train, 3)).first()
    assert (got["n"], got["missed"]) == (3, 1) and math.isclose(got["accuracy"], 66.666667)
    with pytest.raises(ValueError):
        knn.classify(test, train, 3, "other")


def test_metrics(spark):
    history = spark.createDataFrame([(0, 10.0), (1, 30.0), (2, 20.0), (3, 40.0)], "epoch int, accuracy double")
    assert [(r["best"], r["is_best"]) for r in metrics.running_best(history).orderBy("epoch").collect()] == [(10.0, True), (30.0, True), (30.0, False), (40.0, True)]
    losses = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, loss double")
    assert metrics.drop_easy(losses, cutoff=7).count() == 2
    assert metrics.drop_easy(losses, percentile=0.5).count() == 5
    assert metrics.drop_easy(losses.limit(0), percentile=0.5).count() == 0


def test_kmeans_small(spark):
    df = vectors(spark, [[1, 1], [1, 2], [8, 8], [9, 8]])
    centroids, history = kmeans.fit(df, 2)
    assert history == [4, 1, 0]
    assert np.allclose(centroids, [[1, 1.5], [8.5, 8]])
    assert [r["cluster"] for r in kmeans.assign(df, centroids).orderBy("id").collect()] == [0, 0, 1, 1]


def test_kmeans_dead_centroid(spark):
    centroids, _ = kmeans.fit(vectors(spark, [[1], [1], [5]]), 3)
    assert centroids[0, 0] == 1 and math.isnan(centroids[1, 0]) and centroids[2, 0] == 5


@pytest.mark.parametrize("parts", [1, 5])
def test_kmeans_against_numpy(spark, parts):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    want, old = x[:4].copy(), None
    for _ in range(20):
        own = kmeans.nearest_centroid(x, want)
        new = np.array([x[own == c].mean(0) for c in range(4)])
        done = old is not None and (own == old).all()
        want, old = new, own
        if done:
            break
    df = vectors(spark, x).repartition(parts)
    got, _ = kmeans.fit(df, 4)
    assert np.allclose(got, want)
    assert kmeans.inertia(df, got) <= kmeans.inertia(df, x[:4]) + 1e-9


BASKETS = [[1, 2, 5], [2, 4], [2, 3], [1, 2, 4], [1, 3], [2, 3], [1, 3], [1, 2, 3, 5], [1, 2, 3], [6]]


def baskets(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "tid bigint, items array<bigint>")


def test_tree_small(spark):
    df = baskets(spark, BASKETS)
    ranks = prefix_tree.item_rank(df, 0.2)
    assert {r["item"]: r["rank"] for r in ranks.collect()} == {2: 2, 1: 3, 3: 4}  # 4 and 5 have a support of exactly 0.2
    found = prefix_tree.paths(df, ranks)
    labels, counts = prefix_tree.serialize(prefix_tree.tree_nodes(found), prefix_tree.root_count(found).first()["cnt"])
    assert labels == [-2, 2, -1, 1, 2, -1, -1, 3, 2, -1, 1, 2, -1, -1, -1]
    assert counts == [9, 1, 1, 2, 2, 1, 1, 6, 2, 1, 4, 2, 1, 1, 1]


def test_tree_random_and_merged(spark):
    rng = random.Random(3)
    rows = [[rng.randrange(8) for _ in range(rng.randrange(1, 6))] for _ in range(60)]  # repeats count
    df = baskets(spark, rows)
    ranks = prefix_tree.item_rank(df, 0.15)
    rank = {r["item"]: r["rank"] for r in ranks.collect()}
    want = {}
    for r in rows:
        path = tuple(sorted((rank[i] for i in r if i in rank), reverse=True))
        for d in range(1, len(path) + 1):
            want[path[:d]] = want.get(path[:d], 0) + 1
    whole = prefix_tree.tree_nodes(prefix_tree.paths(df, ranks))
    assert {tuple(r["path"]): r["cnt"] for r in whole.collect()} == want
    parts = [prefix_tree.tree_nodes(prefix_tree.paths(df.filter(F.col("tid") % 3 == k), ranks)) for k in range(3)]
    merged = prefix_tree.merge_trees(*parts)
    assert {tuple(r["path"]): r["cnt"] for r in merged.collect()} == want


def test_tree_prune_and_empty(spark):
    df = baskets(spark, BASKETS)
    nodes = prefix_tree.build(df, 0.2)
    kept = {tuple(r["path"]) for r in prefix_tree.prune(nodes, [3]).collect()}
    assert kept == {p for p in (tuple(r["path"]) for r in nodes.collect()) if p[0] == 4}  # item 3 has the highest rank
    assert prefix_tree.build(df.limit(0), 0.2).count() == 0
    assert prefix_tree.serialize(prefix_tree.build(df.limit(0), 0.2), 0) == ([-2], [0])


def test_spectral_line(spark):
    df = vectors(spark, [[0], [1], [2], [6], [7]])
    graph = spectral.tnn_graph(df, 2)
    near = {}
    for r in graph.collect():
        near.setdefault(r["i"], {})[r["j"]] = r["w"]
    assert near == {0: {1: 1, 2: 2}, 1: {0: 1, 2: 1}, 2: {0: 2, 1: 1}, 3: {2: 4, 4: 1}, 4: {2: 5, 3: 1}}
    sym = spectral.symmetric_closure(graph)
    assert sym.count() == 12
    assert [r["mean"] for r in spectral.row_stats(sym).orderBy("i").collect()] == [1.5, 1, 3, 2.5, 3]
    sim = spectral.similarity(sym)
    assert np.allclose([r["total"] for r in spectral.row_stats(sim).orderBy("i").collect()], [1.357712, 1.563013, 2.081168, 1.279661, 1.184859], atol=1e-6)
    a = {(r["i"], r["j"]): r["w"] for r in spectral.normalize(sim).collect()}
    assert np.allclose([a[0, 1], a[0, 2], a[1, 2], a[2, 3], a[2, 4], a[3, 4]], [0.49187, 0.381437, 0.469335, 0.210888, 0.158791, 0.759742], atol=1e-6)
    values, _, _ = spectral.eigenpairs(spectral.normalize(sim), 5)
    assert np.allclose(values, [1, 0.696343, -0.409343, -0.523991, -0.763008], atol=1e-6)
    by_size, _, _ = spectral.eigenpairs(spectral.normalize(sim), 2, kind="LM")
    assert np.allclose(by_size, [1, -0.763008], atol=1e-6)


def test_zero_distances(spark):
    df = vectors(spark, [[1], [1], [1], [4]])
    a = spectral.normalize(spectral.similarity(spectral.symmetric_closure(spectral.tnn_graph(df, 2))))
    assert all(0 <= r["w"] <= 1 for r in a.collect())


@pytest.mark.parametrize("kind", spectral.KINDS)
def test_lanczos(kind):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 60))
    m = (m + m.T) / 2
    values, vecs, _ = spectral.lanczos_local(lambda x: m @ x, np.arange(60), 3, 20, kind)
    exact = np.linalg.eigvalsh(m)
    assert np.allclose(values, exact[spectral.wanted(exact, 3, kind)], atol=1e-6)
    assert np.allclose(m @ vecs, vecs * values, atol=1e-5)


def test_lanczos_as_tables(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 2))  # one cloud: its largest eigenvalue is single
    a = spectral.normalize(spectral.similarity(spectral.symmetric_closure(spectral.tnn_graph(vectors(spark, x), 5)))).cache()
    values, vectors_, _ = spectral.eigenpairs(a, 2)
    again, tables, bounds = spectral.eigenpairs(a, 2, bound=0, tol=1e-8)
    assert np.allclose(values, again, atol=1e-8) and (bounds <= 1e-8).all()
    m, v = np.zeros((30, 30)), np.array([r["v"] for r in tables.orderBy("id").collect()])
    for r in a.collect():
        m[r["i"], r["j"]] = r["w"]
    assert np.allclose(m @ v, v * again, atol=1e-7)
    assert tables.count() == vectors_.count() == 30


def test_spectral_clusters(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.3, size=(20, 2)), rng.normal(9, 0.3, size=(20, 2))])
    got = [r["cluster"] for r in spectral.spectral_clusters(vectors(spark, x), 2, 6, init="random").orderBy("id").collect()]
    assert len(set(got[:20])) == len(set(got[20:])) == 1 and got[0] != got[20]

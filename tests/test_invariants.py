"""Properties of iterative results, layouts, skew and degenerate input."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regatta.operators import aggregate as agg
from regatta.operators import communities as C
from regatta.operators import graph as G
from regatta.operators import kmeans as KM
from regatta.operators import pairs as P
from regatta.operators import projection, sampling, scoring
from regatta.operators.common import value_rank
from regatta.plans.clustering import METHODS, cluster
from regatta.plans.rounds import fit_rounds


def rand_index(a, b):
    """Adjusted Rand index of two labellings."""
    table = pd.crosstab(np.asarray(a), np.asarray(b)).to_numpy()
    pairs = lambda x: (x * (x - 1) / 2).sum()
    both, rows, cols = pairs(table), pairs(table.sum(1)), pairs(table.sum(0))
    n = table.sum()
    expected = rows * cols / (n * (n - 1) / 2)
    return (both - expected) / ((rows + cols) / 2 - expected)


@pytest.fixture(scope="module")
def planted(spark):
    """Three tight bundles of 15 directions in 8 dimensions."""
    rng = np.random.default_rng(3)
    centres = np.eye(8)[:3]
    rows = [(i, i % 3, (centres[i % 3] + rng.normal(0, 0.05, 8)).tolist()) for i in range(45)]
    return spark.createDataFrame(rows, "entity long, truth int, vector array<double>").cache()


@pytest.mark.parametrize("method", METHODS)
def test_planted_clusters_are_found(planted, method):
    k = 3 if method in ("kmeans", "spectral") else None
    part = cluster(planted, method, "cosine", k=k, max_distance=0.5, max_passes=6)
    rows = planted.join(part, "entity").collect()
    assert len(rows) == 45
    assert rand_index([r.truth for r in rows], [r.cluster for r in rows]) >= 0.95


def test_consensus_finds_planted_clusters(planted):
    part = cluster(planted, "louvain", max_distance=0.5, consensus_runs=5, max_passes=4)
    rows = planted.join(part, "entity").collect()
    assert rand_index([r.truth for r in rows], [r.cluster for r in rows]) >= 0.95


def test_louvain_beats_singletons(triangles):
    history = []
    labels = C.louvain_runs(triangles, [1.0], 6, history=history)
    q = G.modularity(triangles, labels.select("node", "community"), 1.0).first()[0]
    assert q == pytest.approx(max(h[0] for h in history))
    assert q >= history[0][0]


def test_kmeans_inertia_never_rises(planted):
    seen = []
    KM.fit_centres(planted, 3, "l2", 20, 1, inertias=seen)
    assert all(b <= a + 1e-9 for a, b in zip(seen, seen[1:]))


def test_choose_k(planted):
    assert KM.choose_k(planted, "cosine", 5, 7) in (2, 3)


def brute_pairs(rows, kernel, bound):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    d = P.KERNELS[kernel](x, x)
    return {(int(ids[i]), int(ids[j])): d[i, j] for i in range(len(ids)) for j in range(i + 1, len(ids))
            if d[i, j] <= bound}


@pytest.mark.parametrize("metric,bound", [("l2", 0.3), ("l1", 0.5), ("cosine", 0.01), ("hamming", 2)])
def test_pruned_pairs_match_brute_force(spark, monkeypatch, metric, bound):
    monkeypatch.setattr(P, "BLOCK_ROWS", (8, 8))
    monkeypatch.setattr(P, "PIVOTS", 6)
    rng = np.random.default_rng(5)
    base = rng.normal(0, 4, (9, 4))
    x = base[rng.integers(0, 9, 150)] + rng.normal(0, 0.05, (150, 4))
    if metric == "cosine":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if metric == "hamming":
        x = np.round(x)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "entity long, vector array<double>")
    got = {(r.src, r.dst): r.d for r in P.pair_distances(df, metric, bound).collect()}
    want = brute_pairs(rows, metric, bound)
    assert got.keys() == want.keys()
    assert list(got.values()) == pytest.approx([want[k] for k in got], abs=1e-9)


def test_nearest_neighbours_and_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", (8, 8))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity long, vector array<double>")
    d = P.KERNELS["l2"](x, x)
    np.fill_diagonal(d, np.inf)
    got = P.nearest_neighbours(df, 3, "l2").groupBy("src").agg(F.array_sort(F.collect_list("dst"))).collect()
    assert {r[0]: r[1] for r in got} == {i: sorted(np.argsort(d[i])[:3].tolist()) for i in range(40)}
    mean = P.mean_pair_distance(df, "l2").first()[0]
    assert mean == pytest.approx(d[np.triu_indices(40, 1)].mean())


def test_closed_form_means_match_pairs(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(60, 3)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity long, vector array<double>")
    for metric in ("l1", "cosine"):
        assert P.mean_pairwise(df, metric).first()[0] == pytest.approx(
            P.mean_pair_distance(df, metric).first()[0])


def test_copies_are_one_node(spark):
    """A third of all rows is one vector: one node with a self edge, no pairs among the copies."""
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(30 + i, [float(np.cos(i)), float(np.sin(i))]) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "entity long, vector array<double>")
    edges = G.similarity_graph(df, "cosine", 0.05).cache()
    own = edges.filter("src = dst").collect()
    assert [(r.src, r.w) for r in own] == [(0, 870.0)]
    assert edges.filter("src between 1 and 29 or dst between 1 and 29").count() == 0
    part = cluster(df, "louvain", max_distance=0.05, max_passes=3)
    assert part.count() == len(rows)
    assert part.filter("entity < 30").select("cluster").distinct().count() == 1


def test_median_with_a_hot_group(spark):
    rng = np.random.default_rng(8)
    hot, cold = rng.normal(size=20001), np.round(rng.normal(size=500), 1)
    rows = [(0, 0, float(v)) for v in hot] + [(1, 0, float(v)) for v in cold]
    long = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "idx", "val"]))
    got = {r.g: r.val for r in agg.long_median(long, ["g"]).collect()}
    assert got == {0: pytest.approx(np.median(hot)), 1: pytest.approx(np.median(cold))}


def test_value_rank_with_ties(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": 0, "id": np.arange(3000), "v": np.round(rng.normal(size=3000), 2)})
    got = value_rank(spark.createDataFrame(pdf), ["k"], "v", "id").toPandas().sort_values("rank")
    want = pdf.sort_values(["v", "id"])
    assert got["rank"].tolist() == list(range(1, 3001))
    assert got["id"].tolist() == want["id"].tolist()


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_layout_does_not_matter(planted, parts):
    rows = planted.withColumn("weight", F.lit(1.0)).withColumn("g", F.col("truth"))

    def run(df):
        mean = agg.vector_aggregate(df, ["g"]).withColumn("val", F.round("val", 9))
        pick = sampling.shuffle_and_take(df.select("entity"), "entity", 10, 3)
        graph = G.similarity_graph(df, "cosine", 0.5).withColumn("w", F.round("w", 9))
        return [sorted(map(tuple, t.collect())) for t in (mean, pick, graph)]

    assert run(rows.repartition(parts, F.rand(parts))) == run(rows)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "entity long, vector array<double>")
    one = spark.createDataFrame([(1, [1.0, 2.0])], "entity long, vector array<double>")
    assert P.pair_distances(none, "l2", all_pairs=True).count() == 0
    assert P.pair_distances(one, "l2", all_pairs=True).count() == 0
    assert agg.mean_pairwise_cosine(none).first()[0] == 1.0
    assert KM.kmeans(none, 3).count() == 0
    assert [r.cluster for r in KM.kmeans(one, 3).collect()] == [0]
    edges = spark.createDataFrame([], "src long, dst long, w double")
    assert G.modularity(edges, spark.createDataFrame([(1, 1)], "node long, community long")).first()[0] == 0.0


def test_the_whole_matrix_must_be_asked_for(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "entity long, vector array<double>")
    with pytest.raises(ValueError):
        P.pair_distances(df, "l1")
    assert P.pair_distances(df, "l1", all_pairs=True).count() == 10


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 101)]
    nodes = spark.createDataFrame([(i,) for i in [*range(21), 100, 101, 200]], "node long")
    edges = spark.createDataFrame(links, "src long, dst long")
    got = {r.node: r.component for r in G.connected_components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 200: 200}


def test_agreement_counts(spark):
    rows = [(r, n, c) for r, labels in enumerate([[0, 0, 1, 1], [0, 0, 0, 1], [0, 0, 1, 1]])
            for n, c in enumerate(labels)]
    labels = spark.createDataFrame(rows, "run int, node long, community long")
    counted, members = C.agreement(labels, 3, 1)
    assert {(r.src, r.dst): r["count"] for r in counted.collect()} == {(0, 2): 1, (2, 3): 2}
    assert {r.node: r.src for r in members.collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_pca_matches_numpy(planted):
    mean, basis = projection.principal_components(planted)
    x = np.array([r.vector for r in planted.orderBy("entity").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(0))
    assert mean == pytest.approx(x.mean(0))
    assert np.abs(basis @ basis.T - np.eye(3)).max() < 1e-9
    assert np.abs(np.sum(basis[:2] * vt[:2], axis=1)) == pytest.approx([1, 1], abs=1e-6)


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        label = i % 2
        rows.append((i % 4, i, [label * 2.0 - 1 + rng.normal(0, 0.3), rng.normal(0, 0.3)], label))
    return spark.createDataFrame(rows, "entity long, sample_id long, features array<double>, label int").cache()


def test_sharded_training_learns(spark, training):
    shape = (2, 4, 2)
    start = scoring.xavier_vector(spark, *shape, 1).withColumn("all", F.lit(0))
    one = agg.to_vectors(start, ["all"]).select("vector").scalar()
    starts = training.select("entity").distinct().withColumn("vector", one)
    whole = scoring.train_per_entity(training, starts, shape, rate=0.1, epochs=10)
    cut = scoring.train_per_entity(training, starts, shape, rate=0.1, epochs=10, shard_rows=20)
    for models in (whole, cut):
        scored = scoring.score_per_entity(training, models, *shape)
        from regatta.operators.quality import accuracy

        assert accuracy(scored).first()[0] > 0.9
        assert [r.n for r in models.collect()] == [60] * 4


def test_rounds_improve(training):
    history, final = fit_rounds(training, (2, 4, 2), rounds=2, method="kmeans", k=2, rate=0.1, seed=4)
    rows = history.orderBy("round").collect()
    assert rows[1].loss < rows[0].loss
    assert final.count() == 4


def test_skewed_sample_sizes(spark):
    samples = spark.createDataFrame([(i, i % 10) for i in range(500)], "sample_id long, label int")
    wants = spark.createDataFrame([(i, i % 10, 40) for i in range(20)], "entity long, label int, n int")
    got = sampling.skewed_sample(wants, samples, 5)
    sizes = got.groupBy("entity", "part").count().collect()
    assert {(r.part, r["count"]) for r in sizes} == {("primary", 28), ("any", 12)}
    inside = got.filter("part = 'primary'").join(samples, "sample_id").join(
        wants.select("entity", F.col("label").alias("want")), "entity")
    assert inside.filter("label <> want").count() == 0
    assert got.groupBy("entity", "part", "sample_id").count().filter("count > 1").count() == 0


def test_primary_shortage_is_topped_up(spark):
    samples = spark.createDataFrame([(i, 0 if i < 5 else 1) for i in range(100)], "sample_id long, label int")
    wants = spark.createDataFrame([(1, 0, 40), (2, 7, 40)], "entity long, label int, n int")
    got = {(r.entity, r.part): r["count"] for r in sampling.skewed_sample(wants, samples, 5).groupBy("entity", "part").count().collect()}
    assert got == {(1, "primary"): 5, (1, "any"): 35, (2, "any"): 40}


@pytest.mark.parametrize("metric, bound", [("l1", 6.0), ("l2", 1.2), ("cosine", 0.3)])
def test_rows_travel_less_often_than_there_are_small_blocks(spark, monkeypatch, metric, bound):
    monkeypatch.setattr(P, "BLOCK_ROWS", (8, 8))
    made, small = [], P.make_blocks
    monkeypatch.setattr(P, "make_blocks", lambda *a, **k: made.append(small(*a, **k)) or made[-1])
    x = np.random.default_rng(8).normal(size=(400, 12))
    if metric == "cosine":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "entity long, vector array<double>")
    got = {(r.src, r.dst): r.d for r in P.pair_distances(df, metric, bound).collect()}
    want = brute_pairs(rows, metric, bound)
    assert got.keys() == want.keys()
    assert made[0].rows.count() <= 400 * 25


@pytest.mark.parametrize("metric", ["l1", "l2"])
@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-3, 1e3), (1e30, 0.0), (1e200, 0.0)])
def test_rough_filters_lose_no_cell(metric, scale, shift):
    rng = np.random.default_rng(3)
    a, b = (rng.normal(size=(n, 33)) * scale + shift for n in (40, 50))
    a[3], b[4, 0], b[5, 1] = b[7], np.nan, np.inf
    with np.errstate(all="ignore"):
        d = P.KERNELS[metric](a, b)
        for bound in (0.0, *np.nanquantile(d[np.isfinite(d)], [0.01, 0.5] if np.isfinite(d).any() else [])):
            i, j, near = P._near_cells(a, b, metric, float(bound))
            assert set(zip(i, j)) == set(zip(*np.nonzero(d <= bound)))
            assert (near == d[i, j]).all()

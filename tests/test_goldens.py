"""Hand-sized expected values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regatta.functions import arrays as A
from regatta.functions.hashing import hash_uniform
from regatta.operators import aggregate as agg
from regatta.operators import assign, quality, sampling
from regatta.operators import graph as G
from regatta.operators import kmeans as KM
from regatta.operators import pairs as P
from regatta.operators import spectral as S
from regatta.operators.communities import sweep_resolutions
from regatta.operators.history import adaptive_effort, band

VECTORS = [(0, 100.0, [1.0, 2.0, 3.0]), (1, 300.0, [3.0, 2.0, 1.0]), (2, 200.0, [5.0, 8.0, -1.0]),
           (3, 400.0, [7.0, 0.0, 9.0])]


@pytest.fixture
def fleet(spark):
    return spark.createDataFrame(VECTORS, "entity long, weight double, vector array<double>").withColumn(
        "g", F.lit(0)
    )


def values(df):
    return [r["val"] for r in df.orderBy("idx").collect()]


@pytest.mark.parametrize("how,want", [
    ("fedavg", [4.8, 2.4, 4.0]), ("fedprox", [4.8, 2.4, 4.0]), ("simple", [4, 3, 3]),
    ("median", [4, 2, 2]),
])
def test_vector_aggregates(fleet, how, want):
    assert values(agg.vector_aggregate(fleet, ["g"], how)) == pytest.approx(want)


def test_median_of_three(fleet):
    assert values(agg.vector_median(fleet.filter("entity < 3"), ["g"])) == [3, 2, 1]


def test_unknown_aggregate_is_an_error(fleet):
    with pytest.raises(ValueError):
        agg.vector_aggregate(fleet, ["g"], "nothing")


def test_zero_total_weight_is_null(fleet):
    zero = fleet.withColumn("weight", F.lit(0.0))
    assert values(agg.vector_aggregate(zero, ["g"], "fedavg")) == [None] * 3


def test_distances(spark):
    row = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 0.0, 1.0], [0.0, 0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    got = row.select(A.l1_distance(a, b), A.l2_distance(a, b), A.cosine_distance(a, b),
                     A.cosine_distance(a, z)).first()
    assert list(got) == pytest.approx([4, 2.449489742783178, 0.40371520600005617, 1])


POINTS = [(0, [0.0]), (1, [1.0]), (2, [10.0]), (3, [13.0])]


@pytest.fixture
def points(spark):
    return spark.createDataFrame(POINTS, "entity long, vector array<double>")


def test_kernel(points):
    sigma = agg.mean_pairwise_l1(points)
    assert sigma.first()[0] == 8.0
    w = G.kernel_weights(P.pair_distances(points, "l1", all_pairs=True), sigma.scalar())
    got = {(r.src, r.dst): r.w for r in w.collect()}
    want = {(0, 1): .882497, (0, 2): .286505, (0, 3): .196912, (1, 2): .324652, (1, 3): .223130, (2, 3): .687289}
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("labels,want,means", [
    ([0, 0, 1, 1], 0.815503977334641, [0.9089026915, 0.7221052632]),
    ([0, 0, 0, 1], 0.5793409806567701, None),
    ([0, 0, 0, 0], 0.0, [0.0]),
])
def test_silhouette(spark, points, labels, want, means):
    part = spark.createDataFrame(list(enumerate(labels)), "entity long, cluster int")
    for per in (
        quality.silhouette_from_distances(P.pair_distances(points, "l1", all_pairs=True), part),
        quality.silhouette(points.join(part, "entity"), "l1"),
    ):
        rows = per.orderBy("cluster").collect()
        assert quality.silhouette_average(per).first()[0] == pytest.approx(want)
        if means:
            assert [r.silhouette for r in rows] == pytest.approx(means)


@pytest.mark.parametrize("labels,gamma,want", [
    ([0, 0, 0, 1, 1, 1], 1, 0.35714285714285715), ([0, 0, 0, 1, 1, 1], 2, -0.14285714285714282),
    ([0, 1, 2, 3, 4, 5], 1, -0.17346938775510204), ([0] * 6, 1, 0.0),
])
def test_modularity(spark, triangles, labels, gamma, want):
    part = spark.createDataFrame(list(enumerate(labels)), "node long, community long")
    assert G.modularity(triangles, part, gamma).first()[0] == pytest.approx(want)


def test_louvain_gains(triangles, singletons):
    for gamma, want in [(1, (0.05102040816326531, 0.04081632653061224)),
                        (2, (0.030612244897959186, 0.010204081632653064))]:
        gains = {r.target: r.gain for r in G.all_gains(triangles, singletons, gamma)
                 .filter("src = 0").collect()}
        assert (gains[1], gains[2]) == pytest.approx(want, abs=1e-11)
    best = {r.src: r.target for r in G.louvain_step(triangles, singletons, 1).collect()}
    assert best == {0: 1, 1: 0, 2: 0, 3: 4, 4: 5, 5: 4}


def test_leiden_gains(triangles, singletons):
    gains = {r.target: r.gain for r in G.all_gains(triangles, singletons, 1, "leiden")
             .filter("src = 0").collect()}
    assert (gains[1], gains[2]) == pytest.approx((0.10204081632653061, 0.08163265306122448), abs=1e-11)


def test_laplacian_eigenvalues(triangles):
    rows = S.normalised_laplacian(triangles).collect()
    m = np.zeros((6, 6))
    for r in rows:
        m[r.src, r.dst] = r.value
    want = [0, 0.204666, 1.166667, 1.5, 1.5, 1.628667]
    assert np.linalg.eigvalsh(m) == pytest.approx(want, abs=1e-6)
    found, vectors = S.smallest_eigenvectors(triangles, 3)
    assert found == pytest.approx(want[:3], abs=1e-5)
    x = np.zeros((6, 3))
    for r in vectors.collect():
        x[r.node] = r.x
    assert np.abs(m @ x - x * np.array(found)).max() < 1e-4
    assert S.eigengap_k(found, 6, 3) == 2


@pytest.mark.parametrize("inertias,want", [([100, 40, 30, 25, 22], 2), ([100, 90, 20, 15, 12], 3),
                                           ([9, 4], 2)])
def test_elbow(spark, inertias, want):
    table = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(inertias)], "k int, inertia double")
    assert KM.elbow(table, 10).first()["k"] == want


@pytest.mark.parametrize("d,want", [([1.0, 2.0, 5.0], [.4375, .375, .1875]),
                                    ([0.0, 2.0, 0.0], [.5, 0, .5]), ([2.0], [1.0])])
def test_assignment_probabilities(spark, d, want):
    got = spark.createDataFrame([(d,)], "d array<double>").select(assign.probabilities(F.col("d"))).first()[0]
    assert got == pytest.approx(want)


def test_softmax_and_loss(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 0.0])], "z array<double>, p array<double>")
    probs = A.softmax(F.col("z"))
    got = row.select(probs, A.cross_entropy(probs, F.lit(2)), A.cross_entropy(F.col("p"), F.lit(1))).first()
    assert got[0] == pytest.approx([0.09003057, 0.24472847, 0.66524096])
    assert (got[1], got[2]) == pytest.approx((0.407605964, 16.11809565))


def test_band(spark):
    df = spark.createDataFrame([(.8,), (.9,), (.7,)], "v double").withColumn("k", F.lit(0))
    row = band(df, ["k"], "v").first()
    assert (row["mean"], row["std"], row["low"], row["high"]) == pytest.approx(
        (80, 8.16496580927726, 71.83503419, 88.16496581))


def test_sweep():
    got = sweep_resolutions()
    assert len(got) == 20
    assert (got[0], got[1], got[-2], got[-1]) == pytest.approx((0.5, 0.605263, 2.394737, 2.5), abs=1e-6)
    assert sweep_resolutions(1) == [0.5]


def test_sample_sizes(spark):
    rows = spark.createDataFrame([(200,), (250,), (400,), (599,)], "n int").select(
        sampling.test_size(F.col("n")), sampling.primary_share(F.col("n"))).collect()
    assert [r[0] for r in rows] == [50, 50, 80, 119]
    assert (rows[0][1], rows[3][1]) == (140, 419)


def test_adaptive_effort(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.2, 1.3, 2.0])], "entity string, round int, norm double")
    assert [r.effort for r in adaptive_effort(df, "norm", ["entity"], 3).orderBy("round").collect()] == [3, 6, 3, 6]


def test_hash_uniform(spark):
    u = spark.range(1).select(hash_uniform(F.lit(5), 42)).first()[0]
    assert u * 2**32 == 219796769
    assert math.floor(u * 400) + 200 == 220

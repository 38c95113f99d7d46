from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from regatta.functions.ids import numeric_suffix
from regatta.operators import assign as A
from regatta.operators import communities as C
from regatta.operators import kmeans as KM
from regatta.operators.assign import cluster_vector_or_global
from regatta.operators.scoring import score_per_entity
from regatta.plans.rounds import fit_rounds


@pytest.fixture
def samples(spark):
    rng = np.random.default_rng(0)
    rows = []
    for entity in range(8):
        for n in range(12):
            label = int(rng.integers(0, 2))
            point = rng.normal(size=3) + (2 if label else -2)
            rows.append((entity, entity * 100 + n, [float(x) for x in point], label))
    return spark.createDataFrame(rows, "entity long, sample_id long, features array<double>, label int")


def test_entities_that_sit_out_keep_their_state(spark, samples):
    test = samples.where("sample_id % 4 = 0")
    history, final = fit_rounds(samples, (3, 4, 2), rounds=4, method="kmeans", k=2, per_round=3, epochs=2,
                                rate=0.3, test=test, seed=3)
    rows = history.orderBy("round").collect()
    assert [r["round"] for r in rows] == [0, 1, 2, 3] and all(r["entities"] == 3 for r in rows)
    assert final.count() == final.select("entity").distinct().count() > 3
    assert rows[-1]["accuracy"] > 0.8 and rows[-1]["loss"] < rows[0]["loss"]


def test_samples_of_entities_without_a_model_have_no_score(spark, samples):
    model = spark.createDataFrame([(0, [0.1] * 26)], "entity long, vector array<double>")
    assert {r["entity"] for r in score_per_entity(samples, model, 3, 4, 2).collect()} == {0}


def test_isolated_nodes_stay(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, w double")
    nodes = spark.range(4).withColumnRenamed("id", "node")
    for found in (C.louvain(edges, nodes=nodes), C.leiden(edges, nodes=nodes)):
        labels = {r["node"]: r["community"] for r in found.collect()}
        assert set(labels) == {0, 1, 2, 3} and labels[2] == -3 and labels[3] == -4
    runs = C.with_isolated(C.louvain_runs(edges, [0.5, 1.0]), nodes)
    assert runs.groupBy("run").count().where("count = 4").count() == 2


def test_a_step_uses_every_centre(spark):
    rows = [(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(25)]
    fleet = spark.createDataFrame(rows, "entity long, vector array<double>")
    centres = np.array([v for _, v in rows])
    moved = KM.lloyd_step(fleet, centres, "l2")
    assert moved.select("cluster").distinct().count() == 25


def test_a_second_global_row_is_an_error(spark):
    entities = spark.createDataFrame([(1, 7)], "entity long, cluster long")
    none = spark.createDataFrame([], "cluster long, vector array<double>")
    two = spark.createDataFrame([([1.0],), ([2.0],)], "vector array<double>")
    assert cluster_vector_or_global(entities, none, two.limit(1)).first()["vector"] == [1.0]
    with pytest.raises(Exception, match="[Ss]ubquery|SCALAR"):
        cluster_vector_or_global(entities, none, two).collect()


def test_long_id_numbers(spark):
    ids = spark.createDataFrame([("client-99999999999",), ("x",)], "id string")
    assert [r[0] for r in ids.select(numeric_suffix(F.col("id"))).collect()] == [99999999999, 0]


@pytest.mark.parametrize("metric", ["cosine", "l1", "l2"])
def test_more_centres_than_a_scalar_takes(spark, monkeypatch, metric):
    rng = np.random.default_rng(5)
    fleet = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)],
                                  "entity long, vector array<double>")
    rows = [(i, rng.normal(size=4).tolist()) for i in range(37)]
    centres = spark.createDataFrame([*rows, (99, rows[3][1])], "cluster long, vector array<double>")
    plain = [{(r["entity"], r["cluster"]): r["d"] for r in f(fleet, centres, metric).collect()}
             for f in (A.nearest, A.centre_distances)]
    for name, value in (("LOOKUP_LIMIT", 5), ("BLOCK_CENTRES", 8), ("BLOCK_ENTITIES", 16)):
        monkeypatch.setattr(A, name, value)
    for f, wanted in zip((A.nearest, A.centre_distances), plain):
        got = {(r["entity"], r["cluster"]): r["d"] for r in f(fleet, centres, metric).collect()}
        assert got.keys() == wanted.keys()
        assert all(abs(got[k] - wanted[k]) < 1e-9 for k in got)
    assert A.nearest(fleet.limit(0), centres, metric).count() == 0


def test_eigen_queries_settle_and_keep_every_cluster_and_node(spark, monkeypatch):
    from regatta.catalog import graphs, load

    links = [(6 * c + i, 6 * c + j, 1.0) for c in range(6) for i in range(6) for j in range(i)]
    links += [(6 * c, (6 * c + 6) % 36, 0.02) for c in range(6)]
    rows = [(a, b, w) for x, y, w in links for a, b in ((x, y), (y, x))]
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    monkeypatch.setattr(graphs, "fleet_graph", lambda spark, sf: edges)
    monkeypatch.setattr(graphs, "fleet_nodes", lambda spark, sf: spark.range(38).withColumnRenamed("id", "node"))
    gap = load().queries["k20_eigengap_k"](spark, "").first()
    assert (gap["nodes"], gap["isolated"], gap["k"]) == (38, 2, 6)
    rows = load().queries["k19_smallest_eigenvectors"](spark, "").collect()
    assert {r["node"] for r in rows} == set(range(38)) and len(rows) == 38 * 3
    assert all(r["val"] == 0 for r in rows if r["node"] >= 36)
    assert gap["settled"] in (True, False) and len({r["settled"] for r in rows}) == 1


def test_eigenvectors_settle_to_the_exact_ones(spark):
    import numpy as np

    from regatta.operators import spectral as S

    rng = np.random.default_rng(8)
    a = np.triu((rng.random((150, 150)) < 0.06) * rng.random((150, 150)), 1)
    a = a + a.T
    src, dst = np.nonzero(a)
    rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(src, dst, strict=True)]
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    values, vectors, residual = S.eigenvectors_and_residual(edges, 3)
    linked = np.flatnonzero(a.sum(1))
    a = a[np.ix_(linked, linked)]
    root = np.sqrt(a.sum(1))
    laplacian = np.eye(len(a)) - a / np.outer(root, root)
    x = np.array([r["x"] for r in vectors.orderBy("node").collect()])
    assert residual < S.TOLERANCE and np.allclose(values, np.linalg.eigvalsh(laplacian)[:3], atol=1e-9)
    assert np.abs(laplacian @ x - x * values).max() < S.TOLERANCE
    assert np.allclose(x.T @ x, np.eye(3), atol=1e-8)

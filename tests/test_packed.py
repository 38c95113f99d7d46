from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from regatta.operators import common, graph, packed, pairs, spectral
from regatta.operators import communities as C
from regatta.operators.packed import PackedEdges

EDGE = "src long, dst long, w double"


def uneven(spark, nodes=60, seed=3):
    """Random weighted links, some ties, a self edge, far and negative ids, one edge that has no way back."""
    rng = np.random.default_rng(seed)
    ids = np.concatenate([np.arange(nodes) * 7 - 40, [10**12]])
    rows = {}
    for a, b, w in zip(rng.choice(ids, 6 * nodes), rng.choice(ids, 6 * nodes), rng.integers(1, 5, 6 * nodes) / 4):
        if a != b:
            rows[int(a), int(b)] = rows[int(b), int(a)] = float(w)
    rows[int(ids[2]), int(ids[2])] = 2.0
    rows[int(ids[3]), 5] = 1.0
    return spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], EDGE)


def as_set(df):
    return sorted(map(tuple, df.collect()))


def by_tables(monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_CELLS", 0)


def test_packed_edges_hold_every_edge_once(spark):
    edges = uneven(spark).repartition(7)
    with PackedEdges.open(edges) as held:
        got = [
            (held.nodes[r], held.nodes[c], x)
            for rows, starts, cols, w in held.chunks(1).collect()
            for r, c, x in zip(np.repeat(rows, np.diff(np.append(starts, len(cols)))), cols, w)
        ]
        sums = {r["node"]: (r["k"], r["loop"]) for r in C._degree_table(edges).collect()}
        assert {n: (k, own) for n, k, own in zip(held.nodes, held.k, held.loop)} == sums
    known = set(held.nodes.tolist())
    want = [tuple(r) for r in edges.collect() if r["src"] != r["dst"] and r["dst"] in known]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("walk", [C.louvain_runs, C.leiden_runs])
@pytest.mark.parametrize("dense", [0.0, 100.0])
def test_packed_walks_equal_those_over_tables(spark, monkeypatch, walk, dense):
    monkeypatch.setattr(packed, "DENSE_SHARE", dense)
    monkeypatch.setattr(packed, "STRIP_EDGES", 64)
    edges = uneven(spark).cache()
    steps, others = [], []
    found = as_set(walk(edges, [0.5, 1.0, 2.5], 2, history=steps))
    by_tables(monkeypatch)
    assert as_set(walk(edges, [0.5, 1.0, 2.5], 2, history=others)) == found
    assert [set(s) for s in steps] == [set(s) for s in others]
    for s, o in zip(steps, others):
        assert s == pytest.approx(o)


def test_runs_that_do_not_fit_at_once_go_one_after_the_other(spark, monkeypatch):
    edges = uneven(spark).cache()
    together = as_set(C.louvain_runs(edges, [0.5, 1.0, 2.5], 4))
    monkeypatch.setattr(packed, "most_cells", lambda: 70)
    assert as_set(C.louvain_runs(edges, [0.5, 1.0, 2.5], 4)) == together


def test_edges_are_made_once_and_never_written(spark, monkeypatch):
    made, written = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = uneven(spark).cache()
    write = common.cut_lineage
    for module in (packed, C):
        monkeypatch.setattr(module, "cut_lineage", lambda df: written.append(df.columns) or write(df))
    C.louvain_runs(edges.mapInArrow(counted, EDGE), [1.0], 3).collect()
    assert made.value == edges.count()
    assert not any("dst" in columns for columns in written)


def test_odd_edges_stay_tables(spark):
    edges = uneven(spark)
    for row in ((1, 2, None), (None, 2, 1.0), (1, 2, float("nan")), (1, 2, float("inf"))):
        assert PackedEdges.open(edges.unionByName(spark.createDataFrame([row], EDGE))) is None
    assert PackedEdges.open(spark.createDataFrame([(None, None, None)], EDGE)) is None
    assert PackedEdges.open(edges.limit(0)) is None
    assert PackedEdges.open(spark.createDataFrame([(1, 2, 0.0), (2, 1, 0.0)], EDGE)) is None


def test_packed_step_to_the_strongest_neighbour(spark):
    edges = uneven(spark).filter("dst <> 5").cache()
    nodes = edges.select(F.col("src").alias("node")).distinct()
    labels = nodes.withColumn("community", F.pmod("node", F.lit(5))).cache()
    with PackedEdges.open(edges) as held:
        found = as_set(packed.refine(held, labels))
    assert found == as_set(graph.strongest_neighbour_refine(edges, labels)) != as_set(labels)


@pytest.mark.parametrize("least", [0, 1000])
def test_packed_products_and_eigenvalues(spark, monkeypatch, least):
    monkeypatch.setattr(packed, "ROW_EDGES", least)
    edges = uneven(spark).filter("dst <> 5").cache()
    with PackedEdges.open(edges) as held:
        x = np.random.default_rng(1).random((held.n, 4))
        at = {n: i for i, n in enumerate(held.nodes)}
        full = np.zeros((held.n, held.n))
        for r in edges.collect():
            full[at[r["src"]], at[r["dst"]]] = r["w"] / np.sqrt(held.k[at[r["src"]]] * held.k[at[r["dst"]]])
        assert np.allclose(packed.product(held, x), full @ x)
    values, vectors, residual = spectral.eigenvectors_and_residual(edges, 3)
    assert values == pytest.approx(np.sort(1 - np.linalg.eigvalsh(full))[:3], abs=1e-6)
    assert vectors.count() == len(full) and residual < spectral.TOLERANCE
    count = spectral.cluster_count(edges)
    by_tables(monkeypatch)
    assert spectral.cluster_count(edges)[:2] == count[:2]


def test_links_of_a_task_have_the_components_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "STREAMED_ROWS", 16)
    monkeypatch.setattr(pairs, "STRIP_CELLS", 100)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(v) for v in rng.integers(0, 3, 8)]) for i in range(150)]
    df = spark.createDataFrame(rows, "entity long, vector array<double>").cache()
    nodes = df.select(F.col("entity").alias("node"))
    for bound in (1.0, 2.0):
        all_pairs = pairs.pair_distances(df, "hamming", bound)
        forest = pairs.near_forest(df, "hamming", bound)
        want = as_set(graph.connected_components(nodes, all_pairs))
        assert as_set(graph.connected_components(nodes, forest)) == want
        assert forest.subtract(all_pairs.select("src", "dst")).count() + forest.count() < 2 * all_pairs.count() + 150


def test_hamming_counts_places_that_differ():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 3, (n, 300)).astype(float) for n in (70, 50))
    a[0, 0] = np.nan
    assert (pairs._hamming(a, b) == (a[:, None] != b[None]).sum(-1)).all()

from __future__ import annotations

import numpy as np
import pytest

from regatta.operators import quality, ranked_l1


def brute(x, label):
    d = np.abs(x[:, None] - x[None]).sum(2)
    out = {}
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        others = [d[i, label == c].mean() for c in np.unique(label) if c != label[i]]
        out[i] = (d[i, own].mean() if own.any() else 0.0, min(others) if others else None)
    return out


@pytest.mark.parametrize("clusters,bucket", [(1, 4096), (3, 7), (70, 25), (70, 4096)])
def test_own_and_nearest_against_all_pairs(spark, clusters, bucket, monkeypatch):
    monkeypatch.setattr(ranked_l1, "BUCKET_VALUES", bucket)
    rng = np.random.default_rng(clusters)
    x = np.round(rng.normal(size=(160, 4)), 1)
    x[:60, 0] = 0.0
    label = rng.integers(0, clusters, 160)
    rows = [(i, int(label[i]) * 3, [float(v) for v in x[i]]) for i in range(160)]
    df = spark.createDataFrame(rows, "entity long, cluster int, vector array<double>").repartition(5)
    want = brute(x, label)
    got = {r["entity"]: (r["a"], r["b"]) for r in ranked_l1.own_and_nearest(df).collect()}
    assert got.keys() == want.keys()
    for i, (a, b) in want.items():
        assert got[i][0] == pytest.approx(a, abs=1e-9)
        assert got[i][1] is None if b is None else got[i][1] == pytest.approx(b, abs=1e-9)


def test_the_hand_sized_silhouette(spark):
    def score(labels):
        rows = [(i, c, [float(v)]) for i, (c, v) in enumerate(zip(labels, (0, 1, 10, 13)))]
        df = spark.createDataFrame(rows + [(9, 0, None)], "entity long, cluster int, vector array<double>")
        return quality.silhouette_average(quality.silhouette(df, "l1")).first()[0]

    assert score([0, 0, 1, 1]) == pytest.approx(0.815503977334641)
    assert score([0, 0, 0, 1]) == pytest.approx(0.5793409806567701)
    assert score([0, 0, 0, 0]) == 0

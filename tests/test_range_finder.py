"""Principal directions by the range finder, against the whole covariance, at narrow and wide vectors."""

from __future__ import annotations

import numpy as np
import pytest

from regatta.operators import projection


def table(spark, x):
    rows = [(i, row.tolist()) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "entity long, vector array<double>").repartition(5).cache()


def exact(x, k=3):
    _, size, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return vt[:k], size[:k] ** 2 / max(1, len(x) - 1)


def worst_angle(a, b):
    return np.linalg.svd(a @ b.T)[1].min()


@pytest.mark.parametrize("width", [2, 64, 4096])
def test_spans_the_leading_directions(spark, width):
    """Variances that fall off slowly, so that a few plain power steps would not do."""
    rng = np.random.default_rng(width)
    spread = 1 / np.sqrt(1 + 0.2 * np.arange(min(width, 300)))
    x = rng.standard_normal((300, len(spread))) * spread @ np.linalg.qr(
        rng.standard_normal((width, len(spread))))[0].T + 7.0
    found = projection.components(table(spark, x))
    want, variances = exact(x)
    assert found.settled
    assert found.mean == pytest.approx(x.mean(0))
    assert found.variances == pytest.approx(variances, rel=1e-6)
    assert worst_angle(found.basis, want[: len(found.basis)]) > 1 - 1e-6
    assert np.abs(found.basis @ found.basis.T - np.eye(len(found.basis))).max() < 1e-9


def test_range_begins_anew(spark, monkeypatch):
    monkeypatch.setattr(projection, "BLOCK", 6)
    monkeypatch.setattr(projection, "WIDEST", 2)
    x = np.random.default_rng(3).standard_normal((200, 40)) * np.linspace(2, 1, 40)
    found = projection.components(table(spark, x))
    want, variances = exact(x)
    assert found.settled and found.variances == pytest.approx(variances, rel=1e-6)
    assert worst_angle(found.basis, want) > 1 - 1e-6


def test_says_when_it_did_not_settle(spark, monkeypatch):
    monkeypatch.setattr(projection, "BLOCK", 4)
    monkeypatch.setattr(projection, "PASSES", 2)
    x = np.random.default_rng(4).standard_normal((200, 60))
    assert not projection.components(table(spark, x)).settled


def test_equal_rows_null_vectors_and_no_rows(spark):
    same = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None)], "entity long, vector array<double>")
    found = projection.components(same)
    assert found.mean.tolist() == [1.0, 2.0] and found.variances == pytest.approx([0, 0])
    assert np.abs(found.basis @ found.basis.T - np.eye(2)).max() < 1e-9
    none = projection.components(same.limit(0))
    assert none.basis.shape == (0, 0) and none.settled
    shares = projection.explained_variance(same).collect()
    assert [(r.component, r.share) for r in shares] == [(0, 0.0), (1, 0.0)]

"""Training by summed gradients: the path does not depend on shards, and follows a plain form."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from regatta.operators import gradient, scoring
from regatta.operators.aggregate import sum_arrays

SHAPE = (3, 4, 2)


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(5)
    # Entity 0 owns two thirds of the rows.
    rows = [
        (0 if i % 3 else i % 4, i, [i % 2 * 2.0 - 1 + rng.normal(0, 0.3), *rng.normal(0, 0.3, 2).tolist()], i % 2)
        for i in range(480)
    ]
    return spark.createDataFrame(rows, "entity long, sample_id long, features array<double>, label int").cache()


@pytest.fixture(scope="module")
def starts(spark, samples):
    flat = np.random.default_rng(2).normal(0, 0.5, scoring.model_size(*SHAPE)).tolist()
    return samples.select("entity").distinct().withColumn("vector", F.array(*map(F.lit, flat)))


def vectors(df):
    return {r.entity: (np.array(r.vector), r.n, r.loss) for r in df.collect()}


def test_same_model_for_any_number_of_shards(samples, starts):
    one = vectors(gradient.train_by_gradients(samples, starts, SHAPE, 0.5, 2, 2, shard_rows=1000))
    many = vectors(gradient.train_by_gradients(
        samples.repartition(7), starts, SHAPE, 0.5, 2, 2, shard_rows=45))
    assert one.keys() == many.keys() and len(one) == 4
    for entity, (vector, n, loss) in one.items():
        assert many[entity][0] == pytest.approx(vector, abs=1e-12)
        assert many[entity][1] == n and many[entity][2] == pytest.approx(loss, abs=1e-12)


def test_follows_numeric_gradient(samples, starts):
    """A full-batch step against central differences of the mean loss."""
    start = np.array(starts.first()["vector"])
    moved = vectors(gradient.train_by_gradients(samples, starts, SHAPE, 1.0, 1, 1))
    rows = samples.filter("entity = 2").toPandas()
    x, y = np.stack(rows["features"]), rows["label"].to_numpy()

    def loss(flat):
        _, p = scoring.Net(flat, *SHAPE).forward(x)
        return -np.log(p[np.arange(len(y)), y]).mean()

    slope = np.array([
        (loss(start + step) - loss(start - step)) / 2e-6 for step in np.eye(len(start)) * 1e-6
    ])
    assert moved[2][0] == pytest.approx(start - slope, abs=1e-6)
    assert moved[2][2] == pytest.approx(loss(start))


def test_learns_and_pulls_to_the_start(samples, starts):
    free = vectors(gradient.train_by_gradients(samples, starts, SHAPE, 1.0, 8, 2))
    held = vectors(gradient.train_by_gradients(samples, starts, SHAPE, 1.0, 8, 2, mu=0.5))
    start = np.array(starts.first()["vector"])
    for entity in free:
        assert free[entity][2] < 0.35
        assert np.linalg.norm(held[entity][0] - start) < np.linalg.norm(free[entity][0] - start)


def test_models_longer_than_a_slice(samples, starts, monkeypatch):
    whole = vectors(gradient.train_by_gradients(samples, starts, SHAPE, 0.5, 1, 2))
    monkeypatch.setattr(gradient, "SLICE", 5)
    cut = vectors(gradient.train_by_gradients(samples, starts, SHAPE, 0.5, 1, 2))
    for entity in whole:
        assert cut[entity][0] == pytest.approx(whole[entity][0], abs=1e-12)


def test_effort_per_entity_and_entities_without_rows(spark, samples, starts):
    some = starts.withColumn("epochs", F.when(F.col("entity") == 0, 2).otherwise(1))
    extra = some.limit(1).withColumn("entity", F.lit(99).cast("long"))
    got = vectors(gradient.train_by_gradients(samples, some.unionByName(extra), SHAPE, 0.5, batches=2))
    one = vectors(gradient.train_by_gradients(samples, starts, SHAPE, 0.5, 1, 2))
    two = vectors(gradient.train_by_gradients(samples, starts, SHAPE, 0.5, 2, 2))
    assert got.keys() == one.keys()
    for entity in got:
        want = two if entity == 0 else one
        assert got[entity][0] == pytest.approx(want[entity][0], abs=1e-12)
        assert got[entity][2] == pytest.approx(want[entity][2], abs=1e-12)


def test_no_rows(samples, starts):
    assert gradient.train_by_gradients(samples.limit(0), starts, SHAPE).count() == 0


def test_sums_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr("regatta.operators.aggregate.BRANCH", 3)
    parts = spark.range(100).select(
        (F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).cast("int").alias("m"),
        F.array(F.col("id").cast("double"), F.lit(1.0)).alias("part"))
    got = {r.k: r.part for r in sum_arrays(parts, ["k"], "m", 50).collect()}
    assert got == {0: [sum(range(0, 100, 2)), 50.0], 1: [sum(range(1, 100, 2)), 50.0]}

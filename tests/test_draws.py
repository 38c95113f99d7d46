from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from regatta.functions.hashing import distinct_draws
from regatta.operators import sampling


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 97, 1000])
def test_every_key_permutes_the_whole_range(spark, size):
    keys = spark.range(6).select("id", distinct_draws(F.lit(size), F.lit(size), F.col("id"), 5).alias("d"))
    rows = [r["d"] for r in keys.collect()]
    assert all(sorted(d) == list(range(size)) for d in rows)
    assert size < 64 or len({tuple(d) for d in rows}) == 6


def test_first_draws_are_even(spark):
    rows = spark.range(20_000).select(
        F.explode(distinct_draws(F.lit(50), F.lit(2), F.col("id"), "x")).alias("place")
    ).groupBy("place").count().collect()
    counts = np.array([r["count"] for r in rows])
    expected = 20_000 * 2 / 50
    # Chi-squared of 49 degrees of freedom: 99.99 % lie below 98.
    assert len(rows) == 50 and ((counts - expected) ** 2 / expected).sum() < 98


def test_entities_overlap_as_independent_samples_do(spark):
    samples = spark.range(400).select(F.col("id").alias("sample_id"), (F.col("id") % 4).alias("label"))
    wants = spark.range(60).select(F.col("id").alias("entity"), F.lit(100).alias("n"))
    got = sampling.iid_sample(wants, samples, 3).cache()
    assert got.distinct().count() == 6000
    shared = got.alias("a").join(got.alias("b"), "sample_id").where("a.entity < b.entity").count()
    pairs = 60 * 59 / 2
    mean, variance = 100 * 100 / 400, 100 * 0.25 * 0.75 * 300 / 399
    assert abs(shared / pairs - mean) < 5 * (variance / pairs) ** 0.5
    again = sampling.iid_sample(wants.repartition(7), samples.repartition(5), 3)
    assert got.exceptAll(again).count() == 0
    one = sampling.iid_sample(wants, samples, 3, shared=True).groupBy("entity").agg(
        F.array_sort(F.collect_list("sample_id")).alias("s")
    )
    assert one.select("s").distinct().count() == 1


def test_no_more_than_there_are(spark):
    samples = spark.range(5).select(F.col("id").alias("sample_id"), F.lit(0).alias("label"))
    wants = spark.createDataFrame([(1, 0, 9), (2, 0, 0), (3, 8, 4)], "entity long, label int, n int")
    got = {r["entity"]: r["count"] for r in sampling.iid_sample(wants, samples, 1).groupBy("entity").count().collect()}
    assert got == {1: 5, 3: 4}
    assert sampling.iid_sample(wants, samples.limit(0), 1).count() == 0
    parts = sampling.skewed_sample(wants, samples, 1).groupBy("entity", "part").count().collect()
    assert {(r["entity"], r["part"]): r["count"] for r in parts} == {(1, "primary"): 5, (1, "any"): 4, (3, "any"): 4}


def test_the_grid_is_sought_once_a_row(spark):
    column = distinct_draws(F.lit(100_000), F.lit(30), F.lit("a"), 1)
    plan = spark.range(1).select(column.alias("d"))
    assert str(column).count("array_min") == 1
    assert len(set(plan.first()["d"])) == 30

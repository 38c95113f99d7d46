from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from regatta.operators import aggregate as agg


def medians(frame):
    return {(r["g"], r["idx"]): r["val"] for r in frame.collect()}


def rows_of(spark, groups):
    rows = [(g, i, float(v)) for (g, i), values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g int, idx int, val double").repartition(6)


@pytest.mark.parametrize("fits", [3, 40, 1 << 16])
def test_refined_medians_are_exact(spark, fits):
    rng = np.random.default_rng(3)
    groups = {
        (0, 0): rng.normal(size=3001), (0, 1): rng.normal(size=3000), (1, 0): rng.integers(0, 4, 2000),
        (1, 1): np.repeat([1.0, 9.0], 700), (2, 0): [5.0] * 900, (2, 1): [7.5], (3, 0): [1.0, 2.0],
        (3, 1): np.concatenate([rng.normal(size=1500), [1e300, -1e300]]), (4, 0): np.arange(100),
        (4, 1): np.concatenate([np.full(600, 2.0), rng.uniform(0, 2, 599)]),
        (5, 0): np.exp(rng.normal(size=1777) * 40),
    }
    got = medians(agg.long_median(rows_of(spark, groups), ["g"], fits))
    assert got == {k: pytest.approx(float(np.median(v)), abs=0, rel=1e-15) for k, v in groups.items()}


def test_nulls_do_not_count_and_no_rows_give_none(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 0, None), (1, 0, 4.0), (2, 0, None)], "g int, idx int, val double")
    assert medians(agg.long_median(df, ["g"])) == {(1, 0): 3.0}
    assert agg.long_median(df.limit(0), ["g"]).count() == 0


def test_a_hot_group_of_ten_million_values(spark):
    long = spark.range(10_000_000, numPartitions=16).select(
        F.lit(1).alias("g"), F.lit(0).alias("idx"), (F.col("id") * 7919 % 10_000_019).cast("double").alias("val")
    )
    rest = spark.createDataFrame([(2, 0, 1.0), (2, 0, 2.0)], "g int, idx int, val double")
    got = medians(agg.long_median(long.unionByName(rest), ["g"], 4096))
    values = np.partition((np.arange(10_000_000) * 7919) % 10_000_019, [4_999_999, 5_000_000])
    assert got == {(1, 0): (values[4_999_999] + values[5_000_000]) / 2, (2, 0): 1.5}

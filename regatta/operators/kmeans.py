"""K-means under any metric: numpy partial sums per Arrow batch, centres on the driver.

An iteration is one scan. Each batch returns at most k partial sums, so nothing but k x d numbers
per task is shuffled whatever the size of a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from regatta.functions.hashing import hash_uniform
from regatta.operators.common import LOOKUP_LIMIT


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float)


def distances_to(x: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        def scaled(m: np.ndarray) -> np.ndarray:
            length = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, length, out=np.zeros_like(m), where=length > 0)
        return 1.0 - scaled(x) @ scaled(centres).T
    out = np.empty((len(x), len(centres)))
    for j, c in enumerate(centres):
        gap = x - c
        out[:, j] = np.abs(gap).sum(1) if metric == "l1" else np.sqrt((gap * gap).sum(1))
    return out


def _points(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("entity"), F.col("vector").cast("array<double>").alias("vector")
    )


def nearest_centre(df: DataFrame, centres: np.ndarray, metric: str) -> DataFrame:
    """``(entity, cluster, distance)``; the lowest index wins ties."""
    entity_type = df.schema["entity"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            d = distances_to(_matrix(pdf["vector"]), centres, metric)
            best = d.argmin(1)
            yield pd.DataFrame({
                "entity": pdf["entity"], "cluster": best.astype("int32"),
                "distance": d[np.arange(len(d)), best],
            })

    schema = f"entity {entity_type}, cluster int, distance double"
    return _points(df).mapInPandas(assign, schema)


def lloyd_sums(df: DataFrame, centres: np.ndarray, metric: str) -> DataFrame:
    """``(cluster, idx, val, n)``: sums of the vectors nearest to each centre."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = _matrix(pdf["vector"])
            best = distances_to(x, centres, metric).argmin(1)
            seen = np.unique(best)
            yield pd.DataFrame({
                "cluster": seen.astype("int32"),
                "n": [int((best == c).sum()) for c in seen],
                "s": [x[best == c].sum(0) for c in seen],
            })

    parts = _points(df).select("vector").mapInPandas(partial, "cluster int, n long, s array<double>")
    return (
        parts.select("cluster", "n", F.posexplode("s").alias("idx", "val"))
        .groupBy("cluster", "idx")
        .agg(F.sum("val").alias("val"), F.sum("n").alias("n"))
    )


def lloyd_step(df: DataFrame, centres: np.ndarray, metric: str) -> DataFrame:
    """``(cluster, idx, val)``: new centres as the mean of their members, whatever the metric."""
    return lloyd_sums(df, centres, metric).select(
        "cluster", "idx", (F.col("val") / F.col("n")).alias("val")
    )


def spread_seeds(df: DataFrame, k: int, metric: str, seed: int | str = 0) -> np.ndarray:
    """k-means++ centres: one aggregate per centre, by exponential keys ``-ln(u) / d^2``.

    The smallest key is a draw with probability proportional to ``d^2``, so no running sum over
    the whole table is needed. At most ``k`` vectors reach the driver.
    """
    points = _points(df)
    u = hash_uniform(F.col("entity"), f"{seed}:0")
    first = points.select("vector", u.alias("key"), "entity").agg(
        F.min_by("vector", F.struct("key", "entity")).alias("v")
    ).first()["v"]
    centres = [np.array(first, float)]
    for c in range(1, k):
        near = nearest_centre(points, np.stack(centres), metric)
        u = F.greatest(hash_uniform(F.col("entity"), f"{seed}:{c}"), F.lit(1e-12))
        weight = F.col("distance") * F.col("distance")
        key = F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))
        chosen = near.select("entity", key.alias("key")).agg(
            F.min_by("entity", F.struct("key", "entity")).alias("e")
        ).first()["e"]
        vector = points.filter(F.col("entity") == F.lit(chosen)).select("vector").first()["vector"]
        centres.append(np.array(vector, float))
    return np.stack(centres)


def _collect_centres(sums: DataFrame, previous: np.ndarray) -> tuple[np.ndarray, list[int]]:
    rows = sums.toPandas()
    centres = previous.copy()
    filled = set()
    for cluster, part in rows.groupby("cluster"):
        centres[int(cluster), part["idx"].to_numpy()] = part["val"].to_numpy()
        filled.add(int(cluster))
    return centres, [c for c in range(len(previous)) if c not in filled]


def fit_centres(
    df: DataFrame, k: int, metric: str = "cosine", max_iterations: int = 100, seed: int | str = 0,
    inertias: list[float] | None = None,
) -> np.ndarray:
    """Lloyd's iteration until the centres, and so the labels, repeat.

    An empty cluster takes a random vector. ``k`` is clamped to ``[1, n]``.
    """
    if k > LOOKUP_LIMIT:
        raise ValueError(f"k above {LOOKUP_LIMIT} does not fit the driver")
    n = df.limit(max(k, 1)).count()
    k = max(1, min(k, n)) if n else 0
    if k == 0:
        return np.empty((0, 0))
    # Read many times; kept in memory or on local disk, recomputed from its source if lost.
    points = _points(df).persist(StorageLevel.MEMORY_AND_DISK)
    centres = spread_seeds(points, k, metric, seed)
    for turn in range(max_iterations):
        if inertias is not None:
            inertias.append(inertia_of(points, centres, metric))
        moved, empty = _collect_centres(lloyd_step(points, centres, metric), centres)
        for c in empty:
            pick = hash_uniform(F.col("entity"), f"{seed}:empty:{turn}:{c}")
            row = points.select("vector", pick.alias("key"), "entity").agg(
                F.min_by("vector", F.struct("key", "entity")).alias("v")
            ).first()
            moved[c] = np.array(row["v"], float)
        if np.allclose(moved, centres, rtol=1e-12, atol=1e-12):
            break
        centres = moved
    points.unpersist()
    return centres


def kmeans(
    df: DataFrame, k: int, metric: str = "cosine", max_iterations: int = 100, seed: int | str = 0
) -> DataFrame:
    """``(entity, cluster)``."""
    centres = fit_centres(df, k, metric, max_iterations, seed)
    if centres.size == 0:
        return df.select("entity", F.lit(0).alias("cluster"))
    return nearest_centre(df, centres, metric).select("entity", "cluster")


def inertia_of(df: DataFrame, centres: np.ndarray, metric: str) -> float:
    d = nearest_centre(df, centres, metric)
    return d.agg(F.sum(F.col("distance") * F.col("distance"))).first()[0]


def inertia_to_means(df: DataFrame, centres: np.ndarray, metric: str) -> float:
    """Sum of squared distances of every vector to the mean of its own cluster."""
    means, _ = _collect_centres(lloyd_step(df, centres, metric), centres)
    fixed = means

    def squared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = _matrix(pdf["vector"])
            own = distances_to(x, centres, metric).argmin(1)
            d = distances_to(x, fixed, metric)[np.arange(len(x)), own]
            yield pd.DataFrame({"s": [float((d * d).sum())]})

    return _points(df).select("vector").mapInPandas(squared, "s double").agg(F.sum("s")).first()[0]


def inertia_table(df: DataFrame, metric: str = "cosine", max_k: int = 5, seed: int = 0) -> DataFrame:
    """``(k, inertia)`` for ``k = 1 .. max_k``: a table of ``max_k`` driver scalars."""
    rows = []
    for k in range(1, max_k + 1):
        centres = fit_centres(df, k, metric, 50, seed)
        rows.append((k, float(inertia_to_means(df, centres, metric))))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def elbow(inertias: DataFrame, n: int | None = None) -> DataFrame:
    """``k`` whose marginal gain drops most; up to two values give ``min(2, n)``.

    The table holds one row per candidate k, so its window is as long as the list of candidates.
    """
    order = W.orderBy("k")
    gap = (
        F.lag("inertia").over(order) - 2 * F.col("inertia") + F.lead("inertia").over(order)
    )
    best = inertias.select("k", gap.alias("gap")).agg(
        F.max(F.when(F.col("gap") > 0, F.struct("gap", (-F.col("k")).alias("neg")))).alias("b"),
        F.count(F.lit(1)).alias("rows"),
    )
    few = F.lit(2 if n is None else min(2, n))
    return best.select(
        F.when(F.col("rows") <= 2, few).otherwise(F.coalesce(-F.col("b.neg"), F.lit(2)))
        .cast("int").alias("k")
    )


def choose_k(df: DataFrame, metric: str = "cosine", max_k: int = 5, seed: int = 0) -> int:
    n = df.limit(max_k + 1).count()
    if n <= 1:
        return 1
    if n <= max_k:
        max_k = n - 1
    return elbow(inertia_table(df, metric, max_k, seed), n).first()["k"]


__all__ = [
    "choose_k", "distances_to", "elbow", "fit_centres", "inertia_of", "inertia_table", "kmeans",
    "lloyd_step", "lloyd_sums", "nearest_centre", "spread_seeds",
]

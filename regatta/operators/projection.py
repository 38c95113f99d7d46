"""Low-dimensional positions of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.functions.arrays import array_sum
from regatta.functions.hashing import hash_uniform
from regatta.operators.aggregate import sum_arrays

# Fixed value: half width of the box positions are scaled into.
BOX = 5.0
# Columns of a block of the range finder, blocks its range may hold, and scans at most.
BLOCK = 32
WIDEST = 4
PASSES = 60
# Residual of a settled direction, as a share of the largest variance.
TOLERANCE = 1e-7
# Elements of a sum that travel in one row.
SLICE = 16384


def with_kind(*keys: str, **tables: DataFrame) -> DataFrame:
    """Bag union of ``(keys..., entity, vector)`` tables with a ``kind`` tag."""
    parts = [
        df.select(*keys, F.lit(kind).alias("kind"), F.col("entity").cast("string").alias("entity"), "vector")
        for kind, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class Components(NamedTuple):
    """Mean, orthonormal directions (rows), the variance along each, and whether they settled."""

    mean: np.ndarray
    basis: np.ndarray
    variances: np.ndarray
    settled: bool


def _scan_sums(
    rows: DataFrame, width: int, columns: int, members: int, part: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """``sum(part(block))`` over blocks of rows, ``width x columns``: summed per task, then in a tree."""
    whole = max(1, SLICE // columns) * columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width * columns)
        for pdf in batches:
            if not pdf.empty:
                total += part(np.stack(pdf["v"].to_numpy()).astype(float)).ravel()
        at = range(0, len(total), whole)
        yield pd.DataFrame({
            "at": [*at], "task": TaskContext.get().partitionId(), "part": [total[i:i + whole] for i in at],
        })

    slices = rows.mapInPandas(run, "at int, task int, part array<double>")
    found = sum_arrays(slices, ["at"], "task", members).toPandas().sort_values("at")
    return np.concatenate(found["part"].to_list()).reshape(width, columns)


def components(
    df: DataFrame, k: int = 3, vector: str = "vector", seed: int = 0, tolerance: float = TOLERANCE
) -> Components:
    """The ``k`` leading principal directions by a randomised range finder, the same for every width.

    A random block of ``BLOCK`` columns goes through the centred rows in one scan; from then on a scan
    multiplies the residuals of the leading Ritz vectors, so the range grows where it is not settled.
    It ends when every wanted residual is within ``tolerance`` of the largest variance, or after ``PASSES``
    scans with ``settled`` false. Once the range is ``WIDEST`` blocks it begins anew from its best block.
    The driver holds two tables of ``width x (BLOCK * WIDEST)`` numbers, none that grows with the rows; a
    task holds one of ``width x BLOCK``. Null vectors are left out; of no rows all is zero.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    facts = rows.select(F.size("v").alias("width"), F.spark_partition_id().alias("task")).agg(
        F.max("width").alias("width"), F.count("width").alias("n"), F.max("task").alias("last")
    ).first()
    width, n, members = facts["width"] or 0, facts["n"], (facts["last"] or 0) + 1
    k = min(k, width)
    if not k:
        return Components(np.zeros(width), np.zeros((0, width)), np.zeros(0), True)
    mean = _scan_sums(rows, width, 1, members, lambda x: x.sum(0)[:, None])[:, 0] / n
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(BLOCK, width))))[0]
    held, images = np.zeros((width, 0)), np.zeros((width, 0))
    settled = False
    for _ in range(PASSES):
        def product(x: np.ndarray, b: np.ndarray = block) -> np.ndarray:
            x = x - mean
            return x.T @ (x @ b)

        image = _scan_sums(rows, width, block.shape[1], members, product) / max(1, n - 1)
        held, images = np.hstack([held, block]), np.hstack([images, image])
        inner = held.T @ images
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        best = min(BLOCK, len(values))
        ritz, moved = held @ turn[:, :best], images @ turn[:, :best]
        rest = moved - ritz * values[:best]
        settled = bool((np.linalg.norm(rest[:, :k], axis=0) <= tolerance * max(values[0], 0.0)).all())
        if settled or held.shape[1] >= width:
            settled = True
            break
        if held.shape[1] >= BLOCK * WIDEST:
            held, images = ritz, moved
        block = _new_directions(rest, held)
        if not block.shape[1]:
            settled = True
            break
    basis = ritz[:, :k].T
    peak = np.abs(basis).argmax(1)
    signs = np.sign(basis[np.arange(k), peak])
    basis = basis * np.where(signs == 0, 1.0, signs)[:, None]
    return Components(mean, basis, np.maximum(values[:k], 0.0), settled)


def _new_directions(block: np.ndarray, held: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to ``held``, at most what fits the width."""
    length = np.linalg.norm(block, axis=0)
    long = length > 1e-13 * max(length.max(), 1e-300)
    block = block[:, long] / length[long]
    for _ in range(2):
        block = block - held @ (held.T @ block)
    left, size, _ = np.linalg.svd(block, full_matrices=False)
    fresh = left[:, size > 1e-10][:, : held.shape[0] - held.shape[1]]
    return np.linalg.qr(fresh - held @ (held.T @ fresh))[0] if fresh.shape[1] else fresh


def principal_components(
    df: DataFrame, k: int = 3, vector: str = "vector"
) -> tuple[np.ndarray, np.ndarray]:
    """Mean and ``k`` orthonormal directions, each with its largest loading positive."""
    found = components(df, k, vector)
    return found.mean, found.basis


def explained_variance(df: DataFrame, k: int = 3, vector: str = "vector") -> DataFrame:
    """``(component, variance, share)``: variance along each direction, and its part of all variance."""
    spark = df.sparkSession
    found = components(df, k, vector)
    rows = [(i, float(v)) for i, v in enumerate(found.variances)]
    mean = F.array(*map(F.lit, found.mean.tolist()))
    away = F.zip_with(F.col(vector).cast("array<double>"), mean, lambda x, m: (x - m) * (x - m))
    n = F.greatest(F.count(vector) - 1, F.lit(1))
    total = df.agg((F.sum(array_sum(away)) / n).alias("total")).scalar()
    return spark.createDataFrame(rows, "component int, variance double").withColumn(
        "share", F.when(total > 0, F.col("variance") / total).otherwise(0.0)
    )


def project(df: DataFrame, mean: np.ndarray, basis: np.ndarray, keys: list[str]) -> DataFrame:
    """``(keys..., x, y, z)``: coordinates along up to three directions (missing ones are 0)."""
    names = ["x", "y", "z"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            at = (np.stack(pdf["vector"].to_numpy()).astype(float) - mean) @ basis.T
            out = pdf[keys].copy()
            for i, name in enumerate(names):
                out[name] = at[:, i] if i < at.shape[1] else 0.0
            yield out

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, "vector").mapInPandas(run, f"{schema}, x double, y double, z double")


def scale_to_box(df: DataFrame, box: float = BOX) -> DataFrame:
    """All coordinates times ``box / max(|c|, 1)``, one factor for the whole table."""
    peak = F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z")))
    factor = df.agg((box / F.greatest(peak, F.lit(1.0)))).scalar()
    return df.withColumns({c: F.col(c) * factor for c in ("x", "y", "z")})


def pca_positions(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., x, y, z)`` in one frame for the whole table, scaled into the box."""
    mean, basis = principal_components(df)
    return scale_to_box(project(df, mean, basis, keys))


def direction_table(spark, dim: int, seed: int | str) -> DataFrame:
    """``(idx, dx, dy, dz)``: three unit directions from hash uniforms."""
    base = spark.range(dim).select(F.col("id").cast("int").alias("idx"))
    for axis in "xyz":
        base = base.withColumn(f"u{axis}", hash_uniform(F.col("idx"), f"{seed}:{axis}") * 2 - 1)
    lengths = base.agg(*[F.sqrt(F.sum(F.col(f"u{a}") * F.col(f"u{a}"))).alias(f"n{a}") for a in "xyz"])
    n = lengths.select(F.struct("nx", "ny", "nz").alias("n")).scalar()
    return base.select("idx", *[
        (F.col(f"u{a}") / F.when(n[f"n{a}"] > 0, n[f"n{a}"]).otherwise(1.0)).alias(f"d{a}") for a in "xyz"
    ])


def random_projection(df: DataFrame, dim: int, seed: int | str, keys: list[str]) -> DataFrame:
    """``(keys..., x, y, z)``: products with three seeded unit directions.

    The directions are as long as a vector and go with the plan as one scalar; no row is exploded or moved.
    A null vector has null positions.
    """
    table = direction_table(df.sparkSession, dim, seed)
    packed = F.array_sort(F.collect_list(F.struct("idx", "dx", "dy", "dz")))
    axes = table.agg(packed.alias("all")).select(
        F.struct(*[F.col("all")[f"d{a}"].alias(a) for a in "xyz"]).alias("axes")
    ).scalar()
    return df.select(*keys, F.col("vector").cast("array<double>").alias("_v"), axes.alias("_axes")).select(
        *keys, *[
            array_sum(F.zip_with("_v", F.col("_axes")[a], lambda x, d: x * d)).alias(a) for a in "xyz"
        ]
    )


def positions_by_round(df: DataFrame) -> DataFrame:
    """Positions laid out round by round, in kind and entity order inside a round.

    Rows stay flat: a round's list is as long as its fleet, so it is a run of rows, not one value.
    """
    return df.repartitionByRange("round", "kind", "entity").sortWithinPartitions(
        "round", "kind", "entity"
    )


__all__ = [
    "components", "direction_table", "explained_variance", "pca_positions", "positions_by_round", "principal_components", "project",
    "random_projection", "scale_to_box", "with_kind",
]

"""Nearest and probability-weighted assignment of entities to group vectors; mixing rules."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.functions.arrays import array_sum, distance, midpoint
from regatta.functions.hashing import hash_uniform
from regatta.operators.common import LOOKUP_LIMIT, lookup, spread_join
from regatta.operators.kmeans import distances_to

# Distances under EPSILON count as zero, probabilistic assignment runs for the first
# PROBABILISTIC_ROUNDS rounds, and a norm has risen when it is RISE times the one before.
EPSILON = 1e-6
PROBABILISTIC_ROUNDS = 5
RISE = 1.2
# Centres and entities of one task where the centres are too many, or too wide, for a scalar.
BLOCK_CENTRES, BLOCK_ENTITIES = 1024, 8192
# Bytes of centre vectors that may travel as a scalar.
LOOKUP_BYTES = 64 << 20
# Distances this close are measured once more before one wins.
TIE = 1e-9


def member_rows(df: DataFrame, partition: DataFrame) -> DataFrame:
    """Rows of the entities that have a cluster; the others drop out."""
    return spread_join(df, partition, ["entity"], [c for c in df.columns if c != "entity"])


def cluster_vector_or_global(
    entities: DataFrame, cluster_vectors: DataFrame, global_vector: DataFrame
) -> DataFrame:
    """``(entity, cluster, vector)``: the vector of the entity's cluster, else the global one."""
    fallback = global_vector.select("vector").scalar()
    found = spread_join(
        entities.select("entity", "cluster"), cluster_vectors.select("cluster", F.col("vector").alias("_v")),
        ["cluster"], ["entity"], "left",
    )
    return found.select("entity", "cluster", F.coalesce("_v", fallback).alias("vector"))


def _distances(entities: DataFrame, centres: DataFrame, metric: str) -> DataFrame:
    """``(entity, dists array<struct<cluster, d>>)`` in cluster order, without a join."""
    table = lookup(centres, "cluster", "vector", what="centres")
    return entities.withColumn("_table", table).select(
        "entity",
        F.transform("_table", lambda c: F.struct(
            c["cluster"].alias("cluster"), distance(metric, F.col("vector"), c["vector"]).alias("d")
        )).alias("dists"),
    )


def _row_distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of ``x`` to the same row of ``y``."""
    if metric == "l1":
        return np.abs(x - y).sum(1)
    if metric == "l2":
        return np.sqrt(((x - y) ** 2).sum(1))
    scale = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
    return 1.0 - np.divide((x * y).sum(1), scale, out=np.zeros(len(x)), where=scale > 0)


def _fits_lookup(centres: DataFrame) -> bool:
    """Whether the centres are few and narrow enough to be one scalar."""
    size = centres.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vector")).alias("values")).first()
    return size["n"] <= LOOKUP_LIMIT and 8 * (size["values"] or 0) <= LOOKUP_BYTES


def _block_products(entities: DataFrame, centres: DataFrame, metric: str, best: bool) -> DataFrame:
    """``(entity, cluster, d)`` from blocks of entities against blocks of centres.

    With ``best`` a task returns one row per entity, so the rows that follow are entities times
    blocks and not entities times centres.
    """
    blocks = max(1, -(-centres.count() // BLOCK_CENTRES))
    shards = max(1, -(-entities.count() // BLOCK_ENTITIES))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    vector = F.col("vector").cast("array<double>").alias("vector")
    left = entities.select(
        "entity", vector, F.pmod(F.xxhash64("entity"), F.lit(shards)).cast("int").alias("_s"),
        numbers(blocks).alias("_b"),
    )
    right = centres.select(
        "cluster", vector, F.pmod(F.xxhash64("cluster"), F.lit(blocks)).cast("int").alias("_b"),
        numbers(shards).alias("_s"),
    )

    def work(x: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if x.empty or c.empty:
            return pd.DataFrame({"entity": x["entity"][:0], "cluster": c["cluster"][:0], "d": []})
        c = c.sort_values("cluster")
        d = distances_to(np.stack(x["vector"].to_numpy()), np.stack(c["vector"].to_numpy()), metric)
        if best:
            # Products of matrices round by their shape: what lies close to the best is measured anew,
            # row by row, so that equal centres tie whatever the block.
            i, j = np.nonzero(d <= d.min(1, keepdims=True) + TIE)
            fine = _row_distances(np.stack(x["vector"].to_numpy()[i]), np.stack(c["vector"].to_numpy()[j]), metric)
            order = np.lexsort((j, fine, i))
            order = order[np.unique(i[order], return_index=True)[1]]
            i, j, d = i[order], j[order], fine[order]
        else:
            i, j = (at.ravel() for at in np.indices(d.shape))
            d = d.ravel()
        return pd.DataFrame({"entity": x["entity"].to_numpy()[i], "cluster": c["cluster"].to_numpy()[j], "d": d})

    kinds = {**dict(entities.dtypes), **dict(centres.dtypes)}
    schema = f"entity {kinds['entity']}, cluster {kinds['cluster']}, d double"
    return left.groupBy("_s", "_b").cogroup(right.groupBy("_s", "_b")).applyInPandas(work, schema)


def centre_distances(entities: DataFrame, centres: DataFrame, metric: str = "cosine") -> DataFrame:
    """``(entity, cluster, d)``: every entity against every centre."""
    if not _fits_lookup(centres):
        return _block_products(entities, centres, metric, best=False)
    return _distances(entities, centres, metric).select(
        "entity", F.explode("dists").alias("_e")
    ).select("entity", F.col("_e.cluster").alias("cluster"), F.col("_e.d").alias("d"))


def nearest(entities: DataFrame, centres: DataFrame, metric: str = "cosine") -> DataFrame:
    """``(entity, cluster, d)`` of the nearest centre; the lowest cluster wins ties.

    Entities are unique.
    """
    if not _fits_lookup(centres):
        found = _block_products(entities, centres, metric, best=True).groupBy("entity").agg(
            F.min(F.struct("d", "cluster")).alias("_n")
        )
        return found.select("entity", F.col("_n.cluster").alias("cluster"), F.col("_n.d").alias("d"))
    best = F.array_min(F.transform("dists", lambda e: F.struct(e["d"].alias("d"), e["cluster"].alias("cluster"))))
    return _distances(entities, centres, metric).select("entity", best.alias("_b")).select(
        "entity", F.col("_b.cluster").alias("cluster"), F.col("_b.d").alias("d")
    )


def probabilities(dists: Column) -> Column:
    """Choice probabilities over an array of distances.

    Distances under ``EPSILON`` share everything; otherwise ``max(0, 1 - d / sum)`` normalised,
    and uniform when nothing is left.
    """
    n = F.size(dists)
    zeros = F.size(F.filter(dists, lambda d: d < EPSILON))
    total = array_sum(dists)
    raw = F.transform(
        dists, lambda d: F.when(total == 0, 1.0 / n).otherwise(F.greatest(F.lit(0.0), 1 - d / total))
    )
    kept = array_sum(raw)
    spread = F.when(kept > 0, F.transform(raw, lambda p: p / kept)).otherwise(
        F.transform(dists, lambda d: 1.0 / n)
    )
    shared = F.transform(dists, lambda d: F.when(d < EPSILON, 1.0 / zeros).otherwise(0.0))
    return F.when(zeros > 0, shared).otherwise(spread)


def assignment_probabilities(
    entities: DataFrame, centres: DataFrame, metric: str = "cosine"
) -> DataFrame:
    """``(entity, cluster, p)``."""
    rows = _with_probabilities(entities, centres, metric)
    return rows.select("entity", F.explode(F.arrays_zip("clusters", "probs")).alias("_e")).select(
        "entity", F.col("_e.clusters").alias("cluster"), F.col("_e.probs").alias("p")
    )


def _with_probabilities(entities: DataFrame, centres: DataFrame, metric: str) -> DataFrame:
    rows = _distances(entities, centres, metric)
    d = F.transform("dists", lambda e: e["d"])
    return rows.select(
        "entity",
        F.transform("dists", lambda e: e["cluster"]).alias("clusters"),
        probabilities(d).alias("probs"),
    )


def draw_index(probs: Column, u: Column) -> Column:
    """0-based place where the running sum first reaches ``u``; 0 when it never does."""
    running = F.transform(
        F.sequence(F.lit(1), F.size(probs)), lambda i: array_sum(F.slice(probs, 1, i))
    )
    place = F.array_position(F.transform(running, lambda s: u <= s), F.lit(True))
    return F.when(place > 0, (place - 1).cast("int")).otherwise(F.lit(0))


def draw_cluster(long: DataFrame, seed: int | str) -> DataFrame:
    """``(entity, cluster)`` drawn from ``(entity, cluster, p)``; a group is one row per cluster."""
    packed = F.array_sort(F.collect_list(F.struct("cluster", "p")))
    rows = long.groupBy("entity").agg(packed.alias("_c"))
    place = draw_index(
        F.transform("_c", lambda e: e["p"]), hash_uniform(F.col("entity"), seed)
    )
    return rows.select("entity", F.element_at("_c", place + 1)["cluster"].alias("cluster"))


def assign_nearest(entities: DataFrame, centres: DataFrame, metric: str, seed, round_no: int):
    return nearest(entities, centres, metric).select("entity", "cluster")


def assign_probabilistic(entities: DataFrame, centres: DataFrame, metric: str, seed, round_no: int):
    """A weighted draw in the first rounds, nearest afterwards."""
    if round_no > PROBABILISTIC_ROUNDS:
        return assign_nearest(entities, centres, metric, seed, round_no)
    rows = _with_probabilities(entities, centres, metric)
    place = draw_index(F.col("probs"), hash_uniform(F.col("entity"), seed))
    return rows.select("entity", F.element_at("clusters", place + 1).alias("cluster"))


ASSIGNMENTS: dict[str, Callable[..., DataFrame]] = {
    "1NN": assign_nearest,
    "probabilistic": assign_probabilistic,
}


def register_assignment(name: str, build: Callable[..., DataFrame]) -> None:
    ASSIGNMENTS[name] = build


def assign(
    entities: DataFrame, centres: DataFrame, method: str = "1NN", metric: str = "cosine",
    seed: int | str = 0, round_no: int = 1,
) -> DataFrame:
    if method not in ASSIGNMENTS:
        raise ValueError(f"unknown assignment {method!r}; known: {sorted(ASSIGNMENTS)}")
    return ASSIGNMENTS[method](entities, centres, metric, seed, round_no)


def has_risen(current: Column, previous: Column) -> Column:
    """True when a norm is at least ``RISE`` times the one before; false without both."""
    return F.coalesce(current >= previous * RISE, F.lit(False))


def mix_none(received: Column, previous: Column, overall: Column, rising: Column) -> Column:
    return received


def mix_fifty_fifty(received: Column, previous: Column, overall: Column, rising: Column) -> Column:
    return F.coalesce(midpoint(received, previous), received)


def mix_gravity(received: Column, previous: Column, overall: Column, rising: Column) -> Column:
    guarded = previous.isNotNull() & rising & overall.isNotNull()
    return F.when(guarded, overall).otherwise(received)


MIXERS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "none": mix_none,
    "50-50": mix_fifty_fifty,
    "gravity": mix_gravity,
}


def register_mixer(name: str, build: Callable[[Column, Column, Column, Column], Column]) -> None:
    MIXERS[name] = build


def mix(method: str, received: Column, previous: Column, overall: Column, rising: Column) -> Column:
    """Start vector of an entity from the received, its previous and the overall vector."""
    if method not in MIXERS:
        raise ValueError(f"unknown mixing rule {method!r}; known: {sorted(MIXERS)}")
    return MIXERS[method](received, previous, overall, rising)

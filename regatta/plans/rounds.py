"""Repeated fitting by parameter averaging: train, cluster, average, evaluate, again."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.functions.arrays import l2_distance
from regatta.operators.aggregate import to_vectors, vector_aggregate
from regatta.operators.assign import assign, mix
from regatta.operators.common import cut_lineage
from regatta.operators.quality import hit, silhouette, silhouette_average
from regatta.operators.sampling import select_available
from regatta.operators.scoring import (
    EPOCHS,
    LEARNING_RATE,
    score,
    train_per_entity,
    xavier_vector,
)
from regatta.plans.clustering import cluster

HISTORY = (
    "round int, loss double, accuracy double, silhouette double, entities long, clusters long, "
    "aggregation_ms double"
)


STATE = ("entity", "vector", "norm", "cluster", "before")


def fit_rounds(
    samples: DataFrame,
    shape: tuple[int, int, int],
    rounds: int = 5,
    method: str = "louvain",
    metric: str = "cosine",
    k: int | None = None,
    aggregate: str = "fedavg",
    mixing: str = "none",
    assignment: str = "1NN",
    per_round: int | None = None,
    least: int = 1,
    rate: float = LEARNING_RATE,
    epochs: int = EPOCHS,
    seed: int = 0,
    mu: float = 0.0,
    test: DataFrame | None = None,
    max_distance: float | None = None,
    neighbours: int | None = None,
    all_pairs: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """History ``(round, loss, accuracy, ...)`` and the final ``(entity, cluster, vector)``.

    ``samples`` is ``(entity, sample_id, features, label)``. The driver holds one model vector and
    a row of scalars per round; every round's vectors are written out before the next one starts.
    Loss and accuracy are those of the averaged model on ``test`` (on all samples without one). An
    entity that sits a round out keeps its vector, norm, norm before and cluster. Graph methods take
    ``max_distance``, ``neighbours`` or ``all_pairs`` as ``cluster`` does.
    """
    spark = samples.sparkSession
    entities = cut_lineage(samples.select("entity").distinct().withColumn("status", F.lit("idle")))
    start = xavier_vector(spark, *shape, seed).withColumn("all", F.lit(0))
    overall = cut_lineage(to_vectors(start, ["all"]).select("vector"))
    previous: DataFrame | None = None
    centres: DataFrame | None = None
    history = []
    for step in range(rounds):
        chosen = entities
        if per_round is not None:
            chosen = select_available(entities.withColumn("round", F.lit(step)), per_round,
                                      f"{seed}:{step}", ["round"])
        if chosen.limit(least).count() < least:
            continue
        begin = _start_vectors(chosen, previous, centres, overall, mixing, assignment, metric,
                               f"{seed}:{step}", step)
        begin = cut_lineage(begin)
        taking = samples.join(chosen.select("entity"), "entity", "left_semi")
        trained = cut_lineage(
            train_per_entity(taking, begin, shape, rate, epochs, seed + step, mu)
            .withColumn("weight", F.col("n").cast("double"))
        )
        part = cut_lineage(cluster(
            trained, method, metric, k=k, seed=seed + step, max_distance=max_distance,
            neighbours=neighbours, all_pairs=all_pairs,
        ))
        begun = time.monotonic()
        labelled = trained.join(part, "entity")
        centres = cut_lineage(
            to_vectors(vector_aggregate(labelled, ["cluster"], "fedavg"), ["cluster"])
        )
        overall = cut_lineage(to_vectors(
            vector_aggregate(trained.withColumn("all", F.lit(0)), ["all"], aggregate), ["all"]
        ).select("vector"))
        took = (time.monotonic() - begun) * 1000
        norms = trained.join(begin.select("entity", F.col("vector").alias("_s")), "entity").select(
            "entity", l2_distance(F.col("vector"), F.col("_s")).alias("norm")
        )
        old = previous.select("entity", F.col("norm").alias("before")) if previous is not None else None
        state = trained.select("entity", "vector").join(norms, "entity").join(
            part, "entity"
        )
        fresh = (
            state.join(old, "entity", "left") if old is not None
            else state.withColumn("before", F.lit(None).cast("double"))
        ).select(*STATE)
        if previous is not None:
            sat_out = previous.join(fresh.select("entity"), "entity", "left_anti")
            fresh = fresh.unionByName(sat_out.select(*STATE))
        previous = cut_lineage(fresh)
        now = previous.join(trained.select("entity"), "entity", "left_semi")
        held = samples if test is None else test
        history.append((step, *_evaluate(held, overall, now, shape, metric), took))
    final = previous.select("entity", "cluster", "vector") if previous is not None else None
    rows = [(s, l, a, sil, n, c, ms) for s, l, a, sil, n, c, ms in history]
    return spark.createDataFrame(rows, HISTORY), final


def _start_vectors(chosen, previous, centres, overall, mixing, assignment, metric, seed, step):
    one = overall.select("vector").scalar()
    if previous is None:
        return chosen.select("entity", one.alias("vector"))
    known = previous.select("entity", "vector", "norm", "before")
    placed = assign(known, centres, assignment, metric, seed, step + 1)
    received = placed.join(
        centres.select("cluster", F.col("vector").alias("received")), "cluster"
    ).select("entity", "received")
    rows = chosen.select("entity").join(known, "entity", "left").join(received, "entity", "left")
    from regatta.operators.assign import has_risen

    rows = rows.withColumn("overall", one)
    return rows.select(
        "entity",
        mix(mixing, F.coalesce("received", "overall"), F.col("vector"), F.col("overall"),
            has_risen(F.col("norm"), F.col("before"))).alias("vector"),
    )


def _evaluate(held: DataFrame, overall: DataFrame, state: DataFrame, shape, metric: str):
    """Loss and accuracy of the averaged model on held-out rows; quality of the round's clusters."""
    from regatta.functions.arrays import cross_entropy

    scored = score(held, overall.first()["vector"], *shape)
    row = scored.agg(
        F.avg(cross_entropy(F.col("probs"), F.col("label"))).alias("loss"),
        F.avg(hit(F.col("probs"), F.col("label"))).alias("accuracy"),
    ).first()
    sil = silhouette_average(silhouette(state.select("entity", "cluster", "vector"), metric)).first()
    size = state.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("c")).first()
    return row["loss"], row["accuracy"], sil["silhouette"], size["n"], size["c"]

"""Training by summed gradients: one model per entity, the same however its rows are dealt."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.functions.hashing import hash_uniform
from regatta.operators.aggregate import sum_arrays
from regatta.operators.common import cut_lineage
from regatta.operators.scoring import EPOCHS, LEARNING_RATE, SHARD_ROWS, Net, per_shard, sharded

# Mini-batches of an epoch, and the elements of a model or gradient that travel in one row.
BATCHES = 4
SLICE = 4096
# The slice that brings the rows and the loss of a gradient.
TOTALS = -1


def batch_of(sample_id: Column, batches: int, seed: int | str) -> Column:
    """Mini-batch of a sample: its place in ``[0, batches)``, the same in every epoch."""
    return F.floor(hash_uniform(sample_id, f"batch:{seed}") * batches).cast("int")


def train_by_gradients(
    samples: DataFrame,
    starts: DataFrame,
    shape: tuple[int, int, int],
    rate: float = LEARNING_RATE,
    epochs: int = EPOCHS,
    batches: int = BATCHES,
    seed: int | str = 0,
    mu: float = 0.0,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``(entity, vector, n, loss)`` from ``(entity, sample_id, features, label)``.

    Every step moves a model by the mean gradient of one mini-batch of its entity. A shard of the
    entity's rows meets one copy of the model and gives one gradient; gradients are added up in a tree
    (``sum_arrays``). So one row and a billion rows take the same path, no task holds more than a
    shard, and the number of shards changes the result by rounding only. ``mu`` pulls towards the start;
    ``epochs`` may come per entity as a column of ``starts``. ``loss`` is the mean over the last epoch.
    Entities without a row have no model; a batch without rows moves nothing.
    """
    tagged, plan = sharded(samples.select("entity", "sample_id", "features", "label"), shard_rows, str(seed))
    rows = cut_lineage(
        tagged.withColumn("batch", batch_of(F.col("sample_id"), batches, seed))
        .sortWithinPartitions("batch")
    )
    plan = cut_lineage(plan)
    shards = plan.agg(F.max("_shards")).first()[0] or 0
    sizes = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    effort = F.col("epochs") if "epochs" in starts.columns else F.lit(epochs)
    cut = F.sequence(F.lit(0), F.floor((F.size("vector") - 1) / SLICE).cast("int"))
    models = cut_lineage(
        starts.join(plan.select("entity"), "entity", "left_semi")
        .select("entity", effort.cast("int").alias("epochs"), "vector", F.explode(cut).alias("slice"))
        .select("entity", "epochs", "slice",
                F.slice("vector", F.col("slice") * SLICE + 1, SLICE).alias("part"))
        .withColumn("start", F.col("part"))
        .withColumns({"seen": F.lit(0.0), "lost": F.lit(0.0)})
    )
    longest = models.agg(F.max("epochs")).first()[0] or 0
    for epoch in range(longest):
        for batch in range(batches):
            learning = models.where(F.col("epochs") > epoch)
            summed = sum_arrays(
                _gradients(rows.where(F.col("batch") == batch), plan, learning, shape),
                ["entity", "slice"], "shard", shards,
            )
            models = cut_lineage(_moved(models, summed, rate, mu, fresh=batch == 0))
    packed = F.array_sort(F.collect_list(F.struct("slice", "part")))
    return models.groupBy("entity").agg(
        F.flatten(F.transform(packed, lambda s: s["part"])).alias("vector"),
        F.max(F.col("lost") / F.col("seen")).alias("loss"),
    ).join(sizes, "entity").select("entity", "vector", "n", "loss")


def _moved(models: DataFrame, summed: DataFrame, rate: float, mu: float, fresh: bool) -> DataFrame:
    """Models after one step; ``seen`` and ``lost`` begin anew with an epoch an entity takes part in."""
    totals = summed.where(F.col("slice") == TOTALS).select(
        "entity", F.col("part")[0].alias("_n"), F.col("part")[1].alias("_loss")
    )
    parts = summed.where(F.col("slice") != TOTALS).select(
        "entity", "slice", F.col("part").alias("_grad")
    )
    both = models.join(parts, ["entity", "slice"], "left").join(totals, "entity", "left")
    step = F.zip_with("part", "_grad", lambda w, g: w - rate * g / F.col("_n"))
    if mu:
        pull = F.zip_with("part", "start", lambda w, s: rate * mu * (w - s))
        step = F.zip_with(step, pull, lambda w, p: w - p)
    took = F.col("_n").isNotNull()

    def total(name: str, more: str) -> Column:
        before = F.lit(0.0) if fresh else F.col(name)
        return F.when(took, before + F.col(more)).otherwise(F.col(name))

    return both.select(
        "entity", "epochs", "slice", F.when(took, step).otherwise(F.col("part")).alias("part"), "start",
        total("seen", "_n").alias("seen"), total("lost", "_loss").alias("lost"),
    )


def _gradients(
    rows: DataFrame, plan: DataFrame, models: DataFrame, shape: tuple[int, int, int]
) -> DataFrame:
    """``(entity, slice, shard, part)``: the summed gradient of every shard's rows, in slices."""
    copies = per_shard(plan, models.select("entity", "slice", "part"))
    columns = ("entity", "slice", "shard", "part")

    def run(key, data: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if data.empty or model.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
        flat = np.concatenate(model.sort_values("slice")["part"].to_list()).astype(float)
        data = data.sort_values("sample_id")
        x = np.stack(data["features"].to_numpy()).astype(float)
        y = data["label"].to_numpy().astype(int)
        grad, loss = gradient(Net(flat, *shape), x, y)
        parts = [grad[i:i + SLICE] for i in range(0, len(grad), SLICE)]
        return pd.DataFrame({
            "entity": [key[0]] * (len(parts) + 1), "slice": [*range(len(parts)), TOTALS], "shard": key[1],
            "part": [*parts, np.array([float(len(x)), loss])],
        })

    entity = rows.schema["entity"].dataType.simpleString()
    return rows.groupBy("entity", "shard").cogroup(copies.groupBy("owner", "piece")).applyInPandas(
        run, f"entity {entity}, slice int, shard int, part array<double>"
    )


def gradient(net: Net, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of the cross-entropy summed over the rows, in the model's own order, and that sum."""
    hidden, p = net.forward(x)
    at = np.arange(len(x))
    loss = -np.log(np.clip(p[at, y], 1e-7, 1 - 1e-7)).sum()
    d_out = p.copy()
    d_out[at, y] -= 1.0
    d_hidden = (d_out @ net.w2.T) * hidden * (1.0 - hidden)
    flat = np.concatenate([
        (x.T @ d_hidden).ravel(), d_hidden.sum(0), (hidden.T @ d_out).ravel(), d_out.sum(0)
    ])
    return flat, float(loss)

"""Scoring and training of small two-layer models over sample tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.functions.arrays import array_sum, sigmoid, softmax
from regatta.functions.hashing import hash_uniform
from regatta.operators.aggregate import to_vectors, vector_aggregate
from regatta.operators.common import spread_join

# Learning rate and epochs of a training run.
LEARNING_RATE = 0.01
EPOCHS = 3
# Samples one training task may hold; a larger entity is cut into shards of equal chance.
SHARD_ROWS = 20000


def model_size(n_in: int, n_hidden: int, n_out: int) -> int:
    return n_in * n_hidden + n_hidden + n_hidden * n_out + n_out


def xavier_vector(spark, n_in: int, n_hidden: int, n_out: int, seed: int | str) -> DataFrame:
    """``(idx, val)``: uniform weights in +-sqrt(2 / (in + out)), zero biases, in W1 b1 W2 b2 order."""
    w1 = n_in * n_hidden
    b1, w2 = w1 + n_hidden, w1 + n_hidden + n_hidden * n_out
    idx = F.col("idx")
    first, second = np.sqrt(2.0 / (n_in + n_hidden)), np.sqrt(2.0 / (n_hidden + n_out))
    scale = (
        F.when(idx < w1, F.lit(float(first)))
        .when(idx < b1, 0.0)
        .when(idx < w2, F.lit(float(second)))
        .otherwise(0.0)
    )
    size = model_size(n_in, n_hidden, n_out)
    return spark.range(size).select(
        F.col("id").cast("int").alias("idx")
    ).withColumn("val", (hash_uniform(idx, seed) * 2 - 1) * scale)


def dense_column(inputs: Column, weights: Column, bias: Column, width: int) -> Column:
    """``inputs x weights + bias`` for a row-major ``array<array<double>>`` of ``width`` columns."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda j: array_sum(
            F.zip_with(inputs, weights, lambda x, row: x * F.element_at(row, j + 1))
        ) + F.element_at(bias, j + 1),
    )


def forward_column(
    features: Column, w1: Column, b1: Column, w2: Column, b2: Column, hidden: int, out: int
) -> Column:
    """Class probabilities as one SQL expression: for small models joined in as columns."""
    inner = F.transform(dense_column(features, w1, b1, hidden), sigmoid)
    return softmax(dense_column(inner, w2, b2, out))


class Net:
    """Numpy view of a flat model vector; a helper for tasks."""

    def __init__(self, flat: np.ndarray, n_in: int, n_hidden: int, n_out: int) -> None:
        a = n_in * n_hidden
        b = a + n_hidden
        c = b + n_hidden * n_out
        self.flat = flat
        self.w1, self.b1 = flat[:a].reshape(n_in, n_hidden), flat[a:b]
        self.w2, self.b2 = flat[b:c].reshape(n_hidden, n_out), flat[c:]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = 1.0 / (1.0 + np.exp(-(x @ self.w1 + self.b1)))
        z = hidden @ self.w2 + self.b2
        e = np.exp(z - z.max(-1, keepdims=True))
        return hidden, e / e.sum(-1, keepdims=True)


def score(
    samples: DataFrame, model: np.ndarray, n_in: int, n_hidden: int, n_out: int
) -> DataFrame:
    """Samples with ``probs`` from one model: a numpy product per Arrow batch."""
    flat = np.asarray(model, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Net(flat, n_in, n_hidden, n_out)
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["features"].to_numpy()).astype(float)
            yield pdf.drop(columns="features").assign(probs=list(net.forward(x)[1]))

    kept = [f for f in samples.schema.fields if f.name != "features"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return samples.mapInPandas(run, f"{schema}, probs array<double>")


def sharded(
    samples: DataFrame, shard_rows: int, salt: str
) -> tuple[DataFrame, DataFrame]:
    """Samples with a hash ``shard`` of about ``shard_rows`` rows, and ``(entity, _shards)``."""
    sizes = samples.groupBy("entity").agg(F.count(F.lit(1)).alias("_rows"))
    plan = sizes.select("entity", F.ceil(F.col("_rows") / shard_rows).cast("int").alias("_shards"))
    u = hash_uniform(F.col("sample_id"), f"shard:{salt}")
    tagged = spread_join(samples, plan, ["entity"], ["sample_id"]).withColumn(
        "shard", F.floor(u * F.col("_shards")).cast("int")
    )
    return tagged.drop("_shards"), plan


def per_shard(plan: DataFrame, models: DataFrame) -> DataFrame:
    """One copy of an entity's model row per shard of its samples."""
    return plan.join(models, "entity").withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1))
    ).withColumnRenamed("entity", "owner").drop("_shards")


def score_per_entity(
    samples: DataFrame, models: DataFrame, n_in: int, n_hidden: int, n_out: int,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """As ``score`` with a model per entity.

    A shard of an entity's samples meets one copy of its model; a crowded entity is many shards.
    """
    # Samples of an entity without a model have no score, and no empty group to make.
    samples = samples.join(models.select("entity"), "entity", "left_semi")
    tagged, plan = sharded(samples, shard_rows, "score")
    pieces = per_shard(plan, models.select("entity", F.col("vector").alias("_model")))
    kept = [f for f in samples.schema.fields if f.name != "features"]
    names = [f.name for f in kept]

    def run(key, data: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if data.empty or model.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*names, "probs"]})
        net = Net(np.asarray(model["_model"].iat[0], float), n_in, n_hidden, n_out)
        x = np.stack(data["features"].to_numpy()).astype(float)
        return data[names].assign(probs=list(net.forward(x)[1]))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return tagged.groupBy("entity", "shard").cogroup(pieces.groupBy("owner", "piece")).applyInPandas(
        run, f"{schema}, probs array<double>"
    )


def _fit(
    flat: np.ndarray, x: np.ndarray, y: np.ndarray, shape: tuple[int, int, int], rate: float,
    epochs: int, order: np.random.Generator, mu: float,
) -> tuple[np.ndarray, float]:
    """Per-sample gradient steps; ``mu`` pulls towards the start vector (proximal term)."""
    start = flat.copy()
    net = Net(flat.copy(), *shape)
    loss = 0.0
    for _ in range(epochs):
        total = 0.0
        for i in order.permutation(len(x)):
            hidden, p = net.forward(x[i])
            total -= np.log(min(max(p[y[i]], 1e-7), 1 - 1e-7))
            d_out = p.copy()
            d_out[y[i]] -= 1.0
            d_hidden = (net.w2 @ d_out) * hidden * (1.0 - hidden)
            if mu:
                net.flat -= rate * mu * (net.flat - start)
            net.w2 -= rate * np.outer(hidden, d_out)
            net.b2 -= rate * d_out
            net.w1 -= rate * np.outer(x[i], d_hidden)
            net.b1 -= rate * d_hidden
        loss = total / max(1, len(x))
    return net.flat, loss


def train_per_entity(
    samples: DataFrame,
    starts: DataFrame,
    shape: tuple[int, int, int],
    rate: float = LEARNING_RATE,
    epochs: int = EPOCHS,
    seed: int = 0,
    mu: float = 0.0,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``(entity, vector, n, loss)``: one model per entity from its ``(features, label)`` rows.

    An entity above ``shard_rows`` is cut into hash shards trained side by side, whose vectors are
    averaged by their row counts; so no task holds more than a shard. ``epochs`` may also come per
    entity as a column of ``starts``.
    """
    tagged, plan = sharded(samples.select("entity", "sample_id", "features", "label"), shard_rows,
                            str(seed))
    effort = F.col("epochs") if "epochs" in starts.columns else F.lit(epochs)
    pieces = per_shard(plan, starts.select(
        "entity", F.col("vector").alias("start"), effort.cast("int").alias("epochs")
    ))

    def fit(key, data: pd.DataFrame, begin_rows: pd.DataFrame) -> pd.DataFrame:
        if data.empty or begin_rows.empty:
            columns = ("entity", "shard", "vector", "n", "loss")
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
        data = data.sort_values("sample_id")
        x = np.stack(data["features"].to_numpy()).astype(float)
        y = data["label"].to_numpy().astype(int)
        order = np.random.default_rng([seed, zlib.crc32(f"{key[0]}:{key[1]}".encode())])
        flat, loss = _fit(
            np.asarray(begin_rows["start"].iat[0], float), x, y, shape, rate,
            int(begin_rows["epochs"].iat[0]), order, mu,
        )
        return pd.DataFrame({
            "entity": [key[0]], "shard": [key[1]], "vector": [flat], "n": [len(x)], "loss": [loss],
        })

    entity_type = samples.schema["entity"].dataType.simpleString()
    trained = tagged.groupBy("entity", "shard").cogroup(
        pieces.groupBy("owner", "piece")
    ).applyInPandas(
        fit, f"entity {entity_type}, shard int, vector array<double>, n long, loss double"
    )
    single = vector_aggregate(
        trained.withColumn("weight", F.col("n").cast("double")), ["entity"], "fedavg"
    )
    scalars = trained.groupBy("entity").agg(
        F.sum("n").alias("n"), (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss")
    )
    return to_vectors(single, ["entity"]).join(scalars, "entity")

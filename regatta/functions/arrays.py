"""Column builders over dense ``array<double>`` vectors (no shuffle, no Python workers)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: probabilities are clipped to [LOG_CLIP, 1 - LOG_CLIP] before the logarithm.
LOG_CLIP = 1e-7


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(array_sum(F.transform(a, lambda x: x * x)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def midpoint(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def l1_distance(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector is similar to nothing (0)."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "l1": l1_distance,
    "l2": l2_distance,
    "cosine": cosine_distance,
}


def register_distance(name: str, build: Callable[[Column, Column], Column]) -> None:
    DISTANCES[name] = build


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in DISTANCES:
        raise ValueError(f"unknown metric {metric!r}; known: {sorted(DISTANCES)}")
    return DISTANCES[metric](a, b)


def flatten_model(layers: Column, bias: Column) -> Column:
    return F.concat(F.flatten(layers), bias)


def flatten_parts(w1: Column, b1: Column, w2: Column, b2: Column) -> Column:
    return F.concat(F.flatten(w1), b1, F.flatten(w2), b2)


def reshape(vector: Column, rows: int, cols: int, start: int = 0) -> Column:
    """Cut ``rows * cols`` values, from 0-based ``start``, into an array of rows."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(rows - 1)),
        lambda i: F.slice(vector, i * cols + (start + 1), F.lit(cols)),
    )


def unflatten_parts(vector: Column, n_in: int, n_hidden: int, n_out: int) -> Column:
    """Flat vector in (W1, b1, W2, b2) order to a struct of the four parts."""
    b1 = n_in * n_hidden
    w2 = b1 + n_hidden
    b2 = w2 + n_hidden * n_out
    return F.struct(
        reshape(vector, n_in, n_hidden).alias("W1"),
        F.slice(vector, b1 + 1, n_hidden).alias("b1"),
        reshape(vector, n_hidden, n_out, w2).alias("W2"),
        F.slice(vector, b2 + 1, n_out).alias("b2"),
    )


def is_well_formed(vector: Column, dim: int) -> Column:
    """True where the vector is present, ``dim`` long and free of null and NaN."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dim) & ~bad, F.lit(False))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda i: F.when(i == label, F.lit(1.0)).otherwise(F.lit(0.0)),
    )


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - top))
    total = array_sum(exps)
    return F.transform(exps, lambda e: e / total)


def cross_entropy(probs: Column, label: Column) -> Column:
    p = F.element_at(probs, label.cast("int") + 1)
    return -F.log(F.greatest(F.lit(LOG_CLIP), F.least(F.lit(1 - LOG_CLIP), p)))


def population_std(values: Column, mean: Column) -> Column:
    gaps = F.transform(values, lambda x: (x - mean) * (x - mean))
    return F.sqrt(array_sum(gaps) / F.size(values))


def segment_stats(vector: Column, segments: Sequence[tuple[str, int, int]]) -> list[Column]:
    """Mean and population deviation over 0-based ``[start, stop)`` ranges of one vector."""
    out = []
    for name, start, stop in segments:
        part = F.slice(vector, start + 1, stop - start)
        mean = array_sum(part) / (stop - start)
        out += [mean.alias(f"{name}_mean"), population_std(part, mean).alias(f"{name}_std")]
    return out

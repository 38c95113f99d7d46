"""Grouped vector aggregates over the long form ``(group..., idx, val[, weight])``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from regatta.functions.arrays import array_sum
from regatta.operators.common import cut_lineage, spread_join, value_rank

# Quantiles between which a group's values are counted, the accuracy asked of their sketch, and the values
# of one group that a task may hold.
MEDIAN_SPLITS = [i / 64 for i in range(1, 64)]
MEDIAN_ACCURACY = 2000
MEDIAN_FITS = 65536
# Arrays that one task adds up in a tree of sums.
BRANCH = 64

AggregateBuilder = Callable[[Column, Column], Column]


def to_long(df: DataFrame, keys: Sequence[str], vector: str = "vector") -> DataFrame:
    """One row per vector element; only the listed columns survive."""
    return df.select(*keys, F.posexplode(vector).alias("idx", "val"))


def to_vectors(long: DataFrame, keys: Sequence[str], vector: str = "vector") -> DataFrame:
    """Rebuild one vector per key; a group holds one row per index, so it is ``d`` long."""
    packed = F.array_sort(F.collect_list(F.struct("idx", "val")))
    return long.groupBy(*keys).agg(F.transform(packed, lambda e: e["val"]).alias(vector))


def _weighted_mean(val: Column, weight: Column) -> Column:
    total = F.sum(weight)
    return F.when(total != 0, F.sum(val * weight) / total)


AGGREGATES: dict[str, AggregateBuilder] = {
    "fedavg": _weighted_mean,
    "fedprox": _weighted_mean,
    "simple": lambda val, weight: F.avg(val),
    "median": lambda val, weight: F.median(val),
}


def register_aggregate(name: str, build: AggregateBuilder) -> None:
    """Offer a user aggregate: a builder of Columns, or one calling a grouped-agg pandas UDF."""
    AGGREGATES[name] = build


def vector_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    how: str = "fedavg",
    vector: str = "vector",
    weight: str | None = "weight",
) -> DataFrame:
    """``(keys..., idx, val)``: element-wise aggregate of the vectors of each group.

    Sums and means combine map-side, so a hot group costs one partial row per task and index. The
    exact median goes through ``vector_median``.
    """
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate {how!r}; known: {sorted(AGGREGATES)}")
    if how == "median":
        return vector_median(df, keys, vector)
    carried = [*keys] + ([weight] if weight else [])
    weight_col = F.col(weight) if weight else F.lit(1.0)
    return (
        to_long(df, carried, vector)
        .groupBy(*keys, "idx")
        .agg(AGGREGATES[how](F.col("val"), weight_col).alias("val"))
    )


def sum_arrays(parts: DataFrame, keys: Sequence[str], member: str, members: int) -> DataFrame:
    """``(keys..., part)``: the arrays ``part`` of each key added up element by element.

    ``member`` numbers the rows of a key from 0, ``members`` of them at most. They meet in a tree, ``BRANCH``
    to a task, so a key of any number of rows is bounded; rows of one member are added in its task.
    Within a task they are added by member, so the sum does not depend on their arrival.
    """
    names = [*keys, member, "part"]
    parts = parts.select(*names)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(pdf.sort_values("_from")["part"].to_numpy()), axis=0)
        return pdf[names[:-1]].iloc[:1].assign(part=[total])

    while True:
        up = parts.withColumn("_from", F.col(member)).withColumn(
            member, F.floor(F.col(member) / BRANCH).cast("int")
        )
        parts = up.groupBy(*keys, member).applyInPandas(add, parts.schema)
        members = -(-members // BRANCH)
        if members <= 1:
            return parts.select(*keys, "part")


def scalar_vector_aggregate(
    df: DataFrame, keys: Sequence[str], parts: Sequence[str], how: str, weight: str
) -> DataFrame:
    """As ``vector_aggregate`` when the vector is spread over named columns: no row is exploded."""
    build = AGGREGATES[how]
    wide = df.groupBy(*keys).agg(*[build(F.col(p), F.col(weight)).alias(p) for p in parts])
    return wide.select(*keys, F.posexplode(F.array(*parts)).alias("idx", "val"))


def vector_median(df: DataFrame, keys: Sequence[str], vector: str = "vector") -> DataFrame:
    """Exact coordinate-wise median; an even count takes the mean of the middle two."""
    return long_median(to_long(df, keys, vector), keys)


def _median_of_counts(counted: DataFrame, at: list[str]) -> DataFrame:
    """``(at..., val)`` from ``(at..., _v, _c, _below, _n)``: few distinct values with their counts."""
    upto = W.partitionBy(*at).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumn("_cum", F.sum("_c").over(upto) + F.col("_below"))

    def at_rank(rank: Column) -> Column:
        holds = (F.col("_cum") >= rank) & (F.col("_cum") - F.col("_c") < rank)
        return F.max(F.when(holds, F.col("_v")))

    low, high = _middle_ranks(F.col("_n"))
    return ranked.groupBy(*at).agg(((at_rank(low) + at_rank(high)) / 2).alias("val"))


def _middle_ranks(n: Column) -> tuple[Column, Column]:
    return F.floor((n + 1) / 2), F.floor((n + 2) / 2)


def _middle_range(long: DataFrame, at: list[str], known: list[str]) -> DataFrame:
    """One round of refinement: ``(at..., _n, _below, _lo, _hi, _inside)`` of every group.

    The group's values in the present range are dealt into bins between sketched quantiles, and a bin of
    its own for every value that is a quantile; only counts, least and greatest value of the bins move.
    What lies between the bins of the two middle ranks is the next range; ``_below`` counts what is less.
    """
    splits = long.groupBy(*at).agg(
        F.percentile_approx("val", MEDIAN_SPLITS, MEDIAN_ACCURACY).alias("_s"), F.count("val").alias("_rows"),
        *[F.first(c).alias(c) for c in known],
    ).withColumn("_s", F.array_distinct("_s"))
    if not known:
        splits = splits.withColumns({"_n": F.col("_rows"), "_below": F.lit(0).cast("long")})
    inside = long.drop(*known)
    dealt = spread_join(inside, splits.drop("_rows"), at, ["val"])
    less = F.size(F.filter("_s", lambda s: s < F.col("val")))
    bins = dealt.groupBy(*at, "_n", "_below", (less * 2 + F.array_contains("_s", F.col("val")).cast("int")).alias("_b")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("val").alias("_min"), F.max("val").alias("_max")
    )
    upto = W.partitionBy(*at).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    ranked = bins.withColumn("_cum", F.sum("_c").over(upto) + F.col("_below"))
    low, high = _middle_ranks(F.col("_n"))
    before = F.col("_cum") - F.col("_c")
    # From the bin of the lower middle rank to that of the higher one.
    middle = ranked.where((F.col("_cum") >= low) & (before < high))
    apart = F.count(F.lit(1)) > 1
    # Two bins: the ranks are the last value of one and the first of the other.
    lowest, highest = F.min_by("_max", "_b"), F.max_by("_min", "_b")
    return middle.groupBy(*at, "_n").agg(
        F.when(apart, F.min("_cum") - F.min_by("_c", "_b")).otherwise(F.min(before)).alias("_below"),
        F.when(apart, lowest).otherwise(F.min("_min")).alias("_lo"),
        F.when(apart, highest).otherwise(F.max("_max")).alias("_hi"),
        F.when(apart | (F.min("_min") == F.max("_max")), 0).otherwise(F.sum("_c")).alias("_inside"),
    )


def long_median(long: DataFrame, keys: Sequence[str], fits: int = MEDIAN_FITS) -> DataFrame:
    """Exact median per ``(keys, idx)`` by refinement of the range that holds the middle.

    While a group's range has more values than fit a task, its values are counted in bins and the range
    shrinks to the bin of the middle ranks, to a thirtieth or less of its rows in each round, or to one
    value. No task holds, sorts or ranks more than ``fits`` values of one group, and only the rows in the
    ranges of large groups are read again. Values that are null do not count.
    """
    at = [*keys, "idx"]
    rows = long.select(*at, "val").where(F.col("val").isNotNull())
    counts = cut_lineage(rows.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")))
    large = counts.where(F.col("_n") > fits)
    if large.isEmpty():
        return rows.groupBy(*at).agg(F.median("val").alias("val"))
    small = spread_join(rows, counts.where(F.col("_n") <= fits), at, ["val"]).groupBy(*at).agg(
        F.median("val").alias("val")
    )
    rows = spread_join(rows, large.select(*at), at, ["val"])
    known: list[str] = []
    done = [small]
    while True:
        state = cut_lineage(_middle_range(rows, at, known))
        done.append(state.where(F.col("_inside") == 0).select(*at, ((F.col("_lo") + F.col("_hi")) / 2).alias("val")))
        open_ = state.where(F.col("_inside") > 0)
        largest = open_.agg(F.max("_inside").alias("n")).first()["n"]
        if largest is None:
            break
        known = ["_n", "_below"]
        ranges = open_.select(*at, *known, "_lo", "_hi")
        rows = cut_lineage(
            spread_join(rows.select(*at, "val"), ranges, at, ["val"])
            .where(F.col("val").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
        )
        if largest <= fits:
            counted = rows.groupBy(*at, *known, F.col("val").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
            done.append(_median_of_counts(counted, at))
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mean_pairwise_cosine(df: DataFrame, vector: str = "vector") -> DataFrame:
    """``sigma``: mean cosine distance over all pairs, in one pass and without making pairs.

    The similarities of all pairs sum to ``(|S|^2 - sum |x|^2) / 2`` for the sum S of the unit
    vectors; empty or zero gives 1.
    """
    from regatta.functions.arrays import unit

    units = df.select(unit(F.col(vector)).alias("_x"))
    sums = units.select(F.posexplode("_x").alias("idx", "val")).groupBy("idx").agg(
        F.sum("val").alias("s"), F.sum(F.col("val") * F.col("val")).alias("q"),
        F.count(F.lit(1)).alias("n"),
    )
    total = sums.agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s") - F.col("q")).alias("x"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = (pairs - F.col("x") / 2) / pairs
    return total.select(
        F.when((F.col("n") > 1) & (mean != 0), mean).otherwise(F.lit(1.0)).alias("sigma")
    )


def mean_pairwise_l1(df: DataFrame, vector: str = "vector") -> DataFrame:
    """``sigma``: mean L1 distance over all pairs from per-index ranks, without making pairs."""
    long = df.select(F.posexplode(vector).alias("idx", "val"))
    ranked = value_rank(long, ["idx"], "val")
    sums = ranked.groupBy("idx").agg(
        F.sum(F.col("val") * F.col("rank") * 2).alias("r"),
        F.sum("val").alias("s"),
        F.count(F.lit(1)).alias("n"),
    )
    total = sums.agg(
        F.max("n").alias("n"), F.sum(F.col("r") - (F.col("n") + 1) * F.col("s")).alias("x")
    )
    mean = F.col("x") / (F.col("n") * (F.col("n") - 1) / 2)
    return total.select(
        F.when((F.col("n") > 1) & (mean != 0), mean).otherwise(F.lit(1.0)).alias("sigma")
    )


def version_bump(version: Column) -> Column:
    """Aggregates over a whole fleet advance the version of the vector they replace."""
    return (version + 1).cast("int")


__all__ = [
    "AGGREGATES", "array_sum", "long_median", "mean_pairwise_cosine", "mean_pairwise_l1",
    "register_aggregate", "scalar_vector_aggregate", "to_long", "to_vectors", "vector_aggregate",
    "vector_median", "version_bump",
]

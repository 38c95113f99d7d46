"""Clustering quality and prediction scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.functions.arrays import argmax, cross_entropy, dot, unit
from regatta.operators.common import LOOKUP_LIMIT, lookup
from regatta.operators.pairs import cluster_distance_sums
from regatta.operators.ranked_l1 import own_and_nearest


def _silhouette_from_means(means: DataFrame) -> DataFrame:
    """``(entity, cluster, s)`` from ``(entity, cluster, other, n, total)``.

    A singleton has a = 0, so it scores 1; with one cluster only, b = a. (The usual definition
    scores singletons 0.)
    """
    own = F.col("other") == F.col("cluster")
    mean = F.col("total") / F.col("n")
    per = means.groupBy("entity", "cluster").agg(
        F.coalesce(F.max(F.when(own & (F.col("n") > 0), mean)), F.lit(0.0)).alias("a"),
        F.min(F.when(~own & (F.col("n") > 0), mean)).alias("b"),
    )
    return _scored(per)


def _scored(per: DataFrame) -> DataFrame:
    """``(entity, cluster, s)`` from ``(entity, cluster, a, b)``; without another cluster b is a."""
    b = F.coalesce("b", "a")
    top = F.greatest(F.col("a"), b)
    return per.select(
        "entity", "cluster",
        F.when(top > 0, (b - F.col("a")) / top).otherwise(F.lit(0.0)).alias("s"),
    )


def silhouette_from_distances(pairs: DataFrame, partition: DataFrame) -> DataFrame:
    """``(cluster, silhouette)`` from a distance table ``(src, dst, d)`` holding every pair once."""
    both = pairs.unionByName(pairs.withColumns({"src": F.col("dst"), "dst": F.col("src")}))
    at = partition.select(F.col("entity").alias("dst"), F.col("cluster").alias("other"))
    sums = (
        both.join(at, "dst")
        .groupBy(F.col("src").alias("entity"), "other")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("total"))
    )
    means = partition.join(sums, "entity", "left")
    return _per_cluster(_silhouette_from_means(means))


def _per_cluster(scores: DataFrame) -> DataFrame:
    return scores.groupBy("cluster").agg(F.avg("s").alias("silhouette"))


def silhouette_scores(
    df: DataFrame, metric: str = "cosine", cluster_limit: int = LOOKUP_LIMIT
) -> DataFrame:
    """``(entity, cluster, s)`` of ``(entity, cluster, vector)``.

    Cosine needs no pairs: the mean distance of x to cluster C is 1 - x.mean(C) over unit vectors.
    Neither does L1, whose sums come from ranks per index (``ranked_l1``). More clusters than a lookup
    holds under cosine, or another metric, go through block sums.
    """
    if metric == "l1":
        return _scored(own_and_nearest(df))
    few = metric == "cosine" and (
        df.select("cluster").distinct().limit(cluster_limit + 1).count() <= cluster_limit
    )
    if not few:
        return _silhouette_from_means(cluster_distance_sums(df, metric))
    units = df.select("entity", "cluster", unit(F.col("vector").cast("array<double>")).alias("x"))
    sums = units.select("cluster", F.posexplode("x").alias("idx", "val")).groupBy(
        "cluster", "idx"
    ).agg(F.sum("val").alias("val"), F.count(F.lit(1)).alias("n"))
    packed = F.array_sort(F.collect_list(F.struct("idx", "val")))
    centres = sums.groupBy("cluster").agg(
        F.max("n").alias("n"), F.transform(packed, lambda e: e["val"]).alias("s")
    )
    table = lookup(centres, "cluster", "n", "s", limit=cluster_limit, what="clusters")
    # All clusters of one entity sit in one row, so a and b need no shuffle.
    units = units.withColumn("_table", table)
    entry = F.transform("_table", lambda e: F.struct(
        (e["cluster"] == F.col("cluster")).alias("own"),
        (e["n"] - F.when(e["cluster"] == F.col("cluster"), 1).otherwise(0)).alias("n"),
        (dot(F.col("x"), e["s"]) - F.when(
            e["cluster"] == F.col("cluster"), dot(F.col("x"), F.col("x"))
        ).otherwise(0.0)).alias("near"),
    ))
    rows = units.withColumn("_m", entry).drop("_table")
    mean = F.transform(
        F.filter("_m", lambda e: e["n"] > 0),
        lambda e: F.struct(e["own"].alias("own"), ((e["n"] - e["near"]) / e["n"]).alias("d")),
    )
    rows = rows.withColumn("_d", mean)
    a = F.coalesce(
        F.array_max(F.transform(F.filter("_d", lambda e: e["own"]), lambda e: e["d"])), F.lit(0.0)
    )
    b = F.array_min(F.transform(F.filter("_d", lambda e: ~e["own"]), lambda e: e["d"]))
    scored = rows.select("entity", "cluster", a.alias("a"), F.coalesce(b, a).alias("b"))
    top = F.greatest("a", "b")
    return scored.select(
        "entity", "cluster",
        F.when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(F.lit(0.0)).alias("s"),
    )


def silhouette(df: DataFrame, metric: str = "cosine") -> DataFrame:
    """``(cluster, silhouette)``: mean per cluster."""
    return _per_cluster(silhouette_scores(df, metric))


def silhouette_average(per_cluster: DataFrame) -> DataFrame:
    """Macro average: the mean of the cluster means."""
    return per_cluster.agg(F.avg("silhouette").alias("silhouette"))


def hit(probs: Column, label: Column) -> Column:
    return F.when(argmax(probs) == label, F.lit(1.0)).otherwise(F.lit(0.0))


def accuracy(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys..., accuracy)`` of ``(probs, label)`` rows."""
    return predictions.groupBy(*(keys or [])).agg(
        F.avg(hit(F.col("probs"), F.col("label"))).alias("accuracy")
    )


def mean_loss(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return predictions.groupBy(*(keys or [])).agg(
        F.avg(cross_entropy(F.col("probs"), F.col("label"))).alias("loss")
    )


def pooled_accuracy(
    predictions: DataFrame, partition: DataFrame, groups: DataFrame | None = None
) -> DataFrame:
    """Accuracy over the pooled rows of each cluster's members; an empty pool scores 0.

    Hits are summed per entity before the join, so a crowded entity travels as one row.
    """
    per_entity = predictions.groupBy("entity").agg(
        F.sum(hit(F.col("probs"), F.col("label"))).alias("hits"), F.count(F.lit(1)).alias("n")
    )
    pooled = partition.join(per_entity, "entity", "left").groupBy("cluster").agg(
        F.coalesce(F.sum("hits"), F.lit(0.0)).alias("hits"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
    )
    out = pooled.select(
        "cluster", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(F.lit(0.0))
        .alias("accuracy"), F.col("n").alias("rows"),
    )
    if groups is None:
        return out
    return groups.join(out, "cluster", "left").select(
        "cluster", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )

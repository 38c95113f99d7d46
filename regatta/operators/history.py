"""Run histories: averaging over seeds, bands, alignment, and windows over rounds.

A history holds one row per (experiment, seed, round[, entity]) once ``one_per_round`` or a grouped
mean has run, so a window over an entity's rounds is as long as the number of rounds, not of events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from regatta.operators.assign import has_risen
from regatta.operators.common import ranked_in_buckets, spread_join

# History length, palette size, and the cap on pivoted columns.
HISTORY_LENGTH = 3
PALETTE = 12
PIVOT_LIMIT = 1000


def one_per_round(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One record per key where rounds were recorded twice (exact copies, or the first by order)."""
    return df.dropDuplicates(list(keys))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key by ``order``: a partial aggregate, so a hot key needs no sort."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def average_rounds(df: DataFrame, keys: Sequence[str] = ("experiment", "round")) -> DataFrame:
    """Means over seeds; a missing silhouette counts as 0."""
    return df.groupBy(*keys).agg(
        F.avg("loss").alias("loss"),
        F.avg("accuracy").alias("accuracy"),
        F.avg("agg_ms").alias("agg_ms"),
        F.avg(F.coalesce("silhouette", F.lit(0.0))).alias("silhouette"),
    )


def average_clusters(df: DataFrame) -> DataFrame:
    """Mean accuracy per cluster position over seeds; members come from the first seed."""
    return df.groupBy("experiment", "round", "pos").agg(
        F.avg("accuracy").alias("accuracy"), F.min_by("members", "seed").alias("members")
    )


def average_entities(df: DataFrame) -> DataFrame:
    return df.groupBy("experiment", "round", "entity").agg(
        F.avg("loss").alias("loss"), F.avg("accuracy").alias("accuracy"),
        F.avg("test_accuracy").alias("test_accuracy"),
    )


def from_first_seed(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.min_by(c, "seed").alias(c) for c in cols])


def band(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, population deviation and the band around the mean, in percent."""
    pct = F.col(value) * 100
    stats = df.groupBy(*keys).agg(F.avg(pct).alias("mean"), F.stddev_pop(pct).alias("std"))
    return stats.withColumns({
        "low": F.col("mean") - F.col("std"), "high": F.col("mean") + F.col("std")
    })


def longest_history(df: DataFrame) -> DataFrame:
    """``rounds``: length of the longest history over runs."""
    return df.groupBy("experiment", "seed").agg(F.countDistinct("round").alias("n")).agg(
        F.max("n").alias("rounds")
    )


def pivot_names(df: DataFrame, col: str, limit: int = PIVOT_LIMIT) -> list:
    """Values to pivot on: sorted, and refused beyond ``limit`` instead of cut."""
    rows = df.select(col).distinct().orderBy(col).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} values of {col} to pivot on")
    return [r[0] for r in rows]


def align_runs(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per round up to the longest run, one column pair per experiment; gaps stay null."""
    names = list(names) if names is not None else pivot_names(df, "experiment")
    last = df.agg(F.max("round").alias("last"))
    spine = last.select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("round"))
    per = df.groupBy("round").pivot("experiment", names).agg(
        F.first("loss", ignorenulls=True).alias("loss"),
        (F.first("accuracy", ignorenulls=True) * 100).alias("acc"),
    )
    wide = spine.join(per, "round", "left")
    return wide.withColumn("round", F.col("round") + 1)


def wide_series(df: DataFrame, entity: str, names: Sequence, metrics: Sequence[str]) -> DataFrame:
    """One row per round, one column per entity and metric, in percent."""
    return df.groupBy("round").pivot(entity, list(names)).agg(
        *[(F.first(m, ignorenulls=True) * 100).alias(m) for m in metrics]
    )


def round_series(df: DataFrame) -> DataFrame:
    """1-based rounds, percent accuracy, percent silhouette with null as 0."""
    return df.select(
        *[c for c in ("experiment", "seed") if c in df.columns],
        (F.col("round") + 1).alias("round"), "loss",
        (F.col("accuracy") * 100).alias("accuracy"),
        (F.coalesce("silhouette", F.lit(0.0)) * 100).alias("silhouette"),
    )


def at_round(df: DataFrame, round_no: int) -> DataFrame:
    """Rows of one round, clamped to the last recorded one."""
    last = df.agg(F.max("round")).scalar()
    return df.filter(F.col("round") == F.least(F.lit(round_no), last))


def quorum(df: DataFrame, least: int) -> DataFrame:
    """Rounds with at least ``least`` idle entities."""
    return (
        df.filter(F.col("status") == "idle")
        .groupBy("round")
        .agg(F.countDistinct("entity").alias("available"))
        .filter(F.col("available") >= least)
    )


def fold_updates(df: DataFrame, cols: Sequence[str], order: Column) -> DataFrame:
    """Last value that is not null per column and entity: partial updates folded into one state."""
    return df.groupBy("entity").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols]
    )


def _rounds(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy("round")


def recent_history(
    df: DataFrame, value: str, keys: Sequence[str], length: int = HISTORY_LENGTH
) -> DataFrame:
    """``history``: up to ``length`` values, newest first."""
    window = _rounds(keys).rowsBetween(-(length - 1), 0)
    return df.withColumn("history", F.reverse(F.collect_list(value).over(window)))


def increase_alerts(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """``rising``: the value is at least 1.2 times the one of the round before."""
    previous = F.lag(value).over(_rounds(keys))
    return df.withColumn("previous", previous).withColumn(
        "rising", has_risen(F.col(value), F.col("previous"))
    )


def adaptive_effort(df: DataFrame, value: str, keys: Sequence[str], base: int) -> DataFrame:
    """``effort``: twice the base where the value has risen."""
    return increase_alerts(df, value, keys).withColumn(
        "effort", F.when(F.col("rising"), base * 2).otherwise(base)
    )


def update_norms(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``norm``: L2 length of the change of a vector since the round before."""
    from regatta.functions.arrays import l2_distance

    previous = F.lag("vector").over(_rounds(keys))
    return df.withColumn("_before", previous).select(
        *keys, "round", l2_distance(F.col("vector"), F.col("_before")).alias("norm")
    )


def latest_change(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last round of every run against the one before it."""
    window = _rounds(keys)
    last = W.partitionBy(*keys).orderBy(F.desc("round"))
    return (
        df.withColumns({
            "_loss": F.lag("loss").over(window), "_acc": F.lag("accuracy").over(window),
            "_r": F.row_number().over(last),
        })
        .filter(F.col("_r") == 1)
        .select(
            *keys, "round", "loss", "accuracy",
            F.coalesce(F.col("loss") < F.col("_loss"), F.lit(False)).alias("loss_improved"),
            F.coalesce(F.col("accuracy") > F.col("_acc"), F.lit(False)).alias("accuracy_improved"),
        )
    )


def participation(df: DataFrame) -> DataFrame:
    """``joined``: rounds an entity has joined so far."""
    seen = _rounds(["entity"]).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("joined", F.count(F.lit(1)).over(seen).cast("int"))


def distinct_entities(df: DataFrame) -> DataFrame:
    """Each entity once, with the name it had first."""
    return df.groupBy("entity").agg(F.min_by("name", "round").alias("name"))


def align_positions(df: DataFrame) -> DataFrame:
    """``(experiment, round, pos, seeds, accuracy)`` out of nested per-seed cluster lists."""
    flat = df.select("experiment", "round", "seed", F.posexplode("clusters").alias("pos", "c"))
    return flat.select("experiment", "round", "seed", "pos", "c.*")


def cluster_of_members(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """Left lookup of the cluster position an entity is listed in; others stay with null."""
    listed = clusters.select(F.explode("members").alias("entity"), F.col("pos").alias("cluster"))
    return entities.join(listed, "entity", "left")


def apply_transfers(rows: DataFrame, transfers: DataFrame, step: int) -> DataFrame:
    """Replace the rows of each ``dst`` by a copy of the rows of its ``src`` at ``step``.

    A transfer repeated for one (step, dst) counts once (smallest src); unknown ids are refused.
    """
    known = rows.select("entity").distinct()
    due = (
        transfers.filter((F.col("step") == step) & (F.col("src") != F.col("dst")))
        .groupBy("dst").agg(F.min("src").alias("src"))
        .join(known.select(F.col("entity").alias("src")), "src", "left_semi")
        .join(known.select(F.col("entity").alias("dst")), "dst", "left_semi")
        .select("dst", "src")
    )
    others = [c for c in rows.columns if c != "entity"]
    moved = due.select(F.col("dst").alias("entity"))
    kept = spread_join(rows, moved, ["entity"], others, "left_anti").select(*rows.columns)
    copies = spread_join(rows.withColumnRenamed("entity", "src"), due, ["src"], others).select(
        F.col("dst").alias("entity"), *others
    )
    return kept.unionByName(copies)


def composition_keys(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., signature, size)``: an order-free fingerprint of each group's member ids.

    Two groups with the same members get the same value. Sums combine map-side, so a group of any
    size is a handful of partial rows and never a list.
    """
    digest = F.md5(F.col("entity").cast("string"))
    half = [F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(38,0)") for at in (1, 13)]
    unique = members.select(*keys, "entity").distinct()
    sums = unique.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.sum(half[0]).alias("_a"), F.sum(half[1]).alias("_b")
    )
    text = F.concat_ws("-", F.col("size").cast("string"), F.col("_a").cast("string"),
                       F.col("_b").cast("string"))
    return sums.select(*keys, text.alias("signature"), "size")


def signature_index(members: DataFrame) -> DataFrame:
    """``(round, cluster, size, palette)``: index of a composition by first appearance, mod 12.

    ``members`` is ``(round, cluster, entity)``.
    """
    signed = composition_keys(members, ["round", "cluster"])
    first = signed.groupBy("signature").agg(F.min(F.struct("round", "cluster")).alias("_f"))
    # The round already follows the order, so it serves as the bucket of the rank.
    ranked = ranked_in_buckets(
        first.withColumn("_bucket", F.col("_f.round")), [], "_bucket", [F.col("_f")], "_rank"
    )
    names = ranked.select("signature", "_rank")
    return spread_join(signed, names, ["signature"], ["round", "cluster"]).select(
        "round", "cluster", "size", ((F.col("_rank") - 1) % PALETTE).cast("int").alias("palette")
    )


def members_of_first_seed(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flat member rows ``(keys..., seed, entity)`` kept for the first seed of each key only."""
    first = members.groupBy(*keys).agg(F.min("seed").alias("seed"))
    return members.join(first, [*keys, "seed"], "left_semi").select(*keys, "seed", "entity").distinct()

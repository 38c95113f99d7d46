"""Shared building blocks: lineage cuts, bounded lookups, salted joins, distributed ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Rows a lookup may hold before it stops being a lookup (centroids, class means, one global row).
LOOKUP_LIMIT = 4096
# Copies of the unique side in a salted join; one hot key is spread over this many tasks.
SALT_COPIES = 8
# Rows of a counted table that may be broadcast; beyond it a join shuffles both sides.
BROADCAST_ROWS = 1 << 18
# Buckets per key in a distributed rank.
RANK_BUCKETS = 64


def ensure_checkpoint_dir(df: DataFrame) -> None:
    """Use the cluster's shared checkpoint folder; make one only for a local session without it."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="regatta-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def checkpoint_folder(df: DataFrame) -> str:
    ensure_checkpoint_dir(df)
    return df.sparkSession.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and go on from there.

    A table survives lost executors, and the next plan starts clean: unlike a checkpointed
    DataFrame it brings no constraints of its past along, which would pile up in a loop, and its
    file sizes let the planner pick broadcast joins by itself.
    """
    path = f"{checkpoint_folder(df)}/regatta-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame, *cols: str, limit: int = LOOKUP_LIMIT, what: str = "lookup") -> Column:
    """All rows of a small table as one ``array<struct>`` scalar, sorted by the first column.

    At most ``limit + 1`` rows ever leave the table; more than ``limit`` is an error, never a cut.
    """
    packed = df.select(*cols).limit(limit + 1).agg(
        F.array_sort(F.collect_list(F.struct(*cols))).alias("items")
    )
    checked = packed.select(
        F.when(F.size("items") > limit, F.raise_error(F.lit(f"{what}: more than {limit} rows")))
        .otherwise(F.col("items"))
        .alias("items")
    )
    return checked.scalar()


def spread_join(
    facts: DataFrame,
    unique: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    copies: int = SALT_COPIES,
) -> DataFrame:
    """Equi-join against a key-unique side when one key may own a third of ``facts``.

    The salt is a hash of ``spread_by``, so a recomputed task sends every row where it went before.
    The planner's size does not know of the copies, so both sides are shuffled and never broadcast.
    """
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(copies)).cast("int"))
    copied = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return salted.join(copied.hint("merge"), [*on, "_salt"], how).drop("_salt")


def is_small(df: DataFrame) -> bool:
    """Whether the table, counted and not estimated, may be broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def counted_join(
    facts: DataFrame,
    unique: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Equi-join against a key-unique table that is cheap to count, such as a written one.

    A small one is broadcast once; a larger one is shuffled, salted by ``spread_by`` where one is given.
    """
    if is_small(unique):
        return facts.join(F.broadcast(unique), list(on), how)
    if spread_by:
        return spread_join(facts, unique, on, spread_by, how)
    return facts.join(unique.hint("merge"), list(on), how)


def ranked_in_buckets(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], rank: str = "rank"
) -> DataFrame:
    """1-based rank within ``keys`` when ``bucket`` already follows the order.

    Each bucket is sorted by itself and offset by the row counts of the buckets before it, so no
    task ever holds a whole key.
    """
    keys = list(keys)
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, bucket)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    local = W.partitionBy(*keys, bucket).orderBy(*order)
    return (
        df.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, bucket])
        .withColumn(rank, (F.col("_local") + F.col("_before")).cast("long"))
        .drop("_local", "_before", bucket)
    )


def uniform_rank(
    df: DataFrame,
    keys: Sequence[str],
    uniform: Column,
    tie: str,
    rank: str = "rank",
    buckets: int = 1024,
) -> DataFrame:
    """Rank within ``keys`` by a uniform column in [0, 1): fixed-width buckets stay even."""
    tagged = df.withColumn("_u", uniform).withColumn(
        "_bucket", F.floor(F.col("_u") * buckets).cast("int")
    )
    return ranked_in_buckets(tagged, keys, "_bucket", [F.col("_u"), F.col(tie)], rank).drop("_u")


def value_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: str | None = None,
    rank: str = "rank",
    buckets: int = RANK_BUCKETS,
) -> DataFrame:
    """Rank within ``keys`` by any numeric column: bucket edges are approximate quantiles."""
    edges = [i / buckets for i in range(1, buckets)]
    splits = df.groupBy(*keys).agg(F.percentile_approx(value, edges, 10000).alias("_splits"))
    if keys:
        tagged = spread_join(df, splits, list(keys), [value])
    else:
        tagged = df.withColumn("_splits", splits.scalar())
    position = F.size(F.filter("_splits", lambda s: s < F.col(value)))
    tagged = tagged.withColumn("_bucket", position).drop("_splits")
    order = [F.col(value)] + ([F.col(tie)] if tie else [])
    return ranked_in_buckets(tagged, keys, "_bucket", order, rank)

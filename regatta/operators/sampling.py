"""Reproducible sampling: ranked hashes instead of shuffles, positions instead of scans per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from regatta.functions.hashing import distinct_draws, entity_weight, hash_uniform
from regatta.operators.common import cut_lineage, spread_join, uniform_rank, value_rank

# Share of a skewed sample that comes from the primary label, and the test size rule.
PRIMARY_PERCENT = 70
TEST_PERCENT = 20
MIN_TEST = 50
# Fixed value: run seeds are drawn below this bound.
SEED_BOUND = 100000
# Tasks that walk the permutations of a table of entities, however few files it came from.
DRAW_TASKS = 32


def shuffle_and_take(
    df: DataFrame, key: str, n: int | Column, seed: int | str, groups: list[str] | None = None
) -> DataFrame:
    """The first ``n`` rows per group of a seeded permutation, with their 1-based ``rank``."""
    ranked = uniform_rank(df, groups or [], hash_uniform(F.col(key), seed), key)
    return ranked.filter(F.col("rank") <= n)


def primary_share(n: Column) -> Column:
    """70 % of ``n``, rounded down, in whole-number arithmetic."""
    return F.floor(n * PRIMARY_PERCENT / 100).cast("int")


def test_size(n: Column) -> Column:
    return F.greatest(F.lit(MIN_TEST), F.floor(n * TEST_PERCENT / 100).cast("int"))


test_size.__test__ = False


def group_of(index: Column, mode: str = "groups") -> Column:
    """0-2, 3-5 and 6 on form three groups; ``pairs`` puts 2i and 2i + 1 together."""
    if mode == "pairs":
        return F.floor(index / 2).cast("int")
    return F.when(index <= 2, 0).when(index <= 5, 1).otherwise(2)


def primary_labels(entities: DataFrame, mode: str = "groups", labels: int = 10) -> DataFrame:
    """``(entity, group, label, ...)``: labels handed out to groups in order of appearance by index.

    The first ``labels`` groups get 0, 1, 2, ...; later ones reuse their index modulo the number.
    """
    grouped = entities.withColumn("group", group_of(F.col("entity"), mode))
    ranked = value_rank(grouped.select("group").distinct(), [], "group", rank="_rank")
    named = ranked.select(
        "group",
        F.when(F.col("_rank") <= labels, F.col("_rank") - 1)
        .otherwise(F.pmod("group", F.lit(labels))).cast("int").alias("label"),
    )
    return spread_join(grouped, named, ["group"], ["entity"])


def _placed(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples with a dense 0-based place by id, per ``keys``; the same table serves every seed."""
    ranked = value_rank(samples, keys, "sample_id")
    return cut_lineage(ranked.withColumn("pos", F.col("rank") - 1).drop("rank"))


def _with_sizes(wants: DataFrame, samples: DataFrame, key: str | None) -> DataFrame:
    if key is None:
        return wants.withColumn("_size", samples.agg(F.count(F.lit(1))).scalar())
    sizes = samples.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    return wants.join(sizes, key, "left").withColumn("_size", F.coalesce("_size", F.lit(0)))


def _drawn(wants: DataFrame, placed: DataFrame, need: str, seed: str, keys: list[str], key: Column) -> DataFrame:
    """``(entity, sample_id)``: the samples at the places that each entity's permutation names.

    Places are joined with a salt: where entities share a permutation, they share its few places.
    They are written once, since a filter on an exploded column would walk the permutation again.
    """
    draws = distinct_draws(F.col("_size"), F.col(need), key, seed)
    drawn = cut_lineage(wants.repartition(DRAW_TASKS, "entity").select("entity", *keys, draws.alias("_draws")))
    places = drawn.select("entity", *keys, F.explode("_draws").alias("pos"))
    return spread_join(places, placed, [*keys, "pos"], ["entity"]).select("entity", "sample_id")


def iid_sample(
    entities: DataFrame, samples: DataFrame, seed: int | str, shared: bool = False
) -> DataFrame:
    """``(entity, sample_id)``: ``n`` distinct samples for every ``(entity, n)``, all if there are fewer.

    Every entity has a permutation of its own (``shared``: one for all, so entities overlap fully),
    computed at the places it reads: the work is the output, not entities x samples, and nothing is
    shuffled or ranked per seed.
    """
    placed = _placed(samples.select("sample_id"), [])
    wants = _with_sizes(entities.select("entity", "n"), placed, None)
    key = F.lit("shared") if shared else F.col("entity")
    return _drawn(wants, placed, "n", f"{seed}:all", [], key)


def skewed_sample(
    entities: DataFrame, samples: DataFrame, seed: int | str
) -> DataFrame:
    """``(entity, sample_id, part)``: 70 % from the primary label, the rest from everything.

    ``entities`` is ``(entity, label, n)``. A sample may come up once in each part; where the
    primary label runs short, the rest makes up the number.
    """
    slim = samples.select("sample_id", "label")
    by_label, overall = _placed(slim, ["label"]), _placed(slim.select("sample_id"), [])
    wants = _with_sizes(entities.select("entity", "label", "n"), by_label, "label")
    wants = cut_lineage(wants.withColumn(
        "_primary", F.least(primary_share(F.col("n")).cast("long"), F.col("_size"))
    ))
    primary = _drawn(wants, by_label, "_primary", f"{seed}:primary", ["label"], F.col("entity"))
    rest = wants.select("entity", (F.col("n") - F.col("_primary")).alias("_rest"))
    rest = _with_sizes(rest, overall, None)
    other = _drawn(rest, overall, "_rest", f"{seed}:all", [], F.col("entity"))
    return primary.withColumn("part", F.lit("primary")).unionByName(other.withColumn("part", F.lit("any")))


def run_seeds(df_or_spark, master: int, count: int) -> DataFrame:
    """``(run, seed)``: ``count`` whole seeds below ``SEED_BOUND`` from one master seed."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    seed = F.floor(hash_uniform(F.col("run"), f"run:{master}") * SEED_BOUND).cast("int")
    return spark.range(count).select(F.col("id").cast("int").alias("run")).withColumn("seed", seed)


def random_weights(entities: DataFrame, seed: int | str) -> DataFrame:
    return entities.withColumn("weight", entity_weight(F.col("entity"), seed))


def select_available(
    entities: DataFrame, count: int, seed: int | str, groups: list[str]
) -> DataFrame:
    """Up to ``count`` of the idle entities per round, in seeded order."""
    idle = entities.filter(F.col("status") == "idle")
    return shuffle_and_take(idle, "entity", count, seed, groups)


def running_share(long: DataFrame) -> DataFrame:
    """``(entity, cluster, p, cum)``: running probability; a group is one row per cluster."""
    order = W.partitionBy("entity").orderBy("cluster").rowsBetween(W.unboundedPreceding, 0)
    return long.withColumn("cum", F.sum("p").over(order))

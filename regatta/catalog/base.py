"""Registry of runnable queries, and the tables they share as Spark plans and as SQL.

Every query is ``(spark, sf_dir) -> DataFrame`` over whole tables. The SQL next to it states the
same result over the same tables for an independent check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.functions.hashing import entity_weight

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Fixed values of the bindings: first day of the event log, vector length, decimals compared.
FIRST_DAY = "2024-01-01"
DIM = 64
DECIMALS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = DECIMALS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def uniform_sql(key: str, seed: str | int) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || ':{seed}'), 1, 8))::BIGINT / 4294967296.0)"


# -- embeddings ---------------------------------------------------------------------------------


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(entity, cluster, weight, vector)`` of the embeddings table."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("entity"), F.col("label").alias("cluster"),
        entity_weight(F.col("vec_id"), "weight").alias("weight"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


FLEET = f"""fleet AS (
  SELECT vec_id AS entity, label AS cluster,
         floor({uniform_sql('vec_id', 'weight')} * 400) + 200 AS weight,
         embedding::DOUBLE[] AS vector
  FROM embeddings)"""

LONG = f"""{FLEET}, long AS (
  SELECT entity, cluster, weight, unnest(vector) AS val,
         unnest(range(len(vector)))::INT AS idx
  FROM fleet)"""

MEANS = f"""{LONG}, means AS (
  SELECT cluster, list(val ORDER BY idx) AS vector FROM (
    SELECT cluster, idx, avg(val) AS val FROM long GROUP BY ALL) GROUP BY cluster)"""


def cluster_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cluster, vector)``: plain mean per label, a fleet of ten."""
    from regatta.operators.aggregate import to_vectors, vector_aggregate

    long = vector_aggregate(fleet(spark, sf_dir), ["cluster"], "simple")
    return to_vectors(long, ["cluster"])


def cosine_sql(a: str, b: str) -> str:
    na, nb = f"sqrt(list_dot_product({a}, {a}))", f"sqrt(list_dot_product({b}, {b}))"
    return (
        f"(CASE WHEN {na} * {nb} > 0 THEN list_dot_product({a}, {b}) / ({na} * {nb}) ELSE 0 END)"
    )


def l1_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))"


def l2_sql(a: str, b: str) -> str:
    return f"list_distance({a}, {b})"


DISTANCE_SQL = {
    "l1": l1_sql,
    "l2": l2_sql,
    "cosine": lambda a, b: f"(1 - {cosine_sql(a, b)})",
}

# -- events as run histories --------------------------------------------------------------------


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ``(experiment, seed, round, entity, loss, accuracy, ...)``."""
    share = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("experiment"),
        (F.col("user_id") % 3).cast("int").alias("seed"),
        F.datediff(F.to_date("ts"), F.lit(FIRST_DAY)).alias("round"),
        F.col("user_id").alias("entity"), F.col("value").alias("loss"),
        (share / 100).alias("accuracy"),
        (F.floor(F.col("user_id") / 3) % 4).cast("int").alias("pos"),
    )


LOG = f"""log AS (
  SELECT event_id, ts, event_type AS experiment, (user_id % 3)::INT AS seed,
         date_diff('day', DATE '{FIRST_DAY}', ts::DATE)::INT AS round, user_id AS entity,
         value AS loss, (props->>'$.k')::INT / 100.0 AS accuracy,
         (floor(user_id / 3)::BIGINT % 4)::INT AS pos
  FROM events)"""


def round_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(experiment, seed, round, loss, accuracy, agg_ms, silhouette)``; some silhouettes null."""
    n = F.count(F.lit(1))
    return log(spark, sf_dir).groupBy("experiment", "seed", "round").agg(
        F.avg("loss").alias("loss"), F.avg("accuracy").alias("accuracy"),
        (n * 10.0).alias("agg_ms"),
        F.when(n % 4 != 0, F.avg("accuracy")).alias("silhouette"),
    )


ROUNDS = f"""{LOG}, rounds AS (
  SELECT experiment, seed, round, avg(loss) AS loss, avg(accuracy) AS accuracy,
         count(*) * 10.0::DOUBLE AS agg_ms,
         CASE WHEN count(*) % 4 <> 0 THEN avg(accuracy) END AS silhouette
  FROM log GROUP BY experiment, seed, round)"""


def entity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).groupBy("experiment", "seed", "round", "entity").agg(
        F.avg("loss").alias("loss"), F.avg("accuracy").alias("accuracy"),
        F.max("accuracy").alias("test_accuracy"),
    )


ENTITY_METRICS = f"""{LOG}, client AS (
  SELECT experiment, seed, round, entity, avg(loss) AS loss, avg(accuracy) AS accuracy,
         max(accuracy) AS test_accuracy
  FROM log GROUP BY experiment, seed, round, entity)"""


def cluster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).groupBy("experiment", "seed", "round", "pos").agg(
        F.avg("accuracy").alias("accuracy")
    )


CLUSTER_METRICS = f"""{LOG}, cluster AS (
  SELECT experiment, seed, round, pos, avg(accuracy) AS accuracy
  FROM log GROUP BY experiment, seed, round, pos)"""


def entity_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(entity, round, norm)``: one row per entity and day."""
    return log(spark, sf_dir).groupBy("entity", "round").agg(
        F.sqrt(F.sum(F.col("loss") * F.col("loss"))).alias("norm")
    )


ENTITY_ROUNDS = f"""{LOG}, er AS (
  SELECT entity, round, sqrt(sum(loss * loss)) AS norm FROM log GROUP BY entity, round)"""

# -- trade graph --------------------------------------------------------------------------------


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to part graph, both directions; weight is the quantity bought."""
    from regatta.operators.graph import both_directions

    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    bought = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            (F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")
        )
        .agg(F.sum("l_quantity").alias("w"))
    )
    return both_directions(bought)


def trade_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node, community)``: nation of a customer, half the size of a part."""
    customers = read(spark, sf_dir, "customer").select(
        (F.col("c_custkey") * 2).alias("node"), F.col("c_nationkey").cast("long").alias("community")
    )
    parts = read(spark, sf_dir, "part").select(
        (F.col("p_partkey") * 2 + 1).alias("node"),
        F.floor(F.col("p_size") / 2).cast("long").alias("community"),
    )
    return customers.unionByName(parts)


TRADE = """half AS (
  SELECT o_custkey * 2 AS src, l_partkey * 2 + 1 AS dst, sum(l_quantity) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
edges AS (SELECT src, dst, w FROM half UNION ALL SELECT dst, src, w FROM half),
labels AS (
  SELECT c_custkey * 2 AS node, c_nationkey::BIGINT AS community FROM customer
  UNION ALL SELECT p_partkey * 2 + 1, floor(p_size / 2)::BIGINT FROM part),
deg AS (SELECT src AS node, sum(w) AS k FROM edges GROUP BY src),
tot AS (SELECT sum(w) AS two_m FROM edges),
kin AS (
  SELECT e.src, l.community, sum(e.w) AS w FROM edges e JOIN labels l ON l.node = e.dst
  GROUP BY ALL),
csum AS (
  SELECT l.community, sum(d.k) AS tot FROM labels l JOIN deg d ON d.node = l.node GROUP BY ALL)"""

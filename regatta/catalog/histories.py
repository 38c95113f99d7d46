"""Run histories: filters, averages, bands, alignment and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from regatta.catalog.base import (
    CLUSTER_METRICS,
    ENTITY_METRICS,
    ENTITY_ROUNDS,
    LOG,
    ROUNDS,
    cluster_metrics,
    entity_metrics,
    entity_rounds,
    log,
    query,
    read,
    round_metrics,
    rounded,
    uniform_sql,
)
from regatta.functions import ids
from regatta.operators import history as H
from regatta.operators import sampling

EXPERIMENTS = ["click", "error", "purchase", "signup", "view"]

STATUS = f"""{LOG}, status AS (
  SELECT DISTINCT round, entity,
         CASE WHEN {uniform_sql('(round::VARCHAR || chr(45) || entity::VARCHAR)', 'idle')} < 0.6 THEN 'idle'
              ELSE 'busy' END AS status FROM log)"""


def _status(spark, sf):
    from regatta.functions.hashing import hash_uniform

    seen = log(spark, sf).select("round", "entity").distinct()
    u = hash_uniform(F.concat_ws("-", "round", "entity"), "idle")
    return seen.withColumn("status", F.when(u < 0.6, "idle").otherwise("busy"))


@query("p4_quorum_rounds", f"""WITH {STATUS}
SELECT round, count(DISTINCT entity) AS available FROM status WHERE status = 'idle'
GROUP BY round HAVING count(DISTINCT entity) >= 60""")
def _quorum(spark, sf):
    return H.quorum(_status(spark, sf), 60)


@query("w9_bounded_selection", f"""WITH {STATUS}, r AS (
  SELECT round, entity, row_number() OVER (
    PARTITION BY round ORDER BY {uniform_sql('entity', 'pick')}, entity) AS rank
  FROM status WHERE status = 'idle')
SELECT round, entity, rank FROM r WHERE rank <= 10""")
def _select(spark, sf):
    out = sampling.select_available(_status(spark, sf), 10, "pick", ["round"])
    return out.select("round", "entity", "rank")


@query("p5_missing_fields", f"""WITH {ROUNDS}
SELECT experiment, seed, round, round(silhouette, 8) AS silhouette FROM rounds WHERE silhouette IS NOT NULL""")
def _present(spark, sf):
    rows = round_metrics(spark, sf).filter(F.col("silhouette").isNotNull())
    return rounded(rows.select("experiment", "seed", "round", "silhouette"), "silhouette", digits=8)


@query("p6_clamped_round", f"""WITH {ROUNDS}
SELECT experiment, seed, round, round(loss, 8) AS loss FROM rounds
WHERE round = least(500, (SELECT max(round) FROM rounds))""")
def _clamped(spark, sf):
    rows = H.at_round(round_metrics(spark, sf), 500)
    return rounded(rows.select("experiment", "seed", "round", "loss"), "loss", digits=8)


STORE = """store AS (
  SELECT 'client-' || c_custkey AS key, c_acctbal AS value FROM customer
  UNION ALL SELECT 'cluster-' || s_suppkey, s_acctbal FROM supplier)"""


def _store(spark, sf):
    a = read(spark, sf, "customer").select(
        F.concat(F.lit("client-"), "c_custkey").alias("key"), F.col("c_acctbal").alias("value")
    )
    b = read(spark, sf, "supplier").select(
        F.concat(F.lit("cluster-"), "s_suppkey").alias("key"), F.col("s_acctbal").alias("value")
    )
    return a.unionByName(b)


@query("p7_key_prefix", f"WITH {STORE} SELECT key, value FROM store WHERE starts_with(key, 'cluster-')")
def _prefix(spark, sf):
    return _store(spark, sf).filter(F.startswith("key", F.lit("cluster-")))


ROLLING = """list_reduce(list_prepend(7::BIGINT, list_transform(string_split(id, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, c: (a * 31 + c) % 4294967296)"""


@query("p8_entity_index", f"""WITH {STORE}, all_ids AS (
  SELECT key AS id FROM store UNION ALL SELECT c_name FROM customer),
h AS (SELECT id, {ROLLING} AS h FROM all_ids)
SELECT id, CASE WHEN regexp_matches(id, '^[^-]*-[0-9]+') THEN regexp_extract(id, '^[^-]*-([0-9]+)', 1)::INT
                ELSE 0 END AS suffix,
       CASE WHEN regexp_matches(id, 'client-[0-9]+') THEN regexp_extract(id, 'client-([0-9]+)', 1)::BIGINT
            WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS idx FROM h""")
def _ids(spark, sf):
    names = read(spark, sf, "customer").select(F.col("c_name").alias("id"))
    every = _store(spark, sf).select(F.col("key").alias("id")).unionByName(names)
    return every.select("id", ids.numeric_suffix(F.col("id")).alias("suffix"),
                        ids.entity_index(F.col("id")).alias("idx"))


@query("p9_round_series", f"""WITH {ROUNDS}
SELECT experiment, seed, round + 1 AS round, round(loss, 8) AS loss, round(accuracy * 100, 8) AS accuracy,
       round(coalesce(silhouette, 0) * 100, 8) AS silhouette FROM rounds""")
def _series(spark, sf):
    return rounded(H.round_series(round_metrics(spark, sf)), "loss", "accuracy", "silhouette", digits=8)


@query("p11_partial_update_fold", f"""WITH {LOG}
SELECT entity,
       arg_max(loss, (ts, event_id)) FILTER (experiment IN ('view', 'click')) AS loss,
       arg_max(accuracy, (ts, event_id)) FILTER (experiment IN ('signup', 'purchase')) AS accuracy,
       arg_max(experiment, (ts, event_id)) AS status
FROM log GROUP BY entity""")
def _fold(spark, sf):
    kind = F.col("experiment")
    updates = log(spark, sf).select(
        "entity", "ts", "event_id",
        F.when(kind.isin("view", "click"), F.col("loss")).alias("loss"),
        F.when(kind.isin("signup", "purchase"), F.col("accuracy")).alias("accuracy"),
        kind.alias("status"),
    )
    return H.fold_updates(updates, ["loss", "accuracy", "status"], F.struct("ts", "event_id"))


MEAN_ROUNDS = f"""{ROUNDS}, mean AS (
  SELECT experiment, round, avg(loss) AS loss, avg(accuracy) AS accuracy, avg(agg_ms) AS agg_ms,
         avg(coalesce(silhouette, 0)) AS silhouette FROM rounds GROUP BY experiment, round)"""


@query("a6_seed_means", f"""WITH {MEAN_ROUNDS}
SELECT experiment, round, round(loss, 8) AS loss, round(accuracy, 8) AS accuracy,
       round(agg_ms, 8) AS agg_ms, round(silhouette, 8) AS silhouette FROM mean""")
def _means(spark, sf):
    out = H.average_rounds(round_metrics(spark, sf))
    return rounded(out, "loss", "accuracy", "agg_ms", "silhouette", digits=8)


@query("u5_duplicate_rounds", f"""WITH {MEAN_ROUNDS}
SELECT experiment, round, round(loss, 8) AS loss, round(agg_ms, 8) AS agg_ms FROM mean""")
def _duplicates(spark, sf):
    once = round_metrics(spark, sf)
    twice = once.unionByName(once)
    clean = H.one_per_round(twice, ["experiment", "seed", "round"])
    out = H.average_rounds(clean).select("experiment", "round", "loss", "agg_ms")
    return rounded(out, "loss", "agg_ms", digits=8)


@query("a7_cluster_means", f"""WITH {CLUSTER_METRICS}, first AS (
  SELECT experiment, round, pos, min(seed) AS seed FROM log GROUP BY ALL),
members AS (
  SELECT experiment, round, pos, count(DISTINCT entity) AS members FROM log
  JOIN first USING (experiment, round, pos, seed) GROUP BY ALL)
SELECT experiment, round, pos, round(avg(accuracy), 8) AS accuracy, any_value(members) AS members
FROM cluster JOIN members USING (experiment, round, pos) GROUP BY experiment, round, pos""")
def _cluster_means(spark, sf):
    keys = ["experiment", "round", "pos"]
    means = cluster_metrics(spark, sf).groupBy(*keys).agg(F.avg("accuracy").alias("accuracy"))
    members = H.members_of_first_seed(log(spark, sf), keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members")
    )
    return rounded(means.join(members, keys), "accuracy", digits=8)


@query("j7_positional_alignment", f"""WITH {CLUSTER_METRICS}
SELECT experiment, round, pos, round(avg(accuracy), 8) AS accuracy, min_by(accuracy, seed) AS first
FROM cluster GROUP BY experiment, round, pos""")
def _positions(spark, sf):
    entry = F.array_sort(F.collect_list(F.struct("pos", "accuracy")))
    # One entry per cluster position of a round: four at most.
    nested = cluster_metrics(spark, sf).groupBy("experiment", "round", "seed").agg(
        F.transform(entry, lambda e: F.struct(e["accuracy"].alias("accuracy"), e["pos"].alias("at")))
        .alias("clusters")
    )
    flat = H.align_positions(nested).withColumn("pos", F.col("at"))
    out = flat.groupBy("experiment", "round", "pos").agg(
        F.avg("accuracy").alias("accuracy"), F.min_by("accuracy", "seed").alias("first")
    )
    return rounded(out, "accuracy", digits=8)


@query("a8_entity_means", f"""WITH {ENTITY_METRICS}
SELECT experiment, round, entity, round(avg(loss), 8) AS loss, round(avg(accuracy), 8) AS accuracy,
       round(avg(test_accuracy), 8) AS test_accuracy
FROM client GROUP BY experiment, round, entity""")
def _entity_means(spark, sf):
    out = H.average_entities(entity_metrics(spark, sf))
    return rounded(out, "loss", "accuracy", "test_accuracy", digits=8)


@query("a9_first_seed_carry_over", f"""WITH {ROUNDS}
SELECT experiment, round, min_by(agg_ms, seed) AS agg_ms, round(min_by(loss, seed), 8) AS loss
FROM rounds GROUP BY experiment, round""")
def _first_seed(spark, sf):
    out = H.from_first_seed(round_metrics(spark, sf), ["experiment", "round"], ["agg_ms", "loss"])
    return rounded(out, "loss", digits=8)


def _band_sql(source: str, table: str, value: str) -> str:
    return f"""WITH {source}, b AS (
  SELECT experiment, round, avg({value} * 100) AS mean, stddev_pop({value} * 100) AS std
  FROM {table} GROUP BY experiment, round)
SELECT experiment, round, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - std, 6) AS low,
       round(mean + std, 6) AS high FROM b"""


@query("a10_cluster_band", _band_sql(CLUSTER_METRICS, "cluster", "accuracy"))
def _cluster_band(spark, sf):
    out = H.band(cluster_metrics(spark, sf), ["experiment", "round"], "accuracy")
    return rounded(out, "mean", "std", "low", "high")


@query("a11_entity_band", _band_sql(ENTITY_METRICS, "client", "test_accuracy"))
def _entity_band(spark, sf):
    out = H.band(entity_metrics(spark, sf), ["experiment", "round"], "test_accuracy")
    return rounded(out, "mean", "std", "low", "high")


@query("a16_longest_history", f"""WITH {LOG}
SELECT max(n) AS rounds FROM (
  SELECT count(DISTINCT round) AS n FROM log GROUP BY experiment, seed)""")
def _longest(spark, sf):
    return H.longest_history(log(spark, sf))


@query("a18_participation", f"""WITH {ENTITY_ROUNDS}
SELECT entity, round, count(*) OVER (PARTITION BY entity ORDER BY round)::INT AS joined FROM er""")
def _joined(spark, sf):
    return H.participation(entity_rounds(spark, sf)).select("entity", "round", "joined")


def _pivot_sql() -> str:
    cols = []
    for e in EXPERIMENTS:
        cols += [f"round(max(loss) FILTER (experiment = '{e}'), 8) AS {e}_loss",
                 f"round(max(accuracy * 100) FILTER (experiment = '{e}'), 8) AS {e}_acc"]
    return f"""WITH {MEAN_ROUNDS}, spine AS (
  SELECT unnest(range((SELECT max(round) + 1 FROM mean)))::INT AS round)
SELECT (s.round + 1)::INT AS round, {', '.join(cols)} FROM spine s LEFT JOIN mean USING (round) GROUP BY s.round"""


@query("j6_align_experiments", _pivot_sql())
def _align(spark, sf):
    out = H.align_runs(H.average_rounds(round_metrics(spark, sf)))
    return rounded(out, *[c for c in out.columns if c != "round"], digits=8)


def _wide_sql() -> str:
    cols = []
    for p in range(4):
        cols += [f"round(max(accuracy * 100) FILTER (pos = {p}), 8) AS \"{p}_accuracy\"",
                 f"round(max(loss * 100) FILTER (pos = {p}), 6) AS \"{p}_loss\""]
    return f"""WITH {LOG}, per AS (
  SELECT round, pos, avg(accuracy) AS accuracy, avg(loss) AS loss FROM log GROUP BY round, pos)
SELECT round, {', '.join(cols)} FROM per GROUP BY round"""


@query("u3_wide_series", _wide_sql())
def _wide(spark, sf):
    per = log(spark, sf).groupBy("round", "pos").agg(
        F.avg("accuracy").alias("accuracy"), F.avg("loss").alias("loss")
    )
    out = H.wide_series(per, "pos", H.pivot_names(per, "pos"), ["accuracy", "loss"])
    out = rounded(out, *[c for c in out.columns if c.endswith("accuracy")], digits=8)
    return rounded(out, *[c for c in out.columns if c.endswith("loss")], digits=6)


@query("u1_distinct_entities", f"""WITH {LOG}
SELECT entity, arg_min(experiment, (round, ts, event_id)) AS name FROM log GROUP BY entity""")
def _distinct(spark, sf):
    rows = log(spark, sf).select(
        "entity", F.col("experiment").alias("name"), F.struct("round", "ts", "event_id").alias("round")
    )
    return H.distinct_entities(rows)


@query("u4_exactly_once_actions", f"""WITH {LOG}
SELECT entity, round, arg_min(event_id, (ts, event_id)) AS event_id FROM log GROUP BY entity, round""")
def _once(spark, sf):
    rows = log(spark, sf).select("entity", "round", "ts", "event_id")
    return H.first_per_key(rows, ["entity", "round"], ["ts", "event_id"]).select(
        "entity", "round", "event_id"
    )


@query("w1_recent_history", f"""WITH {ENTITY_ROUNDS}
SELECT entity, round, round(norm, 6) AS newest,
       round(lag(norm, 1) OVER w, 6) AS second, round(lag(norm, 2) OVER w, 6) AS third,
       least(3, row_number() OVER w)::INT AS kept
FROM er WINDOW w AS (PARTITION BY entity ORDER BY round)""")
def _recent(spark, sf):
    rows = H.recent_history(entity_rounds(spark, sf), "norm", ["entity"])
    h = F.col("history")
    return rows.select(
        "entity", "round", F.round(h[0], 6).alias("newest"),
        F.round(F.try_element_at(h, F.lit(2)), 6).alias("second"),
        F.round(F.try_element_at(h, F.lit(3)), 6).alias("third"), F.size(h).alias("kept"),
    )


@query("w2_increase_detector", f"""WITH {ENTITY_ROUNDS}
SELECT entity, round, coalesce(norm >= lag(norm) OVER w * 1.2, false) AS rising
FROM er WINDOW w AS (PARTITION BY entity ORDER BY round)""")
def _rising(spark, sf):
    return H.increase_alerts(entity_rounds(spark, sf), "norm", ["entity"]).select(
        "entity", "round", "rising"
    )


@query("w3_adaptive_effort", f"""WITH {ENTITY_ROUNDS}
SELECT entity, round, CASE WHEN norm >= lag(norm) OVER w * 1.2 THEN 6 ELSE 3 END AS effort
FROM er WINDOW w AS (PARTITION BY entity ORDER BY round)""")
def _effort(spark, sf):
    return H.adaptive_effort(entity_rounds(spark, sf), "norm", ["entity"], 3).select(
        "entity", "round", "effort"
    )


@query("w4_latest_change", f"""WITH {ROUNDS}, l AS (
  SELECT *, lag(loss) OVER w AS pl, lag(accuracy) OVER w AS pa,
         row_number() OVER (PARTITION BY experiment, seed ORDER BY round DESC) AS r
  FROM rounds WINDOW w AS (PARTITION BY experiment, seed ORDER BY round))
SELECT experiment, seed, round, round(loss, 8) AS loss, round(accuracy, 8) AS accuracy,
       coalesce(loss < pl, false) AS loss_improved, coalesce(accuracy > pa, false) AS accuracy_improved
FROM l WHERE r = 1""")
def _latest(spark, sf):
    return rounded(H.latest_change(round_metrics(spark, sf), ["experiment", "seed"]),
                   "loss", "accuracy", digits=8)


MEMBERS = f"""{LOG}, members AS (
  SELECT DISTINCT round, experiment AS cluster, entity FROM log)"""


@query("w6_composition_index", f"""WITH {MEMBERS}, signed AS (
  SELECT round, cluster, string_agg(entity::VARCHAR, ',' ORDER BY entity) AS signature, count(*) AS size
  FROM members GROUP BY round, cluster),
first AS (SELECT signature, min((round, cluster)) AS f FROM signed GROUP BY signature),
ranked AS (SELECT signature, row_number() OVER (ORDER BY f) - 1 AS r FROM first)
SELECT round, cluster, size, (r % 12)::INT AS palette FROM signed JOIN ranked USING (signature)""")
def _signatures(spark, sf):
    members = log(spark, sf).select("round", F.col("experiment").alias("cluster"), "entity")
    return H.signature_index(members)


@query("j9_cluster_of_members", f"""WITH {LOG}, listed AS (
  SELECT entity, arg_max(experiment, (loss, event_id)) AS cluster FROM log GROUP BY entity)
SELECT c.c_custkey AS entity, l.cluster FROM customer c LEFT JOIN listed l ON l.entity = c.c_custkey""")
def _member_lookup(spark, sf):
    top = log(spark, sf).groupBy("entity").agg(
        F.max_by("experiment", F.struct("loss", "event_id")).alias("experiment")
    )
    clusters = top.select(F.array("entity").alias("members"), F.col("experiment").alias("pos"))
    entities = read(spark, sf, "customer").select(F.col("c_custkey").alias("entity"))
    return H.cluster_of_members(entities, clusters)


@query("w7_ordered_entities", f"""WITH {ENTITY_ROUNDS}
SELECT 'client-' || entity AS id, round, row_number() OVER (PARTITION BY round ORDER BY entity) AS place,
       row_number() OVER (PARTITION BY entity ORDER BY round DESC) AS newest_first
FROM er""")
def _ordered(spark, sf):
    from pyspark.sql import Window as W

    from regatta.operators.common import value_rank

    rows = entity_rounds(spark, sf).select(F.concat(F.lit("client-"), "entity").alias("id"), "round")
    keyed = rows.withColumn("_n", ids.numeric_suffix(F.col("id")))
    placed = value_rank(keyed, ["round"], "_n", rank="place", buckets=16).drop("_n")
    back = W.partitionBy("id").orderBy(F.desc("round"))
    return placed.withColumn("newest_first", F.row_number().over(back))


TRANSFERS = """transfers AS (
  SELECT s_nationkey AS step, s_suppkey AS dst, s_suppkey + 1 AS src FROM supplier
  UNION ALL SELECT s_nationkey, s_suppkey, s_suppkey + 7 FROM supplier),
known AS (SELECT DISTINCT l_suppkey AS entity FROM lineitem),
due AS (
  SELECT dst, min(src) AS src FROM transfers WHERE step = 3 GROUP BY dst)"""


@query("j8_keyed_data_replacement", f"""WITH {TRANSFERS}, ok AS (
  SELECT * FROM due WHERE src IN (SELECT entity FROM known) AND dst IN (SELECT entity FROM known)),
out AS (
  SELECT l_suppkey AS entity, l_quantity AS q FROM lineitem WHERE l_suppkey NOT IN (SELECT dst FROM ok)
  UNION ALL SELECT ok.dst, l_quantity FROM lineitem JOIN ok ON ok.src = l_suppkey)
SELECT entity, count(*) AS n, round(sum(q), 4) AS q FROM out GROUP BY entity""")
def _transfer(spark, sf):
    s = read(spark, sf, "supplier")
    moves = [
        s.select(F.col("s_nationkey").alias("step"), F.col("s_suppkey").alias("dst"),
                 (F.col("s_suppkey") + by).alias("src"))
        for by in (1, 7)
    ]
    rows = read(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("entity"), F.col("l_quantity").alias("q")
    )
    out = H.apply_transfers(rows, moves[0].unionByName(moves[1]), 3)
    totals = out.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))
    return rounded(totals, "q", digits=4)

"""Streams over the event log, run to the end of it, and sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from regatta.catalog.base import (
    ENTITY_ROUNDS,
    FIRST_DAY,
    LOG,
    ROUNDS,
    cluster_metrics,
    fleet,
    query,
    round_metrics,
    rounded,
)
from regatta.operators import history as H
from regatta.sources import experiments as X
from regatta.sources import idx as I
from regatta.streaming import metrics as M
from regatta.streaming import state as S
from regatta.streaming.sinks import new_folder, run_and_follow, run_partials, run_to_end, run_to_table


def _day(col: str):
    return F.datediff(F.to_date(col), F.lit(FIRST_DAY))


@query("st1_live_round_metrics", f"""WITH {LOG}
SELECT round, experiment, round(avg(loss), 8) AS mean, round(stddev_pop(loss), 8) AS std, count(*) AS n
FROM log GROUP BY round, experiment""")
def _live(spark, sf):
    table = run_to_end(M.event_stream(spark, sf), M.round_metrics)
    out = table.select(_day("start").alias("round"), "experiment", "mean", "std", "n")
    return rounded(out, "mean", "std", digits=8)


def _windows(spark, sf):
    return run_and_follow(M.event_stream(spark, sf), M.entity_windows)


# Entity rounds in stretches without a silence of more than 30 days.
STRETCHES = f"""{ENTITY_ROUNDS}, gaps AS (
  SELECT *, coalesce(round - lag(round) OVER (PARTITION BY entity ORDER BY round) > 30, false)::INT AS gap FROM er),
r AS (SELECT *, sum(gap) OVER (PARTITION BY entity ORDER BY round) AS stretch FROM gaps)"""


@query("st2_keyed_last_three", f"""WITH {STRETCHES}
SELECT entity, round, round(norm, 6) AS newest, round(lag(norm, 1) OVER w, 6) AS second,
       round(lag(norm, 2) OVER w, 6) AS third, least(3, row_number() OVER w)::INT AS kept
FROM r WINDOW w AS (PARTITION BY entity, stretch ORDER BY round)""")
def _last_three(spark, sf):
    table = run_to_table(S.recent_values(_windows(spark, sf)))
    out = table.select("entity", _day("at").alias("round"), "newest", "second", "third", "kept")
    return rounded(out, "newest", "second", "third")


@query("st3_increase_alerts", f"""WITH {STRETCHES}, pairs AS (
  SELECT entity, round, norm, lag(norm) OVER (PARTITION BY entity, stretch ORDER BY round) AS previous FROM r)
SELECT entity, round, round(previous, 6) AS previous, round(norm, 6) AS current
FROM pairs WHERE norm >= previous * 1.2""")
def _alerts(spark, sf):
    table = run_to_table(S.increase_alerts(_windows(spark, sf)))
    out = table.select("entity", _day("at").alias("round"), "previous", "current")
    return rounded(out, "previous", "current")


@query("st4_quorum_per_window", f"""WITH {LOG}
SELECT round, count(DISTINCT entity) AS entities, count(*) AS rows, 0::BIGINT AS late
FROM log GROUP BY round HAVING count(DISTINCT entity) >= 130""")
def _quorum(spark, sf):
    """The whole log comes in one batch, before any watermark, so SQL can say that no row is late."""
    stream = M.event_stream(spark, sf)
    table = run_to_end(stream, lambda rows: M.quorum(rows, 130))
    out = M.late_rows(table, run_partials(stream, M.window_rows))
    return out.select(_day("start").alias("round"), "entities", "rows", "late")


@query("st5_exactly_once_actions", f"WITH {LOG} SELECT DISTINCT entity, round FROM log")
def _once(spark, sf):
    table = run_to_table(M.once_per_round(M.event_stream(spark, sf)))
    return table.select("entity", _day("round").alias("round"))


@query("st6_running_vector_mean", f"""WITH {LOG}, long AS (
  SELECT experiment AS "group", accuracy + 1 AS w, unnest([loss, accuracy]) AS val,
         unnest([0, 1])::INT AS idx FROM log)
SELECT "group", idx, round(sum(val * w) / sum(w), 6) AS val, 1 AS version FROM long GROUP BY ALL""")
def _running(spark, sf):
    share = F.get_json_object("props", "$.k").cast("int") / 100
    rows = M.event_stream(spark, sf).select(
        F.col("event_type").alias("group"), F.array("value", share).alias("vector"),
        (share + 1).alias("weight"),
    )
    return rounded(M.running_mean(run_partials(rows, M.mean_partials)), "val")


@query("st7_latest_state_fold", f"""WITH {LOG}
SELECT entity,
       arg_max(loss, (ts, event_id)) FILTER (experiment IN ('view', 'click')) AS loss,
       arg_max(experiment, (ts, event_id)) AS status
FROM log GROUP BY entity""")
def _state(spark, sf):
    rows = M.event_stream(spark, sf).select(
        F.col("user_id").alias("entity"), "ts", "event_id",
        F.when(F.col("event_type").isin("view", "click"), F.col("value")).alias("loss"),
        F.col("event_type").alias("status"),
    )
    cols = ["loss", "status"]
    return M.latest_state(run_partials(rows, lambda b: M.fold_partials(b, cols)), cols)


# -- sources and sinks --------------------------------------------------------------------------


def documents(spark, sf):
    """One document per (experiment, seed): a nested entry per day, four cluster entries in each."""
    clusters = cluster_metrics(spark, sf).groupBy("experiment", "seed", "round").agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos").alias("clusterId"), "accuracy"))).alias("c")
    )
    rows = round_metrics(spark, sf).join(clusters, ["experiment", "seed", "round"])
    model = F.struct(
        F.array(F.array("accuracy")).alias("layers"), F.array("loss").alias("bias"),
        F.lit(1).alias("version"),
    )
    entry = F.struct(
        "round", F.col("loss").alias("globalLoss"), F.col("accuracy").alias("globalAccuracy"),
        F.col("agg_ms").alias("aggregationTime"), F.col("silhouette").alias("silhouetteAvg"),
        F.transform("c", lambda e: F.struct(
            e["clusterId"].alias("clusterId"), e["accuracy"].alias("accuracy"), model.alias("weights")
        )).alias("clusterMetrics"),
        F.array(F.struct(F.lit("client-0").alias("clientId"), F.col("loss").alias("loss"),
                         model.alias("weights"))).alias("clientMetrics"),
        model.alias("globalModelWeights"),
    )
    # A run has one entry per day of the log.
    docs = rows.groupBy("experiment", "seed").agg(
        F.array_sort(F.collect_list(entry)).alias("roundHistory")
    )
    return docs.select(
        "experiment", F.lit(X.VERSION).alias("version"), F.lit("2024-02-01T00:00:00.000Z").alias("savedAt"),
        F.struct(F.lit("fedavg").alias("aggregationMethod"), F.col("seed").cast("long").alias("seed"))
        .alias("serverConfig"),
        "roundHistory",
    )


def saved(spark, sf):
    docs = documents(spark, sf)
    folder = new_folder(docs, "experiments")
    X.write_documents(docs, folder)
    return X.read_documents(spark, folder, multi_line=False)


@query("s4_experiment_scan", f"""WITH {ROUNDS}
SELECT experiment, seed::BIGINT AS seed, round, round(loss, 8) AS loss, round(accuracy, 8) AS accuracy,
       agg_ms, round(silhouette, 8) AS silhouette FROM rounds""")
def _scan(spark, sf):
    return rounded(X.rounds_of(saved(spark, sf)), "loss", "accuracy", "silhouette", digits=8)


@query("s5_header_guard", """WITH d AS (SELECT DISTINCT event_type, user_id % 3 AS seed FROM events)
SELECT seed <> 1 AS accepted, count(*) AS documents FROM d GROUP BY ALL""")
def _guard(spark, sf):
    docs = documents(spark, sf).withColumn(
        "version", F.when(F.col("serverConfig.seed") != 1, F.col("version"))
    )
    folder = new_folder(docs, "guarded")
    X.write_documents(docs, folder)
    good, bad = X.split_valid(X.read_documents(spark, folder, multi_line=False))
    both = good.select(F.lit(True).alias("accepted")).unionByName(
        bad.select(F.lit(False).alias("accepted"))
    )
    return both.groupBy("accepted").agg(F.count(F.lit(1)).alias("documents"))


@query("s6_pruned_sink", f"""WITH {LOG}, c AS (
  SELECT experiment, seed, round, pos, avg(accuracy) AS accuracy FROM log GROUP BY ALL)
SELECT experiment, seed::BIGINT AS seed, round, (row_number() OVER w - 1)::INT AS pos,
       round(accuracy, 8) AS accuracy, 0::BIGINT AS weights
FROM c WINDOW w AS (PARTITION BY experiment, seed, round ORDER BY pos)""")
def _pruned(spark, sf):
    docs = saved(spark, sf)
    kept = docs.select(
        "experiment", F.col("serverConfig.seed").alias("seed"),
        F.explode("roundHistory").alias("r"),
    ).select(
        "experiment", "seed", F.col("r.round").alias("round"),
        F.posexplode("r.clusterMetrics").alias("pos", "c"),
        F.col("r.globalModelWeights").isNotNull().cast("long").alias("g"),
    )
    return kept.select(
        "experiment", "seed", "round", "pos", F.round("c.accuracy", 8).alias("accuracy"),
        (F.col("c.weights").isNotNull().cast("long") + F.col("g")).alias("weights"),
    )


@query("s7_averaged_sink", f"""WITH {ROUNDS}
SELECT 'benchmark-' || experiment || '-avg'
       || (SELECT count(DISTINCT seed) FROM rounds r WHERE r.experiment = m.experiment)
       || 'seeds-t0' AS file, round, round(loss, 8) AS loss
FROM (SELECT experiment, round, avg(loss) AS loss FROM rounds GROUP BY experiment, round) m""")
def _averages(spark, sf):
    rows = round_metrics(spark, sf)
    seeds = rows.groupBy("experiment").agg(F.countDistinct("seed").alias("seeds"))
    means = H.average_rounds(rows).join(seeds, "experiment")
    table = X.write_averages(means, new_folder(rows, "averages"), "t0")
    return table.select("file", "round", F.round("loss", 8).alias("loss"))


@query("s8_experiment_summary", """WITH d AS (
  SELECT event_type AS experiment, user_id % 3 AS seed, count(DISTINCT ts::DATE) AS rounds
  FROM events GROUP BY ALL)
SELECT experiment, rounds::INT AS rounds, 'fedavg' AS aggregation, count(*) AS runs FROM d GROUP BY ALL""")
def _summary(spark, sf):
    rows = X.summarise(saved(spark, sf))
    return rows.groupBy("experiment", "rounds", "aggregation").agg(F.count(F.lit(1)).alias("runs"))


def _idx_folder(spark, sf):
    """The fleet as pixel files: eight by eight bytes per vector, a file pair per partition."""
    rows = fleet(spark, sf).select(
        F.transform("vector", lambda v: F.floor((v + 1) * 127.5).cast("int")).alias("pixels"),
        F.col("cluster").alias("label"),
    )
    folder = new_folder(rows, "idx")
    done = I.write_files(rows.repartition(4), folder, 8, 8)
    done.agg(F.sum("items")).collect()
    return folder


PIXELS = "list_sum(list_transform(embedding, lambda v: floor((v::DOUBLE + 1) * 127.5) / 255.0))"


@query("s1_image_scan", f"""SELECT count(*) AS images, round(sum({PIXELS}), 4) AS total FROM embeddings""")
def _images(spark, sf):
    images, _ = I.read_images(spark, f"{_idx_folder(spark, sf)}/*images*")
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return images.agg(F.count(F.lit(1)).alias("images"), F.round(F.sum(total), 4).alias("total"))


@query("s2_label_scan", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def _labels(spark, sf):
    labels, _ = I.read_labels(spark, f"{_idx_folder(spark, sf)}/*labels*")
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("s3_dataset_load", f"""SELECT label, count(*) AS n, round(sum({PIXELS}), 4) AS total
FROM embeddings GROUP BY label""")
def _dataset(spark, sf):
    rows = I.load_dataset(spark, _idx_folder(spark, sf))
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 4).alias("total"))


__all__ = ["documents", "saved"]
